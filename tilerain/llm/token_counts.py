"""Token counts of a unigram vocabulary, without building the tokens."""

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilerain.llm.common import mapped, text_of

#: Stands for a space in pieces.
BAR = "▁"
#: What an unknown character costs beyond the lowest score of the vocabulary.
UNKNOWN = 10.0
#: Distinct segments whose counts a task remembers before it starts anew.
SEGMENTS_KEPT = 400_000


class UnigramCounter:
    """Best segmentation of texts into scored pieces, as score and number of tokens only.

    An Aho-Corasick automaton lists all pieces that end at a character, the longest first; a piece replaces the best so
    far only with a strictly higher score, so of equal ones that with the earliest start wins, and an unknown character
    comes last. That is the tie rule of the tokenizer. A character no piece stands for is written as its UTF-8 bytes.
    """

    def __init__(self, pieces: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        # texts may be cut where no piece crosses: before a bar that follows another character, around line ends
        self.cut_bars = not any(BAR in p.lstrip(BAR) for p in pieces)
        lines = not any("\n" in p for p in pieces)
        self.parts = re.compile((f"{BAR}*[^{BAR}\n]+|{BAR}+|\n+" if lines else f"{BAR}*[^{BAR}]+|{BAR}+")) if self.cut_bars else None
        self.known: dict[str, tuple[float, int, int]] = {}

    @classmethod
    def from_file(cls, path: str) -> "UnigramCounter":
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls({model.id_to_piece(i): model.get_score(i) for i in usual})

    def best(self, segment: str) -> tuple[float, int, int]:
        """Score, tokens and unknown characters of the best segmentation."""
        n = len(segment)
        ends: list[list] = [[] for _ in range(n)] if n else []
        if n:
            for end, match in self.automaton.iter(segment):
                ends[end].append(match)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            best, at, one = None, end, False
            for size, worth in ends[end]:
                total = score[end + 1 - size] + worth
                one |= size == 1
                if best is None or total > best:
                    best, at = total, end + 1 - size
            if not one:
                total = score[end] + self.unknown
                if best is None or total > best:
                    score[end + 1] = total
                    count[end + 1] = count[end] + len(segment[end].encode("utf-8", "replace"))
                    odd[end + 1] = odd[end] + 1
                    continue
            score[end + 1], count[end + 1], odd[end + 1] = best, count[at] + 1, odd[at]
        return score[n], count[n], odd[n]

    def count(self, text: str) -> tuple[float, int, int]:
        """Score, tokens and unknown characters of a text; an empty text has none."""
        if not text:
            return 0.0, 0, 0
        text = BAR + text.replace(" ", BAR)
        if self.parts is None:
            return self.best(text)
        if len(self.known) > SEGMENTS_KEPT:
            self.known = {}
        known, score, count, odd = self.known, 0.0, 0, 0
        for part in self.parts.findall(text):
            found = known.get(part)
            if found is None:
                found = known[part] = self.best(part)
            score += found[0]
            count += found[1]
            odd += found[2]
        return score, count, odd


def default_vocabulary() -> str:
    """The installed vocabulary of 32k scored pieces."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


_LOADED: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_unknown (characters written as bytes), score (sum of the scores of the pieces) per row.

    The pieces of the vocabulary file and their scores make the unigram vocabulary. A space is written as a bar and one
    stands before the text. Null texts count as empty and have no tokens; rows are neither merged nor dropped; an empty
    table gives no rows; further columns play no part. `vocabulary` is a file that every executor can open.
    """
    def run(batches):
        path = vocabulary or default_vocabulary()
        if path not in _LOADED:
            _LOADED[path] = UnigramCounter.from_file(path)
        counter = _LOADED[path]
        for batch in batches:
            found = [counter.count(t) for t in batch.column(1).to_pylist()]
            score, count, odd = (np.array(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.record_batch([batch.column(0), pa.array(count, pa.int64()), pa.array(odd, pa.int64()),
                                   pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_unknown", "score"])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    return mapped(rows, run, "doc_id long, n_tokens long, n_unknown long, score double")
