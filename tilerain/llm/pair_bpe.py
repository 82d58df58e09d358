"""Byte-pair encoding over a pair occurrence index, and decoding."""

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilerain.llm.common import mapped, text_of

#: Distinct words whose encoding a task remembers before it starts anew.
WORDS_KEPT = 400_000
#: White space as the vocabulary's pattern language defines it (fixed values).
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, more = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(more)
            more += 1
    return letters


class WordBpe:
    """A lower-casing byte-level vocabulary with word ends, read from its file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        first, made = {}, {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            key = vocab[a] << 20 | vocab[b]
            first[key] = rank
            made[rank] = vocab[a + b]
        order = sorted(first)
        self.pairs = np.array(order, np.int64)
        self.pair_rank = np.array([first[k] for k in order], np.int64)
        self.pair_of = {r: (k >> 20, k & 0xFFFFF) for k, r in first.items()}
        self.made = made
        kinds = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(kinds[0].replace(r"\s", SPACE))
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def words(self, text: str) -> list[str]:
        """The text's words and special tokens in order; a special token is a word that no ordinary word can equal."""
        out: list[str] = []
        for part in self.stops.split(text) if self.stops and "<|" in text else (text,):
            if part in self.special:
                out.append("\n" + part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out.extend(self.pattern.findall(part.lower()))
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 for pairs without one."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_rank[at], -1)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Encodes many distinct words at once.

        Every pair of neighbours stands in an index from its rank to all its positions. The lowest active rank is taken,
        its pairs are merged wherever they still stand, and the pairs on both sides of each merge join their own lists.
        Words don't touch, so taking ranks in ascending order over all of them equals doing so in each.
        """
        out: list[np.ndarray] = [np.array([self.special[w[1:]]], np.int32) if w[0] == "\n" else None for w in words]
        plain = [i for i, x in enumerate(out) if x is None]
        if not plain:
            return out
        raw = [words[i].encode("utf-8", "replace") for i in plain]
        size = np.array([len(b) for b in raw], np.int64)
        stop = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        sym[stop - 1] = self.last[data[stop - 1]]
        n = len(sym)
        nxt = np.arange(1, n + 1)
        nxt[stop - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[stop - size] = -1

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(nxt >= 0))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.pair_of[rank]
            at = at[(sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # a run of equal symbols pairs up from the left
                at = np.sort(at)
                free, chosen = -1, []
                for p, q in zip(at.tolist(), nxt[at].tolist()):
                    if p != free:
                        chosen.append(p)
                        free = q
                at = np.array(chosen)
            if not len(at):
                continue
            gone = nxt[at]
            sym[at] = self.made[rank]
            sym[gone] = -1
            after = nxt[gone]
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            add(np.unique(np.concatenate((before[before >= 0], at[after >= 0]))))
        live = sym >= 0
        ids = sym[live]
        ends = np.cumsum(live)[stop - 1]
        for i, x in zip(plain, np.split(ids, ends[:-1])):
            out[i] = x
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens in order, one space between; ids outside the vocabulary give nothing."""
        return " ".join([self.tokens[i] for i in ids if 0 <= i < len(self.tokens) and self.tokens[i]])


def default_vocabulary() -> str:
    """The installed word-end vocabulary of 49k pieces."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


_LOADED: dict[str, WordBpe] = {}


def _loaded(path: str | None) -> WordBpe:
    path = path or default_vocabulary()
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


class _Remembered:
    """Encodings of the words met so far in a task: ids as little-endian unsigned 32-bit integers, and their decoding."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.ids, self.texts = bpe, {}, {}

    def learn(self, lists: list[list[str]]) -> None:
        new = set().union(*lists).difference(self.ids)
        if len(self.ids) + len(new) > WORDS_KEPT:
            self.ids, self.texts = {}, {}
            new = set().union(*lists)
        order = list(new)
        for word, ids in zip(order, self.bpe.encode_words(order)):
            self.ids[word] = ids.astype("<u4").tobytes()
            self.texts[word] = self.bpe.decode(ids.tolist())


def _mapped(docs: DataFrame, text: str, doc_id: str, path: str | None, finish: Callable, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        memory = _Remembered(_loaded(path))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            lists = [memory.bpe.words(t) for t in texts]
            memory.learn(lists)
            yield pa.record_batch([ids, *finish(memory, lists)], names)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    return mapped(rows, run, schema)


def encoded(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) per row. Null texts count as empty and have no ids; rows are neither merged nor dropped.

    `vocabulary` is a file that every executor can open; the default is the installed one. A special token's string in a
    text is that token. An empty table gives no rows; further columns play no part.
    """
    def finish(memory, lists):
        flat = [b"".join(map(memory.ids.__getitem__, words)) for words in lists]
        ends = np.cumsum([0] + [len(x) // 4 for x in flat])
        values = np.frombuffer(b"".join(flat), "<u4").astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))]
    return _mapped(docs, text, doc_id, vocabulary, finish, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, ids: str = "ids", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, text per row of ids; null ids count as an empty list."""
    def run(batches):
        bpe = _loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return mapped(rows.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{ids}`").alias("ids")), run,
                  "doc_id long, text string")


def round_trip_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per row: `encoded` and `decoded` without sending ids between them."""
    def finish(memory, lists):
        ids = [b"".join(map(memory.ids.__getitem__, words)) for words in lists]
        texts = [" ".join(map(memory.texts.__getitem__, words)) for words in lists]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts])]
    return _mapped(docs, text, doc_id, vocabulary, finish,
                   "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
