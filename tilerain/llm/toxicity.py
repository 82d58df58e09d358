"""Toxicity scores of texts whose spelling is first restored by a noisy-channel decoder."""

import math
import re
from collections import Counter, defaultdict
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilerain.llm.common import mapped, stored, text_of

#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of the id.
TRAIN_ROWS = 8000
#: Features of the classifier at most, and the least association (in standard deviations) and toxic rows of one.
FEATURES, MIN_Z, MIN_ROWS = 1024, 3.0, 3
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 6, 8)
#: Symbols of the character model: a boundary, 26 letters, any other letter.
SYMBOLS = 28
#: What look-alike characters may stand for (fixed values).
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
         "€": "e", "(": "c", "¡": "i"}
#: Log costs of the channel: a look-alike, a letter of a run that is dropped, a separator that is dropped or that parts words.
LOOK_COST, REPEAT_COST, GAP_COST, PART_COST = -1.0, -0.7, -0.2, -1.0
#: Longest stretch whose decoding is kept for the next time.
REMEMBERED = 40
_L = r"[^\W\d_]"
_D = "[0134578@$!|+€(¡9]"
_X = rf"(?:{_L}|{_D})"
_GAPPED = rf"(?<![\w@$]){_X}(?P<gap>[ .\-_*/~]){_X}(?:(?=(?P=gap))|(?![\w@$]))(?:(?P=gap){_X}(?:(?=(?P=gap))|(?![\w@$])))++"
_MIXED = rf"(?<![\w@.+/=-])(?:{_L}*+{_D}++)++{_L}++(?![\w@=])|(?<![\w@.+/=-]){_L}{{2,}}+(?:[013457@$]{_L}*+)++(?![\w@.=])"
_DOUBLED = rf"(?<!\w)(?={_L}++(?!\w)){_L}*?(?P<twice>{_L})(?P=twice){_L}*+"
#: Stretches that may hide a word: single characters set apart, letters mixed with look-alikes, doubled letters and longer
#: runs. Groups that repeat are possessive, so that a try costs no more than its stretch.
SUSPECT = re.compile(f"{_GAPPED}|{_MIXED}|{_DOUBLED}")
MIXED, DOUBLED = re.compile(_MIXED), re.compile(_DOUBLED)
#: Whether letters and look-alikes are a suspect hangs on their two ends, so of a long unbroken stretch only the first places
#: that a try may start at are tried: all others would read it again to the same end.
LONG_FROM = 1000
LONG = re.compile(rf"(?<!{_L})(?<!{_D}){_X}{{{LONG_FROM},}}+")
FIRST = re.compile(rf"(?<![\w@.+/=-]){_X}")
PART = re.compile(rf"(?:{_L}|[013457@$])++")
FIRST_LETTERS = re.compile(rf"(?<![\w@.+/=-]){_L}{{2}}")
WORD = re.compile(rf"{_L}+")
#: Blanks that a stretch of single characters may run across; no other white space lies inside a stretch.
CROSSED = re.compile(rf" (?={_X}(?![\w@$]))(?<={_X} )(?<![\w@$]{_X} )")
SOLID = re.compile(r"\S+")
#: Pieces of a text whose features are kept for the next time, and the longest such piece.
PIECES_KEPT, PIECE_LENGTH = 200_000, 40


def pieces(text: str) -> list[str]:
    """The text, cut at white space that no suspicious stretch runs across."""
    crossed = {found.start() for found in CROSSED.finditer(text)}
    if not crossed:
        return text.split()
    out, start, end = [], 0, -1
    for found in SOLID.finditer(text):
        if end not in crossed:
            if end >= 0:
                out.append(text[start:end])
            start = found.start()
        end = found.end()
    out.append(text[start:end])
    return out


def symbols(text: str) -> np.ndarray:
    """The text in lower case as symbols of the character model; other characters than letters are boundaries."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    return _SYMBOL[raw]


_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[ord("a"):ord("z") + 1] = np.arange(1, 27)
_SYMBOL[128:] = 27


def character_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How often each four symbols follow one another, over all texts; at most SYMBOLS ** 4 figures reach the driver."""
    def run(batches):
        total = np.zeros(SYMBOLS ** 4, np.int64)
        for batch in batches:
            s = symbols("   ".join(batch.column(0).to_pylist()))
            for at in range(0, len(s) - 3, 1 << 20):
                x = s[at:at + (1 << 20) + 3]
                total += np.bincount(((x[:-3] * SYMBOLS + x[1:-2]) * SYMBOLS + x[2:-1]) * SYMBOLS + x[3:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])
    rows = mapped(docs.select(text_of(text).alias("text")), run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS ** 4)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts


def character_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after three others, smoothed by the shorter contexts."""
    c4 = counts.reshape(-1, SYMBOLS)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in (1, 2, 3, 4):
        c = c4.reshape([SYMBOLS] * 4).sum(axis=tuple(range(4 - order))).reshape(-1, SYMBOLS)
        lower = np.tile(p, (len(c) // len(p.reshape(-1, SYMBOLS)), 1)) if order > 1 else p.reshape(1, -1)
        p = (c + 2.0 * lower) / (c.sum(axis=1, keepdims=True) + 2.0)
    return np.log(p).astype(np.float32)


class Restorer:
    """Viterbi decoding of suspicious stretches. Each character is a column of a lattice: letters stand for themselves,
    look-alikes for letters, separators for nothing or the end of a word, and a run of one letter for one or two of it. A path is
    worth what the character model gives its letters plus the costs of its channel; the states are the last three symbols."""

    def __init__(self, model: np.ndarray):
        self.logs, self.known = model.tolist(), {}

    def _columns(self, stretch: str, gap: str | None) -> list[list[tuple[str, float]]]:
        columns, i = [], 0
        while i < len(stretch):
            c, run = stretch[i], 1
            while i + run < len(stretch) and stretch[i + run] == c:
                run += 1
            if c == gap or not (c.isalpha() or c in LOOKS):
                columns.append([("", GAP_COST), (" ", PART_COST)])
            else:
                letters = [(c, 0.0)] if c.isalpha() else [(x, LOOK_COST) for x in LOOKS[c]]
                options = []
                for letter, cost in letters:
                    options.append((letter, cost + (run > 1) * REPEAT_COST))
                    if run > 1:  # a pair may be meant, a longer run never is
                        options.append((letter * 2, 2 * cost + (run > 2) * REPEAT_COST))
                columns.append(options)
            i += run
        return columns

    def decode(self, stretch: str, gap: str | None = None) -> str:
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # the best way to each state, as a chain from its end
        for options in self._columns(stretch, gap):
            step: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, way) in paths.items():
                for letters, cost in options:
                    s, total = state, score + cost
                    for x in letters:
                        code = ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27
                        total += self.logs[s][code]
                        s = s * SYMBOLS % SYMBOLS ** 3 + code
                    if s not in step or total > step[s][0]:
                        step[s] = (total, (way, letters))
            paths = step
        way = max(paths.items(), key=lambda p: p[1][0] + self.logs[p[0]][0])[1][1]
        parts = []
        while way is not None:
            way, letters = way
            parts.append(letters)
        return "".join(reversed(parts))

    def restore(self, text: str) -> str:
        """The text in lower case with every suspicious stretch decoded."""
        text, parts, at = text.lower(), [], 0
        for run in LONG.finditer(text):
            if run.start() >= at:
                parts.append(SUSPECT.sub(self.decoded, text[at:run.start()]))
                at = run.start()
                for found in self._in_long(text, at, run.end()):
                    parts += [text[at:found.start()], self.decoded(found)]
                    at = found.end()
                parts.append(text[at:run.end()])
                at = max(at, run.end())
        return "".join(parts) + SUSPECT.sub(self.decoded, text[at:] if at else text)

    def _in_long(self, text: str, at: int, end: int):
        """Suspects of an unbroken stretch: the whole of it, parts without signs, or words with doubled letters."""
        def doubled(start: int, stop: int):
            while (word := DOUBLED.search(text, start, stop)) is not None:
                start = word.end()
                if not (start == end < len(text) and (text[end].isalnum() or text[end] == "_")):
                    yield word

        tries = [FIRST.search(text, at, end)]
        tries += [FIRST_LETTERS.search(text, part.start(), part.end()) for part in PART.finditer(text, at, end)]
        for first in tries:
            found = first and first.start() >= at and MIXED.match(text, first.start())
            if found:
                yield from doubled(at, found.start())
                yield found
                at = found.end()
        yield from doubled(at, end)

    def decoded(self, found: re.Match) -> str:
        stretch, gap = found.group(), found.groupdict().get("gap")
        if len(stretch) > REMEMBERED:
            return self.decode(stretch, gap)
        if stretch not in self.known:
            if len(self.known) > 100_000:
                self.known = {}
            self.known[stretch] = self.decode(stretch, gap)
        return self.known[stretch]


def features(restored: str) -> Counter:
    """Words and word beginnings with their counts."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(restored)).items():
        out["=" + word] += n
        for k in PREFIXES:
            if len(word) > k:
                out[word[:k]] += n
    return out


class Reader:
    """Features of whole texts, piece by piece. A short piece that comes again, in this text or another, is not decoded again."""

    def __init__(self, model: np.ndarray, wanted: Collection[str] | None = None):
        """`wanted` names the features that are counted; all without it."""
        self.restorer, self.wanted, self.known = Restorer(model), wanted, {}

    def _piece(self, piece: str) -> tuple[int, int, Collection[str]]:
        """Stretches that may hide a word, words, and features, repeats included, of a piece in lower case."""
        if len(piece) < LONG_FROM:
            restored, changed = SUSPECT.subn(self.restorer.decoded, piece)
        else:
            restored, changed = self.restorer.restore(piece), sum(1 for _ in SUSPECT.finditer(piece))
        words, wanted, found = WORD.findall(restored), self.wanted, []
        for word in words:
            for f in ("=" + word, *[word[:k] for k in PREFIXES if len(word) > k]):
                if wanted is None or f in wanted:
                    found.append(f)
        return (changed, len(words), found) if found or changed or len(words) != 1 else _PLAIN

    def read(self, text: str) -> tuple[int, int, dict[str, int]]:
        """Stretches that may hide a word, words, and features with their counts, of the restored text."""
        changed, words, out = 0, 0, {}
        for piece, times in Counter(pieces(text.lower())).items():
            one = self.known.get(piece)
            if one is None:
                one = self._piece(piece)
                if len(piece) <= PIECE_LENGTH:
                    if len(self.known) >= PIECES_KEPT:
                        self.known = {}
                    self.known[piece] = one
            changed += times * one[0]
            words += times * one[1]
            for f in one[2]:
                out[f] = out.get(f, 0) + times
        return changed, words, out


#: One word without any wanted feature, as most pieces are.
_PLAIN = (0, 1, ())


def _fit(rows: list[tuple[list[int], list[float], float]], n: int) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge, by gradient steps with running moments."""
    x = np.zeros((len(rows), n + 1), np.float32)
    y = np.zeros(len(rows), np.float32)
    for i, (at, value, label) in enumerate(rows):
        x[i, at] = value
        y[i] = label
    x[:, n] = 1
    w = np.zeros(n + 1, np.float32)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w[n] = math.log(rate / (1 - rate))
    first, second = np.zeros_like(w), np.zeros_like(w)
    ridge = np.full(n + 1, 1.0 / max(len(rows), 1), np.float32) * 0.3
    ridge[n] = 0
    for step in range(1, 251):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(rows) + ridge * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
    return w[:n], float(w[n])


def _value(count: float, words: int) -> float:
    """A count as the classifier takes it: growing slowly, and less in long texts."""
    return math.log1p(count) / (1 + 0.1 * math.log1p(words / 200))


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
            usable: str = "crc32(cast(id as string)) % 4 <> 2", max_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[str, float], float]:
    """The character model of all texts, and the weights and intercept of a classifier.

    Labels are learned from the rows that `usable` allows, at most `max_rows`, those with the smallest hashes of the id.
    Association with the label picks at most `FEATURES` features out of an aggregation; only these, and their counts in
    the sampled rows, reach the driver.
    """
    model = character_model(character_counts(docs, text))
    marks = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    marks = marks.where("id IS NOT NULL AND label IN (0, 1)").where(usable).groupBy("id").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), text_of(text).alias("text"))
    sample = stored(rows.join(marks, "id").select("id", "label", "text").dropDuplicates(["id"]))

    def read(batches, wanted=None):
        reader = Reader(model, wanted)
        for batch in batches:
            for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                yield i, *reader.read(t)[1:]

    def tallies(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for toxic, _, found in read(batches):
            for f in found:
                seen[f][toxic] += 1
        names = list(seen)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([seen[f][0] for f in names], pa.int64()),
                               pa.array([seen[f][1] for f in names], pa.int64())], ["feature", "clean", "toxic"])

    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    n, bad = size["n"] or 0, size["toxic"] or 0
    if not bad or bad == n:
        return model, {}, math.log((bad + 0.5) / (n - bad + 0.5))
    found = mapped(sample, tallies, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    expected = (F.col("clean") + F.col("toxic")) * (bad / n)
    z = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    best = (found.where(F.col("toxic") >= MIN_ROWS).withColumn("z", z).where(F.col("z") >= MIN_Z)
            .orderBy(F.desc("z"), "feature").limit(FEATURES).collect())
    index = {r["feature"]: i for i, r in enumerate(best)}

    def vectors(batches):
        out = []
        for toxic, words, found in read(batches, index):
            hits = [(index[f], _value(c, words)) for f, c in found.items()]
            out.append(([h[0] for h in hits], [h[1] for h in hits], toxic))
        yield pa.record_batch([pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.float64())),
                               pa.array([o[2] for o in out], pa.int32())], ["at", "value", "label"])
    points = [(r["at"], r["value"], float(r["label"]))
              for r in mapped(sample, vectors, "at array<int>, value array<double>, label int").collect()]
    weights, bias = _fit(points, len(index))
    return model, {f: float(weights[i]) for f, i in index.items()}, bias


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, restored_parts (stretches that decoding changed) per row of `docs`.

    The score is the probability, by the classifier, that the restored text is labelled toxic; nothing but the text goes
    into it. held_out marks the ids whose labels are never learned from. Null texts count as empty and get the score of a
    text without features. A null id counts as not held out. Without any toxic label every score is the smoothed share of
    toxic labels. Rows are neither merged nor dropped; an empty table gives no rows; further columns play no part.
    """
    model, weights, bias = trained(docs, labels, text, doc_id, **options)

    def run(batches):
        reader = Reader(model, weights)
        for batch in batches:
            scores, parts = [], []
            for t in batch.column(1).to_pylist():
                changed, words, found = reader.read(t)
                total = bias + math.fsum(weights[f] * _value(n, words) for f, n in found.items())
                scores.append(1 / (1 + math.exp(-min(max(total, -50), 50))))
                parts.append(changed)
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(parts, pa.int64())],
                                  ["doc_id", "score", "restored_parts"])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return (mapped(rows, run, "doc_id long, score double, restored_parts long")
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "restored_parts"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, all columns, that `scored` does not predict to be toxic; ids are taken as unique."""
    bad = scored(docs, labels, text, doc_id, **options).where("predicted = 1").select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(bad, docs[f"`{doc_id}`"].cast("long").eqNullSafe(F.col("__bad_id")), "left_anti")
