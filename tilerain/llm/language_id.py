"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilerain.llm.common import mapped

#: Hidden units of a direction, and bytes of a segment: the network reads a text segment by segment, each from both ends.
HIDDEN, SEGMENT = 8, 128
#: Training: documents at most (shared equally among the languages, those with the smallest hashes of the id), segments per
#: document at most (evenly spread over the whole text), steps at least, segments per step, step size.
TRAIN_DOCS, TRAIN_SEGMENTS, STEPS, STEP_SEGMENTS, RATE = 1600, 4, 200, 128, 0.02
#: Segments that are read at once.
LANES = 4096
#: Answer for texts without a letter.
UNDETERMINED = "und"

#: Bytes that are part of letters: ASCII letters, and all bytes of other characters.
LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def cut(raw: np.ndarray, width: int = SEGMENT) -> list[np.ndarray]:
    """A text's bytes as segments of `width`, the last one shorter."""
    return [raw[at:at + width] for at in range(0, len(raw), width)]


def lanes(segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Segments as columns (position, lane), zeros below short ones, and their lengths."""
    sizes = np.array([len(s) for s in segments], np.int64)
    out = np.zeros((len(segments), int(sizes.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(segments) if segments else np.zeros(0, np.uint8)
    return np.ascontiguousarray(out.T), sizes


class Network:
    """Two gated recurrent layers, one from each end, and a softmax at every position.

    For each direction, with the byte x and the state h: z, r = sigmoid(E x + U h), c = tanh(E x + r * U h), h + z * (c - h).
    Matrices are kept with lanes last, so that every step works on contiguous rows.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.p = {"out": rng.normal(0, 0.3, (classes, 2 * hidden)).astype(np.float32), "bias": np.zeros((classes, 1), np.float32)}
        for side in ("f", "b"):
            self.p["e" + side] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.p["u" + side] = rng.normal(0, hidden ** -0.5, (3 * hidden, hidden)).astype(np.float32)

    def _run(self, side: str, x: np.ndarray, inside: np.ndarray | None, keep: bool):
        """States after each position (position, hidden, lane); with `keep` also what the way back needs."""
        e, u, k = self.p["e" + side], self.p["u" + side], self.hidden
        steps, width = x.shape
        states = np.zeros((steps, k, width), np.float32)
        gates = np.empty((steps, 2 * k, width), np.float32) if keep else None
        news, pulls = (np.empty_like(states), np.empty_like(states)) if keep else (None, None)
        h = np.zeros((k, width), np.float32)
        a, b = np.empty((3 * k, width), np.float32), np.empty((3 * k, width), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            np.take(e, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=b)
            zr = a[:2 * k]
            zr += b[:2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            c = a[2 * k:]
            if keep:
                gates[t], pulls[t] = zr, b[2 * k:]
            b[2 * k:] *= zr[k:]
            c += b[2 * k:]
            np.tanh(c, out=c)
            if keep:
                news[t] = c
            c -= h
            c *= zr[:k]
            h = h + c if inside is None else (h + c) * inside[t]
            states[t] = h
        return states, gates, news, pulls

    def probabilities(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The languages' probabilities at every position: (position, class, lane)."""
        inside = self._inside(x, sizes)
        f, b = self._run("f", x, inside, False)[0], self._run("b", x, inside, False)[0]
        out, k = self.p["out"], self.hidden
        logits = np.matmul(out[:, :k], f)
        logits += np.matmul(out[:, k:], b)
        logits += self.p["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    @staticmethod
    def _inside(x, sizes):
        """1 inside a segment, 0 below its end, where states stay zero; None if all segments are whole."""
        return None if (sizes == len(x)).all() else (np.arange(len(x))[:, None] < sizes).astype(np.float32)

    def gradient(self, x: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of all positions and its gradient, by backpropagation through time."""
        k, (steps, width) = self.hidden, x.shape
        inside = self._inside(x, sizes)
        runs = {side: self._run(side, x, inside, True) for side in ("f", "b")}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=1)
        logits = np.matmul(self.p["out"], both) + self.p["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        n = float(sizes.sum())
        picked = prob[:, label, np.arange(width)]
        weight = np.ones((steps, width), np.float32) if inside is None else inside
        loss = -float((np.log(picked + 1e-9) * weight).sum()) / n
        prob[:, label, np.arange(width)] -= 1
        prob *= (weight / n)[:, None, :]
        grad = {"out": np.einsum("tcl,thl->ch", prob, both, optimize=True), "bias": prob.sum(axis=(0, 2))[:, None]}
        above = np.matmul(self.p["out"].T, prob)
        for side, part in (("f", above[:, :k]), ("b", above[:, k:])):
            states, gates, news, pulls = runs[side]
            u = self.p["u" + side]
            du, pushed = np.zeros_like(u), np.empty((steps, 3 * k, width), np.float32)
            carry, zero = np.zeros((k, width), np.float32), np.zeros((k, width), np.float32)
            order = range(steps - 1, -1, -1) if side == "f" else range(steps)
            for t in order:
                prior = t - 1 if side == "f" else t + 1
                h = states[prior] if 0 <= prior < steps else zero
                d = part[t] + carry
                if inside is not None:
                    d = d * inside[t]
                z, r, c, pull = gates[t, :k], gates[t, k:], news[t], pulls[t]
                dc = d * z * (1 - c * c)
                da = np.concatenate([d * (c - h) * z * (1 - z), dc * pull * r * (1 - r), dc])
                db = np.concatenate([da[:2 * k], dc * r])
                carry = d * (1 - z) + u.T @ db
                du += db @ h.T
                pushed[t] = da
            grad["e" + side] = np.stack([np.bincount(x.ravel(), pushed[:, i].ravel(), 256) for i in range(3 * k)]).astype(np.float32)
            grad["u" + side] = du
        return loss, grad


def fitted(segments: list[np.ndarray], labels: list[int], classes: int, least: int = STEPS, seed: int = 7) -> Network:
    """A network fitted on labelled segments by gradient steps with running moments. The same segments give the same network."""
    net, rng = Network(classes, seed=seed), np.random.default_rng(seed)
    first = {n: np.zeros_like(w) for n, w in net.p.items()}
    second = {n: np.zeros_like(w) for n, w in net.p.items()}
    y, step = np.array(labels), 0
    passes = -(-least // -(-len(segments) // STEP_SEGMENTS))
    steps = passes * -(-len(segments) // STEP_SEGMENTS)
    for _ in range(passes):
        order = rng.permutation(len(segments))
        for at in range(0, len(order), STEP_SEGMENTS):
            some = order[at:at + STEP_SEGMENTS]
            x, sizes = lanes([segments[i] for i in some])
            _, grad = net.gradient(x, sizes, y[some])
            reach = min(1.0, 1.0 / (float(np.sqrt(sum((g * g).sum() for g in grad.values()))) + 1e-9))
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for n, g in grad.items():
                g = g * reach
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                net.p[n] -= (rate * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: str = "crc32(cast(id as binary)) % 5 = 0",
            max_docs: int = TRAIN_DOCS) -> tuple[Network | None, list[str]]:
    """The network and the languages it tells apart, learned from rows with a language and an id that `held_out` does not hold
    back. Only the sample's segments reach the driver: max_docs * TRAIN_SEGMENTS of SEGMENT bytes at most."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.where(f"id IS NOT NULL AND lang IS NOT NULL AND NOT ({held_out})").where(F.col("text").rlike(r"\p{L}"))
    hashed = rows.select("id", "lang", F.xxhash64("id").alias("hash")).withColumn("part", F.shiftrightunsigned("hash", 56))
    # the smallest hashes of a language lie in its first parts: 256 counts for each say in how many
    counts: dict[str, list[int]] = {}
    for r in hashed.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["lang"], [0] * 256)[r["part"]] = r["n"]
    languages = sorted(counts)
    if not languages:
        return None, []
    most = max(1, max_docs // len(languages))
    reach = {v: next((i for i in range(256) if sum(n[:i + 1]) >= most), 255) for v, n in counts.items()}
    first = hashed.where(F.col("part") <= F.create_map(*[F.lit(x) for item in reach.items() for x in item])[F.col("lang")])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("part", "hash", "id"))
    picked = first.withColumn("nth", nth).where(F.col("nth") <= most).select("id", "lang").distinct()
    sample = rows.join(F.broadcast(picked), ["id", "lang"]).select("id", "lang", "text")
    index = {v: i for i, v in enumerate(languages)}

    def run(batches):
        for batch in batches:
            out = []
            for i, l, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                parts = [s for s in cut(np.frombuffer(t.encode("utf-8", "replace"), np.uint8)) if LETTER[s].any()]
                for at in sorted({len(parts) * n // TRAIN_SEGMENTS for n in range(TRAIN_SEGMENTS)}):
                    out.append((i, at, index[l], parts[at].tobytes()))
            yield pa.record_batch([pa.array([o[c] for o in out], k) for c, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))],
                                  ["id", "at", "label", "bytes"])
    found = mapped(sample, run, "id string, at int, label int, bytes binary").collect()
    found = sorted((r["id"], r["at"], r["label"], bytes(r["bytes"])) for r in found)[:max_docs * TRAIN_SEGMENTS]
    return fitted([np.frombuffer(r[3], np.uint8) for r in found], [r[2] for r in found], len(languages)), languages


def pooled(net: Network, texts: list[str | None]) -> np.ndarray:
    """Per text, the sums over the bytes of its letters of each language's probability, and of the positions labelled with it:
    (text, 2, class). Segments of equal length share lanes, so a text's figures don't depend on the other texts."""
    total = np.zeros((len(texts), 2, net.classes))
    segments, owner = [], []

    def read(some: list[int]):
        x, sizes = lanes([segments[i] for i in some])
        prob = net.probabilities(x, sizes)
        letter = LETTER[x] & (np.arange(len(x))[:, None] < sizes)
        label = prob.argmax(axis=1)
        mine = [owner[i] for i in some]
        for c in range(net.classes):
            np.add.at(total[:, 0, c], mine, (prob[:, c] * letter).sum(axis=0, dtype=np.float64))
            np.add.at(total[:, 1, c], mine, ((label == c) & letter).sum(axis=0))

    def flush():
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        for at in range(0, len(order), LANES):
            read(order[at:at + LANES])
        segments.clear()
        owner.clear()
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)
        for at in range(0, len(raw), SEGMENT * LANES):
            parts = cut(raw[at:at + SEGMENT * LANES])
            segments.extend(parts)
            owner.extend([i] * len(parts))
            if len(segments) >= 4 * LANES:
                flush()
    flush()
    return total


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_letters, agreeing of each row of `docs`.

    Every byte of the whole text is labelled by the network; a document's probabilities are the means over the bytes of its
    letters. lang_pred is the language of the largest, score that mean, n_letters how many bytes it is over, agreeing how many
    of them are labelled with lang_pred themselves. Null texts and texts without a letter are `und` with score 0, and so is
    every text if nothing could be learned. Segments are read on their own, so a text costs in proportion to its length and
    memory stays bounded. A null id is not held out and not learned from. Repeated rows are answered each; an empty table
    gives no rows; further columns play no part.
    """
    net, languages = trained(docs, doc_id, text, lang, **options)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                known = [net is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
                total = pooled(net, [t if k else None for t, k in zip(texts, known)]) if net is not None else np.zeros((len(texts), 2, 1))
                best, letters = total[:, 0].argmax(axis=1), np.maximum(total[:, 0].sum(axis=1), 1e-9)
                every = np.arange(len(texts))
                # equal runs differ in the last bits of single-precision steps
                score = np.round(np.clip(total[every, 0, best] / letters, 0.0, 1.0), 7)
                yield pa.record_batch([
                    part.column(0), pa.array([languages[b] if k else UNDETERMINED for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, score, 0.0)), pa.array(np.rint(total[:, 0].sum(axis=1)).astype(np.int64)),
                    pa.array(total[every, 1, best].astype(np.int64))], ["doc_id", "lang_pred", "score", "n_letters", "agreeing"])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = mapped(rows, run, "doc_id long, lang_pred string, score double, n_letters long, agreeing long")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_letters", "agreeing")
