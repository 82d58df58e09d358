"""Whitening, ranked search and language identification against brute force, with nulls, ties, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tilerain.llm import language_id, ranked_search, whitening

VECTORS = "vec_id long, embedding array<double>, n long, i int, component int, v string"
DOCS = "doc_id long, text string, lang string, source string, id string, item int, df long, term string"
ITEMS = "item_id long, text string, doc_id long, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 5, 6, 7, "x") for i, v in rows], VECTORS)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x", 3, 4, "y") for i, t, lang in rows], DOCS)


def exact_covariance(x):
    n, dims = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dims)]
    return [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3)) for j in range(dims)] for i in range(dims)], s


@pytest.mark.parametrize("scale", [1.0, 3e6, 1e12])
def test_whitening_equals_exact_arithmetic(spark, scale):
    rng = random.Random(5)
    rows = [(i, [scale * (rng.gauss(0, 1) + 3 * (j == 2) * rng.random()) for j in range(10)]) for i in range(57)]
    odd = [(100, None), (101, [1.0] * 9 + [None]), (102, [math.nan] * 10), (103, [math.inf] + [0.0] * 9), (None, rows[0][1]), (3, rows[0][1])]
    got = whitening.whitened(vectors(spark, rows + odd)).collect()
    used = rows + odd[4:]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in used]
    v, s = exact_covariance(x)
    n = len(x)
    values, axes = np.linalg.eigh(np.array(v))
    assert len(got) == 8 * n and {r["component"] for r in got} == set(range(1, 9)) and {r["n"] for r in got} == {n}
    for (vec_id, _), row in zip(used, x):
        mine = [r for r in got if r["vec_id"] == vec_id]
        want = sum((n * a - b) ** 2 for a, b in zip(row, s))
        assert any(r["deviation_exact"] == str(want) and r["deviation"] == (want if want < 1 << 63 else None) for r in mine)
        for c in range(8):
            axis = axes[:, -1 - c]
            value = float(np.array([float(Fraction(n * a - b, n)) for a, b in zip(row, s)]) @ axis / math.sqrt(values[-1 - c]))
            assert min(abs(abs(r["whitened"]) - abs(value)) for r in mine if r["component"] == c + 1) < 1e-6
    for r in got:
        assert math.isclose(r["explained"], values[-r["component"]] / values.sum(), rel_tol=1e-8) and r["identity_error"] < 1e-9
    signs = {}
    for r in got:
        if r["vec_id"] in (None, 3):
            signs.setdefault((r["component"], round(abs(r["whitened"]), 9)), set()).add(r["whitened"] > 0)
    assert all(len(found) == 1 for found in signs.values())


def test_polarised_covariances_are_exact():
    rng = random.Random(9)
    x = [[rng.randint(-10 ** 6, 10 ** 6) for _ in range(6)] for _ in range(40)]
    x = [r + [r[0] + r[1]] for r in x]
    want, s = exact_covariance(x)
    centre = [(2 * t + 40) // 80 for t in s]
    d = [[a - m for a, m in zip(r, centre)] for r in x]
    square = {(i, j): sum((r[i] + r[j] * (i != j)) ** 2 for r in d) for i in range(7) for j in range(i, 7)}
    got = whitening.covariance(40, [sum(r[i] for r in d) for i in range(7)], square)
    assert np.allclose(got, want, rtol=1e-15, atol=0)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(9)], [(1, []), (2, [])]])
def test_whitening_without_variance(spark, rows):
    got = whitening.whitened(vectors(spark, rows))
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_short_vectors_end_in_zeros(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (2, [3.0]), (3, [0.5, 4.0, 0.0])]
    full = [(i, v + [0.0] * (3 - len(v))) for i, v in rows]
    first, second = ([tuple(r) for r in whitening.whitened(vectors(spark, some)).orderBy("vec_id", "component").collect()] for some in (rows, full))
    assert first == second and len(first) == 3 * 2  # the third dimension has no variance


def ranking(docs, items, best=20):
    held = [(i, Counter(w.translate(LOWER) for w in TERM.findall(t or ""))) for i, t, _ in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        want = Counter(w.translate(LOWER) for w in TERM.findall(text or ""))
        scores = []
        for i, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            scores.append((sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 12 * m))
                               for w, k in want.items() if c[w]), i))
        ordered = sorted(((-s, i is not None, i) for s, i in scores if s > 0))[:best]
        out += [(item, at + 1, i, -s) for at, (s, _, i) in enumerate(ordered)]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("block", [2000, 3])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block)
    monkeypatch.setattr(ranked_search, "SHARD_KEYS", 700)
    monkeypatch.setattr(ranked_search, "GROUP_TERMS", 12)
    monkeypatch.setattr(ranked_search, "KNOWN_TERMS", 150)
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(400)] + ["Ünï", "ÀB", "İx", "a1", "日本"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice([" ", "-", "_", "."]) for _ in range(rng.choice([1, 5, 30, 200]))), "en") for i in range(180)]
    docs += [(500, None, "en"), (501, "", None), (502, "... --", "en"), (None, docs[0][1], "en"), (3, docs[4][1], "en"), (7, docs[7][1], "en")]
    docs += [(600 + i, docs[11][1].upper(), "en") for i in range(40)] + [(700, "w1 " * 40000 + "rare", "en")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "unknown words"), (23, docs[11][1]), (24, "rare w1 w1"), (None, "w5"), (0, "w5")]
    got = [tuple(r) for r in ranked_search.ranked(documents(spark, docs), spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS)).collect()]
    assert sorted(got, key=key) == sorted(ranking(docs, items), key=key)


def test_bounds_are_never_below_scores(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 60))), "en") for i in range(90)]
    index = ranked_search.signed(documents(spark, docs).select("doc_id", "text"))
    counts = {i: Counter(t.encode().split()) for i, t, _ in docs}
    n, total = len(docs), sum(sum(c.values()) for c in counts.values())
    terms = sorted({w for c in counts.values() for w in c})
    items = [(np.arange(len(terms)), np.arange(1.0, len(terms) + 1))]
    bounds = ranked_search._Bounds(items, terms, n, total)
    for shard in index.where("term IS NULL").collect():
        for _, bound in bounds.of(shard.asDict()):
            for doc, b in zip(shard["ids"], bound):
                m = 75 + (25 * sum(counts[doc].values()) * n) // total
                exact = sum((t + 1) * ranked_search._gain(counts[doc][w], m) for t, w in enumerate(terms) if counts[doc][w])
                assert exact <= b <= exact * 2.5


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a", "en")], []), ([(1, None, None)], [(1, "a")]), ([(1, "b", "en")], [(1, "a")])])
def test_ranked_search_without_results(spark, docs, items):
    got = ranked_search.ranked(documents(spark, docs), spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_gradient_equals_differences():
    net = language_id.Network(3, 4)
    net.p = {n: w.astype(np.float64) for n, w in net.p.items()}
    x, sizes = language_id.lanes([np.frombuffer(b"abcab", np.uint8), np.frombuffer(b"bca", np.uint8)])
    label = np.array([0, 2])
    grad = net.gradient(x, sizes, label)[1]
    for name, w in net.p.items():
        for _ in range(6):
            at = tuple(random.Random(name).randrange(k) for k in w.shape) if name[0] != "e" else (random.Random(name).randrange(w.shape[0]), 98)
            old = w[at]
            w[at] = old + 1e-2
            up = net.gradient(x, sizes, label)[0]
            w[at] = old - 1e-2
            down = net.gradient(x, sizes, label)[0]
            w[at] = old
            assert abs(grad[name][at] - (up - down) / 2e-2) < 1e-4


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(12)
    words = {"aa": ["the", "thing", "with", "ending", "this"], "bb": ["ñeta", "ción", "que", "los", "año"], "cc": ["über", "schön", "und", "nicht", "weiß"]}
    rows = [(i, sentences(rng, words[lang], rng.choice([3, 20, 90])), lang) for i, lang in ((i, "abc"[i % 3] * 2) for i in range(240))]
    return rows + [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "aa"), (903, sentences(rng, words["bb"], 60000), None),
                   (None, "über schön", "cc"), (5, "the thing", "aa"), (904, "²³ ½", "bb")]


def test_language_of_held_out_documents(spark, languages):
    rows = language_id.identified(documents(spark, languages)).collect()
    assert len(rows) == len(languages)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in languages if i is not None}
    assert all(r["held_out"] == held.get(r["doc_id"], False) and 0 <= r["score"] <= 1 for r in rows)
    truth = {i: lang for i, _, lang in languages[:240]}
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 5]
    assert len(tested) > 20 and all(r["lang_pred"] == truth[r["doc_id"]] for r in tested)
    other = {r["doc_id"]: r for r in rows}
    assert all((other[i]["lang_pred"], other[i]["score"], other[i]["n_letters"]) == ("und", 0.0, 0) for i in (900, 901, 902, 904))
    assert other[903]["lang_pred"] == "bb" and other[903]["agreeing"] > 0.9 * other[903]["n_letters"] > 100_000
    assert other[None]["lang_pred"] == "cc"


def test_held_out_labels_and_other_columns_play_no_part(spark, languages):
    def answers(rows, **swap):
        return sorted(((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language_id.identified(documents(spark, rows)).collect()))
    some = [r for r in languages[:120]]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in some]
    assert answers(some) == answers(wrong) == answers(some[::-1])


def test_texts_are_pooled_on_their_own(languages):
    net = language_id.Network(4)
    texts = [t for _, t, _ in languages]
    together = language_id.pooled(net, texts)
    for i in (0, 1, 2, 50, 243):
        assert np.allclose(together[i], language_id.pooled(net, [texts[i]])[0], rtol=1e-5)
    raw = np.frombuffer(texts[1].encode(), np.uint8)
    assert together[1, 1].sum() == language_id.LETTER[raw].sum()


def test_nothing_to_learn(spark):
    assert language_id.identified(documents(spark, [])).count() == 0
    rows = language_id.identified(documents(spark, [(1, "abc", None), (2, None, "en")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 2
