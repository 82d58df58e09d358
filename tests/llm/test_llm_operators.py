"""The training-text operators against brute force, on small tables with nulls, ties, long texts and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tilerain.llm import (curves, exact_dedup, html_density, induced, mixing, pair_bpe, pii, simhash, suffix_dedup, token_counts,
                          toxicity)
from tilerain.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, body string, mark long, key long, node long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None if n % 7 == 3 else f"s{n % 3}", 1, 9, "x", 9, 9, 9) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "idiot", "ümlaut", "x1"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [None, "", "   ", "a\tb  c", "a b c", *some, *some[:10], "word " * 30000]


def test_exact_owners(spark, texts):
    rows = exact_dedup.exact_duplicates(documents(spark, texts), budget=5000).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, size = {}, Counter(norm)
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    assert sorted(map(tuple, rows)) == sorted((i, first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm))
    kept = exact_dedup.without_copies(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values()) and kept.columns[-1] == "node"


def test_null_ids_never_win(spark):
    rows = exact_dedup.exact_duplicates(documents(spark, ["a", "a", "b"], [None, 5, None])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in rows) == [("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_trie_spills_whole(spark):
    rng = random.Random(1)
    trie, want = exact_dedup.PatriciaOwners(3000), {}
    for i in range(5000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        trie.insert(key, i)
        a, n = want.get(key, (i, 0))
        want[key] = (min(a, i), n + 1)
    got = list(trie.drain())
    assert len(got) == len(want) and {k: (a, n) for k, a, n in got} == want


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [1024, 8])
def test_links_hold_every_near_pair(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(15)}
    for _ in range(400):
        x = rng.choice(sorted(prints))
        for i in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << i
        prints.add(x)
    prints = sorted(prints)
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    signed = {x: x - (x >> 63 << 64) for x in prints}
    df = spark.createDataFrame([(signed[x], [signed[x]]) for x in prints], "node long, prints array<long>")
    named = {r.node: r.root for r in components(simhash.links(df)).collect()}
    ours, theirs = {}, {}
    for x in prints:
        ours.setdefault(named.get(signed[x], signed[x]), set()).add(x)
        theirs.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("keyed", [1 << 15, 50])
def test_values_meet_by_parts(spark, monkeypatch, keyed):
    """The masks of a variant's senders, folded over the parts, are those of all values one bit away; a value is three rows."""
    monkeypatch.setattr(simhash, "KEYED", keyed)
    rng = random.Random(keyed)
    base = [rng.getrandbits(32) for _ in range(40)]
    values = {b ^ sum(1 << i for i in rng.sample(range(32), rng.randrange(5))) for b in base for _ in range(30)}
    values |= {7 << 32 | v for v in list(values)[:200]} | {rng.getrandbits(11) << 21 for _ in range(300)}
    keys = sorted((i << simhash.PART_SHIFT | v & (p | 0xFFFFFF << 32), v) for v in values for i, p in enumerate(simhash.PARTS))
    got = defaultdict(int)
    for batch in simhash._met([pa.record_batch([pa.array([k for k, _ in keys]), pa.array([v for _, v in keys])], ["key", "piece"])]):
        for variant, senders in zip(*(c.to_pylist() for c in batch.columns)):
            got[variant] |= senders
    want = defaultdict(int)
    for v in values:
        want[v] |= 1
        for i in range(32):
            want[v ^ 1 << i] |= 1 << i + 1
    assert got == {k: m for k, m in want.items() if m.bit_count() > 1}
    df = spark.createDataFrame([(v,) for v in values], "piece long")
    buckets = defaultdict(set)
    for r in simhash._meetings(df).collect():
        buckets[r.bucket].add(r.piece)
    met = {(a, b) for members in buckets.values() for a in members for b in members if a < b}
    assert met == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    plan = simhash._meetings(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("shiftleft")  # variants of single values are made in tasks, not as rows


@pytest.mark.parametrize("strays", [0, 25])
def test_nodes_of_one_root_are_not_joined_to_buckets(spark, monkeypatch, strays):
    """What is connected already is left out before nodes are joined to buckets; all else is found as by brute force."""
    made = []
    monkeypatch.setattr(simhash, "stored", lambda df, store=simhash.stored: made.append(store(df)) or made[-1])
    monkeypatch.setattr(simhash, "KEYED", 64)
    rng = random.Random(strays)
    low, high = rng.getrandbits(62), rng.getrandbits(62)

    def around(x, n):
        return {x ^ sum(1 << i for i in rng.sample(range(62), rng.randrange(4))) for _ in range(n)}
    near, others = sorted(around(low, 300)), sorted(around(high, 40))
    root = {x: near[0] for x in near} | {x: x for x in others}
    root |= {x: x for x in near[1:strays + 1]}
    df = spark.createDataFrame([(x, [x], r) for x, r in root.items()], "node long, prints array<long>, root long")
    linked = {(r.a, r.b) for r in simhash.links(df).collect()}
    shared = [r.node for f in made if "bucket" in f.columns for r in f.collect()]
    assert set(shared) & set(others) and (strays or not set(shared) & set(near))

    def groups(pairs):
        own = {x: x for x in root}

        def find(x):
            while own[x] != x:
                x = own[x]
            return x
        for a, b in [*root.items(), *pairs]:
            own[find(a)] = find(b)
        return sorted(sorted(x for x in own if find(x) == y) for y in own if own[y] == y)
    assert groups(linked) == groups([(a, b) for a in root for b in root if a < b and (a ^ b).bit_count() <= 3])


def test_simhash_groups(spark, texts):
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(documents(spark, texts)).collect()}
    assert {i: f for i, (f, _) in rows.items()} == {i: "%016x" % fingerprint(t) for i, t in enumerate(texts)}
    assert rows[0][1] == rows[1][1] == rows[2][1] == 0
    assert simhash.simhash_recall(0.08, 6) > 0.95


def test_near_copies_go(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    near, other = list(base), [f"v{rng.randint(0, 5000)}" for _ in range(400)]
    near[100] = "changed"
    kept = simhash.one_of_each_group(documents(spark, [" ".join(base), " ".join(near), " ".join(other)]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def planted_pairs(rng, indices, size=400):
    """Pairs of texts without a third between, whose five-word shingles have about the given indices."""
    texts = []
    for index in indices:
        base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(size)]
        other = list(base)
        for k in rng.sample(range(size // 5), round((1 - index) / (1 + index) * size / 5)):
            other[5 * k + 2] = "changed"
        texts += [" ".join(base), " ".join(other)]
    return texts


def test_near_copies_at_the_limit_are_exact(spark):
    """Isolated pairs around 0.8: linked if and only if the counted index says so."""
    rng = random.Random(11)
    texts = planted_pairs(rng, [0.70, 0.75, 0.78, 0.79, 0.80, 0.805, 0.81, 0.82, 0.85, 0.9, 0.95] * 12)

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    want = set(range(0, len(texts), 2))
    near = 0
    for i in range(0, len(texts), 2):
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        if len(a & b) / len(a | b) < 0.8:
            want.add(i + 1)
        near += 0.8 <= len(a & b) / len(a | b) < 0.85
    kept = {r.doc_id for r in simhash.one_of_each_group(documents(spark, texts)).collect()}
    assert near >= 24 and kept == want
    assert simhash.candidate_recall(0.8, 8) > 0.9999


@pytest.mark.parametrize("block", [1024, 4])
def test_near_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    texts = [None, "", "  ", "one two", "one two", "one two three"]
    for _ in range(30):
        other = list(base)
        for k in rng.sample(range(200), rng.randint(0, 9)):
            other[k] = f"x{rng.randint(0, 3)}"
        texts.append(" ".join(other))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or len(a & b) / len(a | b) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    kept = {r.doc_id for r in simhash.one_of_each_group(documents(spark, texts)).collect()}
    assert kept == set(root)


def test_bpe_equals_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["<|endoftext|>x", "ΟΔΥΣΣΕΥΣ İ a\x85b \x1c", "aaaaaaa 'll don't 1234 é́ 👍", "你好"]
    docs = documents(spark, [*texts, *odd])
    for r in pair_bpe.round_trip_digests(docs).collect():
        ids = library.encode(([*texts, *odd][r.doc_id]) or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = pair_bpe.decoded(pair_bpe.encoded(docs)).collect()
    assert len(both) == docs.count()


def test_counts_follow_the_tie_rule():
    from tokenizers import Tokenizer, models
    rng = random.Random(2)
    for _ in range(200):
        pieces = {p: float(-rng.randint(1, 3)) for p in ("a", "b", "ab", "ba", "aa", "aba", "▁", "▁a", "aab")}
        library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False))
        text = "".join(rng.choice("ab") for _ in range(12))
        assert token_counts.UnigramCounter(pieces).count(text)[1] == len(library.encode("▁" + text).ids)


def test_token_counts_rows(spark, texts):
    rows = {r.doc_id: r for r in token_counts.token_counts(documents(spark, texts)).collect()}
    assert len(rows) == len(texts) and rows[0].n_tokens == rows[1].n_tokens == 0 and rows[len(texts) - 1].n_tokens >= 30000


@pytest.mark.parametrize("batch, ranges, entries, base", [(1 << 15, 1024, 10 ** 6, 9), (1, 3, 5, 0), (4, 2, 10, 0)])
def test_induced_order(monkeypatch, batch, ranges, entries, base):
    for name, value in (("BATCH", batch), ("RANGES", ranges), ("QUEUE_ENTRIES", entries), ("BASE", base)):
        monkeypatch.setattr(induced, name, value)
    rng = random.Random(batch)
    for _ in range(80):
        symbols, cap = rng.choice([2, 3, 8]), rng.choice([3, 400])
        s = [rng.randint(1, symbols - 1) for _ in range(rng.randint(0, 50))]
        s = (s[:9] * 3 if rng.random() < 0.3 else s) + [0]
        pos, lcp = [], []
        induced.falling_suffixes(np.array(s), symbols, cap, lambda p, c: (pos.extend(p.tolist()), lcp.extend(c.tolist())))
        want = sorted(range(len(s)), key=lambda i: s[i:], reverse=True)
        assert pos == want
        for k in range(1, len(want)):
            a, b = s[want[k - 1]:], s[want[k]:]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(same, cap)


@pytest.mark.parametrize("length, gram", [(12, 6), (8, 3)])
def test_repeats_are_removed(spark, length, gram):
    rng = random.Random(length)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(3, 60))) for _ in range(8)]
    texts = [None, "", "a" * 50, "ab" * 40] + ["".join(rng.choice(pool) + rng.choice("xyz") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    for r in suffix_dedup.without_repeats(documents(spark, texts), length=length, gram=gram).collect():
        b, gone = raw[r.doc_id], bytearray(len(raw[r.doc_id]))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, kept)



def test_edges_of_a_shared_passage_are_split(spark, monkeypatch, tmp_path):
    """A passage that all texts share, each with other text around it: no mark brings more than a shard."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20000)
    folder, shard = str(tmp_path), suffix_dedup._shard

    def spy(length):
        inner = shard(length)

        def run(batches):
            import collections
            import uuid
            sizes = collections.Counter()

            def seen():
                for batch in batches:
                    for mark, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                        sizes[mark] += len(body)
                    yield batch
            yield from inner(seen())
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(max(sizes.values(), default=0)))
        return run
    monkeypatch.setattr(suffix_dedup, "_shard", spy)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, length = noise(900), 400
    texts = [noise(500 + i) + passage + noise(500) for i in range(120)] + [noise(200) + passage[100:700] + noise(200), passage[:450]] + [noise(600)] * 2
    raw = [t.encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    for r in suffix_dedup.without_repeats(documents(spark, texts)).collect():
        b, gone = raw[r.doc_id], bytearray(len(raw[r.doc_id]))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
        assert (r.n_removed, r.kept_sha256) == (sum(gone), kept)
    largest = max(int(p.read_text()) for p in tmp_path.iterdir())
    assert largest <= 20000, largest

def test_base_spans_and_discovery(spark):
    known = [f"member id 4111 1111 1111 1111 ok{i}" if i == 0 else f"member id user{i}@mail.org now" for i in range(12)]
    rows = {r.doc_id: r for r in pii.personal_data(documents(spark, [None, "", "1" * 20000, "+1 (555) 555-0199 at 1.2.3.256 or 8.8.8.8",
                                                                    *known, "member id ZX8812Q now"])).collect()}
    assert (rows[3].n_phone, rows[3].n_ip, rows[2].n_card) == (1, 1, 0)
    assert rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[16].n_id == 1 and rows[16].spans == "id:10:17"


def test_keys_give_their_contexts_away(spark):
    rng = random.Random(2)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    texts = [f'some words api_token = "{k}" end' for k in keys] + ['more words api_token = "zx8812qq" end', f"a lone hash {keys[0][::-1]} elsewhere"]
    rows = {r.doc_id: r for r in pii.personal_data(documents(spark, texts)).collect()}
    assert all(rows[i].spans == "id:24:64" for i in range(30)) and rows[30].spans == "id:24:32" and rows[31].spans == ""
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows.values())


def test_contexts_are_whole_words_however_long(spark):
    cases = [("w" * 9000 + " = ", " v" + "x" * 9000 + "."), ("a " + " " * 9000 + "b ", " " * 9000 + "End."), ("one two three ", ""), ("", " -- !"),
             ("x" * 70 + " y ", " " * 70 + "z"), ("ab " + "-" * 61, "." * 58 + "qq rr")]
    df = spark.createDataFrame([(i, b + "K1K2K3" + a, len(b), len(b) + 6) for i, (b, a) in enumerate(cases)], "i int, text string, s int, e int")
    got = {r.i: r.p for r in df.select("i", pii._contexts(F.col("text"), F.col("s"), F.col("e")).alias("p")).collect()}
    for i, (b, a) in enumerate(cases):
        words = [""] * 2 + [w for w in re.split(r"[^\w=:@]+", b.lower()) if w]
        after = re.search(r"\w+", a.lower())
        assert got[i] == [f"2 {words[-2]} {words[-1]} _", f"1 {words[-1]} _ {after.group() if after else ''}"]


def test_base_spans_equal_the_patterns_on_random_texts(spark):
    rng = random.Random(12)
    pieces = ["a@b.co", "x.y+z@mail.example.org", "@", ".", "-", " ", "+", "1.2.3.4", "256", "255", "0007", "4111 1111 1111 1111", "4111-1111", "5500005555555559",
              "+1 (555) 010-9999", "(", ")", "12", "é", "\n", "  ", "1" * 13, "0" * 16, "..", "_%", "+49.30.123456", "word"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(1500)]

    def luhn(digits):
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(x - 9 * (x > 9) for x in twice) % 10 == 0

    def spans(text):
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        tests = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
                 ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
                 ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
                 ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
        return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, pattern, test in tests for m in re.finditer(pattern, text) if test(m))

    rows = pii.personal_data(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(spans(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id]


def test_toxic_words_are_learned_and_restored(spark):
    rng = random.Random(5)
    words = ["anen", "thore", "erst", "tionan", "hand", "stion"]
    texts = [" ".join(rng.choice(words) for _ in range(20)) + (" moron" if i % 4 == 0 else "") for i in range(200)]
    tricks = ["anen m0r0n hand", "erst m o r o n hand", "hand moooron erst", "anen erst hand", None]
    docs = documents(spark, texts + tricks)
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert [rows[200 + i].predicted for i in range(5)] == [1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == {i for i, r in rows.items() if not r.predicted}
    none = labels.where("toxic = 2")
    assert len({r.score for r in toxicity.scored(docs, none).collect()}) == 1



def test_spaced_long_and_doubled_spellings_are_restored(spark):
    rng = random.Random(7)
    words = ["anen", "thore", "erst", "tionan", "hand", "stion"]
    texts = [" ".join(rng.choice(words) for _ in range(20)) + (" moron" if i % 4 == 0 else "") for i in range(400)]
    tricks = ["anen hand m o r o n", "h a n d m o r o n", "anen morron hand", "anen m" + "o" * 90 + "ron hand",
              " ".join("handerstanenhanderst") + " " + " ".join("moron"), "a n e n h a n d"]
    docs = documents(spark, texts + tricks)
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert [rows[400 + i].predicted for i in range(6)] == [1, 1, 1, 1, 1, 0]


def test_long_stretches_cost_their_length():
    restorer = toxicity.Restorer(toxicity.character_model(np.zeros(toxicity.SYMBOLS ** 4)))
    assert restorer.restore("a" + "1" * 5000 + "= x") and len(toxicity.features("m" * 70)) == 4

def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    x[100:300] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16)]
    found = curves.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = (unit @ unit[q]).round(12)
        s[q] = -9
        want = set(np.lexsort((np.arange(600), -s))[:5].tolist())
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        hits += len(want & {r.vec_id for r in mine})
    assert hits >= 0.9 * 60


def test_page_text():
    page = ("<html><head><title>T</title><script>x='</p>'</script></head><body><nav><a href=/>Home</a></nav><div class=cookie-notice>Cookies</div>"
            "<article><h1>Head &amp; line</h1><p><b>One two.<br><p>Three\n  four &lt;b&gt;</p><form>Mail</form></article>"
            "<section id='comments'><p>First comment that is rather long and chatty indeed.</p></section><footer>&copy; x</footer>")
    assert html_density.main_text(page) == "Head & line\nOne two.\nThree four <b>"
    assert html_density.main_text("") == "" and html_density.main_text("<p>" * 3000) == ""



@pytest.mark.parametrize("wrapper", ["class='content has-sidebar'", "class='page no-sidebar'", "id='search-results'", "class='post tags'",
                                     "aria-label='Comments on the new law'", "class='share'"])
def test_wrapped_articles_stay(wrapper):
    article = "".join(f"<p>Paragraph {i} of an article that goes on for a good while and says a lot.</p>" for i in range(9))
    page = f"<html><body><div class='site-header'>Our site</div><div {wrapper}>{article}</div><div class='comments'><p>Me too</p></div><div class=ad>Buy</div></body></html>"
    text = html_density.main_text(page)
    assert text.count("Paragraph") == 9 and "Our site" not in text and "Me too" not in text and "Buy" not in text


def test_long_comments_beside_an_article_go():
    chat = "<article class='c'><p>A rather long comment that says what all the others say as well.</p></article>" * 9
    page = f"<body><div class='wrap'><article><p>The piece itself, short as it is.</p></article></div><div id='comments'>{chat}</div></body>"
    assert html_density.main_text(page) == "The piece itself, short as it is."


def test_articles_stay_beside_named_parts_of_any_size():
    lines = [f"<p>Paragraph {i} of an article that goes on for a good while and says a lot.</p>" for i in range(4)]
    beside = "".join(f"<p>Side {i} of a column that goes on for a good while and says a lot too.</p>" for i in range(600))
    for n in (1, 6, 600):
        part = "".join(beside.split("</p>")[:n])
        text = html_density.main_text(f"<body><div class=content>{''.join(lines)}</div><div class='sidebar'>{part}</div></body>")
        assert text.count("Paragraph") == 4 and "Side" not in text
    text = html_density.main_text(f"<body><main>Teaser</main><div id='search'>{''.join(lines)}<div class=ad>Buy</div></div></body>")
    assert text.count("Paragraph") == 4 and "Buy" not in text


@pytest.mark.parametrize("piece", ["<a>", "<a><h1>x", "<div>x", "<i></b>", "<a ", "<div class=ad>x", "<script></script><a>x "])
def test_odd_markup_takes_time_in_proportion(piece):
    def seconds(n):
        start = time.process_time()
        html_density.main_text(piece * n)
        return time.process_time() - start
    assert seconds(40_000) < 20 * seconds(4_000) + 0.5


def test_pages_with_nulls_and_clashing_columns(spark):
    rows = [(1, None, None, "a", 1), (1, "u", "", "b", 2), (None, "u", "<p>One</p>", "c", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {tuple(r) for r in html_density.extracted(pages).collect()}
    assert got == {(1, None, "", 0), (1, "u", "", 0), (None, "u", "One", 3)}


def test_best_path_of_a_lattice_by_trying_all():
    rng = np.random.default_rng(3)
    restorer = toxicity.Restorer(np.log(rng.dirichlet(np.full(toxicity.SYMBOLS, 0.3), toxicity.SYMBOLS ** 3) + 1e-6))
    draw = random.Random(8)
    for _ in range(60):
        gap = draw.choice(" .-")
        stretch = "".join(draw.choice(["a", "bb", "c", "1", "4", "$$", "ooo", gap]) for _ in range(draw.randint(1, 6)))
        best = None
        for path in itertools.product(*restorer._columns(stretch, gap)):
            state, score = 0, 0.0
            for letters, cost in path:
                score += cost
                for x in letters:
                    code = 0 if x == " " else ord(x) - 96
                    score += restorer.logs[state][code]
                    state = state * toxicity.SYMBOLS % toxicity.SYMBOLS ** 3 + code
            score += restorer.logs[state][0]
            best = max(best, (score, "".join(x for x, _ in path))) if best else (score, "".join(x for x, _ in path))
        assert restorer.decode(stretch, gap) == best[1]


def test_long_unbroken_stretches_follow_the_rules_of_short_ones(monkeypatch):
    restorer = toxicity.Restorer(np.zeros((toxicity.SYMBOLS ** 3, toxicity.SYMBOLS)))
    monkeypatch.setattr(toxicity.Restorer, "decode", lambda self, stretch, gap=None: f"<{stretch}>")
    draw = random.Random(9)
    texts = [draw.choice(["", ".", "x ", "2", ","]) + "".join(draw.choice("aab$!05@") for _ in range(draw.randint(1, 14)))
             + draw.choice(["", " y", ".", "=", "2"]) for _ in range(5000)]
    short = [restorer.restore(t) for t in texts]
    monkeypatch.setattr(toxicity, "LONG", re.compile(toxicity.LONG.pattern.replace("{1000,}", "{5,}")))
    assert [restorer.restore(t) for t in texts] == short


@pytest.mark.parametrize("piece", [",@", "!", "ab$", "!5", "a", "aab$", "("])
def test_odd_spelling_takes_time_in_proportion(piece):
    restorer = toxicity.Restorer(np.zeros((toxicity.SYMBOLS ** 3, toxicity.SYMBOLS)))

    def seconds(n):
        start = time.process_time()
        restorer.restore(piece * n + "=2")
        return time.process_time() - start
    assert seconds(400_000) < 20 * seconds(40_000) + 0.5


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), "big" if i % 3 else ("null" if i % 2 else None)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs, passes=2.0, entropy=None).collect()
    total = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("big", "null", None)}
    taken = {s: sum(r.n_tokens * r.copies for r in got if r.source == s) for s in total}
    assert all(r.copies >= 1 for r in got) and len(got) == 900
    assert math.isclose(max(taken[s] / total[s] for s in total), 2.0, rel_tol=0.02)
    for r in got:
        assert abs(r.weight - taken[r.source] / sum(taken.values())) < 0.02
    assert mixing.mixed(docs, passes=2.0, entropy=None).count() == sum(r.copies for r in got)


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (exact_dedup.exact_duplicates(docs), simhash.simhash_groups(docs), pair_bpe.round_trip_digests(docs), token_counts.token_counts(docs),
               suffix_dedup.without_repeats(docs), pii.personal_data(docs), toxicity.scored(docs, labels), mixing.copies(docs),
               html_density.extracted(pages), curves.nearest_neighbours(vectors, F.col("id") % 50 == 0)):
        assert df.collect() == []


def test_texts_read_piece_by_piece_as_a_whole():
    """Counts as of the whole restored text, and a piece that comes again is decoded once."""
    model = toxicity.character_model(np.arange(toxicity.SYMBOLS ** 4) % 7)
    reader, plain, calls = toxicity.Reader(model), toxicity.Restorer(model), []
    decode = reader.restorer.decode
    reader.restorer.decode = lambda stretch, gap=None: (calls.append(stretch), decode(stretch, gap))[1]
    rng, parts = random.Random(8), ["a", "I", "b4d", "f00l", "(", "$", "2", "_", " ", " ", " ", "\n", "\xa0", ".", "-", "ss", "x.y", "Σ", "İ", "a" * 1001, "(" * 1001]
    for _ in range(300):
        some = rng.sample(parts, 8)
        text = "".join(rng.choice(some) for _ in range(rng.randrange(30)))
        want = toxicity.features(plain.restore(text))
        assert reader.read(text) == (sum(1 for _ in toxicity.SUSPECT.finditer(text.lower())), sum(n for f, n in want.items() if f[0] == "="), dict(want))
    calls.clear()
    reader.known, reader.restorer.known = {}, {}
    reader.read("b4d " * 500 + "so b a d and b4d")
    reader.read("so b a d")
    assert sorted(calls) == ["b a d", "b4d"]
    few = toxicity.Reader(model, {"=so"})
    assert few.read("so so what")[1:] == (3, {"=so": 2})
