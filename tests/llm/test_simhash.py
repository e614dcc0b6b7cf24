import numpy as np
import xxhash
from pyspark.sql import functions as F

from chartloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string, least long"


def brute_components(values, linked):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(values):
        for y in values[:i]:
            if linked(x, y):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {v: find(v) for v in values}


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_pair_within_three_bits_meets():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for _ in range(40):
        y = x.copy()
        for i in range(len(x)):
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                y[i] ^= np.uint64(1) << np.uint64(bit)
        (kx, ox), (ky, oy) = simhash.anchors(x), simhash.anchors(y)
        other = set(zip(ky.tolist(), oy.tolist()))
        assert {i for k, i in zip(kx.tolist(), ox.tolist()) if (k, i) in other} == set(range(len(x)))


def test_links_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 60, dtype=np.int64)
    values = set(base.tolist())
    for b in base[:30].tolist():
        for _ in range(12):
            x = b
            for bit in rng.choice(62, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    values |= {base[0].item() ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}  # a dense ball
    values = sorted(values)
    want = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    for hot in (simhash.HOT_ANCHOR, simhash.HOT_SAMPLE * 2):
        monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
        got = {r.node: r.root for r in simhash.components(simhash.links(prints)).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_documents(spark):
    long = "alpha beta gamma " * 30_000
    rows = [(0, "A b  c\td E", "x", 1), (1, "a B c d e", "y", 2), (2, None, None, None), (3, "", "z", 3), (4, " \n\t", "z", 3), (None, "a b c d e", "x", 1), (5, "one", "x", 1), (6, "one two", "x", 1), (7, long, "x", 1), (7, long, "x", 1), (8, "È é ñ x y", "x", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    prints = {r[0]: f"{brute_print(r[1]):016x}" for r in rows}
    assert all(r.fingerprint == prints[r.doc_id] for r in out)
    roots = {r.doc_id: r.component_id for r in out}
    assert roots == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, None: 0, 5: 5, 6: 6, 7: 7, 8: 8}
    assert simhash.near_duplicates(docs.where("doc_id = -1")).count() == 0
    assert simhash.near_duplicates(docs.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(2)).where("kept").count() == 2


def brute_set(text, size=5):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)] if words else [])


def brute_similar(texts, least=0.8):
    """The smallest place that each text reaches by links of the Jaccard similarity, by all pairs."""
    sets = [brute_set(t) for t in texts]
    alike = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])
    return brute_components(range(len(texts)), alike)


def test_wide_fingerprint_is_a_majority():
    rng = np.random.default_rng(3)
    for n in (1, 2, 255, 256, 700):
        own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        made = simhash.wide_fingerprint(own, 4)
        assert int(made[0]) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own.tolist()) > n)
        mixed = [(int(h) ^ int(h) >> 32) * int(simhash._MIXERS[1]) % (1 << 64) for h in own.tolist()]
        mixed = [m ^ m >> 29 for m in mixed]
        assert int(made[2]) == sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > n)
    assert simhash.wide_fingerprint(np.zeros(0, np.uint64), 2).tolist() == [0, 0]


def test_leaders_reach_every_row():
    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 62, 30, dtype=np.uint64).repeat(40)
    f ^= np.array([sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False)) for _ in f], np.uint64)
    keys = np.sort(rng.integers(0, 9, len(f)))
    a, b, led = simhash._led(keys, f, 20)
    assert (keys[a] == keys[b]).all() and (np.bitwise_count(f[a] ^ f[b]) <= 20).all() and len(a) < 4 * len(f)
    heads = set(led.tolist())
    close = {i for i, j, d in zip(b.tolist(), a.tolist(), np.bitwise_count(f[a] ^ f[b]).tolist()) if d <= simhash.CLOSE_BITS and j in heads}
    assert close | heads == set(range(len(f)))


def near_copies(rng, count=40):
    """Texts with copies that share from 0.6 to all of their shingles."""
    word = lambda: "".join(rng.choice(list("abcdefghij")) for _ in range(6))
    texts = []
    for _ in range(count):
        words = [word() for _ in range(int(rng.integers(60, 300)))]
        texts.append(" ".join(words))
        for _ in range(int(rng.integers(0, 4))):
            other = list(words)
            for _ in range(int(rng.integers(0, 1 + len(words) // 30))):
                other[int(rng.integers(0, len(other)))] = word()
            cut = int(rng.integers(0, len(words) // 10))
            texts.append(" ".join(other[cut:]))
    return texts


def test_keep_similar_against_all_pairs(spark, monkeypatch):
    texts = near_copies(np.random.default_rng(11)) + ["", None, " ", "one two", "One  two", "one two three"]
    roots = brute_similar(texts)
    docs = spark.createDataFrame([(i, t, f"x{i}", 7) for i, t in enumerate(texts)], "doc_id long, text string, _own_id string, c int").repartition(5)
    want = {i for i, r in roots.items() if i == r}
    got = {}
    for hot, few in ((simhash.HOT_ANCHOR, simhash.FEW), (2, 0)):  # also with all anchors of two rows dealt out, and without broadcasts
        monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
        monkeypatch.setattr(simhash, "HOT_SAMPLE", 64 if hot > 64 else 1)
        monkeypatch.setattr(simhash, "FEW", few)
        out = simhash.keep_similar(docs).collect()
        got[few] = {r.doc_id for r in out}
        assert len(out) == len(got[few]) and all(r.text == texts[r.doc_id] and r._own_id == f"x{r.doc_id}" for r in out)
        # no link is wrong, and few are missed
        assert want <= got[few] and len(got[few] - want) <= 0.03 * (len(texts) - len(want))
    assert len(got) == 2 and got[0] == got[500_000]


def replaced(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[int(rng.integers(0, len(out)))] = f"x{rng.integers(0, 5000)}"
    return out


def families(rng):
    """Near copies of one text, chains in which each text is a copy of the last, and pairs of texts of 8 to 300 shingles just over the least similarity."""
    word = lambda: f"x{rng.integers(0, 5000)}"
    texts = []
    for length, copies, most in ((100, 200, 7), (200, 150, 5), (60, 100, 4)):
        base = [word() for _ in range(length)]
        texts += [replaced(rng, base, int(rng.integers(1, most))) for _ in range(copies)]
    for _ in range(8):
        at = [word() for _ in range(120)]
        for _ in range(15):
            at = replaced(rng, at, 2)
            texts.append(at)
    for n in (8, 12, 20, 50, 100, 300):
        for _ in range(25):
            base = [word() for _ in range(n + 4)]
            cut = max(1, n // 5 - 1)
            texts += [base, base[cut:]]  # n and n - cut shingles, all of these shared
    return [" ".join(t) for t in texts]


def test_merges_of_families_chains_and_pairs(spark, monkeypatch):
    """Of what all pairs would merge hardly anything is missed, and as much if every anchor counts as hot."""
    texts = families(np.random.default_rng(21))
    roots = brute_similar(texts)
    merges = sum(i != r for i, r in roots.items())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    for hot in (simhash.HOT_ANCHOR, 2, 40):
        monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
        monkeypatch.setattr(simhash, "HOT_SAMPLE", 64 if hot > 64 else 1)
        kept = {r.doc_id for r in simhash.keep_similar(docs).select("doc_id").collect()}
        assert {i for i, r in roots.items() if i == r} <= kept
        found = len(texts) - len(kept)
        assert found >= 0.95 * merges, (hot, found, merges)


def test_keep_similar_shapes(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a b c d e f g", 1), (3, "A b c d e f g", 1), (3, "A b c d e f g", 2), (4, None, 1), (4, "", 1), (5, long, 1), (6, long + " x", 1), (None, "only nameless one", 1), (None, "only nameless one", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own_th int")
    out = [(r.doc_id, r.text) for r in simhash.keep_similar(docs).collect()]
    texts = {t for _, t in out}
    assert sorted(d for d, _ in out if d is not None) == [3, 4, 5] and len(out) == 4 and (None, "only nameless one") in out and "A b c d e f g" in texts and long in texts
    assert simhash.keep_similar(docs.where("doc_id = 99")).count() == 0
    assert simhash.keep_similar(docs).columns == docs.columns
    assert [r.doc_id for r in simhash.keep_first(docs.where("doc_id = 3")).collect()] == [3]


def test_candidates_do_not_rest_on_dealing_out(spark, monkeypatch):
    """The same pairs, leader by leader, whether an anchor is one task's or dealt out, in one round or many."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(3):
        at = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        for _ in range(60):
            words = [int(w) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False)) for w in at]
            rows.append((int(rng.integers(-(1 << 62), 1 << 62)), *words))
    prints = spark.createDataFrame(rows, "c long, w0 long, w1 long")
    found = []
    for hot, few in ((simhash.HOT_ANCHOR, simhash.HEAD), (20, 2), (20, simhash.HEAD)):
        monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
        monkeypatch.setattr(simhash, "HOT_SAMPLE", 64 if hot > 64 else 1)
        monkeypatch.setattr(simhash, "HEAD", few)
        found.append({tuple(r) for r in simhash.candidates(prints, 2, 20, 5).collect()})
    assert found[0] and found[0] == found[1] == found[2]
