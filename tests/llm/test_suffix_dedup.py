import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import suffix_dedup as sd

KIND = "doc_id long, text string, kept string, _d long, n_bytes int"


def brute(rows, window=sd.WINDOW):
    """By (id, text): bytes, removed bytes, runs and digest; every window is looked up among all before it."""
    import xxhash

    places = sorted({(d if d is not None else -(1 << 63), t or "") for d, t in rows}, key=lambda x: (x[0], np.int64(np.uint64(xxhash.xxh64_intdigest(x[1].encode(), 42)))))
    seen, out = set(), {}
    for d, t in places:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - window + 1):
            w = data[s : s + window]
            if w in seen:
                gone[s : s + window] = True
            seen.add(w)
        kept = data if not gone.any() else bytes(np.frombuffer(data, np.uint8)[~gone])
        out[d, t] = (len(data), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=13):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))
    common, licence = [prose(rng.randint(15, 60)) for _ in range(6)], prose(30)
    rows = []
    for i in range(90):
        text = prose(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(common)[rng.randint(0, 9) :] + prose(rng.randint(0, 12))
        rows.append((i, text))
    rows += [(100 + i, licence + prose(rng.randint(0, 3)) + licence[50:]) for i in range(40)]  # a hot passage, twice in each
    rows += [(200 + i, prose(2) + rows[3][1]) for i in range(5)] + [(300 + i, rows[4][1]) for i in range(30)]
    rows += [(400, "ab" * 300), (401, "x" * 500), (402, "x" * 99 + "y" + "x" * 120), (403, "aab" * 200), (404, "e" * 99), (405, "x" * 100)]
    rows += [(500, None), (501, ""), (None, common[0] + prose(5)), (None, common[0] + "z"), (None, None), (5, rows[5][1]), (6, "other text " + common[1]), (-(1 << 62), common[2])]
    rng.shuffle(rows)
    return rows


def ran(spark, rows, window=sd.WINDOW, **how):
    frame = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], KIND).repartition(5)
    out = sd.dedup_suffixes(frame, window=window, **how)
    assert out.columns == ["doc_id", "text", "_d", "n_bytes", "n_removed", "n_spans", "kept"]
    got = [(r.doc_id if r.doc_id is not None else -(1 << 63), r.text, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept or b"").hexdigest()) for r in out.collect()]
    assert len(got) == len(rows)
    return {(g[0], g[1] or "", *g[2:]) for g in got}


@pytest.mark.parametrize("how", [{}, {"parts": 1}, {"parts": 40, "chunk": 8, "known": 0}, {"parts": 3, "chunk": 1, "known": 5, "few": 0}])
def test_against_brute_force(spark, monkeypatch, how):
    """Also with parts and chunks so small that common anchors are cut by both, and without what a task remembers."""
    monkeypatch.setattr(sd, "CHUNK", how.pop("chunk", sd.CHUNK))
    monkeypatch.setattr(sd, "KNOWN", how.pop("known", sd.KNOWN))
    monkeypatch.setattr(sd, "FEW", how.pop("few", sd.FEW))
    rows = corpus()
    want = {(*k, *v) for k, v in brute(rows).items()}
    got = ran(spark, rows, **how)
    assert got == want


def test_small_windows_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PACK", 150)
    monkeypatch.setattr(sd.packs, "__defaults__", (sd.WINDOW, 150))
    rows = corpus(14)
    assert ran(spark, rows, 64, parts=2) == {(*k, *v) for k, v in brute(rows, 64).items()}


def test_empty(spark):
    assert sd.dedup_suffixes(spark.createDataFrame([], KIND)).collect() == []
    assert [tuple(r) for r in sd.dedup_suffixes(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, None, 0, 0, 0, None)]
    with pytest.raises(ValueError):
        sd.dedup_suffixes(spark.createDataFrame([], KIND), window=40)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400), st.integers(100, 130))
def test_anchors_are_the_windows_own(data, window):
    """A window's anchor rests on its bytes alone."""
    b = np.frombuffer(data, np.uint8)
    at = sd.anchors(b, window)
    assert len(at) == max(0, len(b) - window + 1)
    for s in range(0, len(at), 7):
        assert sd.anchors(b[s : s + window], window)[0] + s == at[s]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=24, max_size=24)), max_size=40))
def test_multikey(rows):
    """What multikey quicksort puts together is what is equal; in a class rows keep their order."""
    b = np.frombuffer("".join(t for _, t in rows).encode() + b" " * 8, np.uint8)
    word = lambda live, depth: np.array([int.from_bytes(b[24 * i + depth : 24 * i + depth + 8].tobytes(), "big") for i in live.tolist()], np.uint64)
    live, label = sd.multikey(np.array([g for g, _ in rows], np.int64), word, [0, 8, 16])
    got = {}
    for i, c in zip(live.tolist(), label.tolist()):
        got.setdefault(c, []).append(i)
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(r, []).append(i)
    assert sorted(got.values()) == sorted(v for v in want.values() if len(v) > 1)
