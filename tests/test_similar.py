import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.operators import coding, metrics, similar


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def words(rng, n, longest=9, alphabet="abcdeé "):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)})


@pytest.mark.parametrize("least", [0.86, 0.72, 0.5, 0.0])
def test_candidates_lose_no_pair(spark, least):
    """Every pair that reaches the ratio is a candidate, far fewer than all pairs are, and the plan has no cross join."""
    rng = random.Random(1)
    a, b = words(rng, 150), words(rng, 150)
    met = similar.candidates(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), least)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    got = {(r.a, r.b) for r in met.collect()}
    want = {(x, y) for x in a for y in b if ratio(x, y) >= max(least, 1e-9) and x and y}
    assert want <= got and len(got) == met.count()
    if least > 0.8:
        assert len(got) < len(a) * len(b) / 20


def test_shortlist_against_all_pairs(spark):
    rng = random.Random(2)
    terms, names = [*words(rng, 60, 12), "zzz", "ABC", None], [*words(rng, 80, 12, "abcdefgh "), "Abc", "abc", "ABC", None]
    for given_ in (names, names[:3] + [None], []):
        out = metrics.shortlist(spark.createDataFrame([(t,) for t in terms] * 2, "term string"), spark.createDataFrame([(n,) for n in given_] * 2, "name string"))
        got = sorted((r.term, r.rank_no, r.name, round(r.score, 9)) for r in out.collect())
        want = []
        for t in {t for t in terms if t is not None}:
            best = sorted((-ratio(t.lower(), n.lower()), n) for n in {n for n in given_ if n is not None})[:5]
            want += [(t, i + 1, n, round(-s, 9)) for i, (s, n) in enumerate(best)]
        assert got == sorted(want)


def windows(needle, hay):
    """The best ratio over all windows, and how many there are."""
    a, b = sorted((needle, hay), key=len)
    if not a or a in b:
        return (1.0 if a else 0.0), 0
    sizes = {s for s in range(len(a) - 2, len(a) + 3) if 3 <= s <= len(b)} or {len(b)}
    every = [b[k : k + s] for s in sizes for k in range(len(b) - s + 1)]
    return max(ratio(w, a) for w in every), len(every)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=9), st.text("abcdé", max_size=30), st.sampled_from([0.0, 0.5, 0.72, 0.9]))
def test_best_window_equals_all_windows(a, b, least):
    best, n = metrics.best_window(a, b, least)
    want, every = windows(a, b)
    assert best == (want if want >= least else 0.0) and n <= every


def test_best_window_aligns_few():
    rng = random.Random(4)
    aligned = every = 0
    for _ in range(200):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120))
        at = rng.randint(0, 100)
        name = text[at : at + 5] + rng.choice("xyz") + text[at + 5 : at + 10] if rng.random() < 0.5 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
        (best, n), (want, m) = metrics.best_window(name, text, metrics.MATCH), windows(name, text)
        assert best == (want if want >= metrics.MATCH else 0.0)
        aligned, every = aligned + n, every + m
    assert aligned * 10 < every


def test_fuzzy_lookup_against_all_pairs(spark):
    rng = random.Random(7)
    names = [w.strip() for w in words(rng, 120, 10, "abcde ") if w.strip()]
    alias = spark.createDataFrame([(i, 0, n, f"c{i}", n) for i, n in enumerate(names)], "row_no int, ord int, alias string, code string, display string")
    terms = [w for w in words(rng, 120, 10, "abcdE ")]
    out = coding.fuzzy_lookup(spark.createDataFrame([(t,) for t in terms], "t string"), "t", alias, 0.8)
    key = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    for r in out.collect():
        scored = [(ratio(key(r.t), key(n)) if key(r.t) != key(n) else 1.0, -i) for i, n in enumerate(names) if key(r.t)]
        best = max(scored, default=(0, 0))
        assert (r.row_no, r.score) == ((-best[1], best[0]) if best[0] >= 0.8 else (None, None)), r
