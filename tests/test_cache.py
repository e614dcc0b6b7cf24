import pytest
from pyspark.sql import functions as F

from chartloom.lineage import scratch
from chartloom.sources import cache


def recogniser(rows):
    text = F.decode("content", "utf-8")
    return rows.select("sha", F.upper(text).alias("text"), F.lit(0.8).alias("mean_confidence"), text.startswith("bad").alias("failed"))


def test_recognise(spark):
    """Each content is read once; what fails is told, not entered, and read again; nothing new writes no manifest."""
    at = scratch(spark, "test-cache")
    docs = spark.createDataFrame([(1, b"a"), (2, b"bad b"), (3, b"a"), (4, None), (5, b"")], "id int, content binary")
    out, read = cache.recognise(docs, at, recogniser)
    assert {r.id: r.text for r in out.collect()} == {1: "A", 2: "BAD B", 3: "A", 4: None, 5: ""} and read.count() == 3
    out, read = cache.recognise(docs.unionByName(spark.createDataFrame([(6, b"c")], "id int, content binary")), at, recogniser)
    assert {r.id: r.text for r in out.collect()} == {1: "A", 2: "BAD B", 3: "A", 4: None, 5: "", 6: "C"} and read.count() == 2
    assert sorted(r.text for r in cache.read(spark, at).collect()) == ["", "A", "C"]
    number, _ = cache.manifest(spark, at)
    out, read = cache.recognise(docs.where("id in (1, 3, 4)"), at, recogniser)
    assert out.count() == 3 and read.count() == 0 and cache.manifest(spark, at)[0] == number == 2
    assert cache.recognise(docs.limit(0), at, recogniser)[0].count() == 0


def test_upsert(spark, monkeypatch):
    """The surest row of a content stays; one that is there isn't changed; of two upserts at once neither is lost."""
    at = scratch(spark, "test-cache")
    rows = lambda *r: spark.createDataFrame(list(r), cache.CACHED)
    assert cache.upsert(rows(("aa1", "x", 0.5), ("aa1", "y", 0.9), ("aa2", "z", 0.1)), at) == 2
    assert cache.upsert(rows(("aa1", "other", 1.0), ("aa3", "w", 0.2), ("bb1", "v", 0.3)), at) == 2
    want = {("aa1", "y", 0.9), ("aa2", "z", 0.1), ("aa3", "w", 0.2), ("bb1", "v", 0.3)}
    assert {tuple(r) for r in cache.read(spark, at).collect()} == want
    assert {tuple(r) for r in cache.read(spark, at, ["bb"]).collect()} == {("bb1", "v", 0.3)}
    real, calls = cache._commit, []

    def beaten(*args):
        calls.append(args)
        if len(calls) == 1:  # another gets in just before
            assert cache.upsert(rows(("aa4", "first", 0.4)), at) == 1
        return real(*args)

    monkeypatch.setattr(cache, "_commit", beaten)
    assert cache.upsert(rows(("aa5", "second", 0.5)), at) == 1 and len(calls) == 3
    assert {tuple(r) for r in cache.read(spark, at).collect()} == want | {("aa4", "first", 0.4), ("aa5", "second", 0.5)}
    monkeypatch.setattr(cache, "_commit", lambda *a: False)
    with pytest.raises(RuntimeError):
        cache.upsert(rows(("cc", "x", 0.5)), at)
