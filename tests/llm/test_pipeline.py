import hashlib
import random
import sys

import pytest

import corpus_pipeline
from chartloom.llm import mixing, quality_rules
from tests.llm.test_bpe import library
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_similar


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    line = lambda: " ".join(word() for _ in range(rng.randint(6, 14))).capitalize() + "."
    stock = [line() for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [line() for _ in range(rng.randint(3, 6))]
        if i % 3 == 0:
            lines.insert(0, rng.choice(stock))
        if i % 10 == 4:
            lines = ["a | b | c | d"] * 10
        if i % 7 == 5:
            lines.append("All rights reserved.")
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
    rows += [(100 + i, rows[i][1] + " X", "en", "s1", 0) for i in range(0, 12, 3)] + [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, rows[1][1], "fr", "s2", 1)]
    single = [" ".join(word() for _ in range(60)).capitalize() for _ in range(6)]
    rows += [(300 + i, x + ".", "en", "s0", 0) for i, x in enumerate(single)] + [(310 + i, x + f" yy zz{i}.", "en", "s3", 0) for i, x in enumerate(single)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_stages_against_brute_force(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    verdict = {r.doc_id: r for r in quality_rules.rules(docs).collect()}
    docs = corpus_pipeline.quality_stage(spark, docs, at)
    one = {r.doc_id: r.text for r in docs.collect()}
    assert one == {d: r._clean for d, r in verdict.items() if r.kept} and docs.columns == columns
    assert 4 not in one and "All rights" not in one[5]
    docs = corpus_pipeline.line_stage(spark, docs, at)
    two = {r.doc_id: r.text for r in docs.collect()}
    gone = brute_lines(sorted(one.items()))
    assert two == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in one.items()}
    docs = corpus_pipeline.near_duplicate_stage(spark, docs, at)
    three = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(two)
    roots = brute_similar([two[d] for d in ids])
    assert set(three) == {d for i, d in enumerate(ids) if roots[i] == i} < set(ids) and all(two[d] == t for d, t in three.items())
    size = {r._id: (r.size, r.taken) for r in mixing.taken(*mixing.mix(docs)).collect()}
    docs = corpus_pipeline.mixing_stage(spark, docs, at)
    four = [(r.doc_id, r.text) for r in docs.collect()]
    assert docs.columns == columns
    assert sorted(d for d, _ in four) == sorted(d for d, (n, t) in size.items() if n for _ in range(int(t / n + 0.5)))
    lib = library()
    out = corpus_pipeline.encoding_stage(spark, docs, at).collect()
    want = sorted((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in four for ids in [lib.encode_ordinary(t)])
    assert sorted(map(tuple, out)) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == want


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert set(entry.oracle_sql()) <= set(names)
    assert "corpus_pipeline" in sys.modules and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_with_clashing_columns(spark, folder):
    """Nulls everywhere, repeated rows and columns named like internal ones, in every stage but the last."""
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id in (1, 2)")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", docs.doc_id * None))
    extra = ["_id", "_th", "_d", "_kept", "_said", "_both", "_source", "_copies", "_copy", "_keep", "kept", "size", "fp", "c", "d", "h", "_text", "_place", "rank", "slot", "_o0", "_lines", "_words", "n", "keep"]
    for name in extra:
        docs = docs.withColumn(name, docs.lang)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[x] == r.lang for r in got for x in extra), name
        assert stage(spark, docs.limit(0), at).count() == 0, name
