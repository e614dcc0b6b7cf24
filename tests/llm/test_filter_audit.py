import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import filter_audit

KIND = "doc_id long, text string, lang string, part string, mask int, good int"


def corpus():
    rng = random.Random(12)
    words = ["ab", "Cd", "é", "x#", "WWWW", "z"]
    out = [(i, " ".join(rng.choice(words + [f"w{j}" for j in range(rng.choice([1, 300]))]) for _ in range(rng.choice([3, 99, 100, 150]))), rng.choice(["en", "fr", "", None]), "p", 1, 7) for i in range(60)]
    out += [(100 + i, out[3][1], rng.choice(["en", "de"]), None, None, None) for i in range(20)]
    return out + [(200, None, "en", "p", 1, 1), (201, "", "en", "p", 1, 1), (None, out[3][1], "en", "p", 1, 1), (5, out[5][1], out[5][2], "p", 1, 1), (202, "q " * 200_000, "long", "p", 1, 1)]


def labelled():
    return [(i, i % 2, i % 3 % 2) for i in range(0, 210, 2)] + [(4, None, 1), (7, 1, None), (None, 1, 1), (4, 0, 0)]


def brute(rows, labels):
    docs = []
    for d, text, lang, *_ in rows:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        e = d is not None and any(o[0] is not None and o[0] < d and (o[1] or "") == text for o in rows)
        fails = (len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), e)
        mine = [x for x in labels if d is not None and x[0] == d]
        docs.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations(range(5)):
            left = [d for d in docs if d[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                fails = [d for d in every if d[1][f]]
                out[part, "".join("ABCDE"[i] for i in order), step] = (len(left), len(gone), len(fails) - len(gone), sum(sum(d[1]) == 1 for d in fails), sum(d[2] for d in gone), sum(d[3] for d in gone))
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {(*k, *v, total[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


def run(spark, docs, labels):
    flags = filter_audit.filter_flags(docs, labels)
    return filter_audit.audit(flags, list("ABCDE"), "part", "good", "toxic")


@pytest.mark.parametrize("few", [500_000, 0])
def test_against_plain_python(spark, monkeypatch, few):
    monkeypatch.setattr(filter_audit, "FEW", few)
    docs = spark.createDataFrame(corpus(), KIND).repartition(3)
    labels = spark.createDataFrame(labelled(), "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in run(spark, docs, labels).collect()]
    assert len(got) == 600 * 5 and set(got) == brute(corpus(), labelled())


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], KIND), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(spark, docs, labels).collect() == []
    some = spark.createDataFrame(corpus()[:3], KIND)
    assert all(r.good_lost == r.toxic_lost == 0 for r in run(spark, some, labels).collect())


def test_bitmaps_of_parts():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, 1000)
    fails = [rng.random(1000) < 0.3 for _ in range(3)]
    begin, sets, rows = filter_audit.bitmaps(codes, 4, fails)
    for mask, alive in filter_audit.passing(sets, rows):
        want = np.ones(1000, bool)
        for i in range(3):
            if mask >> i & 1:
                want &= ~fails[i]
        assert np.add.reduceat(np.bitwise_count(alive), begin).tolist() == [int((want & (codes == c)).sum()) for c in range(4)]


def test_any_filters(spark):
    rows = spark.range(1000).select(*((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3)) == 0).alias(n) for i, n in enumerate(["m", "n"])), F.when(F.col("id") % 5 > 0, F.lit("p")).alias("where"), F.lit(None).cast("boolean").alias("g"), (F.col("id") % 7 == 0).alias("t"))
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(rows, ["m", "n"], "where", "g", "t").collect()}
    assert len(got) == 8 and {k[0] for k in got} == {"", "p"}
    for part in ("", "p"):
        own = rows.where(F.coalesce("where", F.lit("")) == part)
        m, n, both = (own.where(c).count() for c in ("m", "n", "m and n"))
        assert got[part, "mn", 2].removed == n - both and got[part, "mn", 2].redundant == both and got[part, "nm", 1].shapley == 2 * n - both
    with pytest.raises(ValueError):
        filter_audit.audit(rows, list("abcdefg"), "where", "g", "t")
