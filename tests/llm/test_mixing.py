import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chartloom.llm import mixing


def water(sizes, weights=(1, 2, 3), repeats=3):
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    cap, left, free, out = [repeats * s for s in sizes], float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total >= cap[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(cap[i])
            left -= cap[i]
            free.remove(i)
    return out


def test_targets(spark):
    rng = random.Random(9)
    for n in (1, 2, 3, 7, 30):
        sizes = [rng.choice([0, 1, 5, 50, 1000, 20_000]) for _ in range(n)]
        names = [f"s{i:02}" for i in range(n - 1)] + [None]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        for name, want in zip(names, water(sizes)):
            assert abs(got[name] - want) < 1e-6 * max(1, want)


def rows():
    rng = random.Random(10)
    out = [(i, "w " * rng.randint(0, 300), rng.choice(["a", "b", "c", None]), i % 3) for i in range(300)]
    out += [(300 + i, "x y " * 200, "hot", 0) for i in range(100)] + [(None, "n n n", "a", 1), (7, None, "b", 2), (7, "", "b", 2), (8, out[8][1], out[8][2], 0), (8, out[8][1], out[8][2], 0)]
    return out


def test_mix(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")
    placed, pieces = mixing.mix(docs)
    out = mixing.taken(placed, pieces).select("_id", "_source", "size", "source_size", "target", "taken").collect()
    assert len(out) == len(rows())
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by[r._source][0] += r.taken
        by[r._source][1] += r.size
        by[r._source][2] = r.target
    for got, size, target in by.values():
        assert abs(got - target) <= max(2, 0.005 * target)
    again = mixing.taken(*mixing.mix(docs.repartition(7))).select("_id", "_source", "size", "source_size", "target", "taken").collect()
    assert Counter(out) == Counter(again)
    slots = [r.slot for r in pieces.groupBy("slot").agg(F.count_distinct("rank").alias("n")).where("n > 1").collect()]
    assert not slots


def test_schedule_is_even(spark):
    wanted = spark.createDataFrame([(1, 10.0), (2, 30.0), (3, 60.0)], "rank long, target double")
    n = 40_000
    got = mixing.schedule(wanted, 1, n).collect()
    assert len(got) == n and len({r.slot for r in got}) == n
    for rank, share in ((1, 0.1), (2, 0.3), (3, 0.6)):
        own = sorted(((r.slot, r.r) for r in got if r["rank"] == rank))
        assert [r for _, r in own] == list(range(len(own)))
        for end in (100, 1000, n):
            assert abs(sum(s < end for s, _ in own) - share * end) < 8


def test_documents_and_empty(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    target = {r.source: r.target for r in mixing.mix(docs)[0].select(F.col("_source").alias("source"), "target").distinct().collect()}
    assert all(abs(words.get(s, 0) - t) <= 450 for s, t in target.items())
    none = docs.where("doc_id = -1")
    assert mixing.taken(*mixing.mix(none)).count() == 0 and mixing.mix_documents(none).count() == 0


def test_what_is_taken_comes_from_the_schedule(spark, monkeypatch, tmp_path):
    """Slots are those of the schedule, documents come in their order, and without a schedule, or with a gap in it, there is no mix."""
    docs = spark.createDataFrame([(i, "w " * (1 + i * 37 % 900), f"s{i % 3}", 0) for i in range(400)], "doc_id long, text string, source string, size int")
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    block = 256
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing.mix, "__defaults__", (*mixing.mix.__defaults__[:-1], block))
    out = mixing.op2_mix_sources(spark, str(tmp_path)).collect()
    placed, pieces = mixing.mix(docs)
    of = defaultdict(set)
    for r in pieces.join(placed, ["rank", "start"]).select("_id", "slot").collect():
        of[r._id].add(r.slot)
    assert {r.doc_id: r.n_slots for r in out} == {i: len(of[i]) for i in range(400)} and all(r.first_slot in of[r.doc_id] for r in out if r.taken)
    got = mixing.mix_documents(docs, slot_col="at").collect()
    assert [r.at for r in got] == sorted(r.at for r in got) and all(r.at in of[r.doc_id] for r in got)
    assert [r.doc_id for r in mixing.mix_documents(docs).collect()] == [r.doc_id for r in got]
    words = Counter()
    for r in got[: len(got) // 2]:  # any stretch of the mix has the sources in proportion
        words[r.source] += len(r.text.split())
    whole = Counter()
    for r in got:
        whole[r.source] += len(r.text.split())
    assert all(abs(words[s] / sum(words.values()) - whole[s] / sum(whole.values())) < 0.03 for s in whole)
    real = mixing.schedule
    for broken in (lambda w, b, n: real(w, b, n).where("false"), lambda w, b, n: real(w, b, n).where("not (rank = 2 and r < 40)")):
        monkeypatch.setattr(mixing, "schedule", broken)
        for use in (lambda: mixing.op2_mix_sources(spark, str(tmp_path)), lambda: mixing.mix_documents(docs)):
            with pytest.raises(ValueError, match="slot"):
                use().count()


def test_small_sources_get_their_targets(spark):
    rows = [(1000 * s + i, "w " * 2000, f"big{s:02}") for s in range(6) for i in range(50)]
    rows += [(100_000 + 10 * s + i, "w " * 100, f"small{s:02}") for s in range(40) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # few slots for the words, as in a corpus of billions of words
    placed, pieces = mixing.mix(docs, block=2048)
    by = {r._source: (r.taken, r.target) for r in mixing.taken(placed, pieces).groupBy("_source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert len(by) == 46 and all(abs(taken - target) <= 1 for taken, target in by.values())
    assert pieces.groupBy("slot").agg(F.count_distinct("rank").alias("n")).where("n > 1").count() == 0


def test_against_a_brute_force_mix(spark):
    """200 sources of one word to a million: targets, streams, schedule and what is taken, each by plain loops."""
    rng = random.Random(31)
    rows = []
    for s in range(200):
        left = round(10 ** (6 * s / 199))
        while left > 0:
            n = min(left, rng.randint(1, max(1, left // rng.randint(1, 12))), 200_000)
            rows.append((len(rows), n, f"s{s:03}" if s else None))
            left -= n
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string").select("doc_id", F.expr("repeat('w ', n)").alias("text"), "source").repartition(8)
    placed, pieces = mixing.mix(docs)
    out = mixing.taken(placed, pieces).collect()
    assert len(out) == len(rows)
    names = sorted({r[2] for r in rows if r[2]}) + [None]
    sizes = {s: sum(n for _, n, x in rows if x == s) for s in names}
    target = dict(zip(names, water([sizes[s] for s in names])))
    streams = defaultdict(list)
    for r in out:
        assert r.size == rows[r._id][1] and r.source_size == sizes[r._source] and abs(r.target - target[r._source]) < 1e-6 * max(1, r.target)
        streams[r._source].append(r)
    for s, own in streams.items():
        end, at = round(target[s]), 0
        for r in sorted(own, key=lambda r: r.start):  # laid end to end
            assert r.start == at
            at += r.size
            assert r.taken == sum(max(0, min(end, lap * sizes[s] + at) - min(end, lap * sizes[s] + r.start)) for lap in range(3))
        assert sum(r.taken for r in own) == end
    # the schedule: slot by slot, each source's blocks in order
    total = sum(target.values())
    top, tops = 0.0, []
    for s in names:
        top += target[s] / total
        tops.append(top)
    count, plan = Counter(), {}
    slots = int(total / mixing.BLOCK * 1.002) + 64
    for t in range(slots):
        u = (t + 1) * 11400714819323198485 % 2**64 / 2**64
        rank = next((i for i, x in enumerate(tops) if u < x and target[names[i]] > 0), len(names) - 1) + 1
        plan[rank, count[rank]] = t
        count[rank] += 1
    used, filled_ = {}, 0
    for p in pieces.select("rank", "slot", "start", "first", "words").collect():
        used.setdefault((p.slot, p["rank"]), 0)
        used[p.slot, p["rank"]] += p.words
    assert len({s for s, _ in used}) == len(used)  # a slot is one source's
    of_rank = defaultdict(list)
    for (slot, rank), words in used.items():
        of_rank[rank].append((slot, words))
        assert words <= mixing.BLOCK
        filled_ += slot >= slots
    for rank, own in of_rank.items():
        end = round(target[names[rank - 1]])
        assert len(own) == -(-end // mixing.BLOCK) and sum(w for _, w in own) == end
        planned = [plan[rank, r] for r in range(min(count[rank], len(own)))]
        assert sorted(slot for slot, _ in own if slot < slots) == planned
    assert filled_ == sum(max(0, len(own) - count[rank]) for rank, own in of_rank.items())
