"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Every source's documents are shuffled and laid end to end; the stream, repeated up to three times, is cut into blocks of
`block` words. Slot t of the schedule takes the golden-ratio point frac((t + 1) / phi), mapped through the sources'
cumulative targets to a source; its rank among the source's slots names the block it takes. What the mix takes of a document is
what the blocks that have a slot hold of it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm.runtime import cut, sized_broadcast, spare, table, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Words of a block.
BLOCK = 2048
#: Documents of a source are shuffled into this many piles, whose words are summed first.
PILES = 4096
#: Slots are ranked within runs of this many.
RUN = 1 << 14
SEED = 77
#: The point of slot t: (t + 1) times 2^64 over the golden ratio, modulo 2^64, as a fraction of it.
_POINT = "cast(pmod(cast(id + 1 as decimal(15,0)) * 11400714819323198485BD, 18446744073709551616BD) as double) / 18446744073709551616D"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.0, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target double, rank) from (source, source_size), one row a source.

    Sources in code-point order, null last, weigh `weights`, repeating, and share `share` of all words. A target stops
    at `repeats` times its source's size and the excess goes to the others by weight until none is above. Sorted by
    what fills first (size over weight), the sources that stop are a prefix, found by running sums. A source without
    words has target 0. No sources, no rows. Rows here are sources, so one task sorts them.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cap = (repeats * F.col("source_size")).cast("double")
    ranked = sources.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", cap)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    all_ = Window.partitionBy()
    known = ranked.withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("after", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))).withColumn("all", F.sum("source_size").over(all_) * F.lit(float(share)))
    level = (F.col("all") - F.col("before")) / F.col("after")
    stops = level * F.col("w") >= F.col("cap")
    place = F.struct((F.col("cap") / F.col("w")).alias("fill"), "rank")
    known = known.withColumn("first", F.min(F.when(~stops, F.struct(place.alias("at"), level.alias("level")))).over(all_))
    target = F.when(F.col("first").isNull() | (place < F.col("first.at")), F.col("cap")).otherwise(F.col("first.level") * F.col("w"))
    return known.select("source", "source_size", target.alias("target"), "rank")


def schedule(wanted: DataFrame, block: int, slots: int) -> DataFrame:
    """(rank, r, slot): for each slot its source (by rank) and which of the source's blocks it takes.

    wanted has (rank, target). Ranking is in two levels, so no task holds a source's slots: counts by run of slots
    first, then ranks within a run.
    """
    spark = wanted.sparkSession
    order = Window.orderBy("rank")
    spans = wanted.where("target > 0").withColumn("top", F.sum("target").over(order)).withColumn("all", F.sum("target").over(Window.partitionBy())).select(F.col("rank"), F.coalesce(F.lag("top").over(order) / F.col("all"), F.lit(0.0)).alias("lo"), (F.col("top") / F.col("all")).alias("hi"), F.row_number().over(Window.orderBy(F.desc("rank"))).alias("back"))
    # an interval may cross several of the 1,024 equal cells; a slot looks up its cell, then its interval
    cells = 1024
    cell = lambda x: F.least(F.floor(x * cells).cast("int"), F.lit(cells - 1))
    spans = spans.withColumn("hi", F.when(F.col("back") == 1, 2.0).otherwise(F.col("hi"))).withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    spans = cut(spans)
    points = spark.range(slots).withColumn("u", F.expr(_POINT)).withColumn("cell", cell(F.col("u")))
    drawn = points.join(sized_broadcast(spans, spans.count(), 100_000), "cell").where("u >= lo and u < hi").select("id", "rank", F.floor(F.col("id") / RUN).alias("run"))
    before = drawn.groupBy("rank", "run").count().withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("rank", "run", "base")
    inner = F.row_number().over(Window.partitionBy("rank", "run").orderBy("id"))
    return drawn.withColumn("n", inner).join(before, ["rank", "run"]).select("rank", (F.col("base") + F.col("n") - 1).alias("r"), F.col("id").alias("slot"))


def filled(planned: DataFrame, wanted: DataFrame, block: int, slots: int) -> DataFrame:
    """planned with more slots, numbered from `slots` on, for the blocks that a source needs to its target and has no slot for.

    The points miss a source's share by a few slots whatever its size, which may be all that a small source has; a source that lacks more
    than that few has no schedule, which is an error.
    """
    planned = cut(planned)
    have = planned.groupBy("rank").agg(F.count(F.lit(1)).alias("have"))
    lack = wanted.where("target > 0").select("rank", F.ceil(F.round("target") / block).alias("need")).join(have, "rank", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    lack = lack.withColumn("base", F.sum(F.col("need") - F.col("have")).over(Window.orderBy("rank")) - (F.col("need") - F.col("have")) + slots)
    lack = cut(lack)
    worst = lack.agg(F.max(F.col("need") - F.col("have"))).first()[0] or 0
    if worst > 4 + 2 * math.log2(slots + 2):
        raise ValueError(f"the schedule leaves {worst} blocks of a source without a slot")
    extra = lack.select("rank", "base", "have", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("r"))
    return planned.unionByName(extra.select("rank", "r", (F.col("base") + F.col("r") - F.col("have")).alias("slot")))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights=WEIGHTS, share: float = 1.0, repeats: int = MOST_REPEATS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The placed documents and the mix's pieces.

    Placed: _id, _th (text hash), _source, size, source_size, target, rank, start (where the document begins in its
    source's stream), one row for each row of docs. Pieces: (rank, start, slot, first, words): slot takes `words` words
    of the document at start, the first being word number `first`, modulo the document's size. A source's last piece
    ends at its target, rounded.

    Null texts and texts without words have size 0 and no pieces; they and sources without words take nothing. Null
    sources are one source, last in order; null ids shuffle as one value, ties by text. Rows alike in source, id and
    text lie next to each other and may be taken differently. The order rests on hashes of id and text alone, so reruns
    agree. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"))
    rows = cut(rows.withColumn("_shuffle", F.xxhash64(F.lit(SEED), "_id", "_th")).withColumn("_pile", F.pmod(F.col("_shuffle"), F.lit(PILES))))
    piles = rows.groupBy("_source", "_pile").agg(F.sum("size").alias("words"))
    piles = piles.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("_source").orderBy("_pile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    piles = cut(piles)
    wanted = cut(targets(piles.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, share, repeats))
    total = wanted.agg(F.sum("target"), F.count(F.lit(1))).first()
    goal, n_sources = total[0] or 0.0, total[1]
    # each source gets its share of slots to within a few; blocks beyond them get slots after these
    slots = int(goal / block * 1.002) + 64 if goal else 0

    know = sized_broadcast(wanted.withColumnRenamed("source", "s"), n_sources, 10_000)
    within = Window.partitionBy("_source", "_pile").orderBy("_shuffle", "_id", "_th", "size")
    offset = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inner", offset).join(piles.select(F.col("_source").alias("s2"), F.col("_pile").alias("p2"), "base"), F.col("_source").eqNullSafe(F.col("s2")) & (F.col("_pile") == F.col("p2"))).join(know, F.col("_source").eqNullSafe(F.col("s")))
    placed = cut(placed.select("_id", "_th", "_source", "size", "source_size", "target", "rank", (F.col("base") + F.col("inner")).cast("long").alias("start")))

    end = F.round("target").cast("long")
    laps = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: F.col("start") + e * F.col("source_size"))
    laid = placed.where("size > 0 and target > 0").select("rank", "start", "size", end.alias("end"), F.explode(laps).alias("at")).where("at < end")
    last = F.least(F.col("at") + F.col("size"), "end")
    parts = laid.withColumn("last", last).withColumn("r", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("last") - 1) / block))))
    begin = F.greatest("at", F.col("r") * block)
    parts = parts.select("rank", "r", "start", (begin - F.col("at")).alias("first"), (F.least("last", (F.col("r") + 1) * block) - begin).alias("words"))
    planned = filled(schedule(wanted.select("rank", "target"), block, slots), wanted, block, slots)
    pieces = cut(parts.join(planned, ["rank", "r"]).select("rank", "start", "slot", "first", "words"))
    n, met = parts.count(), pieces.count()
    if n != met:
        raise ValueError(f"{n - met} pieces of blocks have no slot")
    return placed, pieces


def taken(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """placed with `taken`, the words that the mix takes of each document, repeats counted, `slots`, where its occurrences begin, in order, and `n_slots`, how many slots hold some of it.

    Documents without words, or of sources without a target, take 0 and have no slots; a row each, whatever is null; no rows, no rows.
    """
    sums = pieces.groupBy("rank", "start").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.when(F.col("first") == 0, F.col("slot")))).alias("slots"), F.count_distinct("slot").alias("n_slots"))
    full = placed.where("size > 0").join(sums, ["rank", "start"], "left")
    none = F.array().cast("array<bigint>")
    empty = placed.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "slots": none, "n_slots": F.lit(0).cast("long")})
    return full.withColumns({"taken": F.coalesce("taken", F.lit(0)).cast("long"), "slots": F.coalesce("slots", none), "n_slots": F.coalesce("n_slots", F.lit(0))}).unionByName(empty)


def mix_documents(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", slot_col: str | None = None, **how) -> DataFrame:
    """docs in the order of the schedule, each row as often as the mix takes its whole text, rounded; rows alike in id, source and text share evenly.

    A row stands where its occurrence's first slot is, which slot_col names, if it is given. Only documents where a source's target ends
    are taken in part, so totals differ from the targets by half a document a source at most. Null texts and such without words
    aren't taken; null sources are one source, null ids one id. Columns pass through, whatever their names; an empty table gives no rows.
    """
    placed, pieces = mix(docs, source_col, id_col, text_col, **how)
    alike = taken(placed, pieces).groupBy("_id", "_th", "_source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.array_sort(F.flatten(F.collect_list("slots"))).alias("slots"))
    i, t, s, n, k = spare(docs, "_id", "_th", "_source", "_slots", "_slot")
    # rows alike begin in the same slots
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    copies = alike.where("size > 0").select(F.col("_id").alias(i), F.col("_th").alias(t), F.col("_source").alias(s), F.slice("slots", 1, times).alias(n)).where(F.size(n) > 0)
    key = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(t)) & F.col(f"`{source_col}`").eqNullSafe(F.col(s))
    out = docs.join(copies, key).withColumn(k, F.explode(n)).repartitionByRange(k).sortWithinPartitions(k)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != slot_col), *([F.col(k).alias(slot_col)] if slot_col else []))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their size, their source's size and target, the words that the mix takes, the slot where it first does, and how many slots do. Nulls, ties, repeated rows and empty tables as in mix."""
    placed, pieces = mix(table(spark, sf_dir, "documents"))
    return taken(placed, pieces).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"), "n_slots")
