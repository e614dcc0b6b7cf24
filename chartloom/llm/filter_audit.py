"""Filter interaction audit: what each filter removes in every order of filters, from packed bitmaps.

A partition's rows are sorted by part, each part beginning on a 64-bit word, and every filter's failures and every label
become a bitset. The rows that pass a set of filters are the AND-NOT of its bitsets; popcounts of these, by part, are all that
leaves a task. Summed over partitions, the counts of the sets answer for every order: a step removes what passes the filters
before it, less what passes them and its own.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.runtime import WORD, cut, released, ship, sized_broadcast, table

#: Filters of one audit: their sets and orders are listed.
MOST_FILTERS = 6
#: Repeated texts that are named by a broadcast; more by a shuffle.
FEW = 500_000
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 100, 80, 10
SIGNS = "#$%&*|"
_UPPER = bytes(range(65, 91))
_SIGN = re.compile(b"[" + re.escape(SIGNS.encode()) + b"]")


def bitmaps(codes: np.ndarray, n_parts: int, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The words at which parts begin, each column as a bitset over rows sorted by part, and the bitset of all rows."""
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=n_parts)
    words = -(-sizes // 64)
    begin = np.cumsum(words) - words
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes)) + np.repeat(64 * begin - (np.cumsum(sizes) - sizes), sizes)

    def packed(column: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * int(words.sum()), bool)
        bits[place] = column
        return np.packbits(bits, bitorder="little").view(np.uint64)

    return begin, [packed(c) for c in columns], packed(np.ones(len(codes), bool))


def passing(fails: list[np.ndarray], rows: np.ndarray):
    """(set of filters as a bit mask, bitset of the rows that fail none of them), every set after its subsets."""
    alive = [rows]
    for mask in range(1 << len(fails)):
        if mask:
            last = mask.bit_length() - 1
            alive.append(alive[mask ^ 1 << last] & ~fails[last])
        yield mask, alive[mask]


def set_counts(rows: DataFrame, filters: list[str], part_col: str, labels: list[str]) -> DataFrame:
    """(part, mask, kept, n_<label>...): for each part and set of filters the rows that fail none, and of these those with each label.

    filters and labels name boolean columns; null is false. A null part is the empty string's. No rows, no counts.
    """
    ship(rows.sparkSession)
    names = ["part", "mask", "kept", *(f"n_{c}" for c in labels)]

    def count(batches):
        for batch in released(batches):
            if not batch.num_rows:
                continue
            parts = batch.column(0).dictionary_encode()
            columns = [pc.fill_null(batch.column(i), False).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)]
            begin, sets, every = bitmaps(parts.indices.to_numpy(), len(parts.dictionary), columns)
            wanted = [every, *sets[len(filters) :]]
            out: list[list] = [[] for _ in names]
            for mask, alive in passing(sets[: len(filters)], every):
                out[0].extend(parts.dictionary.to_pylist())
                out[1].extend([mask] * len(begin))
                for column, label in zip(out[2:], wanted):
                    column.extend(np.add.reduceat(np.bitwise_count(alive & label), begin, dtype=np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=names)

    picked = rows.select(F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), *(F.col(f"`{c}`") for c in [*filters, *labels]))
    counts = picked.mapInArrow(count, "part string, mask int, kept long" + "".join(f", `n_{c}` long" for c in labels))
    return counts.groupBy("part", "mask").agg(*(F.sum(f"`{c}`").alias(c) for c in names[2:]))


def orders(spark: SparkSession, filters: list[str]) -> DataFrame:
    """(at, filter_order, step, own, before): one row for each step of each order; own is the step's filter, before the mask of those applied earlier."""
    rows = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, own in enumerate(order, 1):
            rows.append((len(rows), "".join(filters[i] for i in order), step, own, before))
            before |= 1 << own
    return spark.createDataFrame(rows, "at int, filter_order string, step int, own int, before int")


def audit(rows: DataFrame, filters: list[str], part_col: str, good_col: str, toxic_col: str) -> DataFrame:
    """For each part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    filters are boolean columns that say which rows fail; filter_order joins their names. removed are the rows that pass the filters
    before and fail this one; redundant fail it and went before; unique_fails fail it alone; shapley sums its removed over all orders.
    Rows count one by one, repeated ones too; nulls in flags and labels are false; a null part is the empty string's; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    n, every = len(filters), (1 << len(filters)) - 1
    counts = set_counts(rows, filters, part_col, [good_col, toxic_col])
    sets = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "kept", F.col(f"`n_{good_col}`").alias("good"), F.col(f"`n_{toxic_col}`").alias("toxic")))).alias("sets"))

    def passed(mask, what: str):
        return F.col("sets")[mask][what]

    def shapley(own: int):
        terms = []
        for mask in range(1 << n):
            if not mask >> own & 1:
                k = mask.bit_count()
                terms.append((passed(F.lit(mask), "kept") - passed(F.lit(mask | 1 << own), "kept")) * F.lit(math.factorial(k) * math.factorial(n - 1 - k)))
        return sum(terms[1:], terms[0])

    sets = sets.withColumn("share", F.array(*(shapley(i) for i in range(n)))).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n * math.factorial(n) - 1))))
    steps = sets.join(F.broadcast(orders(rows.sparkSession, filters)), "at")  # n * n! rows, 4,320 at most
    own = F.element_at(F.array(*(F.lit(1 << i) for i in range(n))), F.col("own") + 1)
    after = F.col("before").bitwiseOR(own)
    removed = passed(F.col("before"), "kept") - passed(after, "kept")
    fails = passed(F.lit(0), "kept") - passed(own, "kept")
    others = F.lit(every).bitwiseXOR(own)
    return steps.select(
        "part", "filter_order", "step", passed(after, "kept").alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        (passed(others, "kept") - passed(F.lit(every), "kept")).alias("unique_fails"),
        (passed(F.col("before"), "good") - passed(after, "good")).alias("good_lost"), (passed(F.col("before"), "toxic") - passed(after, "toxic")).alias("toxic_lost"),
        F.col("share")[F.col("own")].alias("shapley"),
    )


def text_filters(text: bytes | None) -> tuple[bool, bool, bool, bool]:
    """Whether a whole text fails A (words), B (distinct words), C (capitals) and D (signs)."""
    text = text or b""
    words = text.split()  # bytes split at just these six characters
    points = len(text.decode("utf-8", "replace"))
    return len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words), 100 * (len(text) - len(text.translate(None, _UPPER))) > MAX_UPPER_PERCENT * points, _SIGN.search(text) is not None


def filter_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic), one row for each row of docs: the filters that its whole text fails, and its labels.

    Null texts are empty. E fails where a smaller id has an equal text; a null id is neither smaller nor larger than any, and rows of one id
    don't fail each other. A document has a label if any of its rows in labels has a 1; null ids have none. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{part_col}`").cast("string").alias("part"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(12), text).alias("t2"), F.octet_length(text).cast("long").alias("size"), text.cast("binary").alias("text"))

    def judge(batches):
        for batch in released(batches):
            found = [text_filters(t.as_py()) for t in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([f[i] for f in found], pa.bool_()) for i in range(4))], names=["id", "part", "t1", "t2", "size", *"ABCD"])

    kind = rows.schema["id"].dataType.simpleString()
    rows = cut(rows.mapInArrow(judge, f"id {kind}, part string, t1 long, t2 long, size long, A boolean, B boolean, C boolean, D boolean"))
    # of each text that several ids have, the least: aggregated before it is shuffled, and joined from a table of its own so that Spark can split a hot text
    first = cut(rows.groupBy("t1", "t2", "size").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most"))
    rows = rows.join(sized_broadcast(first, first.count(), FEW), ["t1", "t2", "size"], "left").withColumn("E", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    known = labels.groupBy(F.col("doc_id").alias("l")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(known, F.col("id") == F.col("l"), "left").select("part", *"ABCDE", "good", "toxic")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by language, in all 120 orders. Nulls, ties, repeated rows and empty tables as in filter_flags and audit."""
    flags = filter_flags(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return audit(flags, list("ABCDE"), "part", "good", "toxic")


ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), known AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, [len(ws) < {MIN_WORDS}, 100 * len(list_distinct(ws)) < {MIN_DISTINCT_PERCENT} * len(ws),
                100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER_PERCENT} * length(text),
                regexp_matches(text, '[{SIGNS}]'), coalesce(t.doc_id > least, false)] AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM t LEFT JOIN known USING (doc_id)
), patterns AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), l(i) AS (SELECT unnest([1, 2, 3, 4, 5])), perms AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT array_to_string(list_transform(p, lambda x: chr((64 + x)::INT)), '') AS filter_order, step, p[step] AS own, p[1 : step - 1] AS before
  FROM perms, unnest([1, 2, 3, 4, 5]) AS s(step)
), judged AS (
  SELECT part, filter_order, step, own, n, patterns.good, patterns.toxic, fails[own] AS failed,
         len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails
  FROM patterns, steps
), counted AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE NOT failed AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE failed AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE failed AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE failed AND n_fails = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE failed AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE failed AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
