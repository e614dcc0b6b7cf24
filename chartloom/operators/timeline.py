"""The timeline of a session's documents: unreadable ones apart, duplicates folded, ordered."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits, and the order of kinds on one day.
UNREADABLE = 0.30
DUPLICATE = 0.6
LEAST_KEYS = 2
KINDS = {"note": 0, "condition": 1, "imaging": 2, "lab": 3, "allergy": 4, "prescription": 5}


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty or null."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_union(a, b)))), F.lit(0.0))


def dose_conflict(a: Column, b: Column) -> Column:
    """Whether a drug of both has different doses; each is an array of struct(drug, doses sorted)."""
    return F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: (x["drug"] == y["drug"]) & (x["doses"] != y["doses"]))), F.lit(False))


def verdict(a: str, b: str) -> Column:
    """Why two entries are or aren't duplicates, the cheap tests first; a and b name structs of kind, date, keys, doses."""
    c = lambda side, name: F.col(f"{side}.{name}")
    overlap = jaccard(c(a, "keys"), c(b, "keys"))
    few = F.least(F.size(c(a, "keys")), F.size(c(b, "keys"))) < LEAST_KEYS
    return F.when(c(a, "kind") != c(b, "kind"), "different kind").when(c(a, "date").isNull() & c(b, "date").isNull(), "both undated").when(~c(a, "date").eqNullSafe(c(b, "date")), "different date").when(few, "too few keys").when(dose_conflict(c(a, "doses"), c(b, "doses")), "dose changed").when(overlap >= DUPLICATE, "duplicate").otherwise("different content")


def split_readable(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable): under the least confidence, or nothing found."""
    bad = (F.col("mean_confidence") < UNREADABLE) | (F.coalesce("n_entities", F.lit(0)) == 0)
    return docs.where(~bad), docs.where(bad)


def kind_rank(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), kind), F.lit(99))


def order(entries: DataFrame, session: list[str], seq_col: str = "seq") -> DataFrame:
    """entries with pos from 1: dated by date, kind, title; undated after; ties as they came."""
    w = Window.partitionBy(*session).orderBy(F.asc_nulls_last("date"), kind_rank(F.col("kind")), F.lower("title"), seq_col)
    return entries.withColumn("pos", F.row_number().over(w))


def newest_first(entries: DataFrame, session: list[str]) -> DataFrame:
    return entries.withColumn("line_no", F.row_number().over(Window.partitionBy(*session).orderBy(F.desc("pos"), "entity_no")))


_NAMES = ("session", "kind", "date", "seq", "document_id", "title", "facility", "confidence")


def _fold(group: list[dict]) -> list[dict]:
    """Entries in order against those kept so far; the first duplicate found absorbs the entry."""
    kept: list[dict] = []
    for row in group:
        keys = {k: i for i, k in enumerate(row["keys"] if row["keys"] is not None else [])}
        doses = {d["drug"]: tuple(d["doses"]) for d in (row["doses"] if row["doses"] is not None else [])}
        for old in kept:
            if min(len(keys), len(old["k"])) < LEAST_KEYS or any(doses[x] != old["d"][x] for x in doses.keys() & old["d"].keys()):
                continue
            if len(keys.keys() & old["k"].keys()) / len(keys.keys() | old["k"].keys()) < DUPLICATE:
                continue
            if row["confidence"] > old["confidence"]:
                main = {"document_id": row["document_id"], "title": row["title"], "facility": row["facility"] or old["facility"], "confidence": row["confidence"]}
                merged, late = {**keys}, old["k"]
            else:
                main = {k: old[k] for k in ("document_id", "title", "confidence")} | {"facility": old["facility"] or row["facility"]}
                merged, late = {**old["k"]}, keys
            for k in late:
                merged.setdefault(k, len(merged))
            ids = dict.fromkeys([*old["ids"], row["document_id"]])
            drugs = {**doses, **old["d"]} if row["confidence"] <= old["confidence"] else {**old["d"], **doses}
            old.update(main, k=merged, ids=list(ids), d=drugs)
            break
        else:
            kept.append({**{k: row[k] for k in _NAMES}, "k": keys, "d": doses, "ids": [row["document_id"]]})
    return [{**{c: o[c] for c in _NAMES}, "duplicate_of": [i for i in o["ids"] if i != o["document_id"]], "keys": list(o["k"])} for o in kept]


def _fold_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds each run of rows of one session, kind and date; a run is held, a partition isn't."""
    columns = [*_NAMES, "duplicate_of", "keys"]
    run, of, out = [], None, []
    for frame in frames:
        names = list(frame.columns)
        for values in zip(*(frame[c].tolist() for c in names)):
            row = dict(zip(names, values))
            key = row["session"], row["kind"], row["date"]
            if key != of:
                out += _fold(run)
                run, of = [], key
            run.append(row)
        yield pd.DataFrame(out, columns=columns)
        out = []
    yield pd.DataFrame(_fold(run), columns=columns)


def fold_duplicates(entries: DataFrame) -> DataFrame:
    """Kept entries of (session, seq, document_id, kind, date, title, facility, confidence, keys, doses).

    Greedy in seq order: each entry meets the kept ones of its session, kind and date; the first of which at least 0.6 of
    all keys are shared (two keys on either side, no dose changed) absorbs it, losing no key or id. The better
    read entry names the result, which keeps the first one's place. Only dated entries with two keys can fold, so only
    those whose session, kind and date occur twice go through Python; a group is what one session has of a kind on a day.
    """
    counted = entries.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("session", "kind", "date")))
    alone = (F.col("_n") == 1) | F.col("date").isNull()
    types = {f.name: f.dataType.simpleString() for f in entries.schema}
    names = _NAMES
    ids = f"array<{types['document_id']}>"
    by = ["session", "kind", "date"]
    # the count has dealt the rows out by these three, so the fold only sorts them
    folded = counted.where(~alone).drop("_n").sortWithinPartitions(*by, "seq").mapInPandas(_fold_sorted, ", ".join(f"{n} {types[n]}" for n in names) + f", duplicate_of {ids}, keys array<string>")
    single = counted.where(alone).select(*names, F.array().cast(ids).alias("duplicate_of"), "keys")
    return single.unionByName(folded)


def merge_notes(kept: DataFrame) -> DataFrame:
    return kept.select("session", F.explode("duplicate_of").alias("other"), "document_id").select("session", F.concat(F.lit("merged "), F.col("other").cast("string"), F.lit(" into "), F.col("document_id").cast("string"), F.lit(": same day, same kind, shared content")).alias("note"))


def gaps(docs: DataFrame, found: DataFrame, session: list[str], sure: float = 0.5) -> DataFrame:
    """Per session: how many documents, unreadable ones, uncertain lab or drug entities (confidence under 0.5), a preview of three of their texts, and whether nothing at all is documented."""
    readable, unreadable = split_readable(docs)
    doubtful = found.where(F.col("kind").isin("lab", "medication") & (F.col("confidence") < sure)).groupBy(*session).agg(F.transform(F.array_sort(F.collect_list(F.struct("document_id", "entity_no", "text"))), lambda e: e["text"]).alias("names"))
    counts = docs.groupBy(*session).agg(F.count(F.lit(1)).alias("n_documents")).join(unreadable.groupBy(*session).agg(F.count(F.lit(1)).alias("n_unreadable")), session, "left").join(doubtful, session, "left")
    n = F.size(F.coalesce("names", F.array().cast("array<string>")))
    more = F.when(n > 3, F.concat(F.lit(" and "), (n - 3).cast("string"), F.lit(" more"))).otherwise("")
    return counts.select(*session, "n_documents", F.coalesce("n_unreadable", F.lit(0)).alias("n_unreadable"), n.cast("long").alias("n_uncertain"), F.concat(F.array_join(F.slice(F.coalesce("names", F.array().cast("array<string>")), 1, 3), ", "), more).alias("preview"), (F.coalesce("n_unreadable", F.lit(0)) == F.col("n_documents")).alias("entirely_undocumented"))
