"""Dimension tables: clinical terms, drugs and their interactions, read from CSV.

The shipped seeds hold public terminology codes, one alias a row; a deployment gives its own folder of the same layout.
Tables of this kind have a few thousand rows at most, so joins broadcast them by Spark's own size threshold.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.text import lookup_key

SEEDS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "seeds")

SCHEMAS = {
    "lab_alias": "row_no int, ord int, alias string, code string, display string, unit string",
    "drug_alias": "row_no int, ord int, alias string, generic string, code string, display string",
    "condition_alias": "row_no int, ord int, alias string, code string, display string",
    "interaction": "row_no int, drug_a string, drug_b string, severity string, description string",
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header: byte-order mark off, values trimmed, nulls as empty text, rows whose first text column starts with # dropped; a missing file gives no rows."""
    empty = spark.createDataFrame([], schema)
    text = [f.name for f in empty.schema if f.dataType.typeName() == "string"]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, multiLine=False)
    return df.withColumns({c: F.coalesce(F.trim(F.regexp_replace(c, "^﻿", "")), F.lit("")) for c in text}).where(~F.col(text[0]).startswith("#"))


def seed_rows(name: str, folder: str = SEEDS) -> list[tuple]:
    """A shipped table's rows on the driver; for literals, not for data."""
    import csv

    with open(os.path.join(folder, f"{name}.csv"), encoding="utf-8-sig", newline="") as f:
        rows = list(csv.reader(f))[1:]
    kinds = [part.split()[1] for part in SCHEMAS[name].split(", ")]
    return [tuple(int(v) if k == "int" else v.strip() for v, k in zip(r, kinds)) for r in rows if not r[0].startswith("#")]


def load(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A dimension table: the shipped one as a local relation, whose size Spark knows, or that of another folder."""
    if folder is None:
        show = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        fields = [c.split() for c in SCHEMAS[name].split(", ")]
        rows = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in seed_rows(name))
        return spark.sql(f"SELECT {', '.join(f'CAST({c} AS {k}) AS {c}' for c, k in fields)} FROM VALUES {rows} AS t({', '.join(c for c, _ in fields)})")
    return read_csv(spark, f"{folder.rstrip('/')}/{name}.csv", SCHEMAS[name])


def keyed(dim: DataFrame) -> DataFrame:
    """An alias table with the column key, one row for each key: the first table row that has it."""
    named = dim.withColumn("key", lookup_key(F.col("alias"))).where("key != ''")
    first = named.groupBy("key").agg(F.min(F.struct("row_no", "ord", *[c for c in dim.columns if c not in ("row_no", "ord")])).alias("r"))
    return first.select("key", "r.*")


def term_count(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """How many terms the three coded tables have together (interactions aren't terms)."""
    parts = [load(spark, n, folder).where("ord = 0").select("row_no") for n in ("lab_alias", "drug_alias", "condition_alias")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.count(F.lit(1)).alias("terms"))


def hygiene(dim: DataFrame) -> DataFrame:
    """Faults of an alias table: keys that several rows have, and blank fields."""
    repeated = dim.withColumn("key", lookup_key(F.col("alias"))).groupBy("key").agg(F.count_distinct("row_no").alias("n")).where("n > 1").select(F.lit("repeated alias").alias("fault"), F.col("key").alias("what"))
    blank = dim.where(" or ".join(f"trim({c}) = ''" for c in dim.columns if c not in ("row_no", "ord"))).select(F.lit("blank field"), F.col("alias"))
    return repeated.union(blank)


def find_folder(start: str, parts: str = os.path.join("shared", "clinical"), name: str = "ontology.json") -> str:
    """The file `name` under `parts` in the nearest folder at or above start that has it. Driver-side configuration, not data."""
    at = os.path.abspath(start)
    while True:
        found = os.path.join(at, parts, name)
        if os.path.isfile(found):
            return found
        above = os.path.dirname(at)
        if above == at:
            raise FileNotFoundError(f"no {os.path.join(parts, name)} at or above {start}")
        at = above


def status(spark: SparkSession, folder: str | None = None, recogniser: str | None = None) -> DataFrame:
    """One row (status, recogniser, terms, detail): degraded without a recogniser, which is a state, not a fault."""
    missing = F.lit(None if recogniser else "no recogniser: pages without text stay empty").cast("string")
    return term_count(spark, folder).select(F.lit("ok" if recogniser else "degraded").alias("status"), F.lit(recogniser).cast("string").alias("recogniser"), "terms", missing.alias("detail"))
