"""What was recognised, by content: a table that each distinct content enters once, and no failed attempt ever.

Rows lie by the first two digits of their content's SHA-256. An upsert writes the prefixes that it touches anew, beside what is there, and then
a manifest that names for each prefix the folder that holds it; readers see one manifest or the next, never half of an
upsert. Of two that upsert at once the later finds its manifest taken, and does its work again on the other's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.lineage import settle

CACHED = "sha string, text string, mean_confidence double"
TRIES = 8


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The last manifest's number, 0 if there is none, and its folders by prefix (256 at most)."""
    at, files = _files(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    last = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)
    return (last, json.loads(spark.read.text(f"{path}/manifests/{last}.json", wholetext=True).first()[0])) if last else (0, {})


def _commit(spark: SparkSession, path: str, number: int, folders: dict[str, str]) -> bool:
    """Puts a manifest in its place, unless another has it."""
    final, files = _files(spark, f"{path}/manifests/{number}.json")
    beside, _ = _files(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = files.create(beside, False)
    out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    out.close()
    if files.exists(final) or not files.rename(beside, final):
        files.delete(beside, False)
        return False
    return True


def read(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """The cached rows (CACHED); only those of some prefixes, if they are given."""
    _, folders = manifest(spark, path)
    wanted = [f"{path}/data/{folder}/prefix={p}" for p, folder in folders.items() if prefixes is None or p in prefixes]
    return spark.read.schema(CACHED).parquet(*wanted) if wanted else spark.createDataFrame([], CACHED)


def upsert(rows: DataFrame, path: str) -> int:
    """Enters the rows (CACHED) whose content isn't there, one for each content: the surest, and of equals the first in text order. Returns how many; none leaves no trace."""
    spark = rows.sparkSession
    best = rows.groupBy("sha").agg(F.min(F.struct((-F.col("mean_confidence")).alias("less"), "text", "mean_confidence")).alias("r"))
    made = settle(best.select("sha", "r.text", "r.mean_confidence").withColumn("prefix", F.substring("sha", 1, 2)))
    for _ in range(TRIES):
        number, folders = manifest(spark, path)
        touched = [r[0] for r in made.select("prefix").distinct().collect()]  # 256 at most
        old = read(spark, path, touched)
        fresh = settle(made.join(old.select("sha"), "sha", "left_anti"))
        n = fresh.count()
        if not n:
            return 0
        touched = [r[0] for r in fresh.select("prefix").distinct().collect()]
        folder = uuid.uuid4().hex
        kept = old.withColumn("prefix", F.substring("sha", 1, 2)).where(F.col("prefix").isin(touched))
        kept.unionByName(fresh).repartition("prefix").write.partitionBy("prefix").parquet(f"{path}/data/{folder}")
        if _commit(spark, path, number + 1, folders | dict.fromkeys(touched, folder)):
            return n
    raise RuntimeError(f"{path}: others upserted {TRIES} times in between")


def recognise(docs: DataFrame, path: str, recogniser: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """docs (…, content binary) with sha, text and mean_confidence, and the contents (sha) that had to be read for it.

    Only contents that the cache doesn't have are read, each once: recogniser takes (sha, content) and gives (sha, text, mean_confidence, failed). What
    failed is told, with what it gave, and not entered, so that it is tried again. A null content has no text and isn't read.
    """
    spark = docs.sparkSession
    every = docs.withColumn("sha", F.sha2("content", 256))
    known = settle(read(spark, path).join(every.select("sha").distinct(), "sha", "left_semi"))
    todo = every.where("content is not null").join(known.select("sha"), "sha", "left_anti").groupBy("sha").agg(F.first("content").alias("content"))
    got = settle(recogniser(todo))
    upsert(got.where("not failed").select("sha", "text", "mean_confidence"), path)
    told = known.unionByName(got.select("sha", "text", "mean_confidence"))
    return every.join(told, "sha", "left").select(*docs.columns, "sha", "text", "mean_confidence"), got.select("sha")
