"""Cutting lineage where several later steps start from one costly result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on a local master may it be unset; it is then beside the warehouse."""
    context = spark.sparkContext._jsc.sc()
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None)
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: compressed columns take a fraction of a checkpoint's rows, and later steps read only those they need."""
    # a null without a type has no form in files
    void = [f.name for f in df.schema if f.dataType == NullType()]
    at = scratch(df.sparkSession, "kept")
    df.drop(*void).write.mode("overwrite").option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.drop(*void).schema).parquet(at)
    return out.select(*(F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns)) if void else out


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared one. It goes when the driver ends, as results may be read from it until then."""
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return at
