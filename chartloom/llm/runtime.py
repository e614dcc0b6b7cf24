"""What the training-data operators share: reading tables, shipping code, cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.lineage import scratch, settle

__all__ = ["Remembered", "SPACE", "WORD", "cut", "released", "scratch", "ship", "sized_broadcast", "spare", "table", "word_count"]

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: A word is a run of characters other than these six.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed where they run: from the driver's folder on a local master, as an archive that Spark hands out elsewhere."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local":
        path = context.environment.get("PYTHONPATH", "")
        if ROOT not in path.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))
    elif not getattr(context, "_chartloom_shipped", False):
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "chartloom"), "zip", ROOT, "chartloom")
        context.addPyFile(made)  # copied by Spark: the driver's own file may go
        context._chartloom_shipped = True


class Remembered(dict):
    """What make gives for each string, in two generations of about `most` bytes each; what is used again comes back from the last one. Strings over `longest` characters aren't kept."""

    def __init__(self, make, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest, self.old, self.size = make, most, longest, {}, 0

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if self.size >= self.most:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[key] = found
            self.size += 150 + 2 * len(key) + len(found)  # heads of both and their slot
        return found

    def forget(self) -> None:
        self.clear()
        self.old, self.size = {}, 0


def released(batches, forget=lambda: None):
    """The batches of a task; after the last, or when the task is given up, what the worker holds beyond them goes back to the system.

    Workers stay for later tasks, and their memory is their executor's.
    """
    try:
        yield from batches
    finally:
        forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint: later work doesn't redo what made it, and a lost executor loses none of it."""
    return settle(df)


def sized_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; otherwise Spark joins it by shuffling."""
    return F.broadcast(df) if rows <= most else df


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def word_count(text):
    """Words of a text column; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
