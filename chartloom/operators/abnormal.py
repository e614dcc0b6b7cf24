"""Lab results against the printed and the curated reference range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.dosing import let

# How much wider or narrower a printed range may be, and units that mean the same.
GARBLED = 2.0
UNITS = {"percent": "%", "u/l": "iu/l", "/cumm": "cells/cumm"}
_RANGE = r"^\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*$"


def range_of(text: Column) -> Column:
    """struct(low, high); null for what doesn't parse or is inverted."""
    sides = F.struct(*(F.regexp_extract(text, _RANGE, i).try_cast("double").alias(n) for i, n in enumerate(("low", "high"), 1)))
    return let(sides, lambda r: F.when(r["low"] < r["high"], r))


def unit_key(unit: Column) -> Column:
    plain = F.nullif(F.lower(F.trim(unit)), F.lit(""))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), plain), plain)


def judge(labs: DataFrame) -> DataFrame:
    """labs (text, value_num, unit, reference_range, curated_range, curated_unit, …) with direction, used_low, used_high, used_unit and warning.

    A non-numeric value gets no verdict and no warning. The printed range counts, unless units differ (no verdict), or
    its width is under half or over twice the curated one's (the curated range counts); bounds are normal.
    """
    num, unit = F.col("value_num"), F.col("unit")

    def state(d: Column, c: Column) -> Column:
        both = d.isNotNull() & c.isNotNull()
        mismatch = both & (unit_key(unit) != unit_key(F.col("curated_unit")))
        widths = (d["high"] - d["low"]) / (c["high"] - c["low"])
        garbled = both & ((widths < 1 / GARBLED) | (widths > GARBLED))
        return F.when(num.isNull(), "none").when(F.coalesce(mismatch, F.lit(False)), "unit").when(F.coalesce(garbled, F.lit(False)), "garbled").when(both & (d != c), "differs").when(d.isNull() & c.isNull(), "missing").when(d.isNull(), "curated").otherwise("printed")

    def verdict(s: Column, d: Column, c: Column) -> Column:
        curated = s.isin("garbled", "curated")
        warning = F.when(s == "unit", "unit differs from the curated table's, not assessed").when(s == "garbled", "printed range implausible, curated range used").when(s == "differs", "printed range differs from the curated one, printed range used").when(s == "missing", "no reference range, not assessed")

        def of(r: Column) -> Column:
            direction = F.when(num > r["high"], "high").when(num < r["low"], "low")
            return F.struct(s.alias("state"), direction.alias("direction"), r["low"].alias("used_low"), r["high"].alias("used_high"), F.when(curated, F.col("curated_unit")).otherwise(unit).alias("used_unit"), warning.alias("warning"))

        return let(F.when(s.isin("none", "unit", "missing"), None).when(curated, c).otherwise(d), of)

    ranges = F.struct(range_of(F.col("reference_range")).alias("d"), range_of(F.col("curated_range")).alias("c"))
    made = let(ranges, lambda r: let(state(r["d"], r["c"]), lambda s: verdict(s, r["d"], r["c"])))
    # one element: a later condition on a verdict then reads it, where it would be worked out again for the condition
    return labs.select("*", F.explode(F.array(made)).alias("_v")).select(*labs.columns, "_v.*")


def with_curated(labs: DataFrame, curated: DataFrame) -> DataFrame:
    """labs with curated_range and curated_unit: by code, or else by key, of the table's first row; curated has (row_no, key, code, range, unit)."""
    by_code = curated.where("code is not null").groupBy(F.col("code").alias("_code")).agg(F.min(F.struct("row_no", "range", "unit")).alias("_a"))
    by_key = curated.groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("row_no", "range", "unit")).alias("_b"))
    from chartloom.functions.text import lookup_key

    out = labs.withColumn("_k", lookup_key(F.col("text"))).join(by_code, F.col("code") == F.col("_code"), "left").join(by_key, F.col("_k") == F.col("_key"), "left")
    first = F.when(F.col("_b").isNull() | (F.col("_a.row_no") <= F.col("_b.row_no")), F.col("_a")).otherwise(F.coalesce("_b", "_a"))
    return out.withColumn("_f", first).select(*labs.columns, F.col("_f.range").alias("curated_range"), F.col("_f.unit").alias("curated_unit"))


def flags(judged: DataFrame) -> DataFrame:
    """The results out of range, with the range in words."""
    shown = lambda x: F.when(x == F.floor(x), F.concat(x.cast("long").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))
    return judged.where("direction is not null").withColumn("range_text", F.concat(shown(F.col("used_low")), F.lit("-"), shown(F.col("used_high"))))
