"""Dates in documents: day-first parsing, labelled candidates, the one date a document sorts on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.dosing import let

# Labels with their weights, forward-looking words, limits.
LABELS = {
    "collected on": 1.00, "collection date": 1.00, "sample collected": 1.00, "date of admission": 1.00, "admitted on": 1.00,
    "date of discharge": 1.00, "discharged on": 1.00, "date of visit": 1.00, "visit date": 1.00, "date": 0.85, "dated": 0.85,
    "dt": 0.75, "दिनांक": 0.85, "reported on": 0.70, "report date": 0.70, "printed on": 0.45, "generated on": 0.45,
}
FORWARD = ("review", "follow up", "follow-up", "f/u", "next visit", "revisit", "valid till", "valid up to", "expiry", "exp")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNLABELLED = 0.35
SHORT_YEAR = 0.75
TIE = 0.6
MAX_AGE = 60
LOOK_BEHIND = 40
NUMERIC_DATE = r"(?<![\p{L}\p{N}_])(\p{Nd}{1,2})\s*[/\-.]\s*(\p{Nd}{1,2})\s*[/\-.]\s*(\p{Nd}{2,4})(?![\p{L}\p{N}_])"
DMY = r"(?=\d)(?<![\d/])(\d{1,2})[/\-.\s](\d{1,2}|[A-Za-z]{3,4}\.?)[/\-.\s](\d{4}|\d{2})(?![\d/])"
LABEL_BEFORE = r"(?i)(?:date|collected|reported|issued|dated|दिनांक|तारीख)\s*[:\-]?\s*$"


def _date(year: Column, month: Column, day: Column) -> Column:
    """A calendar date or null, whatever the numbers."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.when(year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= days), F.make_date(year, month, day))


def spans(text: Column, pattern: str) -> Column:
    """(before, m) for each match: all text before it and the match."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    ends = F.aggregate(F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("p"), found.alias("m")), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda s, x: F.struct((s["at"] + F.char_length(x["p"]) + F.char_length(x["m"])).alias("at"), F.concat(s["starts"], F.array(s["at"] + F.char_length(x["p"]))).alias("starts")), lambda s: s["starts"])
    return F.arrays_zip(ends.alias("start"), found.alias("m"))


def parse_dmy(raw: Column, pivot: int = 70) -> Column:
    """struct(value date, ambiguous) of a day-first date; value is null if there is no such day."""
    return let(F.split(F.regexp_replace(F.regexp_extract(raw, DMY, 0), DMY, "$1\x01$2\x01$3"), "\x01", -1), lambda g: _dmy(g, pivot))


def _dmy(found: Column, pivot: int) -> Column:
    part = lambda i: F.coalesce(F.get(found, i - 1), F.lit(""))
    month = F.lower(F.regexp_replace(part(2), r"\.$", ""))
    named = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(month, 1, 3)), F.lit(0)).cast("int")
    named = F.when((F.char_length(month) <= 3) | (month == "sept") | month.rlike("^[a-z]{4}$"), named)
    numeric = part(2).rlike("^[0-9]")
    year = part(3).cast("int")
    full = F.when(F.char_length(part(3)) == 2, year + F.when(year > pivot, 1900).otherwise(2000)).otherwise(year)
    value = _date(full, F.when(numeric, F.try_to_number(part(2), F.lit("99")).cast("int")).otherwise(named), part(1).cast("int"))
    return F.struct(value.alias("value"), (numeric & (part(1).cast("int") <= 12)).alias("ambiguous"))


def date_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' rows times their dates: pos, raw, value, ambiguous, labelled (a date word ends right before, within 20 characters)."""
    rows = docs.select("*", F.posexplode(spans(F.col(text_col), DMY)).alias("pos", "_s"))
    before = F.substring(text_col, F.greatest(F.col("_s.start") - 19, F.lit(1)), F.least(F.col("_s.start"), F.lit(20)))
    return rows.withColumn("raw", F.col("_s.m")).withColumn("_p", parse_dmy(F.col("raw"))).select(*docs.columns, "pos", "raw", "_p.value", "_p.ambiguous", before.rlike(LABEL_BEFORE).alias("labelled")).where("value is not null")


def best_date(docs: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, value, confidence): labelled before unlabelled, unambiguous before ambiguous, then reading order."""
    found = date_entities(docs, text_col)
    first = found.groupBy(*key).agg(F.max_by(F.struct("value", "ambiguous"), F.struct("labelled", ~F.col("ambiguous"), -F.col("pos"))).alias("b"))
    return first.select(*key, F.col("b.value").alias("value"), F.when(F.col("b.ambiguous"), 0.70).otherwise(0.95).alias("confidence"))


def date_candidates(docs: DataFrame, today: str, text_col: str = "text") -> DataFrame:
    """docs' rows times their plausible numeric dates: iso (date), score, label.

    Future dates, dates over sixty years back and those after a forward-looking word (within 40 characters) are left out;
    the heaviest label there counts. A two-digit year is completed, at a discount.
    """
    rows = docs.select("*", F.posexplode(spans(F.col(text_col), NUMERIC_DATE)).alias("pos", "_s"))
    ascii_ = F.translate(F.col("_s.m"), "०१२३४५६७८९", "0123456789")
    part = lambda i: F.regexp_extract(ascii_, r"^(\d+)\s*[/\-.]\s*(\d+)\s*[/\-.]\s*(\d+)$", i).cast("int")
    short = part(3) < 100
    now = F.lit(today).cast("date")
    year = F.when(short, F.when(part(3) + 2000 > F.year(now), part(3) + 1900).otherwise(part(3) + 2000)).otherwise(part(3))
    before = F.lower(F.substring(text_col, F.greatest(F.col("_s.start") - LOOK_BEHIND + 1, F.lit(1)), F.least(F.col("_s.start"), F.lit(LOOK_BEHIND))))
    label = F.reduce(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(w).alias("w")) for n, w in LABELS.items())), F.struct(F.lit(None).cast("string").alias("label"), F.lit(UNLABELLED).alias("w")), lambda s, x: F.when(F.contains(before, x["label"]) & (x["w"] > s["w"]), F.struct(x["label"].alias("label"), x["w"].alias("w"))).otherwise(s))
    out = rows.select(*docs.columns, "pos", _date(year, part(2), part(1)).alias("iso"), short.alias("_short"), label.alias("_l"), F.array_contains(F.transform(F.array(*map(F.lit, FORWARD)), lambda f: F.contains(before, f)), True).alias("_ahead"))
    out = out.where(~F.col("_ahead") & (F.col("iso") <= now) & (F.year(now) - F.year("iso") <= MAX_AGE))
    return out.select(*docs.columns, "pos", "iso", (F.col("_l.w") * F.when(F.col("_short"), SHORT_YEAR).otherwise(1.0)).alias("score"), F.col("_l.label").alias("label"))


# Why a date counts.
NO_DATE = "no usable date found on the document"
SEVERAL_DATES = " equally-labelled dates, earliest kept"
NO_LABEL = "unlabelled date on page"


def clinical_date(docs: DataFrame, key: list[str], today: str, confidence_col: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with clinical_date, date_confidence and date_reason: the best candidate, scaled by how well the page was read; of different dates that tie the earliest, at 0.6. Candidates stay in their document's group."""
    found = date_candidates(docs.select(*key, text_col), today, text_col)
    top = found.withColumn("top", F.max("score").over(Window.partitionBy(*key))).where("abs(score - top) < 1e-9")
    one = top.groupBy(*key).agg(F.min("iso").alias("clinical_date"), F.max("top").alias("_score"), F.count_distinct("iso").alias("_n"), F.min_by("label", F.struct("iso", "pos")).alias("_label"))
    ocr = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(confidence_col))) if confidence_col else F.lit(1.0)
    reason = F.when(F.col("_n").isNull(), NO_DATE).when(F.col("_n") > 1, F.concat(F.lit("ambiguous: "), F.col("_n").cast("string"), F.lit(SEVERAL_DATES))).when(F.col("_label").isNull(), NO_LABEL).otherwise(F.concat(F.lit("labelled '"), "_label", F.lit("'")))
    return docs.join(one, key, "left").select(*docs.columns, "clinical_date", F.coalesce(F.col("_score") * ocr * F.when(F.col("_n") > 1, TIE).otherwise(1.0), F.lit(0.0)).alias("date_confidence"), reason.alias("date_reason"))
