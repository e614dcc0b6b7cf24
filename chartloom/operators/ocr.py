"""Words that a recogniser read, put together: lines, confidences, whether a page needs another reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The escalation limit and language codes of locales.
ESCALATE = 0.55
LANGUAGES = {"en": "eng", "hi": "hin", "bn": "ben", "mr": "mar", "ta": "tam", "te": "tel", "gu": "guj", "kn": "kan", "ml": "mal", "pa": "pan", "or": "ori", "as": "asm", "ur": "urd", "ne": "nep", "sa": "san"}


def tokens(words: DataFrame) -> DataFrame:
    """Words with text and a confidence, trimmed; conf from 0 to 100 becomes confidence to four places."""
    return words.withColumn("text", F.trim("text")).where("text != '' and conf >= 0").withColumn("confidence", F.bround(F.col("conf") / 100, 4))


def lines(words: DataFrame, page: list[str]) -> DataFrame:
    """(page, line_no, text): a line breaks where block, paragraph or line differ from the word before, so a line that comes again is a new one."""
    w = Window.partitionBy(*page).orderBy("word_no")
    key = F.struct("block", "par", "line")
    broken = words.withColumn("_new", F.when(F.lag(key).over(w) == key, 0).otherwise(1)).withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return broken.groupBy(*page, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("text"))


def page_text(of_lines: DataFrame, page: list[str]) -> DataFrame:
    return of_lines.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def _mean(words: Column) -> Column:
    """Mean of an array of struct(word_no, confidence), added up from the last word to the first: sums of doubles rest on their order, so it is one whatever the partitions (and the one in which the queries' SQL adds)."""
    return F.aggregate(F.sort_array(words, asc=False), F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size(words)


def _line_words(words: DataFrame, page: list[str]) -> DataFrame:
    """Lines with their words; rows are dealt out by page, so what is grouped by page or line from here on isn't shuffled again."""
    return words.repartition(*page).groupBy(*page, "block", "par", "line").agg(F.collect_list(F.struct("word_no", "confidence")).alias("_w"), F.count(F.lit(1)).alias("n")).withColumn("mean", _mean(F.col("_w")))


def six_places(x: Column) -> Column:
    """x to six places, halves up, of the double itself as DuckDB rounds; Spark rounds the shortest decimal that names it, which at a half may go the other way."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def line_confidence(words: DataFrame, page: list[str]) -> DataFrame:
    """Mean confidence of lines of two words or more."""
    return _line_words(words, page).where("n >= 2").select(*page, "block", "par", "line", "mean", "n")


def page_confidence(pages: DataFrame, words: DataFrame, page: list[str], limit: float = ESCALATE) -> DataFrame:
    """(page, mean_confidence, worst_line, low, escalate): 0 where nothing was read; a page whose mean or worst line is below the limit should be read again."""
    read = _line_words(words, page).groupBy(*page).agg(F.flatten(F.collect_list("_w")).alias("_w"), F.min(F.when(F.col("n") >= 2, F.col("mean"))).alias("w")).select(*page, _mean(F.col("_w")).alias("m"), "w")
    out = pages.join(read, page, "left")
    m = F.coalesce("m", F.lit(0.0))
    w = F.coalesce("w", m)
    return out.select(*page, m.alias("mean_confidence"), w.alias("worst_line"), (m < limit).alias("low"), ((m < limit) | (w < limit)).alias("escalate"))


def language(wanted: Column, installed: list[str], default: str = "eng+hin") -> Column:
    """Codes the recogniser has, joined by +; English, or the first it has, where none fits; unfiltered if what it has isn't known."""
    known = F.create_map(*(F.lit(v) for kv in LANGUAGES.items() for v in kv))
    parts = F.filter(F.transform(F.split(F.coalesce(F.nullif(wanted, F.lit("")), F.lit(default)), r"\+"), lambda p: F.trim(p)), lambda p: p != "")
    codes = F.filter(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), lambda p: F.char_length(p) >= 3)
    if not installed:
        return F.coalesce(F.nullif(F.array_join(codes, "+"), F.lit("")), F.lit(default))
    usable = F.filter(codes, lambda p: p.isin(*installed))
    return F.when(F.size(usable) > 0, F.array_join(usable, "+")).otherwise(F.lit("eng" if "eng" in installed else sorted(installed)[0]))


# Below and above what a photograph is no good.
# What is said of images, and the limits.
BLURRY, DARK, BRIGHT = "blurry - ask for a retake", "too dark - ask for a retake", "overexposed - ask for a retake"
LEAST_SHARPNESS, LEAST_BRIGHTNESS, MOST_BRIGHTNESS = 100, 60, 225


def image_quality(images: DataFrame, key: list[str]) -> DataFrame:
    """(key, sharpness, brightness, verdict) of grey images (key, width, height, pixels: rows of 0 to 255 end to end).

    Sharpness is the variance of each inner pixel's four neighbours less four times itself; an image without inner pixels
    has none and is blurry. Both figures are rounded to two places after the verdict.
    """
    w = F.col("width")
    at = lambda i: F.get("pixels", i).cast("double")
    inner = F.filter(F.sequence(w, F.size("pixels") - w - 1), lambda i: (F.pmod(i, w) > 0) & (F.pmod(i, w) < w - 1))
    none = F.array().cast("array<double>")
    edges = F.when((w > 2) & (F.col("height") > 2), F.transform(inner, lambda i: at(i - w) + at(i + w) + at(i - 1) + at(i + 1) - 4 * at(i))).otherwise(none)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    a = images.select(*key, edges.alias("_e"), F.transform("pixels", lambda x: x.cast("double")).alias("_p"))
    a = a.withColumn("_m", F.when(F.size("_e") > 0, mean(F.col("_e"))))
    a = a.withColumn("sharpness", F.coalesce(F.when(F.size("_e") > 0, mean(F.transform("_e", lambda x: (x - F.col("_m")) * (x - F.col("_m"))))), F.lit(0.0))).withColumn("brightness", F.when(F.size("_p") > 0, mean(F.col("_p"))).otherwise(0.0))
    verdict = F.when(F.col("sharpness") < LEAST_SHARPNESS, BLURRY).when(F.col("brightness") < LEAST_BRIGHTNESS, DARK).when(F.col("brightness") > MOST_BRIGHTNESS, BRIGHT).otherwise("ok")
    return a.select(*key, F.round("sharpness", 2).alias("sharpness"), F.round("brightness", 2).alias("brightness"), verdict.alias("verdict"))
