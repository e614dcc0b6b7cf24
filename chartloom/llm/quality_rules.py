"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much go too. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.runtime import WORD, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document that loses over this share of its word characters with its failing lines is rejected.
MAX_LOST_PERCENT = 50

# Characters and phrases of the line rules.
SYMBOLS = r"[#*$%&|<>]"
SHOUTS = r"[#*$%&<>~^=_{}\\]|!{2,}|\?{2,}"
SEPARATORS = r"[|>»«•·→]"
NAVIGATION = r"(?i)^\s*(home|menu|main menu|next|previous|prev|back|back to top|log ?in|log ?out|sign ?in|sign ?up|register|search|share|print|contact( us)?|about( us)?|site ?map|skip to content|read more|load more|more)\s*[.!:]?\s*$"
BOILERPLATE = r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|accept cookies|click here|subscribe to our|newsletter|enable javascript|javascript is (disabled|required)|powered by|licensed under the|is licensed under)"


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails a rule.

    Punctuation: two or more symbols or runs of ! or ?, and over one for every two words. Navigation: two or more
    separators, and three or more for every ten words; or nothing but a menu entry. Boilerplate: a stock phrase.
    """
    words = F.regexp_count(line, F.lit(WORD))
    shouts, bars = F.regexp_count(line, F.lit(SHOUTS)), F.regexp_count(line, F.lit(SEPARATORS))
    return ((shouts >= 2) & (2 * shouts > words)) | ((bars >= 2) & (10 * bars >= 3 * words)) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


def repeat_words(hashes: Column, n: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows that occur twice or more, from the words' hashes.

    Window hashes double in width until they span `window` words (a power of two). Most texts repeat no window, which
    one hash set shows; only others sort their windows.
    """
    h, width = hashes, 1
    while width < window:
        h = F.zip_with(h, F.slice(h, width + 1, n), lambda a, b: F.xxhash64(a, b))
        width *= 2
    return F.slice(h, 1, F.greatest(n - (window - 1), F.lit(0)))


def _covered(windows: Column, window: int) -> Column:
    """Words that the repeated windows cover, each once."""
    size = F.size(windows)
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    after = F.zip_with(ordered, F.slice(ordered, 2, size), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    before = F.slice(F.concat(F.array(F.lit(False)), after), 1, size)
    seen = F.zip_with(ordered, F.zip_with(after, before, lambda a, b: a | b), lambda o, f: F.when(f, o["i"]))
    at = F.sort_array(F.filter(seen, lambda i: i.isNotNull()))
    return F.aggregate(F.zip_with(at, F.slice(at, 2, size), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window)))), F.lit(0), lambda s, x: s + x)


def rules(docs: DataFrame, text_col: str = "text", clean_col: str = "_clean", prefix: str = "", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept
    (boolean), each under `prefix`, and clean_col: the text without its failing lines.

    A null text has no words or lines: its figures are 0, it fails and its clean text is null; an empty or blank one
    fails too. Lines without a word never fail and stay. Rows are judged one by one, so ties, repeated rows and null or
    repeated ids change nothing, and docs' other columns pass through; columns of docs with the names of new ones are
    replaced. An empty table gives no rows.
    """
    new = [prefix + n for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")] + [clean_col]
    others = [c for c in docs.columns if c not in new or c == text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(others)]
    olds = [f"_o{i}" for i in range(len(others))]
    own = f"_o{others.index(text_col)}"
    a = docs.select(*keep, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"), F.split(text, "\n").alias("_lines"), F.regexp_count(text, F.lit(SYMBOLS)).alias("_symbols"))
    a = a.select(*olds, "_symbols", F.size("_words").alias("_n"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"), F.aggregate("_words", F.lit(0), lambda s, w: s + F.char_length(w)).alias("_chars"), F.transform("_lines", lambda x: F.struct(x.alias("line"), x.rlike(WORD).alias("has"), line_fails(x).alias("bad"))).alias("_lines"))
    a = a.select(*olds, "_symbols", "_n", "_chars", "_lines", repeat_words(F.col("_h"), F.col("_n")).alias("_w"))
    said = F.transform(F.filter("_lines", lambda x: x["has"]), lambda x: x["line"])
    bad = F.filter("_lines", lambda x: x["has"] & x["bad"])
    a = a.select(*olds, "_symbols", "_n", "_chars", "_w", said.alias("_said"), F.size(F.array_distinct("_w")).alias("_different"), F.aggregate(bad, F.lit(0), lambda s, x: s + F.char_length(F.regexp_replace(x["line"], r"[\x20\x09-\x0D]+", ""))).alias("_lost"), F.when(F.size(bad) > 0, F.array_join(F.transform(F.filter("_lines", lambda x: ~(x["has"] & x["bad"])), lambda x: x["line"]), "\n")).otherwise(F.col(own)).alias("_clean_text"))
    a = a.select(*olds, "_symbols", "_n", "_chars", "_lost", "_clean_text", (F.size("_said") - F.size(F.array_distinct("_said"))).alias("_dup"), F.when(F.col("_different") < F.size("_w"), _covered(F.col("_w"), WINDOW)).otherwise(0).alias("_rep"))
    failed = (F.col("_n") < min_words) | (100 * F.col("_rep").cast("long") > max_repeat * F.col("_n").cast("long"))
    verdict = 100 * F.col("_lost").cast("long") <= max_lost * F.col("_chars").cast("long")
    figures = [F.col(c).cast("long").alias(prefix + n) for c, n in (("_n", "n_words"), ("_chars", "word_chars"), ("_symbols", "n_symbols"), ("_dup", "n_dup_lines"), ("_rep", "n_repeat_words"))]
    return a.select(*(F.col(o).alias(c) for o, c in zip(olds, others)), *figures, failed.alias(prefix + "base_failed"), (~failed & verdict).alias(prefix + "kept"), F.col("_clean_text").alias(clean_col))


def clean(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The documents that pass, without their failing lines; n_chars, if there, is counted anew.

    Null, empty and blank texts have under the least words and go. Rows are judged one by one: repeated ones and null ids
    change nothing. Columns pass through in their order, whatever their names (but for _q_*); an empty table gives no rows.
    """
    out = rules(docs, text_col, "_q_clean", "_q_", **limits)
    # a filter would be pushed below and work the rules out again; a generator isn't
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.explode(F.when(F.col("_q_kept"), F.array("_q_clean"))).alias(text_col))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their figures and verdicts; nulls, empty texts, repeated rows and empty tables as in rules."""
    return rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS g
  FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY doc_id
), line AS (
  SELECT doc_id, x, len(regexp_extract_all(x, '{WORD}')) AS n, len(regexp_extract_all(x, '{_sql(SHOUTS)}')) AS shouts,
         len(regexp_extract_all(x, '{_sql(SEPARATORS)}')) AS bars, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w)
), judged AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup, coalesce(sum(chars) FILTER (WHERE (shouts >= 2 AND 2 * shouts > n) OR (bars >= 2 AND 10 * bars >= 3 * n)
         OR regexp_matches(x, '{_sql(NAVIGATION)}') OR regexp_matches(x, '{_sql(BOILERPLATE)}')), 0) AS lost
  FROM line WHERE n > 0 GROUP BY doc_id
), f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN judged USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM f
"""
