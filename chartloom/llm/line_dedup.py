"""Line dedup across documents by a deletion-neighbourhood join. Column functions only.

A line counts as a copy of an earlier line if at most one character edit (insertion, deletion, substitution) parts
them. Every line emits what is left after deleting any one character, as hashed keys; two lines within one edit share
such a key (equal lengths: deleted at the same place; lengths one apart: the shorter line itself), the edit distance of
those that share one is verified, and the earliest line stays.

Emitting every deletion of every line would multiply the corpus by its line length. Of two lines within one edit, the
first k or the last k characters agree if neither part is over half the shorter line, so each distinct line first gives
the hashes of these ends. k depends on a band of lengths; the shortest lines of a band give the ends of the band below
too, as they may be one character longer than lines there. Only lines that share an end with another line go
on, cut the part where the edit must be into pieces and hash what is around each piece; only pieces whose surroundings
agree with another line's emit deletions. This loses no link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm.runtime import cut, sized_broadcast, spare, table

#: Shorter lines (in characters, normalised) match exactly only: one edit would change too much of them.
MIN_CHARS = 20
#: Deletions are hashed inside pieces of this many characters, so that long lines cost in proportion to their length.
PIECE = 32
#: Bands of line lengths grow by this factor.
BAND = 1.25
_FEW = 200_000
_NO_ID = -(1 << 63)


def normalised(line: Column) -> Column:
    """Lower case, no white space at the ends."""
    return F.btrim(F.lower(line), F.lit(" \t\x0b\x0c\r"))


def _place(docs_id: str, text: str) -> Column:
    """A row's id as a long; rows without one come before all, by a hash of their text, so that they aren't one place."""
    return F.coalesce(F.col(f"`{docs_id}`").cast("long"), F.shiftrightunsigned(F.xxhash64(F.col(f"`{text}`")), 2) + F.lit(_NO_ID))


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, i, x, h, g): place, line number, normalised line with a word, two hashes of it."""
    rows = docs.select(_place(id_col, text_col).alias("d"), F.posexplode(F.split(text_col, "\n")).alias("i", "x")).withColumn("x", normalised(F.col("x"))).where("x != ''")
    h, g = _hashes(F.col("x"))
    return rows.withColumns({"h": h, "g": g})


def _band(n: Column, min_chars: int) -> tuple[Column, Column]:
    """The number of a length's band (0 from min_chars on) and the shortest length in it, rounded up."""
    j = F.floor(F.log(BAND, n.cast("double") / min_chars) + 1e-9).cast("int")
    return j, F.ceil(min_chars * F.pow(F.lit(BAND), j) - 1e-6).cast("int")


def _ends(lines: DataFrame, min_chars: int) -> DataFrame:
    """lines with p0, s0, p1, s1: hashes of the first and last k characters by the own band, and by the band below where one length apart; null for short lines."""
    n = F.char_length("x")
    band, least = _band(F.col("n"), min_chars)
    out = lines.withColumn("n", n).withColumn("band", F.when(F.col("n") >= min_chars, band)).withColumn("least", F.when(F.col("n") >= min_chars, least))
    new = {}
    for i in (0, 1):
        k = F.floor(_least(F.col("band") - i, min_chars) / 2).cast("int")
        fits = (F.col("n") >= min_chars) if i == 0 else ((F.col("n") == F.col("least")) & (F.col("band") > 0))
        new[f"p{i}"] = F.when(fits, F.xxhash64(F.lit("p"), F.col("band") - i, F.substring("x", F.lit(1), k)))
        new[f"s{i}"] = F.when(fits, F.xxhash64(F.lit("s"), F.col("band") - i, F.right("x", k)))
    return out.withColumns(new)


def _least(band: Column, min_chars: int) -> Column:
    return F.ceil(min_chars * F.pow(F.lit(BAND), band) - 1e-6).cast("int")


def _pieces(lines: DataFrame, min_chars: int) -> DataFrame:
    """(rest, piece, same, d, i, h, g) of lines (x, codes, d, i, h, g): pieces where an edit may be, and a hash of all around them.

    Lines within one edit agree in the hash around the piece that has the edit. Code 0 and 1: the own band's first and last end is shared; 2 and 3: those of the band below, by the longer line.
    """
    band, _ = _band(F.col("n"), min_chars)
    below = F.floor(F.col("code") / 2).cast("int")
    a = lines.select("x", "d", "i", "h", "g", F.char_length("x").alias("n"), F.explode("codes").alias("code"))
    a = a.withColumn("k", F.floor(_least(band - below, min_chars) / 2).cast("int"))
    a = a.withColumn("m", F.explode(F.when(F.col("code") < 2, F.array("n", F.col("n") - 1)).otherwise(F.array(F.col("n") - 1)))).where("m >= 2 * k")
    first = F.col("code") % 2 == 0  # the first end is shared: the edit is behind it
    a = a.withColumn("from", F.when(first, F.col("k")).otherwise(0)).withColumn("to", F.when(first, F.col("m")).otherwise(F.col("m") - F.col("k")))
    a = a.withColumn("at", F.explode(F.sequence("from", F.col("to") - 1, F.lit(PIECE)))).withColumn("end", F.least(F.col("at") + PIECE, "to"))
    piece = F.substring("x", F.col("at") + 1, F.col("end") - F.col("at") + F.col("n") - F.col("m"))
    return a.select("d", "i", "h", "g", (F.col("n") == F.col("m")).alias("same"), piece.alias("piece"), F.xxhash64("m", "at", "end", F.substring("x", F.lit(1), F.col("at")), F.right("x", F.col("m") - F.col("end"))).alias("rest"))


def _deletions(a: DataFrame) -> DataFrame:
    """(key, kind, whole, d, i, h, g) of pieces: the keys that lines within one edit share."""
    left = lambda i: F.concat(F.substring("piece", F.lit(1), i - 1), F.substring("piece", i + 1, F.char_length("piece")))
    places = F.sequence(F.lit(1), F.char_length("piece"))
    key = lambda kind, *of: F.struct(F.xxhash64(F.lit(kind), F.col("rest"), *of).alias("key"), F.lit(kind).alias("kind"))
    swaps = F.transform(places, lambda i: F.struct(key("s", i, left(i)).alias("v"), F.lit(False).alias("whole")))
    drops = F.transform(places, lambda i: F.struct(key("d", left(i)).alias("v"), F.lit(False).alias("whole")))
    itself = F.array(F.struct(key("d", F.col("piece")).alias("v"), F.lit(True).alias("whole")))
    return a.select("d", "i", "h", "g", F.explode(F.when(F.col("same"), F.concat(swaps, itself)).otherwise(drops)).alias("e")).select("e.v.key", "e.v.kind", "e.whole", "d", "i", "h", "g")


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, kept): for each document id, the hashes of the lines that stay there, where there are any."""
    lines = _lines(docs, id_col, text_col)
    ends = ["p0", "s0", "p1", "s1"]
    first = cut(_ends(lines, min_chars).groupBy("h", "g").agg(F.min("d").alias("d"), *(F.first(e).alias(e) for e in ends)))
    given = first.select("h", "g", "d", F.explode(F.filter(F.array(*(F.struct(F.col(e).alias("k"), F.lit(i).alias("code")) for i, e in enumerate(ends))), lambda e: e["k"].isNotNull())).alias("e")).select("h", "g", "d", "e.k", "e.code")
    shared = given.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("k")
    near = cut(given.join(shared, "k").groupBy("h", "g").agg(F.min("d").alias("d"), F.collect_set("code").alias("codes")))
    few = sized_broadcast(near, near.count(), _FEW)
    near = cut(lines.join(few, ["h", "g", "d"]).groupBy("h", "g", "d").agg(F.min("i").alias("i"), F.first("x").alias("x"), F.first("codes").alias("codes")))

    pieces = _pieces(near, min_chars)
    agree = pieces.groupBy("rest").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("rest")
    by_key, me = Window.partitionBy("key", "kind"), F.struct("d", "i", "h", "g")
    partner = F.when(F.col("kind") == "s", F.min(me).over(by_key)).when(F.col("whole"), F.min(F.when(~F.col("whole"), me)).over(by_key)).otherwise(F.min(F.when(F.col("whole"), me)).over(by_key))
    pairs = _deletions(pieces.join(agree, "rest")).select("h", "g", partner.alias("o"), me.alias("own")).where("o < own").select("h", "g", F.col("o.h").alias("oh"), F.col("o.g").alias("og")).distinct()
    text, other = near.select("h", "g", "x"), near.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("x").alias("y"))
    copies = pairs.join(text, ["h", "g"]).join(other, ["oh", "og"]).where(F.levenshtein("x", "y", 1) >= 0).select("h", "g").distinct()
    return first.select("h", "g", "d").join(copies, ["h", "g"], "left_anti").groupBy("d").agg(F.collect_list("h").alias("kept"))


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the column _removed: the numbers (from 0, ascending) of the lines that copy an earlier line.

    Lines split at \\n and compare normalised. Of equal lines the one in the document of the smallest id stays (null
    before all, by a hash of the text), the first of them there; of different lines within one edit those go of which
    another is earlier, by document id and line number, whether or not that one stays itself. Lines of fewer than min_chars
    characters are copies only of equal lines. Lines without a word are never copies. Null and empty texts have no lines to
    remove. Rows of one id are one place, and so are those of no id and equal text: each keeps what that place keeps. An
    empty table gives no rows; other columns pass through. Ids must be integers.
    """
    place, kept, said, both_, own = spare(docs, "_d", "_kept", "_said", "_both", "_own")
    of = kept_lines(docs, id_col, text_col, min_chars).withColumnsRenamed({"d": place, "kept": kept})
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(F.when(normalised(x) != "", F.xxhash64(normalised(x))).alias("h"), i.alias("i"))), lambda s: s["h"].isNotNull())
    # a kept hash, numbered -1, sorts right before the line that stays
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    # the place is a column before the join, so that a text that nobody wants isn't shuffled for it
    out = docs.withColumns({said: F.coalesce(lines, none), own: _place(id_col, text_col)}).join(of, F.col(own) == F.col(place), "left")
    both = F.sort_array(F.concat(said, F.coalesce(F.transform(kept, lambda h: F.struct(h.alias("h"), F.lit(-1).alias("i"))), none)))
    out = out.withColumn(both_, both)
    stays = lambda a, b: (b["i"] < 0) & (a["h"] == b["h"])
    gone = F.zip_with(both_, F.slice(F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), both_), 1, F.size(both_)), lambda a, b: F.when((a["i"] >= 0) & ~F.coalesce(stays(a, b), F.lit(False)), a["i"]))
    removed = F.sort_array(F.filter(gone, lambda i: i.isNotNull()))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != "_removed"), removed.alias("_removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs whose texts lack the lines that mark_lines names; n_chars, if there, is counted anew. No document goes."""
    marked = mark_lines(docs, id_col, text_col, min_chars)
    rest = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_removed", i)), "\n")
    out = marked.withColumn(text_col, F.when(F.size("_removed") > 0, rest).otherwise(F.col(f"`{text_col}`")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with how many lines they have, and how many and which of them copy an earlier one; nulls, ties, repeated rows and empty tables as in mark_lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return mark_lines(docs.withColumn("n_lines", lines.cast("long"))).select("doc_id", "n_lines", F.size("_removed").cast("long").alias("n_removed"), F.array_join("_removed", ",").alias("removed_lines"))


ORACLE_SQL = rf"""
WITH line AS (
  SELECT doc_id, i, regexp_replace(lower(x[i]), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)
), worded AS (
  SELECT doc_id, i - 1 AS i, s FROM line WHERE s <> ''
), first AS (
  SELECT s, min(row(doc_id, i)) AS p, length(s) AS n FROM worded GROUP BY s
), a AS (
  SELECT s, p, n, n // 2 AS half FROM first WHERE n >= {MIN_CHARS}
), pair AS (
  SELECT a.s AS s1, a.p AS p1, b.s AS s2, b.p AS p2, a.n FROM a JOIN a AS b ON b.n = a.n AND left(a.s, a.half) = left(b.s, a.half) AND a.s <> b.s
  UNION ALL SELECT a.s, a.p, b.s, b.p, a.n FROM a JOIN a AS b ON b.n = a.n AND right(a.s, a.n - a.half) = right(b.s, a.n - a.half) AND a.s <> b.s
  UNION ALL SELECT a.s, a.p, b.s, b.p, a.n FROM a JOIN a AS b ON b.n = a.n + 1 AND left(a.s, a.half) = left(b.s, a.half)
  UNION ALL SELECT a.s, a.p, b.s, b.p, a.n FROM a JOIN a AS b ON b.n = a.n + 1 AND right(a.s, a.n - a.half) = right(b.s, a.n - a.half)
), near AS (
  SELECT * FROM pair WHERE length(list_filter(range(1, n + 2), lambda k: left(s1, k - 1) = left(s2, k - 1)
    AND CASE WHEN length(s2) = n THEN substr(s1, k + 1) ELSE substr(s1, k) END = substr(s2, k + 1))) > 0
), gone AS (
  SELECT s2 AS s FROM near WHERE p1 < p2 UNION SELECT s1 FROM near WHERE p2 < p1
), removed AS (
  SELECT w.doc_id, w.i FROM worded AS w JOIN first USING (s) LEFT JOIN gone USING (s) WHERE row(w.doc_id, w.i) <> p OR gone.s IS NOT NULL
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS r FROM removed GROUP BY doc_id
)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(r, '') AS removed_lines
FROM documents LEFT JOIN listed USING (doc_id)
"""
