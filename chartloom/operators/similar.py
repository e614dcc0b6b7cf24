"""Texts alike by Python's sequence ratio, found through an inverted index of their letters instead of from all pairs.

The ratio is twice the letters in matching blocks over both lengths, so it is at most twice the letters that both have over both lengths.
Letters numbered by their occurrence make a text a set. Two texts that reach a ratio share a number of its members, which
their lengths tell, and then share one of the rarest few of each: only texts that meet at such a member are compared.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chartloom.lineage import settle

#: Ratios at which a shortlist looks for terms that haven't got enough names yet; the last finds whatever shares a letter.
LEVELS = (0.7, 0.4, 0.0)
_EDGE = 1e-9


@F.pandas_udf(DoubleType())
def ratio_from(target: pd.Series, candidate: pd.Series, least: pd.Series) -> pd.Series:
    """Python's sequence ratio, the target first (it isn't symmetric), where it is at least `least`; pairs that its cheap upper bounds rule out aren't aligned and give null."""
    from difflib import SequenceMatcher

    out = []
    for a, b, low in zip(target, candidate, least):
        match = SequenceMatcher(None, a, b)
        out.append(match.ratio() if match.real_quick_ratio() >= low and match.quick_ratio() >= low else None)
    return pd.Series(out, dtype="float64")


def letters(text: Column) -> Column:
    """A text's letters, each with the number of equal ones before it."""
    own = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(own, lambda c, i: F.concat(c, F.size(F.filter(F.slice(own, 1, i), lambda d: d == c)).cast("string")))


def _least_shared(n: Column, least: float) -> Column:
    """How many letters a text of n shares with any text that reaches the ratio: the shortest such text shares fewest."""
    shortest = F.ceil(n * (least / (2 - least)) - _EDGE)
    return F.greatest(F.lit(1), F.ceil((n + shortest) * (least / 2) - _EDGE))


def candidates(terms: DataFrame, names: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b), distinct, of terms (by, a) and names (by, b): all pairs of equal `by` whose letters allow a ratio of `least`, or any ratio over 0 if that is 0; empty texts have none."""
    index = lambda df, c: df.where(F.char_length(c) > 0).select(*by, c).distinct().withColumn("own", letters(F.col(c)))
    a, b = index(terms, "a"), index(names, "b")
    rare = b.select(F.explode("own").alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("of"))

    def few(df: DataFrame, c: str) -> DataFrame:
        n = F.char_length(c)
        ranked = df.select(*by, c, F.explode("own").alias("letter")).join(rare, "letter", "left")
        # a join on letters regroups the texts; what they meet by are their first, the rarest, of a common order
        held = ranked.groupBy(*by, c).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("of", F.lit(0)).alias("of"), "letter"))).alias("own"))
        return held.select(*by, c, F.explode(F.slice("own", 1, (n - _least_shared(n, least) + 1).cast("int"))).alias("m")).select(*by, c, "m.letter")

    met = few(a, "a").join(few(b, "b"), [*by, "letter"])
    n, m = F.char_length("a"), F.char_length("b")
    met = met.where((2 * F.least(n, m) >= least * (n + m) - _EDGE)).select(*by, "a", "b").distinct()
    shared = F.size(F.array_intersect(letters(F.col("a")), letters(F.col("b"))))
    return met.where(2 * shared >= least * (n + m) - _EDGE)


def shortlist(terms: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """(term, name, score, rank_no): for each distinct term the n names most alike in lower case, ties by name; fewer only where there are fewer names. Null terms and names aren't any.

    A term that n names reach a ratio with is done at that level; the others go on to a lower one, and only what is alike to hardly any
    name is compared with all that shares a letter. Names without a common letter score 0 and fill up in their order.
    """
    every = settle(names.where("name is not null").select("name").distinct().withColumn("b", F.lower("name")))
    left = settle(terms.where("term is not null").select("term").distinct().withColumn("a", F.lower("term")))
    best = Window.partitionBy("term").orderBy(F.desc("score"), "name")
    out = None
    for least in LEVELS:
        met = candidates(left, every, least)
        scored = met.withColumn("score", ratio_from("a", "b", F.lit(least))).where((F.col("score") >= least) & (F.col("score") > 0))
        rows = scored.join(every, "b").join(left, "a").select("term", "name", "score")
        ranked = settle(rows.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= n))
        if least == 0:
            first = [r.name for r in every.orderBy("name").limit(n).collect()]  # n rows
            none = left.select("term", F.explode(F.array(*map(F.lit, first)).cast("array<string>")).alias("name")).join(ranked, ["term", "name"], "left_anti").withColumn("score", F.when((F.col("term") == "") & (F.col("name") == ""), 1.0).otherwise(0.0))
            found = ranked.select("term", "name", "score").unionByName(none).withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= n)
            out = found if out is None else out.unionByName(found)
            break
        full = ranked.where(F.col("rank_no") == n).select("term")
        done = ranked.join(full, "term", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = settle(left.join(full, "term", "left_anti"))
        if left.isEmpty():
            break
    return out.select("term", "name", "score", "rank_no")
