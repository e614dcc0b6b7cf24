"""How well extraction reads prescriptions: precision, recall, window matches, one-to-one matching."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chartloom.functions.text import alnum_key
from chartloom.operators import similar

# The least ratio of a match and the length of a shortlist.
MATCH = 0.72
SHORTLIST = 5


def precision_recall(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """precision, recall and their harmonic mean twice from n_correct, n_extracted, n_expected, summed over `by` or all; nothing extracted or expected gives 0."""
    c, e, p = (F.sum(n).cast("double") for n in ("n_correct", "n_extracted", "n_expected"))
    sums = rows.groupBy(*(by or [])).agg(c.alias("c"), e.alias("e"), p.alias("p"))
    precision, recall = F.coalesce(F.try_divide("c", "e"), F.lit(0.0)), F.coalesce(F.try_divide("c", "p"), F.lit(0.0))
    return sums.select(*(by or []), precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def _bounds(short: np.ndarray, of: np.ndarray, hay: np.ndarray, size: int) -> np.ndarray:
    """The letters that each window of `size` letters shares with the short text, by running counts of its letters in the long one."""
    sums = np.zeros((len(hay) + 1, len(short)), np.int32)
    np.cumsum(hay[:, None] == short, axis=0, out=sums[1:])
    return np.minimum(sums[size:] - sums[:-size], of).sum(1)


def best_window(needle: str, hay: str, least: float = 0.0) -> tuple[float, int]:
    """The best ratio of the shorter text against windows of about its length in the longer, 1 if it is contained, 0 if none reaches `least`; and how many windows were aligned.

    A window's ratio is at most twice the letters it shares over both lengths, so windows are aligned from the highest bound down, until no bound is
    over the best ratio.
    """
    a, b = sorted((needle, hay), key=len)
    if not a:
        return 0.0, 0
    if a in b:
        return 1.0, 0
    letters, of = np.unique(np.frombuffer(a.encode("utf-32-le"), np.uint32), return_counts=True)
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    sizes = sorted({s for s in range(len(a) - 2, len(a) + 3) if 3 <= s <= len(b)} or {len(b)})
    bound = [2.0 * _bounds(letters, of, codes, s) / (len(a) + s) for s in sizes]
    every, at = np.concatenate(bound), np.concatenate([np.arange(len(x)) for x in bound])
    size = np.repeat(sizes, [len(x) for x in bound])
    match, best, n = SequenceMatcher(None, "", a), 0.0, 0
    seen = set()
    for i in np.argsort(-every, kind="stable"):
        if every[i] < least or every[i] <= best:
            break
        window = b[at[i] : at[i] + size[i]]
        if window not in seen:
            seen.add(window)
            match.set_seq1(window)
            best, n = max(best, match.ratio()), n + 1
    return (best if best >= least else 0.0), n


def window_ratio(needle: Column, hay: Column, least: float) -> Column:
    """best_window of two columns, each pair of a batch once."""

    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a, b):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = best_window(*pair, least)[0]
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return score(needle, hay)


def found_in(rows: DataFrame, name_col: str, text_col: str, least: float = MATCH) -> DataFrame:
    """rows with strict (the name's letters stand in the text) and fuzzy (a window is alike); only names that aren't found strictly are scored."""
    a, b = alnum_key(F.col(name_col)), alnum_key(F.col(text_col))
    rows = rows.withColumn("strict", F.contains(b, a) & (a != ""))
    easy, hard = rows.where("strict").withColumn("fuzzy", F.lit(True)), rows.where("not coalesce(strict, false)")
    return easy.unionByName(hard.withColumn("fuzzy", F.coalesce(window_ratio(a, b, least) >= least, F.lit(False))))


def one_to_one(expected: DataFrame, extracted: DataFrame, least: float = MATCH) -> DataFrame:
    """(document_id, a_no, b_no, score): pairs of a document's expected (a_no, a) and extracted (b_no, b) names, best first, each used once.

    What one document names bounds its list of pairs; a pair is taken if neither side was taken before.
    """
    pairs = expected.join(extracted, "document_id").withColumn("score", window_ratio(alnum_key(F.col("a")), alnum_key(F.col("b")), least)).where(F.col("score") >= least)
    per = pairs.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "a_no", "b_no"))).alias("p"))
    taken = lambda done, x: F.exists(done, lambda y: (y["a_no"] == x["a_no"]) | (y["b_no"] == x["b_no"]))
    best = F.aggregate("p", F.slice("p", 1, 0), lambda done, x: F.when(taken(done, x), done).otherwise(F.concat(done, F.array(x))))
    return per.select("document_id", F.explode(best).alias("m")).select("document_id", "m.a_no", "m.b_no", (-F.col("m.s")).alias("score"))


def shortlist(terms: DataFrame, names: DataFrame, n: int = SHORTLIST) -> DataFrame:
    """(term, name, score, rank_no): for each distinct term the n most alike names, by similar.shortlist."""
    return similar.shortlist(terms, names, n)


def accepted(answer: Column, listed: Column) -> Column:
    """An answer counts only if it is on the shortlist, in any case."""
    return F.array_contains(F.transform(listed, lambda x: F.lower(x)), F.lower(answer))


def recall_by(rows: DataFrame, by: str) -> DataFrame:
    """Mean of per-image recall for each value of `by`, best first."""
    return rows.groupBy(by).agg(F.avg(F.try_divide(F.col("n_correct").cast("double"), F.col("n_expected"))).alias("mean_recall")).orderBy(F.desc("mean_recall"), by)


def recalls(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """strict, fuzzy and coded over rows (strict, fuzzy, code) of expected names: shares of names found, and of those found fuzzily how many have a code. No names, or none found, give 0."""
    n = F.count(F.lit(1))
    share = lambda test, of: F.coalesce(F.try_divide(F.count_if(test).cast("double"), of), F.lit(0.0))
    found = F.coalesce(F.col("fuzzy"), F.lit(False))
    return rows.groupBy(*(by or [])).agg(n.alias("names"), share(F.coalesce(F.col("strict"), F.lit(False)), n).alias("strict"), share(found, n).alias("fuzzy"), share(found & F.col("code").isNotNull(), F.count_if(found)).alias("coded"))


def brands(rows: DataFrame, brands_col: str = "brands", key: list[str] | None = None) -> DataFrame:
    """(key, name): every brand of a column of brands parted by |, trimmed, blanks dropped, repeats kept."""
    return rows.select(*(key or []), F.explode(F.split(brands_col, r"\|")).alias("name")).withColumn("name", F.trim("name")).where("name != ''")
