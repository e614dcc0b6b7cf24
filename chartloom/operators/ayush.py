"""Constitution from questionnaire answers, and what of an examination is still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The doshas in their order, the items, the margins.
DOSHAS = ("vata", "pitta", "kapha")
ITEMS = ("pa.build", "pa.skin", "pa.appetite", "pa.digestion", "pa.sleep", "pa.temperament", "pa.weather", "pa.energy")
LEAST_ANSWERED = 6
DUAL_MARGIN = 1


def prakriti(answers: DataFrame, session: list[str], items: tuple = ITEMS) -> DataFrame:
    """(session, vata, pitta, kapha, items_answered, dual, dominant): counts of the answers; dominant is null under six answered items (an answer that names no dosha counts as answered). answers has one row a question."""
    of = answers.where(F.col("question_id").isin(*items))
    per = of.groupBy(*session).agg(*(F.count_if(F.col("value") == d).alias(d) for d in DOSHAS), F.count(F.lit(1)).alias("items_answered"))
    ranked = F.array_sort(F.array(*(F.struct((-F.col(d)).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DOSHAS))))
    dual = (F.col("r")[1]["n"] - F.col("r")[0]["n"]) <= DUAL_MARGIN
    name = F.when(F.col("items_answered") >= LEAST_ANSWERED, F.when(dual, F.concat(F.col("r")[0]["d"], F.lit("-"), F.col("r")[1]["d"])).otherwise(F.col("r")[0]["d"]))
    return per.withColumn("r", ranked).select(*session, *DOSHAS, "items_answered", dual.alias("dual"), name.alias("dominant"))


def missing_parameters(sessions: DataFrame, answers: DataFrame, parameters: DataFrame, session: list[str]) -> DataFrame:
    """(session, missing, n_missing, complete) for parameters (parameter, ord, capture_mode, question_id or null): those that patients report and that have no question or no answer. Others never count."""
    # an examination has some ten parameters: one row, beside what each session has answered
    want = parameters.where("capture_mode = 'patient_reported'").agg(F.array_sort(F.collect_list(F.struct("ord", "parameter", "question_id"))).alias("_want"))
    given = answers.groupBy(*session).agg(F.collect_set("question_id").alias("_given"))
    absent = F.filter("_want", lambda p: p["question_id"].isNull() | ~F.coalesce(F.array_contains("_given", p["question_id"]), F.lit(False)))
    out = sessions.join(given, session, "left").crossJoin(F.broadcast(want)).withColumn("missing", F.transform(absent, lambda p: p["parameter"]))
    return out.select(*session, "missing", F.size("missing").cast("long").alias("n_missing"), (F.size("missing") == 0).alias("complete"))


def status(sessions: DataFrame, parameters: DataFrame, session: list[str]) -> DataFrame:
    """Parameters by how they come, as three lists; always provisional."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("capture_mode") == m, F.struct("ord", "parameter")))), lambda x: x["parameter"]).alias(n) for m, n in (("derived", "derived"), ("examiner_required", "pending_examiner"), ("patient_reported", "patient_reported"))]
    return sessions.crossJoin(F.broadcast(parameters.agg(*lists))).withColumn("provisional", F.lit(True))


def derive(sessions: DataFrame, answers: DataFrame, parameters: DataFrame, session: list[str]) -> DataFrame:
    """(session, prakriti, missing, not_derived, complete): a finished interview's row.

    prakriti is the constitution's struct, null without an answer to it; derived parameters other than it are named as not
    derived, sorted, and prakriti itself too where nothing was answered.
    """
    made = prakriti(answers, session)
    made = made.select(*session, F.struct(*(c for c in made.columns if c not in session)).alias("prakriti"))
    derived = parameters.where("capture_mode = 'derived'").agg(F.array_sort(F.collect_set("parameter")).alias("_derived"))
    out = missing_parameters(sessions, answers, parameters, session).join(made, session, "left").crossJoin(F.broadcast(derived))  # one row
    left = F.filter("_derived", lambda p: ~((p == "prakriti") & F.col("prakriti").isNotNull()))
    return out.select(*session, "prakriti", "missing", left.alias("not_derived"), "complete")
