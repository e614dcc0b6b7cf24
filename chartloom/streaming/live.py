"""What running interviews hold, read from the stream's own state: answers by session, what is asked next, what examiners owe.

Spark's state data source reads the store of a query's checkpoint as a table, partition by partition, while the query runs or
between its runs; nothing is replayed. A session that was never heard has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import interview
from chartloom.sources import scan
from chartloom.streaming.interview import state_store

ANSWERS = "answers"


def answers(spark: SparkSession, checkpoint: str, batch: int | None = None, operator: int = 0) -> DataFrame:
    """(session_id, question_id, value): the answers that a query over interview.states holds, as of its last committed micro-batch or that of number `batch`."""
    with state_store(spark):
        reader = spark.read.format("statestore").option("stateVarName", ANSWERS).option("operatorId", operator)
        if batch is not None:
            reader = reader.option("batchId", batch)
        rows = reader.load(checkpoint)
    return rows.select(F.col("key.session_id").alias("session_id"), F.col("user_map_key.question_id").alias("question_id"), F.col("user_map_value.v").alias("value"))


def read(held: DataFrame, ontology: dict, conditions: dict | None = None, mode: str = "allopathic") -> DataFrame:
    """(session_id, next_question, completed, n_answered, answers, unanswered, pending_examiner) of sessions' answers (session_id, question_id, value).

    What is asked next is the first of the unanswered questions by order or, with a condition map, by rank. pending_examiner are the
    fields that an examiner has to fill in, in an ayush interview. All of it is columns over the state; sessions are independent.
    """
    spark = held.sparkSession
    session = ["session_id"]
    sections = {s["id"]: s for s in ontology["sections"]}
    flat = scan.flatten(spark, ontology)
    told = held.withColumn("multi", F.lit(None).cast("array<string>"))
    seq = interview.sequence(flat, told, session, sections, mode)
    waits = interview.unanswered(seq).select(*session, "question_id", "q_ord")
    if conditions is None:
        ranked = waits.join(waits.groupBy(*session).agg(F.min("q_ord").alias("_first")), session).where("q_ord = _first").select(*session, "question_id", F.lit(1).alias("rank_no"))
    else:
        evidence, must, known = scan.condition_map(spark, conditions)
        live = interview.plausibility(told, evidence, known, session).where("plausibility > 0").join(known.select("condition_id", "ord"), "condition_id")
        scored = interview.question_scores(live, waits.select(*session, "question_id"), evidence, must, session).withColumn("score", F.round("score", 9))
        ranked = interview.rank_questions(scored.join(waits, [*session, "question_id"]), live, must, known, session)
    pending = [i["id"] for s in ontology["sections"] if mode == "ayush" and s.get("mode") == "ayush" for i in scan.items(s) if i.get("capture_mode") == "examiner_required"]
    per = held.groupBy(*session).agg(F.count_distinct("question_id").alias("n_answered"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("question_id", "value")))).alias("answers"))
    left = waits.groupBy(*session).agg(F.transform(F.array_sort(F.collect_list(F.struct("q_ord", "question_id"))), lambda x: x["question_id"]).alias("unanswered"))
    out = interview.next_question(ranked, per.join(left, session, "left"), session)
    none = F.array().cast("array<string>")
    return out.select(*session, "next_question", "completed", "n_answered", "answers", F.coalesce("unanswered", none).alias("unanswered"), (F.array(*map(F.lit, pending)) if pending else none).alias("pending_examiner"))
