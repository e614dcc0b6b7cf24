"""From a session's documents to its bundle: the whole batch path, each step an operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions import dates, dosing, text
from chartloom.operators import abnormal, coding, extract, timeline
from chartloom.lineage import keep

DOSES = "array<struct<drug:string,doses:array<string>>>"


@dataclass
class Bundle:
    """What a set of sessions has, as DataFrames keyed by session."""

    documents: DataFrame
    entities: DataFrame
    timeline: DataFrame
    unreadable: DataFrame
    interactions: DataFrame
    abnormal: DataFrame
    notes: DataFrame


def entity_keys(coded: DataFrame, drug_alias: DataFrame) -> DataFrame:
    """(session, document_id, keys, doses): what two documents are compared by: drugs by generic name, the rest by text."""
    key = ["session", "document_id", "entity_no"]
    drugs = coding.primary_drug(coded.where("kind = 'medication'"), key, "text", drug_alias)
    named = coded.join(drugs, key, "left").withColumn("k", text.entity_chars(F.when(F.col("kind") == "medication", F.coalesce("generic", "drug_name", "text")).otherwise(F.col("text")))).where("k != ''")
    named = named.withColumn("dose", F.when(F.col("kind") == "medication", dosing.dose_key(F.col("text"))))
    per = named.groupBy("session", "document_id", "k").agg(F.min("entity_no").alias("e"), F.array_sort(F.collect_set("dose")).alias("doses"))
    return per.groupBy("session", "document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("e", "k"))), lambda x: x["k"]).alias("keys"), F.collect_list(F.when(F.size("doses") > 0, F.struct(F.col("k").alias("drug"), "doses"))).cast(DOSES).alias("doses"))


def build(docs: DataFrame, lab_alias: DataFrame, drug_alias: DataFrame, condition_alias: DataFrame, interaction: DataFrame, today: str, curated: DataFrame | None = None) -> Bundle:
    """docs: (session, document_id, doc_no, text, mean_confidence, hint); `today` bounds dates and is never the clock's.

    Documents under 0.30 confidence or without entities are set apart; the others are dated, folded and ordered. Drugs
    of all readable documents are checked together. curated: (row_no, key, code, range, unit), if there is one.
    """
    key = ["session", "document_id"]
    pages = docs.withColumn("text", text.normalize_text(F.col("text")))
    found = keep(extract.entities(pages.select(*key, "text", "mean_confidence"), key))
    shaped = extract.structure(pages, found, key)
    dated = dates.clinical_date(docs.select(*key, "doc_no", "text", F.col("mean_confidence").alias("ocr")), key, today, "ocr").drop("text")
    whole = keep(dated.join(shaped.drop("mean_confidence"), key).withColumnRenamed("ocr", "mean_confidence"))
    readable, unreadable = timeline.split_readable(whole)
    coded = keep(coding.code_entities(found, lab_alias, drug_alias, condition_alias).join(readable.select(*key), key))
    sure = coded.groupBy(*key).agg(F.avg("confidence").alias("confidence"))
    entries = readable.join(sure, key, "left").join(entity_keys(coded, drug_alias), key, "left").select("session", F.col("doc_no").cast("long").alias("seq"), "document_id", F.col("suggested_type").alias("kind"), F.col("clinical_date").alias("date"), F.col("suggested_title").alias("title"), "facility", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), F.coalesce("doses", F.array().cast(DOSES)).alias("doses"))
    kept = keep(timeline.fold_duplicates(entries))
    names = coding.primary_drug(coded.where("kind = 'medication'"), [*key, "entity_no"], "text", drug_alias).join(readable.select(*key, "doc_no"), key)
    drugs = names.select("session", F.struct(F.col("doc_no").cast("long").alias("doc_no"), "entity_no").alias("pos"), F.col("drug_name").alias("drug"))
    labs = coded.where("kind = 'lab'")
    labs = abnormal.with_curated(labs, curated) if curated is not None else labs.withColumns({"curated_range": F.lit(None).cast("string"), "curated_unit": F.lit(None).cast("string")})
    return Bundle(whole, coded, timeline.order(kept, ["session"]), unreadable.select(*key), coding.interactions(drugs, ["session"], drug_alias, interaction), abnormal.flags(abnormal.judge(labs)), timeline.merge_notes(kept))


def ingest(docs: DataFrame, today: str) -> DataFrame:
    """One entry a document, not joined with others: (session, document_id, date, date_confidence, kind, title, facility, n_entities, mean_confidence).

    Unlike in `build`, the date is the extraction's best one, as sure as the document was read; only without one the
    labelled dates are weighed. docs as for build.
    """
    key = ["session", "document_id"]
    pages = keep(docs.withColumn("text", text.normalize_text(F.col("text"))))
    shaped = extract.structure(pages, extract.entities(pages.select(*key, "text", "mean_confidence"), key), key)
    best = dates.best_date(pages.select(*key, "text"), key).select(*key, F.col("value").alias("_best"))
    weighed = dates.clinical_date(pages.select(*key, "text", F.col("mean_confidence").alias("ocr")), key, today, "ocr").select(*key, "clinical_date", "date_confidence")
    both = shaped.join(best, key, "left").join(weighed, key, "left")
    sure = F.when(F.col("_best").isNotNull(), F.col("mean_confidence")).otherwise(F.coalesce("date_confidence", F.lit(0.0)))
    return both.select(*key, F.coalesce("_best", "clinical_date").alias("date"), sure.alias("date_confidence"), F.col("suggested_type").alias("kind"), F.col("suggested_title").alias("title"), "facility", "n_entities", "mean_confidence")
