"""Documents and rule files as sources: base64 and text, ontology and condition map JSON, status."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 10 * 1024 * 1024


class OntologyError(ValueError):
    """An ontology that can't be used."""


def decode(data: Column) -> Column:
    """struct(content binary, fault): strict base64, ten MiB at most."""
    raw = F.try_to_binary(data, F.lit("base64"))
    fault = F.when(raw.isNull(), "not base64").when(F.octet_length(raw) > MOST_BYTES, "too large")
    return F.struct(F.when(fault.isNull(), raw).alias("content"), fault.alias("fault"))


def resolve(docs: DataFrame) -> DataFrame:
    """docs (text, data_base64) with source (text, bytes or missing), mean_confidence of given text and the content to recognise; blank text doesn't count as given."""
    got = decode(F.col("data_base64"))
    given = F.coalesce(F.col("text"), F.lit("")) != ""
    return docs.withColumn("_d", F.when(~given, got)).select(*docs.columns, F.when(given, "text").when(F.col("_d.content").isNotNull(), "bytes").otherwise("missing").alias("source"), F.when(given, 0.99).alias("mean_confidence"), F.col("_d.content").alias("content"), F.when(~given, F.coalesce("_d.fault", F.lit(None))).alias("fault"))


def load_ontology(spark: SparkSession, path: str) -> dict:
    """An ontology of sections and items, checked; any store that Spark reads. It is a rule file of some hundred items, used on the driver to build plans."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except Exception as e:
        raise OntologyError(f"no ontology at {path}") from e
    try:
        found = json.loads(text[0])
    except (TypeError, ValueError) as e:
        raise OntologyError("not JSON") from e
    return check_ontology(found)


def check_ontology(found: dict) -> dict:
    seen: set[str] = set()
    if not found.get("sections"):
        raise OntologyError("no sections")
    for s in found["sections"]:
        if not s.get("id"):
            raise OntologyError("a section without id")
        if "questions" not in s and "parameters" not in s:
            raise OntologyError(f"section {s['id']} has no items")
        for item in items(s, derived=True):
            if not item.get("id"):
                raise OntologyError(f"an item without id in {s['id']}")
            if item["id"] in seen:
                raise OntologyError(f"{item['id']} twice")
            seen.add(item["id"])
    return found


def items(section: dict, derived: bool = False) -> list[dict]:
    """A section's questions, or else parameters; derived ones only if asked for."""
    found = section["questions"] if "questions" in section else section.get("parameters", [])
    return [i for i in found if derived or i.get("input_type") != "derived"]


def flatten(spark: SparkSession, ontology: dict) -> DataFrame:
    """(question_id, section_id, section_order, section_no, item_order, input_type, capture_mode, follow_up, skippable) of every item that can be asked; section_no is the section's place in the file."""
    rows = []
    for no, s in enumerate(ontology["sections"]):
        for n, i in enumerate(items(s)):
            mode = i.get("capture_mode")
            if mode not in ("patient_reported", "derived", "examiner_required"):
                mode = "derived" if i.get("input_type") == "derived" else "patient_reported"
            rows.append((i["id"], s["id"], int(s.get("order", 0)), no, n, i.get("input_type"), mode, i.get("follow_up_on_yes"), bool(i.get("skippable", not i.get("required", False)))))
    return spark.createDataFrame(rows, "question_id string, section_id string, section_order int, section_no int, item_order int, input_type string, capture_mode string, follow_up string, skippable boolean")


def derived_ids(ontology: dict) -> list[str]:
    return [i["id"] for s in ontology["sections"] for i in items(s, derived=True) if i.get("input_type") == "derived"]


def rules(ontology: dict) -> list[dict]:
    """Red-flag rules, the question's own before its options'."""
    out = []
    for s in ontology["sections"]:
        for i in items(s):
            for option, flag in [(None, i.get("red_flag")), *((o["id"], o.get("red_flag")) for o in i.get("options", []))]:
                if flag:
                    out.append({"question_id": i["id"], "option": option, "when": flag.get("when"), "reason": flag["reason"], "severity": flag.get("severity", "urgent")})
    return out


def interaction_defaults(ontology: dict) -> dict:
    return ontology.get("interaction_defaults") or {"tap_timeout_seconds": 10}


def condition_map(spark: SparkSession, found: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, must_ask, conditions) of a condition map: discriminators with their weight, negatives with its negative."""
    evidence, must, conditions = [], [], []
    for n, c in enumerate(found["conditions"]):
        conditions.append((c["id"], n, c.get("urgency", "")))
        must += [(c["id"], q) for q in c.get("must_ask", [])]
        for sign, part in ((1.0, "discriminators"), (-1.0, "negative")):
            evidence += [(c["id"], d["question_id"], str(d["value"]), sign * float(d["weight"]), len(evidence) + k) for k, d in enumerate(c.get(part, []))]
    return spark.createDataFrame(evidence, "condition_id string, question_id string, value string, signed_weight double, ord int"), spark.createDataFrame(must, "condition_id string, question_id string"), spark.createDataFrame(conditions, "condition_id string, ord int, urgency string")


def uncached(docs: DataFrame, cache: DataFrame, content_col: str = "content") -> DataFrame:
    """docs with sha (SHA-256 of the content) that the cache (sha) doesn't have."""
    return docs.withColumn("sha", F.sha2(content_col, 256)).join(cache.select("sha").distinct(), "sha", "left_anti")
