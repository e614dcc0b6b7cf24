"""Queries over session operators: recogniser words, timeline, resources, interview, summary, accuracy."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from chartloom.functions.text import lookup_key
from chartloom.lineage import scratch
from chartloom.operators import ayush, coding, dialogue, fhir, interview, metrics, ocr, rules, summary, timeline
from chartloom.plans.inputs import ALIAS, DOC, DRUGS, HIGH, LOW, QTY, cte, for_spark, make, pick, tables, values
from chartloom.sources import cache, dims, scan

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Words of pages.
_TOKENS = f"{cte('words')}, token AS (SELECT page, word_no, block, par, line, trim(text) AS text, round(conf / 100, 4) AS confidence FROM words WHERE trim(text) <> '' AND conf >= 0)"
_LINES = f"{_TOKENS}, mark AS (SELECT *, CASE WHEN lag(row(block, par, line)) OVER w = row(block, par, line) THEN 0 ELSE 1 END AS brk FROM token WINDOW w AS (PARTITION BY page ORDER BY word_no)), ln AS (SELECT *, sum(brk) OVER (PARTITION BY page ORDER BY word_no) AS line_no FROM mark), line_text AS (SELECT page, line_no, string_agg(text, ' ' ORDER BY word_no) AS text FROM ln GROUP BY 1, 2)"


@query(f"WITH {_TOKENS} SELECT page, word_no::BIGINT AS word_no, text, confidence FROM token")
def ocr_tokens(spark, sf_dir):
    return ocr.tokens(make(spark, sf_dir, "words")).select("page", F.col("word_no").cast("long").alias("word_no"), "text", "confidence")


@query(f"WITH {_LINES} SELECT page, count(*) AS n_lines, md5(string_agg(text, chr(10) ORDER BY line_no)) AS text_md5 FROM line_text GROUP BY 1")
def ocr_pages(spark, sf_dir):
    of = ocr.lines(ocr.tokens(make(spark, sf_dir, "words")), ["page"])
    return ocr.page_text(of, ["page"]).select("page", (F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.md5("text").alias("text_md5"))


@query(f"WITH {_TOKENS} SELECT page, block, par, line, round(avg(confidence), 6) AS mean, count(*) AS n FROM token GROUP BY ALL HAVING count(*) >= 2")
def ocr_line_confidence(spark, sf_dir):
    return ocr.line_confidence(ocr.tokens(make(spark, sf_dir, "words")), ["page"]).withColumn("mean", ocr.six_places(F.col("mean")))


@query(f"WITH {_TOKENS}, l AS (SELECT page, avg(confidence) AS m FROM token GROUP BY page, block, par, line HAVING count(*) >= 2), w AS (SELECT page, min(m) AS worst FROM l GROUP BY 1), p AS (SELECT page, avg(confidence) AS m FROM token GROUP BY 1) SELECT d.doc_id AS page, round(coalesce(m, 0), 6) AS mean_confidence, round(coalesce(worst, m, 0), 6) AS worst_line, coalesce(m, 0) < 0.55 AS low, coalesce(m, 0) < 0.55 OR coalesce(worst, m, 0) < 0.55 AS escalate FROM documents d LEFT JOIN p ON p.page = d.doc_id LEFT JOIN w ON w.page = d.doc_id")
def ocr_escalation(spark, sf_dir):
    words = ocr.tokens(make(spark, sf_dir, "words"))
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page"))
    return ocr.page_confidence(pages, words, ["page"]).withColumns({c: ocr.six_places(F.col(c)) for c in ("mean_confidence", "worst_line")})


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'eng' WHEN 'es' THEN 'eng' WHEN 'de' THEN 'eng' ELSE 'eng' END AS one, CASE WHEN lang = 'en' THEN 'hin+eng+eng' ELSE 'hin+eng' END AS two FROM documents")
def ocr_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", ocr.language(F.col("lang"), ["eng", "hin"]).alias("one"), ocr.language(F.concat(F.lit("hi+"), "lang", F.lit("+en")), ["eng", "hin"]).alias("two"))


# The timeline.
@query(f"WITH {cte('entries')} SELECT document_id, session, row_number() OVER (PARTITION BY session ORDER BY date ASC NULLS LAST, CASE kind WHEN 'note' THEN 0 WHEN 'condition' THEN 1 WHEN 'imaging' THEN 2 WHEN 'lab' THEN 3 WHEN 'allergy' THEN 4 WHEN 'prescription' THEN 5 ELSE 99 END, lower(title), seq) AS pos FROM entries")
def timeline_order(spark, sf_dir):
    return timeline.order(make(spark, sf_dir, "entries"), ["session"]).select("document_id", "session", F.col("pos").cast("long").alias("pos"))


_KEYS = "keyset AS (SELECT o_orderkey AS id, o_custkey AS session, list_sort(list(DISTINCT 'k' || (l_partkey % 6))) AS keys FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def _keysets(spark, sf_dir):
    tables(spark, sf_dir, "orders", "lineitem")
    return spark.sql("SELECT o_orderkey AS id, o_custkey AS session, sort_array(collect_set('k' || (l_partkey % 6))) AS keys FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")


@query(f"WITH {_KEYS}, e AS (SELECT id, session, keys, id % 2 AS kind, id % 3 AS day, CASE WHEN list_contains(keys, 'k0') THEN CASE WHEN id % 8 < 4 THEN '500mg' ELSE '250mg' END END AS dose FROM keyset) SELECT a.id, b.id AS other, round(len(list_intersect(a.keys, b.keys)) / len(list_distinct(list_concat(a.keys, b.keys))), 6) AS jaccard, CASE WHEN a.kind <> b.kind THEN 'different kind' WHEN a.day = 0 AND b.day = 0 THEN 'both undated' WHEN a.day <> b.day THEN 'different date' WHEN least(len(a.keys), len(b.keys)) < 2 THEN 'too few keys' WHEN a.dose <> b.dose THEN 'dose changed' WHEN len(list_intersect(a.keys, b.keys)) / len(list_distinct(list_concat(a.keys, b.keys))) >= 0.6 THEN 'duplicate' ELSE 'different content' END AS verdict FROM e a JOIN e b ON a.session = b.session AND b.id > a.id")
def duplicate_verdicts(spark, sf_dir):
    """Every two entries of a session."""
    dose = F.when(F.array_contains("keys", "k0"), F.array(F.struct(F.lit("k0").alias("drug"), F.array(F.when(F.col("id") % 8 < 4, "500mg").otherwise("250mg")).alias("doses")))).otherwise(F.array().cast("array<struct<drug:string,doses:array<string>>>"))
    e = _keysets(spark, sf_dir).select("id", "session", F.struct((F.col("id") % 2).alias("kind"), F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("date"), "keys", dose.alias("doses")).alias("x"))
    b = e.select(F.col("id").alias("other"), "session", F.col("x").alias("y"))
    return e.join(b, "session").where("other > id").select("id", "other", F.round(timeline.jaccard(F.col("x.keys"), F.col("y.keys")), 6).alias("jaccard"), timeline.verdict("x", "y").alias("verdict"))


def _entries(spark, sf_dir):
    """Entries with keys and doses; each order comes again as a worse copy under the next number, of a clinic where the first has none."""
    doses = F.when(F.array_contains("keys", "k0"), F.array(F.struct(F.lit("k0").alias("drug"), F.array(F.when(F.col("seq") % 8 < 4, "500mg").otherwise("250mg")).alias("doses")))).otherwise(F.array().cast("array<struct<drug:string,doses:array<string>>>"))
    e = make(spark, sf_dir, "entries").join(_keysets(spark, sf_dir).select(F.col("id").alias("seq"), "keys"), "seq").withColumn("doses", doses)
    # days are folded to quarters, so that more than copies meet
    e = e.withColumns({"seq": F.col("seq") * 2, "date": F.trunc("date", "quarter"), "kind": F.when(F.col("kind") == "note", "lab").otherwise(F.col("kind"))})
    copy = e.withColumns({"seq": F.col("seq") + 1, "document_id": -F.col("document_id"), "confidence": F.col("confidence") - 0.05, "facility": F.coalesce("facility", F.lit("Ward"))})
    return e.unionByName(copy)


_FOLD = f"""{cte('entries')}, {_KEYS}, one AS (
  SELECT e.session, e.seq * 2 AS seq, document_id, CASE kind WHEN 'note' THEN 'lab' ELSE kind END AS kind, date_trunc('quarter', date)::DATE AS date, facility, confidence, keys,
         CASE WHEN list_contains(keys, 'k0') THEN CASE WHEN e.seq % 8 < 4 THEN '500mg' ELSE '250mg' END END AS dose
  FROM entries e JOIN keyset k ON k.id = e.seq
), doubled AS (
  SELECT * FROM one UNION ALL SELECT session, seq + 1, -document_id, kind, date, coalesce(facility, 'Ward'), confidence - 0.05, keys, dose FROM one
), e AS (
  SELECT *, row_number() OVER (PARTITION BY session, kind, date, CASE WHEN date IS NULL THEN seq END ORDER BY seq) AS n, CASE WHEN date IS NULL THEN seq ELSE 0 END AS g,
         {{'seq': seq, 'document_id': document_id, 'facility': facility, 'confidence': confidence, 'keys': keys, 'dose': dose, 'ids': [document_id]}} AS x
  FROM doubled
), met(session, kind, date, g, n, kept) AS (
  SELECT session, kind, date, g, n, [x] FROM e WHERE n = 1
  UNION ALL
  SELECT session, kind, date, g, n, CASE WHEN spot = 0 THEN list_append(kept, x) ELSE list_concat(kept[1 : spot - 1], [CASE WHEN x.confidence > kept[spot].confidence
    THEN {{'seq': kept[spot].seq, 'document_id': x.document_id, 'facility': coalesce(x.facility, kept[spot].facility), 'confidence': x.confidence, 'keys': list_sort(list_distinct(list_concat(kept[spot].keys, x.keys))), 'dose': coalesce(kept[spot].dose, x.dose), 'ids': list_append(kept[spot].ids, x.document_id)}}
    ELSE {{'seq': kept[spot].seq, 'document_id': kept[spot].document_id, 'facility': coalesce(kept[spot].facility, x.facility), 'confidence': kept[spot].confidence, 'keys': list_sort(list_distinct(list_concat(kept[spot].keys, x.keys))), 'dose': coalesce(kept[spot].dose, x.dose), 'ids': list_append(kept[spot].ids, x.document_id)}} END], kept[spot + 1 : ]) END
  FROM (SELECT m.session, m.kind, m.date, m.g, e.n, kept, x, coalesce(list_position(list_transform(kept, lambda k: least(len(k.keys), len(e.keys)) >= 2 AND coalesce(k.dose = e.dose, true) AND len(list_intersect(k.keys, e.keys)) / len(list_distinct(list_concat(k.keys, e.keys))) >= 0.6), true), 0) AS spot
        FROM met m JOIN e ON e.session = m.session AND e.kind = m.kind AND e.date IS NOT DISTINCT FROM m.date AND e.g = m.g AND e.n = m.n + 1)
), folded AS (
  SELECT session, kind, date, unnest(kept) AS k FROM (SELECT *, max(n) OVER (PARTITION BY session, kind, date, g) AS last FROM met) WHERE n = last
)"""


@query(f"WITH RECURSIVE {_FOLD} SELECT session, k.seq AS seq, k.document_id AS document_id, kind, strftime(date, '%Y-%m-%d') AS date, k.facility AS facility, round(k.confidence, 6) AS confidence, array_to_string(list_filter(k.ids, lambda i: i <> k.document_id), ',') AS duplicate_of, array_to_string(list_sort(k.keys), ',') AS keys FROM folded")
def timeline_folded(spark, sf_dir):
    """Entries kept by the greedy fold, with what they absorbed: its SQL folds a list recursively, entry by entry."""
    kept = timeline.fold_duplicates(_entries(spark, sf_dir))
    return kept.select("session", "seq", "document_id", "kind", F.col("date").cast("string").alias("date"), "facility", F.round("confidence", 6).alias("confidence"), F.array_join("duplicate_of", ",").alias("duplicate_of"), F.array_join(F.array_sort("keys"), ",").alias("keys"))


@query(f"WITH RECURSIVE {_FOLD}, gone AS (SELECT session, k.document_id AS kept_id, unnest(list_filter(k.ids, lambda i: i <> k.document_id)) AS other FROM folded) SELECT session, 'merged ' || other || ' into ' || kept_id || ': same day, same kind, shared content' AS note FROM gone")
def merge_notes(spark, sf_dir):
    return timeline.merge_notes(timeline.fold_duplicates(_entries(spark, sf_dir)))


_DOCS = "docs AS (SELECT o_orderkey AS document_id, o_custkey AS session, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS mean_confidence, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 4 END AS n_entities FROM orders)"


def _docs(spark, sf_dir):
    tables(spark, sf_dir, "orders")
    return spark.sql(_DOCS.removeprefix("docs AS "))


@query(f"WITH {_DOCS} SELECT document_id, mean_confidence < 0.3 OR n_entities = 0 AS unreadable FROM docs")
def unreadable_documents(spark, sf_dir):
    good, bad = timeline.split_readable(_docs(spark, sf_dir))
    return good.select("document_id", F.lit(False).alias("unreadable")).unionByName(bad.select("document_id", F.lit(True).alias("unreadable")))


_FOUND = f"found AS (SELECT o_custkey AS session, o_orderkey AS document_id, {DOC} AS entity_no, CASE WHEN l_suppkey % 2 = 0 THEN 'lab' ELSE 'medication' END AS kind, {ALIAS} AS text, CAST(l_linenumber % 10 AS DOUBLE) / 10 AS confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _found(spark, sf_dir):
    tables(spark, sf_dir, "orders", "lineitem")
    return spark.sql(for_spark(_FOUND.removeprefix("found AS ")))


@query(f"WITH {_DOCS}, {_FOUND}, d AS (SELECT session, list(text ORDER BY document_id, entity_no, text) AS names FROM found WHERE confidence < 0.5 GROUP BY 1), c AS (SELECT session, count(*) AS n, count(*) FILTER (WHERE mean_confidence < 0.3 OR n_entities = 0) AS u FROM docs GROUP BY 1) SELECT session, n AS n_documents, u AS n_unreadable, coalesce(len(names), 0)::BIGINT AS n_uncertain, coalesce(array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' and ' || (len(names) - 3) || ' more' ELSE '' END, '') AS preview, u = n AS entirely_undocumented FROM c LEFT JOIN d USING (session)")
def documentation_gaps(spark, sf_dir):
    return timeline.gaps(_docs(spark, sf_dir), _found(spark, sf_dir), ["session"])


@query(f"WITH {_FOUND} SELECT kind, count(*) AS n, round(avg(confidence), 6) AS mean, round(coalesce(avg(confidence) FILTER (WHERE confidence > 0), 0), 6) AS mean_positive FROM found GROUP BY 1")
def mean_confidences(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)), 6).alias("mean_positive"))


# Resources.
_UNITS = ["mg/dL", "cells/cumm", "mmHg", "U/L", "%", "lakhs/cumm", "degF"]


@query(f"SELECT {DOC} AS document_id, {pick('CAST(l_partkey % 7 AS INT)', _UNITS)} AS unit, {pick('CAST(l_partkey % 7 AS INT)', ['mg/dL', None, 'mm[Hg]', 'U/L', '%', None, '[degF]']).replace(chr(39) + 'None' + chr(39), 'NULL')} AS code, {QTY}::DOUBLE AS value, CASE WHEN l_suppkey % 2 = 0 THEN 5.0::DOUBLE END AS low, 'preliminary' AS status FROM lineitem")
def fhir_observations(spark, sf_dir):
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(for_spark(f"SELECT {DOC} AS document_id, 'lab' AS kind, 'x' AS text, CAST({QTY} AS DOUBLE) AS value_num, CAST(NULL AS STRING) AS value_str, {pick('CAST(l_partkey % 7 AS INT)', _UNITS)} AS unit, CASE WHEN l_suppkey % 2 = 0 THEN '5-9' ELSE 'negative' END AS reference_range, CAST(NULL AS STRING) AS system, CAST(NULL AS STRING) AS code, CAST(NULL AS STRING) AS display, '2001-01-01' AS effective, 0.5D AS confidence FROM lineitem"))
    j = rows.select("document_id", F.to_json(fhir.observation()).alias("j"))
    get = lambda path: F.get_json_object("j", path)
    return j.select("document_id", get("$.valueQuantity.unit").alias("unit"), get("$.valueQuantity.code").alias("code"), get("$.valueQuantity.value").cast("double").alias("value"), get("$.referenceRange[0].low.value").cast("double").alias("low"), get("$.status").alias("status"))


def _coded(spark, sf_dir):
    none = {c: F.lit(None).cast("string") for c in ("system", "code", "display", "value_str", "unit", "reference_range")}
    return _found(spark, sf_dir).withColumns(none).withColumn("value_num", F.lit(1.0))


def _headed(spark, sf_dir):
    return _docs(spark, sf_dir).select("document_id", "session", F.when(F.col("document_id") % 3 == 0, "lab").otherwise("note").alias("suggested_type"), F.lit("Title").alias("suggested_title"), F.lit("2001-01-01").alias("clinical_date"), "mean_confidence")


_RESOURCES = f"{_DOCS}, {_FOUND}, per AS (SELECT document_id, count(*) FILTER (WHERE kind = 'lab') AS o, count(*) FILTER (WHERE kind = 'medication') AS m FROM found GROUP BY 1), res AS (SELECT document_id, session, CASE WHEN document_id % 3 = 0 OR (coalesce(o, 0) > 0 AND coalesce(m, 0) = 0) THEN coalesce(o, 0) WHEN coalesce(m, 0) > 0 THEN m ELSE 0 END AS n_parts, CASE WHEN document_id % 3 = 0 OR (coalesce(o, 0) > 0 AND coalesce(m, 0) = 0) THEN CASE WHEN coalesce(o, 0) = 1 THEN 'Observation' ELSE 'DiagnosticReport' END WHEN coalesce(m, 0) > 0 THEN CASE WHEN m = 1 THEN 'MedicationRequest' ELSE 'Bundle' END ELSE 'DocumentReference' END AS resource_type FROM docs LEFT JOIN per USING (document_id))"


@query(f"WITH {_RESOURCES} SELECT document_id, resource_type, n_parts FROM res")
def fhir_resources(spark, sf_dir):
    return fhir.resources(_headed(spark, sf_dir), _coded(spark, sf_dir).drop("session"), ["document_id"]).select("document_id", "resource_type", "n_parts")


@query(f"WITH {_RESOURCES} SELECT session, (sum(CASE WHEN resource_type = 'Bundle' THEN n_parts ELSE 1 END) + CASE WHEN session % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS total, CASE WHEN session % 4 = 0 THEN 'high' END AS severity FROM res GROUP BY 1")
def fhir_bundles(spark, sf_dir):
    made = fhir.resources(_headed(spark, sf_dir), _coded(spark, sf_dir).drop("session"), ["document_id"]).join(_docs(spark, sf_dir).select("document_id", "session"), "document_id")
    alerts = made.where("session % 4 = 0").select("session").distinct().select("session", F.lit(1).alias("rank_no"), F.lit("major").alias("severity"), F.lit("aspirin").alias("drug_a"), F.lit("warfarin").alias("drug_b"), F.lit("bleeding").alias("description"))
    out = fhir.patient_bundle(made, alerts, made.select("session").distinct(), ["session"], "document_id")
    issue = F.regexp_extract("bundle", r'"resourceType":"DetectedIssue","status":"preliminary","severity":"(\w+)"', 1)
    return out.select("session", F.get_json_object("bundle", "$.total").cast("long").alias("total"), F.nullif(issue, F.lit("")).alias("severity"))


@query(f"WITH s AS (SELECT DISTINCT o_custkey AS session FROM orders) SELECT session, CASE WHEN session % 2 = 0 THEN 'MedicationRequest/m' || session END AS first, 'aspirin' AS first_name, NULL::VARCHAR AS second, 'Warfarin' AS second_name FROM s")
def issue_references(spark, sf_dir):
    """Warnings that name the requests they rest on; names are looked up as written, in an index of lower-cased names."""
    sessions = make(spark, sf_dir, "entries").select("session").distinct()
    made = sessions.select("session", F.to_json(F.struct(F.lit("MedicationRequest").alias("resourceType"), F.when(F.col("session") % 2 == 0, F.concat(F.lit("m"), F.col("session").cast("string"))).alias("id"), F.struct(F.lit("Aspirin").alias("text")).alias("medicationCodeableConcept"))).alias("json"))
    warf = sessions.select("session", F.lit('{"resourceType":"MedicationRequest","id":"w","medicationCodeableConcept":{"text":"Warfarin"}}').alias("json"))
    alerts = sessions.select("session", F.lit(1).alias("rank_no"), F.lit("major").alias("severity"), F.lit("aspirin").alias("drug_a"), F.lit("Warfarin").alias("drug_b"), F.lit("x").alias("description"))
    issues = fhir.detected_issues(alerts, ["session"], fhir.medication_ids(made.unionByName(warf), ["session"]))
    get = lambda path: F.get_json_object("json", path)
    return issues.select("session", *(get(f"$.implicated[{i}].{k}").alias(n) for i, k, n in ((0, "reference", "first"), (0, "display", "first_name"), (1, "reference", "second"), (1, "display", "second_name"))))


# The interview, over the event log.
#: The event types in order, which name the questions, as a rule file's ids do.
NAMES = ("click", "error", "purchase", "signup", "view")
RULES = [
    {"question_id": None, "option": None, "when": "value == yes", "reason": "said yes", "severity": "urgent"},
    {"question_id": None, "option": None, "when": "value >= 9 && {other} == yes", "reason": "high after yes", "severity": "critical"},
]


_ANS = cte("answers")
_STATE = f"{_ANS}, q AS (SELECT DISTINCT question_id AS q FROM answers), names AS (SELECT q, row_number() OVER (ORDER BY q) AS i FROM q), sofar AS (SELECT a.session_id, a.ord, a.question_id, a.value, n.q, n.i, last_value(CASE WHEN a.question_id = n.q THEN a.value END IGNORE NULLS) OVER (PARTITION BY a.session_id, n.q ORDER BY a.ord) AS v FROM answers a CROSS JOIN names n)"


@query(f"WITH {_STATE} SELECT session_id, ord, question_id, value, count(v) AS n_known, max(CASE WHEN i = 1 THEN v END) AS first_value FROM sofar GROUP BY 1, 2, 3, 4")
def state_as_of_answer(spark, sf_dir):
    out = interview.state_as_of(make(spark, sf_dir, "answers"), ["session_id"])
    return out.select("session_id", F.col("ord").cast("long").alias("ord"), "question_id", "value", F.size("state").cast("long").alias("n_known"), F.try_element_at("state", F.lit(NAMES[0])).alias("first_value"))


def _rules():
    return [{**r, "question_id": q, "when": r["when"].replace("{other}", NAMES[-1])} for q in NAMES[:2] for r in RULES]


def _answers(spark, sf_dir):
    return make(spark, sf_dir, "answers").withColumns({"multi": F.lit(None).cast("array<string>"), "dur_amount": F.lit(None).cast("double"), "dur_unit": F.lit(None).cast("string")})


_FLAGS = f"{_STATE}, flag AS (SELECT a.session_id, a.ord, a.question_id, 'said yes' AS reason, 'urgent' AS severity FROM answers a JOIN names ON q = question_id WHERE i <= 2 AND a.value = 'yes' UNION ALL SELECT s.session_id, s.ord, s.question_id, 'high after yes', 'critical' FROM sofar s JOIN names m ON m.q = s.question_id WHERE m.i <= 2 AND s.i = (SELECT max(i) FROM names) AND try_cast(s.value AS DOUBLE) >= 9 AND s.v = 'yes')"


@query(f"WITH {_FLAGS} SELECT session_id, ord, question_id, reason, severity FROM flag")
def red_flags(spark, sf_dir):
    return interview.red_flags(_answers(spark, sf_dir), _rules(), ["session_id"]).withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {_FLAGS} SELECT session_id, ord, question_id, reason, severity FROM flag")
def red_flags_streaming(spark, sf_dir):
    """The same flags from the answers as a stream, drained into a table in the shared folder and read back."""
    from chartloom.streaming.interview import state_store, stream_red_flags

    base = scratch(spark, "stream")
    log = _answers(spark, sf_dir).withColumn("ord", F.col("ord").cast("long"))
    log.write.parquet(f"{base}/log")
    flags = stream_red_flags(spark.readStream.schema(log.schema).parquet(f"{base}/log"), _rules())
    with state_store(spark):
        flags.writeStream.format("parquet").option("path", f"{base}/flags").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/flags").select("session_id", "ord", "question_id", "reason", "severity")


_PART_RULES = (
    "SELECT CAST(p_partkey AS BIGINT) AS rule_no, " + pick("CAST(p_partkey % 5 AS INT)", list(NAMES)) + " AS question_id, CAST(NULL AS VARCHAR(9)) AS option, "
    "'value == ' || " + pick("CAST(p_size % 13 AS INT)", [*range(11), "yes", "no"]) + " || ' && ' || " + pick("CAST((p_partkey + 1 + p_size % 4) % 5 AS INT)", list(NAMES)) + " || "
    + pick("CAST(floor(p_retailprice) % 4 AS INT)", [" >= 7", " == yes", " in [no, 3, 4]", " < 2 && value == 5"]) + " AS condition, p_type AS reason, 'urgent' AS severity FROM part"
)


@query(f"WITH {_ANS}, r AS ({_PART_RULES}), p AS (SELECT *, regexp_extract(condition, '^value == ([^ ]+)', 1) AS own, regexp_extract(condition, '&& ([^ ]+)', 1) AS other, condition LIKE '%&& value == 5' AS five FROM r), met AS (SELECT a.session_id, a.ord, p.* FROM answers a JOIN p ON p.question_id = a.question_id AND p.own = a.value WHERE NOT five OR a.value = '5'), seen AS (SELECT met.*, b.value AS v, try_cast(b.value AS DOUBLE) AS n FROM met ASOF LEFT JOIN answers b ON met.session_id = b.session_id AND met.other = b.question_id AND met.ord >= b.ord) SELECT rule_no, reason, count(*) AS n_fired, count(DISTINCT session_id) AS n_sessions, sum(ord)::BIGINT AS places FROM seen WHERE CASE WHEN condition LIKE '%>= 7%' THEN n >= 7 WHEN condition LIKE '%== yes' THEN v = 'yes' WHEN condition LIKE '%in [no, 3, 4]%' THEN v IN ('no', '3', '4') ELSE n < 2 END GROUP BY 1, 2")
def part_rules(spark, sf_dir):
    """A rule for each part: answers meet the distinct conditions, and rules have their counts."""
    tables(spark, sf_dir, "part")
    found = spark.sql(_PART_RULES).withColumnRenamed("condition", "when")
    return interview.tally(_answers(spark, sf_dir), found, ["session_id"]).select("rule_no", "reason", "n_fired", "n_sessions", "places")


_MAP = {"conditions": [
    {"id": "c1", "urgency": "critical", "discriminators": [{"question_id": 0, "value": "yes", "weight": 0.4}, {"question_id": 1, "value": "no", "weight": 0.3}], "negative": [{"question_id": 2, "value": "yes", "weight": 0.2}], "must_ask": [3]},
    {"id": "c2", "urgency": "soon", "discriminators": [{"question_id": 1, "value": "yes", "weight": 0.5}, {"question_id": 2, "value": "no", "weight": 0.6}], "negative": [{"question_id": 0, "value": "no", "weight": 0.1}], "must_ask": []},
    {"id": "c3", "urgency": "watch", "discriminators": [{"question_id": 4, "value": "5", "weight": 0.7}], "negative": [], "must_ask": []},
]}


def _named_map():
    return {"conditions": [{**c, "must_ask": [NAMES[q % len(NAMES)] for q in c["must_ask"]], **{k: [{**d, "question_id": NAMES[d["question_id"] % len(NAMES)]} for d in c[k]] for k in ("discriminators", "negative")}} for c in _MAP["conditions"]]}


def _condition_map(spark, sf_dir):
    return scan.condition_map(spark, _named_map())


_EVIDENCE = values([(c["id"], d["question_id"] + 1, d["value"], s * d["weight"]) for c in _MAP["conditions"] for s, k in ((1.0, "discriminators"), (-1.0, "negative")) for d in c[k]], "condition_id, i, value, w", "ev")
_CONDITIONS = values([(c["id"], n) for n, c in enumerate(_MAP["conditions"])], "condition_id, n", "cc")
_PLAUSIBLE = f"{_ANS}, names AS (SELECT q, row_number() OVER (ORDER BY q) AS i FROM (SELECT DISTINCT question_id AS q FROM answers)), latest AS (SELECT session_id, question_id, arg_max(value, ord) AS value FROM answers GROUP BY 1, 2), sums AS (SELECT session_id, condition_id, sum(w) AS s FROM latest JOIN names ON q = question_id JOIN {_EVIDENCE} AS e ON e.i = names.i AND e.value = latest.value GROUP BY 1, 2), plaus AS (SELECT session_id, condition_id, n, greatest(0, least(1, coalesce(s, 0)))::DOUBLE AS p FROM (SELECT DISTINCT session_id FROM answers) CROSS JOIN {_CONDITIONS} AS c LEFT JOIN sums USING (session_id, condition_id))"


def _plausibility(spark, sf_dir):
    evidence, must, conditions = _condition_map(spark, sf_dir)
    answers = interview.latest_answers(_answers(spark, sf_dir), ["session_id"])
    return answers, evidence, must, conditions, interview.plausibility(answers, evidence, conditions, ["session_id"])


@query(f"WITH {_PLAUSIBLE} SELECT session_id, condition_id, round(p, 6) AS plausibility FROM plaus")
def plausibility(spark, sf_dir):
    return _plausibility(spark, sf_dir)[-1].withColumn("plausibility", F.round("plausibility", 6))


_SCORES = f"{_PLAUSIBLE}, eff AS (SELECT i, condition_id, arg_max(w, abs(w)) AS e FROM {_EVIDENCE} AS x GROUP BY 1, 2), live AS (SELECT * FROM plaus WHERE p > 0), ce AS (SELECT session_id, condition_id, n, p, q, names.i, coalesce(e, 0) AS e FROM live CROSS JOIN names LEFT JOIN eff USING (condition_id, i)), pairs AS (SELECT a.session_id, a.q, sum(greatest(a.p, b.p) * abs(a.e - b.e)) AS s FROM ce a JOIN ce b ON a.session_id = b.session_id AND a.q = b.q AND a.n < b.n GROUP BY 1, 2), one AS (SELECT session_id, q, count(*) AS k, max(abs(e)) AS m, bool_or(condition_id = 'c1' AND i = 4) AS must FROM ce GROUP BY 1, 2), score AS (SELECT s.session_id, names.q AS question_id, names.i, CASE WHEN must THEN 100.0 WHEN k = 1 THEN m WHEN k > 1 THEN coalesce(pairs.s, 0) ELSE 0 END::DOUBLE AS score, CASE WHEN must THEN 3 ELSE 0 END AS u FROM (SELECT DISTINCT session_id FROM answers) s CROSS JOIN names LEFT JOIN one ON one.session_id = s.session_id AND one.q = names.q LEFT JOIN pairs ON pairs.session_id = s.session_id AND pairs.q = names.q)"


@query(f"WITH {_SCORES} SELECT session_id, question_id, round(score, 6) AS score, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, u DESC, i) AS rank_no FROM score")
def ranked_questions(spark, sf_dir):
    answers, evidence, must, conditions, plaus = _plausibility(spark, sf_dir)
    live = plaus.where("plausibility > 0").join(conditions.select("condition_id", "ord"), "condition_id")
    asked = spark.createDataFrame(list(enumerate(NAMES)), "q_ord int, question_id string")
    candidates = answers.select("session_id").distinct().crossJoin(asked)
    scored = interview.question_scores(live, candidates.select("session_id", "question_id"), evidence, must, ["session_id"]).withColumn("score", F.round("score", 9))
    out = interview.rank_questions(scored.join(asked, "question_id"), live, must, conditions, ["session_id"])
    return out.select("session_id", "question_id", F.round("score", 6).alias("score"), F.col("rank_no").cast("long").alias("rank_no"))


ONTOLOGY = {"sections": [
    {"id": "s1", "order": 1, "always": True, "questions": [{"id": 0, "follow_up_on_yes": 1}, {"id": 1}, {"id": "extra", "input_type": "derived"}]},
    {"id": "s2", "order": 2, "trigger": "{2} == no", "questions": [{"id": 2}, {"id": 3, "capture_mode": "examiner_required"}]},
    {"id": "s3", "order": 3, "mode": "ayush", "questions": [{"id": 4}]},
]}


def _ontology(spark, sf_dir):
    name = lambda x: NAMES[x % len(NAMES)] if isinstance(x, int) else x
    sections = []
    for s in ONTOLOGY["sections"]:
        items = [{**i, "id": name(i["id"])} | ({"follow_up_on_yes": name(i["follow_up_on_yes"])} if "follow_up_on_yes" in i else {}) for i in s["questions"]]
        sections.append({**s, "questions": items} | ({"trigger": s["trigger"].replace("{2}", NAMES[2])} if "trigger" in s else {}))
    return scan.check_ontology({"sections": sections})


_SEQ = f"{_ANS}, names AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS i FROM (SELECT DISTINCT question_id AS q FROM answers)), latest AS (SELECT session_id, i, q, arg_max(value, ord) AS value FROM answers JOIN names ON q = question_id GROUP BY 1, 2, 3), sess AS (SELECT DISTINCT session_id FROM answers), seq AS (SELECT session_id, 0 AS i, 1 AS o FROM sess UNION ALL SELECT session_id, 1, 2 FROM latest WHERE i = 0 AND value = 'yes' UNION ALL SELECT session_id, 2, 3 FROM latest WHERE i = 2 AND value = 'no')"


@query(f"WITH {_SEQ} SELECT s.session_id, names.q AS question_id, row_number() OVER (PARTITION BY s.session_id ORDER BY o) AS q_ord, l.value IS NOT NULL AS answered FROM seq s JOIN names USING (i) LEFT JOIN latest l ON l.session_id = s.session_id AND l.i = s.i")
def question_sequence(spark, sf_dir):
    found = _ontology(spark, sf_dir)
    answers = interview.latest_answers(_answers(spark, sf_dir), ["session_id"])
    sections = {s["id"]: s for s in found["sections"]}
    return interview.sequence(scan.flatten(spark, found), answers, ["session_id"], sections).withColumn("q_ord", F.col("q_ord").cast("long"))


@query(f"WITH {_FLAGS} SELECT session_id, count(DISTINCT question_id) AS n_answered, coalesce(n, 0)::BIGINT AS n_flags FROM answers LEFT JOIN (SELECT session_id, count(*) AS n FROM flag GROUP BY 1) USING (session_id) GROUP BY session_id, n")
def transcripts(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    flags = interview.red_flags(answers, _rules(), ["session_id"])
    out = interview.transcripts(answers.withColumn("transcript", F.lit(None).cast("string")), question_sequence(spark, sf_dir), flags, ["session_id"])
    return out.select("session_id", "n_answered", F.size("red_flags").cast("long").alias("n_flags"))


@query(f"WITH {_SCORES}, seq AS (SELECT session_id, 1 AS i, 1 AS o FROM (SELECT DISTINCT session_id FROM answers) UNION ALL SELECT session_id, 2, 2 FROM latest JOIN names ON q = question_id WHERE i = 1 AND value = 'yes' UNION ALL SELECT session_id, 3, 3 FROM latest JOIN names ON q = question_id WHERE i = 3 AND value = 'no'), waits AS (SELECT s.session_id, sc.question_id, row_number() OVER (PARTITION BY s.session_id ORDER BY round(score, 9) DESC, u DESC, o) AS n FROM seq s JOIN score sc ON sc.session_id = s.session_id AND sc.i = s.i LEFT JOIN latest l ON l.session_id = s.session_id AND l.question_id = sc.question_id WHERE l.question_id IS NULL) SELECT a.session_id, w.question_id AS next_question, w.question_id IS NULL AS completed FROM (SELECT DISTINCT session_id FROM answers) a LEFT JOIN (SELECT * FROM waits WHERE n = 1) w USING (session_id)")
def next_questions(spark, sf_dir):
    """What each session is asked next: the head of its unanswered questions' ranking; none ends the interview."""
    answers, evidence, must, conditions, plaus = _plausibility(spark, sf_dir)
    live = plaus.where("plausibility > 0").join(conditions.select("condition_id", "ord"), "condition_id")
    waits = interview.unanswered(question_sequence(spark, sf_dir)).select("session_id", "question_id", "q_ord")
    scored = interview.question_scores(live, waits.select("session_id", "question_id"), evidence, must, ["session_id"]).withColumn("score", F.round("score", 9))
    ranked = interview.rank_questions(scored.join(waits, ["session_id", "question_id"]), live, must, conditions, ["session_id"])
    return interview.next_question(ranked, answers.select("session_id").distinct(), ["session_id"])


def _drained(spark, sf_dir, base):
    """The answers as a stream of files in the shared folder."""
    log = _answers(spark, sf_dir).withColumn("ord", F.col("ord").cast("long"))
    log.write.parquet(f"{base}/log")
    return spark.readStream.schema(log.schema).parquet(f"{base}/log")


@query(f"WITH {_ANS} SELECT session_id, question_id, arg_max(value, ord) AS value FROM answers GROUP BY 1, 2")
def live_answers(spark, sf_dir):
    """What the running interviews hold: the stream's own state, read from its checkpoint."""
    from chartloom.streaming import live

    return live.answers(spark, _running(spark, sf_dir))


def _running(spark, sf_dir) -> str:
    """The checkpoint of a query that has drained the answers."""
    from chartloom.streaming.interview import state_store, states

    base = scratch(spark, "live")
    with state_store(spark):
        states(_drained(spark, sf_dir, base)).select("session_id", "ord").writeStream.format("parquet").option("path", f"{base}/seen").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/state"


@query(SQL["next_questions"])
def live_sessions(spark, sf_dir):
    """The same next questions as of the log, from the live state."""
    from chartloom.streaming import live

    return live.read(live.answers(spark, _running(spark, sf_dir)), _ontology(spark, sf_dir), _named_map()).select("session_id", "next_question", "completed")


def _triage(alert: dict) -> tuple[bool, str]:
    """A receiver that takes critical alerts only."""
    return (True, "taken") if alert["severity"] == "critical" else (False, "failed: not urgent enough")


@query(f"WITH {_FLAGS} SELECT session_id, ord, question_id, reason, severity, severity = 'critical' AS delivered, CASE severity WHEN 'critical' THEN 'taken' ELSE 'failed: not urgent enough' END AS detail, count(*) AS n FROM flag GROUP BY ALL")
def delivered_alerts(spark, sf_dir):
    """Alerts of a stream whose first commit fails once they are delivered: the batch comes again, and none is sent or written twice."""
    from chartloom.streaming import alerts
    from chartloom.streaming.interview import state_store, stream_red_flags

    base = scratch(spark, "alerts")
    flags = stream_red_flags(_drained(spark, sf_dir, base), _rules())
    tries = []

    def batch(rows, number):
        tries.append(alerts.record(rows, number, f"{base}/ledger", _triage))
        if len(tries) == 1:
            raise RuntimeError("the query dies before its commit")

    for _ in range(2):
        with state_store(spark):
            query_ = flags.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            try:
                query_.awaitTermination()
            except StreamingQueryException:
                if len(tries) != 1:
                    raise
    if tries != [True, False]:
        raise ValueError(f"a batch was written {sum(tries)} times")
    rows = spark.read.schema(alerts.LEDGER).parquet(f"{base}/ledger")
    return rows.groupBy("session_id", "ord", "question_id", "reason", "severity", "delivered", "detail").agg(F.count(F.lit(1)).alias("n"))


#: Seconds after which an interview counts as abandoned; a deployment's rule file has them for its taps.
_DEFAULTS = {"interaction_defaults": {"tap_timeout_seconds": 86_400}}


@query("WITH e AS (SELECT user_id AS session_id, epoch_us(ts) // 1000 AS t, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), r AS (SELECT *, sum(CASE WHEN t - p <= 86400000 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY t) AS run FROM e), g AS (SELECT session_id, run, min(t) AS began_ms, max(t) AS ended_ms, count(*) AS n, max(run) OVER (PARTITION BY session_id) AS runs FROM r GROUP BY 1, 2) SELECT session_id, began_ms, ended_ms, n FROM g WHERE run < runs OR ended_ms + 86400001 <= (SELECT max(epoch_us(ts) // 1000) FROM events)")
def closed_sessions(spark, sf_dir):
    """Interviews that paused for over a day, closed by timers in the stream's event time."""
    from chartloom.streaming.interview import state_store
    from chartloom.streaming.pauses import CLOSED, closed

    base = scratch(spark, "pauses")
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    log.write.parquet(f"{base}/log")
    with state_store(spark):
        out = closed(spark.readStream.schema(log.schema).parquet(f"{base}/log"), scan.interaction_defaults(_DEFAULTS)["tap_timeout_seconds"])
        out.writeStream.format("parquet").option("path", f"{base}/closed").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CLOSED).parquet(f"{base}/closed")


SHUFFLED = {"sections": [{"id": "z", "order": 1, "always": True, "questions": [{"id": "z1"}, {"id": "z2"}]}, {"id": "a", "order": 1, "always": True, "questions": [{"id": "a1"}]}, {"id": "m", "always": True, "questions": [{"id": "m1"}]}, {"id": "b", "order": 0, "always": True, "questions": [{"id": "b1"}]}]}


@query(f"SELECT DISTINCT session_id, question_id, q_ord::BIGINT AS q_ord FROM (SELECT user_id AS session_id FROM events) e CROSS JOIN {values([('m1', 1), ('b1', 2), ('z1', 3), ('z2', 4), ('a1', 5)], 'question_id, q_ord', 's')} AS x")
def section_order(spark, sf_dir):
    """Sections of equal or missing order, as they stand in the file."""
    answers = interview.latest_answers(_answers(spark, sf_dir), ["session_id"])
    sections = {s["id"]: s for s in SHUFFLED["sections"]}
    return interview.sequence(scan.flatten(spark, SHUFFLED), answers, ["session_id"], sections).select("session_id", "question_id", F.col("q_ord").cast("long").alias("q_ord"))


_DURATIONS = [(None, None), (None, "days"), (2.0, "days"), (20.0, "hours"), (3.0, None), (1.0, "moons"), (0.5, "weeks")]


@query(f"WITH d AS (SELECT event_id, user_id, i, CASE WHEN a IS NULL AND u IS NULL THEN 'Infinity'::DOUBLE ELSE coalesce(a, 0) * CASE u WHEN 'days' THEN 24 WHEN 'weeks' THEN 168 ELSE 1 END END AS h, event_id % 4 AS n FROM events JOIN {values([(i, *d) for i, d in enumerate(_DURATIONS)], 'i, a, u', 'd')} AS x ON x.i = event_id % 7) SELECT event_id AS ord, 'acute' AS reason FROM d WHERE h <= 24 UNION ALL SELECT event_id, 'lasting' FROM d WHERE h >= 1 UNION ALL SELECT event_id, 'three' FROM d WHERE n IN (0, 1)")
def duration_flags(spark, sf_dir):
    """Rules over durations with and without amounts and units, and over numbers and texts that only look like numbers."""
    tables(spark, sf_dir, "events")
    amount, unit = (F.get(F.array(*(F.lit(d[k]).cast(t) for d in _DURATIONS)), (F.col("event_id") % 7).cast("int")) for k, t in ((0, "double"), (1, "string")))
    rows = spark.table("events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.lit("when").alias("question_id"), F.get(F.array(*map(F.lit, ["3", " 3.5e0 ", "3d", "3f"])), (F.col("event_id") % 4).cast("int")).alias("value"), F.lit(None).cast("array<string>").alias("multi"), amount.alias("dur_amount"), unit.alias("dur_unit"))
    when = [{"question_id": "when", "option": None, "when": w, "reason": r, "severity": "urgent"} for w, r in (("value_hours <= 24", "acute"), ("value_hours >= 1", "lasting"), ("value >= 3", "three"))]
    return interview.red_flags(rows, when, ["session_id"]).select("ord", "reason")


SERVED = {"sections": [
    {"id": "b", "order": 2, "trigger": "view == no && click in [yes, no]", "questions": [{"id": "signup"}]},
    {"id": "a", "order": 1, "always": True, "questions": [{"id": "click", "follow_up_on_yes": "error"}, {"id": "error"}, {"id": "view"}, {"id": "purchase", "capture_mode": "examiner_required"}]},
    {"id": "c", "order": 3, "trigger": "view >= 3", "questions": [{"id": "purchase2"}]},
]}
def _traffic(spark, sf_dir):
    """The event log as an interview's events."""
    question = F.when(F.col("question_id") == "purchase", "purchase2").otherwise(F.col("question_id")).alias("question_id")
    return _answers(spark, sf_dir).select("session_id", (F.col("ord") * 2).cast("long").alias("ord"), F.when(F.col("ord") % 31 == 1, "start").otherwise("answer").alias("kind"), F.lit("allopathic").alias("mode"), question, "value", "multi", F.lit(None).cast("string").alias("transcript"))


_KNOWN = "list_filter(['click', CASE WHEN got['click'] = 'yes' THEN 'error' END, 'view', CASE WHEN got['view'] = 'no' AND got['click'] IN ('yes', 'no') THEN 'signup' END, CASE WHEN try_cast(got['view'] AS DOUBLE) >= 3 THEN 'purchase2' END], lambda x: x IS NOT NULL)"
_LEFT = f"list_filter({_KNOWN}, lambda x: NOT list_contains(map_keys(got), x))"


@query(f"""WITH RECURSIVE {_ANS}, log AS (
  SELECT session_id, ord * 2 AS ord, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n, CASE WHEN ord % 31 = 1 THEN 'start' ELSE 'answer' END AS kind, CASE WHEN question_id = 'purchase' THEN 'purchase2' ELSE question_id END AS question, value FROM answers
), step(session_id, n, ord, open, got, status, following, answered, total) AS (
  SELECT session_id, 0::BIGINT, 0::BIGINT, false, MAP {{}}::MAP(VARCHAR, VARCHAR), '', NULL::VARCHAR, 0::BIGINT, 0::BIGINT FROM log GROUP BY 1
  UNION ALL
  SELECT session_id, n, ord, now AND len({_LEFT}) > 0, got, status, CASE WHEN now THEN ({_LEFT})[1] END, CASE WHEN now THEN len({_KNOWN}) - len({_LEFT}) ELSE 0 END, CASE WHEN now THEN len({_KNOWN}) ELSE 0 END
  FROM (SELECT l.session_id, l.n, l.ord, l.kind = 'start' OR s.open AS now,
               CASE WHEN l.kind = 'start' THEN 'started' WHEN NOT s.open THEN 'unknown session' WHEN l.question = s.following THEN 'accepted' ELSE 'refused: waiting for ' || s.following END AS status,
               CASE WHEN l.kind = 'start' THEN MAP {{}}::MAP(VARCHAR, VARCHAR) WHEN s.open AND l.question = s.following THEN map_concat(s.got, MAP([l.question], [l.value])) ELSE s.got END AS got
        FROM step s JOIN log l ON l.session_id = s.session_id AND l.n = s.n + 1) AS x
)
SELECT session_id, ord, status, following AS next_question, status <> 'unknown session' AND following IS NULL AS completed, answered, total AS estimated_total FROM step WHERE n > 0""")
def session_service(spark, sf_dir):
    """The event log as an interview's traffic: each session starts, then answers, often out of turn. What waits rests on what was accepted before; its SQL takes a session's events one after the other."""
    log = _traffic(spark, sf_dir)
    return dialogue.replay(log, dialogue.Script(scan.check_ontology(SERVED))).select("session_id", "ord", "status", "next_question", "completed", "answered", "estimated_total")


@query(SQL["session_service"])
def session_service_streaming(spark, sf_dir):
    """The same steps from the events as a stream."""
    from chartloom.streaming.interview import serve, state_store

    base = scratch(spark, "serve")
    log = _traffic(spark, sf_dir)
    log.write.parquet(f"{base}/log")
    with state_store(spark):
        serve(spark.readStream.schema(dialogue.EVENT).parquet(f"{base}/log"), dialogue.Script(scan.check_ontology(SERVED))).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(dialogue.STEP).parquet(f"{base}/out").select("session_id", "ord", "status", "next_question", "completed", "answered", "estimated_total")


# Constitution.
@query(f"WITH {cte('prakriti')}, c AS (SELECT session_id, count(*) FILTER (WHERE value = 'vata') AS vata, count(*) FILTER (WHERE value = 'pitta') AS pitta, count(*) FILTER (WHERE value = 'kapha') AS kapha, count(*) AS items_answered FROM prakriti GROUP BY 1), r AS (SELECT *, list_sort([row(-vata, 0, 'vata'), row(-pitta, 1, 'pitta'), row(-kapha, 2, 'kapha')]) AS l FROM c) SELECT session_id, vata, pitta, kapha, items_answered, (l[2][1] - l[1][1]) <= 1 AS dual, CASE WHEN items_answered >= 6 THEN CASE WHEN (l[2][1] - l[1][1]) <= 1 THEN l[1][3] || '-' || l[2][3] ELSE l[1][3] END END AS dominant FROM r")
def prakriti(spark, sf_dir):
    return ayush.prakriti(make(spark, sf_dir, "prakriti"), ["session_id"])


_PARAMETERS = [("p1", 0, "patient_reported", "pa.build"), ("p2", 1, "patient_reported", "pa.skin"), ("p3", 2, "derived", None), ("p4", 3, "examiner_required", None), ("p5", 4, "patient_reported", None)]


@query(f"WITH {cte('prakriti')}, s AS (SELECT DISTINCT session_id FROM prakriti), want AS (SELECT * FROM {values([('p1', 0, 'pa.build'), ('p2', 1, 'pa.skin'), ('p5', 2, None)], 'parameter, ord, question_id', 'w')} AS z), m AS (SELECT s.session_id, string_agg(parameter, ',' ORDER BY ord) AS missing, count(*) AS n FROM s CROSS JOIN want LEFT JOIN prakriti p ON p.session_id = s.session_id AND p.question_id = want.question_id WHERE p.value IS NULL GROUP BY 1) SELECT session_id, coalesce(missing, '') AS missing, coalesce(n, 0)::BIGINT AS n_missing, coalesce(n, 0) = 0 AS complete FROM s LEFT JOIN m USING (session_id)")
def missing_parameters(spark, sf_dir):
    answers = make(spark, sf_dir, "prakriti")
    parameters = spark.createDataFrame(_PARAMETERS, "parameter string, ord int, capture_mode string, question_id string")
    return ayush.missing_parameters(answers.select("session_id").distinct(), answers, parameters, ["session_id"]).withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {cte('prakriti')}, s AS (SELECT session_id, count(*) FILTER (WHERE question_id = 'pa.build' AND value IS NOT NULL) AS b, count(*) FILTER (WHERE question_id = 'pa.skin' AND value IS NOT NULL) AS k FROM prakriti GROUP BY 1) SELECT session_id, concat_ws(',', CASE WHEN b = 0 THEN 'p1' END, CASE WHEN k = 0 THEN 'p2' END, 'p5') AS missing, 'p3' AS not_derived, false AS complete FROM s")
def derived_examinations(spark, sf_dir):
    answers = make(spark, sf_dir, "prakriti")
    parameters = spark.createDataFrame([*_PARAMETERS, ("prakriti", 5, "derived", None)], "parameter string, ord int, capture_mode string, question_id string")
    out = ayush.derive(answers.select("session_id").distinct(), answers, parameters, ["session_id"])
    return out.select("session_id", F.array_join("missing", ",").alias("missing"), F.array_join("not_derived", ",").alias("not_derived"), "complete")


# Summary.
@query(f"WITH {cte('entries')}, {_FOUND}, t AS (SELECT session, document_id, row_number() OVER (PARTITION BY session ORDER BY date ASC NULLS LAST, CASE kind WHEN 'note' THEN 0 WHEN 'imaging' THEN 2 WHEN 'lab' THEN 3 WHEN 'allergy' THEN 4 ELSE 5 END, lower(title), seq) AS pos, kind, title, date FROM entries), l AS (SELECT session, 0 AS g, -pos AS p, entity_no AS e, f.text || CASE WHEN confidence < 0.6 THEN ' (as read; low confidence)' ELSE '' END || ' — ' || coalesce(strftime(date, '%Y-%m-%d'), 'undated') AS en, confidence FROM found f JOIN t USING (session, document_id) WHERE f.kind = 'medication' UNION ALL SELECT session, 1, pos, 0, 'Allergy record on file: \"' || title || '\" — ' || coalesce(strftime(date, '%Y-%m-%d'), 'undated'), NULL FROM t WHERE kind = 'allergy') SELECT s.session, coalesce(md5(string_agg(en, chr(10) ORDER BY g, p, e)), md5('No medications or allergy records found among the documents provided.')) AS en_md5, round(coalesce(avg(confidence), 0), 6) AS confidence FROM (SELECT DISTINCT session FROM entries) s LEFT JOIN l USING (session) GROUP BY 1")
def drug_sections(spark, sf_dir):
    entries = timeline.order(make(spark, sf_dir, "entries"), ["session"])
    out = summary.drug_section(entries, _found(spark, sf_dir), entries.select("session").distinct(), ["session"])
    return out.select("session", F.md5("en").alias("en_md5"), F.round("confidence", 6).alias("confidence"))


_SAID_OF_MEDICINE = ["no", "yes", None, "no_tell", "No", "False", "0"]


@query(f"WITH den AS (SELECT c_custkey AS session, c_custkey % 7 AS k FROM customer), {_FOUND} SELECT session, CASE WHEN k = 2 THEN 'I am not taking any medicine' ELSE 'Asked about medicines taken now, the patient said no.' END AS from_interview, 'Prescription found for ' || text AS from_documents, document_id FROM den JOIN found USING (session) WHERE k NOT IN (1, 4) AND kind = 'medication'")
def contradictions(spark, sf_dir):
    """Answers that deny and such as only look so; the third of them was never asked, so what was said counts."""
    tables(spark, sf_dir, "customer")
    denials = spark.sql(f"SELECT c_custkey AS session, {pick('CAST(c_custkey % 7 AS INT)', _SAID_OF_MEDICINE).replace(chr(39) + 'None' + chr(39), 'NULL')} AS rx_current, c_custkey % 7 <> 2 AS rx_asked, array('hello', 'I am not taking any medicine') AS narration FROM customer")
    meds = _found(spark, sf_dir).where("kind = 'medication'").select("session", "document_id", F.col("text").alias("drug_name"))
    return summary.contradictions(denials, meds, ["session"]).drop("topic")


INTERVIEWS = "SELECT c_custkey AS session, CASE c_custkey % 4 WHEN 0 THEN map('cc.primary', 'pain', 'cc.area', 'chest', 'soc.severity', '0', 'px.surgery', 'no') WHEN 1 THEN map('cc.primary', 'fever', 'cc.describe', 'since Monday', 'px.surgery', 'yes', 'ros.anything', 'tired') WHEN 2 THEN map('cc.describe', 'since Monday') ELSE map('x', 'y') END AS answers, map('soc.associations', array('nausea', 'none', 'sweat'), 'px.conditions', array('asthma'), 'pf.family', array('none'), 'pf.habits', array('tea', 'tobacco'), 'ros.screen', array('cough', 'none')) AS lists FROM customer"


@query("WITH a AS (SELECT c_custkey AS session, c_custkey % 4 AS k FROM customer) SELECT session, 'chief_complaint' AS heading, CASE k WHEN 0 THEN 'Presenting complaint: pain in the chest.' WHEN 1 THEN 'Presenting complaint: fever.' || chr(10) || 'Patient''s own words: \"since Monday\"' WHEN 2 THEN 'Patient''s own words: \"since Monday\"' ELSE 'Not answered in this interview.' END AS en, CASE k WHEN 0 THEN 0.7 WHEN 3 THEN 0 ELSE 1 END::DOUBLE AS confidence FROM a UNION ALL SELECT session, 'hpi', CASE WHEN k = 0 THEN 'Severity: 0/10. Associated with: nausea, sweat.' WHEN k IN (1, 2) THEN 'History of presenting illness, in the patient''s own words: \"since Monday\". Structured follow-up questions for this type of complaint are not yet in the interview ontology.' ELSE 'Not answered in this interview.' END, CASE WHEN k = 0 THEN 0.9 WHEN k = 3 THEN 0 ELSE 0.5 END FROM a UNION ALL SELECT session, 'past_surgical', CASE WHEN k = 0 THEN 'Patient reports no prior operations.' WHEN k = 1 THEN 'Patient reports a prior operation; details not captured.' ELSE 'Not answered in this interview.' END, CASE WHEN k = 0 THEN 0.9 WHEN k = 1 THEN 0.8 ELSE 0 END FROM a UNION ALL SELECT session, 'past_medical', 'Patient-reported known conditions: asthma.', 0.85 FROM a UNION ALL SELECT session, 'family', 'Not answered in this interview.', 0 FROM a UNION ALL SELECT session, 'personal', 'Reported habits: tea, tobacco.', 0.85 FROM a UNION ALL SELECT session, 'ros', 'Reported in the last few weeks: cough.' || CASE WHEN k = 1 THEN ' Patient added: \"tired\"' ELSE '' END, 0.8 FROM a UNION ALL SELECT session, 'ayurvedic_assessment', 'Not answered in this interview.', 0 FROM a")
def interview_sections(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    rows = spark.sql(INTERVIEWS)
    return summary.interview_sections(rows, ["session"]).select("session", "heading", "en", "confidence")


_PRIOR = f"{_FOUND}, s AS (SELECT DISTINCT o_custkey AS session FROM orders), flag AS (SELECT session, 0 AS g, '  - ' || text || ': 7.5 mg/dL (high, reference 1-5)' AS line, entity_no AS a, document_id AS b, document_id FROM found WHERE kind = 'lab' AND session % 3 = 0), doc AS (SELECT o_custkey AS session, 1 AS g, '  - Title ' || o_orderpriority || ' — ' || coalesce(strftime(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d'), 'undated') AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END ASC NULLS LAST, lower('Title ' || o_orderpriority), o_orderkey) AS a, 0 AS b, o_orderkey AS document_id FROM orders WHERE o_orderkey % 5 = 1), alert AS (SELECT session, 2 AS g, '  - aspirin + warfarin: bleeding (major)' AS line, 1 AS a, 0 AS b, NULL::BIGINT AS document_id FROM s WHERE session % 4 = 0), block AS (SELECT session, g, CASE g WHEN 0 THEN 'Abnormal results:' WHEN 1 THEN 'All investigations on file:' ELSE 'Drug interaction warnings:' END || chr(10) || string_agg(line, chr(10) ORDER BY a, b) AS body, CASE g WHEN 0 THEN 'असामान्य परिणाम:' WHEN 1 THEN 'उपलब्ध सभी जाँच रिपोर्ट:' ELSE 'दवा पारस्परिक प्रभाव चेतावनी:' END || chr(10) || string_agg(line, chr(10) ORDER BY a, b) AS hindi FROM (SELECT * FROM flag UNION ALL SELECT * FROM doc UNION ALL SELECT * FROM alert) GROUP BY 1, 2), ids AS (SELECT session, count(DISTINCT document_id) AS n FROM (SELECT * FROM flag UNION ALL SELECT * FROM doc) GROUP BY 1), whole AS (SELECT session, string_agg(body, chr(10) || chr(10) ORDER BY g) AS en, string_agg(hindi, chr(10) || chr(10) ORDER BY g) AS hi FROM block GROUP BY 1)"


@query(f"WITH {_PRIOR} SELECT session, md5(coalesce(en, 'No prior investigation reports found among the documents provided.')) AS en_md5, md5(coalesce(hi, 'प्रदान किए गए दस्तावेज़ों में कोई पिछली जाँच रिपोर्ट नहीं मिली।')) AS hi_md5, coalesce(n, 0) AS n_documents FROM s LEFT JOIN whole USING (session) LEFT JOIN ids USING (session)")
def prior_sections(spark, sf_dir):
    """Abnormal results, investigations and warnings, in English and Hindi."""
    entries = timeline.order(make(spark, sf_dir, "entries"), ["session"])
    flags = _found(spark, sf_dir).where("kind = 'lab' and session % 3 = 0").select("session", F.struct("entity_no", "document_id").alias("n"), "text", F.lit(7.5).alias("value_num"), F.lit("mg/dL").alias("unit"), F.lit("high").alias("direction"), F.lit("1-5").alias("range_text"), "document_id")
    flags = flags.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("n")))
    alerts = entries.select("session").distinct().where("session % 4 = 0").select("session", F.lit(1).alias("rank_no"), F.lit("major").alias("severity"), F.lit("aspirin").alias("drug_a"), F.lit("warfarin").alias("drug_b"), F.lit("bleeding").alias("description"))
    bundles = entries.groupBy("session").agg(F.avg("confidence").alias("mean_confidence"))
    return summary.prior_section(entries, flags, alerts, bundles, ["session"]).select("session", F.md5("en").alias("en_md5"), F.md5("hi").alias("hi_md5"), F.size("provenance").cast("long").alias("n_documents"))


@query(f"WITH {_FOUND}, flag AS (SELECT document_id, text, entity_no, CASE WHEN entity_no % 2 = 0 THEN 'high' ELSE 'low' END AS direction FROM found WHERE kind = 'lab' AND entity_no % 3 = 0), last AS (SELECT document_id, lower(text) AS t, arg_max(direction, entity_no) AS marker FROM flag GROUP BY 1, 2) SELECT f.document_id, f.entity_no, marker FROM found f LEFT JOIN last l ON l.document_id = f.document_id AND l.t = lower(f.text)")
def abnormal_markers(spark, sf_dir):
    found = _found(spark, sf_dir)
    flags = found.where("kind = 'lab' and entity_no % 3 = 0").select("document_id", "text", "entity_no", F.when(F.col("entity_no") % 2 == 0, "high").otherwise("low").alias("direction"))
    return fhir.abnormal_markers(found, flags, ["document_id"]).select("document_id", "entity_no", "marker")


# The whole path.
def _bundles_sql() -> str:
    """Each document has one lab or one drug, so none folds into another: entries are documents, and the rest is worked out from the columns."""
    from chartloom.plans import documents

    alerts = documents._ALERTS.replace(cte("session_drugs"), f"session_drugs AS (SELECT l_orderkey AS session_id, {DOC} AS pos, {ALIAS} AS drug FROM lineitem)")
    return f"WITH {alerts}, d AS (SELECT l_orderkey AS session, 2 * count(*) AS n_entries, count(*) FILTER (WHERE l_suppkey % 5 <> 0 AND ({QTY} > {HIGH} OR {QTY} < {LOW})) AS n_abnormal FROM lineitem GROUP BY 1), i AS (SELECT session_id AS session, count(*) AS n FROM ranked GROUP BY 1) SELECT session, n_entries, n_abnormal, coalesce(n, 0)::BIGINT AS n_interactions FROM d LEFT JOIN i USING (session)"


@query(_bundles_sql)
def document_bundles(spark, sf_dir):
    """Pages of one lab row or one drug line a document, three sources of operators in one path."""
    from chartloom.plans import bundle

    labs, drugs = (make(spark, sf_dir, n).select(F.col("session_id").alias("session"), "document_id", "text", "mean_confidence") for n in ("lab_docs", "drug_docs"))
    docs = labs.unionByName(drugs.withColumn("document_id", -F.col("document_id"))).withColumn("doc_no", F.row_number().over(Window.partitionBy("session").orderBy("document_id"))).withColumn("hint", F.lit(None).cast("string"))
    out = bundle.build(docs, *(dims.load(spark, n) for n in ("lab_alias", "drug_alias", "condition_alias", "interaction")), "2002-01-01")
    per = out.timeline.groupBy("session").agg(F.count(F.lit(1)).alias("n_entries"))
    return per.join(out.abnormal.groupBy("session").agg(F.count(F.lit(1)).alias("n_abnormal")), "session", "left").join(out.interactions.groupBy("session").agg(F.count(F.lit(1)).alias("n_interactions")), "session", "left").select("session", "n_entries", F.coalesce("n_abnormal", F.lit(0)).alias("n_abnormal"), F.coalesce("n_interactions", F.lit(0)).alias("n_interactions"))


# Accuracy.
@query(f"WITH {cte('scores')} SELECT grp, round(coalesce(sum(n_correct) / nullif(sum(n_extracted), 0), 0), 6) AS precision, round(coalesce(sum(n_correct) / nullif(sum(n_expected), 0), 0), 6) AS recall, round(coalesce(2.0 * sum(n_correct) / nullif(sum(n_extracted) + sum(n_expected), 0), 0), 6) AS f1 FROM scores GROUP BY 1")
def precision_recall(spark, sf_dir):
    return metrics.precision_recall(make(spark, sf_dir, "scores"), ["grp"]).select("grp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {cte('scores')} SELECT grp, round(avg(n_correct / nullif(n_expected, 0)), 6) AS mean_recall FROM scores GROUP BY 1")
def recall_by_condition(spark, sf_dir):
    return metrics.recall_by(make(spark, sf_dir, "scores"), "grp").withColumn("mean_recall", F.round("mean_recall", 6))


def _ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


#: Names as a recogniser may read them.
_READ = [r[2][:2] + r[2][3:] for r in DRUGS[::4]] + ["xyz"]
_BRANDS = sorted({r[2] for r in dims.seed_rows("drug_alias")})


def _shortlist_sql() -> str:
    rows = []
    for i, term in enumerate(_READ):
        best = sorted(((-_ratio(term.lower(), b.lower()), b) for b in _BRANDS))[: metrics.SHORTLIST]
        rows += [(i, term, b, round(-s, 6), n + 1) for n, (s, b) in enumerate(best)]
    return f"SELECT DISTINCT term, name, score, rank_no::INT AS rank_no FROM part JOIN {values([(i, t, b, float(s), n) for i, t, b, s, n in rows], 'i, term, name, score, rank_no', 'l')} AS x ON x.i = p_partkey % {len(_READ)}"


@query(_shortlist_sql)
def brand_shortlists(spark, sf_dir):
    tables(spark, sf_dir, "part")
    terms = spark.sql(f"SELECT {pick(f'CAST(p_partkey % {len(_READ)} AS INT)', _READ)} AS term FROM part")
    return metrics.shortlist(terms, dims.load(spark, "drug_alias").select(F.col("alias").alias("name"))).withColumn("score", F.round("score", 6))


def _ratios(pairs: str) -> str:
    """CTEs that give `ratios` (a, b, ratio) of a statement of pairs (a, b), by the sequence ratio's own definition: the longest common block, the earliest of equals, then what is left and right of it."""
    return f"""pairs AS ({pairs}), segs(a, b, alo, ahi, blo, bhi, found) AS (
  SELECT a, b, 1::BIGINT, length(a)::BIGINT + 1, 1::BIGINT, length(b)::BIGINT + 1, 0::BIGINT FROM pairs
  UNION ALL
  SELECT a, b, side.alo, side.ahi, side.blo, side.bhi, side.found FROM (
    SELECT a, b, alo, ahi, blo, bhi, max(row(k, -i, -j)) AS best FROM segs, unnest(range(alo, ahi)) AS u(i), unnest(range(blo, bhi)) AS v(j), unnest(range(1, least(ahi - i, bhi - j) + 1)) AS w(k)
    WHERE substr(a, i, k) = substr(b, j, k) GROUP BY a, b, alo, ahi, blo, bhi) AS x,
    unnest([{{'alo': alo, 'ahi': -best[2], 'blo': blo, 'bhi': -best[3], 'found': best[1]}}, {{'alo': -best[2] + best[1], 'ahi': ahi, 'blo': -best[3] + best[1], 'bhi': bhi, 'found': 0::BIGINT}}]) AS s(side)
), ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * sum(found) / (length(a) + length(b)) END::DOUBLE AS ratio FROM segs GROUP BY a, b)"""


#: Words of parts, misread by a letter that their size picks, and the words that there are.
_MISREAD = "SELECT p_partkey, p_size, w, CASE WHEN length(w) > 2 THEN substr(w, 1, CAST(p_size % length(w) AS INT)) || substr(w, CAST(p_size % length(w) AS INT) + 2, 99) ELSE w END AS term FROM (SELECT p_partkey, p_size, p_name, {first} AS w FROM part)"
_FIRST = {"spark": "element_at(split(p_name, ' '), 1)", "duckdb": "string_split(p_name, ' ')[1]"}
_WORDS = {"spark": "SELECT explode(split(p_name, ' ')) AS w FROM part UNION SELECT explode(regexp_extract_all(url, '[a-z]+', 0)) FROM pages", "duckdb": "SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT unnest(regexp_extract_all(url, '[a-z]+')) FROM pages"}


@query(f"WITH RECURSIVE terms AS (SELECT DISTINCT term FROM ({_MISREAD.format(first=_FIRST['duckdb'])})), words AS ({_WORDS['duckdb']}), {_ratios('SELECT term AS a, w AS b FROM terms, words')} SELECT a AS term, b AS name, round(ratio, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, b) AS rank_no FROM ratios QUALIFY rank_no <= {metrics.SHORTLIST}")
def similar_names(spark, sf_dir):
    """The five words of parts and addresses that are most alike to each misread word."""
    tables(spark, sf_dir, "part", "pages")
    terms, words = spark.sql(_MISREAD.format(first=_FIRST["spark"])).select("term"), spark.sql(_WORDS["spark"]).withColumnRenamed("w", "name")
    return metrics.shortlist(terms, words).withColumns({"score": F.round("score", 6), "rank_no": F.col("rank_no").cast("long")})


@query(f"WITH RECURSIVE misread AS ({_MISREAD.format(first=_FIRST['duckdb'])}), words AS (SELECT row_number() OVER (ORDER BY w) AS code, w FROM ({_WORDS['duckdb']}) WHERE length(w) > 2), {_ratios('SELECT DISTINCT term AS a, words.w AS b FROM misread, words')}, best AS (SELECT a, arg_max(code, row(ratio, -code)) AS code, max(ratio) AS score FROM ratios JOIN words ON b = words.w WHERE ratio >= {coding.FUZZY} GROUP BY 1) SELECT p_partkey, term, 'c' || code AS code, round(score, 6) AS score, CASE WHEN code IS NOT NULL THEN score < 1 END AS review FROM misread LEFT JOIN best ON a = term")
def coded_words(spark, sf_dir):
    """Each part's misread word with the code of the word that it fits best, the words of the tables being the dimension."""
    tables(spark, sf_dir, "part", "pages")
    words = spark.sql(_WORDS["spark"]).where("length(w) > 2").withColumn("n", F.row_number().over(Window.orderBy("w")))
    alias = words.select(F.col("n").alias("row_no"), F.lit(0).alias("ord"), F.col("w").alias("alias"), F.concat(F.lit("c"), F.col("n").cast("string")).alias("code"), F.col("w").alias("display"))
    rows = spark.sql(_MISREAD.format(first=_FIRST["spark"])).select("p_partkey", "term")
    return coding.fuzzy_lookup(rows, "term", alias).select("p_partkey", "term", "code", F.round("score", 6).alias("score"), "review")


@query(f"WITH RECURSIVE misread AS ({_MISREAD.format(first=_FIRST['duckdb'])}), asked AS (SELECT m.p_partkey, m.term, lower(regexp_replace(p.p_name || p.p_brand, '[^A-Za-z0-9]', '', 'g')) AS text FROM misread m JOIN part p ON p.p_partkey = m.p_partkey + m.p_size % 3), hay AS (SELECT DISTINCT term, text FROM asked WHERE NOT contains(text, term)), win AS (SELECT DISTINCT term, text, substr(text, k, s) AS w FROM hay, unnest(range(greatest(3, length(term) - 2), length(term) + 3)) AS a(s), unnest(range(1, length(text) - s + 2)) AS b(k)), {_ratios('SELECT DISTINCT w AS a, term AS b FROM win')}, found AS (SELECT term, text, max(ratio) >= {metrics.MATCH} AS fuzzy FROM win JOIN ratios ON a = w AND b = term GROUP BY 1, 2) SELECT p_partkey, contains(text, term) AS strict, contains(text, term) OR fuzzy AS fuzzy FROM asked LEFT JOIN found USING (term, text)")
def misread_names_found(spark, sf_dir):
    """Whether each part's misread word stands in a neighbour's name, as it is or alike; names come from the rows."""
    tables(spark, sf_dir, "part")
    rows = spark.sql(_MISREAD.format(first=_FIRST["spark"])).withColumn("of", F.col("p_partkey") + F.col("p_size") % 3)
    asked = rows.join(spark.sql("SELECT p_partkey AS of, p_name || p_brand AS text FROM part"), "of")
    return metrics.found_in(asked, "term", "text").select("p_partkey", "strict", "fuzzy")


#: Lines of a page, and names looked for: one that is there, one read badly, one that isn't there.
_PAGE = [f"{form} {r[2]}" for r, form in zip(DRUGS[1::4], ["Tab.", "Cap", "1. Tab", "Syp."] * 3)]
_LOOKED = [(r[2], r[2][0] + r[2][2:], "Zzyzx") for r in DRUGS[1::4]]


def _window(needle: str, hay: str) -> float:
    """The best ratio of the shorter in windows of the longer, of up to two letters more or less, by brute force."""
    a, b = sorted((needle, hay), key=len)
    if not a or a in b:
        return 1.0 if a else 0.0
    sizes = {n for n in range(len(a) - 2, len(a) + 3) if 3 <= n <= len(b)} or {len(b)}
    return max(_ratio(b[k : k + n], a) for n in sizes for k in range(len(b) - n + 1))


def _alnum(x: str) -> str:
    return "".join(c for c in x.lower() if c.isalnum())


def _looked() -> list[tuple]:
    """(page, which name, strict, fuzzy, code) of each page and name."""
    codes = {_alnum(r[2]): r[4] for r in reversed(dims.seed_rows("drug_alias"))}
    return [(i, k, int(_alnum(n) in _alnum(_PAGE[i])), int(_window(_alnum(n), _alnum(_PAGE[i])) >= metrics.MATCH), codes.get(_alnum(n))) for i, names in enumerate(_LOOKED) for k, n in enumerate(names)]


def _pages(spark, sf_dir):
    tables(spark, sf_dir, "lineitem")
    at, which = f"CAST(l_partkey % {len(_PAGE)} AS INT)", "CAST(l_suppkey % 3 AS INT)"
    name = "CASE " + " ".join(f"WHEN {which} = {k} THEN {pick(at, [n[k] for n in _LOOKED])}" for k in range(3)) + " END"
    return spark.sql(for_spark(f"SELECT {DOC} AS document_id, {pick(at, _PAGE)} AS text, {name} AS name FROM lineitem"))


_LOOKED_AT = f"x.i = l_partkey % {len(_PAGE)} AND x.k = l_suppkey % 3"


@query(lambda: f"SELECT {DOC} AS document_id, strict = 1 AS strict, fuzzy = 1 AS fuzzy FROM lineitem JOIN {values(_looked(), 'i, k, strict, fuzzy, code', 'l')} AS x ON {_LOOKED_AT}")
def fuzzy_found(spark, sf_dir):
    return metrics.found_in(_pages(spark, sf_dir), "name", "text").select("document_id", "strict", "fuzzy")


@query(lambda: f"SELECT l_returnflag AS grp, count(*) AS names, round(avg(strict), 6) AS strict, round(avg(fuzzy), 6) AS fuzzy, round(coalesce(sum(CASE WHEN fuzzy = 1 AND code IS NOT NULL THEN 1 ELSE 0 END) / nullif(sum(fuzzy), 0), 0), 6) AS coded FROM lineitem JOIN {values(_looked(), 'i, k, strict, fuzzy, code', 'l')} AS x ON {_LOOKED_AT} GROUP BY 1")
def name_recalls(spark, sf_dir):
    """Shares of names found, alike and coded, by a group of pages."""
    pages = _pages(spark, sf_dir)
    groups = spark.sql(for_spark(f"SELECT {DOC} AS document_id, l_returnflag AS grp FROM lineitem"))
    found = coding.drug_lookup(metrics.found_in(pages, "name", "text"), "name", dims.load(spark, "drug_alias")).join(groups, "document_id")
    return metrics.recalls(found, ["grp"]).select("grp", "names", *(F.round(c, 6).alias(c) for c in ("strict", "fuzzy", "coded")))


#: Expected and extracted names of a document, by its number.
_LISTS = [(["Amaryl", "Telma"], ["Amarl", "Telma"]), (["Crocin"], ["Dolo", "Crocn", "Crocin"]), (["Ecosprin", "Disprin"], ["Esprin"]), ([], ["Lantus"]), (["Plavix", "Plavix"], ["Plavix"]), (["Warf", "Uniwarfin"], ["Uniwarf", "Warfin"])]


def _one_to_one_sql() -> str:
    rows = []
    for g, (expected, extracted) in enumerate(_LISTS):
        pairs = sorted(((-_window(_alnum(a), _alnum(b)), i, j) for i, a in enumerate(expected) for j, b in enumerate(extracted)))
        left, right = set(), set()
        for s, i, j in pairs:
            if -s >= metrics.MATCH and i not in left and j not in right:
                left.add(i)
                right.add(j)
                rows.append((g, i, j, float(round(-s, 6))))
    return f"SELECT o_orderkey AS document_id, a_no, b_no, score FROM orders JOIN {values(rows, 'g, a_no, b_no, score', 'l')} AS x ON x.g = o_orderkey % {len(_LISTS)}"


@query(_one_to_one_sql)
def one_to_one(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("document_id"))
    lists = [spark.createDataFrame([(g, i, n) for g, both in enumerate(_LISTS) for i, n in enumerate(both[side])], f"g int, {name}_no int, {name} string") for side, name in ((0, "a"), (1, "b"))]
    expected, extracted = (orders.withColumn("g", (F.col("document_id") % len(_LISTS)).cast("int")).join(x, "g").drop("g") for x in lists)
    return metrics.one_to_one(expected, extracted).withColumn("score", F.round("score", 6))


@query("SELECT page_id, trim(b) AS name FROM (SELECT page_id, unnest(string_split(url || '| a |b| |', '|')) AS b FROM pages) WHERE trim(b) <> ''")
def brand_names(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", F.lit("| a |b| |")).alias("brands"))
    return metrics.brands(rows, key=["page_id"])


@query("WITH e AS (SELECT vec_id, list_transform(embedding[1:30], lambda x: CAST(abs(floor(x * 400)) AS BIGINT) % 256) AS p FROM embeddings), places AS (SELECT vec_id, p, unnest([8, 9, 10, 11, 14, 15, 16, 17, 20, 21, 22, 23]) AS i FROM e), lap AS (SELECT vec_id, (p[i - 6] + p[i + 6] + p[i - 1] + p[i + 1] - 4 * p[i])::DOUBLE AS v FROM places), v AS (SELECT vec_id, var_pop(v) AS s FROM lap GROUP BY 1), f AS (SELECT vec_id, s, list_avg(p) AS b FROM e JOIN v USING (vec_id)) SELECT vec_id, round(s, 2) AS sharpness, round(b, 2) AS brightness, CASE WHEN s < 100 THEN 'blurry - ask for a retake' WHEN b < 60 THEN 'too dark - ask for a retake' WHEN b > 225 THEN 'overexposed - ask for a retake' ELSE 'ok' END AS verdict FROM f")
def image_verdicts(spark, sf_dir):
    """Vectors as images of six by five."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.lit(6).alias("width"), F.lit(5).alias("height"), F.transform(F.slice("embedding", 1, 30), lambda x: F.pmod(F.abs(F.floor(x.cast("double") * 400)).cast("long"), F.lit(256))).alias("pixels"))
    return ocr.image_quality(rows, ["vec_id"])


# Sources.
@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'text' ELSE 'bytes' END AS source, CASE WHEN turn % 2 = 0 THEN 0.99::DOUBLE END AS mean_confidence, CASE WHEN turn % 2 = 1 THEN octet_length(encode(text))::BIGINT END AS n_bytes FROM conversations")
def resolved_sources(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"), F.base64(F.encode("text", "utf-8")).alias("data_base64"))
    return scan.resolve(rows).select("conv_id", "turn", "source", "mean_confidence", F.octet_length("content").cast("long").alias("n_bytes"))


@query("SELECT page_id, sha256(html) AS sha FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 2 = 0)")
def uncached_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("content", F.encode("html", "utf-8"))
    cache = pages.where("page_id % 2 = 0").select(F.sha2("content", 256).alias("sha"))
    return scan.uncached(pages, cache).select("page_id", "sha")


@query("WITH c AS (SELECT page_id, sha256(html) AS sha, length(html) % 5 = 0 AS failed, length(html) AS n FROM pages) SELECT page_id, sha, CASE WHEN failed THEN 2 ELSE 1 END::BIGINT AS n_read, NOT failed AS cached, n || ' letters' AS text FROM c")
def recognised_pages(spark, sf_dir):
    """Two passes over pages: the second reads only what failed in the first, and the cache holds the rest, each content once."""
    base = scratch(spark, "cache")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.encode("html", "utf-8").alias("content"))

    def recogniser(rows):
        n = F.char_length(F.decode("content", "utf-8"))
        return rows.select("sha", F.concat(n.cast("string"), F.lit(" letters")).alias("text"), F.lit(0.9).alias("mean_confidence"), (n % 5 == 0).alias("failed"))

    _, first = cache.recognise(pages, base, recogniser)
    told, second = cache.recognise(pages, base, recogniser)
    reads = first.unionByName(second).groupBy("sha").agg(F.count(F.lit(1)).alias("n_read"))
    held = cache.read(spark, base).groupBy("sha").agg((F.count(F.lit(1)) == 1).alias("cached"))
    return told.join(reads, "sha").join(held, "sha", "left").select("page_id", "sha", "n_read", F.coalesce("cached", F.lit(False)).alias("cached"), "text")
