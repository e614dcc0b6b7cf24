"""Queries that compare whole values: bundles as canonical JSON, histories with all their sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators import abnormal, fhir, summary, timeline
from chartloom.plans import documents, sessions
from chartloom.plans.inputs import ALIAS, ANALYTE, DOC, DRUGS, HIGH, LABS, LOW, QTY, cte, for_spark, make, pick, tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_UNITS = ["mg/dL", "cells/cumm", "mmHg", "U/L", "%", "lakhs/cumm", "degF"]
_CODES = ["mg/dL", None, "mm[Hg]", "U/L", "%", None, "[degF]"]
_UNIT = pick("CAST(l_partkey % 7 AS INT)", _UNITS)
_KIND = "CASE WHEN l_suppkey % 4 = 0 THEN 'medication' WHEN l_suppkey % 4 = 1 THEN 'lab' WHEN l_suppkey % 4 = 2 THEN 'vital' ELSE 'diagnosis' END"
_LAB = pick("CAST(l_partkey % 8 AS INT)", [r[2] for r in LABS])
_LAB_CODE = pick("CAST(l_partkey % 8 AS INT)", [r[3] for r in LABS])
_LAB_NAME = pick("CAST(l_partkey % 8 AS INT)", [r[4] for r in LABS])

#: Documents of orders with what was found in them: of one document in three only drugs, labs or vitals, or nothing.
_PAGES = "SELECT o_orderkey AS document_id, o_custkey AS session, CASE WHEN o_orderkey % 4 = 0 THEN 'lab' ELSE 'note' END AS suggested_type, 'Title ' || o_orderpriority AS suggested_title, CASE WHEN o_orderkey % 7 <> 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 10) END AS clinical_date, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS mean_confidence FROM orders"
_ENTITIES = (
    f"SELECT o_orderkey AS document_id, {DOC} AS entity_no, kind, CASE kind WHEN 'medication' THEN drug WHEN 'lab' THEN lab WHEN 'vital' THEN 'Pulse' ELSE 'Fever' END AS text, "
    "CASE kind WHEN 'lab' THEN 'LOINC' WHEN 'medication' THEN 'RxNorm' END AS system, CASE kind WHEN 'lab' THEN lab_code WHEN 'medication' THEN drug_code END AS code, CASE kind WHEN 'lab' THEN lab_name WHEN 'medication' THEN generic END AS display, "
    f"CASE WHEN kind IN ('lab', 'vital') AND l_linenumber % 3 <> 0 THEN CAST({QTY} AS DOUBLE) / 4 END AS value_num, CASE WHEN kind = 'lab' THEN 'trace' END AS value_str, CASE WHEN kind = 'lab' THEN unit END AS unit, "
    "CASE WHEN kind <> 'lab' THEN NULL WHEN l_linenumber % 4 = 0 THEN 'negative' WHEN l_linenumber % 4 = 1 THEN '5-9.5' END AS reference_range, CAST(l_linenumber % 10 AS DOUBLE) / 10 AS confidence "
    f"FROM (SELECT *, {_KIND} AS kind, {ALIAS} AS drug, {pick('CAST(l_partkey % 40 AS INT)', [r[3] for r in DRUGS])} AS generic, {pick('CAST(l_partkey % 40 AS INT)', [r[4] for r in DRUGS])} AS drug_code, {_LAB} AS lab, {_LAB_CODE} AS lab_code, {_LAB_NAME} AS lab_name, {_UNIT} AS unit FROM orders JOIN lineitem ON o_orderkey = l_orderkey) x WHERE o_orderkey % 3 <> 0 OR l_linenumber < 2"
)


def _object(**parts: str) -> str:
    """SQL text of a JSON object with its keys in order; a part that is null is left out."""
    return "'{' || array_to_string(list_filter([" + ", ".join(f"'\"{k.strip('_')}\":' || {v}" for k, v in sorted(parts.items())) + "], lambda x: x IS NOT NULL), ',') || '}'"


def _text(x: str) -> str:
    return f"'\"' || {x} || '\"'"


def _number(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::VARCHAR END)"


def _list(x: str) -> str:
    return f"'[' || {x} || ']'"


def _fixed(x: str) -> str:
    return "'\"" + x + "\"'"


_SURE = _list(_object(url=_fixed("urn:chartloom:confidence"), valueDecimal=_number("confidence")))
_URL = "CASE system " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fhir.SYSTEMS.items()) + " END"
_CONCEPT = _object(coding=f"CASE WHEN code IS NOT NULL THEN {_list(_object(code=_text('code'), display=_text('display'), system=_text(_URL)))} END", text=_text("{name}"))
_CODE = "CASE unit " + " ".join(f"WHEN '{u}' THEN '{c}'" for u, c in zip(_UNITS, _CODES) if c) + " END"
_SIDE = lambda v: _object(unit=_text("coalesce(unit, '')"), value=v)
_OBSERVATION = _object(
    resourceType=_fixed("Observation"), status=_fixed("preliminary"), id="part_id", effectiveDateTime=_text("clinical_date"), extension=_SURE, code=_CONCEPT.replace("{name}", "text"),
    category=_list(_object(coding=_list(_object(code="CASE kind WHEN 'lab' THEN '\"laboratory\"' ELSE '\"vital-signs\"' END", system=_fixed(fhir.CATEGORY))))),
    valueQuantity=f"CASE WHEN value_num IS NOT NULL THEN {_object(code=_text(_CODE), system=_fixed('http://unitsofmeasure.org'), unit=_text(chr(99) + 'oalesce(unit, ' + chr(39) * 2 + ')'), value=_number('value_num'))} END",
    valueString=f"CASE WHEN value_num IS NULL THEN {_text('value_str')} END",
    referenceRange=f"CASE reference_range WHEN '5-9.5' THEN {_list(_object(high=_SIDE(chr(39) + '9.5' + chr(39)), low=_SIDE(chr(39) + '5' + chr(39))))} WHEN 'negative' THEN {_list(_object(text=_fixed('negative')))} END",
)
_REQUEST = _object(resourceType=_fixed("MedicationRequest"), status=_fixed("draft"), intent=_fixed("order"), authoredOn=_text("clinical_date"), extension=_SURE, medicationCodeableConcept=_CONCEPT.replace("{name}", "coalesce(display, value_str, text)"), dosageInstruction=_list(_object(text=_text("text"))))
_STATUS = lambda kind, code: _object(coding=_list(_object(code=_fixed(code), system=_fixed(f"http://terminology.hl7.org/CodeSystem/{kind}"))))
_CONDITION = _object(resourceType=_fixed("Condition"), clinicalStatus=_STATUS("condition-clinical", "active"), verificationStatus=_STATUS("condition-ver-status", "provisional"), code=_CONCEPT.replace("{name}", "text"), onsetDateTime=_text("clinical_date"), extension=_SURE)
_REPORT = _object(resourceType=_fixed("DiagnosticReport"), status=_fixed("preliminary"), code=_object(text=_text("suggested_title")), effectiveDateTime=_text("clinical_date"), extension=_SURE, contained=_list("array_to_string(coalesce(parts, []), ',')"), result=_list("array_to_string(list_transform(range(1, len(coalesce(parts, [])) + 1), lambda i: '{\"reference\":\"#obs-' || i || '\"}'), ',')"))
_REFERENCE = _object(resourceType=_fixed("DocumentReference"), status=_fixed("current"), docStatus=_fixed("preliminary"), description=_text("suggested_title"), date=_text("clinical_date"), extension=_SURE)
_SIDES = [_object(display=_text(x)) for x in ("drug_a", "drug_b")]
_ISSUE = _object(resourceType=_fixed("DetectedIssue"), status=_fixed("preliminary"), severity="CASE severity WHEN 'contraindicated' THEN '\"high\"' WHEN 'major' THEN '\"high\"' WHEN 'minor' THEN '\"low\"' ELSE '\"moderate\"' END", code=_object(text=_fixed("Drug-drug interaction")), implicated=_list(f"{_SIDES[0]} || ',' || {_SIDES[1]}"), detail=_text("description"))

_BUNDLES = f"""{documents._ALERTS}, pages AS ({_PAGES}), entities AS ({_ENTITIES}),
part AS (SELECT e.*, p.clinical_date, CASE kind WHEN 'medication' THEN 'meds' WHEN 'diagnosis' THEN 'dx' ELSE 'obs' END AS g FROM entities e JOIN pages p USING (document_id)),
per AS (SELECT document_id, count(*) FILTER (WHERE g = 'obs') AS obs, count(*) FILTER (WHERE g = 'meds') AS meds, count(*) FILTER (WHERE g = 'dx') AS dx FROM part GROUP BY 1),
doc AS (SELECT p.*, CASE WHEN suggested_type = 'lab' OR (coalesce(obs, 0) > 0 AND coalesce(meds, 0) = 0) THEN 'obs' WHEN coalesce(meds, 0) > 0 THEN 'meds' WHEN coalesce(dx, 0) > 0 THEN 'dx' ELSE 'none' END AS which, coalesce(obs, 0) AS obs FROM pages p LEFT JOIN per USING (document_id)),
made AS (SELECT part.*, d.session, d.which, row_number() OVER (PARTITION BY document_id ORDER BY entity_no) AS i, CASE WHEN which = 'obs' AND d.obs > 1 THEN '"obs-' || row_number() OVER (PARTITION BY document_id ORDER BY entity_no) || '"' END AS part_id FROM part JOIN doc d USING (document_id) WHERE g = which),
json AS (SELECT session, document_id, which, i, CASE which WHEN 'obs' THEN {_OBSERVATION} WHEN 'meds' THEN {_REQUEST} ELSE {_CONDITION} END AS j FROM made),
grouped AS (SELECT document_id, list(j ORDER BY i) AS parts FROM json GROUP BY 1),
top AS (SELECT session, document_id AS spot, 0::BIGINT AS i, CASE WHEN which = 'none' THEN {_REFERENCE} WHEN len(parts) = 1 THEN parts[1] ELSE {_REPORT} END AS j FROM (SELECT doc.*, mean_confidence AS confidence, parts FROM doc LEFT JOIN grouped USING (document_id)) WHERE which IN ('none', 'obs')),
flat AS (SELECT session, 0 AS g, spot, i, j FROM top UNION ALL SELECT session, 0, document_id, i, j FROM json WHERE which IN ('meds', 'dx') UNION ALL SELECT session_id, 1, rank_no, 0, {_ISSUE} FROM ranked WHERE session_id IN (SELECT session FROM pages)),
bundle AS (SELECT session, count(*) AS total, count(*) FILTER (WHERE g = 1) AS n_issues, count(*) FILTER (WHERE j LIKE '%"resourceType":"DiagnosticReport"%') AS n_reports,
  '{{"entry":[' || string_agg('{{"resource":' || j || '}}', ',' ORDER BY g, spot, i) || '],"meta":{{"tag":[{{"code":"draft"}}]}},"resourceType":"Bundle","total":' || count(*) || ',"type":"collection"}}' AS j FROM flat GROUP BY 1)"""


def _pages(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "orders", "lineitem")
    return spark.sql(_PAGES)


def _bundles(spark, sf_dir: str) -> DataFrame:
    """Each session's bundle as canonical JSON, with the interactions that its drugs have."""
    pages = _pages(spark, sf_dir)
    made = fhir.resources(pages, spark.sql(for_spark(_ENTITIES)), ["document_id"], ordered=True, along=("session",))
    alerts = documents._alerts(spark, sf_dir).withColumnRenamed("session_id", "session")
    return fhir.patient_bundle(made, alerts, pages.select("session").distinct(), ["session"], "document_id", ordered=True)


@query(f"WITH {_BUNDLES} SELECT session, total, md5(j) AS digest FROM bundle")
def whole_bundles(spark, sf_dir):
    """A digest of each whole bundle as canonical JSON: resources, codes, references, provenance, issues."""
    return _bundles(spark, sf_dir).select("session", "total", F.md5("bundle").alias("digest"))


@query(f"WITH {_BUNDLES} SELECT session, n_issues, n_reports FROM bundle")
def bundle_entries(spark, sf_dir):
    """What bundles hold, read as variant values."""
    rows = fhir.entries(_bundles(spark, sf_dir), ["session"])
    draft = F.variant_get("resource", "$.status", "string")
    return rows.groupBy("session").agg(F.count_if((F.col("resource_type") == "DetectedIssue") & (draft == "preliminary")).alias("n_issues"), F.count_if(F.col("resource_type") == "DiagnosticReport").alias("n_reports"))


# Histories: what documents and interviews say, in one draft a session.
_RANGE = f"{LOW} || '.0-' || {HIGH} || '.0'"
_FLAG = f"flag AS (SELECT o_custkey AS session, 0 AS g, '  - ' || {ANALYTE} || ': ' || {QTY} || '.0 mg/dL (' || CASE WHEN {QTY} > {HIGH} THEN 'high' ELSE 'low' END || ', reference ' || {_RANGE} || ')' AS line, o_orderkey AS a, {DOC} AS b, o_orderkey AS document_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey % 5 <> 0 AND ({QTY} > {HIGH} OR {QTY} < {LOW}))"
_ALERT = "warned AS (SELECT session_id AS session, 2 AS g, '  - ' || drug_a || ' + ' || drug_b || ': ' || description || ' (' || severity || ')' AS line, rank_no AS a, 0 AS b, NULL::BIGINT AS document_id FROM ranked)"


def _prior() -> str:
    """The prior section's CTEs with flags and warnings worked out from the tables."""
    text = sessions._PRIOR
    for name, following, made in (("flag AS (", ", doc AS (", _FLAG), ("alert AS (", ", block AS (", _ALERT)):
        start = text.index(name)
        text = text[:start] + made + text[text.index(following, start) :]
    return text.replace("SELECT * FROM alert", "SELECT * FROM warned")


#: What options are called.
LABELS = {"asthma": "Bronchial asthma", "tea": "Tea", "fever": "High fever", "chest": "Chest", "nausea": "Nausea"}
_INTERVIEW = sessions.SQL["interview_sections"].replace("conditions: asthma", "conditions: Bronchial asthma").replace("habits: tea", "habits: Tea").replace("complaint: fever", "complaint: High fever").replace("in the chest", "in the Chest").replace("with: nausea", "with: Nausea")
_HEADINGS = ("chief_complaint", "hpi", "past_medical", "past_surgical", "family", "personal", "ros", "ayurvedic_assessment")
_HISTORY = f"""{documents._ALERTS}, {cte('entries')}, {_prior()},
placed AS (SELECT session, document_id, row_number() OVER (PARTITION BY session ORDER BY date ASC NULLS LAST, CASE kind WHEN 'note' THEN 0 WHEN 'imaging' THEN 2 WHEN 'lab' THEN 3 WHEN 'allergy' THEN 4 ELSE 5 END, lower(title), seq) AS pos, kind, title, date FROM entries),
line AS (SELECT session, 0 AS g, -pos AS p, entity_no AS e, f.text || CASE WHEN confidence < 0.6 THEN ' (as read; low confidence)' ELSE '' END || ' — ' || coalesce(strftime(date, '%Y-%m-%d'), 'undated') AS en, confidence FROM found f JOIN placed USING (session, document_id) WHERE f.kind = 'medication'
  UNION ALL SELECT session, 1, pos, 0, 'Allergy record on file: "' || title || '" — ' || coalesce(strftime(date, '%Y-%m-%d'), 'undated'), NULL FROM placed WHERE kind = 'allergy'),
drugs AS (SELECT s.session, coalesce(string_agg(line.en, chr(10) ORDER BY line.g, p, e), 'No medications or allergy records found among the documents provided.') AS en, coalesce(avg(confidence), 0) AS confidence FROM s LEFT JOIN line USING (session) GROUP BY 1),
sure AS (SELECT session, avg(confidence) AS confidence FROM entries GROUP BY 1),
asked AS ({_INTERVIEW}),
sections AS (SELECT session, 0 AS side, 0 AS position, 'drugs_allergy' AS heading, en, confidence FROM drugs
  UNION ALL SELECT session, 0, 1, 'prior_investigations', coalesce(en, 'No prior investigation reports found among the documents provided.'), CASE WHEN en IS NULL THEN 0 ELSE confidence END FROM s LEFT JOIN whole USING (session) LEFT JOIN sure USING (session)
  UNION ALL SELECT session, 1, list_position({list(_HEADINGS)}, heading), heading, en, confidence FROM asked),
open AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 2 = 0 THEN ['pain.where'] ELSE [] END || CASE WHEN u > 0 THEN [u || ' unreadable documents'] ELSE [] END || ['sleep'] AS points FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS u FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query(f"WITH {_HISTORY} SELECT session, 'draft' AS status, count(*) AS n_sections, md5(string_agg(heading || '|' || en || '|' || round(confidence * 10000000)::BIGINT, chr(10) ORDER BY side, position)) AS sections_md5, array_to_string(any_value(points) || list(heading || ': nothing recorded' ORDER BY position) FILTER (WHERE side = 1 AND confidence = 0), '; ') AS gaps, round(coalesce(avg(confidence) FILTER (WHERE confidence > 0), 0), 9) AS mean_confidence FROM sections FULL JOIN open USING (session) GROUP BY session")
def histories(spark, sf_dir):
    """Every session's draft: ten sections with option labels, flags and warnings from their operators, and all that stays open."""
    entries = timeline.order(make(spark, sf_dir, "entries"), ["session"])
    found = sessions._found(spark, sf_dir)
    tables(spark, sf_dir, "orders", "lineitem", "customer")
    none = {c: F.lit(None).cast("string") for c in ("curated_range", "curated_unit")}
    labs = spark.sql(for_spark(f"SELECT o_custkey AS session, o_orderkey AS document_id, {DOC} AS entity_no, {ANALYTE} AS text, CAST({QTY} AS DOUBLE) AS value_num, 'mg/dL' AS unit, {LOW} || '-' || {HIGH} AS reference_range FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey % 5 <> 0")).withColumns(none)
    flags = abnormal.flags(abnormal.judge(labs)).withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("document_id", "entity_no")))
    alerts = documents._alerts(spark, sf_dir).withColumnRenamed("session_id", "session")
    who = entries.select("session").distinct()
    sure = entries.groupBy("session").agg(F.avg("confidence").alias("mean_confidence"))
    drugs, prior = summary.drug_section(entries, found, who, ["session"]), summary.prior_section(entries, flags, alerts, sure, ["session"])
    part = lambda df, n: df.select("session", F.lit(n).alias("position"), "heading", "en", "confidence")
    told = summary.interview_sections(spark.sql(sessions.INTERVIEWS), ["session"], LABELS)
    unread = spark.sql("SELECT o_custkey AS session, count_if(o_orderkey % 5 = 0) AS u FROM orders GROUP BY 1")
    open_ = spark.sql("SELECT c_custkey AS session, CASE WHEN c_custkey % 2 = 0 THEN array('pain.where') ELSE array() END AS unanswered, array('sleep') AS not_explored FROM customer")
    warned = unread.select("session", F.when(F.col("u") > 0, F.array(F.concat(F.col("u").cast("string"), F.lit(" unreadable documents")))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    out = summary.history(part(drugs, 0).unionByName(part(prior, 1)), told, open_, warned, ["session"])
    line = F.transform("sections", lambda x: F.concat(x["heading"], F.lit("|"), x["en"], F.lit("|"), F.round(x["confidence"] * 10_000_000).cast("long").cast("string")))
    return out.select("session", "status", F.size("sections").cast("long").alias("n_sections"), F.md5(F.array_join(line, "\n")).alias("sections_md5"), F.array_join("gaps", "; ").alias("gaps"), F.round("mean_confidence", 9).alias("mean_confidence"))
