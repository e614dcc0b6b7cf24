"""Queries over document operators: normalisation, dates, doses, extraction, coding, abnormal results."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chartloom.functions import dates, dosing, text
from chartloom.lineage import scratch
from chartloom.operators import abnormal, coding, extract
from chartloom.plans import bundle
from chartloom.plans.inputs import ALIAS, ANALYTE, DAYS, DOC, DRUGS, FORM, GENERIC, HIGH, LABS, LOW, QTY, SENTENCE, SLOT, STRENGTH, TODAY, cte, for_spark, make, pick, tables, values
from chartloom.sources import dims
from chartloom.sources.dims import seed_rows

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DASHES = "".join(f"chr({ord(c)}) || " for c in text.DASHES).removesuffix(" || ")


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), {_DASHES} || '`*', '-------'), '[ \t\x{{00a0}}]+', ' ', 'g'), '(^|\n) ', '\1', 'g'), ' (\n|$)', '\1', 'g') AS clean FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def normalize_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.normalize_text(F.col("text")).alias("clean"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS look_up, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS alnum, regexp_replace(lower(text), '[^a-z0-9\x{0900}-\x{097f}]+', '', 'g') AS entity FROM conversations""")
def text_keys(spark, sf_dir):
    x = F.col("text")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.lookup_key(x).alias("look_up"), text.alnum_key(x).alias("alnum"), text.entity_chars(x).alias("entity"))


@query(f"WITH {cte('dated_docs')} SELECT document_id, CAST(o_orderdate AS DATE) AS value, CASE WHEN day(o_orderdate) <= 12 THEN 0.7 ELSE 0.95 END AS confidence FROM dated_docs JOIN orders ON o_orderkey = document_id")
def best_dates(spark, sf_dir):
    return dates.best_date(make(spark, sf_dir, "dated_docs"), ["document_id"])


_CANDIDATES = f"""cand AS (
  SELECT o_orderkey AS document_id, 0 AS pos, CAST(o_orderdate AS DATE) AS iso, {pick("CAST(o_orderkey % 4 AS INT)", [1.0, 0.45, 0.35, 0.85], False)} AS score, {pick("CAST(o_orderkey % 4 AS INT)", ["collected on", "printed on", "", "date"])} AS label FROM orders
  UNION ALL SELECT o_orderkey, 1, DATE '1999-06-05', 0.7, 'reported on' FROM orders WHERE o_custkey % 3 = 1)"""


@query(f"WITH {_CANDIDATES} SELECT document_id, pos::BIGINT AS pos, iso, score::DOUBLE AS score, label FROM cand")
def date_candidates(spark, sf_dir):
    found = dates.date_candidates(make(spark, sf_dir, "dated_docs").select("document_id", "text"), TODAY)
    return found.select("document_id", F.col("pos").cast("long").alias("pos"), "iso", "score", F.coalesce("label", F.lit("")).alias("label"))


@query(f"""WITH {_CANDIDATES}, top AS (SELECT *, max(score) OVER (PARTITION BY document_id) AS best FROM cand)
SELECT document_id, min(iso) AS clinical_date, round(CAST(max(best) * 0.9 * CASE WHEN count(DISTINCT iso) > 1 THEN 0.6 ELSE 1 END AS DOUBLE), 6) AS date_confidence, CASE WHEN count(DISTINCT iso) > 1 THEN 'ambiguous: ' || count(DISTINCT iso) || ' equally-labelled dates, earliest kept' WHEN max(label) = '' THEN 'unlabelled date on page' ELSE 'labelled ''' || max(label) || '''' END AS date_reason
FROM top WHERE score = best GROUP BY document_id""")
def clinical_dates(spark, sf_dir):
    out = dates.clinical_date(make(spark, sf_dir, "dated_docs"), ["document_id"], TODAY, "mean_confidence")
    return out.select("document_id", "clinical_date", F.round("date_confidence", 6).alias("date_confidence"), "date_reason")


@query(f"SELECT {DOC} AS document_id, {SENTENCE} || ', for ' || {DAYS} || ' days' AS phrase, {pick('CAST(l_suppkey % 5 AS INT)', [2.0, 3.0, 1.0, 1.5, 3.0], False)}::DOUBLE AS per_day, {STRENGTH} || 'mg' AS dose FROM lineitem")
def dose_phrases(spark, sf_dir):
    t = F.col("text")
    rest = F.regexp_extract(t, r"mg(.*)$", 1)
    return make(spark, sf_dir, "drug_docs").select("document_id", dosing.dose_phrase(rest).alias("phrase"), dosing.total_per_day(dosing.dose_slots(rest)).alias("per_day"), dosing.dose_key(t).alias("dose"))


@query("SELECT event_id, " + pick("CAST(event_id % 6 AS INT)", ["once daily", "twice daily", "three times daily", "as needed", "Q8H", "at bedtime"]) + " AS said FROM events")
def frequencies(spark, sf_dir):
    tables(spark, sf_dir, "events")
    rows = spark.sql("SELECT event_id, 'Tab X 5mg ' || " + pick("CAST(event_id % 6 AS INT)", ["OD", "bd", "TDS", "sos", "q8h", "HS"]) + " AS t FROM events")
    return rows.select("event_id", dosing.dose_phrase(F.col("t")).alias("said"))


_LAB_SQL = f"SELECT {DOC} AS document_id, 0::BIGINT AS entity_no, 'lab' AS kind, {ANALYTE} AS text, CASE WHEN l_suppkey % 5 <> 0 THEN {QTY}::DOUBLE END AS value_num, CASE WHEN l_suppkey % 5 = 0 THEN '<' || {QTY} END AS value_str, 'mg/dL' AS unit, {LOW} || '-' || {HIGH} AS reference_range, round(CAST((0.8 + 0.05 * (l_linenumber % 4)) * 0.75 AS DOUBLE), 6) AS confidence FROM lineitem"


@query(_LAB_SQL)
def lab_rows(spark, sf_dir):
    return extract.entities(make(spark, sf_dir, "lab_docs"), ["document_id"], kinds=("lab",)).select("document_id", F.lit(0).cast("long").alias("entity_no"), "kind", "text", "value_num", "value_str", "unit", "reference_range", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT {DOC} AS document_id, {FORM} || ' ' || {ALIAS} || ' ' || {STRENGTH} || 'mg ' || {SLOT} || ' x ' || {DAYS} || ' days [' || {SENTENCE} || ', for ' || {DAYS} || ' days]' AS text, {STRENGTH}::DOUBLE AS value_num, 'mg' AS unit, round(0.9 * 0.8, 6)::DOUBLE AS confidence FROM lineitem")
def drug_lines(spark, sf_dir):
    return extract.entities(make(spark, sf_dir, "drug_docs"), ["document_id"], kinds=("medication",)).select("document_id", "text", "value_num", "unit", F.round("confidence", 6).alias("confidence"))


@query(f"""SELECT {DOC} AS document_id, 'BP: ' || CAST(90 + l_quantity AS INT) || '/' || CAST(60 + l_suppkey % 30 AS INT) || ' (systolic=' || CAST(90 + l_quantity AS INT) || ', diastolic=' || CAST(60 + l_suppkey % 30 AS INT) || ')' AS text, NULL::DOUBLE AS value_num, CAST(90 + l_quantity AS INT) || '/' || CAST(60 + l_suppkey % 30 AS INT) AS value_str, 'mmHg' AS unit FROM lineitem
UNION ALL SELECT {DOC}, 'Pulse ' || CAST(60 + l_partkey % 40 AS INT) || ' bpm', CAST(60 + l_partkey % 40 AS DOUBLE), NULL, 'bpm' FROM lineitem
UNION ALL SELECT {DOC}, 'Wt: ' || CAST(40 + l_quantity AS INT) || ' kg', CAST(CAST(40 + l_quantity AS INT) AS DOUBLE), NULL, 'kg' FROM lineitem""")
def vitals(spark, sf_dir):
    return extract.rows(make(spark, sf_dir, "vital_docs"), ["document_id"], extract.vital_array(F.col("text"))).select("document_id", "text", "value_num", "value_str", "unit")


@query("""SELECT o_orderkey AS document_id, o_orderpriority AS text FROM orders UNION ALL SELECT o_orderkey, o_orderstatus || ' disease' FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'Asthma' ELSE 'Migraine' END FROM orders""")
def diagnoses(spark, sf_dir):
    return extract.rows(make(spark, sf_dir, "dx_docs"), ["document_id"], extract.diagnosis_array(F.col("text"))).select("document_id", "text")


@query(f"WITH {cte('drug_docs')} SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'note' ELSE 'prescription' END AS suggested_type, 'Untitled document' AS suggested_title, round(0.72, 6)::DOUBLE AS mean_confidence, 1::BIGINT AS n_entities FROM drug_docs")
def structure(spark, sf_dir):
    docs = make(spark, sf_dir, "drug_docs").withColumn("hint", F.when(F.col("document_id") % 3 == 0, "note"))
    found = extract.entities(docs, ["document_id"])
    return extract.structure(docs, found, ["document_id"]).select("document_id", "suggested_type", "suggested_title", F.round("mean_confidence", 6).alias("mean_confidence"), "n_entities")


@query(f"SELECT {DOC} AS document_id, {ALIAS} AS drug, {GENERIC} AS generic, {pick('CAST(l_partkey % 40 AS INT)', [r[4] for r in DRUGS])} AS code FROM lineitem")
def drug_codes(spark, sf_dir):
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(for_spark(f"SELECT {DOC} AS document_id, {ALIAS} AS drug FROM lineitem"))
    return coding.drug_lookup(rows, "drug", dims.load(spark, "drug_alias")).select("document_id", "drug", "generic", "code")


@query(f"SELECT {DOC} AS document_id, {ANALYTE} AS text, {pick('CAST(l_partkey % 8 AS INT)', [r[3] for r in LABS])} AS code, 'mg/dL' AS unit, 'LOINC' AS system, false AS review FROM lineitem")
def lab_codes(spark, sf_dir):
    found = extract.rows(make(spark, sf_dir, "lab_docs"), ["document_id"], extract.lab_array(F.col("text")))
    coded = coding.code_entities(found, *(dims.load(spark, n) for n in ("lab_alias", "drug_alias", "condition_alias")))
    return coded.select("document_id", "text", "code", "unit", "system", "review")


def _fuzzy(term: str, rows: list[tuple], least: float) -> tuple | None:
    """The best row of an alias table for a term by plain loops: (row, score)."""
    from difflib import SequenceMatcher

    found = None
    for r in rows:
        key = " ".join(re.findall("[a-z0-9]+", r[2].lower()))
        score = SequenceMatcher(None, term, key).ratio()
        if key and score >= least and (found is None or score > found[1]):
            found = r, score
    return found


_CONDITION_ROWS = seed_rows("condition_alias")
#: Condition names for fuzzy look-up: every fourth alias, with one letter dropped.
_SAID = [(f"{n}:{k}", r[2][: k + 1] + r[2][k + 2 :]) for n, r in enumerate(_CONDITION_ROWS[::4]) for k in range(6)]
_SAID_NO = f"(p_partkey % {len(_SAID)})"


def _fuzzy_terms_sql() -> str:
    made = []
    for i, (_, term) in enumerate(_SAID):
        found = _fuzzy(" ".join(re.findall("[a-z0-9]+", term.lower())), _CONDITION_ROWS, coding.FUZZY)
        made.append((i, term, found[0][3] if found else None, float(found[1]) if found else None))
    return f"SELECT p_partkey, term, code, round(score, 6) AS score, CASE WHEN code IS NOT NULL THEN score < 1 END AS review FROM part JOIN {values(made, 'i, term, code, score', 't')} AS x ON x.i = {_SAID_NO}"


@query(_fuzzy_terms_sql)
def fuzzy_terms(spark, sf_dir):
    """A misspelt condition for each part, against all aliases."""
    tables(spark, sf_dir, "part")
    rows = spark.sql(f"SELECT p_partkey, {pick(f'CAST({_SAID_NO} AS INT)', [t for _, t in _SAID])} AS term FROM part")
    return coding.fuzzy_lookup(rows, "term", dims.load(spark, "condition_alias")).select("p_partkey", "term", "code", F.round("score", 6).alias("score"), "review")


def _codes_sql() -> str:
    said = [("Asthma",), ("Migraine",), *((f"{x} disease",) for x in "FOP"), *((p,) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))]
    made = []
    for (text,) in said:
        found = _fuzzy(" ".join(re.findall("[a-z0-9]+", text.lower())), _CONDITION_ROWS, coding.FUZZY)
        made.append((text, found[0][3] if found else None, float(found[1]) if found else None))
    code = pick("CAST(l_partkey % 40 AS INT)", [r[4] for r in DRUGS])
    dx = f"SELECT document_id, 'diagnosis' AS kind, d.text, d.text AS k FROM (SELECT o_orderkey AS document_id, o_orderpriority AS text FROM orders UNION ALL SELECT o_orderkey, o_orderstatus || ' disease' FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'Asthma' ELSE 'Migraine' END FROM orders) d"
    return f"""SELECT {DOC} AS document_id, 'medication' AS kind, 'RxNorm' AS system, {code} AS code, false AS review FROM lineitem
UNION ALL SELECT document_id, kind, CASE WHEN code IS NOT NULL THEN 'SNOMED' END, code, coalesce(score < 1, false) FROM ({dx}) e LEFT JOIN {values(made, 't, code, score', 'cc')} AS c ON c.t = e.k"""


@query(_codes_sql)
def entity_codes(spark, sf_dir):
    """Drugs and diagnoses in one table, each coded by its kind's system."""
    drugs = extract.rows(make(spark, sf_dir, "drug_docs"), ["document_id"], extract.drug_array(F.col("text")))
    said = extract.rows(make(spark, sf_dir, "dx_docs"), ["document_id"], extract.diagnosis_array(F.col("text")))
    coded = coding.code_entities(drugs.unionByName(said), *(dims.load(spark, n) for n in ("lab_alias", "drug_alias", "condition_alias")))
    return coded.select("document_id", "kind", "system", "code", "review")


def _primary(alias: str) -> tuple[str, str | None]:
    """(drug_name, generic) of an alias by a plain loop over its words."""
    named = {}
    for r in seed_rows("drug_alias"):
        named.setdefault(" ".join(re.findall("[a-z0-9]+", r[2].lower())), r[3])
    words = [w for w in re.findall("[A-Za-z]+", alias) if w.lower() not in coding.NOT_NAMES]
    return next(((w, named[w.lower()]) for w in words if w.lower() in named), (words[0], None))


_PRIMARY = [_primary(r[2]) for r in DRUGS]


@query(f"SELECT {DOC} AS document_id, drug_name, generic FROM lineitem JOIN {values([(i, *p) for i, p in enumerate(_PRIMARY)], 'i, drug_name, generic', 'p')} AS x ON x.i = l_partkey % 40")
def primary_drugs(spark, sf_dir):
    return coding.primary_drug(make(spark, sf_dir, "drug_docs"), ["document_id"], "text", dims.load(spark, "drug_alias"))


# Pages with everything on them: a facility, a labelled date in words or figures, a reversed drug line, all vitals, Hindi labels.
_MONTH = ["Jan", "February", "Mar", "April", "May", "June", "Jul", "August", "Sept", "Oct", "November", "Dec"]
_MIXED_DATE = f"CASE WHEN o_orderkey % 3 = 0 THEN 'Date: ' || CAST(day(o_orderdate) AS VARCHAR(2)) || ' ' || {pick('CAST(month(o_orderdate) - 1 AS INT)', _MONTH)} || ' ' || CAST(year(o_orderdate) AS VARCHAR(4)) WHEN o_orderkey % 3 = 1 THEN 'Date: ' || lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0') || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0') || '-' || CAST(year(o_orderdate) AS VARCHAR(4)) ELSE 'Date: 31/02/2001' END"
_PLACE = pick("CAST(o_custkey % 3 AS INT)", ["Sunrise Clinic", "Asha Hospital", "Nobody's notes"])
_MIXED = f"""SELECT o_orderkey AS document_id, o_custkey AS session, 0.9 AS mean_confidence, {_PLACE} || chr(10) || {_MIXED_DATE} || chr(10) || 'Neutral powder after meals' || chr(10) ||
 'Temp: ' || CAST(97 + o_custkey % 8 AS VARCHAR(3)) || ' F' || chr(10) || 'SpO2 ' || CAST(90 + o_custkey % 10 AS VARCHAR(3)) || '%' || chr(10) || 'Ht: ' || CAST(150 + o_custkey % 40 AS VARCHAR(3)) || ' cm' || chr(10) ||
 'RR ' || CAST(12 + o_custkey % 9 AS VARCHAR(2)) || ' /min' || chr(10) || 'वजन ' || CAST(40 + o_custkey % 50 AS VARCHAR(3)) || ' किलो' AS text FROM orders"""


def _mixed(spark, sf_dir):
    tables(spark, sf_dir, "orders")
    return spark.sql(_MIXED)


@query("""SELECT o_orderkey AS document_id, 'Temp: ' || (97 + o_custkey % 8) || ' F' AS text, (97 + o_custkey % 8)::DOUBLE AS value_num, 'F' AS unit FROM orders
UNION ALL SELECT o_orderkey, 'SpO2 ' || (90 + o_custkey % 10) || '%', (90 + o_custkey % 10)::DOUBLE, '%' FROM orders
UNION ALL SELECT o_orderkey, 'Ht: ' || (150 + o_custkey % 40) || ' cm', (150 + o_custkey % 40)::DOUBLE, 'cm' FROM orders
UNION ALL SELECT o_orderkey, 'RR ' || (12 + o_custkey % 9) || ' /min', (12 + o_custkey % 9)::DOUBLE, '/min' FROM orders
UNION ALL SELECT o_orderkey, 'वजन ' || (40 + o_custkey % 50) || ' किलो', (40 + o_custkey % 50)::DOUBLE, 'किलो' FROM orders""")
def other_vitals(spark, sf_dir):
    return extract.rows(_mixed(spark, sf_dir), ["document_id"], extract.vital_array(F.col("text"))).select("document_id", "text", "value_num", "unit")


#: Names of months count if they have three or four letters.
_DATED = f"(o_orderkey % 3 = 1 OR o_orderkey % 3 = 0 AND month(o_orderdate) IN ({', '.join(str(i + 1) for i, m in enumerate(_MONTH) if len(m) < 5)}))"


@query(f"SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS value, o_orderkey % 3 = 1 AND day(o_orderdate) <= 12 AS ambiguous FROM orders WHERE {_DATED}")
def date_entities(spark, sf_dir):
    """Dates with month names and figures; a day that no month has is none."""
    found = extract.rows(_mixed(spark, sf_dir), ["document_id"], extract.date_array(F.col("text")))
    return found.select("document_id", F.col("value_str").cast("date").alias("value"), (F.col("rule") == "date_assumed_dmy").alias("ambiguous"))


@query(f"SELECT o_orderkey AS document_id, CASE WHEN o_custkey % 3 < 2 THEN {_PLACE} END AS facility, CASE WHEN o_custkey % 3 < 2 THEN 'Prescription — ' || {_PLACE} ELSE 'Untitled document' END AS title, 'prescription' AS kind, 'Neutral powder after meals' AS drug FROM orders")
def mixed_documents(spark, sf_dir):
    """Facility, title and type of pages whose only drug line has the form behind the name."""
    docs = _mixed(spark, sf_dir).withColumn("hint", F.lit(None).cast("string"))
    found = extract.entities(docs, ["document_id"])
    drugs = found.where("kind = 'medication'").select("document_id", F.col("text").alias("drug"))
    return extract.structure(docs, found, ["document_id"]).join(drugs, "document_id").select("document_id", "facility", F.col("suggested_title").alias("title"), F.col("suggested_type").alias("kind"), "drug")


@query(f"SELECT o_orderkey AS document_id, CASE WHEN {_DATED} THEN CAST(o_orderdate AS DATE) END AS date, 'prescription' AS kind, 7 + {_DATED}::INT + (o_custkey % 3 < 2)::INT AS n_entities FROM orders")
def ingested_documents(spark, sf_dir):
    """One entry a document, its date the extraction's own: a drug, five vital signs (one of which reads as a laboratory row too), and a facility and a date where there are any."""
    docs = _mixed(spark, sf_dir).withColumn("hint", F.lit(None).cast("string"))
    return bundle.ingest(docs, TODAY).select("document_id", "date", "kind", F.col("n_entities").cast("int").alias("n_entities"))


_DIM = values([(r[2].lower(), r[3]) for r in dims.seed_rows("drug_alias")], "alias, generic", "dd")
_PAIRS = values([(r[0], *sorted((r[1], r[2])), r[3], r[4]) for r in dims.seed_rows("interaction")], "row_no, lo, hi, severity, description", "ii")
_ALERTS = f"""{cte('session_drugs')}, named AS (SELECT session_id, pos, generic AS k FROM session_drugs JOIN {_DIM} AS d ON lower(drug) = alias),
place AS (SELECT session_id, k, min(pos) AS pos FROM named GROUP BY 1, 2),
alert AS (SELECT a.session_id, severity, CASE WHEN a.pos < b.pos THEN a.k ELSE b.k END AS drug_a, CASE WHEN a.pos < b.pos THEN b.k ELSE a.k END AS drug_b, description, least(a.pos, b.pos) AS p, greatest(a.pos, b.pos) AS q FROM place a JOIN {_PAIRS} AS i ON a.k = lo JOIN place b ON b.session_id = a.session_id AND b.k = hi),
ranked AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE severity WHEN 'contraindicated' THEN 0 WHEN 'major' THEN 1 WHEN 'moderate' THEN 2 WHEN 'minor' THEN 3 ELSE 9 END, p, q) AS rank_no, severity, drug_a, drug_b, description FROM alert)"""


def _alerts(spark, sf_dir):
    return coding.interactions(make(spark, sf_dir, "session_drugs"), ["session_id"], dims.load(spark, "drug_alias"), dims.load(spark, "interaction"))


@query(f"WITH {_ALERTS} SELECT * FROM ranked")
def interactions(spark, sf_dir):
    return _alerts(spark, sf_dir).withColumn("rank_no", F.col("rank_no").cast("long"))


@query(f"""WITH {_ALERTS}, per AS (SELECT session_id, count(*) AS n, arg_min(severity, rank_no) AS severity, arg_min(drug_a, rank_no) AS drug_a, arg_min(drug_b, rank_no) AS drug_b FROM ranked GROUP BY 1)
SELECT s.session_id, CASE WHEN n IS NULL THEN 'No known interaction in the table; this does not mean that the combination is safe.' WHEN severity IN ('major', 'contraindicated') THEN 'Serious interaction: ' || drug_a || ' with ' || drug_b || '. ' || n || ' in all.' ELSE n || ' possible interaction(s) to review.' END AS summary FROM (SELECT DISTINCT session_id FROM session_drugs) s LEFT JOIN per USING (session_id)""")
def interaction_summaries(spark, sf_dir):
    sessions = make(spark, sf_dir, "session_drugs").select("session_id").distinct()
    return coding.interaction_line(_alerts(spark, sf_dir), sessions, ["session_id"])


_CURATED = [(i, r[2].lower(), r[3], f"{10 + i}-{30 + 2 * i}" if i != 3 else None, "mg/dL" if i != 5 else "mmol/L") for i, r in enumerate(LABS)]


@query(f"""WITH lab AS (SELECT {DOC} AS document_id, {ANALYTE} AS text, CASE WHEN l_suppkey % 5 <> 0 THEN {QTY}::DOUBLE END AS v, CAST(l_partkey % 8 AS INT) AS i, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE {LOW}::DOUBLE END AS lo, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE {HIGH}::DOUBLE END AS hi FROM lineitem),
r AS (SELECT *, CASE WHEN i <> 3 THEN 10.0 + i END AS clo, CASE WHEN i <> 3 THEN 30.0 + 2 * i END AS chi FROM lab),
s AS (SELECT *, CASE WHEN v IS NULL THEN 'none' WHEN lo IS NOT NULL AND clo IS NOT NULL AND i = 5 THEN 'unit' WHEN (hi - lo) / (chi - clo) < 0.5 OR (hi - lo) / (chi - clo) > 2 THEN 'garbled' WHEN lo <> clo OR hi <> chi THEN 'differs' WHEN lo IS NULL AND clo IS NULL THEN 'missing' WHEN lo IS NULL THEN 'curated' ELSE 'printed' END AS state FROM r),
u AS (SELECT *, CASE WHEN state IN ('none', 'unit', 'missing') THEN NULL WHEN state IN ('garbled', 'curated') THEN clo ELSE lo END AS ulo, CASE WHEN state IN ('none', 'unit', 'missing') THEN NULL WHEN state IN ('garbled', 'curated') THEN chi ELSE hi END AS uhi FROM s)
SELECT document_id, text, state, CASE WHEN v > uhi THEN 'high' WHEN v < ulo THEN 'low' END AS direction, ulo::DOUBLE AS used_low, uhi::DOUBLE AS used_high FROM u""")
def abnormal_results(spark, sf_dir):
    tables(spark, sf_dir, "lineitem")
    lab = spark.sql(for_spark(f"SELECT {DOC} AS document_id, {ANALYTE} AS text, CASE WHEN l_suppkey % 5 <> 0 THEN CAST({QTY} AS DOUBLE) END AS value_num, 'mg/dl' AS unit, CASE WHEN l_partkey % 3 <> 0 THEN {LOW} || '-' || {HIGH} END AS reference_range, CAST(NULL AS STRING) AS code FROM lineitem"))
    curated = spark.createDataFrame([(i, text_key, None, rng, unit) for i, text_key, _, rng, unit in _CURATED], "row_no int, key string, code string, range string, unit string")
    return abnormal.judge(abnormal.with_curated(lab, curated)).select("document_id", "text", "state", "direction", "used_low", "used_high")


@query(f"SELECT {DOC} AS document_id, l_orderkey AS session_id, {ANALYTE} AS text, {QTY}::DOUBLE AS value_num, 'mg/dL' AS unit, {LOW} || '.0-' || {HIGH} || '.0' AS range_text, CASE WHEN {QTY} > {HIGH} THEN 'high' ELSE 'low' END AS direction, {pick('CAST(l_partkey % 8 AS INT)', [r[3] for r in LABS])} AS code FROM lineitem WHERE l_suppkey % 5 <> 0 AND ({QTY} > {HIGH} OR {QTY} < {LOW})")
def out_of_range_labs(spark, sf_dir):
    """Text documents to coded, out-of-range results: the whole path from page to flag."""
    docs = make(spark, sf_dir, "lab_docs")
    found = extract.rows(docs, ["document_id", "session_id"], extract.lab_array(F.col("text"))).drop("rule")
    coded = coding.fuzzy_lookup(found, "text", dims.load(spark, "lab_alias"))
    judged = abnormal.judge(coded.withColumn("curated_range", F.lit(None).cast("string")).withColumn("curated_unit", F.col("dim_unit")))
    return abnormal.flags(judged).select("document_id", "session_id", "text", "value_num", "unit", "range_text", "direction", "code")


# A deployment's own alias tables, made of the test tables and read from its folder of CSV files.
_FOLDER = {
    "lab_alias": "SELECT CAST(p_partkey AS INT) AS row_no, CAST(p_partkey % 3 AS INT) AS ord, CASE WHEN p_partkey % 50 = 7 THEN '# ' || p_name ELSE '  ' || p_name || ' ' || p_brand || ' ' END AS alias, 'L' || CAST(p_partkey AS VARCHAR(9)) AS code, p_type AS display, CASE WHEN p_size % 10 = 0 THEN ' ' ELSE 'mg/dL' END AS unit FROM part",
    "drug_alias": "SELECT CAST(s_suppkey AS INT) AS row_no, CAST(s_suppkey % 2 AS INT) AS ord, s_name AS alias, 'Generic ' || CAST(s_suppkey % 7 AS VARCHAR(9)) AS generic, 'R' || CAST(s_suppkey AS VARCHAR(9)) AS code, s_name AS display FROM supplier",
    "condition_alias": "SELECT CAST(n_nationkey AS INT) AS row_no, 0 AS ord, n_name AS alias, CASE WHEN n_nationkey % 9 = 4 THEN '' ELSE 'S' || CAST(n_nationkey AS VARCHAR(9)) END AS code, n_name AS display FROM nation",
}
_READ = ", ".join(f"{n} AS (SELECT * REPLACE (trim(alias) AS alias) FROM ({sql}) WHERE NOT starts_with(trim(alias), '#'))" for n, sql in _FOLDER.items())
_TERMS = "(" + " + ".join(f"(SELECT count(*) FROM {n} WHERE ord = 0)" for n in _FOLDER) + ")"
_BLANK = {n: " OR ".join(f"trim({c.split()[0]}) = ''" for c in dims.SCHEMAS[n].split(", ") if c.endswith("string")) for n in _FOLDER}


def _folder(spark, sf_dir) -> str:
    tables(spark, sf_dir, "part", "supplier", "nation")
    base = scratch(spark, "terms")
    for name, sql in _FOLDER.items():
        spark.sql(sql).write.csv(f"{base}/{name}.csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return base


@query(f"WITH {_READ} SELECT {_TERMS}::BIGINT AS terms")
def term_count(spark, sf_dir):
    """The terms of a deployment's folder, read from CSV: trimmed, without comments."""
    return dims.term_count(spark, _folder(spark, sf_dir))


@query(f"WITH {_READ} " + " UNION ALL ".join(f"SELECT '{n}' AS dim, 'repeated alias' AS fault, k AS what FROM (SELECT array_to_string(regexp_extract_all(lower(alias), '[a-z0-9]+'), ' ') AS k, row_no FROM {n}) GROUP BY k HAVING count(DISTINCT row_no) > 1 UNION ALL SELECT '{n}', 'blank field', alias FROM {n} WHERE {_BLANK[n]}" for n in _FOLDER))
def seed_hygiene(spark, sf_dir):
    """Faults of a deployment's alias tables."""
    folder, out = _folder(spark, sf_dir), None
    for n in _FOLDER:
        part = dims.hygiene(dims.load(spark, n, folder)).select(F.lit(n).alias("dim"), "fault", "what")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_READ} SELECT 'degraded' AS status, {_TERMS}::BIGINT AS terms")
def service_status(spark, sf_dir):
    """The state of a deployment without a recogniser, with its own terms."""
    return dims.status(spark, _folder(spark, sf_dir)).select("status", "terms")
