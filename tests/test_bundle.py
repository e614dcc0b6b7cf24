import datetime

from pyspark.sql import functions as F

from chartloom.operators import fhir, summary
from chartloom.plans import bundle
from chartloom.sources import dims

LAB = "SUNRISE DIAGNOSTICS\nCollected on 13/03/2024\nFasting blood sugar 142 mg/dL 70 - 100\nHDL cholesterol 50 mg/dL 40 - 60"
RX = "City Clinic\nDate: 20/03/2024\nTab. Glycomet 500mg 1-0-1 x 30 days\nTab Ecosprin 75mg OD\nReview after 20/06/2024"
DOCS = [("s", 1, 1, LAB, 0.9, None), ("s", 2, 2, RX, 0.9, None), ("s", 3, 3, RX + "\nsmudge", 0.6, None), ("s", 4, 4, RX.replace("500mg", "850mg"), 0.9, None), ("s", 5, 5, "Tab Warf 5mg", 0.8, None), ("s", 6, 6, LAB, 0.2, None), ("s", 7, 7, "nothing of use", 0.9, None), ("t", 8, 1, None, 0.9, None)]


def test_path(spark):
    docs = spark.createDataFrame(DOCS, "session string, document_id long, doc_no int, text string, mean_confidence double, hint string")
    out = bundle.build(docs, *(dims.load(spark, n) for n in ("lab_alias", "drug_alias", "condition_alias", "interaction")), "2025-01-01")
    line = out.timeline.where("session = 's'").orderBy("pos").collect()
    assert [(r.document_id, r.kind, r.date, list(r.duplicate_of)) for r in line] == [(1, "lab", datetime.date(2024, 3, 13), []), (2, "prescription", datetime.date(2024, 3, 20), [3]), (4, "prescription", datetime.date(2024, 3, 20), []), (5, "prescription", None, [])]
    assert sorted(r.document_id for r in out.unreadable.collect()) == [6, 7, 8]
    placed = {i for r in out.timeline.collect() for i in [r.document_id, *r.duplicate_of]} | {r.document_id for r in out.unreadable.collect()}
    assert placed == {d[1] for d in DOCS}
    assert [(r.severity, r.drug_a, r.drug_b) for r in out.interactions.collect()] == [("major", "aspirin", "warfarin")]
    flags = out.abnormal.collect()
    assert [(r.document_id, r.text, r.direction, r.code) for r in flags] == [(1, "Fasting blood sugar", "high", "1558-6")]
    assert [r.note for r in out.notes.collect()] == ["merged 3 into 2: same day, same kind, shared content"]
    read = {d[1]: d[4] for d in DOCS}
    assert all(r.confidence <= read[r.document_id] for r in out.entities.collect())
    again = bundle.build(docs.repartition(5), *(dims.load(spark, n) for n in ("lab_alias", "drug_alias", "condition_alias", "interaction")), "2025-01-01")
    assert sorted(map(str, again.timeline.collect())) == sorted(map(str, out.timeline.collect()))


def test_history(spark):
    t = spark.createDataFrame([("s", {"cc.primary": "pain", "cc.area": "chest", "soc.onset": "sudden", "soc.severity": "0", "px.surgery": "yes", "px.surgery_detail": "knee"}, {"soc.associations": ["sweat", "none"], "pf.family": ["dm"]}), ("t", {"cc.describe": "cough"}, {})], "session string, answers map<string,string>, lists map<string,array<string>>")
    rows = summary.interview_sections(t, ["session"], {"chest": "chest region", "pain": "Pain", "dm": "diabetes"})
    by = {(r.session, r.heading): (r.en, r.confidence) for r in rows.collect()}
    assert len(by) == 16
    assert by["s", "chief_complaint"] == ("Presenting complaint: Pain in the chest region.", 0.7)
    assert by["s", "hpi"] == ("Onset: sudden. Severity: 0/10. Associated with: sweat.", 0.9)
    assert by["s", "past_surgical"] == ('Patient reports a prior operation: "knee".', 0.8) and by["s", "family"][0] == "Family history: diabetes."
    assert by["t", "chief_complaint"] == ('Patient\'s own words: "cough"', 1.0) and by["t", "hpi"][1] == 0.5 and by["t", "ros"] == (summary.NOT_ANSWERED, 0.0)
    docs = spark.createDataFrame([("s", 0, "drugs_allergy", "x", 0.0), ("u", 0, "drugs_allergy", "y", 0.5)], "session string, position int, heading string, en string, confidence double")
    open_ = spark.createDataFrame([("s", ["q"], None)], "session string, unanswered array<string>, not_explored array<string>")
    bundles = spark.createDataFrame([("u", ["w"])], "session string, warnings array<string>")
    out = {r.session: r for r in summary.history(docs, rows, open_, bundles, ["session"]).collect()}
    assert set(out) == {"s", "t", "u"} and all(r.status == "draft" for r in out.values())
    assert [x.heading for x in out["s"].sections][:3] == ["drugs_allergy", "chief_complaint", "hpi"] and len(out["s"].sections) == 9
    assert out["s"].gaps[0] == "q" and "ros: nothing recorded" in out["s"].gaps and out["u"].gaps == ["w"] and out["u"].mean_confidence == 0.5


def test_prior_section(spark):
    t = spark.createDataFrame([("s", 1, 1, "lab", "Lab", datetime.date(2020, 1, 1))], "session string, document_id long, pos int, kind string, title string, date date")
    a = spark.createDataFrame([("s", 0, "FBS", 142.0, "mg/dL", "high", "70.0-100.0", 1)], "session string, n int, text string, value_num double, unit string, direction string, range_text string, document_id long")
    i = spark.createDataFrame([("s", 1, "major", "a", "b", "d")], "session string, rank_no int, severity string, drug_a string, drug_b string, description string")
    b = spark.createDataFrame([("s", 0.8), ("t", 0.9)], "session string, mean_confidence double")
    out = {r.session: r for r in summary.prior_section(t, a, i, b, ["session"]).collect()}
    assert out["s"].en == "Abnormal results:\n  - FBS: 142.0 mg/dL (high, reference 70.0-100.0)\n\nAll investigations on file:\n  - Lab — 2020-01-01\n\nDrug interaction warnings:\n  - a + b: d (major)"
    assert out["s"].hi.startswith("असामान्य") and out["s"].provenance == [1] and out["s"].confidence == 0.8 and out["t"].confidence == 0.0


def test_canonical_json_and_entries(spark):
    """Equal values have equal text whatever the order of keys or needless zeros; entries are read as variants."""
    rows = spark.createDataFrame([('{"b":1.0,"a":[{"y":"é","x":0.50}]}',), ('{"a":[{"x":0.5,"y":"\\u00e9"}],"b":1}',)], "j string")
    assert {r[0] for r in rows.select(fhir.canonical(F.col("j"))).collect()} == {'{"a":[{"x":0.5,"y":"é"}],"b":1}'}
    bundles = spark.createDataFrame([(1, '{"entry":[{"resource":{"resourceType":"Observation","id":"o"}},{"resource":{"resourceType":"DetectedIssue"}}]}'), (2, '{"entry":[]}')], "session int, bundle string")
    out = fhir.entries(bundles, ["session"]).select("session", "at", "resource_type", F.variant_get("resource", "$.id", "string").alias("id")).collect()
    assert sorted(map(tuple, out)) == [(1, 0, "Observation", "o"), (1, 1, "DetectedIssue", None)]
