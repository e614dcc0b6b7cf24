import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators import ayush, fhir, interview, metrics, ocr, summary, timeline
from chartloom.sources import scan
from chartloom.streaming.interview import stream_red_flags

ENTRY = "session long, seq long, document_id long, kind string, date date, title string, facility string, confidence double, keys array<string>, doses array<struct<drug:string,doses:array<string>>>"


def plain_fold(entries):
    """The fold as a plain loop over a whole session."""
    kept = []
    for e in sorted(entries, key=lambda e: e["seq"]):
        for k in kept:
            same = k["kind"] == e["kind"] and k["date"] == e["date"] and e["date"] is not None
            both = set(k["keys"]) | set(e["keys"])
            if same and min(len(set(k["keys"])), len(set(e["keys"]))) >= 2 and not any(k["doses"].get(d, x) != x for d, x in e["doses"].items()) and len(set(k["keys"]) & set(e["keys"])) / len(both) >= 0.6:
                ids = [*k["ids"], e["document_id"]]
                if e["confidence"] > k["confidence"]:
                    k.update(document_id=e["document_id"], confidence=e["confidence"], facility=e["facility"] or k["facility"])
                else:
                    k["facility"] = k["facility"] or e["facility"]
                k.update(keys=both, ids=ids, doses={**e["doses"], **k["doses"]})
                break
        else:
            kept.append({**e, "ids": [e["document_id"]]})
    return sorted((k["seq"], k["document_id"], tuple(sorted(set(k["ids"]) - {k["document_id"]})), tuple(sorted(set(k["keys"]))), k["facility"]) for k in kept)


def test_fold_equals_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for n in range(160):
        keys = sorted(rng.sample("abcdef", rng.randint(0, 5)))
        doses = {k: ["500mg"] for k in keys if k in "ab" and rng.random() < 0.2}
        rows.append({"session": n % 4, "seq": n, "document_id": 1000 + n, "kind": rng.choice(["lab", "prescription"]), "date": rng.choice([None, datetime.date(2020, 1, 1), datetime.date(2020, 1, 2)]), "title": "t", "facility": rng.choice([None, "F"]), "confidence": rng.choice([0.2, 0.5, 0.9]), "keys": keys, "doses": {k: [rng.choice(["500mg", "250mg"])] for k in doses}})
    df = spark.createDataFrame([(*(r[k] for k in ("session", "seq", "document_id", "kind", "date", "title", "facility", "confidence", "keys")), [(d, x) for d, x in r["doses"].items()]) for r in rows], ENTRY)
    for parts in (1, 5):
        out = timeline.fold_duplicates(df.repartition(parts)).collect()
        for s in range(4):
            got = sorted((r.seq, r.document_id, tuple(sorted(r.duplicate_of)), tuple(sorted(r["keys"])), r.facility) for r in out if r.session == s)
            assert got == plain_fold([r for r in rows if r["session"] == s])
        assert sorted(i for r in out for i in [r.document_id, *r.duplicate_of]) == sorted(r["document_id"] for r in rows)


def test_order(spark):
    d = datetime.date
    rows = [("a", 1, "prescription", d(2020, 1, 1), "X"), ("a", 2, "note", d(2020, 1, 1), "y"), ("a", 3, "lab", None, "b"), ("a", 4, "lab", None, "A"), ("a", 5, "odd", d(2019, 1, 1), "z"), ("b", 6, "lab", None, "q")]
    out = timeline.order(spark.createDataFrame(rows, "session string, seq int, kind string, date date, title string"), ["session"])
    assert [r.seq for r in out.where("session = 'a'").orderBy("pos").collect()] == [5, 2, 1, 4, 3]


def test_ocr(spark):
    rows = [("p", i, 0, 0, line, text, conf) for i, (line, text, conf) in enumerate([(0, "a", 90.0), (0, " ", 90.0), (0, "b", -1.0), (0, "c", 50.0), (1, "d", 20.0), (0, "e", 80.0)])]
    words = ocr.tokens(spark.createDataFrame(rows, "page string, word_no int, block int, par int, line int, text string, conf double"))
    assert ocr.page_text(ocr.lines(words, ["page"]), ["page"]).first().text == "a c\nd\ne"
    pages = spark.createDataFrame([("p",), ("q",)], "page string")
    out = {r.page: r for r in ocr.page_confidence(pages, words, ["page"]).collect()}
    assert abs(out["p"].mean_confidence - 0.6) < 1e-9 and abs(out["p"].worst_line - (0.9 + 0.5 + 0.8) / 3) < 1e-9 and not out["p"].escalate
    assert out["q"].mean_confidence == 0.0 and out["q"].escalate
    lang = lambda x, has: spark.createDataFrame([(x,)], "x string").select(ocr.language(F.col("x"), has)).first()[0]
    assert [lang("hi+en", ["eng", "hin"]), lang("xx", ["eng"]), lang("ta", ["deu", "fra"]), lang(None, []), lang("ta", [])] == ["hin+eng", "eng", "deu", "eng+hin", "tam"]


@pytest.mark.parametrize("text,answers,want", [(None, {}, True), ("a == yes", {"a": "yes"}, True), ("a == yes && (b >= 3)", {"a": "yes", "b": "3"}, True), ("b >= 3", {"b": "x"}, False), ("b >= 3", {}, False), ("a in [x, y]", {"a": "y"}, True), ("a in [x, y]", {}, False), ("a == None", {}, True), ("b <= 2.5", {"b": "2"}, True), ("b < 2", {"b": "2"}, False)])
def test_conditions(spark, text, answers, want):
    df = spark.createDataFrame([(answers,)], "m map<string,string>")
    assert df.select(interview.compile_condition(text, interview.from_map(F.col("m")))).first()[0] is want
    with pytest.raises(interview.ConditionError):
        interview.compile_condition("a ~ b", interview.from_map(F.col("m")))


ANSWER = "session_id long, ord long, question_id string, value string, multi array<string>, dur_amount double, dur_unit string"
RULES = [
    {"question_id": "pain", "option": None, "when": "value == yes && age >= 40", "reason": "cardiac", "severity": "critical"},
    {"question_id": "when", "option": None, "when": "value_hours <= 24", "reason": "acute", "severity": "urgent"},
    {"question_id": "when", "option": None, "when": "value_hours >= 1", "reason": "lasting", "severity": "urgent"},
    {"question_id": "where", "option": "chest", "when": None, "reason": "chest", "severity": "critical"},
]


def log():
    rng = random.Random(8)
    rows = [(1, 1, "pain", "yes", None, None, None), (1, 2, "age", "50", None, None, None), (1, 3, "pain", "yes", None, None, None), (2, 1, "when", None, None, 2.0, "days"), (2, 2, "when", None, None, 20.0, "hours"), (2, 3, "when", "x", None, None, None), (2, 4, "where", None, ["arm", "chest"], None, None), (2, 5, "where", "chest", None, None, None)]
    return rows + [(10 + i % 7, i, rng.choice(["pain", "age"]), rng.choice(["yes", "no", "39", "60"]), None, None, None) for i in range(120)]


def test_red_flags_see_only_earlier_answers(spark):
    out = interview.red_flags(spark.createDataFrame(log(), ANSWER), RULES, ["session_id"]).collect()
    assert sorted((r.session_id, r.ord, r.reason) for r in out if r.session_id < 10) == [(1, 3, "cardiac"), (2, 1, "lasting"), (2, 2, "acute"), (2, 2, "lasting"), (2, 3, "lasting"), (2, 4, "chest"), (2, 5, "chest")]
    state, want = {}, []
    for s, o, q, v, *_ in sorted(r for r in log() if r[0] >= 10):
        state.setdefault(s, {})[q] = v
        age = state[s].get("age")
        if q == "pain" and v == "yes" and age and age.isdigit() and int(age) >= 40:
            want.append((s, o))
    assert sorted((r.session_id, r.ord) for r in out if r.session_id >= 10) == want


def test_stream_equals_batch(spark, tmp_path):
    batch = sorted(map(tuple, interview.red_flags(spark.createDataFrame(log(), ANSWER), RULES, ["session_id"]).collect()))
    rows = sorted(log(), key=lambda r: r[1])
    for k in range(3):  # the stream takes the log in three pieces
        spark.createDataFrame(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], ANSWER).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        flags = stream_red_flags(spark.readStream.schema(ANSWER).parquet(str(tmp_path / "log")), RULES)
        flags.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch


ONTOLOGY = {"sections": [{"id": "b", "order": 2, "trigger": "q1 == yes", "questions": [{"id": "q3"}]}, {"id": "a", "order": 1, "always": True, "questions": [{"id": "q1", "follow_up_on_yes": "q2", "options": [{"id": "x", "red_flag": {"reason": "r", "severity": "urgent"}}]}, {"id": "q2"}, {"id": "d", "input_type": "derived"}]}, {"id": "c", "order": 3, "mode": "ayush", "parameters": [{"id": "q4"}]}, {"id": "e", "order": 4, "questions": [{"id": "q5"}]}]}


def test_ontology(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps(ONTOLOGY), encoding="utf-8")
    found = scan.load_ontology(spark, str(tmp_path / "o.json"))
    flat = scan.flatten(spark, found)
    assert sorted(r.question_id for r in flat.collect()) == ["q1", "q2", "q3", "q4", "q5"] and scan.derived_ids(found) == ["d"]
    assert scan.rules(found) == [{"question_id": "q1", "option": "x", "when": None, "reason": "r", "severity": "urgent"}] and scan.interaction_defaults(found) == {"tap_timeout_seconds": 10}
    for broken in ({}, {"sections": []}, {"sections": [{"questions": []}]}, {"sections": [{"id": "a"}]}, {"sections": [{"id": "a", "questions": [{}]}]}, {"sections": [{"id": "a", "questions": [{"id": "x"}, {"id": "x", "input_type": "derived"}]}]}):
        with pytest.raises(scan.OntologyError):
            scan.check_ontology(broken)
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    for path in ("bad.json", "none.json"):
        with pytest.raises(scan.OntologyError):
            scan.load_ontology(spark, str(tmp_path / path))
    answers = spark.createDataFrame([(1, "q1", "yes"), (2, "q1", "no")], "s int, question_id string, value string")
    sections = {s["id"]: s for s in found["sections"]}
    asked = lambda mode: {s: [r.question_id for r in interview.sequence(flat, answers, ["s"], sections, mode).where(f"s = {s}").orderBy("q_ord").collect()] for s in (1, 2)}
    assert asked("allopathic") == {1: ["q1", "q2", "q3"], 2: ["q1"]}
    assert asked("ayush") == {1: ["q1", "q2", "q3", "q4"], 2: ["q1", "q4"]}


def test_plausibility_and_ranking(spark):
    evidence, must, conditions = scan.condition_map(spark, {"conditions": [{"id": "x", "urgency": "critical", "discriminators": [{"question_id": "q1", "value": "yes", "weight": 0.7}, {"question_id": "q2", "value": "a", "weight": 0.5}], "negative": [{"question_id": "q3", "value": "no", "weight": 0.9}], "must_ask": ["q4"]}, {"id": "y", "discriminators": [{"question_id": "q2", "value": "a", "weight": 0.6}, {"question_id": "q3", "value": "yes", "weight": 0.2}]}]})
    answers = spark.createDataFrame([(1, "q1", "yes", None), (1, "q2", None, ["a", "b"]), (2, "q3", "no", None), (3, "q2", "a", None)], "s int, question_id string, value string, multi array<string>")
    plaus = interview.plausibility(answers, evidence, conditions, ["s"])
    got = {(r.s, r.condition_id): round(r.plausibility, 6) for r in plaus.collect()}
    assert got == {(1, "x"): 1.0, (1, "y"): 0.6, (2, "x"): 0.0, (2, "y"): 0.0, (3, "x"): 0.5, (3, "y"): 0.6}
    live = plaus.where("plausibility > 0").join(conditions.select("condition_id", "ord"), "condition_id")
    asked = spark.createDataFrame([(s, q, i) for s in (1, 2, 3) for i, q in enumerate(["q1", "q3", "q4", "q5"])], "s int, question_id string, q_ord int")
    scored = interview.question_scores(live, asked.select("s", "question_id"), evidence, must, ["s"])
    scores = {(r.s, r.question_id): round(r.score, 6) for r in scored.collect()}
    assert scores[1, "q1"] == 0.7 and scores[1, "q3"] == round(1.0 * 1.1, 6) and scores[1, "q4"] == 100.0 and scores[2, "q4"] == 0.0 and scores[3, "q3"] == round(0.6 * 1.1, 6)
    ranked = interview.rank_questions(scored.join(asked, ["s", "question_id"]), live, must, conditions, ["s"])
    assert [r.question_id for r in ranked.where("s = 1").orderBy("rank_no").collect()] == ["q4", "q3", "q1", "q5"]
    assert [r.question_id for r in ranked.where("s = 2").orderBy("rank_no").collect()] == ["q1", "q3", "q4", "q5"]


def test_prakriti(spark):
    rows = [(1, i, "vata") for i in ayush.ITEMS[:4]] + [(1, i, "pitta") for i in ayush.ITEMS[4:7]] + [(2, i, "kapha") for i in ayush.ITEMS[:5]] + [(3, i, "kapha") for i in ayush.ITEMS[:5]] + [(3, ayush.ITEMS[5], "odd")]
    out = {r.s: (r.dominant, r.dual) for r in ayush.prakriti(spark.createDataFrame(rows, "s int, question_id string, value string"), ["s"]).collect()}
    assert out == {1: ("vata-pitta", True), 2: (None, False), 3: ("kapha", False)}


def test_fhir(spark):
    coded = spark.createDataFrame([(1, 0, "lab", "FBS", 142.0, None, "mg/dL", "70-100", "LOINC", "1558-6", "Glucose", 0.7), (1, 1, "vital", "Pulse 88", 88.0, None, "bpm", None, None, None, None, 0.9), (2, 0, "medication", "Tab Glycomet 500mg", 500.0, None, "mg", None, "RxNorm", "6809", "Metformin", 0.8), (3, 0, "diagnosis", "Asthma", None, None, None, None, None, None, None, 0.7), (5, 0, "medication", "A", None, "A", None, None, None, None, None, 0.8), (5, 1, "medication", "B", None, "B", None, None, None, None, None, 0.8)], "document_id int, entity_no int, kind string, text string, value_num double, value_str string, unit string, reference_range string, system string, code string, display string, confidence double")
    docs = spark.createDataFrame([(i, "s", t, f"T{i}", "2024-01-01", 0.8) for i, t in ((1, "lab"), (2, "prescription"), (3, "condition"), (4, "note"), (5, "prescription"))], "document_id int, session string, suggested_type string, suggested_title string, clinical_date string, mean_confidence double")
    made = fhir.resources(docs, coded, ["document_id"])
    out = {r.document_id: json.loads(r.fhir) for r in made.collect()}
    assert [out[i]["resourceType"] for i in range(1, 6)] == ["DiagnosticReport", "MedicationRequest", "Condition", "DocumentReference", "Bundle"]
    obs = out[1]["contained"]
    assert [o["id"] for o in obs] == ["obs-1", "obs-2"] and obs[0]["valueQuantity"]["code"] == "mg/dL" and "code" not in obs[1]["valueQuantity"] and "coding" not in obs[1]["code"] and out[1]["result"][1] == {"reference": "#obs-2"}
    assert out[2]["medicationCodeableConcept"]["text"] == "Metformin" and out[2]["status"] == "draft"
    alerts = spark.createDataFrame([("s", 1, "major", "a", "b", "d")], "session string, rank_no int, severity string, drug_a string, drug_b string, description string")
    bundle = fhir.patient_bundle(made.join(docs.select("document_id", "session"), "document_id"), alerts, docs.select("session").distinct(), ["session"], "document_id").first()
    whole = json.loads(bundle.bundle)
    assert whole["total"] == bundle.total == len(whole["entry"]) == 7 and whole["entry"][-1]["resource"]["severity"] == "high"


def test_summary(spark):
    t = spark.createDataFrame([("s", 1, 1, "prescription", "Rx", datetime.date(2020, 1, 1)), ("s", 2, 2, "allergy", "Al", None), ("s", 3, 3, "prescription", "Rx", datetime.date(2021, 1, 1)), ("t", 4, 1, "note", "N", None)], "session string, document_id long, pos int, kind string, title string, date date")
    f = spark.createDataFrame([("s", 1, 0, "medication", "A", 0.9), ("s", 3, 0, "medication", "B", 0.5), ("s", 3, 1, "lab", "L", 0.1)], "session string, document_id long, entity_no long, kind string, text string, confidence double")
    out = {r.session: r for r in summary.drug_section(t, f, t.select("session").distinct(), ["session"]).collect()}
    assert out["s"].en == 'B (as read; low confidence) — 2021-01-01\nA — 2020-01-01\nAllergy record on file: "Al" — undated' and out["s"].provenance == [3, 1, 2] and abs(out["s"].confidence - 0.7) < 1e-9
    assert "जैसा" in out["s"].hi and out["t"].confidence == 0.0 and out["t"].en.startswith("No medications")
    d = spark.createDataFrame([("s", "no", True, ["x"]), ("t", None, False, ["I take no tablets"]), ("u", "yes", True, ["no medicine"])], "session string, rx_current string, rx_asked boolean, narration array<string>")
    m = spark.createDataFrame([(s, 1, "A") for s in "stu"] + [("s", 2, "B")], "session string, document_id int, drug_name string")
    assert sorted((r.session, r.from_documents) for r in summary.contradictions(d, m, ["session"]).collect()) == [("s", "Prescription found for A"), ("s", "Prescription found for B"), ("t", "Prescription found for A")]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 2, 4, 3), (1, 0, 0, 0), (2, 0, 5, 0)], "g int, n_correct int, n_extracted int, n_expected int")
    out = {r.g: (r.precision, round(r.recall, 6), round(r.f1, 6)) for r in metrics.precision_recall(rows, ["g"]).collect()}
    assert out == {1: (0.5, 0.666667, 0.571429), 2: (0.0, 0.0, 0.0)}
    assert metrics.best_window("abc", "xxabcxx") == (1.0, 0) and metrics.best_window("", "x") == (0.0, 0) and 0.7 < metrics.best_window("glycomet", "tab glicomet 500")[0] < 1
    a = spark.createDataFrame([("d", 0, "Glycomet"), ("d", 1, "Telma")], "document_id string, a_no int, a string")
    b = spark.createDataFrame([("d", 0, "Glycomett"), ("d", 1, "Glycomet"), ("d", 2, "zzz")], "document_id string, b_no int, b string")
    assert [(r.a_no, r.b_no) for r in metrics.one_to_one(a, b).collect()] in ([(0, 0)], [(0, 1)])
