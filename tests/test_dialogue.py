import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.lineage import scratch
from chartloom.operators import ayush, coding, dialogue, fhir, interview, metrics, ocr, rules, summary
from chartloom.plans import bundle
from chartloom.sources import dims, scan
from chartloom.streaming.interview import serve, state_store

ONTOLOGY = {
    "$region_labels": {"chest": {"en": "Chest"}},
    "sections": [
        {"id": "two", "order": 2, "trigger": "pain == yes", "questions": [{"id": "where", "input_type": "region", "regions": ["chest", "leg"], "required": True}, {"id": "age", "input_type": "number", "min": 0}]},
        {"id": "one", "order": 1, "always": True, "questions": [{"id": "pain", "input_type": "yesno", "follow_up_on_yes": "since", "options": [{"id": "yes", "label": {"en": "Yes"}}, {"id": "no"}]}, {"id": "since", "input_type": "text", "skippable": False}, {"id": "fever", "input_type": "yesno"}, {"id": "pulse", "capture_mode": "examiner_required"}]},
        {"id": "ay", "order": 3, "mode": "ayush", "parameters": [{"id": "build", "input_type": "choice"}, {"id": "prakriti", "input_type": "derived"}]},
    ],
}
MAP = {"conditions": [{"id": "a", "urgency": "critical", "discriminators": [{"question_id": "pain", "value": "yes", "weight": 0.5}, {"question_id": "age", "value": "50", "weight": 0.4}], "must_ask": ["fever"]}, {"id": "b", "discriminators": [{"question_id": "pain", "value": "yes", "weight": 0.3}, {"question_id": "where", "value": "leg", "weight": 0.9}], "negative": [{"question_id": "age", "value": "50", "weight": 0.2}]}]}


def event(session, ord_, question=None, value=None, multi=None, said=None, mode="allopathic"):
    return (session, ord_, "start" if question is None else "answer", mode, question, value, multi, said)


def by_order(rows):
    return [(r.status, r.next_question, r.completed, r.answered, r.estimated_total) for r in sorted(rows, key=lambda r: r.ord)]


def test_session(spark):
    log = [event(1, 1), event(1, 2, "fever", "no"), event(1, 3, "pain", "yes", said="it hurts"), event(1, 4, "since", None), event(1, 5, "fever", "no"), event(1, 6, "where", None, ["leg"]), event(1, 7, "age", "50"), event(1, 8, "age", "51"), event(2, 1, "pain", "no"), event(3, 1, mode="ayush"), event(3, 2, "pain", "no"), event(3, 3, mode="ayush"), event(None, 1)]
    out = dialogue.replay(spark.createDataFrame(log, dialogue.EVENT), dialogue.Script(ONTOLOGY)).collect()
    assert by_order(r for r in out if r.session_id == 1) == [("started", "pain", False, 0, 2), ("refused: waiting for pain", "pain", False, 0, 2), ("accepted", "since", False, 1, 5), ("accepted", "fever", False, 2, 5), ("accepted", "where", False, 3, 5), ("accepted", "age", False, 4, 5), ("accepted", None, True, 5, 5), ("unknown session", None, False, 0, 0)]
    assert by_order(r for r in out if r.session_id == 2) == [("unknown session", None, False, 0, 0)]
    assert [r.next_question for r in sorted((r for r in out if r.session_id == 3), key=lambda r: r.ord)] == ["pain", "fever", "pain"]
    shown = {r.ord: json.loads(r.payload) for r in out if r.session_id == 1 and r.payload}
    assert shown[1]["options"][0]["label"] == {"en": "Yes"} and shown[1]["skippable"] and not shown[3]["skippable"] and shown[1]["selection_reason"] == "ontology_order"
    assert not shown[5]["skippable"] and shown[5]["hints"] == {"regions": ["chest", "leg"], "region_labels": {"chest": {"en": "Chest"}}} and shown[6]["hints"] == {"min": 0}
    seen = {r.session_id: r for r in dialogue.read(spark.createDataFrame(out, dialogue.STEP)).collect()}
    assert set(seen) == {1, 3} and seen[1].completed and seen[1].narration == ["it hurts"] and seen[1].unanswered == [] and seen[1].answers["age"] == "50" and seen[3].unanswered == ["pain", "fever", "build"]


def test_ranking_follows_the_condition_map(spark):
    script = dialogue.Script(ONTOLOGY, MAP)
    assert script.next("allopathic", {}) == "pain"
    # a must-ask of a live condition comes first, then what tells the two conditions apart most
    assert script.next("allopathic", {"pain": "yes"}) == "fever"
    assert script.next("allopathic", {"pain": "yes", "fever": "no"}) == "where"
    assert script.payload("pain", "allopathic", {})["selection_reason"] == "condition_map"
    # equal to the batch operators' head of ranking
    evidence, must, conditions = scan.condition_map(spark, MAP)
    flat, sections = scan.flatten(spark, ONTOLOGY), {s["id"]: s for s in ONTOLOGY["sections"]}
    rng = random.Random(4)
    states = [{q: rng.choice(v) for q, v in {"pain": ["yes", "no"], "since": ["x"], "fever": ["yes", "no"], "where": ["leg", "arm"], "age": ["50", "9"]}.items() if rng.random() < 0.5} for _ in range(40)]
    rows = [(i, q, v, None) for i, s in enumerate(states) for q, v in {**s, "-": "-"}.items()]
    answers = spark.createDataFrame(rows, "s int, question_id string, value string, multi array<string>")
    plaus = interview.plausibility(answers, evidence, conditions, ["s"])
    live = plaus.where("plausibility > 0").join(conditions.select("condition_id", "ord"), "condition_id")
    waits = interview.unanswered(interview.sequence(flat, answers, ["s"], sections)).select("s", "question_id", "q_ord")
    scored = interview.question_scores(live, waits.select("s", "question_id"), evidence, must, ["s"]).withColumn("score", F.round("score", 9))
    ranked = interview.rank_questions(scored.join(waits, ["s", "question_id"]), live, must, conditions, ["s"])
    heads = {r.s: r.next_question for r in interview.next_question(ranked, answers.select("s").distinct(), ["s"]).collect()}
    assert heads == {i: script.next("allopathic", s) for i, s in enumerate(states)}


def test_stream_equals_replay_and_releases(spark):
    rng = random.Random(9)
    log = [event(s, 1) for s in range(6)] + [event(s, o, rng.choice(["pain", "since", "fever", "where", "age"]), rng.choice(["yes", "no", "50"])) for s in range(6) for o in range(2, 40)]
    log.sort(key=lambda e: e[1])
    script, base = dialogue.Script(ONTOLOGY, MAP), scratch(spark, "test-serve")
    for k in range(3):
        spark.createDataFrame(log[k * len(log) // 3 : (k + 1) * len(log) // 3], dialogue.EVENT).coalesce(1).write.mode("append").parquet(f"{base}/log")
        with state_store(spark):
            serve(spark.readStream.schema(dialogue.EVENT).parquet(f"{base}/log"), script).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    batch = dialogue.replay(spark.createDataFrame(log, dialogue.EVENT), script).collect()
    key = lambda r: (r.session_id, r.ord)
    assert sorted(map(tuple, spark.read.parquet(f"{base}/out").collect()), key=str) == sorted(map(tuple, batch), key=str)
    assert any(r.completed for r in batch) and any(r.status == "unknown session" for r in sorted(batch, key=key))


@pytest.mark.parametrize("value,want", [("3", True), (" 3.5e0 ", True), ("2d", False), ("1f", False), ("0x1", False), ("", False), (None, False), ("Infinity", True), ("-1", False)])
def test_numbers_in_rules(spark, value, want):
    df = spark.createDataFrame([({"a": value},)], "m map<string,string>")
    assert df.select(interview.compile_condition("a >= 1", interview.from_map(F.col("m")))).first()[0] is want


def test_denials(spark):
    rows = [(i, v, True, []) for i, v in enumerate(["no", "No", "False", "0", "no_tell", "yes", "0.0", "10"])]
    denials = spark.createDataFrame(rows, "s int, rx_current string, rx_asked boolean, narration array<string>")
    meds = spark.createDataFrame([(i, 1, "x") for i in range(8)], "s int, document_id int, drug_name string")
    assert sorted(r.s for r in summary.contradictions(denials, meds, ["s"]).collect()) == [0, 2, 3, 4, 6]


def test_state_as_of_is_one_fold(spark):
    rng = random.Random(2)
    rows = [(i % 5, i, rng.choice("abc"), rng.choice(["x", "y", None])) for i in range(200)] + [(9, i, f"q{i % 7}", str(i)) for i in range(10_000)]
    rng.shuffle(rows)
    answers = spark.createDataFrame(rows, "s int, ord int, question_id string, value string")
    state, want = {}, {}
    for s, o, q, v in sorted(rows, key=lambda r: r[:2]):
        state.setdefault(s, {})[q] = v
        want[s, o] = dict(state[s])
    assert {(r.s, r.ord): r.state for r in interview.state_as_of(answers, ["s"]).collect()} == want


def test_rules_as_rows(spark):
    """Rules as rows fire where plain loops over the session say so, a stream's form too, and the plan is one for any number of them."""
    rng = random.Random(6)
    ops = ["== yes", ">= 3", "< 2", "in [yes, 3, x]", "<= 5", "> 1", "== None"]
    made = [(n, rng.choice("abc"), rng.choice([None, None, "x", "yes"]), rng.choice([None, *(" && ".join(f"{rng.choice(['value', 'a', 'b', '(c', 'zz'])} {rng.choice(ops)}" + (")" if rng.random() < 0.2 else "") for _ in range(rng.randint(1, 3))) for _ in range(4))]), f"r{n}", "urgent") for n in range(120)]
    log = [(i % 4, i, rng.choice("abcd"), *rng.choice([("yes", None), ("3", None), (None, None), ("1", None), (None, ["x", "yes", "x"]), (None, [])]), None, None) for i in range(160)]
    answers = spark.createDataFrame(log, "session_id long, ord long, question_id string, value string, multi array<string>, dur_amount double, dur_unit string")
    table = spark.createDataFrame(made, rules.RULE)
    want, state = [], {}
    for s, o, q, v, multi, *_ in log:
        mine = state.setdefault(s, {})
        mine[q] = v
        for n, question, option, when, reason, _ in made:
            if question != q or (option is not None and option not in (multi if multi is not None else [v])):
                continue
            own = option if option is not None else v if multi is None else None
            if when is None or dialogue.holds(when, {**mine, "value": own}):
                want.append((s, o, n))
    got = rules.fired(answers, table, ["session_id"])
    assert sorted((r.session_id, r.ord, r.rule_no) for r in got.collect()) == sorted(want)
    stream = rules.fired_as_of(interview.state_as_of(answers, ["session_id"]), table, ["session_id"])
    assert sorted((r.session_id, r.ord, r.rule_no) for r in stream.collect()) == sorted(want)
    size = lambda n: len(rules.fired(answers, spark.createDataFrame(made[:n], rules.RULE), ["session_id"])._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(120) == size(3)
    with pytest.raises(Exception, match="no operator"):
        rules.fired(answers, spark.createDataFrame([(1, "a", None, "b ~ 3", "r", "s")], rules.RULE), ["session_id"]).collect()
    assert rules.parse("a<=3 && (b in [x, y])") == [("a", "<=", "3"), ("b", " in ", "[x, y]")]


def test_one_pass_look_up(spark):
    """The rows of a look-up are worked out once, and no join is a nested loop."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    rows = spark.range(50).select("id", counted(F.element_at(F.array(*map(F.lit, ["HDL cholesterl", "TSH", "nothing like it"])), (F.col("id") % 3 + 1).cast("int"))).alias("text"))
    out = coding.fuzzy_lookup(rows, "text", dims.load(spark, "lab_alias"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 50 and calls.value == 50 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.where("code is not null and score < 1").count() > 0


def test_recalls_and_brands(spark):
    rows = spark.createDataFrame([(True, True, "c"), (False, True, None), (False, False, "c"), (None, None, None)], "strict boolean, fuzzy boolean, code string")
    assert tuple(metrics.recalls(rows).first()) == (4, 0.25, 0.5, 0.5)
    assert metrics.recalls(rows.limit(0)).first().strict == 0.0
    assert [r.name for r in metrics.brands(spark.createDataFrame([("A| b ||A",), (None,), ("",)], "brands string")).collect()] == ["A", "b", "A"]


def test_image_quality(spark):
    rng = np.random.default_rng(1)
    images = [("flat", np.full((6, 7), 128)), ("dark", rng.integers(0, 60, (8, 5))), ("bright", 255 - 60 * (np.indices((6, 6)).sum(0) % 2 * (np.indices((6, 6))[0] % 3 == 0))), ("ok", rng.integers(0, 255, (9, 9))), ("thin", rng.integers(0, 255, (2, 9)))]
    rows = [(n, a.shape[1], a.shape[0], a.ravel().tolist()) for n, a in images]
    out = {r.name: r for r in ocr.image_quality(spark.createDataFrame(rows, "name string, width int, height int, pixels array<int>"), ["name"]).collect()}
    for name, a in images:
        x = a.astype(float)
        lap = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
        assert abs(out[name].sharpness - (lap.var() if lap.size else 0.0)) < 0.006 and abs(out[name].brightness - x.mean()) < 0.006
    assert out["flat"].verdict.startswith("blurry") and out["dark"].verdict.startswith("too dark") and out["ok"].verdict == "ok"


def test_derived_examination(spark):
    answers = spark.createDataFrame([(1, f"pa.{q}", "vata") for q in ("build", "skin", "appetite", "digestion", "sleep", "temperament")], "s int, question_id string, value string")
    parameters = spark.createDataFrame([("p1", 0, "patient_reported", "pa.build"), ("p2", 1, "patient_reported", None), ("prakriti", 2, "derived", None), ("vaya", 3, "derived", None), ("x", 4, "examiner_required", None)], "parameter string, ord int, capture_mode string, question_id string")
    out = {r.s: r for r in ayush.derive(spark.createDataFrame([(1,), (2,)], "s int"), answers, parameters, ["s"]).collect()}
    assert out[1].prakriti.dominant == "vata" and out[1].missing == ["p2"] and out[1].not_derived == ["vaya"] and not out[1].complete
    assert out[2].prakriti is None and out[2].missing == ["p1", "p2"] and out[2].not_derived == ["prakriti", "vaya"]


def test_issues_name_their_requests(spark):
    made = spark.createDataFrame([(1, json.dumps({"resourceType": "MedicationRequest", "id": "m1", "medicationCodeableConcept": {"text": "Aspirin"}})), (1, json.dumps({"resourceType": "MedicationRequest", "medicationCodeableConcept": {"text": "Warf"}})), (1, "{}")], "s int, json string")
    alerts = spark.createDataFrame([(1, 1, "major", "aspirin", "Warf", "bleeding"), (2, 1, "odd", "aspirin", "x", "d")], "s int, rank_no int, severity string, drug_a string, drug_b string, description string")
    out = {r.s: json.loads(r.json) for r in fhir.detected_issues(alerts, ["s"], fhir.medication_ids(made, ["s"])).collect()}
    assert out[1]["implicated"] == [{"reference": "MedicationRequest/m1", "display": "aspirin"}, {"display": "Warf"}] and out[1]["severity"] == "high"
    assert out[2]["implicated"][0] == {"display": "aspirin"} and out[2]["severity"] == "moderate"


def test_ingest_keeps_the_extraction_date(spark):
    docs = spark.createDataFrame([("s", 1, 1, "City Clinic\nSeen 3 Mar 2020\nTab Crocin 500mg", 0.8, None), ("s", 2, 2, "nothing", 0.9, None), ("s", 3, 3, None, 0.9, None)], "session string, document_id long, doc_no int, text string, mean_confidence double, hint string")
    out = {r.document_id: r for r in bundle.ingest(docs, "2025-01-01").collect()}
    assert str(out[1].date) == "2020-03-03" and out[1].date_confidence == out[1].mean_confidence and out[1].kind == "prescription"
    assert out[2].date is None and out[2].date_confidence == 0.0 and out[3].n_entities == 0


def test_sources(spark, tmp_path):
    (tmp_path / "shared" / "clinical").mkdir(parents=True)
    (tmp_path / "shared" / "clinical" / "ontology.json").write_text("{}")
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert dims.find_folder(str(tmp_path / "a" / "b")) == str(tmp_path / "shared" / "clinical" / "ontology.json")
    with pytest.raises(FileNotFoundError):
        dims.find_folder(str(tmp_path / "a"), name="none.json")
    assert dims.status(spark).first().status == "degraded" and dims.status(spark, recogniser="x 1").first().detail is None
