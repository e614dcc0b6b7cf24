"""Work that has to grow with the input, and what is sent where."""

import random

from pyspark.sql import functions as F

from chartloom.functions import dates
from chartloom.lineage import keep
from chartloom.operators import abnormal, coding, extract, fhir, interview, ocr, rules
from chartloom.plans.inputs import for_spark, pick
from chartloom.sources import dims

ANSWER = "session_id long, ord long, question_id string, value string, multi array<string>, dur_amount double, dur_unit string"


def test_tally_counts_equal_rules_once(spark):
    """Counts are those of the rules fired one by one, equal conditions meet the answers once, and rules that never fire have no row."""
    rng = random.Random(5)
    rows = [(s, i, rng.choice("ab"), rng.choice(["yes", "no", "7", None]), None, None, None) for s in range(9) for i in range(12)]
    answers = spark.createDataFrame(rows, ANSWER).repartition(3)
    whens = ["value == yes && b == 7", "value == yes && b == 7", "b == None && a >= 3", None, "value == never"]
    found = spark.createDataFrame([(n, "ab"[n % 2], "no" if n % 7 == 0 else None, whens[n % 5], f"r{n}", "urgent") for n in range(60)], rules.RULE)
    plain = rules.fired(answers, found, ["session_id"]).groupBy("rule_no", "reason", "severity").agg(F.count(F.lit(1)), F.count_distinct("session_id"), F.sum("ord").cast("long"))
    told = interview.tally(answers, found, ["session_id"])
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, plain.collect())) and 0 < told.count() < 60


def test_rules_are_what_is_broadcast(spark):
    """Answers, of a stream or not, are never sent to the driver to meet a rule file's few rules."""
    seen = spark.createDataFrame([(1, 1, "a", "yes", None, None, None, {"a": "yes"})], ANSWER + ", state map<string,string>")
    flags = interview.red_flags(seen, [{"question_id": "a", "when": "value == yes", "reason": "r", "severity": "urgent"}], ["session_id"], with_state=True)
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert [r.reason for r in flags.collect()] == ["r"]


def test_dates_of_any_numbers(spark):
    """A day that no month has is none, leap years have theirs, and no number is an error."""
    days = [(2000, 2, 29, True), (1900, 2, 29, False), (2023, 2, 29, False), (2024, 2, 29, True), (2023, 4, 31, False), (2023, 12, 31, True), (0, 1, 1, False), (2023, 13, 1, False), (2023, 0, 1, False), (2023, 1, 0, False), (None, 1, 1, False), (2023, None, 1, False), (1, 1, 1, True)]
    rows = spark.createDataFrame(days, "y int, m int, d int, good boolean").select("*", dates._date(F.col("y"), F.col("m"), F.col("d")).alias("v")).collect()
    assert all((r.v is not None) == r.good and (r.v is None or (r.v.year, r.v.month, r.v.day) == (r.y, r.m, r.d)) for r in rows)


def test_kept_rows_are_compressed_columns(spark):
    """What is kept reads as it was, nulls without a type too, from files of columns."""
    df = spark.range(50).select(F.col("id").alias("a b"), F.lit(None).alias("none"), F.array(F.struct(F.lit("x").alias("k"))).alias("l"))
    out = keep(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert all(f.endswith(".zstd.parquet") for f in out.inputFiles()) and out.inputFiles()


ENTITY = "document_id long, entity_no long, kind string, text string, value_num double, value_str string, unit string, reference_range string, system string, code string, display string, confidence double"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _made(spark, ranges=("5-9",)):
    docs = spark.createDataFrame([(i, 7, "note", "T", "2001-01-01", 0.5) for i in range(1, 5)], "document_id long, session long, suggested_type string, suggested_title string, clinical_date string, mean_confidence double")
    rows = [(1, 2, "lab", "b", 1.0, None, "%", r, None, None, None, 0.5) for r in ranges] + [(2, n, "medication", f"d{n}", None, None, None, None, None, None, None, 0.5) for n in (3, 1)] + [(2, 2, "lab", "left out", 1.0, None, "%", None, None, None, None, 0.5), (3, 1, "diagnosis", "x", None, None, None, None, None, None, None, 0.5), (3, 2, "date", "y", None, None, None, None, None, None, None, 0.5)]
    return docs, fhir.resources(docs.drop("session"), spark.createDataFrame(rows, ENTITY), ["document_id"])


def test_types_and_parts_need_no_json(spark):
    """Kinds of resources come from counts, so that neither JSON nor lists of entities are held for them; they are those of the JSON."""
    _, made = _made(spark)
    plan = _plan(made.select("document_id", "resource_type", "n_parts"))
    assert "json" not in plan and "collect_list" not in plan
    rows = made.select("*", F.get_json_object("fhir", "$.resourceType").alias("said")).orderBy("document_id").collect()
    assert [r.resource_type for r in rows] == [r.said for r in rows] == ["Observation", "Bundle", "Condition", "DocumentReference"]
    assert [r.n_parts for r in rows] == [1, 2, 1, 0]


def test_documents_are_gone_through_once_for_a_bundle(spark):
    """Ids of requests come from the session's own list, and what resources hold isn't read back from their JSON; a collection given as JSON alone makes the same bundle."""
    docs, made = _made(spark)
    whole = made.join(docs.select("document_id", "session"), "document_id")
    alerts = spark.createDataFrame([(7, 1, "major", "d1", "own", "why")], "session long, rank_no int, severity string, drug_a string, drug_b string, description string")
    request = '{"resourceType":"MedicationRequest","id":"%s","medicationCodeableConcept":{"text":"OWN"}}'
    own = spark.createDataFrame([(9, "MedicationRequest", 1, request % "m1", 7), (10, "MedicationRequest", 1, (request % "m2").replace('"id"', '"\\u0069d"'), 7)], "document_id long, resource_type string, n_parts long, fhir string, session long").withColumn("entries", F.array("fhir"))
    out = fhir.patient_bundle(whole.unionByName(own), alerts, docs.select("session").distinct(), ["session"], "document_id")
    assert _plan(out).count("Generate posexplode") == 1 and "from_json" not in _plan(out).lower() and "jsontostructs" not in _plan(out).lower()
    row = out.first()
    assert row.total == 8 and '"implicated":[{"display":"d1"},{"reference":"MedicationRequest/m2","display":"own"}]' in row.bundle
    assert fhir.patient_bundle(whole.unionByName(own).drop("entries"), alerts, docs.select("session").distinct(), ["session"], "document_id").first() == row


def test_ranges_of_any_form(spark):
    """A printed range has two sides if both are numbers, or else its text."""
    _, made = _made(spark, ("5-9", "-5-9", "5-9-", "negative", "5"))
    got = made.where("document_id = 1").select(F.get_json_object("fhir", "$.contained[*].referenceRange").alias("r")).first().r
    assert got.count('"low"') == 1 and got.count('"text"') == 4


def test_a_condition_on_a_verdict_reads_it(spark):
    """The results out of range are filtered by the verdict, not by working it out again: each range is read once."""
    labs = spark.createDataFrame([("a", 9.0, "%", "1-5", None, None), ("b", 3.0, "%", "1-5", "1-50", "%"), ("c", 60.0, "%", "1-5", "1-50", "%")], "text string, value_num double, unit string, reference_range string, curated_range string, curated_unit string")
    found = abnormal.flags(abnormal.judge(labs))
    assert _plan(found).count("regexp_extract(reference_range") == 2
    assert sorted((r.text, r.state, r.direction, r.range_text) for r in found.collect()) == [("a", "printed", "high", "1.0-5.0"), ("c", "garbled", "high", "1.0-50.0")]


def test_shipped_tables_have_a_size(spark):
    """Spark knows how small the shipped tables are before it runs, so that rows which look terms up aren't shuffled; they read as they are in the files."""
    rows = spark.range(9).select(F.concat(F.lit("Dolo "), F.col("id").cast("string")).alias("drug"))
    assert "SortMergeJoin" not in _plan(coding.drug_lookup(rows, "drug", dims.load(spark, "drug_alias")))
    for name in dims.SCHEMAS:
        table = dims.load(spark, name)
        assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000
        assert sorted(map(tuple, table.collect())) == sorted(dims.seed_rows(name))


def test_a_dose_is_read_in_few_passes(spark):
    """What a drug line's strength and duration consist of comes from one pass over the match, whatever the white space."""
    lines = spark.createDataFrame([("Tab. Dolo 500 mg 1 -\t0 - 1/2 x 3 days",), ("Tab Dolo 5.50mg BD",), ("Cap Dolo for 2 weeks",), ("Cap Dolo",)], "text string")
    found = lines.select(F.explode(extract.drug_array(F.col("text"))).alias("e"))
    assert _plan(found).count("days?|din") == 2 and _plan(found).count("(mg|mcg") == 2
    said = [(r.e.value_num, r.e.unit, r.e.value_str, r.e.text.partition(" [")[2]) for r in found.collect()]
    assert said == [(500.0, "mg", None, "1 tablet in the morning and half a tablet at night, for 3 days]"), (5.5, "mg", None, "twice daily]"), (None, None, "Dolo for", "For 2 weeks]"), (None, None, "Dolo", "")]


def test_ordered_resources_are_canonical(spark):
    """What is written in order is, to the byte, what reading it back and writing it as canonical gives: escapes, other scripts, exponents, no numbers, zeros, nulls."""
    odd = ['say "x"\\n', "tab\there\x01", "é ½ दवा 😀", "", None, "/<&> \x7f", "mg/dL"]
    numbers = [12.0, 0.5, -0.0, 1e7, 1.5e-9, float("nan"), float("-inf"), None, 100.0, 123456.789]
    rows = [(d, n, kind, odd[(d + n) % 7], numbers[(3 * d + n) % 10], odd[(d + n + 1) % 7], odd[(n + 2) % 7], ["5-9.50", "neg\"ative", None, "-0-1e9"][n % 4], ["LOINC", "own\\", None][(d + n) % 3], odd[(2 * n + d) % 7], odd[(n + d + 3) % 7], numbers[(d + n) % 10]) for d in range(24) for n, kind in enumerate((["lab", "vital", "lab", "lab"], ["medication", "medication"], ["diagnosis", "diagnosis"], ["lab"], ["medication"], ["date"], ["vital", "medication"], [])[d % 8])]
    docs = spark.createDataFrame([(d, d % 3, "note", odd[d % 7], odd[(d + 1) % 7], numbers[d % 10]) for d in range(24)], "document_id long, session long, suggested_type string, suggested_title string, clinical_date string, mean_confidence double")
    coded = spark.createDataFrame(rows, ENTITY)
    plain, ordered = (fhir.resources(docs, coded, ["document_id"], ordered=o, along=("session",)) for o in (False, True))
    read = plain.select("document_id", fhir.canonical(F.col("fhir")).alias("fhir"), F.transform("entries", fhir.canonical).alias("entries"))
    told = {r.document_id: (r.fhir, r.entries) for r in read.collect()}
    assert len(told) == 24 and {r.document_id: (r.fhir, r.entries) for r in ordered.collect()} == told
    alerts = spark.createDataFrame([(s, n, ["major", "odd", None][n], odd[n], odd[s + 2], odd[s + n]) for s in range(3) for n in range(3)], "session long, rank_no int, severity string, drug_a string, drug_b string, description string")
    bundle = lambda df, o: fhir.patient_bundle(df, alerts, docs.select("session").distinct(), ["session"], "document_id", ordered=o)
    want = {r[0]: r[1] for r in bundle(plain, False).select("session", fhir.canonical(F.col("bundle"))).collect()}
    assert len(want) == 3 and all({r.session: r.bundle for r in bundle(df, True).collect()} == want for df in (ordered, plain.drop("entries")))


def test_lists_are_worked_out_once(spark):
    """Spark puts no condition on a list's size before it is gone through, which would make all its JSON once more; and digests don't read bundles back."""
    docs, made = _made(spark)
    alerts = spark.createDataFrame([], "session long, rank_no int, severity string, drug_a string, drug_b string, description string")
    out = fhir.patient_bundle(made.join(docs.select("document_id", "session"), "document_id"), alerts, docs.select("session").distinct(), ["session"], "document_id")
    assert "Filter (size(" not in _plan(out) and _plan(out).count("DiagnosticReport") == 1
    read = _plan(fhir.entries(out, ["session"]))
    assert read.count("parseJson") == 1
    whole = spark.createDataFrame([(1, '{"entry":[]}'), (2, '{"entry":[{"resource":{"resourceType":"A"}}]}'), (3, "{}")], "session int, bundle string")
    assert [tuple(r)[:3] for r in fhir.entries(whole, ["session"]).collect()] == [(2, 0, "A")]


def test_picks_are_look_ups_for_spark(spark):
    """A pick by number is one step for Spark, with the CASE's values; nothing is picked for other numbers."""
    case = pick("CAST(id % 9 AS INT)", ["it's", "b", "c"])
    rows = spark.range(-9, 20)
    assert "CASE" not in for_spark(f"SELECT {case} || 'x' FROM t") and rows.selectExpr(case).collect() == rows.selectExpr(for_spark(case)).collect()


def test_interactions_are_dealt_out_once(spark):
    """A session's drugs are shuffled once, all that follows stays where they are; the drugs of no pair aren't shuffled; names, places and ranks are the same."""
    drugs = spark.createDataFrame([(1, 1, "Ecosprin"), (1, 2, "warfarin"), (1, 3, "ASPIRIN"), (1, 4, "nothing known"), (1, 5, None), (2, 1, "warfarin"), (3, 2, "Aspirin"), (3, 1, "Warfarin"), (3, 9, "x-1"), (3, 7, "X 1")], "session long, pos long, drug string")
    table = spark.createDataFrame([(1, "aspirin", "warfarin", "major", "bleeding"), (2, "Warfarin", "ASPIRIN", "minor", "later row"), (3, "x 1", "aspirin", "contraindicated", "own"), (4, "x 1", "X-1", "minor", "itself")], dims.SCHEMAS["interaction"])
    out = coding.interactions(drugs, ["session"], dims.load(spark, "drug_alias"), table)
    assert sorted(map(tuple, out.collect())) == [(1, 1, "major", "aspirin", "warfarin", "bleeding"), (3, 1, "contraindicated", "aspirin", "x-1", "own"), (3, 2, "major", "warfarin", "aspirin", "bleeding"), (3, 3, "minor", "x-1", "x-1", "itself")]
    small = coding.interactions(drugs, ["session"], dims.load(spark, "drug_alias"), dims.load(spark, "interaction"))
    assert "SortMergeJoin" not in _plan(small) and sum("Exchange hashpartitioning(session" in line for line in _plan(small).splitlines()) == 1


def test_means_of_pages_do_not_rest_on_partitions(spark):
    """Confidences are added from the last word to the first, wherever the rows lie, and means round as doubles."""
    rng = random.Random(3)
    said = {p: [rng.randrange(101) / 100 for _ in range(rng.choice([3, 32, 160]))] for p in range(60)}
    rows = [(p, i, 0, 0, i // 9, c) for p, cs in said.items() for i, c in enumerate(cs)]

    def mean(cs):
        total = 0.0
        for c in reversed(cs):
            total += c
        return total / len(cs)

    for parts in (1, 7):
        rng.shuffle(rows)
        words = spark.createDataFrame(rows, "page int, word_no int, block int, par int, line int, confidence double").repartition(parts)
        out = {r.page: r for r in ocr.page_confidence(words.select("page").distinct(), words, ["page"]).collect()}
        lines = {(r.page, r.line): r.mean for r in ocr.line_confidence(words, ["page"]).collect()}
        for p, cs in said.items():
            each = {k: mean(cs[9 * k : 9 * k + 9]) for k in range(len(cs) // 9 + 1) if len(cs[9 * k : 9 * k + 9]) > 1}
            assert out[p].mean_confidence == mean(cs) and out[p].worst_line == min(each.values())
            assert {k: v for (q, k), v in lines.items() if q == p} == each
    tie = spark.createDataFrame([(0.48593749999999997,), (0.5559375000000001,), (0.36593749999999997,), (None,)], "x double")
    assert [r[0] for r in tie.select(ocr.six_places(F.col("x"))).collect()] == [0.485937, 0.555938, 0.365938, None]
