from difflib import SequenceMatcher

from pyspark.sql import functions as F

from chartloom.operators import abnormal, coding, extract
from chartloom.sources import dims

REPORT = "SUNRISE DIAGNOSTICS\nCollected on 13/03/2024\nTest Result Unit Range\nFasting blood sugar   142   mg/dL   70 - 100\nHDL cholesterol: 38 mg/dL (40-60)\nTSH <0.1 mIU/L\nHb 11.2 g/dL\nCRP 12 mg/L"
SLIP = "City Clinic\nBP: 140/90 mmHg Pulse 88 SpO2 97% Temp 99.1 F Wt: 70 kg\nDx: Hypertension, Type 2 diabetes mellitus and Asthma\n1. Tab. Glycomet 500mg 1-0-1 x 30 days\n- Syp Crocin 5 ml SOS\nElectral powder 1 sachet\nTab Menopace\nReview 10/05/2024"


def found(spark, *texts, mean=0.9):
    docs = spark.createDataFrame([(i, t, mean) for i, t in enumerate(texts)], "document_id int, text string, mean_confidence double")
    return extract.entities(docs, ["document_id"]), docs


def test_labs(spark):
    rows = [r for r in found(spark, REPORT)[0].orderBy("entity_no").collect() if r.kind == "lab"]
    assert [(r.text, r.value_num, r.value_str, r.unit, r.reference_range) for r in rows] == [("Fasting blood sugar", 142.0, None, "mg/dL", "70-100"), ("HDL cholesterol", 38.0, None, "mg/dL", "40-60"), ("TSH", None, "<0.1", "mIU/L", None), ("Hb", 11.2, None, "g/dL", None)]
    assert all(abs(r.confidence - 0.675) < 1e-9 for r in rows)


def test_slip(spark):
    rows = found(spark, SLIP)[0].orderBy("entity_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r.kind, []).append(r)
    assert [r.text for r in by["diagnosis"]] == ["Hypertension", "Type 2 diabetes mellitus", "Asthma"]
    assert [(r.value_str, r.unit) for r in by["vital"][:1]] == [("140/90", "mmHg")]
    assert {(r.value_num, r.unit) for r in by["vital"][1:]} == {(88.0, "bpm"), (97.0, "%"), (99.1, "F"), (70.0, "kg")}
    meds = by["medication"]
    assert meds[0].value_str == "Electral" and meds[0].text.startswith("Electral powder")
    assert meds[1].text == "1. Tab. Glycomet 500mg 1-0-1 x 30 days [1 tablet in the morning and 1 tablet at night, for 30 days]" and meds[1].value_num == 500.0
    assert meds[2].text == "- Syp Crocin 5 ml SOS [as needed]" and meds[3].value_str == "Menopace"
    assert [r.kind for r in rows] == sorted((r.kind for r in rows), key=["date", "diagnosis", "medication", "lab", "vital", "facility"].index)
    assert by["facility"][0].text.startswith("City Clinic")


def test_structure(spark):
    e, docs = found(spark, REPORT, SLIP, "nothing here", "", None, "Dx: Asthma")
    out = {r.document_id: r for r in extract.structure(docs.withColumn("hint", F.when(F.col("document_id") == 2, "imaging")), e, ["document_id"]).collect()}
    assert [out[i].suggested_type for i in range(6)] == ["lab", "prescription", "imaging", "note", "note", "condition"]
    assert out[0].suggested_title == "Lab Report — SUNRISE DIAGNOSTICS" and out[2].suggested_title == "Untitled document"
    assert out[4].n_entities == 0 and out[4].mean_confidence == 0.0 and len(out[3].warnings) == 2


def load(spark):
    return [dims.load(spark, n) for n in ("lab_alias", "drug_alias", "condition_alias")]


def test_codes(spark):
    coded = {(r.document_id, r.text): r for r in coding.code_entities(found(spark, REPORT, SLIP)[0], *load(spark)).collect()}
    assert coded[0, "Fasting blood sugar"].code == "1558-6" and coded[0, "HDL cholesterol"].code == "2085-9"
    assert coded[1, "Asthma"].system == "SNOMED" and not coded[1, "Asthma"].review
    assert next(r for k, r in coded.items() if "Glycomet" in k[1]).code == "6809"
    assert next(r for k, r in coded.items() if "Menopace" in k[1]).code is None


def test_fuzzy_against_difflib(spark):
    lab = dims.load(spark, "lab_alias")
    every = [(dims_row[2].lower().replace("-", " ").replace(".", "").replace("+", "").strip(), dims_row) for dims_row in dims.seed_rows("lab_alias")]
    terms = ["Fasting blod sugar", "VLDL cholesterol", "platelet cuont", "zzz", "", "TSH", "serum sodum"]
    out = {r.t: r for r in coding.fuzzy_lookup(spark.createDataFrame([(t,) for t in terms], "t string"), "t", lab).collect()}
    for t in terms:
        best = max(SequenceMatcher(None, t.lower(), " ".join(k.split())).ratio() for k, _ in every)
        assert (out[t].code is not None) == (best >= coding.FUZZY and t != "")
        if out[t].code:
            assert abs(out[t].score - best) < 1e-9 and out[t].review == (best < 1)
    assert out["VLDL cholesterol"].code == "13457-7" and out["VLDL cholesterol"].review


def test_interactions(spark):
    rows = [("s", 0, "Ecosprin"), ("s", 1, "Warf"), ("s", 2, "aspirin"), ("s", 3, "Unknown"), ("t", 0, "Warf"), ("u", 0, None), ("v", 0, "Brufen"), ("v", 1, "Telma"), ("v", 2, "Voveran")]
    out = coding.interactions(spark.createDataFrame(rows, "session string, pos int, drug string"), ["session"], dims.load(spark, "drug_alias"), dims.load(spark, "interaction"))
    got = sorted((r.session, r.rank_no, r.severity, r.drug_a, r.drug_b) for r in out.collect())
    assert got == [("s", 1, "major", "aspirin", "warfarin"), ("v", 1, "major", "ibuprofen", "diclofenac"), ("v", 2, "moderate", "ibuprofen", "telmisartan")]
    lines = {r.session: r.summary for r in coding.interaction_line(out, spark.createDataFrame([("s",), ("t",), ("v",)], "session string"), ["session"]).collect()}
    assert lines["s"].startswith("Serious interaction") and "does not mean" in lines["t"]


def test_primary_drug(spark):
    rows = spark.createDataFrame([(1, "Tab. Foo Glycomet 500mg"), (2, "Cap Bar 5 mg"), (3, "Tab 5 mg")], "i int, t string")
    assert {r.i: (r.drug_name, r.generic) for r in coding.primary_drug(rows, ["i"], "t", dims.load(spark, "drug_alias")).collect()} == {1: ("Glycomet", "metformin"), 2: ("Bar", None)}


def test_abnormal_table(spark):
    rows = [
        ("inside", 80.0, "mg/dL", "70-100", "70-100", "mg/dL", "printed", None), ("high", 142.0, "mg/dL", "70-100", None, None, "printed", "high"), ("low", 60.0, "mg/dL", "70-100", None, None, "printed", "low"),
        ("edge", 100.0, "mg/dL", "70-100", "70-100", "mg/dL", "printed", None), ("curated", 142.0, "mg/dL", None, "70-100", "mg/dL", "curated", "high"), ("none", 142.0, "mg/dL", None, None, None, "missing", None),
        ("units", 142.0, "mmol/L", "70-100", "70-100", "mg/dL", "unit", None), ("same unit", 142.0, "U/L", "70-100", "70-100", "IU/L", "printed", "high"), ("garbled", 101.0, "mg/dL", "70-1000", "70-100", "mg/dL", "garbled", "high"),
        ("narrow", 80.0, "mg/dL", "70-71", "70-100", "mg/dL", "garbled", None), ("differs", 105.0, "mg/dL", "70-110", "70-100", "mg/dL", "differs", None), ("inverted", 142.0, "mg/dL", "100-70", None, None, "missing", None),
        ("words", None, "mg/dL", "70-100", None, None, "none", None), ("unparsed", 142.0, "mg/dL", "about 70", "70-100", "mg/dL", "curated", "high"),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "text string, value_num double, unit string, reference_range string, curated_range string, curated_unit string")
    out = {r.text: (r.state, r.direction) for r in abnormal.judge(df).collect()}
    assert out == {r[0]: r[6:] for r in rows}
    flags = {r.text: r.range_text for r in abnormal.flags(abnormal.judge(df)).collect()}
    assert flags["high"] == "70.0-100.0" and flags["garbled"] == "70.0-100.0"


def test_seed_hygiene_and_csv(spark, tmp_path):
    for n in ("lab_alias", "drug_alias", "condition_alias"):
        assert dims.hygiene(dims.load(spark, n)).count() == 0
    (tmp_path / "interaction.csv").write_text("﻿row_no,drug_a,drug_b,severity,description\n0, warfarin ,aspirin,major,\n1,#off,x,minor,y\n", encoding="utf-8")
    assert [tuple(r) for r in dims.load(spark, "interaction", str(tmp_path)).collect()] == [(0, "warfarin", "aspirin", "major", "")]
    assert dims.load(spark, "lab_alias", str(tmp_path)).count() == 0
