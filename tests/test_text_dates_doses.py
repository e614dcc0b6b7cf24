import datetime

import pytest
from pyspark.sql import functions as F

from chartloom.functions import dates, dosing, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("  a\t b  \r\nc ", "a b\nc"), ("१-०-१ `Tab` *x*", "1-0-1 Tab x"), ("1–0—1", "1-0-1"), ("½-0-1", "1/2-0-1"), ("ｆｕｌｌ ５", "full 5"), ("a b", "a b"), ("", ""), (None, None)])
def test_normalize_text(spark, raw, want):
    got = one(spark, raw, text.normalize_text)
    assert got == want
    assert one(spark, got, text.normalize_text) == want


def test_keys(spark):
    assert one(spark, " S. Creatinine! ", text.lookup_key) == "s creatinine"
    assert one(spark, "É-b 1", text.alnum_key) == "éb1"
    assert one(spark, "Blood  शर्करा (F)", text.entity_chars) == "bloodशर्कराf"


@pytest.mark.parametrize("raw,value,ambiguous", [("03/04/2026", "2026-04-03", True), ("13/04/26", "2026-04-13", False), ("31.02.2026", None, None), ("5 Sept 71", "1971-09-05", False), ("5-JAN-2020", "2020-01-05", False), ("01/13/2020", None, None), ("7 foo 2020", None, None)])
def test_parse_dmy(spark, raw, value, ambiguous):
    got = one(spark, raw, dates.parse_dmy)
    assert (got.value and str(got.value)) == value
    if value:
        assert got.ambiguous == ambiguous


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")


def test_best_date_prefers_labels_then_certainty(spark):
    out = {r.document_id: (str(r.value), r.confidence) for r in dates.best_date(docs(spark, "02/03/2020 and 25/03/2020", "25/03/2020 then Date: 02/03/2020", "seen 25/03/2020 and 26/03/2020", "Collected on: 02/03/2020 or 25/03/2020", "none"), ["document_id"]).collect()}
    assert out == {0: ("2020-03-25", 0.95), 1: ("2020-03-02", 0.70), 2: ("2020-03-25", 0.95), 3: ("2020-03-25", 0.95)}


def test_clinical_date(spark):
    rows = docs(spark, "Collected on 02/03/2020, which is more than forty characters before: printed on 05/03/2020", "Review after 02/03/2020", "01/01/1899 and 01/01/2099", "date 02/03/20", "date 05/03/2020\n" + "x" * 60 + "\ndate 02/03/2020", "दिनांक ०३/०४/२०२०", "", None, "explained 02/03/2020")
    out = {r.document_id: (r.clinical_date and str(r.clinical_date), round(r.date_confidence, 4), r.date_reason) for r in dates.clinical_date(rows, ["document_id"], "2026-01-01").collect()}
    assert out[0] == ("2020-03-02", 1.0, "labelled 'collected on'")
    assert out[1] == out[2] == out[6] == out[7] == out[8] == (None, 0.0, "no usable date found on the document")
    assert out[3] == ("2020-03-02", round(0.85 * 0.75, 4), "labelled 'date'")
    assert out[4] == ("2020-03-02", round(0.85 * 0.6, 4), "ambiguous: 2 equally-labelled dates, earliest kept")
    assert out[5] == ("2020-04-03", 0.85, "labelled 'दिनांक'")


def test_candidates_keep_every_date(spark):
    got = dates.date_candidates(docs(spark, "a 1/2/2020 b 3/4/2019 c 5-6-18"), "2026-01-01").orderBy("pos").collect()
    assert [(r.iso, round(r.score, 4)) for r in got] == [(datetime.date(2020, 2, 1), 0.35), (datetime.date(2019, 4, 3), 0.35), (datetime.date(2018, 6, 5), round(0.35 * 0.75, 4))]


@pytest.mark.parametrize("raw,want", [("1-0-1", "1 tablet in the morning and 1 tablet at night"), ("1-1-1-2 x 5 days", "1 tablet in the morning, 1 tablet in the afternoon, 1 tablet at night and 2 tablets at bedtime, for 5 days"), ("1/2 - 0 - 0", "half a tablet in the morning"), ("½-0-½", "half a tablet in the morning and half a tablet at night"), ("0-0-0", ""), ("BD for 7 days", "twice daily, for 7 days"), ("q8h", "Q8H"), ("10 days", "For 10 days"), ("03-04-2026", ""), ("022-2754-1122", ""), ("ODS", ""), ("1/0-0-1", "1 tablet at night"), ("5 दिन", "For 5 दिन")])
def test_dose_phrase(spark, raw, want):
    assert one(spark, raw, dosing.dose_phrase) == want


def test_dose_key(spark):
    for raw, want in (("Tab 500.0 MG", "500mg"), ("0.50 mcg", "0.5mcg"), ("2 units", "2unit"), ("40 IU x", "40iu"), ("none", None)):
        assert one(spark, raw, dosing.dose_key) == want
    assert one(spark, "1/2-1-0-2", lambda c: dosing.total_per_day(dosing.dose_slots(c))) == 3.5
