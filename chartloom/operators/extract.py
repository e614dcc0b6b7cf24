"""Entities in normalised document text. All rows carry entity order so that later steps never rest on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.dates import DMY, parse_dmy
from chartloom.functions.dosing import STRENGTH, dose_phrase, let

# How sure each rule is, and the forms of lines.
ASSUMED = " (day/month order assumed, please confirm)"
RULES = {
    "bp": 0.95, "spo2": 0.95, "pulse": 0.90, "temperature": 0.90, "weight": 0.90, "height": 0.90, "resp_rate": 0.85, "dose_notation": 0.95,
    "frequency_abbrev": 0.85, "strength": 0.90, "drug_line": 0.80, "lab_row": 0.75, "date_unambiguous": 0.95, "date_assumed_dmy": 0.70, "facility": 0.60, "diagnosis_line": 0.70,
}
JUNK = r"^\s*(?:[^\sA-Za-zऀ-ॿ]++[ \t]*+)*+"
FORM = r"(Tab|Tabs|Tablet|TS|T|Cap|Caps|Capsule|Syp|Syrup|Susp|Inj|Injection|Oint|Ointment|Drops?|Gel|Cream|Powder|गोली|कैप्सूल|सिरप|इंजेक्शन)"
DRUG_LINE = rf"(?im){JUNK}{FORM}\.?\s+([A-Za-zऀ-ॿ][A-Za-z0-9ऀ-ॿ'\- ]{{1,48}}?)(?=\s*(?:\d|\(|\[|$))(.*)$"
REVERSED_LINE = rf"(?im){JUNK}([A-Za-z][A-Za-z\- ]{{1,30}}?)\s+(powder|sachet|solution|gel)\s*(.*)$"
UNIT = r"(?:mg/dL|mg/dl|g/dL|g/dl|mmol/L|mmol/l|mEq/L|µmol/L|umol/L|IU/L|U/L|mIU/L|ng/mL|ng/ml|pg/mL|µg/dL|ug/dL|cells/cumm|/cumm|lakhs?/cumm|million/cumm|10\^\d/L|fL|pg|%|mm/hr|mL/min)"
LAB_ROW = rf"(?m)^\s*([A-Za-zऀ-ॿ][A-Za-z0-9ऀ-ॿ()\-.,/ ]{{1,44}}?)\s*[:.]?\s+([<>])?\s*(\d+(?:\.\d+)?)(?:\s*({UNIT}))?(?:[\s|]*\(?(\d+(?:\.\d+)?\s*(?:-|to|–)\s*\d+(?:\.\d+)?)\)?)?\s*$"
VITALS = (
    ("pulse", r"(?i)(?=[phन])(?<![A-Za-z])(?:Pulse|PR|Heart\s*Rate|HR|नाड़ी|नाडी)\s*[:\-]?\s*(\d{2,3})\s*(bpm|/min|per\s*min)?", "bpm"),
    ("spo2", r"(?i)(?=[soऑ])(?<![A-Za-z])(?:SpO2|SaO2|O2\s*Sat|Oxygen\s*Saturation|ऑक्सीजन)\s*[:\-]?\s*(\d{2,3})\s*(%)?", "%"),
    ("temperature", r"(?i)(?=[tतब])(?<![A-Za-z])(?:Temp|Temperature|तापमान|बुखार)\.?\s*[:\-]?\s*(\d{2,3}(?:\.\d)?)\s*(?:°|deg\s*)?\s*(F|C)?(?![A-Za-z])", "F"),
    ("weight", r"(?i)(?=[wवभ])(?<![A-Za-z])(?:Weight|Wt|वजन|भार)\.?\s*[:\-]?\s*(\d{1,3}(?:\.\d{1,2})?)\s*(kgs?|kilograms?|किलो)", "kg"),
    ("height", r"(?i)(?=[hलक])(?<![A-Za-z])(?:Height|Ht|लंबाई|कद)\.?\s*[:\-]?\s*(\d{2,3}(?:\.\d)?)\s*(cms?|centimet(?:er|re)s?|m)(?![A-Za-z])", "cm"),
    ("resp_rate", r"(?i)(?=[rश])(?<![A-Za-z])(?:RR|Resp\s*Rate|Respiratory\s*Rate|श्वसन)\.?\s*[:\-]?\s*(\d{1,2})\s*(/min|per\s*min|bpm)?", "/min"),
)
PRESSURE = r"(?i)(?=[bबर])(?<![A-Za-z])(?:BP|B\.P\.?|Blood\s*Pressure|बीपी|बी\.पी\.?|रक्तचाप)\s*[:\-]?\s*(\d{2,3})\s*/\s*(\d{2,3})\s*(mm\s*Hg)?"
FACILITY = r"(?im)^.{0,80}?((?:[A-Za-zऀ-ॿ][A-Za-z0-9ऀ-ॿ&'.,\- ]{2,60}?\s*)?(?:Primary\s+Health\s+Centre|PHC|CHC|Sub\s*-?\s*Centre|District\s+Hospital|Civil\s+Hospital|Medical\s+College|Hospital|Nursing\s+Home|Clinic|Polyclinic|Diagnostics?|Diagnostic\s+Cent(?:re|er)|Laboratory|Labs?|Path\s*Lab|अस्पताल|चिकित्सालय|स्वास्थ्य\s*केंद्र))"
NAMES_FACILITY = r"(?i)(?=[cphdlअचक])(?:Centre|PHC|CHC|Hospital|College|Home|Clinic|Polyclinic|Diagnostic|Lab|अस्पताल|चिकित्सालय|केंद्र)"
DIAGNOSIS = r"(?im)^\s*(?:Dx|Diagnosis|Impression|निदान)\s*[.:]\s*(.+)$"
TITLES = {"prescription": "Prescription", "lab": "Lab Report", "condition": "Diagnosis"}



def confidence(mean: Column, rule: Column) -> Column:
    """How well the page was read times how sure the rule is, within 0 and 1."""
    sure = F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean * F.try_element_at(sure, rule)))


def _groups(match: Column, pattern: str, n: int) -> Column:
    """A match's groups 1 to n as an array, in one pass; empty for those that took no part."""
    return F.split(F.regexp_replace(match, pattern, "\x01".join(f"${i}" for i in range(1, n + 1))), "\x01", -1)


def _or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _entity(kind: str, text: Column, rule, num=None, string=None, unit=None, ref=None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (null if num is None else num).cast("double").alias("value_num"), (null if string is None else string).cast("string").alias("value_str"), (null if unit is None else unit).cast("string").alias("unit"), (null if ref is None else ref).cast("string").alias("reference_range"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"))


def _each(text: Column, pattern: str, make) -> Column:
    """An array of what make gives for each match; empty where text is null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), make)


def date_array(text: Column) -> Column:
    def made(m: Column) -> Column:
        def of(d: Column) -> Column:
            said = F.when(d["ambiguous"], F.concat(m, F.lit(ASSUMED))).otherwise(m)
            return _entity("date", said, F.when(d["ambiguous"], "date_assumed_dmy").otherwise("date_unambiguous"), string=F.date_format(d["value"], "yyyy-MM-dd"))

        return let(parse_dmy(m), of)

    return F.filter(_each(text, DMY, made), lambda e: e["value_str"].isNotNull())


def diagnosis_array(text: Column) -> Column:
    parts = lambda m: F.filter(F.transform(F.split(F.regexp_extract(m, DIAGNOSIS, 1), r"(?i)\s*(?:,|;|\band\b)\s*", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.flatten(_each(text, DIAGNOSIS, lambda m: F.transform(parts(m), lambda x: _entity("diagnosis", x, "diagnosis_line"))))


def reversed_drug_array(text: Column) -> Column:
    return _each(text, REVERSED_LINE, lambda m: _entity("medication", F.trim(m), "drug_line", string=F.trim(F.regexp_extract(m, REVERSED_LINE, 1))))


def drug_array(text: Column) -> Column:
    def made(m: Column) -> Column:
        line = F.trim(F.regexp_replace(m, r"^\s+|\s+$", ""))

        def of(g: Column) -> Column:
            rest = g[2]
            said = let(dose_phrase(rest), lambda p: F.when(p != "", F.concat(line, F.lit(" ["), p, F.lit("]"))).otherwise(line))
            return let(_groups(F.regexp_extract(rest, STRENGTH, 0), STRENGTH, 2), lambda s: _entity("medication", said, "drug_line", num=_or_null(s[0]), string=F.when(s[0] == "", F.trim(g[1])), unit=_or_null(F.get(s, F.lit(1)))))

        return let(_groups(m, DRUG_LINE, 3), of)

    return _each(text, DRUG_LINE, made)


def lab_array(text: Column) -> Column:
    def of(g: Column) -> Column:
        plain = g[1] == ""
        return _entity("lab", F.trim(g[0]), "lab_row", num=F.when(plain, g[2]), string=F.when(~plain, F.concat(g[1], g[2])), unit=_or_null(g[3]), ref=_or_null(F.replace(g[4], F.lit(" "), F.lit(""))))

    return _each(text, LAB_ROW, lambda m: let(_groups(m, LAB_ROW, 5), of))


def vital_array(text: Column) -> Column:
    def pressure(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m, PRESSURE, i)
        said = F.concat(F.trim(m), F.lit(" (systolic="), part(1), F.lit(", diastolic="), part(2), F.lit(")"))
        return _entity("vital", said, "bp", string=F.concat(part(1), F.lit("/"), part(2)), unit=F.coalesce(_or_null(part(3)), F.lit("mmHg")))

    def simple(rule: str, pattern: str, unit: str) -> Column:
        return _each(text, pattern, lambda m: _entity("vital", F.trim(m), rule, num=F.regexp_extract(m, pattern, 1), unit=F.coalesce(_or_null(F.trim(F.regexp_extract(m, pattern, 2))), F.lit(unit))))

    return F.concat(_each(text, PRESSURE, pressure), *(simple(*v) for v in VITALS))


def facility_array(text: Column) -> Column:
    """The first facility named."""
    name = F.when(text.rlike(NAMES_FACILITY), F.trim(F.regexp_extract(text, FACILITY, 1)))
    return F.filter(F.array(_entity("facility", name, "facility")), lambda e: F.coalesce(e["text"], F.lit("")) != "")


def rows(docs: DataFrame, key: list[str], found: Column) -> DataFrame:
    """One row for each entity of an array: (key, kind, text, value_num, value_str, unit, reference_range, rule)."""
    return docs.select(*key, F.explode(found).alias("e")).select(*key, "e.*")


#: What finds each kind, in order.
FINDERS = (("date", date_array), ("diagnosis", diagnosis_array), ("medication", reversed_drug_array), ("medication", drug_array), ("lab", lab_array), ("vital", vital_array), ("facility", facility_array))


def entities(docs: DataFrame, key: list[str], mean_col: str = "mean_confidence", text_col: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(key, entity_no, kind, text, value_num, value_str, unit, reference_range, confidence) in the order dates, diagnoses, reversed drug lines, drug lines, labs, vitals, facility; of some kinds only, if they are given, and then only these are looked for. One pass over the documents, no shuffle."""
    text = F.col(text_col)
    every = F.concat(*(f(text) for k, f in FINDERS if kinds is None or k in kinds))
    out = docs.select(*key, F.col(mean_col).alias("_mean"), F.posexplode(every).alias("entity_no", "e"))
    return out.select(*key, "entity_no", *(f"e.{c}" for c in ("kind", "text", "value_num", "value_str", "unit", "reference_range")), confidence(F.col("_mean"), F.col("e.rule")).alias("confidence"))


def structure(docs: DataFrame, found: DataFrame, key: list[str], hint_col: str = "hint") -> DataFrame:
    """One row for each document: suggested_type, suggested_title, facility, mean_confidence, n_entities, warnings. A hint, if given, is the type."""
    per = found.groupBy(*key).agg(F.bool_or(F.col("kind") == "medication").alias("m"), F.bool_or(F.col("kind") == "lab").alias("l"), F.bool_or(F.col("kind") == "diagnosis").alias("d"), F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("n_entities"), F.min_by(F.when(F.col("kind") == "facility", F.col("text")), F.when(F.col("kind") == "facility", F.col("entity_no"))).alias("facility"))
    kind = F.coalesce(F.nullif(F.col(hint_col), F.lit("")), F.when(F.col("m"), "prescription").when(F.col("l"), "lab").when(F.col("d"), "condition").otherwise("note"))
    titles = F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv))
    out = docs.drop("mean_confidence").join(per, key, "left").withColumn("suggested_type", kind)
    title = F.when(F.col("facility").isNull(), "Untitled document").otherwise(F.concat(F.coalesce(F.try_element_at(titles, F.col("suggested_type")), F.lit("Document")), F.lit(" — "), "facility"))
    warnings = F.array_compact(F.array(F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text on the page"), F.when(F.col("n_entities").isNull(), "nothing recognised on the page")))
    return out.select(*key, "suggested_type", title.alias("suggested_title"), "facility", F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"), F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities"), warnings.alias("warnings"))
