"""FHIR-shaped JSON: one resource a document, one bundle a session. Always drafts; never an invented code."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.dosing import let

# Code systems and UCUM units (cells/cumm and lakhs/cumm have none on purpose).
SYSTEMS = {"LOINC": "http://loinc.org", "SNOMED": "http://snomed.info/sct", "RxNorm": "http://www.nlm.nih.gov/research/umls/rxnorm"}
UCUM = {"mg/dl": "mg/dL", "%": "%", "g/dl": "g/dL", "u/l": "U/L", "ng/ml": "ng/mL", "pg/ml": "pg/mL", "mg/l": "mg/L", "kg": "kg", "mm/hr": "mm/h", "meq/l": "meq/L", "mmhg": "mm[Hg]", "degf": "[degF]", "miu/l": "m[IU]/L"}
CATEGORY = "http://terminology.hl7.org/CodeSystem/observation-category"
SEVERITY = {"contraindicated": "high", "major": "high", "minor": "low"}


def _map(d: dict, x: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in d.items() for v in kv)), x)


# Resources are described by dicts (objects), lists, strings (fixed text) and columns (text), and by these: a number, a text that is never null, a text
# whose JSON is at hand, a part that is there on a condition, a value worked out once for a part, JSON as it is. What is null is left out of its object.
Number = namedtuple("Number", "of")
Sure = namedtuple("Sure", "of")
Known = namedtuple("Known", "of json")
When = namedtuple("When", "condition part")
Let = namedtuple("Let", "value part")
Raw = namedtuple("Raw", "json")

#: What JSON writes otherwise in a string; U+FFFD as bytes that are no character are read as that.
_ESCAPED = r'[\x00-\x1f"\\\x{fffd}]'


def _value(x) -> Column:
    """A description as a column of structs and arrays, its fields in the order described."""
    if isinstance(x, dict):
        return F.struct(*(_value(v).alias(k) for k, v in x.items()))
    if isinstance(x, list):
        return F.array(*map(_value, x))
    if isinstance(x, When):
        return F.when(x.condition, _value(x.part))
    if isinstance(x, Let):
        return let(x.value, lambda v: _value(x.part(v)))
    return x.of if isinstance(x, (Number, Sure, Known)) else F.lit(x) if isinstance(x, str) else x


def _quoted(x: Column) -> Column:
    whole = F.to_json(F.struct(x.alias("v")))
    return F.when(x.rlike(_ESCAPED), F.substring(whole, F.lit(6), F.char_length(whole) - 6)).otherwise(F.concat(F.lit('"'), x, F.lit('"')))


def _plain(x: Column) -> Column:
    """A number without needless zeros, as canonical writes it: with an exponent it stays, and what is no number is text."""
    short = lambda s: F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))
    return let(x.cast("string"), lambda s: F.when(s.isin("NaN", "Infinity", "-Infinity"), F.concat(F.lit('"'), s, F.lit('"'))).when(s == "-0.0", "0").when(F.contains(s, F.lit(".")) & ~F.contains(s, F.lit("E")), short(s)).otherwise(s))


def _flat(pieces: list) -> Column:
    """Pieces of text in a row; neighbours that are fixed become one."""
    out: list = []
    for p in pieces:
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        else:
            out.append(p)
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in out))


def _members(x: dict) -> list:
    """Pieces of an object's members in order. Those that may be left out bring their comma with them, where another is sure to be there."""
    parts = [(f'"{k}":', v, isinstance(v, (str, dict, list, Sure, Raw))) for k, v in sorted(x.items())]
    sure = next((i for i, p in enumerate(parts) if p[2]), None)
    if sure is None:
        return [F.concat_ws(",", *(_flat([k, *_pieces(v)]) for k, v, _ in parts))]
    out: list = []
    for i, (k, v, always) in enumerate(parts):
        comma = ("", ",") if i < sure else ("," if i > sure else "", "")
        piece = [comma[0], k, *_pieces(v), comma[1]]
        out += piece if always else [F.coalesce(_flat(piece), F.lit(""))]
    return out


def _pieces(x) -> list:
    if isinstance(x, dict):
        return ["{", *_members(x), "}"]
    if isinstance(x, list):
        return ["[", *(p for i, v in enumerate(x) for p in ([","] if i else []) + _pieces(v)), "]"]
    if isinstance(x, When):
        return [F.when(x.condition, ordered_json(x.part))]
    if isinstance(x, Let):
        return [let(x.value, lambda v: ordered_json(x.part(v)))]
    return [_plain(x.of) if isinstance(x, Number) else _quoted(x.of) if isinstance(x, Sure) else x.json if isinstance(x, (Known, Raw)) else f'"{x}"' if isinstance(x, str) else _quoted(x)]


def ordered_json(x) -> Column:
    """A description as the JSON text that canonical gives of it, without reading it back. Lists hold objects and fixed texts only."""
    return _flat(_pieces(x))


def _listed(d: dict, x: Column) -> Known:
    """_map of fixed texts that JSON writes as they are."""
    return Known(_map(d, x), _map({k: f'"{v}"' for k, v in d.items()}, x))


def ucum(unit: Column) -> Column:
    """The unit's UCUM code, or null rather than a guess."""
    return _map(UCUM, F.lower(unit))


def _concept(system: Column, code: Column, display: Column, text: Column) -> dict:
    url = _listed(SYSTEMS, system)
    return {"coding": When(code.isNotNull(), [{"system": Known(F.coalesce(url.of, system), F.coalesce(url.json, _quoted(system))), "code": Sure(code), "display": display}]), "text": text}


def _provenance(confidence: Column) -> list:
    return [{"url": "urn:chartloom:confidence", "valueDecimal": Number(F.bround(confidence, 3))}]


def _observation(of=F.col) -> dict:
    unit = F.coalesce(of("unit"), F.lit(""))
    quantity = When(of("value_num").isNotNull(), {"value": Number(of("value_num")), "unit": Sure(unit), "system": "http://unitsofmeasure.org", "code": _listed(UCUM, F.lower(of("unit")))})
    sides = F.transform(F.split(of("reference_range"), "-", 2), lambda v: v.try_cast("double"))
    side = lambda v: {"value": Number(v), "unit": Sure(unit)}
    given = lambda s: (F.size(s) == 2) & s[0].isNotNull() & s[1].isNotNull()
    ref = When(of("reference_range").isNotNull(), [Let(sides, lambda s: {"low": When(given(s), side(s[0])), "high": When(given(s), side(s[1])), "text": When(~given(s), of("reference_range"))})])
    category = [{"coding": [{"system": CATEGORY, "code": Sure(F.when(of("kind") == "lab", "laboratory").otherwise("vital-signs"))}]}]
    return {"resourceType": "Observation", "status": "preliminary", "category": category, "code": _concept(of("system"), of("code"), of("display"), of("text")), "effectiveDateTime": of("effective"), "valueQuantity": quantity, "valueString": When(of("value_num").isNull(), of("value_str")), "referenceRange": ref, "extension": _provenance(of("confidence"))}


def _medication_request(of=F.col) -> dict:
    name = F.coalesce(of("display"), of("value_str"), of("text"))
    return {"resourceType": "MedicationRequest", "status": "draft", "intent": "order", "medicationCodeableConcept": _concept(of("system"), of("code"), of("display"), name), "dosageInstruction": [{"text": of("text")}], "authoredOn": of("effective"), "extension": _provenance(of("confidence"))}


def _condition(of=F.col) -> dict:
    status = lambda kind, code: {"coding": [{"system": f"http://terminology.hl7.org/CodeSystem/{kind}", "code": code}]}
    return {"resourceType": "Condition", "clinicalStatus": status("condition-clinical", "active"), "verificationStatus": status("condition-ver-status", "provisional"), "code": _concept(of("system"), of("code"), of("display"), of("text")), "onsetDateTime": of("effective"), "extension": _provenance(of("confidence"))}


def concept(system: Column, code: Column, display: Column, text: Column) -> Column:
    return _value(_concept(system, code, display, text))


def provenance(confidence: Column) -> Column:
    return _value(_provenance(confidence))


def observation(of=F.col) -> Column:
    """Of an entity row with code columns and effective (date text), or whatever `of` gives by these names: a preliminary lab value or vital sign."""
    return _value(_observation(of))


def medication_request(of=F.col) -> Column:
    """A draft order that names the drug; the strength stays in the line's text."""
    return _value(_medication_request(of))


def condition(of=F.col) -> Column:
    return _value(_condition(of))


#: What resources are made from.
_MADE_FROM = ("text", "value_num", "value_str", "unit", "reference_range", "system", "code", "display", "confidence", "kind")


def resources(docs: DataFrame, coded: DataFrame, key: list[str], ordered: bool = False, along: tuple[str, ...] = ()) -> DataFrame:
    """(key, resource_type, n_parts, fhir, entries): each document's one top-level resource; entries are what a bundle takes from it, a collection's members or the resource.

    docs has (key, suggested_type, suggested_title, clinical_date text, mean_confidence). Labs or vitals without drugs make an
    observation, or a report that contains several (or none); drugs make a request or a collection; else
    diagnoses; else a reference to the document. A prescription leaves its vitals and diagnoses out. Rows are grouped as they are: JSON is
    made after that, of what the document's resource holds; type and parts come from counts. `ordered` writes it as canonical would.
    The columns of docs that `along` names come last.
    """
    group = F.when(F.col("kind").isin("lab", "vital"), "obs").when(F.col("kind") == "medication", "meds").when(F.col("kind") == "diagnosis", "dx")
    counts = [F.count_if(F.col("_g") == g).alias(f"_{g}") for g in ("obs", "meds", "dx")]
    row = F.when(F.col("_g").isNotNull(), F.struct("_g", "entity_no", *_MADE_FROM))
    per = coded.withColumn("_g", group).groupBy(*key).agg(*counts, F.collect_list(row).alias("_rows"))
    a = docs.join(per, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_obs", "_meds", "_dx")})
    which = F.when((F.col("suggested_type") == "lab") | ((F.col("_obs") > 0) & (F.col("_meds") == 0)), "obs").when((F.col("suggested_type") == "prescription") | (F.col("_meds") > 0), "meds").when(F.col("_dx") > 0, "dx").otherwise("none")
    a = a.withColumn("which", which).withColumn("_n", F.when(F.col("which") == "obs", F.col("_obs")).when(F.col("which") == "meds", F.col("_meds")).when(F.col("which") == "dx", F.col("_dx")).otherwise(0))

    # of a resource either its JSON, or the text before and after where an id would be
    forms = {"head": lambda d: _flat(["{", *_members({k: v for k, v in d.items() if k < "id"})]), "tail": lambda d: _flat([*_members({k: v for k, v in d.items() if k > "id"}), "}"])} if ordered else {"json": lambda d: F.to_json(_value(d))}
    write = ordered_json if ordered else lambda d: F.to_json(_value(d))

    date = F.col("clinical_date")
    if ordered:
        a = a.withColumn("_date", _quoted(date))
        date = Known(date, F.col("_date"))

    held = F.coalesce(F.filter("_rows", lambda x: x["_g"] == F.col("which")), F.array().cast(per.schema["_rows"].dataType))

    def made(kind) -> Column:
        of = lambda x: lambda c: date if c == "effective" else x[c]
        return F.transform(held, lambda x: F.struct(x["entity_no"], *(f(kind(of(x))).alias(n) for n, f in forms.items())))

    def text(e: Column, id_: Column | None = None) -> Column:
        named = [] if id_ is None else [F.lit('"id":"obs-'), id_.cast("string"), F.lit('",')]
        return F.concat(e["head"], F.lit(","), *named, e["tail"]) if ordered else F.concat(F.lit("{"), *named, F.substring(e["json"], F.lit(2), F.char_length(e["json"]))) if named else e["json"]

    a = a.withColumn("_made", F.sort_array(F.when(F.col("which") == "obs", made(_observation)).when(F.col("which") == "meds", made(_medication_request)).otherwise(made(_condition)))).withColumn("parts", F.transform("_made", lambda e: text(e)))
    listed = lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))
    named = listed(F.transform("_made", lambda e, i: text(e, i + 1)))
    refs = listed(F.transform("_made", lambda e, i: F.concat(F.lit('{"reference":"#obs-'), (i + 1).cast("string"), F.lit('"}'))))
    head = {"resourceType": "DiagnosticReport", "status": "preliminary", "code": {"text": F.col("suggested_title")}, "effectiveDateTime": date, "extension": _provenance(F.col("mean_confidence"))}
    report = write(head | {"contained": Raw(named), "result": Raw(refs)}) if ordered else F.concat(F.regexp_replace(write(head), r"\}$", ""), F.lit(',"contained":'), named, F.lit(',"result":'), refs, F.lit("}"))
    members = listed(F.transform("parts", lambda p: F.concat(F.lit('{"resource":'), p, F.lit("}"))))
    collection = F.concat(F.lit('{"entry":'), members, F.lit(',"resourceType":"Bundle","type":"collection"}')) if ordered else F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":'), members, F.lit("}"))
    reference = write({"resourceType": "DocumentReference", "status": "current", "docStatus": "preliminary", "description": F.col("suggested_title"), "date": date, "extension": _provenance(F.col("mean_confidence"))})
    one, none, report_ = F.col("_n") == 1, F.col("which") == "none", F.col("which") == "obs"
    single = F.when(report_, "Observation").when(F.col("which") == "meds", "MedicationRequest").otherwise("Condition")
    kind = F.when(none, "DocumentReference").when(one, single).when(report_, "DiagnosticReport").otherwise("Bundle")
    fhir = F.when(none, reference).when(one, F.try_element_at("parts", F.lit(1))).when(report_, report).otherwise(collection)
    entries = F.when(none, F.array(reference)).when(report_ & ~one, F.array(report)).otherwise(F.col("parts"))
    return a.select(*key, kind.alias("resource_type"), F.col("_n").cast("long").alias("n_parts"), fhir.alias("fhir"), entries.alias("entries"), *along)


def _may_have_id(json: Column) -> Column:
    """False only for what is no medication request or has no id; cheaper than reading the JSON. Either word may be written with escapes."""
    return (F.contains(json, F.lit('"MedicationRequest"')) & F.contains(json, F.lit('"id"'))) | F.contains(json, F.lit("\\u"))


def _request_id(json: Column) -> dict[str, Column]:
    """name and id of a medication request that has both; nulls for anything else."""
    get = lambda path: F.get_json_object(json, path)
    request = get("$.resourceType") == "MedicationRequest"
    return {"name": F.when(request, F.nullif(F.lower(get("$.medicationCodeableConcept.text")), F.lit(""))), "id": F.when(request, F.nullif(get("$.id"), F.lit("")))}


def medication_ids(resources_: DataFrame, session: list[str]) -> DataFrame:
    """(session, name, id) of the medication requests (session, json) that have an id, by their lower-cased drug text; of several the last id in code-point order."""
    rows = resources_.where(_may_have_id(F.col("json"))).select(*session, *(v.alias(n) for n, v in _request_id(F.col("json")).items()))
    return rows.where("name is not null and id is not null").groupBy(*session, "name").agg(F.max("id").alias("id"))


def _issue(severity: Column, drug_a: Column, drug_b: Column, description: Column, id_a: Column, id_b: Column) -> dict:
    one = lambda name, at: {"reference": F.concat(F.lit("MedicationRequest/"), at), "display": name}
    return {"resourceType": "DetectedIssue", "status": "preliminary", "severity": F.coalesce(_map(SEVERITY, severity), F.lit("moderate")), "code": {"text": "Drug-drug interaction"}, "implicated": [one(drug_a, id_a), one(drug_b, id_b)], "detail": description}


def detected_issues(alerts: DataFrame, session: list[str], ids: DataFrame | None = None) -> DataFrame:
    """(session, at, json): an issue for each alert. ids (session, name, id), if given, name the requests that are implicated; a drug without one is shown by its name alone, and the issue stays."""
    found = alerts
    for side in ("drug_a", "drug_b"):
        if ids is None:
            found = found.withColumn(f"_{side}", F.lit(None).cast("string"))
        else:
            found = found.join(ids.select(*session, F.col("name").alias(side), F.col("id").alias(f"_{side}")), [*session, side], "left")
    issue = _issue(*(F.col(c) for c in ("severity", "drug_a", "drug_b", "description", "_drug_a", "_drug_b")))
    return found.select(*session, F.col("rank_no").alias("at"), F.to_json(_value(issue)).alias("json"))


def patient_bundle(per_document: DataFrame, alerts: DataFrame, sessions: DataFrame, session: list[str], order_col: str = "pos", ordered: bool = False) -> DataFrame:
    """(session, total, bundle): documents in timeline order, collections flattened, then interaction issues; tagged as a draft.

    per_document as from resources; without entries, collections are read from their JSON. Documents are grouped once: the requests that issues implicate are looked up in the session's own list.
    `ordered` gives the text that canonical gives of the bundle; entries are then to be as ordered resources are, and what is read from JSON is made so.
    """
    if "entries" in per_document.columns:
        own = F.col("entries")
    else:
        parsed = F.coalesce(F.from_json(F.when(F.col("resource_type") == "Bundle", F.get_json_object("fhir", "$.entry")), "array<struct<resource:string>>"), F.array().cast("array<struct<resource:string>>"))
        own = F.when(F.col("resource_type") == "Bundle", F.transform(parsed, lambda e: e["resource"])).otherwise(F.array("fhir"))
        own = F.transform(own, canonical) if ordered else own
    # outer, as Spark would otherwise work the lists out once more, to leave empty ones out before
    flat = per_document.select(*session, F.col(order_col).cast("long").alias("at"), F.posexplode_outer(own).alias("i", "json")).where("i is not null")
    entry = lambda g, at, i, json: F.struct(F.lit(g).alias("g"), at.alias("at"), i.alias("i"), json.alias("json"))
    named = F.when(_may_have_id(F.col("json")), F.struct(*(v.alias(n) for n, v in _request_id(F.col("json")).items())))
    per = flat.groupBy(*session).agg(F.collect_list(entry(0, F.col("at"), F.col("i"), F.col("json"))).alias("_e"), F.collect_list(named).alias("_ids"))
    told = alerts.groupBy(*session).agg(F.collect_list(F.struct(F.col("rank_no").cast("long").alias("at"), "severity", "drug_a", "drug_b", "description")).alias("_alerts"))
    a = sessions.join(per, session, "left").join(told, session, "left")
    write = ordered_json if ordered else lambda d: F.to_json(_value(d))
    id_of = lambda drug: F.array_max(F.transform(F.filter("_ids", lambda x: x["name"] == drug), lambda x: x["id"]))
    issues = F.transform("_alerts", lambda x: entry(1, x["at"], F.lit(0), write(_issue(x["severity"], x["drug_a"], x["drug_b"], x["description"], id_of(x["drug_a"]), id_of(x["drug_b"])))))
    kind = "array<struct<g:int,at:bigint,i:int,json:string>>"
    listed = F.sort_array(F.concat(*(F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (F.col("_e"), issues))))
    a = a.withColumn("e", F.transform(listed, lambda e: F.concat(F.lit('{"resource":'), e["json"], F.lit("}"))))
    n, members = F.size("e").cast("string"), F.array_join("e", ",")
    if ordered:
        whole = F.concat(F.lit('{"entry":['), members, F.lit('],"meta":{"tag":[{"code":"draft"}]},"resourceType":"Bundle","total":'), n, F.lit(',"type":"collection"}'))
    else:
        whole = F.concat(F.lit('{"resourceType":"Bundle","type":"collection","meta":{"tag":[{"code":"draft"}]},"total":'), n, F.lit(',"entry":['), members, F.lit("]}"))
    return a.select(*session, F.size("e").cast("long").alias("total"), whole.alias("bundle"))


def abnormal_markers(found: DataFrame, flags: DataFrame, key: list[str]) -> DataFrame:
    """Entities with the direction of the last flag of the same analyte in the same document."""
    last = flags.groupBy(*key, F.lower("text").alias("_a")).agg(F.max_by("direction", "entity_no").alias("marker"))
    return found.withColumn("_a", F.lower("text")).join(last, [*key, "_a"], "left").drop("_a")


def canonical(text: Column) -> Column:
    """JSON with its keys in order and numbers without needless zeros, so that equal values have equal text."""
    return F.to_json(F.parse_json(text))


def entries(bundles: DataFrame, session: list[str]) -> DataFrame:
    """(session, at, resource_type, resource variant) of bundles (session, bundle): each entry, as a value that variant_get reads."""
    whole = F.variant_get(F.parse_json("bundle"), "$.entry", "array<variant>")
    rows = bundles.select(*session, F.posexplode_outer(whole).alias("at", "e")).where("at is not null")
    return rows.select(*session, "at", F.variant_get("e", "$.resource.resourceType", "string").alias("resource_type"), F.variant_get("e", "$.resource", "variant").alias("resource"))
