"""Summary sections and contradictions. Every section names the documents it rests on; templates translate, data doesn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The hedge's limit, templates with their Hindi, ways to deny taking medicine.
HEDGE = 0.6
TEMPLATES = {
    "Abnormal results:": "असामान्य परिणाम:",
    "All investigations on file:": "उपलब्ध सभी जाँच रिपोर्ट:",
    "Drug interaction warnings:": "दवा पारस्परिक प्रभाव चेतावनी:",
    "No medications or allergy records found among the documents provided.": "प्रदान किए गए दस्तावेज़ों में कोई दवा या एलर्जी रिकॉर्ड नहीं मिला।",
    "No prior investigation reports found among the documents provided.": "प्रदान किए गए दस्तावेज़ों में कोई पिछली जाँच रिपोर्ट नहीं मिली।",
    "(as read; low confidence)": "(जैसा पढ़ा गया; कम विश्वसनीयता)",
}
DENIALS = r"(?i)\bno medicin|\bnot (on|taking) any medic|\bdon'?t take any medic|\bno tablets?\b|\bkoi dawa nahi\b"
NO = ("False", "no", "no_tell")  # False is a boolean's text


def translate(text: Column) -> Column:
    """The Hindi of a template; other text stays."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TEMPLATES.items() for x in kv)), text), text)


def shown_date(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("undated"))


def _lines(rows: DataFrame, session: list[str], *order: str) -> DataFrame:
    made = F.array_sort(F.collect_list(F.struct(*order, "en", "hi", "document_id")))
    return rows.groupBy(*session).agg(made.alias("l")).select(*session, F.array_join(F.transform("l", lambda x: x["en"]), "\n").alias("en"), F.array_join(F.transform("l", lambda x: x["hi"]), "\n").alias("hi"), F.array_distinct(F.array_compact(F.transform("l", lambda x: x["document_id"]))).alias("provenance"))


def drug_section(timeline: DataFrame, found: DataFrame, sessions: DataFrame, session: list[str]) -> DataFrame:
    """(session, heading, en, hi, provenance, confidence): drug lines of the newest document first, then allergy records; mean confidence of the drugs.

    timeline: (session, document_id, pos, kind, title, date); found: (session, document_id, entity_no, kind, text, confidence).
    """
    meds = found.where("kind = 'medication'").drop("kind").join(timeline.select(*session, "document_id", "pos", "date"), [*session, "document_id"])
    weak = F.col("confidence") < HEDGE
    line = lambda hedge: F.concat("text", F.when(weak, F.concat(F.lit(" "), hedge)).otherwise(""), F.lit(" — "), shown_date(F.col("date")))
    hedge = F.lit("(as read; low confidence)")
    a = meds.select(*session, F.lit(0).alias("g"), (-F.col("pos")).alias("p"), F.col("entity_no").alias("e"), line(hedge).alias("en"), line(translate(hedge)).alias("hi"), "document_id")
    allergy = F.concat(F.lit('Allergy record on file: "'), "title", F.lit('" — '), shown_date(F.col("date")))
    b = timeline.where("kind = 'allergy'").select(*session, F.lit(1).alias("g"), F.col("pos").alias("p"), F.lit(0).alias("e"), allergy.alias("en"), allergy.alias("hi"), "document_id")
    text = _lines(a.unionByName(b), session, "g", "p", "e")
    mean = meds.groupBy(*session).agg(F.avg("confidence").alias("confidence"))
    none = F.lit("No medications or allergy records found among the documents provided.")
    out = sessions.join(text, session, "left").join(mean, session, "left")
    return out.select(*session, F.lit("drugs_allergy").alias("heading"), F.coalesce("en", none).alias("en"), F.coalesce("hi", translate(none)).alias("hi"), F.coalesce("provenance", F.array().cast("array<bigint>")).alias("provenance"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def contradictions(denials: DataFrame, medications: DataFrame, session: list[str]) -> DataFrame:
    """One row for each documented drug of a session whose patient denies taking medicine.

    denials: (session, rx_current or null, rx_asked, narration array). The structured answer counts if the question was
    asked, otherwise the first narrated line that denies. Denied is by "no", "no_tell", false and 0, in these very letters:
    "No" is none. medications: (session, document_id, drug_name).
    """
    said = F.try_element_at(F.filter("narration", lambda x: x.rlike(DENIALS)), F.lit(1))
    stated = F.when(F.col("rx_current").isin(*NO, "false") | F.col("rx_current").rlike(r"^[+-]?0+(\.0*)?$"), F.lit("Asked about medicines taken now, the patient said no."))
    who = denials.select(*session, F.when(F.col("rx_asked"), stated).otherwise(said).alias("from_interview")).where("from_interview is not null")
    return who.join(medications, session).select(*session, F.lit("current medications").alias("topic"), "from_interview", F.concat(F.lit("Prescription found for "), "drug_name").alias("from_documents"), "document_id")


def labelled(values: Column, labels: Column) -> Column:
    """Option ids as English labels, unknown ones as they are, `none` left out."""
    return F.transform(F.filter(values, lambda x: x != "none"), lambda x: F.coalesce(F.try_element_at(labels, x), x))


def open_points(unanswered: Column, warnings: Column, not_explored: Column, empty_sections: Column) -> Column:
    """All that stays open, in that order."""
    none = F.array().cast("array<string>")
    return F.concat(*(F.coalesce(c, none) for c in (unanswered, warnings, not_explored)), F.transform(F.coalesce(empty_sections, none), lambda s: F.concat(s, F.lit(": nothing recorded"))))


# Headings, their sentences, question ids, and how sure each is.
NOT_ANSWERED = "Not answered in this interview."
LISTED = {
    "past_medical": ("px.conditions", "Patient-reported known conditions: ", 0.85),
    "family": ("pf.family", "Family history: ", 0.85),
    "personal": ("pf.habits", "Reported habits: ", 0.85),
}
PAIN = (("soc.onset", "Onset: "), ("soc.character", "Character: "), ("soc.severity", "Severity: "))
PAIN_LISTS = (("soc.associations", "Associated with: "), ("soc.modifiers", "Modifiers: "))


def interview_sections(transcripts: DataFrame, session: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """(session, position, heading, en, provenance, confidence): eight sections of each interview, in order.

    transcripts: (session, answers map of text, lists map of arrays). Blank answers count as none, except a severity of 0;
    a section without an answer says so with confidence 0. Complaints other than pain have the patient's own words only.
    """
    named = F.create_map(*(F.lit(x) for kv in (labels or {"none": "none"}).items() for x in kv))
    get = lambda q: F.nullif(F.try_element_at("answers", F.lit(q)), F.lit(""))
    name = lambda q: F.coalesce(F.try_element_at(named, get(q)), get(q))
    many = lambda q: F.nullif(F.array_join(labelled(F.coalesce(F.try_element_at("lists", F.lit(q)), F.array().cast("array<string>")), named), ", "), F.lit(""))
    join = lambda sep, *parts: F.nullif(F.array_join(F.array_compact(F.array(*parts)), sep), F.lit(""))
    words = get("cc.describe")
    quoted = lambda lead: F.concat(F.lit(lead + '"'), words, F.lit('"'))

    where = F.coalesce(F.concat(F.lit(" in the "), name("cc.area")), F.lit(""))
    complaint = join("\n", F.concat(F.lit("Presenting complaint: "), name("cc.primary"), where, F.lit(".")), quoted("Patient's own words: "))
    onset = [F.concat(F.lit(lead), name(q) if q == "soc.character" else get(q), F.lit("/10." if q == "soc.severity" else ".")) for q, lead in PAIN]
    pain = join(" ", *onset, *(F.concat(F.lit(lead), many(q), F.lit(".")) for q, lead in PAIN_LISTS))
    own = F.concat(quoted("History of presenting illness, in the patient's own words: "), F.lit(". Structured follow-up questions for this type of complaint are not yet in the interview ontology."))
    is_pain = F.coalesce(get("cc.primary") == "pain", F.lit(False))
    surgery = F.when(get("px.surgery").isin("no", "false"), "Patient reports no prior operations.").when(get("px.surgery").isNotNull(), F.coalesce(F.concat(F.lit('Patient reports a prior operation: "'), get("px.surgery_detail"), F.lit('".')), F.lit("Patient reports a prior operation; details not captured.")))
    review = join(" ", F.concat(F.lit("Reported in the last few weeks: "), many("ros.screen"), F.lit(".")), F.concat(F.lit('Patient added: "'), get("ros.anything"), F.lit('"')))
    rows = [
        ("chief_complaint", complaint, ["cc.area", "cc.primary", "cc.describe"], F.when(words.isNotNull(), 1.0).otherwise(0.7)),
        ("hpi", F.when(is_pain, pain).otherwise(own), ["cc.describe"], F.when(is_pain, 0.9).otherwise(0.5)),
        *((h, F.concat(F.lit(lead), many(q), F.lit(".")), [q], F.lit(sure)) for h, (q, lead, sure) in list(LISTED.items())[:1]),
        ("past_surgical", surgery, ["px.surgery", "px.surgery_detail"], F.when(get("px.surgery").isin("no", "false"), 0.9).otherwise(0.8)),
        *((h, F.concat(F.lit(lead), many(q), F.lit(".")), [q], F.lit(sure)) for h, (q, lead, sure) in list(LISTED.items())[1:]),
        ("ros", review, ["ros.screen", "ros.anything"], F.lit(0.8)),
        ("ayurvedic_assessment", F.lit(None).cast("string"), [], F.lit(0.0)),
    ]
    parts = [F.struct(F.lit(i).alias("position"), F.lit(h).alias("heading"), F.coalesce(text, F.lit(NOT_ANSWERED)).alias("en"), F.when(text.isNotNull(), F.array(*(F.lit(f"interview:{q}") for q in asked)).cast("array<string>")).otherwise(F.array().cast("array<string>")).alias("provenance"), F.when(text.isNotNull(), sure).otherwise(0.0).cast("double").alias("confidence")) for i, (h, text, asked, sure) in enumerate(rows)]
    return transcripts.select(*session, F.explode(F.array(*parts)).alias("s")).select(*session, "s.*")


def prior_section(timeline: DataFrame, abnormal: DataFrame, alerts: DataFrame, bundles: DataFrame, session: list[str]) -> DataFrame:
    """(session, heading, en, hi, provenance, confidence): abnormal results first, then lab documents, then interactions, a blank line between blocks.

    abnormal: (session, n, text, value_num, unit, direction, range_text, document_id); timeline as for drug_section;
    alerts as from interactions; bundles: (session, mean_confidence).
    """
    number = F.col("value_num").cast("string")
    a = abnormal.select(*session, F.lit(0).alias("g"), F.col("n").cast("long").alias("p"), F.concat(F.lit("  - "), "text", F.lit(": "), number, F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(" ("), "direction", F.lit(", reference "), "range_text", F.lit(")")).alias("line"), "document_id")
    b = timeline.where("kind = 'lab'").select(*session, F.lit(1).alias("g"), F.col("pos").cast("long").alias("p"), F.concat(F.lit("  - "), "title", F.lit(" — "), shown_date(F.col("date"))).alias("line"), "document_id")
    c = alerts.select(*session, F.lit(2).alias("g"), F.col("rank_no").cast("long").alias("p"), F.concat(F.lit("  - "), "drug_a", F.lit(" + "), "drug_b", F.lit(": "), "description", F.lit(" ("), "severity", F.lit(")")).alias("line"), F.lit(None).cast("long").alias("document_id"))
    rows = a.unionByName(b).unionByName(c).groupBy(*session, "g").agg(F.array_sort(F.collect_list(F.struct("p", "line", "document_id"))).alias("l"))
    heads = F.array(*(F.lit(t) for t in list(TEMPLATES)[:3]))
    head = F.element_at(heads, F.col("g") + 1)
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    blocks = rows.groupBy(*session).agg(F.array_sort(F.collect_list(F.struct("g", F.concat(head, F.lit("\n"), body).alias("en"), F.concat(translate(head), F.lit("\n"), body).alias("hi"), F.array_compact(F.transform("l", lambda x: x["document_id"])).alias("ids")))).alias("b"))
    text = lambda f: F.array_join(F.transform("b", lambda x: x[f]), "\n\n")
    none = F.lit("No prior investigation reports found among the documents provided.")
    out = bundles.join(blocks, session, "left")
    return out.select(*session, F.lit("prior_investigations").alias("heading"), F.coalesce(text("en"), none).alias("en"), F.coalesce(text("hi"), translate(none)).alias("hi"), F.coalesce(F.array_distinct(F.flatten(F.transform("b", lambda x: x["ids"]))), F.array().cast("array<bigint>")).alias("provenance"), F.when(F.col("b").isNull(), 0.0).otherwise(F.col("mean_confidence")).alias("confidence"))


def history(documents: DataFrame, interview: DataFrame, transcripts: DataFrame, bundles: DataFrame, session: list[str]) -> DataFrame:
    """One draft summary a session: sections in order, open points, mean confidence of the sections that have any.

    documents: document sections (session, position, heading, en, confidence); transcripts: (session, unanswered,
    not_explored); bundles: (session, warnings). A session with either side only is kept.
    """
    sections = documents.select(*session, F.lit(0).alias("side"), "position", "heading", "en", "confidence").unionByName(interview.select(*session, F.lit(1).alias("side"), "position", "heading", "en", "confidence"))
    per = sections.groupBy(*session).agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "position", "heading", "en", "confidence"))), lambda x: F.struct(x["heading"].alias("heading"), x["en"].alias("en"), x["confidence"].alias("confidence"))).alias("sections"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"), F.transform(F.array_sort(F.collect_list(F.when((F.col("side") == 1) & (F.col("confidence") == 0), F.struct("position", "heading")))), lambda x: x["heading"]).alias("_empty"))
    every = per.join(transcripts, session, "full").join(bundles, session, "full")
    return every.select(*session, F.lit("draft").alias("status"), "sections", open_points(F.col("unanswered"), F.col("warnings"), F.col("not_explored"), F.col("_empty")).alias("gaps"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"))
