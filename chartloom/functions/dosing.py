"""Doses as written on prescriptions: slots (1-0-1), frequencies, durations, strengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words. A look at the first character comes first, as it rules most places out.
SLOT = r"(?:\d{1,2}/\d{1,2}|\d{1,2}(?:\.\d{1,2})?|[½¼¾])"
DOSE = rf"(?=[\d½¼¾])(?<![\w/.-])({SLOT})\s*-\s*({SLOT})\s*-\s*({SLOT})(?:\s*-\s*({SLOT}))?(?![\w.-])"
FREQUENCY = r"(?i)(?=[OBTQHSP])(?<![A-Za-z])(OD|BD|BID|TDS|TID|QID|QDS|HS|SOS|PRN|STAT|Q\d{1,2}H)(?![A-Za-z])"
DURATION = r"(?iu)(?=[xfक\d])(?:(?:x|for|के\s*लिए)\s*)?(\d{1,3})\s*(days?|din|दिन|weeks?|हफ़्ते|हफ्ते|months?|माह|महीने)(?![A-Za-z])"
STRENGTH = r"(\d+(?:\.\d+)?)\s*(mg|mcg|µg|ug|gm|g|ml|mL|IU|U|%)(?![A-Za-z])"
TIMES = ("in the morning", "in the afternoon", "at night", "at bedtime")
FREQUENCIES = {"OD": "once daily", "BD": "twice daily", "BID": "twice daily", "TDS": "three times daily", "TID": "three times daily", "QID": "four times daily", "QDS": "four times daily", "HS": "at bedtime", "SOS": "as needed", "PRN": "as needed", "STAT": "immediately"}


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def slot_value(token: Column) -> Column:
    """A slot as a double; null for no slot and for a division by zero."""
    ratio = F.try_divide(F.regexp_extract(token, r"^(\d+)/", 1).cast("double"), F.regexp_extract(token, r"/(\d+)$", 1).cast("double"))
    return F.when(token == "", F.lit(None)).when(token == "½", 0.5).when(token == "¼", 0.25).when(token == "¾", 0.75).when(F.contains(token, F.lit("/")), ratio).otherwise(token.try_cast("double"))


def dose_slots(text: Column) -> Column:
    """Array of three or four doubles of the first dose notation; null if there is none."""
    # slots have no white space within; a split at one character needs no pattern
    tokens = lambda d: F.split(F.regexp_replace(d, r"\s+", ""), "-")
    return let(F.regexp_extract(text, DOSE, 0), lambda d: F.when(d != "", F.transform(tokens(d), slot_value)))


def total_per_day(slots: Column) -> Column:
    return F.aggregate(slots, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def dose_sentence(slots: Column) -> Column:
    return let(slots, _sentence)


def _sentence(slots: Column) -> Column:
    """"1 tablet in the morning and 1 tablet at night"; empty if nothing is taken, null without slots."""
    shown = lambda x: F.when(x == F.floor(x), x.cast("int").cast("string")).otherwise(x.cast("string"))
    said = lambda x: F.when(x == 0.5, "half a tablet").when(x == 1.0, "1 tablet").otherwise(F.concat(shown(x), F.lit(" tablets")))
    each = F.filter(F.transform(slots, lambda x, i: F.when(x > 0, F.concat(said(x), F.lit(" "), F.element_at(F.array(*map(F.lit, TIMES)), i + 1)))), lambda x: x.isNotNull())
    return F.when(slots.isNull(), None).otherwise(let(each, _listed))


def _listed(each: Column) -> Column:
    n = F.size(each)
    return F.when(n == 0, "").when(n == 1, F.try_element_at(each, F.lit(1))).otherwise(F.concat(F.array_join(F.slice(each, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(each, F.lit(-1))))


def frequency_text(token: Column) -> Column:
    """English of an abbreviation; an unknown one in capitals."""
    known = F.create_map(*(F.lit(x) for kv in FREQUENCIES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.upper(token)), F.upper(token))


def dose_phrase(text: Column) -> Column:
    """Schedule (or frequency) and duration of the text after a drug's name, in words; empty if it has neither."""
    often = let(F.regexp_extract(text, FREQUENCY, 1), lambda f: F.when(f != "", frequency_text(f)).otherwise(""))
    lasts = let(F.regexp_extract(text, DURATION, 0), lambda m: let(F.split(F.regexp_replace(m, DURATION, "$1\x01$2"), "\x01", -1), lambda g: F.struct(g[0].alias("n"), F.coalesce(F.get(g, F.lit(1)), F.lit("")).alias("unit"))))
    said = let(lasts, lambda d: F.struct(F.coalesce(dose_sentence(dose_slots(text)), often).alias("main"), d["n"].alias("n"), d["unit"].alias("unit")))

    def joined(x: Column) -> Column:
        alone = F.concat(F.lit("For "), x["n"], F.lit(" "), F.lower(x["unit"]))
        return F.when(x["n"] == "", x["main"]).when(x["main"] == "", alone).otherwise(F.concat(x["main"], F.lit(", for "), x["n"], F.lit(" "), x["unit"]))

    return let(said, joined)


def dose_key(text: Column) -> Column:
    """Number and unit of the first strength, the number without trailing zeros and the unit without plural; null if there is none."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|iu|units?)(?!\w)"
    number = F.regexp_extract(text, pattern, 1)
    plain = F.regexp_replace(F.regexp_replace(number, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    return F.when(number != "", F.concat(F.regexp_replace(plain, r"\.$", ""), F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 2)), "s+$", "")))
