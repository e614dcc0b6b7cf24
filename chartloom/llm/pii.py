"""Format-preserving Feistel pseudonyms for personal numbers and dates. Column functions only.

Spans are found by form and validated (Luhn for cards, octets for addresses, the calendar for dates, the issuing rules for
social security numbers); what fails stays as it is. A valid value is numbered within its format, the number is split
as left * b + right, and eight rounds add a keyed digest of one side to the other, modulo that side's size. Each round is
a bijection, so different values stay different, equal ones stay equal in every document, and the key undoes it.
E-mail addresses are no numbers: they become addresses made of keyed digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.runtime import table

ROUNDS = 8
#: Where a deployment sets its own key; without one the pseudonyms are no secret.
KEY_SETTING = "spark.chartloom.pseudonym.key"
KEY = "a key of the deployment's own"

# The forms, as Java patterns.
EMAIL = r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
CARD = r"(?<![\w.])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
ADDRESS = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
DATE = r"(?<![\w-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w-])"
FORMS = {"email": EMAIL, "phone": PHONE, "card": CARD, "ssn": SSN, "address": ADDRESS, "date": DATE}
ANY = "|".join(FORMS.values())
#: Dates from 1900-01-01 to 2099-12-31: 73,049 days, 17 * 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def feistel(value: Column, a: Column, b: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """A keyed permutation of the longs below a * b; each kind and size has its own."""

    def turn(r: Column, half: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), a.cast("string"), b.cast("string"), r.cast("string"), half.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    sign = F.lit(-1 if inverse else 1)

    def step(s: Column, r: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + sign * turn(r, s["r"], a), a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * turn(r, s["l"], b), b).alias("r"))
        return F.when(r % 2 == 0, left).otherwise(right)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _ten(n: Column) -> Column:
    """10 to the power of n, for n up to 18."""
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _permuted_digits(d: Column, kind: str, key: str, inverse: bool) -> Column:
    """The digits, up to 18, permuted among those of their number. Halves are cut as strings, so no division is needed."""
    n = F.char_length(d)
    low = F.floor(n / 2).cast("int")
    return F.lpad(feistel(d.cast("long"), _ten(n - low), _ten(low), kind, key, inverse).cast("string"), n, "0")


def _laid(shape: Column, digits: Column) -> Column:
    """digits in the places of shape's digits."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(shape)), lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.char_length(_digits(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))), "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, every second one doubled; `doubled` is 1 if that starts with the last."""
    n = F.char_length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when((i + doubled) % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))


def _card(x: Column, key: str, inverse: bool) -> Column:
    d = _digits(x)
    payload = _permuted_digits(F.substring(d, F.lit(1), F.char_length(d) - 1), "card", key, inverse)
    new = F.concat(payload, F.pmod(10 - F.pmod(_luhn(payload, 1), F.lit(10)), F.lit(10)).cast("string"))
    return F.when((_luhn(d, 0) % 10 == 0) & d.rlike("[1-9]"), _laid(x, new))


def _phone(x: Column, key: str, inverse: bool) -> Column:
    """The last ten digits change, or all if there are fewer."""
    d = _digits(x)
    k = F.least(F.lit(10), F.char_length(d))
    return _laid(x, F.concat(F.substring(d, F.lit(1), F.char_length(d) - k), _permuted_digits(F.right(d, k), "phone", key, inverse)))


def _ssn(x: Column, key: str, inverse: bool) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999 are numbered without gaps."""
    area, group, serial = F.substring(x, 1, 3).cast("int"), F.substring(x, 5, 2).cast("int"), F.substring(x, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    upper = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    new = feistel(upper.cast("long") * 9999 + serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), "ssn", key, inverse)
    top = F.floor(new / 9999).cast("int")
    new_area = F.floor(top / 99).cast("int") + 1
    new_area = new_area + F.when(new_area >= 666, 1).otherwise(0)
    return F.when(valid, F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((top % 99 + 1).cast("string"), 2, "0"), F.lpad((new % 9999 + 1).cast("string"), 4, "0")))


def _address(x: Column, key: str, inverse: bool) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    valid = F.forall(octets, lambda o: o <= 255) & ~x.rlike(r"(^|\.)0\d")
    new = feistel(F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o), F.lit(65536).cast("long"), F.lit(65536).cast("long"), "address", key, inverse)
    return F.when(valid, F.array_join(F.transform(F.array(*(F.lit(s) for s in (24, 16, 8, 0))), lambda s: F.pmod(F.floor(new / F.pow(F.lit(2), s)).cast("long"), F.lit(256)).cast("string")), "."))


def _date(x: Column, key: str, inverse: bool) -> Column:
    """Calendar dates of the two centuries, day first where the year is last."""
    year_first, dot = F.substring(x, 5, 1) == "-", F.substring(x, 3, 1) == "."
    day = F.try_to_date(F.when(year_first, x).otherwise(F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2))), "yyyy-MM-dd")
    number = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    new = feistel(number.cast("long"), *(F.lit(s).cast("long") for s in DAYS), "date", key, inverse)
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int"))
    shown = F.when(year_first, F.date_format(moved, "yyyy-MM-dd")).when(dot, F.date_format(moved, "dd.MM.yyyy")).otherwise(F.date_format(moved, "dd/MM/yyyy"))
    return F.when((number >= 0) & (number < DAYS[0] * DAYS[1]), shown)


def _email(x: Column, key: str) -> Column:
    at = F.instr(x, "@")
    part = lambda kind, value, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(value)), 256), 1, n)
    return F.concat(F.lit("u"), part("email", x, 16), F.lit("@d"), part("domain", F.substring(x, at + 1, F.char_length(x)), 8), F.lit(".example"))


def _judged(x: Column, key: str, inverse: bool) -> Column:
    """(kind, value) of a span that has one of the forms: the first form that fits; value is null if it isn't valid."""
    whole = {kind: x.rlike(f"^(?:{form})$") for kind, form in FORMS.items()}
    made = {"email": F.lit(None).cast("string") if inverse else _email(x, key), "phone": _phone(x, key, inverse), "card": _card(x, key, inverse), "ssn": _ssn(x, key, inverse), "address": _address(x, key, inverse), "date": _date(x, key, inverse)}
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(FORMS):
        kind, value = F.when(whole[k], k).otherwise(kind), F.when(whole[k], made[k]).otherwise(value)
    return F.struct(kind.alias("kind"), value.alias("value"), x.alias("span"))


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, inverse: bool = False) -> DataFrame:
    """docs whose texts have pseudonyms for personal values, with n_email, n_phone, n_card, n_ssn, n_address and n_date:
    how many of each were replaced.

    Null texts stay null and empty ones empty, with counts 0. Values in a text are replaced wherever they stand, however
    long the text. Rows are treated one by one: repeated rows and nulls elsewhere change nothing; an empty table gives
    no rows. Other columns pass through; those named like the counts are replaced. With inverse, the same key brings
    numbers and dates back; e-mail addresses can't be.
    """
    new = [f"n_{k}" for k in FORMS]
    others = [c for c in docs.columns if c not in new]
    text = F.col(f"`{text_col}`")
    touched = text.rlike(r"@|[0-9][-0-9. /()]{5}")  # any form needs one of these
    spans = F.when(touched, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # in three steps, so that nothing is worked out twice
    a = docs.select(*(F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(others)), spans.alias("_spans"))
    own = F.col(f"_o{others.index(text_col)}")
    olds = [f"_o{i}" for i in range(len(others))]
    a = a.select(*olds, F.transform("_spans", lambda x: _judged(x, key, inverse)).alias("_judged"))
    found = F.size(F.filter("_judged", lambda j: j["value"].isNotNull())) > 0
    pieces = F.zip_with(F.split(own, ANY, -1), F.transform("_judged", lambda j: F.coalesce(j["value"], j["span"])), lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    a = a.select(*olds, "_judged", F.when(found, F.array_join(pieces, "")).otherwise(own).alias("_text"))
    counts = [F.coalesce(F.size(F.filter("_judged", lambda j: (j["kind"] == k) & j["value"].isNotNull())), F.lit(0)).cast("long").alias(f"n_{k}") for k in FORMS]
    return a.select(*(F.col("_text" if c == text_col else o).alias(c) for o, c in zip(olds, others)), *counts)


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """All documents with pseudonyms for personal values, under the given key or the session's setting KEY_SETTING; nulls, repeated rows and empty tables as in pseudonymise."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key or spark.conf.get(KEY_SETTING, KEY))
