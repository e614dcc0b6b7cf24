"""Conditions and rules: their grammar, and rules as data.

A condition is clauses joined by &&: `id op value`, or `id in [a, b]`. Rules are rows; their clauses are rows too, and meet answers
by joins on the question and, where a rule names an answer or option, on that as well. So a plan has one size whatever the
number of rules, and a rule costs what its own answers cost.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Operators in the order they are tried, hours of a unit.
OPERATORS = ("<=", ">=", "==", "<", ">", " in ")
HOURS = {"hours": 1, "days": 24, "weeks": 168, "months": 720, "years": 8760}
#: What a clause calls the answer that sets the rule off.
OWN = ("value", "value_hours")
RULE = "rule_no long, question_id string, option string, when string, reason string, severity string"


class ConditionError(ValueError):
    """A condition that the grammar doesn't have."""


def parse(text: str | None) -> list[tuple[str, str, str]]:
    """A condition's clauses (id, operator, value); no condition has none."""
    found = []
    for clause in [] if text is None else text.split("&&"):
        clause = re.sub(r"^[\s(]+|[\s)]+$", "", clause)
        op = next((o for o in OPERATORS if o in clause), None)
        if op is None:
            raise ConditionError(f"no operator in {clause!r}")
        left, right = (p.strip() for p in clause.split(op, 1))
        found.append((left, op, right))
    return found


def clauses(text: Column) -> Column:
    """The same as parse of a column: array<struct<lhs, op, rhs>>; a clause without an operator is an error."""

    def one(raw: Column) -> Column:
        c = F.regexp_replace(raw, r"^[\s(]+|[\s)]+$", "")
        op = F.coalesce(*(F.when(F.contains(c, F.lit(o)), o) for o in OPERATORS), F.raise_error(F.concat(F.lit("no operator in "), c)).cast("string"))
        at = F.position(op, c)
        strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
        return F.struct(strip(F.substr(c, F.lit(1), at - 1)).alias("lhs"), op.alias("op"), strip(F.substr(c, at + F.char_length(op))).alias("rhs"))

    return F.coalesce(F.transform(F.split(text, "&&"), one), F.array().cast("array<struct<lhs:string,op:string,rhs:string>>"))


def number(x: Column) -> Column:
    """A decimal number, with an exponent or not; text that only SQL takes for one ("2d", "1f") is none."""
    return F.when(F.trim(x).rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"), F.trim(x)).try_cast("double")


def hours(amount: Column, unit: Column) -> Column:
    """A duration in hours: no amount counts as 0, no or an unknown unit as hours. Infinite if neither is there, which is no duration, so that no "at most" fires."""
    per = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in HOURS.items() for v in (kv[0], float(kv[1])))), unit), F.lit(1.0))
    return F.when(amount.isNull() & unit.isNull(), float("inf")).otherwise(F.coalesce(amount, F.lit(0.0)) * per)


def holds(op: Column, rhs: Column, value: Column) -> Column:
    """Whether a clause holds for an answer's text: equality and membership compare text, a missing answer being "None" for equality; other comparisons need numbers on both sides and fail otherwise."""
    members = F.transform(F.split(F.regexp_replace(rhs, r"^[\[\]]+|[\[\]]+$", ""), ","), lambda m: F.trim(m))
    a, b = number(value), number(rhs)
    compared = F.when(op == "<=", a <= b).when(op == ">=", a >= b).when(op == "<", a < b).otherwise(a > b)
    return F.when(op == "==", F.coalesce(value, F.lit("None")) == rhs).when(op == " in ", F.coalesce(F.array_contains(members, value), F.lit(False))).otherwise(F.coalesce(compared, F.lit(False)))


def from_list(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A rule file's rules (question_id, option, when, reason, severity) as rows, in their order; conditions that the grammar doesn't have are errors at once.

    Spark doesn't know the size of rows that the driver gave, so it would send the answers to them: the rules are what joins broadcast.
    """
    for r in rules:
        parse(r.get("when"))
    return F.broadcast(spark.createDataFrame([(n, r["question_id"], r.get("option"), r.get("when"), r["reason"], r["severity"]) for n, r in enumerate(rules)], RULE))


def indexed(rules: DataFrame) -> DataFrame:
    """(rule_no, question_id, kind, key, reason, severity, own, rest): what each rule is found by, its clauses on the answer itself and those on others.

    An option's rule is found by the option, one that wants a value by the value, and any other by its question alone.
    """
    every = clauses(F.col("when"))
    rows = rules.withColumn("own", F.filter(every, lambda c: c["lhs"].isin(*OWN))).withColumn("rest", F.array_distinct(F.filter(every, lambda c: ~c["lhs"].isin(*OWN))))
    equal = F.get(F.filter("own", lambda c: (c["lhs"] == "value") & (c["op"] == "==")), 0)["rhs"]
    kind = F.when(F.col("option").isNotNull(), "option").when(equal.isNotNull(), "equal").otherwise("any")
    return rows.select("rule_no", "question_id", kind.alias("kind"), F.coalesce("option", equal, F.lit("")).alias("key"), "reason", "severity", "own", "rest")


def _set_off(answers: DataFrame, rules: DataFrame, session: list[str], order_col: str, *more: str) -> DataFrame:
    """(session, ord, question_id, rule_no, reason, severity, rest) of the rules whose question and own clauses an answer meets."""
    current = F.when(F.col("multi").isNull(), F.col("value"))
    chosen = F.array_compact(F.array_distinct(F.coalesce("multi", F.array("value"))))
    fact = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    facts = F.concat(F.array(fact("any", F.lit("")), fact("equal", F.coalesce(current, F.lit("None")))), F.transform(chosen, lambda o: fact("option", o)))
    rows = answers.select(*session, F.col(order_col).alias("ord"), "question_id", *more, current.alias("_value"), hours(F.col("dur_amount"), F.col("dur_unit")).cast("string").alias("_hours"), F.explode(facts).alias("_f")).select("*", "_f.*")
    met = rows.join(indexed(rules), ["question_id", "kind", "key"])
    value = F.when(F.col("kind") == "option", F.col("key")).otherwise(F.col("_value"))
    true = F.forall("own", lambda c: holds(c["op"], c["rhs"], F.when(c["lhs"] == "value", value).otherwise(F.col("_hours"))))
    return met.where(true).select(*session, "ord", "question_id", *more, "rule_no", "reason", "severity", "rest")


def fired(answers: DataFrame, rules: DataFrame, session: list[str], order_col: str = "ord") -> DataFrame:
    """(session, ord, question_id, rule_no, reason, severity) for each rule that an answer sets off. It sees the session's answers so far and never later ones.

    answers: value (text), multi (array of options, or null), dur_amount, dur_unit; rules: RULE. A clause on another question holds or
    doesn't with each answer to that; what holds as of the answer that sets a rule off is the last of these, found once for each
    clause however many rules have it. A rule fires when as many clauses hold as it has.
    """
    met = _set_off(answers, rules, session, order_col)
    out = [*session, "ord", "question_id", "rule_no", "reason", "severity"]
    asks = met.where(F.size("rest") > 0).select(*out, F.size("rest").alias("n"), F.explode("rest").alias("c"))
    wanted = indexed(rules).select(F.explode("rest").alias("c")).select("c.*").distinct()
    clause = ["lhs", "op", "rhs"]
    told = answers.join(wanted, F.col("question_id") == F.col("lhs")).select(*session, F.col(order_col).alias("ord"), *clause, F.struct(holds(F.col("op"), F.col("rhs"), F.col("value")).alias("true")).alias("told"))
    asked = asks.select(*out, "n", "c.*", F.lit(1).alias("asks"))
    both = asked.unionByName(told.withColumn("asks", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*session, *clause).orderBy("ord", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.withColumn("told", F.last("told", ignorenulls=True).over(so_far)).where("asks = 1")
    true = known.where(F.coalesce(F.col("told.true"), holds(F.col("op"), F.col("rhs"), F.lit(None).cast("string"))))
    whole = true.groupBy(*out, "n").count().where("count = n").select(*out)
    return met.where(F.size("rest") == 0).select(*out).unionByName(whole)


def fired_as_of(seen: DataFrame, rules: DataFrame, session: list[str], order_col: str = "ord") -> DataFrame:
    """The same rows from answers that carry `state`, the map of the session's answers so far; for streams, which join rules as they come."""
    met = _set_off(seen, rules, session, order_col, "state")
    return met.where(F.forall("rest", lambda c: holds(c["op"], c["rhs"], F.try_element_at("state", c["lhs"])))).drop("state", "rest")
