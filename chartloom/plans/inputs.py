"""Clinical inputs made from the general test tables by arithmetic that Spark and DuckDB share.

The tables have no clinical text, so each input is a SQL text that both engines read alike; queries run the operators on
it and their SQL computes the same results from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources.dims import seed_rows

TODAY = "2002-01-01"


def pick(index: str, values: list, quote: bool = True) -> str:
    """CASE that picks a value by a number from 0."""
    show = (lambda v: "'" + str(v).replace("'", "''") + "'") if quote else str
    case = "CASE " + index + " " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + " END"
    if quote:
        _PICKS[case] = f"get(array({', '.join(map(show, values))}), {index})"
    return case


#: The CASE texts, and what Spark does in one step where a CASE tries one number after the other, in code too long to be compiled.
_PICKS: dict[str, str] = {}


def for_spark(sql: str) -> str:
    """An input's SQL with its picks as look-ups by place, and documents' numbers as `tables` has them."""
    sql = sql.replace(DOC, "_doc")
    for case in sorted((c for c in _PICKS if c in sql), key=len, reverse=True):
        sql = sql.replace(case, _PICKS[case])
    return sql


def values(rows: list[tuple], names: str, alias: str) -> str:
    """An inline table that both engines read; a null has the type of its column's other values."""
    kinds = ["DOUBLE" if any(isinstance(r[i], float) for r in rows) else "BIGINT" if any(isinstance(r[i], int) for r in rows) else "VARCHAR" for i in range(len(rows[0]))]

    def show(v, kind):
        return f"CAST(NULL AS {kind})" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r, kinds)) + ')' for r in rows)}) AS {alias}({names}))"


LABS = [r for r in seed_rows("lab_alias") if r[1] == 0 and r[5] == "mg/dL"][:8]
DRUGS = [r for r in seed_rows("drug_alias") if r[1] <= 1][:40]

ANALYTE = pick("CAST(l_partkey % 8 AS INT)", [r[2] for r in LABS])
QTY = "CAST(l_quantity AS INT)"
LOW = "CAST(10 + l_suppkey % 7 AS INT)"
HIGH = f"({LOW} + 15 + l_linenumber)"
DOC = "((((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS INT))"
#: The same number as a DECIMAL, and whether it doesn't fit a BIGINT: by a double, and exactly only near the limit.
_IN_ORDER = "(((l_linenumber * 100000L + l_partkey) * 10000L + l_suppkey) * 100L + CAST(l_quantity AS INT))"
_WIDE_DOC = f"CAST(CAST(l_orderkey AS DECIMAL(20, 0)) * CAST(1000000000000 AS DECIMAL(13, 0)) + {_IN_ORDER} AS DECIMAL(38, 0))"
_ABOUT = f"abs(CAST(l_orderkey AS DOUBLE) * 1e12D + {_IN_ORDER})"
_BEYOND = f"{_ABOUT} > 9.3e18D OR {_ABOUT} > 9.1e18D AND {_WIDE_DOC} NOT BETWEEN -9223372036854775808BD AND 9223372036854775807BD"
ALIAS = pick("CAST(l_partkey % 40 AS INT)", [r[2] for r in DRUGS])
GENERIC = pick("CAST(l_partkey % 40 AS INT)", [r[3] for r in DRUGS])
STRENGTH = "(250 * (1 + l_linenumber % 4))"
SLOTS = ["1-0-1", "1-1-1", "0-0-1", "1/2-0-1", "2-0-0-1"]
SENTENCES = ["1 tablet in the morning and 1 tablet at night", "1 tablet in the morning, 1 tablet in the afternoon and 1 tablet at night", "1 tablet at night", "half a tablet in the morning and 1 tablet at night", "2 tablets in the morning and 1 tablet at bedtime"]
SLOT = pick("CAST(l_suppkey % 5 AS INT)", SLOTS)
SENTENCE = pick("CAST(l_suppkey % 5 AS INT)", SENTENCES)
FORMS = ["Tab.", "Cap", "1. Tab", "- Syp."]
FORM = pick("CAST(l_linenumber % 4 AS INT)", FORMS)
DAYS = f"({QTY})"

INPUTS = {
    "lab_docs": f"SELECT {DOC} AS document_id, l_orderkey AS session_id, 0.8 + 0.05 * (l_linenumber % 4) AS mean_confidence, "
    f"'LABORATORY REPORT' || chr(10) || {ANALYTE} || '   ' || CASE WHEN l_suppkey % 5 = 0 THEN '<' ELSE '' END || CAST({QTY} AS VARCHAR(9)) || ' mg/dL   ' || CAST({LOW} AS VARCHAR(9)) || ' - ' || CAST({HIGH} AS VARCHAR(9)) AS text FROM lineitem",
    "drug_docs": f"SELECT {DOC} AS document_id, l_orderkey AS session_id, 0.9 AS mean_confidence, "
    f"{FORM} || ' ' || {ALIAS} || ' ' || CAST({STRENGTH} AS VARCHAR(9)) || 'mg ' || {SLOT} || ' x ' || CAST({DAYS} AS VARCHAR(9)) || ' days' AS text FROM lineitem",
    "vital_docs": f"SELECT {DOC} AS document_id, 0.9 AS mean_confidence, "
    "'BP: ' || CAST(CAST(90 + l_quantity AS INT) AS VARCHAR(9)) || '/' || CAST(CAST(60 + l_suppkey % 30 AS INT) AS VARCHAR(9)) || ' Pulse ' || CAST(CAST(60 + l_partkey % 40 AS INT) AS VARCHAR(9)) || ' bpm' || chr(10) || 'Wt: ' || CAST(CAST(40 + l_quantity AS INT) AS VARCHAR(9)) || ' kg' AS text FROM lineitem",
    "dx_docs": "SELECT o_orderkey AS document_id, 0.8 AS mean_confidence, 'Dx: ' || o_orderpriority || ', ' || o_orderstatus || ' disease and ' || CASE WHEN o_custkey % 2 = 0 THEN 'Asthma' ELSE 'Migraine' END AS text FROM orders",
    "dated_docs": "SELECT o_orderkey AS document_id, 0.9 AS mean_confidence, "
    + pick("CAST(o_orderkey % 4 AS INT)", ["Collected on ", "Printed on ", "Seen ", "Date: "])
    + " || lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0') || '/' || CAST(year(o_orderdate) AS VARCHAR(4)) || chr(10) || 'some fifty characters of other text in between, so far away' || chr(10) || CASE WHEN o_custkey % 3 = 0 THEN 'Review after 05/06/1999' WHEN o_custkey % 3 = 1 THEN 'Reported on 05/06/1999' ELSE 'nothing' END AS text FROM orders",
    "entries": "SELECT o_custkey AS session, o_orderkey AS seq, o_orderkey AS document_id, "
    + pick("CAST(o_orderkey % 5 AS INT)", ["note", "lab", "prescription", "allergy", "imaging"])
    + " AS kind, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, 'Title ' || o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Clinic' END AS facility, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence FROM orders",
    "words": "SELECT doc_id AS page, i AS word_no, CAST(floor(i / 40) AS INT) AS block, 0 AS par, CAST(floor(i / 9) AS INT) % 3 AS line, w AS text, CAST((length(w) * 13) % 101 - CASE WHEN length(w) = 7 THEN 101 ELSE 0 END AS DOUBLE) AS conf FROM word_list",
    "answers": "SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type AS question_id, CASE WHEN CAST(floor(value) AS BIGINT) % 4 = 0 THEN 'yes' WHEN CAST(floor(value) AS BIGINT) % 4 = 1 THEN 'no' ELSE CAST(CAST(floor(value) AS BIGINT) % 11 AS VARCHAR(9)) END AS value FROM events",
    "prakriti": "SELECT user_id AS session_id, " + pick("CAST(event_id % 8 AS INT)", ["pa.build", "pa.skin", "pa.appetite", "pa.digestion", "pa.sleep", "pa.temperament", "pa.weather", "pa.energy"]) + " AS question_id, max(" + pick("CAST(floor(value) AS BIGINT) % 4", ["vata", "pitta", "kapha", "unsure"]) + ") AS value FROM events GROUP BY 1, 2",
    "scores": "SELECT doc_id % 7 AS grp, doc_id, quality + toxic AS n_extracted, quality AS n_expected, quality * (1 - toxic) AS n_correct FROM labels",
    "session_drugs": f"SELECT o_custkey AS session_id, {DOC} AS pos, {ALIAS} AS drug FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
}

#: What Spark needs to say otherwise: the words of documents, in reading order.
WORDS = {
    "spark": "SELECT doc_id, pos + 1 AS i, w FROM (SELECT doc_id, posexplode(split(replace(text, chr(10), ' '), ' ')) AS (pos, w) FROM documents)",
    "duckdb": "SELECT doc_id, i, x[i] AS w FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)",
}


def spread(df: DataFrame, small: int = 32_000_000) -> DataFrame:
    """df over all cores where its files are too few or small to be: work on texts then runs in parallel. Larger inputs stay as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < small * cores else df


def _with_doc(lines: DataFrame, shown: DataFrame) -> DataFrame:
    """shown with `_doc`, the number of a line's document: a BIGINT as in SQL; where a line's doesn't fit (order keys from 9.2 million), which is an error in SQL, a DECIMAL, exactly."""
    wide = lines.agg(F.bool_or(F.expr(_BEYOND))).first()[0]
    return shown.withColumn("_doc", F.expr(_WIDE_DOC if wide else DOC))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        read = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        shown = spread(read)
        (_with_doc(read, shown) if n == "lineitem" else shown).createOrReplaceTempView(n)


SOURCES = {"lab_docs": ["lineitem"], "drug_docs": ["lineitem"], "vital_docs": ["lineitem"], "dx_docs": ["orders"], "dated_docs": ["orders"], "entries": ["orders"], "words": ["documents"], "answers": ["events"], "prakriti": ["events"], "scores": ["labels"], "session_drugs": ["orders", "lineitem"]}


def make(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame."""
    tables(spark, sf_dir, *SOURCES[name])
    sql = INPUTS[name]
    if name == "words":
        sql = f"WITH word_list AS ({WORDS['spark']}) {sql}"
    return spark.sql(for_spark(sql))


def cte(*names: str) -> str:
    """The inputs as DuckDB CTEs, to go after WITH."""
    out = []
    for n in names:
        if n == "words":
            out.append(f"word_list AS ({WORDS['duckdb']})")
        out.append(f"{n} AS ({INPUTS[n]})")
    return ", ".join(out)
