"""Red-flag alerts and what became of them: a ledger that each alert enters once, however often its micro-batch is tried.

A micro-batch is written to the ledger under its number, in one commit. A batch that is tried again after its ledger entry was
committed, because the query died before its own commit, finds it and sends nothing. One that died while sending is sent again: alerts
carry an id made of what they say, by which a receiver drops what it has. No answers, names or narration leave: an alert is
a session, its place, the question's id, a reason's code and a severity.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ALERT = ("session_id", "ord", "question_id", "reason", "severity")
LEDGER = "session_id long, ord long, question_id string, reason string, severity string, alert_id string, delivered boolean, detail string, batch long"
#: Fixed value: seconds that a receiver has.
TIMEOUT = 5
NO_RECEIVER = "no receiver is configured: the alert stands in the ledger and was not delivered"


def webhook(url: str, timeout: float = TIMEOUT) -> Callable[[dict], tuple[bool, str]]:
    """Posts an alert as JSON; anything but a 2xx in time is a failed delivery, never an error."""

    def send(alert: dict) -> tuple[bool, str]:
        request = urllib.request.Request(url, json.dumps(alert).encode(), {"Content-Type": "application/json"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return True, f"delivered: HTTP {response.status}"
        except (urllib.error.URLError, OSError, ValueError) as e:
            return False, f"failed: {e}"

    return send


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _sent(alerts: DataFrame, send: Callable[[dict], tuple[bool, str]] | None) -> DataFrame:
    """alerts (ALERT) with alert_id, delivered and detail; they're sent from the tasks that hold them."""
    rows = alerts.select(*ALERT, F.sha2(F.to_json(F.struct(*ALERT)), 256).alias("alert_id"))
    if send is None:
        return rows.withColumns({"delivered": F.lit(False), "detail": F.lit(NO_RECEIVER)})

    def post(frames):
        for frame in frames:
            told = [send(a) for a in json.loads(frame.to_json(orient="records"))]
            yield frame.assign(delivered=[d for d, _ in told], detail=[x for _, x in told])

    return rows.mapInPandas(post, LEDGER.removesuffix(", batch long"))


def record(flags: DataFrame, batch: int, path: str, send: Callable[[dict], tuple[bool, str]] | None = None) -> bool:
    """Sends a micro-batch of flags and writes its ledger entry; False if the batch was in the ledger already, and nothing was done."""
    at = f"{path}/batch={batch}"
    if _exists(flags.sparkSession, f"{at}/_SUCCESS"):
        flags.write.format("noop").mode("overwrite").save()  # the stream's state has to be committed even so
        return False
    _sent(flags, send).write.mode("overwrite").parquet(at)  # over what a try that died has left
    return True


def stream(flags: DataFrame, path: str, checkpoint: str, send: Callable[[dict], tuple[bool, str]] | None = None) -> StreamingQuery:
    """A query that delivers a stream's flags as they come, each micro-batch once; run it inside interview.state_store."""

    def batch(rows: DataFrame, number: int) -> None:
        record(rows, number, path, send)

    return flags.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(ALERT, alert_id, delivered, detail, batch): each alert with its last outcome. Tries again have negative batch numbers, the later the lower."""
    rows = spark.read.schema(LEDGER).parquet(path)
    return rows.groupBy(*ALERT, "alert_id").agg(F.max_by(F.struct("delivered", "detail", "batch"), F.when(F.col("batch") < 0, -F.col("batch")).otherwise(0)).alias("o")).select(*ALERT, "alert_id", "o.*")


def retry(spark: SparkSession, path: str, send: Callable[[dict], tuple[bool, str]] | None, attempt: int) -> bool:
    """Sends again what wasn't delivered; attempt counts from 1, and one that is in the ledger isn't made again."""
    waiting = ledger(spark, path).where(~F.col("delivered") & (F.col("batch") > -attempt)).select(*ALERT)
    return record(waiting, -attempt, path, send)
