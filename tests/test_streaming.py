import datetime
import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from chartloom.lineage import scratch
from chartloom.operators import dialogue
from chartloom.sources import scan
from chartloom.streaming import alerts, live, pauses
from chartloom.streaming.interview import ANSWER, state_store, states

ONTOLOGY = {"sections": [{"id": "two", "order": 2, "trigger": "pain == yes", "questions": [{"id": "where"}, {"id": "age"}]}, {"id": "one", "order": 1, "always": True, "questions": [{"id": "pain", "follow_up_on_yes": "since"}, {"id": "since"}, {"id": "fever"}]}, {"id": "ay", "order": 3, "mode": "ayush", "parameters": [{"id": "build"}, {"id": "pulse", "capture_mode": "examiner_required"}, {"id": "type", "input_type": "derived"}]}]}


def drain(spark, base, rows, kind, make):
    """One more file of the stream, and the query over all that came."""
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{base}/log")
    with state_store(spark):
        make(spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(f"{base}/log")).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def test_live_state(spark):
    """After each drain the state has the latest answers, and what is asked next is what the script would ask; an earlier batch can be read too."""
    rng, base, held, script = random.Random(3), scratch(spark, "test-live"), {}, dialogue.Script(ONTOLOGY)
    seen = []
    for batch in range(3):
        rows = [(rng.randint(0, 6), 100 * batch + i, rng.choice(["pain", "since", "fever", "where", "age"]), rng.choice(["yes", "no", None, "50"]), None, None, None) for i in range(25)]
        for s, _, q, v, *_ in rows:
            held[s, q] = v
        seen.append(dict(held))
        drain(spark, base, rows, ANSWER, states)
        assert {(r.session_id, r.question_id): r.value for r in live.answers(spark, f"{base}/state").collect()} == held
    assert {(r.session_id, r.question_id): r.value for r in live.answers(spark, f"{base}/state", batch=0).collect()} == seen[0]
    now = live.answers(spark, f"{base}/state")
    for mode in ("allopathic", "ayush"):
        got = {r.session_id: r for r in live.read(now, ONTOLOGY, mode=mode).collect()}
        for s in {s for s, _ in held}:
            mine = {q: v for (x, q), v in held.items() if x == s}
            assert got[s].next_question == script.next(mode, mine) and got[s].completed == (got[s].next_question is None) and got[s].answers == mine
            assert got[s].unanswered == [q for q in script.sequence(mode, mine) if q not in mine] and got[s].n_answered == len(mine)
            assert got[s].pending_examiner == (["pulse"] if mode == "ayush" else [])
    assert 99 not in got


FLAG = "session_id long, ord long, question_id string, reason string, severity string, note string"


class _Receiver(http.server.BaseHTTPRequestHandler):
    got: list = []
    down = True

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        down = self.down and body["severity"] != "critical"
        self.got.append((body, down))
        self.send_response(503 if down else 204)
        self.end_headers()

    def log_message(self, *_):
        pass


@pytest.fixture
def receiver():
    _Receiver.got, _Receiver.down = [], True
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_alerts(spark, receiver):
    """An alert goes out once though its batch is tried again; what failed is told and can be tried again; nothing but codes leaves."""
    at, send = scratch(spark, "test-alerts"), alerts.webhook(receiver)
    flags = spark.createDataFrame([(1, 1, "q", "chest", "critical", "said in private"), (1, 2, "q", "fever", "urgent", "private"), (2, 1, "p", "chest", "critical", None)], FLAG)
    assert alerts.record(flags, 0, f"{at}/l", send) and not alerts.record(flags, 0, f"{at}/l", send)
    assert len(_Receiver.got) == 3 and all(set(b) == {*alerts.ALERT, "alert_id"} for b, _ in _Receiver.got)
    told = {(r.session_id, r.ord): (r.delivered, r.detail) for r in alerts.ledger(spark, f"{at}/l").collect()}
    assert told[1, 1] == told[2, 1] == (True, "delivered: HTTP 204") and not told[1, 2][0] and told[1, 2][1].startswith("failed: ")
    _Receiver.down = False
    assert alerts.retry(spark, f"{at}/l", send, 1) and not alerts.retry(spark, f"{at}/l", send, 1)
    assert len(_Receiver.got) == 4 and _Receiver.got[3][0]["reason"] == "fever" and all(r.delivered for r in alerts.ledger(spark, f"{at}/l").collect())
    assert alerts.retry(spark, f"{at}/l", send, 2) and len(_Receiver.got) == 4


def test_alerts_without_receiver_or_with_one_that_is_gone(spark):
    at = scratch(spark, "test-alerts")
    flags = spark.createDataFrame([(1, 1, "q", "chest", "critical", "x")], FLAG)
    assert alerts.record(flags, 0, f"{at}/a", None) and [tuple(r)[6:8] for r in alerts.ledger(spark, f"{at}/a").collect()] == [(False, alerts.NO_RECEIVER)]
    assert alerts.record(flags, 0, f"{at}/b", alerts.webhook("http://127.0.0.1:9/", 1)) and not alerts.ledger(spark, f"{at}/b").first().delivered
    assert alerts.record(flags.limit(0), 1, f"{at}/b", None) and alerts.ledger(spark, f"{at}/b").count() == 1


def test_alerts_of_a_half_written_batch(spark):
    """What a try that died has left isn't a ledger entry."""
    at = scratch(spark, "test-alerts")
    flags = spark.createDataFrame([(1, 1, "q", "chest", "critical", "x")], FLAG)
    alerts.record(flags, 4, f"{at}/a", None)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/a/batch=4/_SUCCESS")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
    assert alerts.record(flags, 4, f"{at}/a", None) and alerts.ledger(spark, f"{at}/a").count() == 1


def test_pauses(spark):
    """Runs parted by pauses over the limit are closed, also over micro-batches; the last ones once the watermark has passed their limit."""
    rng, base = random.Random(5), scratch(spark, "test-pauses")
    start = datetime.datetime(2024, 1, 1)
    times = sorted((rng.randint(0, 4000), rng.randint(0, 5)) for _ in range(150)) + [(5000, 7), (5050, 8)]
    log = [(s, start + datetime.timedelta(seconds=t)) for t, s in times] + [(None, start)]
    for piece in (log[:60], log[60:110], log[110:]):
        drain(spark, base, piece, "session_id long, ts timestamp", lambda df: pauses.closed(df, 100, "10 seconds"))
    runs, open_ = [], {}
    for t, s in times:
        if s in open_ and t - open_[s][1] > 100:
            runs.append((s, *open_.pop(s)))
        began, _, n = open_.get(s, (t, t, 0))
        open_[s] = (began, t, n + 1)
    runs += [(s, *r) for s, r in open_.items() if r[1] + 100 < 5040]
    zero = spark.sql("SELECT unix_millis(timestamp'2024-01-01')").first()[0]
    got = [(r.session_id, (r.began_ms - zero) // 1000, (r.ended_ms - zero) // 1000, r.n) for r in spark.read.schema(pauses.CLOSED).parquet(f"{base}/out").collect()]
    assert sorted(got) == sorted(runs) and not any(s in (7, 8) for s, *_ in got)


def test_defaults():
    assert scan.interaction_defaults({}) == {"tap_timeout_seconds": 10}
