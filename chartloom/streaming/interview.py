"""The interview as a stream: state per session, rules on the state as of each answer."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from chartloom.operators.dialogue import STEP, Script
from chartloom.operators.interview import red_flags

ANSWER = "session_id long, ord long, question_id string, value string, multi array<string>, dur_amount double, dur_unit string"
_ORDER = ["session_id", "ord", "question_id", "value", "multi", "dur_amount", "dur_unit"]


@contextmanager
def state_store(spark: SparkSession):
    """The state store that map state needs, for queries started inside; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SessionState(StatefulProcessor):
    """Keeps a session's answers by question and sends each answer on with all that hold as of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("v", StringType(), True)])
        self.answers = handle.getMapState("answers", StructType([StructField("question_id", StringType(), True)]), text)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = {k[0]: v[0] for k, v in self.answers.iterator()}
        got = pd.concat(list(rows)).sort_values("ord", kind="stable")
        out, told = [], {}
        for r in zip(*(got[c] for c in _ORDER)):
            state[r[2]] = told[r[2]] = r[3]
            out.append((*r, dict(state)))
        # the store is told once of a question, however often it was answered
        for question, value in told.items():
            self.answers.updateValue((question,), (value,))
        yield pd.DataFrame(out, columns=[*_ORDER, "state"])

    def close(self) -> None:
        pass


def states(answers: DataFrame) -> DataFrame:
    """The stream of answers, each with the map of its session's answers so far. Needs the RocksDB state store; a session's rows of one micro-batch are taken in ord order."""
    schema = ANSWER + ", state map<string,string>"
    return answers.groupBy("session_id").transformWithStateInPandas(SessionState(), schema, "Append", "None")


def stream_red_flags(answers: DataFrame, rules: list[dict]) -> DataFrame:
    """The same rows as red_flags over the answers in batch: only keeping state is Python, rules are columns."""
    return red_flags(states(answers), rules, ["session_id"], with_state=True)


class ServedSession(StatefulProcessor):
    """Keeps an open interview as one JSON value, and drops it once nothing is left to ask."""

    def __init__(self, script: Script):
        self.script = script

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("session", StructType([StructField("state", StringType(), True)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        state, out = self.script.play(state, pd.concat(list(rows)))
        if state is None:
            self.kept.clear()
        else:
            self.kept.update((json.dumps(state),))
        yield out

    def close(self) -> None:
        pass


def serve(events: DataFrame, script: Script) -> DataFrame:
    """The same rows as dialogue.replay, from a stream of events; run it inside state_store. One task holds a session at a time."""
    return events.where("session_id is not null").groupBy("session_id").transformWithStateInPandas(ServedSession(script), STEP, "Append", "None")
