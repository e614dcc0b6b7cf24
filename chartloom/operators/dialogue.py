"""The interview as a service of state: start, checked answers, the next question with its payload, completion and release.

What a session is asked next rests on all answers it has had accepted, so a session's events are taken one after the other,
here over a log (`replay`) and in `streaming.interview.serve` over a stream, by the same `Script.step`. Sessions are
independent; a session's events are bounded by its interview.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators import rules
from chartloom.operators.interview import ASKABLE, MODES, URGENCY
from chartloom.sources.scan import items

EVENT = "session_id long, ord long, kind string, mode string, question_id string, value string, multi array<string>, transcript string"
STEP = "session_id long, ord long, status string, question_id string, next_question string, completed boolean, answered long, estimated_total long, payload string, snapshot string"
#: What of an item goes into a question's hints.
HINTS = ("regions", "min", "max", "face_scale", "max_seconds", "units")


def _as_number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def holds(condition: str, answers: dict) -> bool:
    """A trigger over accepted answers, by the grammar of rules.parse."""
    for name, op, wanted in rules.parse(condition):
        given = answers.get(name)
        if op == " in ":
            true = given in [w.strip() for w in wanted.strip("[]").split(",")]
        elif op == "==":
            true = str(given) == wanted
        else:
            a, b = _as_number(given), _as_number(wanted)
            true = a is not None and b is not None and {"<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b}[op]
        if not true:
            return False
    return True


class Script:
    """An ontology and, if there is one, a condition map, made ready for asking."""

    def __init__(self, ontology: dict, conditions: dict | None = None):
        self.sections = sorted(ontology["sections"], key=lambda s: s.get("order", 0))
        self.entries = {i["id"]: (s["id"], i) for s in self.sections for i in items(s, derived=True)}
        self.targets = {i["follow_up_on_yes"] for _, i in self.entries.values() if i.get("follow_up_on_yes")}
        self.labels = ontology.get("$region_labels", {})
        self.conditions = (conditions or {}).get("conditions")

    def _askable(self, question: str) -> bool:
        item = self.entries[question][1]
        mode = item.get("capture_mode")
        return (mode if mode in MODES else "derived" if item.get("input_type") == "derived" else ASKABLE) == ASKABLE

    def sequence(self, mode: str, answers: dict) -> list[str]:
        """What the session is asked, answered or not; a follow-up stands after a parent answered yes."""
        asked: dict[str, None] = {}
        for s in self.sections:
            own, trigger = s.get("mode"), s.get("trigger")
            if own not in (None, mode) or not (s.get("always") or (holds(trigger, answers) if trigger else own)):
                continue
            for q in (i["id"] for i in items(s)):
                if q in self.targets or not self._askable(q):
                    continue
                asked[q] = None
                follow = self.entries[q][1].get("follow_up_on_yes")
                if follow in self.entries and answers.get(q) == "yes" and self._askable(follow):
                    asked[follow] = None
        return list(asked)

    def _live(self, answers: dict) -> list[tuple[dict, float]]:
        """Conditions with plausibility above 0."""
        found = []
        for c in self.conditions:
            weight = 0.0
            for sign, part in ((1, "discriminators"), (-1, "negative")):
                for d in c.get(part, []):
                    given = answers.get(d["question_id"])
                    if str(d["value"]) in (given if isinstance(given, list) else [given]):
                        weight += sign * float(d["weight"])
            if weight > 0:
                found.append((c, min(1.0, weight)))
        return found

    def next(self, mode: str, answers: dict) -> str | None:
        """The first of the unanswered questions by score, urgency and order; None ends the interview."""
        left = [q for q in self.sequence(mode, answers) if q not in answers]
        if not left or self.conditions is None:
            return left[0] if left else None
        live = self._live(answers)
        effects = []
        for c, p in live:
            by_question: dict[str, float] = {}
            for sign, part in ((1.0, "discriminators"), (-1.0, "negative")):
                for d in c.get(part, []):
                    if abs(float(d["weight"])) > abs(by_question.get(d["question_id"], 0.0)):
                        by_question[d["question_id"]] = sign * float(d["weight"])
            effects.append((p, by_question))

        def rank(question: str):
            musts = [URGENCY.get(c.get("urgency"), 0) for c, _ in live if question in c.get("must_ask", [])]
            e = [(p, by.get(question, 0.0)) for p, by in effects]
            score = 100.0 if musts else abs(e[0][1]) if len(e) == 1 else sum(max(p, r) * abs(x - y) for n, (p, x) in enumerate(e) for r, y in e[n + 1 :])
            return -round(score, 9), -max(musts, default=0)

        return min(left, key=rank) if live else left[0]

    def payload(self, question: str, mode: str, answers: dict) -> dict:
        """What a client shows."""
        section, item = self.entries[question]
        hints = {k: item[k] for k in HINTS if k in item}
        if "regions" in hints:
            hints["region_labels"] = {r: self.labels[r] for r in hints["regions"] if r in self.labels}
        skippable = bool(item["skippable"]) if "skippable" in item else not item["required"] if "required" in item else True
        options = [{"id": o["id"], "label": o.get("label", {}), "icon": o.get("icon"), "exclusive": o.get("exclusive", False)} for o in item.get("options", [])]
        return {"question_id": question, "section_id": section, "input_type": item.get("input_type"), "prompt": item.get("prompt", {}), "audio_url": item.get("audio_url"), "options": options, "skippable": skippable, "hints": hints, "selection_reason": "ontology_order" if self.conditions is None else "condition_map"}

    def step(self, state: dict | None, event: dict) -> tuple[dict | None, tuple]:
        """The state after an event, None once the interview is over, and the row that tells of it (without session and ord).

        A start, also of a known session, begins anew. An answer counts only if it is to the question that waits; any other is
        refused and changes nothing, and so is one to a session that isn't open. A null value counts as answered.
        """
        question = event["question_id"]
        if event["kind"] == "start":
            state, status = {"mode": event["mode"] or "allopathic", "answers": {}, "narration": []}, "started"
        elif state is None:
            return None, ("unknown session", question, None, False, 0, 0, None, None)
        elif question != (waits := self.next(state["mode"], state["answers"])):
            status = f"refused: waiting for {waits}"
        else:
            status = "accepted"
            state["answers"][question] = event["multi"] if event["multi"] is not None else event["value"]
            if event["transcript"]:
                state["narration"].append(event["transcript"])
        mode, answers = state["mode"], state["answers"]
        following, asked = self.next(mode, answers), self.sequence(mode, answers)
        shown = None if following is None else json.dumps(self.payload(following, mode, answers), ensure_ascii=False, sort_keys=True)
        told = json.dumps({"mode": mode, "answers": answers, "narration": state["narration"], "unanswered": [q for q in asked if q not in answers]}, ensure_ascii=False)
        return None if following is None else state, (status, question, following, following is None, sum(q in answers for q in asked), len(asked), shown, told)

    def play(self, state: dict | None, events: pd.DataFrame) -> tuple[dict | None, pd.DataFrame]:
        """A session's events in their order."""
        out = []
        for e in events.sort_values("ord", kind="stable").to_dict("records"):
            clean = {k: None if not isinstance(v, (list, str)) and (v is None or pd.isna(v)) else v for k, v in ((k, list(v) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else v) for k, v in e.items())}
            state, row = self.step(state, clean)
            out.append((e["session_id"], e["ord"], *row))
        return state, pd.DataFrame(out, columns=[c.split()[0] for c in STEP.split(", ")])


def replay(events: DataFrame, script: Script) -> DataFrame:
    """A row of STEP for each event (EVENT) of a log: what became of it and what is asked next. Events without a session are dropped."""
    return events.where("session_id is not null").groupBy("session_id").applyInPandas(lambda rows: script.play(None, rows)[1], STEP)


def read(steps: DataFrame) -> DataFrame:
    """(session_id, next_question, completed, answers, unanswered, narration) as of each session's last event; sessions never started have no row."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ord"))
    last = steps.where("snapshot is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    said = F.from_json("snapshot", "answers map<string,string>, unanswered array<string>, narration array<string>")
    return last.withColumn("s", said).select("session_id", "next_question", "completed", "s.answers", "s.unanswered", "s.narration")
