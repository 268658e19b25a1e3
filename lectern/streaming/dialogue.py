"""Slot-filling dialogues: planning flows that ask for what is missing, as a stateful stream and as an ordered batch fold.

What a turn says (semesters, credits, codes, programmes that its words name) is found by column functions, in the JVM. The state
machine only merges these slots, turn by turn.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.grouped import per_group
from lectern.operators.relational import small

#: Commands that start a flow, and the flows.
COMMANDS = {
    "__hero__:plan_study_program": "plan_study_program",
    "__hero__:plan_whole_study_program": "plan_study_program",
    "__hero__:complete_study_plan": "plan_study_program",
    "__hero__:plan_semester": "plan_semester",
    "__hero__:plan_mobility": "plan_mobility",
}
#: Words for more results, for courses already passed, for a suggestion, and words that aren't part of a programme's name.
MORE = r"(?i)\b(show more|more results|next|weitere|mehr)\b"
COMPLETED = r"(?i)\b(already completed|completed|done|passed|without those|ohne diese|déjà validé)\b"
SUGGEST = r"(?i)suggest|recommend|of your choice"
FILLERS = r"(?i)\b(bachelor|master|doctorate|phd|in|for|over|within|complete|study|plan|program|programme)\b"
#: Programmes offered for a choice, semesters of a stay, results a page, credits of a suggestion, semesters of a plan.
OFFERED, STAY, PAGE, SUGGESTED_ECTS, MOST_SEMESTERS = 8, 2, 25, 30, 16

SLOTS = "command string, semesters array<string>, rest string, number long, count int, count_said boolean, ects int, codes array<string>, more boolean, passed boolean, suggest boolean, query string, programs array<long>"
ACTION = "session_id long, turn long, flow string, action string, program_id long, semesters array<string>, count int, ects int, interest string, codes array<string>, shown int"
_UNIT = r"(?i)\b(\d{1,2})\s*(?:semester|semesters|semestri|semestren)\b"


def program_candidates(query: Column, catalog: DataFrame) -> Column:
    """Ids of the programmes whose name holds the query, in order of ids; ``catalog`` (program_id, name) is a small dimension."""
    known = catalog.where("program_id is not null and name <> ''").distinct()
    if not small(known):
        raise ValueError("a catalogue of more bytes than a broadcast may have: join the candidates before the turns are read")
    rows = known.orderBy("program_id", "name").collect()
    if not rows:
        return F.array().cast("array<long>")
    names = F.array(*[F.struct(F.lit(int(r.program_id)).cast("long").alias("id"), F.lit(r.name.lower()).alias("name")) for r in rows])
    return F.when(query == "", F.array().cast("array<long>")).otherwise(F.array_distinct(F.transform(F.filter(names, lambda p: F.contains(p["name"], F.lower(query))), lambda p: p["id"])))


def with_slots(turns: DataFrame, catalog: DataFrame, text: str = "text") -> DataFrame:
    """``turns`` with a struct ``slots`` of what each text says. Null texts say nothing."""
    t = F.coalesce(F.col(text), F.lit(""))
    first = lambda pattern, c=t: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    half = lambda x: F.when(F.upper(F.left(x, F.lit(2))).isin("HS", "AS", "SA"), "HS-").otherwise("FS-")
    named = F.regexp_extract_all(t, F.lit(r"(?i)\b((?:HS|AS|SA|FS|SS|SP)[-\s]?\d{4})\b"), F.lit(1))
    semesters = F.slice(F.array_distinct(F.transform(named, lambda x: F.concat(half(x), F.right(x, F.lit(4))))), 1, STAY)
    trimmed = lambda c, marks: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), rf"^[{marks}]+|[{marks}]+$", "")
    rest = trimmed(F.regexp_replace(t, r"(?i)\b(HS|AS|SA|FS|SS|SP)[-\s]?\d{4}\b", " "), r" ,.:\-")
    count = first(r"(?i)\b(\d{1,2})\s*(?:semester|semesters|semestri|semestren)?\b").try_cast("int")
    count = F.when(count.between(1, MOST_SEMESTERS), count)
    ects = first(r"(?i)\b(\d{1,3})\s*ects\b").try_cast("int")
    words = F.when(count.isNotNull(), F.regexp_replace(rest, r"(?i)\b\d{1,2}\s*(semester|semesters|semestri|semestren)?\b", "")).otherwise(rest)
    words = F.when(ects.isNotNull(), F.regexp_replace(words, r"(?i)\b\d{2,3}\s*ects\b", "")).otherwise(words)
    command = F.lit(None).cast("string")
    for said, flow in COMMANDS.items():
        command = F.when(F.lower(F.trim(t)) == said, flow).otherwise(command)
    out = turns.withColumn("_query", trimmed(F.regexp_replace(words, FILLERS, " "), r" ,.\-"))
    slots = F.struct(
        command.alias("command"), semesters.alias("semesters"), rest.alias("rest"), first(r"(?i)\b(?:id\s*)?(\d{1,18})\b").try_cast("long").alias("number"), count.alias("count"), t.rlike(_UNIT).alias("count_said"),
        ects.alias("ects"), F.array_distinct(F.regexp_extract_all(F.upper(t), F.lit(r"(?<![A-Z0-9])([A-Z]{2,3}-[A-Z]{1,3}\.?[0-9.]+)"), F.lit(1))).alias("codes"), t.rlike(MORE).alias("more"), t.rlike(COMPLETED).alias("passed"),
        t.rlike(SUGGEST).alias("suggest"), F.col("_query").alias("query"), program_candidates(F.col("_query"), catalog).alias("programs"),
    )
    return out.withColumn("slots", slots.cast(f"struct<{SLOTS.replace(' ', ':').replace(',:', ',')}>")).drop("_query")


@dataclass
class State:
    """What a session knows. ``shown`` counts the results given of the last search, ``at`` is the time of the last turn in milliseconds."""

    turn: int = -1
    at: int = 0
    flow: str | None = None
    step: str | None = None
    program_id: int | None = None
    count: int | None = None
    ects: int | None = None
    interest: str | None = None
    shown: int | None = None
    semesters: list[str] = field(default_factory=list)
    offered: list[int] = field(default_factory=list)
    codes: list[str] = field(default_factory=list)


def _merged(a: list, b: list) -> list:
    return list(dict.fromkeys([*a, *b]))


def _choose(s: State, said: dict, words: str) -> str | None:
    """Fill the slot of the programme; the question to ask if it stays open."""
    if s.offered and s.program_id is None and said["number"] is not None:
        if said["number"] not in s.offered:
            return "unknown_id"
        s.program_id = said["number"]
    if s.program_id is None:
        if not words:
            return "ask_program"
        if not said["programs"]:
            return "unknown_program"
        if len(said["programs"]) > 1:
            s.offered = list(said["programs"][:OFFERED])
            return "choose_program"
        s.program_id = said["programs"][0]
    return None


def _mobility(s: State, said: dict) -> str:
    s.semesters = _merged(s.semesters, said["semesters"])[:STAY]
    if said["rest"] and said["rest"].lower() not in ("fs", "hs", "ss", "as"):
        s.interest = said["rest"]
    if not s.semesters:
        return "ask_semester"
    if not s.interest:
        return "ask_interest"
    s.flow, s.shown = None, PAGE
    return "mobility"


def _study_program(s: State, said: dict) -> str:
    if said["count_said"] or not (s.offered and s.program_id is None):
        s.count = said["count"] or s.count
    s.ects = said["ects"] if said["ects"] and said["ects"] > 9 else s.ects
    if ask := _choose(s, said, said["query"]):
        return ask
    if not s.count:
        return "ask_count"
    waits = s.step == "electives"
    if waits and not said["codes"] and not said["passed"]:
        return "ask_electives"
    s.codes = _merged(s.codes, said["codes"]) if waits or said["passed"] else s.codes
    s.offered, s.step = [], None if waits or s.codes else "electives"
    return "plan"


def _semester(s: State, said: dict) -> str:
    if s.step == "completed":
        if not said["codes"]:
            return "ask_completed"
        s.codes, s.step = list(said["codes"]), "take"
        return "remaining"
    if s.step == "take":
        target = said["ects"] if said["ects"] and said["ects"] < 100 else None
        if said["suggest"] or target:
            s.ects = target or SUGGESTED_ECTS
            return "suggest"
        if said["codes"]:
            return "selected"
    s.semesters = s.semesters or list(said["semesters"][:1])
    if not s.semesters:
        return "ask_semester"
    if ask := _choose(s, said, said["rest"]):
        return ask
    s.step = "completed"
    return "courses"


_FLOWS = {"plan_mobility": _mobility, "plan_study_program": _study_program, "plan_semester": _semester}


def _reset(s: State, **values) -> None:  # noqa: ANN003
    for name, value in dataclasses.asdict(State(**values)).items():
        setattr(s, name, value)


def advance(s: State, turn: int, at: int, said: dict, idle: int) -> tuple | None:
    """Take a user's turn: what is done (a row of ``ACTION`` without session), or None for a turn that is not later than the last.

    A session that was silent for more than ``idle`` milliseconds starts anew.
    """
    if turn <= s.turn:
        return None
    if s.turn >= 0 and at - s.at > idle:
        _reset(s)
    s.turn, s.at = turn, max(at, s.at)
    flow = s.flow
    if s.shown is not None and said["more"]:
        s.shown += PAGE
        action = "more"
    elif said["command"]:
        _reset(s, turn=turn, at=s.at, flow=said["command"], shown=s.shown)
        flow, action = s.flow, "intro"
    elif flow:
        action = _FLOWS[flow](s, said)
    else:
        action = "question"
    return turn, flow, action, s.program_id, list(s.semesters), s.count, s.ects, s.interest, list(s.codes), s.shown


def _users(turns: DataFrame, catalog: DataFrame) -> DataFrame:
    own = turns.where("role = 'user' and session_id is not null and turn is not null and ts is not null")
    return with_slots(own, catalog).select("session_id", "turn", "ts", F.unix_millis("ts").alias("at"), "text", F.to_json("slots").alias("slots"))


def _read(slots: str) -> dict:
    empty = dict.fromkeys(("command", "rest", "number", "count", "ects", "query")) | {"semesters": [], "codes": [], "programs": []}
    return empty | json.loads(slots)


def fold_dialogues(turns: DataFrame, catalog: DataFrame, idle_minutes: int = 30) -> DataFrame:
    """(session_id, turn, flow, action, slots...) of every user turn in order: the batch twin of ``stream_dialogues``.

    ``turns``: session_id, turn, ts, role, text. Turns of other roles, and null ids, turns or times, are left out; of turns that repeat a number
    the first counts, in order of times and texts. A command starts its flow anew; a flow without missing slots acts, and a session without flow asks a question. Sessions that are silent for
    longer than ``idle_minutes`` start anew.
    """
    def run(rows: list) -> list[tuple]:
        s, out = State(), []
        for r in rows:
            done = advance(s, r.turn, r.at, _read(r.slots), idle_minutes * 60_000)
            if done:
                out.append((r.session_id, *done))
        return out

    return per_group(_users(turns, catalog).drop("ts"), ["session_id"], ["turn", "at", "text"], run, ACTION)


#: What is kept of a session: the fields of ``State``, and the time of its timer.
KEPT = "turn long, at long, flow string, step string, program_id long, count int, ects int, interest string, shown int, semesters array<string>, offered array<long>, codes array<string>, timer long"


class Dialogues(StatefulProcessor):
    """A session's slots in state, as one value, which is read and written once a batch. A silent session is forgotten by a timer."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms
        self.row = Row(*[x.split()[0] for x in ACTION.split(", ")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        *values, timer = self.kept.get() or (*dataclasses.astuple(State()), None)
        s, out = State(*values[:9], *map(list, values[9:])), []
        for turn, at, _, slots in sorted((r.turn, r.at, r.text or "", r.slots) for r in rows):
            done = advance(s, turn, at, _read(slots), self.idle_ms)
            if done:
                out.append(self.row(key[0], *done))
        due = s.at + self.idle_ms + 1
        self.kept.update((*dataclasses.astuple(s), due))
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_dialogues(turns: DataFrame, catalog: DataFrame, idle_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """As ``fold_dialogues``, over a stream: each micro-batch's turns of a session are taken in order, later ones go on from the state.

    Turns that come after a later one of their session are left out, and so are those more than ``late`` behind the stream. Needs the RocksDB
    state store (``stateful``). A silent session's state is dropped once the stream's time has passed it.
    """
    said = _users(turns, catalog).withWatermark("ts", late)
    return said.groupBy("session_id").transformWithState(Dialogues(idle_minutes * 60_000), ACTION, "append", "EventTime")


def stateful(spark) -> None:  # noqa: ANN001
    """Let the session's streams keep lists and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
