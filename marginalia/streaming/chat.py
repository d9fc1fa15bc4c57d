"""The chat service as a stream with state, and as a fold over a batch.

Requests become events: tokens of the answer, one after another, then one ``result``; or one ``error``. A
request is answered with the profile of its owner (joined before) and the memory of its
session, which is state: summary and number of turns. Only answers of the behaviours in
``REMEMBERED`` are folded into the memory, after the result is out; a fold that fails is noted on
the result row and changes neither the answer nor the state.

The seams are plain functions, ``answer(Request) -> Answer`` and ``fold(summary, question, answer) -> str``. An answer
that raises becomes the error event of that request alone.

State lives in the state store under ``memory``, with an optional time to live; with ``idle`` a
session that asks nothing for so long is closed by an event-time timer: its memory goes and
a ``closed`` event is written. Requests of a session are taken in the order of their ``seq``; ones
that were taken already (a replay after a restart of the source) are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.streaming.session_memory import CAP, append

# Behaviours whose turns are remembered, the event types, and the fields of a request.
REMEMBERED = ("answer", "flag-void-clause")
TOKEN, RESULT, ERROR, CLOSED = "token", "result", "error", "closed"
FIELDS = ("question", "itemId", "traceId", "ownerId", "sessionId")

EVENTS = "session_id string, seq long, n int, type string, token string, body string"
_EVENT_NAMES = ["session_id", "seq", "n", "type", "token", "body"]
#: Where requests without a session go: they have no memory.
NO_SESSION = ""


@dataclass(frozen=True)
class Request:
    """What the answer seam sees."""

    item_id: str
    question: str
    trace_id: str | None
    profile: str | None
    summary: str
    turns: int
    keys: tuple[str, ...] = ()
    contexts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Answer:
    """An answer envelope: behaviour, text, claims, and whether the run was cut short."""

    behaviour: str
    text: str
    claims: tuple[dict[str, Any], ...] = field(default=())
    degraded: bool = False


AnswerSeam = Callable[[Request], Answer]
FoldSeam = Callable[[str, str, str], str]


def quote_first(request: Request) -> Answer:
    """A stand-in model: quotes the first words of the first context; refuses without one."""
    if not request.contexts:
        return Answer("refuse", "I cannot answer that from the sources.")
    return Answer("answer", " ".join(request.contexts[0].split()[:12]), ({"text": request.contexts[0][:80], "cites": list(request.keys[:1])},))


def fold_turn(summary: str, question: str, answer: str) -> str:
    """A stand-in summariser: question and answer are appended and capped."""
    return append(summary, f"Q: {question} A: {answer}")


def parse_requests(raw: Column) -> Column:
    """A request body as a struct of its fields and ``problem``, which is null if the body is valid.

    Bodies are strict: known fields only, all strings, ``question`` and ``itemId`` not empty, ``traceId`` 32 lower-case
    hex digits, ``ownerId`` and ``sessionId`` not empty where given.
    """
    body = F.try_parse_json(raw)
    fields = F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"})
    kind = lambda name: F.schema_of_variant(F.try_variant_get(body, f"$.{name}", "variant"))
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(body, f"$.{name}", "string"))
    given = lambda name: F.map_contains_key(fields, name)
    unknown = F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, FIELDS)))) > 0
    problem = F.when(body.isNull() | (F.schema_of_variant(body).startswith("OBJECT") != F.lit(True)), "no object").when(unknown, "unknown field")
    for name in ("question", "itemId"):
        problem = problem.when(F.coalesce(F.length(text(name)), F.lit(0)) == 0, f"{name} must be a text")
    for name in ("ownerId", "sessionId"):
        problem = problem.when(given(name) & (F.coalesce(F.length(text(name)), F.lit(0)) == 0), f"{name} must be a text")
    problem = problem.when(given("traceId") & ~F.coalesce(text("traceId").rlike("^[0-9a-f]{32}$"), F.lit(False)), "traceId must be 32 hex digits")
    names = {"question": "question", "itemId": "item_id", "traceId": "trace_id", "ownerId": "owner_id", "sessionId": "session_id"}
    return F.struct(*(text(old).alias(new) for old, new in names.items()), problem.alias("problem"))


def with_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """``requests`` with the ``profile`` of their owner, null without one; ``profiles(owner_id, profile)`` is a static table."""
    return requests.join(profiles.select("owner_id", "profile"), "owner_id", "left")


def _tokens(text: str) -> list[str]:
    """What is streamed: words with the white space before them; together they are the text."""
    return re.findall(r"\s*\S+|\s+$", text)


@dataclass
class Memory:
    """The state of a session."""

    summary: str = ""
    turns: int = 0
    last: int = -1


def turn(row: Any, memory: Memory, answer: AnswerSeam, fold: FoldSeam) -> Iterator[tuple]:
    """The events of one request; ``memory`` is renewed once they are out."""
    session, seq, given = row.session_id or NO_SESSION, int(row.seq), lambda x: None if x is None or x != x else x
    if given(row.problem) is not None:
        yield session, seq, 0, ERROR, None, json.dumps({"message": row.problem})
        return
    keys, contexts = (() if x is None else tuple(x) for x in (row.keys, row.contexts))
    summary, turns = (memory.summary, memory.turns) if session else ("", 0)
    request = Request(row.item_id, row.question, given(row.trace_id), given(row.profile), summary, turns, keys, contexts)
    try:
        found = answer(request)
    except Exception as error:  # one request's failure is its own event
        yield session, seq, 0, ERROR, None, json.dumps({"message": str(error)})
        return
    pieces = _tokens(found.text)
    for n, piece in enumerate(pieces):
        yield session, seq, n, TOKEN, piece, None
    remembered, failed = bool(session) and found.behaviour in REMEMBERED, None
    if remembered:
        try:
            memory.summary, memory.turns = fold(memory.summary, row.question, found.text)[:CAP], memory.turns + 1
        except Exception as error:  # the answer stands without it
            remembered, failed = False, str(error)
    body = {
        "traceId": request.trace_id, "itemId": request.item_id, "behaviorClass": found.behaviour, "answer": found.text, "claims": list(found.claims),
        "retrievedCitablePathKeys": list(keys), "retrievedContexts": list(contexts), "degraded": found.degraded, "priorTurns": turns, "remembered": remembered,
    }
    body |= {"memoryError": failed} if failed else {}
    yield session, seq, len(pieces), RESULT, None, json.dumps(body, sort_keys=True)


class ChatProcessor(StatefulProcessor):
    """Sessions, one key each."""

    def __init__(self, answer: AnswerSeam, fold: FoldSeam, ttl: timedelta | None, idle: timedelta | None):
        self.answer, self.fold, self.ttl, self.idle = answer, fold, ttl, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.ttl is None else int(self.ttl.total_seconds() * 1000)
        self.memory = handle.getValueState("memory", "summary string, turns long, last long", ttl)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        memory = Memory(*self.memory.get()) if key[0] and self.memory.exists() else Memory()
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        events: list[tuple] = []
        latest = None
        for row in frame.itertuples(index=False):
            if key[0] and row.seq <= memory.last:
                continue
            events += turn(row, memory, self.answer, self.fold)
            memory.last = int(row.seq) if key[0] else -1
            latest = row.asked_at if latest is None or row.asked_at > latest else latest
        if key[0] and events:
            self.memory.update((memory.summary, memory.turns, memory.last))
            if self.idle is not None and latest is not None:
                if self.due.exists():
                    self.handle.deleteTimer(self.due.get()[0])
                at = int(pd.Timestamp(latest).timestamp() * 1000 + self.idle.total_seconds() * 1000)
                self.handle.registerTimer(at)
                self.due.update((at,))
        yield pd.DataFrame(events, columns=_EVENT_NAMES)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        memory = Memory(*self.memory.get()) if self.memory.exists() else Memory()
        self.memory.clear()
        self.due.clear()
        yield pd.DataFrame([(key[0], memory.last, 0, CLOSED, None, json.dumps({"turns": memory.turns}))], columns=_EVENT_NAMES)

    def close(self) -> None:
        pass


def _ready(requests: DataFrame) -> DataFrame:
    """The columns that a turn reads; those that are missing are null."""
    kinds = {"session_id": "string", "seq": "long", "item_id": "string", "question": "string", "trace_id": "string", "profile": "string", "problem": "string", "keys": "array<string>", "contexts": "array<string>", "asked_at": "timestamp"}
    have = {c.lower() for c in requests.columns}
    columns = [(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    return requests.select(*columns).withColumn("session_id", F.coalesce("session_id", F.lit(NO_SESSION)))


def chat_events(requests: DataFrame, *, answer: AnswerSeam = quote_first, fold: FoldSeam = fold_turn, ttl: timedelta | None = None, idle: timedelta | None = None) -> DataFrame:
    """Events of a stream of requests; needs the RocksDB state store.

    ``requests(session_id, seq, item_id, question, trace_id, profile, keys, contexts, problem, asked_at)``, of which all but
    seq may be missing. ``idle`` needs a watermark on ``asked_at``; ``ttl`` counts processing time. They exclude one another.
    """
    if ttl is not None and idle is not None:
        raise ValueError("ttl counts processing time, idle event time: a stream has one of them")
    processor = ChatProcessor(answer, fold, ttl, idle)
    mode = "EventTime" if idle is not None else "ProcessingTime" if ttl is not None else "None"
    return _ready(requests).groupBy("session_id").transformWithStateInPandas(processor, EVENTS, "Append" if idle is not None else "Update", mode)


def chat_events_batch(requests: DataFrame, *, answer: AnswerSeam = quote_first, fold: FoldSeam = fold_turn) -> DataFrame:
    """The same events of a finished table of requests: sorted by session and seq, and read as they come.

    A task holds one memory at a time, however long a session is; requests without a session are dealt out evenly.
    """
    ready = _ready(requests)
    spread = F.when(F.col("session_id") == NO_SESSION, F.xxhash64("seq", "item_id", "question"))
    dealt = ready.repartition("session_id", spread).sortWithinPartitions("session_id", "seq")
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, memory = None, Memory()
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            events: list[tuple] = []
            for row in pd.DataFrame({c: batch.column(i).to_pylist() for i, c in enumerate(names)}, columns=names, dtype=object).itertuples(index=False):
                if row.session_id != at:
                    at, memory = row.session_id, Memory()
                if at and row.seq <= memory.last:
                    continue
                events += turn(row, memory, answer, fold)
                memory.last = int(row.seq) if at else -1
            columns = zip(*events, strict=True) if events else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _EVENT_NAMES)

    return dealt.mapInArrow(run, EVENTS)


def event_sink(folder: str, also: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the events of a batch as Parquet under its number, so a batch that is run again replaces itself.

    ``also`` is a further write (a store, say). If it fails, the batch stands and its number and the error are set
    aside under ``failed``, for ``failed_batches`` and another try.
    """
    folder = folder.rstrip("/")

    def write(events: DataFrame, number: int) -> None:
        kept = events.persist()
        try:
            kept.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
            if also is not None:
                try:
                    also(kept, number)
                except Exception as error:  # the events are out already
                    row = [(number, type(error).__name__, str(error)[:500], datetime.now())]
                    known = events.sparkSession.createDataFrame(row, "batch long, kind string, message string, at timestamp")
                    known.coalesce(1).write.mode("overwrite").parquet(f"{folder}/failed/batch={number}")
        finally:
            kept.unpersist()

    return write


def service_response(events: DataFrame) -> DataFrame:
    """One row a request, as a service without a stream answers it (11.30): its result body, or its error."""
    ends = events.where(F.col("type").isin(RESULT, ERROR))
    return ends.select("session_id", "seq", F.col("type") == ERROR, "body").toDF("session_id", "seq", "failed", "body")
