"""Session memory: a capped running summary and turn count of each session.

As a stream the state of a session is one row (summary, turns) in the state store, so it
survives restarts and lost executors with the query's checkpoint; turns of a batch are
taken in order. There is no event time: a session never expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CAP = 2000
OUT = "session_id long, turns long, summary string"


def cap(text: str, limit: int = CAP) -> str:
    """At most ``limit`` characters, cut at the last space if that lies past the half."""
    if len(text) <= limit:
        return text
    cut = text[:limit]
    at = cut.rfind(" ")
    return cut[:at] if at > limit * 0.5 else cut


def append(summary: str, text: str) -> str:
    """The summary after one more turn; the stand-in for a summarising model joins and caps."""
    return cap(f"{summary} {text}" if summary else text)


def session_memory(turns: DataFrame) -> DataFrame:
    """``turns(session_id, turn, text)``, a stream, -> the memory of each session that a batch touched."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        summary, count = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        for text in rows["text"]:
            summary, count = append(summary, text or ""), count + 1
        state.update((summary, count))
        yield pd.DataFrame([(key[0], count, summary)], columns=["session_id", "turns", "summary"])

    return turns.groupBy("session_id").applyInPandasWithState(step, OUT, "summary string, turns long", "update", "NoTimeout")
