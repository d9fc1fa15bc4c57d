"""The embedding seam: texts to a provider in full batches, paced over all tasks, with retries.

``embed(rows, provider)`` with ``rows(id, text)`` and ``provider(texts) -> vectors``. Batches have ``batch`` texts whatever
Arrow brings: a batch runs on over the borders of Arrow's, only a task's last one is shorter.

Pace. Calls start in slots, ``spacing`` seconds apart since a moment that the driver sets. With ``lanes`` tasks the one
numbered p uses the slots p, p + lanes, p + 2 * lanes ... that still lie ahead, so no two calls of whatever tasks share a
slot, without any talk between them; one lane uses every slot. Retries wait for slots like any call.

A call that fails is tried again, ``tries`` times in all, after a pause of ``backoff``: twice as long each time, up to a
limit, and a jitter that a hash of batch and try decides. What fails to the end is the task's error. A provider that
gives another number of vectors than it got texts is an error at once.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.builds import FIRST_MS, LONGEST_MS

# Texts a request, seconds between requests.
BATCH, SPACING = 96, 21.0

Provider = Callable[[Sequence[str]], Sequence[Sequence[float]]]
OUT = "id {kind}, vector array<double>, batch int, tries int, slot long"


class ProviderError(RuntimeError):
    """A call that may be tried again."""


def backoff_ms(attempt: int, jitter: int, first: int = FIRST_MS, longest: int = LONGEST_MS) -> int:
    """How long to wait after the attempt of this number, from 0."""
    return min(first * 2**attempt, longest) + jitter


class Slots:
    """The slots of one lane."""

    def __init__(self, start: float, spacing: float, lane: int, lanes: int):
        self.start, self.spacing, self.lane, self.lanes, self.last = start, spacing, lane, lanes, -1

    def next(self, now: float) -> tuple[int, float]:
        """The next free slot of the lane and the seconds to wait for it."""
        ahead = 0 if self.spacing <= 0 else max(0, -int(-(now - self.start) // self.spacing))
        least = max(ahead, self.last + 1)
        slot = least + (self.lane - least) % self.lanes
        self.last = slot
        return slot, max(0.0, self.start + slot * self.spacing - now)


def _vectors(provider: Provider, texts: list[str], slots: Slots, tries: int, first_ms: int) -> tuple[list[list[float]], int, int]:
    """Vectors of one batch, the tries it took, and the slot of the last."""
    for attempt in range(tries):
        slot, wait = slots.next(time.time())
        time.sleep(wait)
        try:
            found = [list(map(float, v)) for v in provider(texts)]
        except ProviderError:
            if attempt + 1 == tries:
                raise
            jitter = zlib.crc32(f"{slot}:{attempt}".encode()) % max(first_ms, 1)
            time.sleep(backoff_ms(attempt, jitter, first_ms) / 1000)
            continue
        if len(found) != len(texts):
            raise ValueError(f"{len(texts)} texts, {len(found)} vectors")
        return found, attempt + 1, slot
    raise ValueError("tries must be positive")


def embed(rows: DataFrame, provider: Provider, *, batch: int = BATCH, lanes: int = 1, spacing: float = SPACING, tries: int = 4, first_ms: int = FIRST_MS) -> DataFrame:
    """``(id, vector, batch, tries, slot)`` of every row, in the order of ids within a lane; a null text is an empty one.

    ``batch``, ``tries`` and ``slot`` tell which call of its lane a row was in. Rows are dealt to lanes by a hash of id and
    text and sorted by id, so a lane's batches are the same whenever it runs.
    """
    kind = rows.schema["id"].dataType.simpleString()
    start = time.time()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(start, spacing, TaskContext.get().partitionId() % lanes, lanes)
        held: list[pa.RecordBatch] = []
        number = 0

        def send(part: pa.Table) -> pa.RecordBatch:
            found, used, slot = _vectors(provider, [t or "" for t in part.column(1).to_pylist()], slots, tries, first_ms)
            n = part.num_rows
            columns = [part.column(0).combine_chunks(), pa.array(found, pa.list_(pa.float64())), pa.array([number] * n, pa.int32()), pa.array([used] * n, pa.int32()), pa.array([slot] * n, pa.int64())]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["id", "vector", "batch", "tries", "slot"])

        for arrived in batches:
            held.append(arrived)
            while sum(h.num_rows for h in held) >= batch:
                table = pa.Table.from_batches(held)
                yield send(table.slice(0, batch))
                number += 1
                held = table.slice(batch).to_batches()
        if sum(h.num_rows for h in held):
            yield send(pa.Table.from_batches(held))

    lane = F.pmod(F.xxhash64("id", "text"), F.lit(lanes)).cast("int")
    # a partition a lane: dealt by a hash of the lane, several would share one and others stay empty
    dealt = rows.select("id", F.col("text").cast("string").alias("text"), lane.alias("lane")).repartitionById(lanes, "lane").sortWithinPartitions("id", "text")
    return dealt.select("id", "text").mapInArrow(run, OUT.format(kind=kind))


def counting_provider(texts: Sequence[str]) -> list[list[float]]:
    """A deterministic stand-in: characters, blanks, digits and ``e``s of each text."""
    return [[len(t), t.count(" "), sum("0" <= c <= "9" for c in t), t.count("e")] for t in texts]
