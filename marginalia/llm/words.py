"""Distinct words of a worker, numbered, so that the work on a word is done once.

A table lives in its Python worker and outlasts a task (workers are reused). It is
emptied when it holds more than ``capacity`` words or ``TABLE_BYTES`` bytes, so its memory is bounded
whatever the partition holds. Emptying it changes the time, never a result.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from marginalia.llm.textkernel import slices, string_buffer


def spare(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so (names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col(quote(name))


def quote(name: str) -> str:
    """A name as SQL and schema strings take it."""
    return "`" + name.replace("`", "``") + "`"


def _hashable(value: Column, kind: DataType) -> Column:
    """``value`` with its maps as entries in the order of their keys, at any depth: maps have no hash."""
    if "map<" not in kind.simpleString() and "variant" not in kind.simpleString():
        return value
    if isinstance(kind, MapType):
        entries = F.transform_values(value, lambda _, v: _hashable(v, kind.valueType))
        pairs = F.transform(F.map_entries(entries), lambda e: F.struct(F.xxhash64(e["key"]).alias("h"), e.alias("e")))
        ordered = F.array_sort(pairs, lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
        return ordered
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.struct(value.isNull().alias("none"), *(_hashable(value[f.name], f.dataType).alias(f"v{i}") for i, f in enumerate(kind.fields)))
    return F.to_json(value) if isinstance(kind, VariantType) else value


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; which of them are null counts too. Maps are hashed as their entries by key."""
    parts = [(quoted(f.name), f.dataType) for f in df.schema.fields]
    return F.xxhash64(*[x for c, kind in parts for x in (c.isNull(), _hashable(c, kind))])


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.bytes += len(word)
        self.fresh.append(word)
        return n


#: Bytes of words that a table holds before it is emptied.
TABLE_BYTES = 64_000_000


class WordTable:
    """Words (bytes without white space) -> rows of feature arrays, made by ``describe(words)``."""

    def __init__(self, describe: Callable[[list[bytes]], tuple[np.ndarray, ...]], capacity: int = 600_000):
        self.describe, self.capacity = describe, capacity
        self._reset()

    def _reset(self) -> None:
        self.numbers, self.columns, self.used = _Numbers(), None, 0

    def index(self, words: list[bytes]) -> np.ndarray:
        """The row of each word; ``self.columns`` then holds the features of all rows."""
        if len(self.numbers) > self.capacity or self.numbers.bytes > TABLE_BYTES:
            self._reset()
        out = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.fresh:
            new, self.numbers.fresh = self.describe(self.numbers.fresh), []
            self._append(new)
        return out

    def _append(self, new: tuple[np.ndarray, ...]) -> None:
        n = len(new[0])
        if self.columns is None:
            self.columns = [np.zeros((0, *x.shape[1:]), x.dtype) for x in new]
        for i, x in enumerate(new):
            have = self.columns[i]
            if len(have) < self.used + n:
                grown = np.zeros((max(2 * len(have), self.used + n, 1024), *have.shape[1:]), have.dtype)
                grown[: self.used] = have[: self.used]
                self.columns[i] = have = grown
            have[self.used : self.used + n] = x
        self.used += n


#: What this worker keeps from batch to batch and task to task: the tables of one operator.
_TABLES: dict[tuple, object] = {}


def worker_table(key: tuple, make: Callable[[], object]):
    """The worker's table of this key. Tables of other operators or models are dropped first."""
    if key not in _TABLES:
        release_tables()
        _TABLES[key] = make()
    return _TABLES[key]


def release_tables() -> None:
    """Drop the worker's tables and give freed memory back: for operators that need the memory for something else."""
    _TABLES.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def split_slices(batch: pa.RecordBatch, text: int, limit: int = 2_000_000) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """Slices [lo, hi) of a batch with their words, document by document, and word counts."""
    data, offsets = string_buffer(batch.column(text))
    for lo, hi in slices(offsets, limit):
        raw = data[offsets[lo] : offsets[hi]].tobytes()
        at = (offsets[lo : hi + 1] - offsets[lo]).tolist()
        words: list[bytes] = []
        counts = np.zeros(hi - lo, np.int64)
        for i in range(hi - lo):
            own = raw[at[i] : at[i + 1]].split()  # ASCII white space of bytes: exactly [\x20\x09-\x0D]
            counts[i] = len(own)
            words += own
        yield lo, hi, words, counts


def sum_by_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values; works for empty runs and for rows of vectors."""
    zero = np.zeros((1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    total = np.concatenate([zero, np.cumsum(values, axis=0, dtype=zero.dtype)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
