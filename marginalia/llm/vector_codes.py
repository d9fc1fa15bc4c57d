"""Vector code compression: integer codebooks whose nearest entries are found by VA-file filtering.

A vector's components become integers, ``floor(scale * x)``, and are cut into ``parts``
consecutive parts (equal ones; where the length does not allow that, the first parts are one
longer). Each part position has a codebook of ``entries`` integer points: at first those of the
smallest vec_ids, then, ``rounds`` times, the componentwise floor of the mean of the parts
assigned to an entry (an entry without parts stays). A part is assigned to the nearest
entry, ties to the lower index.

Nearest entries by a VA-file: along each component the entries of a codebook fall into
``2 ** bits`` cells, and an entry is approximated by its cells. For a part, a table of
each component holds the squared distance to the nearest and to the farthest entry of
each cell; sums of table entries bound the distance of every codebook entry from below and
above. Only entries whose lower bound does not exceed the smallest upper bound are refined
with integer distances. All numbers are integers, so bounds and results are exact.

Each round is one scan: tasks send sums and counts of each entry (``parts * entries`` rows,
whatever the input), and the driver holds the codebooks only.

Left out are vectors that are null or hold null or non-finite components, and vectors of
another length than the one with the smallest vec_id. All others are coded: rows with
a null or repeated id (nulls come last, equal ids by vector) and equal rows too; with fewer
vectors than ``entries`` the codebooks are as short. Components beyond +-2^27 after scaling
count as that, since squared distances of larger ones fit no long. Extra columns of any name
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import quoted
from marginalia.plans.scratch import materialize

#: Largest absolute integer component.
MOST = 1 << 27
#: Vectors that are looked at together.
_AT_ONCE = 4096


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def to_integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Scaled components, rounded down."""
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part."""
    size, more = divmod(width, parts)
    ends = np.cumsum([size + (i < more) for i in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


class VAFile:
    """The entries of one codebook, with their cells."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries = entries
        n, width = entries.shape
        low = entries.min(axis=0, initial=0) if not n else entries.min(axis=0)
        span = np.maximum((entries.max(axis=0) - low if n else low) + 1, 1)
        self.cells = (entries - low) * (1 << bits) // span  # (entry, component)
        # the interval of the entries in each cell; an empty cell is never looked up
        self.first = np.zeros((1 << bits, width), np.int64)
        self.last = np.zeros((1 << bits, width), np.int64)
        for cell in range(1 << bits):
            inside = self.cells == cell
            self.first[cell] = np.where(inside, entries, 2 * MOST).min(axis=0, initial=2 * MOST)
            self.last[cell] = np.where(inside, entries, -2 * MOST).max(axis=0, initial=-2 * MOST)
        empty = self.first > self.last
        self.first[empty] = self.last[empty] = 0

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (part, entry) of squared distances, by lookup tables (part, cell, component)."""
        x = parts[:, None, :]
        below, above = self.first - x, x - self.last
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower = np.zeros((len(parts), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for c in range(parts.shape[1]):
            lower += least[:, self.cells[:, c], c]
            upper += most[:, self.cells[:, c], c]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry of each part, its squared distance, and how many entries were refined."""
        lower, upper = self.bounds(parts)
        part, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))  # by part, then entry
        exact = ((parts[part] - self.entries[entry]) ** 2).sum(axis=1)
        order = np.lexsort((entry, exact, part))
        first = order[np.flatnonzero(np.diff(part[order], prepend=-1))]
        return entry[first], exact[first], len(part)


class Codebooks:
    """The entries of all part positions."""

    def __init__(self, entries: list[np.ndarray], spans: list[tuple[int, int]], scale: float, bits: int):
        self.entries, self.spans, self.scale = entries, spans, scale
        self.files = [VAFile(e, bits) for e in entries]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Integer vectors, and the nearest entry and squared distance of each part (vector, part); entries refined."""
        whole = to_integers(vectors, self.scale)
        pick = np.zeros((len(whole), len(self.spans)), np.int64)
        error, refined = np.zeros_like(pick), 0
        for p, (lo, hi) in enumerate(self.spans):
            pick[:, p], error[:, p], n = self.files[p].nearest(whole[:, lo:hi])
            refined += n
        return whole, pick, error, refined

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and component."""
        numbers = (str(x) for e in self.entries for x in e.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _matrices(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices [lo, hi) of a column of vectors as matrices."""
    for lo in range(0, len(column), _AT_ONCE):
        part = column.slice(lo, _AT_ONCE)
        yield lo, lo + len(part), part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def _sums(vectors: DataFrame, width: int, shared) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> parts assigned to it, and their componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        many, spans = len(books.entries[0]), books.spans
        count = np.zeros((len(spans), many), np.int64)
        sums = [np.zeros((many, hi - lo), object) for lo, hi in spans]  # Python's integers: sums of any number of rows
        for batch in batches:
            for _, _, matrix in _matrices(batch.column(0), width):
                whole, pick, _, _ = books.assign(matrix)
                for p, (lo, hi) in enumerate(spans):
                    count[p] += np.bincount(pick[:, p], minlength=many)
                    order = np.argsort(pick[:, p], kind="stable")
                    used, begin = np.unique(pick[order, p], return_index=True)
                    sums[p][used] += np.add.reduceat(whole[order, lo:hi], begin, axis=0)
        used = [(p, e) for p in range(len(spans)) for e in np.flatnonzero(count[p]).tolist()]
        columns = [
            pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
            pa.array([int(count[x]) for x in used], pa.int64()), pa.array([[str(v) for v in sums[p][e]] for p, e in used], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    found = vectors.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    each = found.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "v"))
    total = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for row in sorted(total.collect(), key=lambda r: (r.part, r.entry, -1 if r.at is None else r.at)):  # one row for each component of the codebooks
        out.setdefault((row.part, row.entry), (row.n, []))[1].append(int(row.v or 0))
    return out


def fit_codebooks(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, bits: int = 3,
) -> Codebooks:
    """The codebooks after ``rounds`` rounds over all usable vectors."""
    kept = _kept(vectors, id_col, vector_col)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    width = len(seeds[0].embedding) if seeds else 0
    kept = kept.where(F.size("embedding") == width)
    if any(len(s.embedding) != width for s in seeds):
        seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = to_integers(np.array([s.embedding for s in seeds], np.float64).reshape(len(seeds), width), scale)
    spans = cuts(width, parts)
    books = Codebooks([start[:, lo:hi] for lo, hi in spans], spans, scale, bits)
    for _ in range(rounds if width and seeds else 0):
        shared = vectors.sparkSession.sparkContext.broadcast(books)
        new = [e.copy() for e in books.entries]
        for (p, e), (n, sums) in _sums(kept, width, shared).items():
            new[p][e] = [s // n for s in sums]
        shared.unpersist()
        settled = all(np.array_equal(a, b) for a, b in zip(new, books.entries, strict=True))
        books = Codebooks(new, spans, scale, bits)
        if settled:  # further rounds would change nothing
            break
    return books


def _kept(vectors: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    picked = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).alias("embedding"), *more)
    return picked.where(usable(F.col("embedding")))


def encode_vectors(
    vectors: DataFrame, books: Codebooks, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(vec_id, label, entries, error, refined)`` of every usable row: entry of each part, summed squared distances."""
    kind = vectors.select(quoted(label_col)).schema[0].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    width = books.spans[-1][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lo, hi, matrix in _matrices(batch.column(1), width):
                _, pick, error, refined = known.assign(matrix)
                codes = pa.ListArray.from_arrays(np.arange(0, pick.size + 1, pick.shape[1], dtype=np.int32), pa.array(pick.ravel().astype(np.int32)))
                each = pa.array(np.full(hi - lo, refined / (hi - lo)))
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), codes, pa.array(error.sum(axis=1)), each]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "entries", "error", "refined"])

    kept = _kept(vectors, id_col, vector_col, quoted(label_col).alias("label")).where(F.size("embedding") == width)
    return kept.select("vec_id", "embedding", "label").mapInArrow(run, f"vec_id long, label {kind}, entries array<int>, error long, refined double")


def compress_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every usable row.

    ``code``: two hex digits a part; ``label_error``: the errors of all rows with that label, summed.
    """
    books = fit_codebooks(vectors, id_col=id_col, vector_col=vector_col, **options)
    coded = encode_vectors(vectors, books, id_col=id_col, vector_col=vector_col, label_col=label_col)
    hexed = F.array_join(F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    coded = materialize(coded.select("vec_id", "label", hexed.alias("code"), "error"))
    # written, so that the planner knows its size and broadcasts it while that is small
    total = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    joined = coded.join(total, coded["label"].eqNullSafe(total["label"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
