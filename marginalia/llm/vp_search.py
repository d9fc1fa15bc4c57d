"""Approximate nearest neighbours with vantage-point trees, one tree a shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash of id and vector. A shard's
tree is built once, in the task that searches it: a node keeps a vantage point and the
median distance of its vectors, leaves keep vectors. Equal vectors of a shard are one point
with many ids, so a vector that a third of all rows share costs one distance.

Shards come in groups that a task can hold (``group_bytes``); every group meets all
queries. A task sorts its rows so that a group's vectors come before its queries, builds
the trees, and then streams the queries through them in blocks of ``block_rows``: a block
walks each tree as a whole, nearer side first, and takes its nearest points so far from one
tree to the next. A subtree is skipped for a query when |distance to the vantage point -
median| > factor * (distance to the k-th best so far); the triangle inequality makes that
exact for factor 1, smaller factors skip more. The best of every group are merged by
distance, then id.

Distances are Euclidean, in double precision, summed in the order of the components, in
the walk too: so ties are ties, and go to the smaller id wherever the points lie (points
are held by distance, then smallest id; a subtree at exactly the bound is walked).
Vectors that are null, zero, or hold a null or non-finite component take no part;
vectors of different lengths are never compared. A query's own row is no candidate,
other rows with the same vector are. Rows with a repeated id are each candidates of
the other ids; a query id that repeats is searched with its smallest vector. Empty tables
give no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.words import quoted

LEAF = 128
_SLACK = 1e-9
_NONE = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def distances(queries: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Of each query to each point, whose components are the rows of ``columns``; added one after another."""
    total = np.zeros((len(queries), columns.shape[1]))
    for j in range(len(columns)):
        step = queries[:, j, None] - columns[j]
        step *= step
        total += step
    return np.sqrt(total, out=total)


class Best:
    """The nearest points so far of a block of queries, by distance, then smallest id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries = queries.astype(np.float64)
        self.distance = np.full((len(queries), k), np.inf)
        self.least = np.full((len(queries), k), _NONE)
        self.place = np.full((len(queries), k), -1)

    def offer(self, of: np.ndarray, distance: np.ndarray, least: np.ndarray, place: np.ndarray) -> None:
        k = self.distance.shape[1]
        near = np.flatnonzero((distance <= self.distance[of, -1:]).any(axis=1))
        if not len(near):
            return
        of, distance = of[near], distance[near]
        every = np.concatenate([self.distance[of], distance], axis=1)
        ids = np.concatenate([self.least[of], np.broadcast_to(least, distance.shape)], axis=1)
        places = np.concatenate([self.place[of], np.broadcast_to(place, distance.shape)], axis=1)
        order = np.lexsort((ids, every), axis=1)[:, :k]
        self.distance[of], self.least[of], self.place[of] = (np.take_along_axis(x, order, 1) for x in (every, ids, places))


class VPTree:
    """A vantage-point tree over distinct vectors, each with the ids that have it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + 0.0  # no negative zeros: equal vectors have equal bytes
        raw = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, owner = np.unique(raw, return_index=True, return_inverse=True)
        points = vectors[first].astype(np.float64)
        #: Nodes: (vantage point, median, left, right) or (None, begin, end of its points) for a leaf.
        self.nodes: list[tuple] = []
        self.measured = 0
        layout: list[np.ndarray] = []
        self._build(points, np.arange(len(first)), np.random.default_rng(seed), layout)
        layout_of = np.concatenate(layout) if layout else np.empty(0, np.int64)
        self.columns = np.ascontiguousarray(points[layout_of].T)
        rank = np.empty(len(first), np.int64)
        rank[layout_of] = np.arange(len(first))
        owner = rank[owner]
        by_owner = np.argsort(owner, kind="stable")  # ids stay ascending within a point
        self.ids = ids[by_owner]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))])
        self.least = self.ids[self.begin[:-1]] if len(first) else np.empty(0, np.int64)

    def _build(self, points: np.ndarray, members: np.ndarray, rng, layout: list[np.ndarray]) -> int:
        """Lays the points out in the order of the walk; a node's vantage point comes before its subtrees."""
        at, begin = len(self.nodes), sum(map(len, layout))
        self.nodes.append((None, begin, begin + len(members)))
        if len(members) <= LEAF:
            layout.append(members)
            return at
        vantage = int(members[rng.integers(len(members))])
        rest = members[members != vantage]
        layout.append(np.array([vantage]))
        distance = distances(points[vantage : vantage + 1], np.ascontiguousarray(points[rest].T))[0]
        half = np.argsort(distance, kind="stable")
        middle = len(rest) // 2
        radius = float(distance[half[middle]])
        left = self._build(points, rest[half[:middle]], rng, layout)
        right = self._build(points, rest[half[middle:]], rng, layout)
        self.nodes[at] = (begin, radius, left, right)
        return at

    def search(self, best: Best, factor: float, number: int = 0) -> None:
        """Offer the points of this tree; their places are (number, point) in one integer."""
        self._best, self._factor, self._number = best, factor, number << 32
        self._walk(0, np.arange(len(best.queries)))

    def _measure(self, of: np.ndarray, begin: int, end: int) -> np.ndarray:
        distance = distances(self._best.queries[of], self.columns[:, begin:end])
        self.measured += distance.size
        self._best.offer(of, distance, self.least[begin:end], self._number + np.arange(begin, end))
        return distance

    def _walk(self, at: int, of: np.ndarray) -> None:
        node = self.nodes[at]
        if node[0] is None:
            if node[2] > node[1]:
                self._measure(of, node[1], node[2])
            return
        vantage, radius, left, right = node
        gap = self._measure(of, vantage, vantage + 1)[:, 0] - radius
        inside = gap < 0
        for first, second, here in ((left, right, inside), (right, left, ~inside)):
            if here.any():
                own = of[here]
                self._walk(first, own)
                still = np.abs(gap[here]) <= self._factor * self._best.distance[own, -1] * (1 + _SLACK) + _SLACK
                if still.any():
                    self._walk(second, own[still])


def search_block(trees: list[VPTree], ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of the ``k`` nearest rows of each query, its own left out."""
    best = Best(queries, k + 1)  # one more for the query itself
    for number, tree in enumerate(trees):
        tree.search(best, factor, number)
    parts = []
    for number, tree in enumerate(trees):
        of, slot = np.nonzero((best.place >> 32 == number) & (best.place >= 0))
        point = best.place[of, slot] & 0xFFFFFFFF
        take = np.minimum(tree.begin[point + 1] - tree.begin[point], k + 1)  # the smallest ids of a point suffice
        ends = np.cumsum(take)
        each = np.repeat(np.arange(len(of)), take)
        found = tree.ids[tree.begin[point][each] + np.arange(len(each)) - (ends - take)[each]]
        parts.append((of[each], found, best.distance[of, slot][each]))
    of, found, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    other = ids[of] != found
    of, found, score = of[other], found[other], score[other]
    order = np.lexsort((found, score, of))
    of, found, score = of[order], found[order], score[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    top = rank < k
    return ids[of[top]], found[top], score[top]


def _vectors(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    part = batch.slice(lo, hi - lo)
    return part.column("id").to_numpy(zero_copy_only=False), part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)


def _search(k: int, factor: float, block_rows: int):
    """Rows sorted by (dim, grp, kind, shard): the vectors of a group by shard, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shard = None
        trees: list[VPTree] = []
        rows: list[tuple] = []
        asked: list[tuple] = []

        def plant() -> None:
            if rows:
                trees.append(VPTree(*(np.concatenate(x) for x in zip(*rows, strict=True))))
                rows.clear()

        def answer() -> Iterator[pa.RecordBatch]:
            if asked:
                ids, vectors = (np.concatenate(x) for x in zip(*asked, strict=True))
                asked.clear()
                for at in range(0, len(ids), block_rows):
                    found = search_block(trees, ids[at : at + block_rows], vectors[at : at + block_rows], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "grp", "kind", "shard")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi == lo:
                    continue
                dim, grp, kind, number = keys[lo]
                if (dim, grp) != group:
                    yield from answer()
                    group, shard, trees = (dim, grp), None, []
                    rows.clear()
                if kind == 0:
                    if number != shard:
                        plant()
                        shard = number
                    rows.append(_vectors(batch, lo, hi))
                    continue
                plant()
                asked.append(_vectors(batch, lo, hi))
                if sum(len(a[0]) for a in asked) >= block_rows:
                    yield from answer()
        yield from answer()

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 0.5, *,
    id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 2048, group_bytes: int = 128_000_000,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query row."""
    spark = vectors.sparkSession
    same = vectors.schema[vector_col].dataType == queries.schema[vector_col].dataType

    def usable_rows(df: DataFrame) -> DataFrame:
        vector = quoted(vector_col) if same else quoted(vector_col).cast("array<double>")
        kept = df.select(quoted(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
        return kept.withColumn("dim", F.size("vector"))

    rows, asked = usable_rows(vectors), usable_rows(queries)
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    n_shards = max(1, -(-seen.n // shard_rows))
    held = max(1, group_bytes // (shard_rows * seen.dim * 8))  # shards that a task holds
    n_groups = min(n_shards, max(-(-n_shards // held), spark.sparkContext.defaultParallelism))
    shard = F.pmod(F.xxhash64("id", "vector"), F.lit(n_shards)).cast("int")
    dealt = rows.withColumn("shard", shard).withColumn("grp", F.col("shard") % n_groups).withColumn("kind", F.lit(0))
    every = asked.withColumn("shard", F.lit(0)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).withColumn("kind", F.lit(1))
    columns = ["dim", "grp", "kind", "shard", "id", "vector"]
    both = dealt.select(*columns).unionByName(every.select(*columns)).repartition(n_groups, "dim", "grp").sortWithinPartitions("dim", "grp", "kind", "shard")
    found = both.mapInArrow(_search(k, factor, block_rows), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
