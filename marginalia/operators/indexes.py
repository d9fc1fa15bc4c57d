"""Stored indexes: a text index pruned by impacts, a vector index pruned by angles.

An index is a folder of Parquet tables, written once by ``ensure_...`` under a name; another
call with that name finds it and writes nothing. It is built beside its place and
renamed at the end, so a build that fails leaves no half index. Searches are joins over
those tables and give exactly what a scan of the whole corpus gives.

Both indexes can be restricted to some rows by a condition on the stored filter columns, which
reaches the scan. As with any filtered search, term statistics are those of the whole corpus.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.operators.retrieval import DIGITS, TermBlock, best_cells, counted, query_names, slices, term_blocks, tokens_in, top_k
from marginalia.plans.scratch import materialize

#: Scores are rounded to ``DIGITS``; bounds are compared with this much room.
_ROOM = 10.0**-DIGITS


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, folder: str) -> bool:
    files, path = _files(spark, folder)
    return files.exists(path)


def _publish(spark: SparkSession, built: str, place: str) -> bool:
    """Move a finished index to its place; False if another build was first."""
    files, path = _files(spark, built)
    _, target = _files(spark, place)
    files.mkdirs(target.getParent())
    done = not files.exists(target) and files.rename(path, target)
    if not done:
        files.delete(path, True)
    return bool(done)


def _definition(spark: SparkSession, place: str) -> dict:
    return json.loads(spark.read.text(f"{place}/definition").first()[0])


def _define(spark: SparkSession, place: str, **parts) -> None:
    spark.createDataFrame([(json.dumps(parts, sort_keys=True),)], "value string").coalesce(1).write.text(f"{place}/definition")


# --- text -------------------------------------------------------------------------------


_TERMS = "term string, df long, bucket int"
_BLOCKS = "term string, span long, top double, at array<int>, impacts array<double>"
#: Bytes of text of which a task makes blocks at a time, in whole spans.
_RUN_BYTES = 1 << 22


@dataclass(frozen=True)
class TextIndex:
    """``terms(term, df)``, ``blocks(term, span, top, at, impacts)``, ``docs(id, span, at, filter columns)``.

    A document is the one at place ``at`` of its span.
    """

    terms: DataFrame
    blocks: DataFrame
    docs: DataFrame
    n: int
    n_buckets: int

    @classmethod
    def open(cls, spark: SparkSession, place: str) -> TextIndex:
        known = _definition(spark, place)
        schemas = {"terms": _TERMS, "blocks": _BLOCKS, "docs": StructType.fromJson(known["docs"])}
        tables = (spark.read.schema(s).parquet(f"{place}/{t}") for t, s in schemas.items())
        return cls(*tables, known["n"], known["n_buckets"])


def _lengths(texts: DataFrame) -> tuple[int, float]:
    """Number of texts and their mean length in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([len(tokens_in(part.column(0))[0])])], ["n", "length"])

    n, length = texts.select("text").mapInArrow(run, "n long, length long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return n, length / n if n else 0.0


def _whole_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of some spans of ``(span, at, text)`` at a time; spans lie one after another."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        span = table.column(0).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(span)) + 1])
        held = table.slice(int(starts[-1]))  # its other rows may follow
        n_bytes = pc.fill_null(pc.binary_length(table.column(2)), 0).to_numpy()
        run = (np.cumsum(n_bytes, dtype=np.int64) // _RUN_BYTES)[starts] if len(span) else starts
        cuts = [0, *starts[np.flatnonzero(np.diff(run)) + 1].tolist(), int(starts[-1])]
        for lo, hi in itertools.pairwise(cuts):
            if lo < hi:
                yield table.slice(lo, hi - lo)
    if held is not None and held.num_rows:
        yield held


def _blocks(placed: DataFrame, avg_length: float, k1: float, b: float) -> DataFrame:
    """The blocks of ``placed(span, at, text)``, made where the spans lie: postings are neither rows nor shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_spans(batches):
            span, at = table.column(0).to_numpy(), table.column(1).to_numpy()
            text, terms, code = tokens_in(table.column(2).combine_chunks())
            if not len(code):
                continue
            length = np.bincount(text, minlength=len(span))
            text, code, tf = counted(text, code, len(terms))
            impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[text] / (avg_length or 1.0)))
            by_name = pc.sort_indices(terms).to_numpy()
            place = np.empty(len(terms), np.int64)
            place[by_name] = np.arange(len(terms))
            order = np.lexsort((at[text], span[text], place[code]))
            text, code, impact = text[order], code[order], impact[order]
            first = np.concatenate([[0], np.flatnonzero((np.diff(code) != 0) | (np.diff(span[text]) != 0)) + 1])
            offsets = pa.array(np.append(first, len(code)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(at[text].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(impact))]
            columns = [terms.take(pa.array(code[first])), pa.array(span[text[first]]), pa.array(np.maximum.reduceat(impact, first)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["term", "span", "top", "at", "impacts"])

    return placed.select("span", "at", "text").mapInArrow(run, _BLOCKS)


def ensure_text_index(
    corpus: DataFrame, folder: str, name: str, *, filters: tuple[str, ...] = (), near: tuple[str, ...] = (),
    k1: float = 1.5, b: float = 0.75, span_rows: int = 128, n_buckets: int = 64,
) -> tuple[TextIndex, bool]:
    """The text index of this name over ``corpus(id, text, near and filter columns)``, and whether this call made it.

    Documents lie in spans of at most ``span_rows``, in the order of the ``near`` columns, then
    ids: the more alike the documents of a span, the more spans a search can leave out. A
    posting holds the part of a document's score that does not depend on the query (its impact).
    Postings of a term and span are a block with its largest impact; blocks of a run of spans lie
    together in the order of their terms, so that a scan for some terms skips pages. Where two tasks
    read parts of one span, each makes blocks of its part: bounds are then sums of both, so they still hold.
    No block grows with the corpus. Document frequencies lie in files by a hash of the term.
    """
    spark, place = corpus.sparkSession, f"{folder.rstrip('/')}/{name}"
    if _exists(spark, place):
        return TextIndex.open(spark, place), False
    built = f"{place}.{uuid.uuid4().hex}"
    order = [*near, "id"]
    kept = corpus.select("id", F.col("text").cast("string").alias("text"), *dict.fromkeys(c for c in (*near, *filters) if c != "id"))
    placed = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    inside = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    span = F.shiftright("row", 33) * F.lit(1 << 33) + F.floor(inside / span_rows)
    placed = materialize(placed.withColumn("span", span).withColumn("at", (inside % span_rows).cast("int")).drop("row"))
    n, avg_length = _lengths(placed)
    docs = placed.select("id", "span", "at", *filters)
    docs.write.parquet(f"{built}/docs")
    _blocks(placed, avg_length, k1, b).write.parquet(f"{built}/blocks")
    stored = spark.read.schema(_BLOCKS).parquet(f"{built}/blocks")
    bucket = F.pmod(F.xxhash64("term"), F.lit(n_buckets)).cast("int").alias("bucket")
    terms = stored.groupBy("term").agg(F.sum(F.size("at")).alias("df")).select("term", "df", bucket)
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{built}/terms")
    _define(spark, built, kind="text", n=n, n_buckets=n_buckets, k1=k1, b=b, near=list(near), docs=docs.schema.jsonValue())
    made = _publish(spark, built, place)
    return TextIndex.open(spark, place), made


#: Spans that a task of a search looks at together.
_SPANS_A_TASK = 512


@dataclass(frozen=True)
class TextSearch:
    """``result(query_id, id, score, rank)``, and how many blocks the queries' terms have and how many were opened."""

    result: DataFrame
    blocks: int
    opened: int


def search_text(index: TextIndex, queries: DataFrame, k: int = 8, *, where: Column | None = None, probe: int = 2, max_queries: int = 1024, matrix_bytes: int = 64_000_000) -> TextSearch:
    """The ``k`` best BM25 scores of each query, equal to a scan's, by the largest impacts of blocks.

    1. The largest impacts of a span, weighted by the query, bound the scores of its documents. Of each
       query the ``probe`` spans with the largest bounds are scored; its k-th best score there is
       a floor. Only the heads of the blocks are read for the bounds.
    2. Spans whose bound stays under the floors of all queries are never opened, and queries
       whose floor a span cannot reach are not scored there.

    ``where`` is a condition on the filter columns; spans without such a document are left out.
    Queries are dealt to blocks as in ``retrieval.bm25``.
    """
    spark = queries.sparkSession
    parts, blocks, opened = [], 0, 0
    for asked in term_blocks(queries, max_queries, matrix_bytes):
        found, seen, read = _search_block(index, queries, asked, k, where, probe)
        parts.append(materialize(found))
        blocks, opened = blocks + seen, opened + read
    if not parts:
        kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((index.docs, "id"), (queries, "query_id"))}
        parts = [spark.createDataFrame([], f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank int")]
    return TextSearch(reduce(DataFrame.unionByName, parts), blocks, opened)


def _search_block(index: TextIndex, queries: DataFrame, asked: TermBlock, k: int, where: Column | None, probe: int) -> tuple[DataFrame, int, int]:
    spark = queries.sparkSession
    names = list(asked.terms)
    buckets = spark.createDataFrame([(t,) for t in names], "term string").select(F.pmod(F.xxhash64("term"), F.lit(index.n_buckets)).alias("b")).distinct()
    # terms and buckets are as many as one matrix has rows: they go to the scans as they are
    wanted = F.col("term").isin(names)
    df = np.zeros(len(names))
    for row in index.terms.where(F.col("bucket").isin([r.b for r in buckets.collect()]) & wanted).select("term", "df").collect():
        df[asked.terms[row.term]] = row.df
    weights = asked.matrix * np.log(1.0 + (index.n - df + 0.5) / (df + 0.5))[:, None]
    shared = spark.sparkContext.broadcast((pa.array(names, pa.string()), weights))  # the terms are in the order of their rows
    ids = query_names(queries, asked.names)
    blocks = index.blocks.where(wanted)
    docs = index.docs if where is None else index.docs.where(where)
    heads = blocks.select("span", "term", "top")
    if where is not None:
        heads = heads.join(docs.select("span").distinct(), "span", "left_semi")
    heads = materialize(heads)
    n_heads = heads.count()
    n_tasks = max(1, -(-index.n // (128 * _SPANS_A_TASK)), spark.sparkContext.defaultParallelism)
    group = F.pmod(F.xxhash64("span"), F.lit(n_tasks)).alias("grp")

    def bounds(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Spans of heads and the bounds of all queries there."""
        terms, weights = shared.value
        span = table.column("span").to_numpy()
        order = np.argsort(span, kind="stable")
        term, top = pc.index_in(table.column("term"), value_set=terms).to_numpy(), table.column("top").to_numpy()
        for at in np.split(order, np.flatnonzero(np.diff(span[order])) + 1):
            if len(at):
                yield int(span[at[0]]), top[at] @ weights[term[at]]

    def best_spans(table: pa.Table) -> pa.Table:
        found = list(bounds(table))
        if not found:
            return pa.table({"q": pa.array([], pa.int32()), "span": pa.array([], pa.int64()), "bound": pa.array([], pa.float64())})
        bound = np.stack([b for _, b in found])
        row, q = best_cells(bound, probe)
        return pa.table({"q": pa.array(q.astype(np.int32)), "span": pa.array([found[i][0] for i in row], pa.int64()), "bound": pa.array(bound[row, q])})

    def reached(floor: np.ndarray):
        def run(table: pa.Table) -> pa.Table:
            found = [(s, np.flatnonzero((b > 0) & (b >= floor)).astype(np.int32)) for s, b in bounds(table)]
            found = [(s, q) for s, q in found if len(q)]
            return pa.table({"span": pa.array([s for s, _ in found], pa.int64()), "qs": pa.array([q for _, q in found], pa.list_(pa.int32()))})

        return run

    kinds = {c: f.schema[c].dataType for f, c in ((docs, "id"), (queries, "query_id"))}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one span in a row a batch, terms by their numbers."""
        for batch in batches:
            span, lists = batch.column(0).to_numpy(), batch.column(2)
            if not len(span):
                continue
            order = pa.array(np.argsort(span, kind="stable"))
            span, lists, impacts = span[order.to_numpy()], lists.take(order), batch.column(3).take(order)
            n = lists.value_lengths().to_numpy()
            slot = pc.index_in(batch.column(1), value_set=shared.value[0]).take(order).to_numpy()
            first = np.concatenate([[0], np.flatnonzero(np.diff(span)) + 1])
            offsets = pa.array(np.append(np.concatenate([[0], np.cumsum(n)])[first], n.sum()).astype(np.int32))
            values = (pa.array(np.repeat(slot, n).astype(np.int32)), lists.flatten(), impacts.flatten())
            yield pa.RecordBatch.from_arrays([pa.array(span[first]), *(pa.ListArray.from_arrays(offsets, v) for v in values)], ["span", "slots", "at", "impacts"])

    def scores(spans: DataFrame) -> DataFrame:
        """The best rows of ``spans(span, qs)`` for the queries ``qs`` of each: (query_id, id, score)."""
        some = spans.select("span")
        members = docs.join(some, "span", "left_semi").groupBy("span").agg(F.collect_list(F.struct("at", "id")).alias("members"))  # a span is bounded
        packed = blocks.select("span", "term", "at", "impacts").join(some, "span", "left_semi").select("span", "term", "at", "impacts").mapInArrow(pack, "span long, slots array<int>, at array<int>, impacts array<double>")
        spread = packed.groupBy("span").agg(F.collect_list(F.struct("slots", "at", "impacts")).alias("held"))
        joined = spans.join(spread, "span").join(members, "span").select("qs", "held", "members")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = shared.value[1]
            for batch in batches:
                for i in range(batch.num_rows):
                    qs, held, inside = (c[i].values for c in batch.columns)
                    qs, places = qs.to_numpy(zero_copy_only=False), inside.field("at").to_numpy()
                    at, term = held.field("at").flatten().to_numpy(), held.field("slots").flatten().to_numpy()
                    used, column = np.unique(term, return_inverse=True)
                    impact = np.zeros((max(int(at.max()), int(places.max())) + 1, len(used)))
                    impact[at, column] = held.field("impacts").flatten().to_numpy()
                    score = np.round(impact[places] @ weights[np.ix_(used, qs)], DIGITS)  # places that are not admitted are left out
                    row, q = best_cells(score, k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(qs[q])), inside.field("id").take(pa.array(row)), pa.array(score[row, q])], ["query_id", "id", "score"])

        return joined.mapInArrow(run, f"query_id {kinds['query_id'].simpleString()}, id {kinds['id'].simpleString()}, score double")

    first = heads.select(group, "span", "term", "top").groupBy("grp").applyInArrow(best_spans, "q int, span long, bound double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "span"))
    first = first.withColumn("n", place).where(F.col("n") <= probe).groupBy("span").agg(F.collect_list("q").alias("qs"))
    first = materialize(first)
    near = materialize(top_k(scores(first), k))
    floor = np.full(len(asked.names), 0.0)
    number = {name: i for i, name in enumerate(asked.names)}
    for row in near.where(F.col("rank") == k).collect():  # a row a query
        floor[number[row.query_id]] = row.score - _ROOM
    rest = heads.select(group, "span", "term", "top").groupBy("grp").applyInArrow(reached(floor), "span long, qs array<int>")
    done = first.withColumnRenamed("qs", "done")
    rest = rest.join(done, "span", "left").select("span", F.when(F.col("done").isNull(), F.col("qs")).otherwise(F.array_except("qs", "done")).alias("qs"))
    rest = materialize(rest.where(F.size("qs") > 0))
    opened = heads.join(first.select("span").unionByName(rest.select("span")).distinct(), "span", "left_semi").count()
    return top_k(near.drop("rank").unionByName(scores(rest)), k), n_heads, opened


# --- vectors ----------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """``rows(id, unit, angle, filter columns, cell)`` by cell, and the unit centres of the cells."""

    rows: DataFrame
    centres: np.ndarray
    reach: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, place: str) -> VectorIndex:
        known = _definition(spark, place)
        rows, reach = (spark.read.schema(StructType.fromJson(known[t])).parquet(f"{place}/{t}") for t in ("rows", "reach"))
        stored = spark.read.schema("cell int, centre array<double>").parquet(f"{place}/centres")  # a row a cell
        return cls(rows, np.array([r.centre for r in stored.orderBy("cell").collect()], float), reach)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _centres(sample: np.ndarray, n_cells: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means over a sample of unit vectors."""
    chosen = np.random.default_rng(seed).permutation(len(sample))[:n_cells]
    centres = sample[chosen]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        centres = np.where(some[:, None], _unit(sums), centres)
    return centres


def ensure_vector_index(
    vectors: DataFrame, folder: str, name: str, *, filters: tuple[str, ...] = (),
    n_cells: int | None = None, sample_rows: int = 16_384, rounds: int = 8, seed: int = 5,
) -> tuple[VectorIndex, bool]:
    """The vector index of this name over ``vectors(id, vector, filter columns)``, and whether this call made it.

    Every vector of positive length lies in the cell of its nearest centre, sorted by its angle to
    the centre; centres come from at most ``sample_rows`` rows (smallest hashes of the id). There
    are about as many cells as the root of the rows, 4,096 at most. All vectors must have one
    length. ``reach`` holds for each cell and set of filter columns the smallest and the largest angle.
    """
    spark, place = vectors.sparkSession, f"{folder.rstrip('/')}/{name}"
    if _exists(spark, place):
        return VectorIndex.open(spark, place), False
    built = f"{place}.{uuid.uuid4().hex}"
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *filters)
    kept = kept.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (length > 0))
    n = kept.count()
    cells = n_cells or int(min(4096, max(1, round(n**0.5))))
    sample = kept.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    width = len(sample[0].vector) if sample else 0
    centres = _centres(_unit(np.array([r.vector for r in sample], float).reshape(len(sample), width)), cells, rounds, seed) if sample else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                unit = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width))
                cosine = unit @ shared.value.T
                cell = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
                held = pa.ListArray.from_arrays(np.arange(0, unit.size + 1, width, dtype=np.int32), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), held, *part.columns[2:], pa.array(angle), pa.array(cell.astype(np.int32))], ["id", "unit", *filters, "angle", "cell"])

    kinds = "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in filters)
    placed = kept.mapInArrow(run, f"id long, unit array<double>{kinds}, angle double, cell int")
    # a cell that is much fuller than others is dealt by id as well
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // max(cells, 1) // 65_536))))).sortWithinPartitions("cell", "angle")
    dealt.write.partitionBy("cell").parquet(f"{built}/rows")
    rows = spark.read.schema(f"id long, unit array<double>{kinds}, angle double, cell int").parquet(f"{built}/rows")
    reach = rows.groupBy("cell", *filters).agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count(F.lit(1)).alias("n"))
    reach.write.parquet(f"{built}/reach")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{built}/centres")
    _define(spark, built, kind="vector", n=n, cells=cells, rows=rows.schema.jsonValue(), reach=reach.schema.jsonValue())
    made = _publish(spark, built, place)
    return VectorIndex.open(spark, place), made


@dataclass(frozen=True)
class VectorSearch:
    """``result(query_id, id, score, rank)``, and how many cells there are and were read."""

    result: DataFrame
    cells: int
    read: int


def _scan(rows: DataFrame, names: np.ndarray, matrix: np.ndarray, wanted: dict[int, np.ndarray], k: int) -> DataFrame:
    """The best ``k`` rows of each query among those of the cells that it wants: (query_id, id, score)."""
    shared = rows.sparkSession.sparkContext.broadcast((names, matrix, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, wanted = shared.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            for at in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
                if not len(at):
                    continue
                asked = wanted.get(int(cell[at[0]]), np.empty(0, np.int64))
                step = max(1, (1 << 21) // max(len(asked), 1))
                for lo in range(0, len(at), step):
                    part = batch.slice(int(at[lo]), min(step, len(at) - lo))
                    unit = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    score = np.round(matrix[asked] @ unit.T, DIGITS)
                    least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else np.full((len(asked), 1), -2.0)
                    q, row = np.nonzero(score >= least)  # ties at the cut stay: ids decide later
                    yield pa.RecordBatch.from_arrays([pa.array(names[asked[q]]), part.column(0).take(pa.array(row)), pa.array(score[q, row])], ["query_id", "id", "score"])

    picked = rows.where(F.col("cell").isin(sorted(wanted))).select("id", "unit", "cell")
    return picked.mapInArrow(run, "query_id long, id long, score double")


def search_vectors(index: VectorIndex, queries: DataFrame, k: int = 8, *, where: Column | None = None, probe: int = 4, max_queries: int = 4096) -> VectorSearch:
    """The ``k`` largest cosines of each of ``queries(query_id, vector)``, equal to a scan's.

    A vector at an angle of a to its centre, seen from a query at an angle of b to that centre, is at
    least ``|a - b|`` away from the query. Each query reads the ``probe`` cells of least such angle first; its
    k-th best cosine there rules out every cell, and within a cell every range of angles, that
    cannot hold a larger one. Cells without a row that ``where`` admits are never read. More than
    ``max_queries`` queries are dealt to blocks, of which the driver holds one at a time.
    """
    reach = index.reach if where is None else index.reach.where(where)
    spans = reach.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("cell").collect()  # a row a cell
    cells = np.array([r.cell for r in spans], np.int64)
    least, most = np.array([r.least for r in spans]), np.array([r.most for r in spans])
    rows = index.rows if where is None else index.rows.where(where)
    asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).where("vector is not null")
    parts, read = [], set()
    for block in batched(asked.toLocalIterator(), max_queries):
        names, matrix = np.array([r.query_id for r in block], np.int64), _unit(np.array([r.vector for r in block], float))
        if not len(cells):
            continue
        angle = np.arccos(np.clip(matrix @ index.centres[cells].T, -1, 1))  # (query, cell)
        away = np.maximum(np.maximum(least - angle, angle - most), 0)
        first = np.argsort(away + 1e-9 * angle, axis=1, kind="stable")[:, :probe]
        probed = {int(cells[c]): np.flatnonzero((first == c).any(axis=1)) for c in np.unique(first)}
        near = materialize(_scan(rows, names, matrix, probed, k))
        kth = {r.query_id: r.score for r in top_k(near, k).where(F.col("rank") == k).select("query_id", "score").collect()}  # a row a query
        floor = np.array([kth.get(int(q), -2.0) for q in names]) - _ROOM
        open_ = np.cos(np.minimum(away, np.pi)) >= floor[:, None]
        np.put_along_axis(open_, first, False, axis=1)
        rest = {int(cells[c]): np.flatnonzero(open_[:, c]) for c in np.flatnonzero(open_.any(axis=0))}
        read |= set(probed) | set(rest)
        # of each cell only angles that some query may still reach
        width = np.arccos(np.clip(floor, -1, 1))
        ranges = []
        at = {int(c): i for i, c in enumerate(cells)}
        for cell, who in rest.items():
            mine = angle[who, at[cell]]
            ranges.append((cell, float((mine - width[who]).min()) - 1e-9, float((mine + width[who]).max()) + 1e-9))
        if ranges:
            limits = F.broadcast(rows.sparkSession.createDataFrame(ranges, "cell int, low double, high double"))  # a row a cell
            close = rows.join(limits, "cell").where((F.col("angle") >= F.col("low")) & (F.col("angle") <= F.col("high")))
            near = near.unionByName(_scan(close, names, matrix, rest, k))
        parts.append(materialize(top_k(near, k).drop("rank")))
    if not parts:
        parts = [rows.sparkSession.createDataFrame([], "query_id long, id long, score double")]
    return VectorSearch(top_k(reduce(DataFrame.unionByName, parts), k), len(cells), len(read))
