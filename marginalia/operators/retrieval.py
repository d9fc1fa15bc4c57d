"""Lexical and dense ranking: BM25, trigram and vector cosine.

A corpus is (id, text), queries are (query_id, text); results are
(query_id, id, score, rank). Scores are rounded to ``digits`` before ranking, so equal
texts tie and ties go to the smaller id wherever the sums were added up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from marginalia.functions.numbers import idf
from marginalia.functions.text import tokens, trigrams
from marginalia.plans.scratch import materialize

DIGITS = 6
CELLS = 1 << 20  # of a matrix of queries by rows at a time
_NOT_TOKEN = re.compile("[^a-z0-9]+")
_TOKEN = re.compile("[a-z0-9]+")
_IN_TOKEN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def top_k(scored: DataFrame, k: int | None, by: str = "query_id") -> DataFrame:
    """Rank by score, then id; the rank filter also prunes before the shuffle."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def postings(corpus: DataFrame) -> DataFrame:
    """(id, length, term, tf): the inverted index as rows (1.15)."""
    split = corpus.select("id", tokens(F.coalesce("text", F.lit(""))).alias("t")).select("id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return split.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: number of texts and mean length in tokens."""
    return corpus.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.coalesce("text", F.lit(""))))).alias("avg_length"))


def tokens_of(text: str | None) -> list[str]:
    """The tokens of one text, as ``functions.text.tokens`` splits them off."""
    return _TOKEN.findall((text or "").lower())


def tokens_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All tokens of many texts, text by text: (place of its text, distinct tokens, place of the token among those)."""
    parts = [(t or "").lower().encode() for t in texts.to_pylist()]
    raw = np.frombuffer(b"\n".join([b"", *parts, b""]), np.uint8)
    inside = _IN_TOKEN[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64))
    return np.searchsorted(ends, start, side="left"), found.dictionary, found.indices.to_numpy()


def counted(texts: np.ndarray, keys: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, how often) of every pair that there is, text by text."""
    pairs, n = np.unique(texts * np.int64(max(n_keys, 1)) + keys, return_counts=True)
    return pairs // max(n_keys, 1), pairs % max(n_keys, 1), n


@dataclass(frozen=True)
class TermBlock:
    """Some queries as a matrix of terms by queries; a query's terms count once."""

    names: list
    terms: dict[str, int]
    matrix: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[Row]) -> TermBlock:
        bags = [set(tokens_of(r.text)) for r in rows]
        terms = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
        matrix = np.zeros((len(terms), len(rows)))
        for q, bag in enumerate(bags):
            matrix[[terms[t] for t in bag], q] = 1.0
        return cls([r.query_id for r in rows], terms, matrix)


def term_blocks(queries: DataFrame, max_queries: int, matrix_bytes: int) -> Iterator[TermBlock]:
    """Blocks of at most ``max_queries`` queries whose matrix has at most ``matrix_bytes``; the driver holds one at a time."""
    for rows in batched(queries.select("query_id", F.col("text").cast("string")).toLocalIterator(), max_queries):
        yield from map(TermBlock.of, _by_bytes(rows, matrix_bytes, lambda text: set(tokens_of(text))))


def _term_counts(corpus: DataFrame, block: TermBlock) -> tuple[int, float, np.ndarray]:
    """Number of texts, their mean length in tokens, and how many have each term of the block: one pass, a sum a term."""
    shared = corpus.sparkSession.sparkContext.broadcast(pa.array(list(block.terms), pa.string()))  # in the order of their slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df = 0, 0, np.zeros(len(shared.value), np.int64)
        for texts in slices(batches, 0):
            place, slot, all_tokens = _asked_tokens(texts.column(0), shared.value)
            n, length = n + texts.num_rows, length + int(all_tokens.sum())
            df += np.bincount(counted(place, slot, len(df))[1], minlength=len(df))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *used.tolist()]), pa.array([n, length, *df[used].tolist()])], ["slot", "n"])

    sums = corpus.select(F.col("text").cast("string")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = {r.slot: r.n for r in sums.collect()}  # a row a term of the block
    n = found.pop(-2, 0)
    length, df = found.pop(-1, 0), np.zeros(len(block.terms), np.int64)
    df[list(found)] = list(found.values())
    return n, length / n if n else 0.0, df


def query_names(queries: DataFrame, names: list) -> pa.Array:
    """Query ids as an Arrow array of their type."""
    kind = queries.schema["query_id"].dataType.simpleString()
    return pa.array(names, pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())


def best_cells(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the positive scores that are among the k largest of their query; ties at the cut stay."""
    least = np.partition(score, -k, axis=0)[-k] if len(score) > k else np.zeros(score.shape[1])
    return np.nonzero((score > 0) & (score >= least))


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most 1,024 rows and, if of more than one, about 2 MB of text."""
    for batch in batches:
        n_bytes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(n_bytes, dtype=np.int64) >> 21
        cuts = np.union1d(np.flatnonzero(np.diff(block)) + 1, np.arange(0, batch.num_rows, 1024)).tolist() + [batch.num_rows]
        for lo, hi in pairwise(cuts):
            yield batch.slice(int(lo), int(hi - lo))


def _asked_tokens(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, slot) of every token that is one of ``terms``, and the number of all tokens of each text."""
    place, found, code = tokens_in(texts)
    slot = pc.fill_null(pc.index_in(found, value_set=terms), -1).to_numpy(zero_copy_only=False)[code]
    return place[slot >= 0], slot[slot >= 0], np.bincount(place, minlength=len(texts))


def _running_best(top: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest scores of each query so far, and (row, query) of the positive scores here that are among them; ties at the cut stay."""
    top = np.vstack([top, score])
    if len(top) > k:
        top = np.partition(top, -k, axis=0)[-k:]
    row, q = np.nonzero((score > 0) & (score >= (top[0] if len(top) == k else 0)))
    return top, row, q


def _nothing_asked(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """The result for no queries, without a pass over the corpus."""
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((corpus, "id"), (queries, "query_id"))}
    return corpus.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank int")


def bm25(corpus: DataFrame, queries: DataFrame, k: int | None = 8, k1: float = 1.5, b: float = 0.75, max_queries: int = 1024, matrix_bytes: int = 64_000_000) -> DataFrame:
    """Positive BM25 scores of each query, best first (5.1, 7.1). A query's terms count once.

    Queries are a matrix of terms by queries that every task holds. The corpus passes twice: for the
    number of texts of each term, and for the scores, of which each slice's best rows are
    shuffled and nothing else. More queries than a block holds get two passes a block. All
    ranks (``k`` None) are joined on terms instead.
    """
    if k is None:
        return bm25_joined(corpus, queries, k, k1, b)
    parts = [_bm25_block(corpus, queries, block, k, k1, b) for block in term_blocks(queries, max_queries, matrix_bytes)]
    if len(parts) <= 1:
        return parts[0] if parts else _nothing_asked(corpus, queries)
    return top_k(reduce(DataFrame.unionByName, map(materialize, parts)).drop("rank"), k)


def _bm25_block(corpus: DataFrame, queries: DataFrame, block: TermBlock, k: int, k1: float, b: float) -> DataFrame:
    """One block of queries."""
    n, avg_length, df = _term_counts(corpus, block)
    weights = block.matrix * np.log(1.0 + (n - df + 0.5) / (df + 0.5))[:, None]
    names = query_names(queries, block.names)
    shared = corpus.sparkSession.sparkContext.broadcast((pa.array(list(block.terms), pa.string()), weights))
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((corpus, "id"), (queries, "query_id"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = shared.value
        top = np.zeros((0, len(names)))
        for part in slices(batches, 1):
            place, slot, length = _asked_tokens(part.column(1), terms)
            text, slot, tf = counted(place, slot, len(terms))
            impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[text] / (avg_length or 1.0)))
            score = np.zeros((part.num_rows, len(names)))
            for i, (lo, hi) in enumerate(pairwise(np.searchsorted(text, np.arange(part.num_rows + 1)).tolist())):
                if lo < hi:
                    score[i] = impact[lo:hi] @ weights[slot[lo:hi]]
            score = np.round(score, DIGITS)
            top, row, q = _running_best(top, score, k)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), part.column(0).take(pa.array(row)), pa.array(score[row, q])], ["query_id", "id", "score"])

    found = corpus.select("id", F.col("text").cast("string")).mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return top_k(found, k)


def bm25_joined(corpus: DataFrame, queries: DataFrame, k: int | None = 8, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The same by a join on terms, for all ranks."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    found = postings(corpus).join(asked.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = found.join(df, "term").join(F.broadcast(corpus_stats(corpus)))  # one row
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.when(F.col("avg_length") > 0, F.col("avg_length")).otherwise(1.0))
    weighted = weighted.select("id", "term", (idf(F.col("n"), F.col("df")) * (F.col("tf") * (k1 + 1) / norm)).alias("w"))
    scored = weighted.join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), DIGITS).alias("score")).where("score > 0")
    return top_k(scored, k)


def gram_counts(table: DataFrame, key: str) -> DataFrame:
    """(key, gram, n, norm): trigram bags with their Euclidean norms."""
    rows = table.select(key, F.explode(trigrams(F.coalesce("text", F.lit("")))).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return rows.join(norms, key)


def _gram_codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams as numbers, with their counts; shorter strings have numbers of their own."""
    joined = " ".join(t for t in _NOT_TOKEN.split((text or "").lower()) if t).encode()
    raw = np.frombuffer(joined, np.uint8).astype(np.int64)
    if len(raw) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(raw) < 3:
        return np.array([int.from_bytes(joined, "big")]), np.array([1])
    return np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:], return_counts=True)


def _grams_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, number of the gram) of all trigrams of many texts, text by text."""
    parts = [(t or "").lower().encode() for t in texts.to_pylist()]
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)  # every text ends with a byte of no token
    inside = _IN_TOKEN[raw]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # a space after each token, the last of its text included
    joined = np.where(inside, raw, 32)[kept].astype(np.int64)
    stop = np.concatenate([[0], np.cumsum(kept)])[np.cumsum(np.array([len(p) + 1 for p in parts], np.int64))]
    size = np.diff(stop, prepend=0)
    text = np.repeat(np.arange(len(parts)), size)
    whole = text[3:] == text[:-3]
    codes = (joined[:-3] << 16 | joined[1:-2] << 8 | joined[2:-1])[whole]
    short = np.flatnonzero((size > 1) & (size < 4))
    first = stop[short] - size[short]
    alone = np.where(size[short] == 2, joined[first], joined[first] << 8 | joined[first + 1])
    return np.concatenate([text[:-3][whole], short]), np.concatenate([codes, alone])


def trigram_cosine(corpus: DataFrame, queries: DataFrame, k: int | None = 8, max_queries: int = 1024, matrix_bytes: int = 64_000_000) -> DataFrame:
    """Positive cosines of trigram bags, best first (7.7, 10.10).

    Queries are a matrix of grams by queries that every task holds; the corpus passes once and
    nothing but each slice's best rows is shuffled. More than ``max_queries`` queries, or
    more grams than ``matrix_bytes`` allow, are dealt to blocks with a pass each, of which the
    driver holds one at a time. All ranks (``k`` None) are joined on grams instead.
    """
    if k is None:
        return trigram_cosine_joined(corpus, queries, k)
    asked = queries.select("query_id", F.col("text").cast("string"))
    rows = asked.limit(max_queries + 1).collect()
    blocks = [rows] if len(rows) <= max_queries else batched(asked.toLocalIterator(), max_queries)
    parts = [part for block in blocks for part in _by_bytes(block, matrix_bytes, lambda text: set(_gram_codes(text)[0].tolist()))]
    if len(parts) <= 1:
        return _trigram_block(corpus, queries, parts[0], k) if parts else _nothing_asked(corpus, queries)
    return top_k(reduce(DataFrame.unionByName, [materialize(_trigram_block(corpus, queries, part, k)) for part in parts]).drop("rank"), k)


def _by_bytes(rows: Sequence[Row], limit: int, keys: Callable[[str | None], set]) -> Iterator[list[Row]]:
    """Runs of queries whose matrix of keys by queries has at most ``limit`` bytes, one query at least."""
    part: list[Row] = []
    known: set = set()
    for row in rows:
        own = keys(row.text)
        if part and len(known | own) * (len(part) + 1) * 8 > limit:
            yield part
            part, known = [], set()
        part.append(row)
        known |= own
    if part:
        yield part


def _trigram_block(corpus: DataFrame, queries: DataFrame, asked: Sequence[Row], k: int) -> DataFrame:
    """One pass for queries that a task can hold. Dot products are whole numbers in double precision, so exact."""
    bags = [_gram_codes(r.text) for r in asked]
    grams = np.unique(np.concatenate([b[0] for b in bags] or [np.empty(0, np.int64)]))
    matrix = np.zeros((len(grams), len(asked)))
    for q, (codes, counts) in enumerate(bags):
        matrix[np.searchsorted(grams, codes), q] = counts
    norms = np.array([np.sqrt(float((c * c).sum())) for _, c in bags])
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((corpus, "id"), (queries, "query_id"))}
    names = query_names(queries, [r.query_id for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((0, len(norms)))
        for part in slices(batches, 1):
            text, codes = _grams_in(part.column(1))
            text, codes, n = counted(text, codes, 1 << 24)
            own = np.sqrt(np.bincount(text, weights=(n * n).astype(float), minlength=part.num_rows))
            place = np.minimum(np.searchsorted(grams, codes), max(len(grams) - 1, 0))
            known = grams[place] == codes if len(grams) else np.zeros(len(codes), bool)
            used, column = np.unique(place[known], return_inverse=True)
            counts = np.zeros((part.num_rows, len(used)))
            counts[text[known], column] = n[known]
            score = np.round((counts @ matrix[used]) / np.maximum(norms * own[:, None], 1e-300), DIGITS)
            top, row, q = _running_best(top, score, k)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), part.column(0).take(pa.array(row)), pa.array(score[row, q])], ["query_id", "id", "score"])

    found = corpus.select("id", F.col("text").cast("string")).mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return top_k(found, k)


def trigram_cosine_joined(corpus: DataFrame, queries: DataFrame, k: int | None = 8) -> DataFrame:
    """The same by a join on grams, for any number of queries."""
    a, q = gram_counts(corpus, "id"), gram_counts(queries, "query_id").withColumnsRenamed({"n": "qn", "norm": "qnorm"})
    dots = a.join(q, "gram").groupBy("query_id", "id").agg(F.sum(F.col("n") * F.col("qn")).alias("dot"), F.first("norm").alias("norm"), F.first("qnorm").alias("qnorm"))
    scored = dots.select("query_id", "id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), DIGITS).alias("score")).where("score > 0")
    return top_k(scored, k)


def vector_cosine(vectors: DataFrame, queries: DataFrame, k: int = 8, max_queries: int = 4096, keep_self: bool = True) -> DataFrame:
    """Exact cosine top-k (7.5): one pass over ``vectors(id, vector)`` for each block of ``max_queries`` query vectors.

    Every task holds its block as one matrix and the best k rows of each query so far. Up to
    ``max_queries`` queries are one block; of more, the driver holds one block at a time and the
    result of each is written before the next.
    """
    picked = vectors.select(F.col("id").cast("long"), "vector").where("id is not null and vector is not null")
    asked = queries.select("query_id", "vector").where("vector is not null")
    rows = asked.limit(max_queries + 1).collect()
    if len(rows) <= max_queries:
        return _vector_cosine_block(picked, rows, k, keep_self)
    blocks = batched(asked.toLocalIterator(), max_queries)
    return top_k(reduce(DataFrame.unionByName, [materialize(_vector_cosine_block(picked, block, k, keep_self)) for block in blocks]).drop("rank"), k)


def _vector_cosine_block(vectors: DataFrame, rows: Sequence[Row], k: int, keep_self: bool) -> DataFrame:
    """One pass for queries that a task can hold."""
    names = np.array([r.query_id for r in rows], np.int64)
    matrix = np.array([r.vector for r in rows], float).reshape(len(rows), -1)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, best_ids = np.full((len(names), 0), -2.0), np.empty((len(names), 0), np.int64)
        step = max(CELLS // max(len(names), 1), 1)
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(all_ids) or not len(names):
                continue
            all_flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(all_ids), -1)
            for at in range(0, len(all_ids), step):
                ids, flat = all_ids[at : at + step], all_flat[at : at + step]
                score = np.round(matrix @ (flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)).T, DIGITS)
                if not keep_self:
                    score = np.where(names[:, None] == ids[None, :], -2.0, score)
                score, ids = np.hstack([best, score]), np.hstack([best_ids, np.broadcast_to(ids, score.shape)])
                order = np.lexsort((ids, -score), axis=1)[:, :k]
                best, best_ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        real = best > -2
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[:, None], best.shape)[real]), pa.array(best_ids[real]), pa.array(best[real])], ["query_id", "id", "score"])

    return top_k(vectors.mapInArrow(run, "query_id long, id long, score double"), k)


def hashed_trigram_vector(text: Column, dimensions: int = 64) -> Column:
    """A deterministic stand-in for an embedding model (11.8): trigrams hashed to signed counts."""
    def counts(slots: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("float"))

    slots = F.transform(trigrams(text), lambda g: F.pmod(F.xxhash64(g), F.lit(dimensions)))
    return F.element_at(F.transform(F.array(slots), counts), 1)
