"""Target-distribution importance resampling over hashed n-gram features, by a distinct-feature dictionary.

Words are runs of letters, digits and characters beyond ASCII (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``)
of the text with A-Z lower-cased. Features are single words and pairs of neighbours, joined
by a space, repeats counted. A feature's bucket is the crc32 of its bytes modulo
``buckets``. A bucket's gain compares its smoothed share of the target's features with
that of the documents' features. A document's weight is the mean gain of its features,
rounded down; with Gumbel noise made of a hash of its doc_id it is the document's score,
and the highest scores among documents of at least ``min_words`` words are drawn.

Plan.

1. Texts are tokenised once, into slices: distinct words and the sequence of their numbers,
   written to the shared folder. A slice is bounded in bytes; one longer text is one of its own.
2. Each slice sends its distinct feature strings with their counts, by blocks of a hash of the
   string. A block merges them to the global dictionary of distinct strings and counts; each
   string's crc32 is taken once, there. Counts are added up to buckets, and every slice is sent
   the buckets of its strings, two bytes each.
3. Gains of the buckets (a table of fixed size) are joined through the dictionary to the feature
   counts of each document of a slice.
4. Scores are ranked by range partitions: the offset of a partition is the number of rows in
   the ones before it, so no task sees all rows.

A null or empty text has no feature and weight 0; it is not drawn. A null doc_id is hashed as
the empty string and sorts last among ties. Every row is returned; equal rows get ranks next
to one another. Nothing is drawn from no rows; with no target rows all gains compare with
even shares. Extra columns of any name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.textkernel import mix, range_hashes, slices, string_buffer
from marginalia.llm.words import quoted, release_tables
from marginalia.plans.scratch import materialize

_U = np.uint64
#: Bytes of text of a slice.
SLICE = 6_000_000
#: Features, repeats counted, that a block of the dictionary is made for.
PER_BLOCK = 3_000_000

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _packed(values: np.ndarray) -> bytes:
    """Numbers with like bytes side by side, compressed."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T if len(values) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.empty(0, kind)


def _pack_strings(strings: pa.Array) -> tuple[bytes, bytes]:
    """The bytes and the lengths of binary strings, compressed."""
    data, offsets = string_buffer(strings)
    return zstandard.ZstdCompressor(level=3).compress(data.tobytes()), _packed(np.diff(offsets).astype(np.int32))


def _strings(data: bytes, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a run of documents, one after another, and how many each document has."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]  # a text's words end with it
    starts = np.flatnonzero(first)
    at = np.concatenate([np.cumsum(inside, dtype=np.int64)[starts] - 1, [np.count_nonzero(inside)]])
    counts = np.diff(np.searchsorted(starts, offsets))
    return _strings(data[inside].tobytes(), np.diff(at)), counts


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_tables()
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = string_buffer(batch.column(1))
        for lo, hi in slices(offsets, SLICE):
            words, counts = split_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            coded = words.dictionary_encode()
            text, lengths = _pack_strings(coded.dictionary)
            ids = batch.column(0).slice(lo, hi - lo)
            columns = [
                pa.array([task << 32 | n]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([_packed(counts.astype(np.int64))]),
                pa.array([_packed(coded.indices.to_numpy().astype(np.int32))]), pa.array([text]), pa.array([lengths]), pa.array([len(words)]),
            ]
            n += 1
            yield pa.RecordBatch.from_arrays(columns, ["slice", "ids", "counts", "seq", "words", "lengths", "n_words"])


class Slice:
    """The distinct features of a slice: words, then pairs, each with its block, in the order of blocks."""

    def __init__(self, counts: bytes, seq: bytes, words: bytes, lengths: bytes, n_blocks: int):
        self.counts, self.seq = _unpacked(counts, np.int64), _unpacked(seq, np.int32).astype(np.int64)
        self.words = _strings(zstandard.ZstdDecompressor().decompress(words), _unpacked(lengths, np.int32))
        n = len(self.words)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.paired = owner[1:] == owner[:-1]  # a word and the next one of the same document
        keys = (self.seq[:-1] * n + self.seq[1:])[self.paired]
        pairs, self.pair_of, times = np.unique(keys, return_inverse=True, return_counts=True)
        self.times = np.concatenate([np.bincount(self.seq, minlength=n), times])
        self.left, self.right = (pairs // n, pairs % n) if n else (pairs, pairs)
        data, offsets = string_buffer(self.words)
        hashes = range_hashes(data, offsets[:-1], offsets[1:]) if n else np.empty(0, _U)
        both = mix(hashes[self.left] * _U(0x9E3779B97F4A7C15) + hashes[self.right])
        self.block = (np.concatenate([mix(hashes), both]) % _U(n_blocks)).astype(np.int64)
        self.order = np.argsort(self.block, kind="stable")

    def strings(self) -> pa.Array:
        """The features as strings."""
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(self.left)), self.words.take(pa.array(self.right)), pa.scalar(b" ", pa.large_binary()))
        return pa.concat_arrays([self.words, pairs])

    def gains(self, of: np.ndarray) -> np.ndarray:
        """The summed gains of each document, given the gain of each feature."""
        n = len(self.words)
        each = np.concatenate([[0], np.cumsum(of[:n][self.seq])])
        two = np.zeros(len(self.seq) + 1, np.int64)
        two[2:][self.paired] = of[n:][self.pair_of]  # a pair counts where it ends
        ends = np.cumsum(self.counts)
        return (each + np.cumsum(two))[ends] - (each + np.cumsum(two))[ends - self.counts]


def _sent(n_blocks: int):
    """(block, slice, strings, lengths, times): the distinct features of a slice, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in batches:
            for number, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = Slice(*packed, n_blocks)
                strings, times = known.strings().take(pa.array(known.order)), known.times[known.order]
                sizes = np.bincount(known.block, minlength=n_blocks)
                ends = np.cumsum(sizes)
                rows: list[list] = [[], [], [], [], []]
                for b in np.flatnonzero(sizes).tolist():
                    lo, n = int(ends[b] - sizes[b]), int(sizes[b])
                    text, lengths = _pack_strings(strings.slice(lo, n))
                    for out, value in zip(rows, (b, number, text, lengths, _packed(times[lo : lo + n].astype(np.int64))), strict=True):
                        out.append(value)
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["block", "slice", "strings", "lengths", "times"])

    return run


def _dictionary(buckets: int):
    """One block of the dictionary: (slice, block, buckets) for each slice, and once the counts of the buckets."""

    def run(table: pa.Table) -> pa.Table:
        release_tables()
        parts = [_unpacked(x, np.int32) for x in table.column("lengths").to_pylist()]
        text = [zstandard.ZstdDecompressor().decompress(x) for x in table.column("strings").to_pylist()]
        coded = _strings(b"".join(text), np.concatenate(parts)).dictionary_encode()
        del text
        times = np.concatenate([_unpacked(x, np.int64) for x in table.column("times").to_pylist()])
        index = coded.indices.to_numpy()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, index, times)
        # each distinct string is hashed once
        bucket = (np.fromiter(map(zlib.crc32, coded.dictionary.to_pylist()), np.uint32, len(total)) % buckets).astype(np.uint32)
        held = np.zeros(buckets, np.int64)
        np.add.at(held, bucket, total)
        ends = np.cumsum([len(p) for p in parts])
        back = [_packed(x) for x in np.split(bucket[index], ends[:-1])]
        n, used = len(back), np.flatnonzero(held)
        block = table.column("block")[0].as_py()
        return pa.table({
            "slice": pa.array([*table.column("slice").to_pylist(), None], pa.int64()),
            "block": pa.array([block] * (n + 1), pa.int64()),
            "buckets": pa.array([*back, None], pa.binary()),
            "used": pa.array([None] * n + [used.tolist()], pa.list_(pa.int64())),
            "held": pa.array([None] * n + [held[used].tolist()], pa.list_(pa.int64())),
        })

    return run


_DICTIONARY = "slice long, block long, buckets binary, used array<long>, held array<long>"


def feature_dictionary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000) -> tuple[DataFrame, DataFrame, int]:
    """The tokenised slices, their dictionary, and its number of blocks."""
    picked = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    schema = "slice long, ids array<long>, counts binary, seq binary, words binary, lengths binary, n_words long"
    cut = materialize(picked.mapInArrow(_tokenise, schema))
    n_words = cut.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n_blocks = max(8, -(-2 * n_words // PER_BLOCK))
    sent = cut.select("slice", "counts", "seq", "words", "lengths").mapInArrow(_sent(n_blocks), "block long, slice long, strings binary, lengths binary, times binary")
    return cut, materialize(sent.groupBy("block").applyInArrow(_dictionary(buckets), _DICTIONARY)), n_blocks


def bucket_counts(dictionary: DataFrame) -> DataFrame:
    """``(bucket, n)`` of the buckets that hold a feature."""
    each = dictionary.where("used is not null").select(F.explode(F.arrays_zip("used", "held")).alias("x"))
    return each.groupBy(F.col("x.used").alias("bucket")).agg(F.sum("x.held").alias("n"))


def bucket_gains(own: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, from ``(bucket, n)`` of the documents and of the target."""
    spark = own.sparkSession
    both = own.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    by = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    s_all, t_all = by.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(float(s_all + buckets))) / ((F.col("s") + 1) * F.lit(float(t_all + buckets)))
    out = np.zeros(buckets, np.int64)
    for row in by.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():  # as many rows as buckets
        out[row.bucket] = row.gain
    return out


def _weigh(gains, n_blocks: int):
    """(doc_id, n_words, n_features, weight) of the documents of joined slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in batches:
            ids, *columns = batch.columns
            for i, (*packed, found) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                known = Slice(*packed, n_blocks)
                by_block = sorted(found or [], key=lambda x: x["block"])
                bucket = np.concatenate([np.empty(0, np.uint32), *(_unpacked(x["buckets"], np.uint32) for x in by_block)])
                of = np.zeros(len(known.block), np.int64)
                of[known.order] = gains.value[bucket]
                n_features = np.maximum(2 * known.counts - 1, 0)
                weight = np.where(n_features > 0, known.gains(of) // np.maximum(n_features, 1), 0)
                out = [ids[i].values, pa.array(known.counts), pa.array(n_features), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh_documents(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row of ``docs``."""
    cut, dictionary, n_blocks = feature_dictionary(docs, id_col=id_col, text_col=text_col, buckets=buckets)
    aim = target.select(F.lit(None).cast("long").alias("id"), quoted(target_text_col).alias("text"))
    _, other, _ = feature_dictionary(aim, id_col="id", text_col="text", buckets=buckets)
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_counts(dictionary), bucket_counts(other), buckets))
    found = dictionary.where("slice is not null").groupBy("slice").agg(F.collect_list(F.struct("block", "buckets")).alias("found"))
    joined = cut.join(found, "slice", "left").select("ids", "counts", "seq", "words", "lengths", "found")
    return joined.mapInArrow(_weigh(gains, n_blocks), "doc_id long, n_words long, n_features long, weight long")


def gumbel_score(doc_id: Column, weight: Column, seed: int) -> Column:
    """The weight with Gumbel noise, in thousandths, made of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


#: Copies of a row that one row is repeated to in one task.
_REPEATS = 4096


def ranked(rows: DataFrame, take: int) -> DataFrame:
    """``rows(doc_id, score, ...)`` with their ``rank`` by score, then doc_id; null beyond ``take``."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _REPEATS)))
    each = counted.withColumn("chunk", chunk).withColumn("left", F.least(F.lit(_REPEATS).cast("long"), F.col("n") - F.col("chunk") * _REPEATS))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), *(F.col(c) for c in columns if c not in ("score", "doc_id")), F.col("chunk"), F.col("copy")]
    placed = each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.select(*columns, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("index")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row a partition
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = (F.col("before") + F.col("index") + 1).cast("long")
    return placed.join(F.broadcast(offsets), "part").select(*columns, F.when(rank <= take, rank).alias("rank"))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    buckets: int = 10_000, min_words: int = 20, percent: int = 25, seed: int = 7,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row; rows with a rank are drawn."""
    weighed = weigh_documents(docs, target, id_col=id_col, text_col=text_col, target_text_col=target_text_col, buckets=buckets)
    scored = materialize(weighed.select("*", gumbel_score(F.col("doc_id"), F.col("weight"), seed).alias("score")))
    known = ["doc_id", "n_features", "weight", "score"]
    many = scored.where(F.col("n_words") >= min_words)
    drawn = ranked(many.select(*known), percent * many.count() // 100)
    return drawn.unionByName(scored.where(F.col("n_words") < min_words).select(*known, F.lit(None).cast("long").alias("rank")))
