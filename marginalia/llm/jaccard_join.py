"""N-gram Jaccard join: a blocked sparse matrix product of document by n-gram incidence.

Two documents are linked when ``den * |A & B| >= num * |A | B|`` over the sets of
distinct k-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text of
fewer words is one shingle; a text without words has no shingle and no link).

Plan. Let o(n) = ceil(num * n / den) be the least overlap of a set of n shingles
with any partner.

1. *Rows.* Every text becomes (doc_id, n, 128-bit fingerprint of its set). Equal
   sets are one class, whose smallest doc_id stands for it.
2. *Column order.* Columns (shingles) that many rows use come last: those seen over
   ``hot`` times in the first columns of all rows. They are marked in a bitmap of
   2^``hot_bits`` bits, by the upper bits of their hashes, which is broadcast: its size
   does not depend on the input. Any fixed order gives the same result, so columns that
   share a bit only cost time.
3. *Blocked product.* Of each row only its first n - o(n) + l(n) columns are kept,
   l(n) = 1 + n // 16: linked rows share at least min(l) of those. They are dealt to
   blocks of columns; each block counts the overlaps of its pairs of rows of
   compatible sizes. Columns with over ``wide`` rows give a chain of size
   neighbours in place of all pairs, so no block's output grows with the square of a
   column. Summed over the blocks, pairs below the bound min(l) are discarded.
4. *Exact products.* The rows of each candidate component are multiplied with all
   their columns: small components whole, large ones as pairs of blocks of rows of
   compatible size classes (blocks of ``rows_per_block`` rows and ``block_shingles``
   columns in use at most). Within a block the product is dense and runs over slices of
   columns. Only a spanning forest of the links and the number of links of each row leave
   a task.
5. *Components* of those links.

Rows are told apart by the fingerprints of their sets throughout, never by doc_id.
Nulls, empty texts: n_shingles 0, linked with nothing, own component. Repeated
doc_ids: each row is returned and compared with its own text. A row with a null doc_id
takes part like any other; ``class_id`` and ``component_id`` are the smallest doc_id that
is not null, or null if there is none. Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.textkernel import Docs, distinct_by_doc, mix, slices, string_buffer, window_hashes
from marginalia.llm.words import quoted, release_tables, row_hash, spare
from marginalia.plans.components import connected_components
from marginalia.plans.scratch import materialize

_U = np.uint64
WORD = "[^\\x20\\x09-\\x0D]"

#: Bytes of text that are packed together into entries of blocks.
ENTRY_SLICE = 4_000_000


def least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-num * n // den)


def prefix_bound(n: np.ndarray) -> np.ndarray:
    """How many of the kept columns two linked rows share at least (l)."""
    return 1 + n // 16


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, one after another, and their numbers."""
    docs = Docs(data, offsets, lower=True)
    hashes, owner, _ = window_hashes(docs.word_hashes(), docs.counts, k)
    return distinct_by_doc(hashes, owner, docs.n)


def _fingerprints(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; an empty set has 0, 0."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([[_U(0)], np.cumsum(mix(hashes ^ _U(salt)), dtype=_U)])
        ends = np.cumsum(counts)
        out.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return out[0], out[1]


def _printed(column: pa.Array, k: int) -> Iterator[tuple[int, int, pa.Array, pa.Array, pa.Array]]:
    """(lo, hi, sizes, two fingerprints) of the sets of a column of texts, by slices."""
    data, offsets = string_buffer(column)
    for lo, hi in slices(offsets):
        hashes, counts = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
        yield lo, hi, pa.array(counts.astype(np.int64)), *map(pa.array, _fingerprints(hashes, counts))


def _rows_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in batches:
            for lo, hi, n, one, two in _printed(batch.column(2), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), n, one, two], ["doc_id", "row", "n_shingles", "fp1", "fp2"])

    return run


#: Sets that a task remembers at once, to send the text of a copy only once.
_SEEN = 65_536


def _texts_of(k: int):
    """The texts with a word, most repeats of a set within a task left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for lo, hi, n, one, two in _printed(batch.column(0), k):
                fresh = []
                for i, (size, *print_) in enumerate(zip(n.to_pylist(), one.to_pylist(), two.to_pylist(), strict=True)):
                    if size and (key := tuple(print_)) not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(key)
                        fresh.append(i)
                at = pa.array(fresh, pa.int64())
                yield pa.RecordBatch.from_arrays([one.take(at), two.take(at), batch.column(0).slice(lo, hi - lo).take(at)], ["fp1", "fp2", "text"])

    return run


def _prints(k: int):
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays([n, one, two], ["n", "fp1", "fp2"]) for _, _, n, one, two in _printed(texts, k)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64())]))

    return run


def _firsts(hashes: np.ndarray, counts: np.ndarray, take: np.ndarray) -> np.ndarray:
    """A mask of the first ``take`` entries of each document."""
    begin = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(len(hashes)) - begin < np.repeat(take, counts)


def _blocks_of(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    return (mix(hashes) % _U(n_blocks)).astype(np.int64)


def _hash_ranges(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    """Blocks that are ranges of hashes."""
    return ((hashes >> _U(32)) * _U(n_blocks) >> _U(32)).astype(np.int64)


def _hot_entries(k: int, num: int, den: int, n_blocks: int):
    """(block, packed hashes): the first columns of all rows in the order of hashes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in batches:
            data, offsets = string_buffer(batch.column(0))
            for lo, hi in slices(offsets, ENTRY_SLICE):
                hashes, counts = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                take = counts - least_overlap(counts, num, den) + prefix_bound(counts)
                hashes = hashes[_firsts(hashes, counts, take + take // 8)]
                block = _hash_ranges(hashes, n_blocks)
                order = np.argsort(block, kind="stable")
                hashes, sizes = hashes[order], np.bincount(block, minlength=n_blocks)
                ends = np.cumsum(sizes)
                use = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(use), pa.array([hashes[ends[b] - sizes[b] : ends[b]].tobytes() for b in use], pa.binary())], ["block", "hashes"])

    return run


def _hot_bits(hot: int, hot_bits: int):
    """The part of the bitmap of common columns that a range of hashes covers: (first byte, bytes)."""

    def run(table: pa.Table) -> pa.Table:
        hashes, counts = np.unique(np.frombuffer(b"".join(table.column("hashes").to_pylist()), _U), return_counts=True)
        bits = np.unique(hashes[counts > hot] >> _U(64 - hot_bits)).astype(np.int64)
        if not len(bits):
            return pa.table({"at": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
        at = int(bits[0]) // 8
        part = np.zeros((int(bits[-1]) // 8 - at + 1) * 8, np.uint8)
        part[bits - at * 8] = 1
        return pa.table({"at": pa.array([at]), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    return run


def _is_hot(hashes: np.ndarray, bitmap: np.ndarray, hot_bits: int) -> np.ndarray:
    at = (hashes >> _U(64 - hot_bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _product_entries(k: int, num: int, den: int, n_blocks: int, bitmap, hot_bits: int):
    """(block, rows, sizes, numbers, hashes): packed first columns of rows, by block of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        common = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            data, offsets = string_buffer(batch.column(0))
            for lo, hi in slices(offsets, ENTRY_SLICE):
                hashes, counts = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                uid, _ = _fingerprints(hashes, counts)
                _, first = np.unique(uid, return_index=True)
                fresh = np.zeros(len(counts), bool)
                fresh[first] = True
                fresh &= counts > 0
                hashes, counts, uid = hashes[np.repeat(fresh, counts)], counts[fresh], uid[fresh]
                docs = np.repeat(np.arange(len(counts)), counts)
                order = np.argsort(docs * 2 + _is_hot(hashes, common, hot_bits), kind="stable")
                hashes = hashes[order]
                keep = _firsts(hashes, counts, counts - least_overlap(counts, num, den) + prefix_bound(counts))
                hashes, docs = hashes[keep], docs[keep]
                block = _blocks_of(hashes, n_blocks)
                order = np.argsort(block, kind="stable")
                hashes, docs, sizes = hashes[order], docs[order], np.bincount(block, minlength=n_blocks)
                ends = np.cumsum(sizes)
                rows: list[list] = [[], [], [], [], []]
                for b in np.flatnonzero(sizes):
                    of = docs[ends[b] - sizes[b] : ends[b]]
                    mine, numbers = np.unique(of, return_counts=True)
                    for out, value in zip(rows, (int(b), uid[mine].tobytes(), counts[mine].tobytes(), numbers.tobytes(), hashes[ends[b] - sizes[b] : ends[b]].tobytes()), strict=True):
                        out.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["block", "rows", "sizes", "numbers", "hashes"])

    return run


#: Stands for "linked by a column with many rows": passes every bound.
CHAINED = 1 << 40
_PAIRS_AT_ONCE = 4_000_000


def _add_up(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, weight = np.concatenate(keys), np.concatenate(weights)
    key, inverse = np.unique(key, return_inverse=True)
    return key, np.bincount(inverse, weights=weight, minlength=len(key)).astype(np.int64)


def _multiply(num: int, den: int, wide: int):
    """One block of columns: overlap counts of its pairs of rows."""

    def run(table: pa.Table) -> pa.Table:
        uid, size, number, hashes = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("rows", np.int64), ("sizes", np.int64), ("numbers", np.int64), ("hashes", _U)))
        uids, first = np.unique(uid, return_index=True)  # copies of a set have the same columns: one row
        fresh = np.zeros(len(uid), bool)
        fresh[first] = True
        sizes = size[first]
        hashes = hashes[np.repeat(fresh, number)]
        rows = np.repeat(np.searchsorted(uids, uid[fresh]), number[fresh])
        order = np.lexsort((rows, sizes[rows], hashes))
        hashes, rows = hashes[order], rows[order]
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
        length = np.diff(np.append(begin, len(hashes)))
        n = len(uids)
        keys, weights, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

        def add(a: np.ndarray, b: np.ndarray, weight: int) -> None:
            nonlocal keys, weights, held
            fits = den * sizes[a] >= num * sizes[b]  # sorted by size: a is not larger
            a, b = a[fits], b[fits]
            keys.append(np.minimum(a, b) * n + np.maximum(a, b))
            weights.append(np.full(len(a), weight))
            held += len(a)
            if held > _PAIRS_AT_ONCE:
                key, weight_sum = _add_up(keys, weights)
                keys, weights, held = [key], [weight_sum], 0

        for m in np.unique(length[(length > 1) & (length <= wide)]):
            left, right = np.triu_indices(int(m), 1)
            runs = begin[length == m]
            step = max(1, _PAIRS_AT_ONCE // len(left))
            for at in range(0, len(runs), step):
                at_rows = rows[runs[at : at + step, None] + np.arange(int(m))]
                add(at_rows[:, left].ravel(), at_rows[:, right].ravel(), 1)
        inner = np.repeat(length > wide, length)
        inner[begin] = False
        chained = np.flatnonzero(inner)
        for at in range(0, len(chained), _PAIRS_AT_ONCE):
            here = chained[at : at + _PAIRS_AT_ONCE]
            add(rows[here - 1], rows[here], CHAINED)
        key, weight = _add_up(keys, weights)
        a, b = key // max(n, 1), key % max(n, 1)
        bound = np.minimum(prefix_bound(sizes[a]), prefix_bound(sizes[b]))
        return pa.table({"a": uids[a], "b": uids[b], "overlap": np.minimum(weight, CHAINED), "bound": bound})

    return run


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest (root, member) of a symmetric boolean matrix."""
    free = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not free[root]:
            continue
        free[root] = False
        frontier = np.array([root])
        while len(frontier):
            reached = linked[frontier].any(axis=0) & free
            free &= ~reached
            frontier = np.flatnonzero(reached)
            for member in frontier:
                yield root, int(member)


_COLUMNS_AT_ONCE = 2048


def _overlaps(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The product of an incidence matrix with its transpose, by slices of its shared columns."""
    g = len(counts)
    rows = np.repeat(np.arange(g), counts)
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else new
    rows, column = rows[shared], column[shared]
    column = np.cumsum(np.concatenate([[0], (column[1:] != column[:-1]).astype(np.int64)])) if len(column) else column
    out = np.zeros((g, g), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS_AT_ONCE):
        lo, hi = np.searchsorted(column, [at, at + _COLUMNS_AT_ONCE])
        part = np.zeros((g, min(_COLUMNS_AT_ONCE, int(column[-1]) + 1 - at)), np.float32)
        part[rows[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _exact(k: int, num: int, den: int):
    """A group of candidate components, or one pair of row blocks: links as (kind, a, b).

    kind 0: an edge of the spanning forest; kind 1: b links of the row a, counted in documents.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data, offsets = string_buffer(table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text"))
        part, side, ids, copies = (table.column(c).to_numpy() for c in ("part", "side", "fp1", "copies"))
        order = np.lexsort((ids, part))
        sets: list = [None] * len(ids)
        for lo, hi in slices(offsets):
            hashes, counts = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
            sets[lo:hi] = np.split(hashes, np.cumsum(counts)[:-1])
        kinds, left, right = [], [], []
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for members in np.split(order, cuts):
            if len(members) < 2:
                continue
            counts = np.array([len(sets[i]) for i in members])
            overlap = _overlaps(np.concatenate([sets[i] for i in members]), counts)
            union = counts[:, None] + counts[None, :] - overlap
            linked = (den * overlap >= num * union) & (overlap > 0)
            np.fill_diagonal(linked, False)
            sides = side[members]
            if sides.min() >= 0 and sides.max() > sides.min():  # two blocks: only pairs across
                linked &= sides[:, None] != sides[None, :]
            mine = ids[members]
            for root, member in _forest(linked):
                kinds.append(0)
                left.append(mine[root])
                right.append(mine[member])
            links = linked @ copies[members]
            some = np.flatnonzero(links)
            kinds += [1] * len(some)
            left += mine[some].tolist()
            right += links[some].tolist()
        return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _linked(
    base: DataFrame, k: int, num: int, den: int,
    hot: int = 32, hot_bits: int = 26, wide: int = 48, entries_per_block: int = 1_000_000, rows_per_block: int = 384, block_shingles: int = 300_000, bytes_per_group: int = 6_000_000,
) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, row, n_shingles, fp1, fp2)`` and classes ``(fp1, fp2, class_id, copies, group, links)`` of ``base(doc_id, row, text)``.

    ``group`` tells components of classes apart, ``links`` counts the documents of other
    classes that a class is linked with.
    """
    spark = base.sparkSession
    rows = materialize(base.mapInArrow(_rows_of(k), "doc_id long, row long, n_shingles long, fp1 long, fp2 long"))
    classes = rows.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    classes = materialize(classes)
    kept = int(rows.agg(F.coalesce(F.sum(F.col("n_shingles") * (den - num) / den + F.col("n_shingles") / 16 + 2), F.lit(0))).first()[0])
    n_blocks = max(8, -(-kept // entries_per_block))

    text = base.select("text")
    counted = text.mapInArrow(_hot_entries(k, num, den, n_blocks), "block long, hashes binary").groupBy("block").applyInArrow(_hot_bits(hot, hot_bits), "at long, bits binary")
    bitmap = np.zeros((1 << hot_bits) // 8, np.uint8)
    for part in counted.collect():  # the parts together are as large as the bitmap
        mine = np.frombuffer(part.bits, np.uint8)
        bitmap[part["at"] : part["at"] + len(mine)] |= mine
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    entries = text.mapInArrow(_product_entries(k, num, den, n_blocks, shared, hot_bits), "block long, rows binary, sizes binary, numbers binary, hashes binary")
    product = entries.groupBy("block").applyInArrow(_multiply(num, den, wide), "a long, b long, overlap long, bound long")
    pairs = product.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("bound").alias("bound")).where("overlap >= bound")
    parts = connected_components(pairs.select("a", "b"))

    # the rows of candidate components, and where each is multiplied
    member = classes.join(parts, classes["fp1"] == parts["node"]).select("component", "fp1", "fp2", "copies", "n")
    step = float(np.log(den / num)) * 1.000001  # wider than the bound by more than rounding
    member = member.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)))
    member = materialize(member)
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    large = sizes.where((F.col("size") > rows_per_block) | ((F.col("shingles") > block_shingles) & (F.col("size") > 2))).select("component")
    total = int(sizes.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0])
    n_groups = max(8, -(-total * 8 // bytes_per_group))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / rows_per_block), F.ceil(F.sum("n") / block_shingles))
    per_class = member.join(large, "component", "left_semi").groupBy("component", "cls").agg(blocks.alias("blocks"))
    whole = member.join(large, "component", "left_anti").select(
        (F.pmod(F.xxhash64("component"), F.lit(n_groups)) * 2).alias("gid"), F.col("component").alias("part"), F.lit(-1).alias("side"), "fp1", "fp2", "copies"
    )
    # size classes are as wide as the size bound, so linked rows are in the same or in neighbouring classes
    own = per_class.select("component", F.col("cls"), F.col("cls").alias("other"), F.col("blocks").alias("others"))
    near = [per_class.select("component", (F.col("cls") + d).alias("cls"), F.col("cls").alias("other"), F.col("blocks").alias("others")) for d in (1, -1)]
    around = own.unionByName(near[0]).unionByName(near[1])
    spread = member.join(per_class, ["component", "cls"]).withColumn("block", F.pmod(F.xxhash64("fp2", "fp1"), F.col("blocks"))).join(around, ["component", "cls"])
    spread = spread.withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    here, there = F.struct(F.col("cls").cast("long").alias("c"), F.col("block").cast("long").alias("b")), F.struct(F.col("other").cast("long").alias("c"), F.col("mate").cast("long").alias("b"))
    paired = spread.select(
        (F.abs(F.xxhash64("component", F.least(here, there), F.greatest(here, there)) % F.lit(1 << 60)) * 2 + 1).alias("gid"),
        F.lit(0).cast("long").alias("part"), F.when(here == there, F.lit(-1)).when(here < there, F.lit(0)).otherwise(F.lit(1)).alias("side"), "fp1", "fp2", "copies",
    )
    work = whole.unionByName(paired)
    printed = base.select("text").mapInArrow(_texts_of(k), "fp1 long, fp2 long, text string")
    one_text = printed.join(member.select("fp1", "fp2").hint("shuffle_hash"), ["fp1", "fp2"], "left_semi").groupBy("fp1", "fp2").agg(F.min("text").alias("text"))
    exact = work.join(one_text, ["fp1", "fp2"]).groupBy("gid").applyInArrow(_exact(k, num, den), "kind int, a long, b long")
    exact = materialize(exact)
    labels = connected_components(exact.where("kind = 0").select("a", "b")).select(F.col("node").alias("fp1"), "component")
    links = exact.where("kind = 1").groupBy(F.col("a").alias("fp1")).agg(F.sum("b").alias("links"))
    info = classes.select("fp1", "fp2", "class_id", "copies").join(labels, "fp1", "left").join(links, "fp1", "left")
    return rows, info.select("fp1", "fp2", "class_id", "copies", F.coalesce("component", "fp1").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id, n_links)`` for every row of ``docs``.

    ``component_id``: smallest doc_id reachable by links; ``class_id``: smallest doc_id
    with an equal set; ``n_links``: documents linked directly, equal sets included.
    """
    base = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), quoted(text_col).cast("string").alias("text"))
    rows, classes = _linked(base, k, num, den, **options)
    classes = materialize(classes)
    least = classes.groupBy("group").agg(F.min("class_id").alias("component_id"))
    info = classes.join(least, "group").select("fp1", "fp2", "class_id", "component_id", "copies", "links")
    out = rows.join(info, ["fp1", "fp2"], "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, null last, then of the smallest hash of the row.

    Rows without a word all stay, with whatever columns; columns and their names are untouched.
    """
    name, one, two, prints = (spare(docs.columns, x) for x in ("row", "fp1", "fp2", "prints"))
    text = quoted(text_col).cast("string")
    keyed = docs.withColumn(name, row_hash(docs))
    base = keyed.select(quoted(id_col).cast("long").alias("doc_id"), F.col(name).alias("row"), text.alias("text"))
    rows, classes = _linked(base, k, num, den, **options)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "fp1", "fp2")).alias("best")
    chosen = rows.join(classes.select("fp1", "fp2", "group"), ["fp1", "fp2"]).groupBy("group").agg(best)
    chosen = materialize(chosen.select(F.col("best.fp1").alias(one), F.col("best.fp2").alias(two), F.col("best.row").alias(name)))
    has_word = F.coalesce(F.regexp_like(text, F.lit(WORD)), F.lit(False))
    told = keyed.where(has_word).withColumn(prints, F.arrow_udf(_prints(k), "struct<n:long,fp1:long,fp2:long>")(text))
    told = told.withColumn(one, F.col(f"{prints}.fp1")).withColumn(two, F.col(f"{prints}.fp2"))
    stay = told.join(chosen, [one, two, name], "left_semi").dropDuplicates([one, two, name])
    columns = [quoted(c) for c in docs.columns]
    return stay.select(*columns).unionByName(docs.where(~has_word).select(*columns))
