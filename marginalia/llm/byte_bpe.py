"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves a whole pre-token that is
a token itself. Tier 2: any other pre-token starts as linked single bytes, and a heap
of neighbouring pairs, ordered by rank and place, drives the merges. A pre-token met
again in the same worker is read from a bounded memo. Decoding joins the bytes of the
ids.

Pre-tokens are the matches of ``public_tokenizers.PATTERN``. Texts whose characters
all lie below U+0250 are split by an equal pattern with the classes spelled out, which
the faster standard engine runs; all others by the pattern itself.

A null text is an empty one: no ids. Every row is returned, rows with a null or repeated id
and repeated rows too; equal texts have equal ids. Extra columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.public_vocab import default_path, rank_file
from marginalia.llm.words import quoted, worker_table

# Letters, numbers and white space below U+0250.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\\t-\\r \\x85\\xa0"
_NARROW = re.compile(f" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_WIDE = re.compile("[^\x00-ɏ]")
_FULL = regex.compile(public_tokenizers.PATTERN)


def pre_tokens(text: str) -> list[str]:
    """The matches of the pattern, which together are the text."""
    return _FULL.findall(text) if _WIDE.search(text) else _NARROW.findall(text)


class PerfectHash:
    """A minimal perfect hash of byte strings to their values, by hash and displace.

    Keys fall in buckets; each bucket, the largest first, gets the first displacement
    that sends its keys to free slots. Buckets of one key come last and name a free slot themselves
    (a negative displacement). There are as many slots as keys. A slot keeps its key, so
    strings outside the set are told apart.
    """

    _MASK = (1 << 40) - 1

    def __init__(self, values: dict[bytes, int]):
        self.size, self.n_buckets = len(values), max(1, len(values) // 2)
        buckets: list[list[tuple[bytes, int, int]]] = [[] for _ in range(self.n_buckets)]
        for key in values:
            x, y, z = self._parts(key)
            buckets[x % self.n_buckets].append((key, y, z))
        self.displacement = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * self.size
        self.values = [-1] * self.size
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            mine = buckets[b]
            if len(mine) < 2:
                break
            d = 0
            while True:
                slots = {self._slot(y, z, d) for _, y, z in mine}
                if len(slots) == len(mine) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.displacement[b] = d
            for key, y, z in mine:
                slot = self._slot(y, z, d)
                self.keys[slot], self.values[slot] = key, values[key]
        free = (s for s in range(self.size) if self.keys[s] is None)
        for b in [b for b in range(self.n_buckets) if len(buckets[b]) == 1]:
            key, slot = buckets[b][0][0], next(free)
            self.displacement[b], self.keys[slot], self.values[slot] = -1 - slot, key, values[key]

    @classmethod
    def _parts(cls, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & cls._MASK, (h >> 40) & cls._MASK, (h >> 80) | 1

    def _slot(self, y: int, z: int, d: int) -> int:
        return -1 - d if d < 0 else (((y ^ (d * 0x9E3779B97F)) * z >> 16) & self._MASK) % self.size

    def get(self, key: bytes) -> int | None:
        if not self.size:
            return None
        x, y, z = self._parts(key)
        slot = self._slot(y, z, self.displacement[x % self.n_buckets])
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``piece``: always the pair of lowest rank merges first, the leftmost of equals.

    An entry of the heap is one number: rank, begin and end of a pair, from the highest bits down.
    """
    n = len(piece)
    bits = n.bit_length()
    low, both = (1 << bits) - 1, 2 * bits
    end = list(range(1, n + 1))  # a part begins at its index and ends at end[i], where the next begins; 0: merged away
    before = list(range(-1, n))
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            heap.append(rank << both | i << bits | i + 2)
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        i, stop = entry >> bits & low, entry & low
        j = end[i]
        if not j or j >= n or end[j] != stop:  # a part of the pair has changed since
            continue
        end[i], end[j], before[stop] = stop, 0, i
        if stop < n:
            rank = get(piece[i : end[stop]])
            if rank is not None:
                push(heap, rank << both | i << bits | end[stop])
        if i:
            k = before[i]
            rank = get(piece[k:stop])
            if rank is not None:
                push(heap, rank << both | k << bits | stop)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Memo(dict):
    """Pre-token -> ids, as the bytes of 32-bit numbers, in two generations of at most ``capacity`` entries."""

    def __init__(self, make, capacity: int):
        super().__init__()
        self.make, self.capacity, self.old = make, capacity, {}

    def __missing__(self, pre_token: str) -> bytes:
        found = self.old.get(pre_token)
        if found is None:
            found = self.make(pre_token)
        if len(pre_token) <= 64:
            if len(self) >= self.capacity:
                self.old = dict(self)
                self.clear()
            self[pre_token] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded memo of pre-tokens."""

    def __init__(self, path: str, capacity: int = 150_000):
        self.ranks = rank_file(path)
        self.whole = PerfectHash(self.ranks)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.memo = _Memo(self._piece, capacity)

    def _piece(self, pre_token: str) -> bytes:
        raw = pre_token.encode("utf-8", "surrogatepass")
        whole = self.whole.get(raw)
        return array("i", (whole,) if whole is not None else merge_bytes(raw, self.ranks)).tobytes()

    def packed(self, text: str) -> np.ndarray:
        """The ids of a text as 32-bit numbers."""
        return np.frombuffer(b"".join(map(self.memo.__getitem__, pre_tokens(text))), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def codec(path: str) -> Codec:
    """The worker's codec."""
    return worker_table(("byte_bpe", path), lambda: Codec(path))


def _encoder(path: str, columns: list[str], digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        label = {i: str(i) for i in tool.token}
        for batch in batches:
            texts, keep = batch.column(len(columns)), [batch.column(i) for i in range(len(columns))]
            for at in range(0, len(texts), 256):  # ids of a few texts at a time
                part = texts.slice(at, 256).to_pylist()
                numbers, first, second = [], [], []
                for text in part:
                    packed = tool.packed(text or "")
                    numbers.append(len(packed))
                    if digests:
                        ids = packed.tolist()
                        first.append(hashlib.sha256(",".join(map(label.__getitem__, ids)).encode()).hexdigest())
                        second.append(hashlib.sha256(tool.decode(ids)).hexdigest())
                    else:
                        first.append(packed)
                        second.append(None)
                out = [pa.array(numbers, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32()))]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids"]
                if digests:
                    out.append(pa.array(second, pa.string()))
                yield pa.RecordBatch.from_arrays([*(k.slice(at, len(part)) for k in keep), *out], [*columns, *names])

    return run


def _with_text(docs: DataFrame, columns: list[str], text_col: str) -> tuple[DataFrame, list[str], str]:
    """The columns and the text under plain names, those names, and their schema."""
    kept = docs.select(*map(quoted, columns))
    plain = [f"c{i}" for i in range(len(columns))]
    schema = "".join(f"{p} {f.dataType.simpleString()}, " for p, f in zip(plain, kept.schema, strict=True))
    return docs.select(*(quoted(c).alias(p) for c, p in zip(columns, plain, strict=True)), quoted(text_col).cast("string").alias("text")), plain, schema


def encode_digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: the ids and their decoded bytes as digests."""
    picked, plain, schema = _with_text(docs, [id_col], text_col)
    found = picked.mapInArrow(_encoder(vocabulary, plain, True), f"{schema}n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def encode(docs: DataFrame, vocabulary: str | None = None, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens and the ids of every row."""
    picked, plain, schema = _with_text(docs, list(keep), text_col)
    path = vocabulary or default_path("byte_bpe_multi_50k.tiktoken")
    return picked.mapInArrow(_encoder(path, plain, False), f"{schema}n_tokens long, ids array<int>").toDF(*keep, "n_tokens", "ids")


def decode(coded: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)`` of every row of ids; null ids give empty bytes."""
    path = vocabulary or default_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())], ["id", "bytes"])

    picked = coded.select(quoted(id_col).alias("id"), quoted(ids_col).alias("ids"))
    return picked.mapInArrow(run, f"id {picked.schema[0].dataType.simpleString()}, bytes binary").toDF(id_col, "bytes")
