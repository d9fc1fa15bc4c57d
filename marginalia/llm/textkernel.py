"""Vectorised text primitives over Arrow string buffers: words, lines, hashes, shingles.

All work is on UTF-8 bytes with numpy, a slice of documents at a time, so the
memory of a worker does not depend on the size of its partition. White space is
``[\\x20\\x09-\\x0D]``; those bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of text looked at together; one longer document is a slice of its own.
SLICE_BYTES = 2_000_000
#: Bytes hashed together.
HASH_BYTES = 1 << 18

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_TABLES.get("pow", ())) < n:
        size = max(n, HASH_BYTES + 1)
        for name, base in (("pow", _R), ("inv", _RINV)):
            table = np.full(size, base, _U)
            table[0] = 1
            _TABLES[name] = np.multiply.accumulate(table)
    return _TABLES["pow"], _TABLES["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _long_hash(data: np.ndarray) -> int:
    """The hash of one range longer than a block, block by block."""
    power, _ = _powers(HASH_BYTES + 1)
    total, scale, step = 0, 1, int(power[HASH_BYTES])
    for at in range(0, len(data), HASH_BYTES):
        part = data[at : at + HASH_BYTES]
        total += scale * int(np.sum((part.astype(_U) + _U(1)) * power[: len(part)], dtype=_U))
        scale = scale * step % (1 << 64)
    return total % (1 << 64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the disjoint ranges [start, end) of ``data``, in ascending order."""
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + HASH_BYTES, "right"))
        if to <= at:
            out[at] = _long_hash(data[base : int(ends[at])])
            at += 1
            continue
        power, inverse = _powers(HASH_BYTES + 1)
        span = int(ends[to - 1]) - base
        sums = np.empty(span + 1, _U)
        sums[0] = 0
        np.cumsum((data[base : base + span].astype(_U) + _U(1)) * power[:span], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * inverse[s]
        at = to
    return mix(out + _U(0xD6E8FEB86659FD93) * (ends - starts).astype(_U))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (n + 1) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [lo, hi) of about ``limit`` bytes, one document at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Docs:
    """The words of a run of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        """``offsets`` has n + 1 entries, from 0 to ``len(data)``."""
        self.n = len(offsets) - 1
        self.offsets = offsets
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data = data
        inside = ~SPACE[data] if len(data) else np.empty(0, bool)
        first = inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(data))]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
            self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.starts = self.ends = np.empty(0, np.int64)
        self.inside = inside
        #: Where each document's words begin in ``starts``; n + 1 entries.
        self.at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.at)

    def word_hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)


def window_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words: (hash, document, first word), document by document.

    A document of 1 to k - 1 words has its whole sequence as its one window.
    """
    n, docs = len(words), np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    left = (ends[docs] - np.arange(n)) if n else np.empty(0, np.int64)
    mult = [_U(pow(0xC2B2AE3D27D4EB4F | 1, j + 1, 1 << 64)) for j in range(k)]
    full = np.flatnonzero(left >= k)
    total = np.zeros(len(full), _U)
    for j in range(k):
        total += words[full + j] * mult[j]
    hashes, where = mix(total + _U(k)), full
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), _U)
        begin = ends[short] - counts[short]
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] += words[begin[has] + j] * mult[j]
        extra = mix(extra + counts[short].astype(_U))
        hashes, where = np.concatenate([hashes, extra]), np.concatenate([where, begin])
        order = np.argsort(where, kind="stable")
        hashes, where = hashes[order], where[order]
    return hashes, docs[where] if n else np.empty(0, np.int64), where


def distinct_by_doc(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document in ascending order, and their numbers (n)."""
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[keep], np.bincount(docs[keep], minlength=n)
