"""Poisson weights of many items and resamples at once, equal to ``stats.poisson_weight`` (12.1).

The md5 of ``seed:iteration:item`` is made for a block of items and all iterations together, as arrays of
32-bit words; texts of more than one md5 block, and nulls, go through ``hashlib``.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Chances of at most 0 to 7 events of a Poisson distribution of mean 1; the constants of md5.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]
LIMITS = [math.ceil(p * 2.0**32) for p in POISSON]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
#: Bytes of a text that fit one md5 block; hashes that are made together.
ONE_BLOCK, AT_ONCE = 55, 8192


def _first_word(words: list) -> np.ndarray:
    """The first 32 bits of the md5 of one-block messages; ``words`` are arrays of one shape, or 0."""
    shape = next(w.shape for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(_SINES[i])
        if isinstance(words[at], np.ndarray):
            f += words[at]
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        f <<= np.uint32(turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    return a.byteswap()


def _words(text: bytes, at: int) -> np.ndarray:
    return np.frombuffer((b"\0" * at + text).ljust(56, b"\0"), "<u4")


def weights(seed: int, items: list[str | None], iterations: int) -> np.ndarray:
    """How often each item is in each resample: an array of items x iterations."""
    heads = [f"{seed}:{i}:".encode() for i in range(iterations)]
    lengths, kind = np.unique([len(h) for h in heads], return_inverse=True)
    known = [None if x is None else x.encode() for x in items]
    fits = [x is not None and len(x) + lengths[-1] <= ONE_BLOCK for x in known]
    drawn = np.empty((len(items), iterations), np.uint32)
    for i in (i for i, fit in enumerate(fits) if not fit):
        texts = (h[:-1] if known[i] is None else h + known[i] for h in heads)
        drawn[i] = [int.from_bytes(hashlib.md5(x, usedforsecurity=False).digest()[:4], "big") for x in texts]
    rows = [i for i, fit in enumerate(fits) if fit]
    before = np.array([_words(h, 0) for h in heads])
    size = max(1, AT_ONCE // iterations)
    for block in (rows[i : i + size] for i in range(0, len(rows), size)):
        after = np.array([[_words(known[i] + b"\x80", n) for n in lengths] for i in block])
        used = -(-int(lengths[-1] + max(len(known[i]) for i in block) + 1) // 4)
        message = [after[:, kind, j] | before[:, j] for j in range(used)] + [0] * (14 - used)
        bits = 8 * (np.array([[len(known[i])] for i in block]) + lengths[kind])
        drawn[block] = _first_word([*message, bits.astype(np.uint32), 0])
    out = np.zeros(drawn.shape, np.int8)
    for limit in LIMITS:
        out += drawn >= np.uint32(limit)
    return out


def sums_of(iterations: int):
    """For ``mapInArrow``: rows (grp, seed, item, value) to (grp, iteration, above, below), the sums of weight x value and of weights in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = defaultdict(lambda: [np.zeros(iterations), np.zeros(iterations, np.int64)])
        for batch in batches:
            groups: dict[tuple[str, int], list[tuple[str | None, float]]] = defaultdict(list)
            for grp, seed, item, value in zip(*(batch.column(c).to_pylist() for c in ("grp", "seed", "item", "value")), strict=True):
                groups[grp, seed].append((item, value))
            for (grp, seed), rows in groups.items():
                size = max(1, (64 * AT_ONCE) // iterations)
                for at in range(0, len(rows), size):
                    part = rows[at : at + size]
                    drawn = weights(seed, [item for item, _ in part], iterations)
                    sums[grp][0] += np.array([value for _, value in part], float) @ drawn
                    sums[grp][1] += drawn.sum(0, dtype=np.int64)
        for grp, (above, below) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([grp] * iterations, pa.string()), pa.array(range(iterations), pa.int32()), pa.array(above), pa.array(below)], ["grp", "iteration", "above", "below"])

    return run
