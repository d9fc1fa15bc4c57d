"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word is labelled good or bad. Its features are shares of kinds of
characters, word lengths, repeats within the line and of earlier lines, and the same
of the line before and after. Forward-backward gives each line's marginal probability
to be good; the mean of those, weighted by the lines' characters, is the text's score.

Fit: on at most ``max_docs`` labelled texts, a bounded sample: of at most as many ids (those
with the smallest hashes) the different texts with the smallest hashes of id and text. Of equal
rows one is taken, so the bound holds however often an id repeats; an id labelled both ways
counts as good. Lines inherit their text's label; lines of bad texts that a
logistic model on single lines takes for good (a sound header above junk) are then
relabelled good, and the chain is fitted to those labels. A labelled sample with one
class only, or none, gives a constant score.

A null or empty text has no line and scores the prior share of good texts, as a text
without words does; in any text the prior weighs as one character. Every row is
returned, rows with a null or repeated id and equal rows too (equal texts score alike); labels
with a null id or label take no part. Extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.textkernel import Docs, range_hashes, slices, string_buffer
from marginalia.llm.words import quoted

_KINDS = 6  # lower letter, upper letter, digit, symbol, other ASCII punctuation, first byte of a longer character


def _kind_table() -> np.ndarray:
    table = np.full(256, _KINDS, np.uint8)
    for byte in range(33, 127):
        c = chr(byte)
        table[byte] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "#*$%&|<>" else 4
    table[0xC2:0xF5] = 5
    return table


_KIND_OF = _kind_table()
N_FEATURES = 11


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, lines of each document, characters of each line."""
    docs = Docs(data, offsets)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    owner = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[owner + 1]) if len(starts) else starts
    first, last = np.searchsorted(docs.starts, starts), np.searchsorted(docs.starts, ends)
    keep = last > first
    starts, ends, owner, first, last = (x[keep] for x in (starts, ends, owner, first, last))
    n, words = len(starts), (last - first).astype(np.float64)
    kinds = _KIND_OF[data]
    count = np.empty((n, _KINDS))
    for k in range(_KINDS):
        sums = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        count[:, k] = sums[ends] - sums[starts]
    chars = count.sum(axis=1)
    size, letters = np.maximum(chars, 1), np.maximum(count[:, 0] + count[:, 1] + count[:, 5], 1)
    hashes = docs.word_hashes()
    line = np.repeat(np.arange(n), last - first)
    inside = hashes[np.repeat(first - np.cumsum(last - first) + (last - first), last - first) + np.arange(int((last - first).sum()))] if n else hashes[:0]
    order = np.lexsort((inside, line))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (inside[order][1:] != inside[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=n)
    same = (inside[1:] == inside[:-1]) & (line[1:] == line[:-1])
    adjacent = np.bincount(line[1:][same], minlength=n)
    of_line = range_hashes(data, starts, ends)
    order = np.lexsort((np.arange(n), of_line, owner))
    again = np.zeros(n)
    if n:
        again[order[1:]] = (of_line[order][1:] == of_line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    features = np.stack([
        np.log1p(chars) / 8, (count[:, 0] + count[:, 5]) / size, count[:, 1] / letters, count[:, 2] / size, count[:, 3] / size, count[:, 4] / size,
        np.minimum(chars / words / 12, 2), distinct / words, adjacent / words, again, words <= 1,
    ], axis=1)
    return features, np.bincount(owner, minlength=docs.n), chars


def with_neighbours(features: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after in its text (zeros at its ends), and 1."""
    n = len(features)
    own = np.repeat(np.arange(len(lines)), lines)
    before, after = np.zeros_like(features), np.zeros_like(features)
    if n > 1:
        joined = (own[1:] == own[:-1])[:, None]
        before[1:] = features[:-1] * joined
        after[:-1] = features[1:] * joined
    return np.concatenate([features, before, after, np.ones((n, 1))], axis=1)


def forward_backward(unary: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probabilities of state 1, and the expected numbers of transitions (2, 2).

    ``unary``: log odds of state 1; ``transition``: log potentials; ``lines``: lengths of the chains.
    """
    n = len(unary)
    good = 1 / (1 + np.exp(-np.clip(unary, -500, 500)))
    emit = np.stack([1 - good, good], axis=1)
    move = np.exp(transition - transition.max())
    order = np.argsort(-lines, kind="stable")
    begin = (np.cumsum(lines) - lines)[order]
    length = lines[order]
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) if len(length) else 0)]  # chains longer than t
    alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    for t, k in enumerate(alive):
        at = begin[:k] + t
        now = emit[at] * (0.5 if t == 0 else alpha[at - 1] @ move)
        scale[at] = now.sum(axis=1)
        alpha[at] = now / scale[at][:, None]
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        beta[at] = (emit[at + 1] * beta[at + 1] / scale[at + 1][:, None]) @ move.T
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    heads = np.zeros(n, bool)
    heads[begin[length > 0]] = True
    to = np.flatnonzero(~heads)
    pair = alpha[to - 1][:, :, None] * move * (emit[to] * beta[to] / scale[to][:, None])[:, None, :]
    total = np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
    return marginal[:, 1], (pair / total).sum(axis=0)


def _ascend(gradient, size: int, rounds: int, rate: float) -> np.ndarray:
    """Adam, upwards."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return x


class LineCRF:
    """A fitted chain: weights of the features and potentials of the transitions."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, transition: np.ndarray, prior: float):
        self.mean, self.spread, self.weights, self.transition, self.prior = mean, spread, weights, transition, prior

    @classmethod
    def fit(cls, features: np.ndarray, lines: np.ndarray, labels: np.ndarray, rounds: int = 150) -> LineCRF:
        prior = float((labels.sum() + 1) / (len(labels) + 2))
        mean, spread = (features.mean(axis=0), features.std(axis=0) + 1e-6) if len(features) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        width = 3 * N_FEATURES + 1
        if len(features) == 0 or labels.min() == labels.max():
            return cls(mean, spread, np.append(np.zeros(width - 1), np.log(prior / (1 - prior))), np.zeros((2, 2)), prior)
        x = with_neighbours((features - mean) / spread, lines)
        y = np.repeat(labels, lines).astype(float)
        n = len(x)
        single = _ascend(lambda w: x.T @ (y - 1 / (1 + np.exp(-x @ w))) / n - 1e-4 * w, width, rounds, 0.1)
        y = np.where((y == 0) & (x @ single > 0), 1.0, y)
        own = np.repeat(np.arange(len(lines)), lines)
        joined = own[1:] == own[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][joined].astype(int), y[1:][joined].astype(int)), 1)

        def gradient(p: np.ndarray) -> np.ndarray:
            marginal, pairs = forward_backward(x @ p[:width], p[width:].reshape(2, 2), lines)
            return np.concatenate([x.T @ (y - marginal) / n, ((seen - pairs) / n).ravel()]) - 1e-4 * p

        found = _ascend(gradient, width + 4, rounds, 0.1)
        return cls(mean, spread, found[:width], found[width:].reshape(2, 2), prior)

    def score(self, features: np.ndarray, lines: np.ndarray, chars: np.ndarray) -> np.ndarray:
        x = with_neighbours((features - self.mean) / self.spread, lines)
        good, _ = forward_backward(x @ self.weights, self.transition, lines)
        own = np.repeat(np.arange(len(lines)), lines)
        total = np.bincount(own, weights=good * chars, minlength=len(lines)) + self.prior
        return np.clip(total / (np.bincount(own, weights=chars, minlength=len(lines)) + 1), 0, 1)


def fit_line_crf(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 1500) -> LineCRF:
    """Fit on at most ``max_docs`` of the labelled rows. Filter ``labels`` to hold rows out."""
    ids = labels.select(quoted(id_col).cast("long").alias("id"), (quoted(label_col) > 0).cast("int").alias("label")).where("id is not null and label is not null")
    ids = ids.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids), "id").withColumn("print", F.xxhash64("text"))
    # one id may hold any number of texts, equal ones too
    taken = texts.select("id", "print").distinct().orderBy(F.xxhash64("id", "print"), "id", "print").limit(max_docs)
    sample = texts.join(F.broadcast(taken), ["id", "print"]).select("id", "print", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            fresh = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            batch = batch.take(pa.array(fresh, pa.int64()))
            data, offsets = string_buffer(batch.column(3))
            for lo, hi in slices(offsets):
                features, lines, _ = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                packed = [x.astype(np.float32).tobytes() for x in np.split(features, np.cumsum(lines)[:-1])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(packed, pa.binary())], ["id", "print", "label", "features"])

    found = sample.mapInArrow(run, "id long, print long, label int, features binary").dropDuplicates(["id", "print"])
    rows = sorted(found.collect(), key=lambda r: (r.id, bytes(r.features)))
    parts = [np.frombuffer(r.features, np.float32).reshape(-1, N_FEATURES).astype(float) for r in rows]
    lines = np.array([len(p) for p in parts], np.int64)
    return LineCRF.fit(np.concatenate(parts) if parts else np.zeros((0, N_FEATURES)), lines, np.array([r.label for r in rows], np.int64))


def score_quality(docs: DataFrame, model: LineCRF, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, n_lines)`` of every row."""
    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                features, lines, chars = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                score = model.score(features, lines, chars)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array(lines.astype(np.int64))], ["id", "score", "n_lines"])

    picked = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, score double, n_lines long").toDF(id_col, "score", "n_lines")
