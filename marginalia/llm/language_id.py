"""Language ID with segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece (lower-cased letters, with or without
the word mark in front). The likelihood of a word is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its
words (runs of letters, lower-cased). The posterior with equal priors decides, ties to
the language that sorts first.

Fit: piece probabilities are estimated by expectation-maximisation over the counts of
all words of at most ``max_docs`` different rows a language (smallest hashes of id and text),
``max_rows`` in all: a bounded sample of labelled rows. Rows equal in id, language and text
count once, so neither repeated ids nor repeated rows widen the sample or empty it. Counts are smoothed towards the mean of all
languages. A letter without a piece has one fixed probability in all languages. Sums are
kept as logarithms, so words of any length are summed whole. The model that tasks get is
a number for each piece of the vocabulary and language.

A text that is null or has no letter is ``und`` with score 0, as every text is when
nothing was learned. Every row is returned, rows with a null or repeated id too; equal
texts score alike. Rows without a lang are never learned from. Extra columns of any name
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.public_vocab import default_path, pieces
from marginalia.llm.words import WordTable, quoted, split_slices, sum_by_doc, worker_table

WORD_MARK = "▁"
_RUN = regex.compile(r"\p{L}+")
UNKNOWN = 1e-7
#: Letters whose pieces are looked at together.
PART_LETTERS = 200_000
#: Numbers of a table of forward values.
_CELLS = 2_000_000


@lru_cache(maxsize=2)
def _automaton(path: str):
    """All lower-case pieces as one automaton: piece -> (number, length), how many there are, and the longest's length."""
    found = ahocorasick.Automaton()
    text, _ = pieces(path)
    kept = sorted(p for p in text if p == p.lower() and (p == WORD_MARK or p.removeprefix(WORD_MARK).isalpha()))
    for i, piece in enumerate(kept):
        found.add_word(piece, (i, len(piece)))
    found.make_automaton()
    return found, len(kept), max(map(len, kept), default=1)


def letter_words(token: str) -> list[str]:
    """The marked, lower-cased runs of letters of a token."""
    if token.isalpha():
        return [WORD_MARK + token.lower()]
    return [WORD_MARK + run.lower() for run in _RUN.findall(token)]


class Lattice:
    """All pieces in each of some words: edges (word, start, stop, piece), by stop, then word.

    Of a part of a longer word, ``skip`` letters only serve as context: edges that stop there are left out.
    """

    def __init__(self, words: list[str], path: str, skip: int = 0):
        automaton, n, _ = _automaton(path)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(lengths) - lengths
        hits = list(automaton.iter("".join(words)))
        end = np.fromiter((h[0] for h in hits), np.int64, len(hits)) + 1
        number = np.fromiter((h[1][0] for h in hits), np.int64, len(hits))
        size = np.fromiter((h[1][1] for h in hits), np.int64, len(hits))
        covered = np.zeros(int(lengths.sum()), bool)
        covered[end[size == 1] - 1] = True
        bare = np.flatnonzero(~covered)  # letters without a piece of their own: number n
        end, number, size = np.concatenate([end, bare + 1]), np.concatenate([number, np.full(len(bare), n)]), np.concatenate([size, np.ones(len(bare), np.int64)])
        word = np.searchsorted(begin, end - 1, "right") - 1
        self.lengths, self.skip = lengths, skip
        stop = end - begin[word]
        order = np.lexsort((word, stop))
        order = order[(stop[order] > skip) & (stop[order] >= size[order])]
        self.word, self.stop, self.start, self.piece = word[order], stop[order], (stop - size)[order], number[order]
        self.longest = int(lengths.max()) if len(words) else 0
        self.cut = np.searchsorted(self.stop, np.arange(1, self.longest + 2))

    def forward(self, logs: np.ndarray, alpha: np.ndarray, base: int = 0) -> np.ndarray:
        """Log forward values at the ends of the words (word, language); ``logs`` has a row for each piece.

        ``alpha`` (word, position modulo its width, language) holds the values of the last
        positions, as many as the longest piece needs; the first letter's position is ``base``.
        """
        width, out = alpha.shape[1], np.zeros((len(self.lengths), logs.shape[1]))
        for stop in range(self.skip + 1, self.longest + 1):
            lo, hi = self.cut[stop - 1], self.cut[stop]
            word = self.word[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            now = np.logaddexp.reduceat(alpha[word, (base + self.start[lo:hi]) % width] + logs[self.piece[lo:hi]], first, axis=0)
            alpha[word[first], (base + stop) % width] = now
            ends = self.lengths[word[first]] == stop
            out[word[first][ends]] = now[ends]
        return out

    def expected(self, logs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (piece, language) given word counts (word, language)."""
        n = len(self.lengths)
        alpha = np.full((n, self.longest + 1, logs.shape[1]), -np.inf)
        alpha[:, 0] = 0
        total = self.forward(logs, alpha)  # wide enough to hold every position
        beta = np.full_like(alpha, -np.inf)
        with np.errstate(divide="ignore"):
            beta[np.arange(n), self.lengths] = np.log(weights) - total
        out = np.zeros(logs.shape)
        for stop in range(self.longest, 0, -1):
            lo, hi = self.cut[stop - 1], self.cut[stop]
            word, start, piece = self.word[lo:hi], self.start[lo:hi], self.piece[lo:hi]
            flow = beta[word, stop] + logs[piece]
            np.add.at(out, piece, np.exp(flow + alpha[word, start]))
            np.logaddexp.at(beta, (word, start), flow)
        return out


def _parts(words: list[str], cells: int) -> Iterator[list[int]]:
    """Numbers of words, shorter ones first, in parts of at most ``PART_LETTERS`` letters and ``cells`` words, or of one word."""
    part: list[int] = []
    letters = 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if part and (letters + len(words[i]) > PART_LETTERS or len(part) >= cells):
            yield part
            part, letters = [], 0
        part.append(i)
        letters += len(words[i])
    if part:
        yield part


class PieceModel:
    """Languages and the log probabilities of the pieces in each (the last row: a letter without a piece)."""

    def __init__(self, languages: list[str], probability: np.ndarray, path: str):
        self.languages, self.path = languages, path
        self.logs = np.log(probability)
        self.key = hashlib.sha256(repr((languages, path)).encode() + self.logs.tobytes()).hexdigest()

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]], path: str, rounds: int = 3, smooth: float = 20.0) -> PieceModel:
        """``counts``: language -> word (marked, lower-cased) -> times."""
        languages = sorted(counts)
        words = sorted({w for c in counts.values() for w in c})
        _, n, _ = _automaton(path)
        weights = np.array([[counts[lang].get(w, 0) for lang in languages] for w in words], float).reshape(len(words), len(languages))
        lattices = [(Lattice([words[i] for i in part], path), weights[part]) for part in _parts(words, _CELLS // max(len(languages), 1))]

        def normal(uses: np.ndarray) -> np.ndarray:
            uses = uses.copy()
            uses[n] = 0
            shared = uses.sum(axis=1, keepdims=True) + 0.01
            shared[n] = 0
            uses = uses + smooth * shared / shared.sum()
            probability = uses / np.maximum(uses.sum(axis=0, keepdims=True), 1e-300)
            probability[n] = UNKNOWN
            return probability

        uses = np.zeros((n + 1, len(languages)))
        for lattice, weight in lattices:
            np.add.at(uses, lattice.piece, weight[lattice.word])
        probability = normal(uses)
        for _ in range(rounds if languages else 0):
            uses = np.zeros_like(probability)
            for lattice, weight in lattices:
                uses += lattice.expected(np.log(probability), weight)
            probability = normal(uses)
        return cls(languages, probability, path)

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """(word, language): over all segmentations of each whole word."""
        longest, many = _automaton(self.path)[2], len(self.languages)
        out = np.zeros((len(words), many))
        for part in _parts(words, _CELLS // max(many, 1) // (longest + 1) + 1):
            alpha = np.full((len(part), longest + 1, many), -np.inf)
            alpha[:, 0] = 0
            size = max(len(words[i]) for i in part)
            for at in range(0, max(size, 1), PART_LETTERS):  # a word longer than that is a part of its own, and read in pieces of so many letters
                skip = min(at, longest)
                lattice = Lattice([words[i][at - skip : at + PART_LETTERS] for i in part], self.path, skip)
                out[part] = lattice.forward(self.logs, alpha, at - skip)
        return out

    def describe(self, tokens: list[bytes]) -> tuple[np.ndarray, ...]:
        """Log likelihoods and numbers of words of distinct tokens."""
        parts = [letter_words(t.decode("utf-8", "replace")) for t in tokens]
        numbers = np.fromiter(map(len, parts), np.int64, len(parts))
        likelihood = self.log_likelihood([w for p in parts for w in p])
        return sum_by_doc(likelihood, numbers), numbers


#: So many of the commonest languages are thinned before their rows are ranked.
_THINNED = 10_000


def _chosen(known: DataFrame, max_docs: int, max_rows: int) -> DataFrame:
    """``(lang, print)`` of the rows to fit on: the ``max_docs`` smallest hashes of each language, ``max_rows`` in all.

    ``print`` is a hash of id and text. Of a language with many different rows only those with
    small hashes, about four times as many as are taken, are shuffled and ranked; the
    limits that tell them are broadcast. They come from the number of different hashes, not
    of rows: a language with few different rows is not thinned.
    """
    small = F.pmod(F.col("print"), F.lit(1 << 40))
    limits = known.groupBy("lang").agg(F.approx_count_distinct("print").cast("double").alias("many")).where(F.col("many") > 8 * max_docs)
    limits = limits.orderBy(F.desc("many"), "lang").limit(_THINNED).select("lang", (F.lit(float(4 * max_docs) * (1 << 40)) / F.col("many")).alias("most"))
    few = known.select("lang", "print").withColumn("h", small).join(F.broadcast(limits), "lang", "left").where("most is null or h <= most")
    few = few.select("lang", "h", "print").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "print"))
    return few.withColumn("n", rank).where(F.col("n") <= max_docs).orderBy("n", "lang", "h").limit(max_rows).select("lang", "print")


def fit_language_id(docs: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 400, max_rows: int = 25_600) -> PieceModel:
    """Fit on a bounded sample of ``docs``: of each language at most ``max_docs`` rows, ``max_rows`` in all. Filter ``docs`` to hold rows out."""
    path = vocabulary or default_path("piece_bpe_32k.model")
    text = quoted(text_col).cast("string")
    known = docs.select(quoted(lang_col).cast("string").alias("lang"), F.xxhash64(quoted(id_col).cast("long"), text).alias("print"), text.alias("text"))
    known = known.where("lang is not null and text is not null")
    sample = known.join(F.broadcast(_chosen(known, max_docs, max_rows)), ["lang", "print"])  # at most max_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            rows: list[tuple[str, int, str, int]] = []
            for lang, print_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, print_) not in seen:
                    seen.add((lang, print_))
                    rows += [(lang, print_, word, n) for word, n in Counter(letter_words(text)).items()]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "print", "word", "n"])

    each = sample.select("lang", "print", "text").mapInArrow(run, "lang string, print long, word string, n long")
    # copies of a row in other tasks have the same counts
    words = each.groupBy("lang", "print", "word").agg(F.max("n").alias("n")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for row in words.collect():  # the distinct words of the sample
        counts.setdefault(row.lang, {})[row.word] = row.n
    return PieceModel.fit(counts, path)


def identify(docs: DataFrame, model: PieceModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every row."""
    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, "und"], object)
        table = worker_table(("language_id", known.key), lambda: WordTable(known.describe, max(_CELLS // max(len(known.languages), 1), 1000)))
        for batch in batches:
            for lo, hi, words, counts in split_slices(batch, 1):
                n = hi - lo
                pick, score = np.full(n, len(known.languages)), np.zeros(n)
                if words and known.languages:
                    rows = table.index(words)
                    total = sum_by_doc(table.columns[0][rows].astype(np.float64), counts)
                    some = sum_by_doc(table.columns[1][rows], counts) > 0
                    odds = np.exp(total - total.max(axis=1, keepdims=True))
                    odds /= odds.sum(axis=1, keepdims=True)
                    pick = np.where(some, odds.argmax(axis=1), pick)
                    score = np.where(some, odds.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(names[pick], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    picked = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, lang_pred string, score double").toDF(id_col, "lang_pred", "score")
