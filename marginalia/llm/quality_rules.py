"""Quality rules: counts of words and repeats, and the fertility of a public tokeniser.

Words are ``[^\\x20\\x09-\\x0D]+``. Base rules: under ``min_words`` words, or words in
repeated 3-word windows over half of all. The method's rule looks at how the text
falls apart under a fixed public vocabulary: characters per token (code points in words,
of whatever kind), share of byte-fallback tokens, and entropy of the text's tokens (bits).
Each script has a band; a document outside the band of its dominant script, by letters, is
rejected; a text without letters has the band ``none``. Entropy is held against what texts
of so many tokens have: a curve over log2(tokens) that ``fit_bands`` takes from texts labelled
good. Random letters of a script have the entropy of its texts and pass.

Null and empty texts have zero counts and fail the base rule. Every row is returned, rows
with a null or repeated id and repeated rows too; equal texts have equal verdicts. Extra
columns of any name are ignored, or carried along by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.public_vocab import default_path, piece_model, pieces
from marginalia.llm.textkernel import Docs, range_hashes, slices, string_buffer, window_hashes
from marginalia.llm.words import WordTable, quoted, sum_by_doc, worker_table
from marginalia.plans.scratch import materialize

#: Distinct words that a worker keeps.
CAPACITY = 150_000
#: Bytes of text that are judged together; one longer document is judged alone.
JUDGED = 500_000
SYMBOLS = b"#*$%&|<>"
# Names of the scripts that have a band of their own.
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Tamil", "Telugu", "Thai", "Lao", "Georgian", "Ethiopic", "Khmer", "Hangul", "Hiragana", "Katakana", "Han", "other", "none"]


class Band(NamedTuple):
    """What a script's texts must keep to; entropy in bits, tokens as their binary logarithm x.

    The floor of entropy is ``share * x``, at most ``cap``. Texts of at most ``upto``
    characters a token, as the calibrated ones have, must also reach ``curve[0] + curve[1] * x +
    curve[2] * x * x - slack``, with x held within ``span``. Longer tokens carry more each, so the curve
    does not bind such texts.
    """

    least: float
    most: float
    fallback: float
    share: float
    cap: float
    upto: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    slack: float = 0.0
    span: tuple[float, float] = (0.0, 0.0)


# Alphabets whose letters the vocabulary holds need half a character a token (a letter and the word mark); scripts
# that fall back to bytes need a quarter, which is what a character of four bytes has, and since their tokens are
# bytes less entropy can be asked for. Texts without letters are mostly digits, each a token: at most eleven kinds
# (3.5 bits) unless they hold more than numbers. There are no labelled texts of these.
_LETTERS, _BYTES = Band(0.50, 8.0, 0.50, 0.50, 4.5), Band(0.25, 12.0, 0.95, 0.40, 4.0)
#: Latin: ``fit_bands`` on the training rows of sf0.1 (crc32 of the id modulo 5 not 0); ``least`` and ``most`` are
#: wider than what it found (1.85 and 2.35 characters a token), since those texts are of short words.
LATIN = Band(1.20, 8.0, 0.10, 0.50, 3.6, 2.48, (1.4789, 0.8856, -0.03657), 0.402, (6.71, 12.1))
BANDS = {name: _BYTES for name in SCRIPTS} | {name: _LETTERS for name in ("Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic")} | {"Latin": LATIN, "none": Band(1.0, 12.0, 0.95, 0.50, 4.0)}
#: Code points beyond this have no letters of these scripts worth a table.
_LAST = 0x32000


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    """Code point -> number of the script whose letter it is; the last for what is no letter."""
    table = np.full(_LAST, len(SCRIPTS) - 1, np.uint8)
    points = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(_LAST))
    for pattern, number in [(r"\p{L}", len(SCRIPTS) - 2)] + [(rf"[\p{{L}}&&\p{{Script={name}}}]", i) for i, name in enumerate(SCRIPTS[:-2])]:
        for found in regex.finditer(rf"(?V1){pattern}+", points):
            table[found.start() : found.end()] = number
    return table


def letters_by_script(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Letters of each script in each document (document, script)."""
    table, n = _script_table(), len(offsets) - 1
    many = len(SCRIPTS)
    kinds = np.where(data < 128, table[data], many - 1)
    at = np.flatnonzero(data >= 0xC2)  # first bytes of longer characters
    if len(at):
        lead, next_ = data[at].astype(np.int64), [data[np.minimum(at + j, len(data) - 1)].astype(np.int64) & 63 for j in (1, 2, 3)]
        two, three, four = (lead & 31) << 6 | next_[0], (lead & 15) << 12 | next_[0] << 6 | next_[1], (lead & 7) << 18 | next_[0] << 12 | next_[1] << 6 | next_[2]
        point = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
        kinds[at] = np.where(point < _LAST, table[np.minimum(point, _LAST - 1)], many - 1)
    spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    return np.array([np.bincount(kinds[a:b], minlength=many) for a, b in spans]).reshape(n, many)[:, :-1]


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document."""
    docs = Docs(data, offsets)
    out = {"n_words": docs.counts.astype(np.int64)}

    spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))

    def total(mask: np.ndarray) -> np.ndarray:
        return np.array([np.count_nonzero(mask[a:b]) for a, b in spans], np.int64)

    out["word_chars"] = total(docs.inside & ((data & 0xC0) != 0x80))
    out["n_symbols"] = total(_IS_SYMBOL[data])
    # lines with a word that equal an earlier line
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    inner = np.searchsorted(breaks, line_starts)
    owner = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(breaks, len(data))[inner], offsets[owner + 1]) if len(line_starts) else line_starts
    with_word = np.searchsorted(docs.starts, line_ends) > np.searchsorted(docs.starts, line_starts)
    line_starts, line_ends, owner = line_starts[with_word], line_ends[with_word], owner[with_word]
    hashes = range_hashes(data, line_starts, line_ends)
    order = np.lexsort((hashes, owner))
    again = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][1:][again], minlength=docs.n).astype(np.int64)
    # words in 3-word windows that occur twice or more
    words = docs.word_hashes()
    long_enough = docs.counts >= 3
    windows, of, first = window_hashes(words, docs.counts, 3)
    keep = long_enough[of]
    windows, of, first = windows[keep], of[keep], first[keep]
    order = np.lexsort((windows, of))
    same = (windows[order][1:] == windows[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = first[order][twice]
    marked = np.zeros(len(words) + 1, bool)
    for j in range(3):
        marked[begin + j] = True
    sums = np.concatenate([[0], np.cumsum(marked[:-1], dtype=np.int64)])
    out["n_repeat_words"] = sums[docs.at[1:]] - sums[docs.at[:-1]]
    return out


def _describe(path: str):
    model = piece_model(path)
    _, byte_ids = pieces(path)
    byte_id = np.zeros(model.get_piece_size(), bool)
    byte_id[list(byte_ids)] = True

    def describe(words: list[bytes]) -> tuple[np.ndarray, ...]:
        coded = model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for ids in coded for i in ids), np.int32, int(sizes.sum()))
        return sizes, np.array(sum_by_doc(byte_id[flat].astype(np.int64), sizes)), flat

    return describe


class TokenTable(WordTable):
    """Words with the ids of their tokens: counts, byte tokens and, one after another, the ids."""

    def _reset(self) -> None:
        super()._reset()
        self.flat, self.flat_used, self.begin = np.zeros(1 << 16, np.int32), 0, np.zeros(0, np.int64)

    def _append(self, new: tuple[np.ndarray, ...]) -> None:
        sizes, byte, flat = new
        if self.flat_used + len(flat) > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.flat_used + len(flat)), np.int32)
            grown[: self.flat_used] = self.flat[: self.flat_used]
            self.flat = grown
        self.flat[self.flat_used : self.flat_used + len(flat)] = flat
        begin = self.flat_used + np.cumsum(sizes) - sizes
        self.flat_used += len(flat)
        super()._append((sizes, byte, begin))


def fertility(table: TokenTable, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and entropy (bits) of each document."""
    if not words:
        zero = np.zeros(len(counts), np.int64)
        return zero, zero, zero.astype(float)
    rows = table.index(words)
    sizes, byte, begin = (c[rows] for c in table.columns)
    tokens, fallback = sum_by_doc(sizes, counts), sum_by_doc(byte, counts)
    ends = np.cumsum(sizes)
    ids = table.flat[np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]))]
    key = np.repeat(np.arange(len(counts)), tokens) * (1 << 20) + ids
    key.sort()
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(cut, len(key)))
    own = key[cut] >> 20
    entropy = np.log2(np.maximum(tokens, 1)) - np.bincount(own, weights=times * np.log2(times), minlength=len(counts)) / np.maximum(tokens, 1)
    return tokens, fallback, np.maximum(entropy, 0.0)


def in_band(script: np.ndarray, chars: np.ndarray, tokens: np.ndarray, fallback: np.ndarray, entropy: np.ndarray, bands: dict[str, Band] | None = None) -> np.ndarray:
    """The method's verdict: within the band of the document's script."""
    bands = bands or BANDS
    table = np.array([[*b[:6], *b.curve, b.slack, *b.span] for b in map(bands.__getitem__, SCRIPTS)])[script]
    least, most, share_fallback, share, cap, upto, c0, c1, c2, slack, low, high = table.T
    size = np.maximum(tokens, 1)
    ratio, x = chars / size, np.log2(size)
    held = np.clip(x, low, high)
    floor = np.minimum(share * x, cap)
    floor = np.where(ratio <= upto, np.maximum(floor, c0 + c1 * held + c2 * held * held - slack), floor)
    return (tokens > 0) & (ratio >= least) & (ratio <= most) & (fallback <= share_fallback * size) & (entropy >= floor)


_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_fallback", "entropy", "script", "base_failed", "kept"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_fallback long, entropy double, script string, base_failed boolean, kept boolean"


def _judge(table: TokenTable, data: np.ndarray, offsets: np.ndarray, min_words: int, bands: dict[str, Band] | None = None) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    out = base_counts(data, offsets)
    raw, at, words = data.tobytes(), offsets.tolist(), []
    for i in range(n):
        words += raw[at[i] : at[i + 1]].split()
    tokens, fallback, entropy = fertility(table, words, out["n_words"])
    letters = letters_by_script(data, offsets)
    script = np.where(letters.any(axis=1), letters.argmax(axis=1), len(SCRIPTS) - 1)
    failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out |= {"n_tokens": tokens, "n_fallback": fallback, "entropy": entropy, "script": np.array(SCRIPTS, object)[script], "base_failed": failed}
    return out | {"kept": ~failed & in_band(script, out["word_chars"], tokens, fallback, entropy, bands)}


def quality_rules(docs: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, bands: dict[str, Band] | None = None) -> DataFrame:
    """Counts, fertility and verdict of every row."""
    path = vocabulary or default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(("quality_rules", path), lambda: TokenTable(_describe(path), CAPACITY))
        for batch in batches:
            data, offsets = string_buffer(batch.column(1))
            for lo, hi in slices(offsets, JUDGED):
                found = _judge(table, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], min_words, bands)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(found[c]) for c in _COLUMNS[1:])], _COLUMNS)

    picked = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, vocabulary: str | None = None, *, text_col: str = "text", min_words: int = 50, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; no shuffle."""
    path = vocabulary or default_path("piece_bpe_32k.model")

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(("quality_rules", path), lambda: TokenTable(_describe(path), CAPACITY))
        for batch in batches:
            data, offsets = string_buffer(batch.column(at))
            kept = np.empty(batch.num_rows, bool)
            for lo, hi in slices(offsets, JUDGED):
                kept[lo:hi] = _judge(table, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], min_words, bands)["kept"]
            yield batch.filter(pa.array(kept))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold anything
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def fit_bands(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least_texts: int = 100, outside: float = 0.0005) -> dict[str, Band]:
    """``BANDS`` with the curves, and the ranges of characters a token, of all texts labelled good.

    Scripts with fewer than ``least_texts`` of them keep their band. Filter ``labels`` to hold rows out. The
    curve is the least-squares parabola of entropy over log2(tokens); ``outside`` is the share of good
    texts that may lie below it less the slack. Sums and quantiles by script are all that the driver sees.
    """
    good = labels.where(quoted(label_col) > 0).select(quoted(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    texts = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).join(good, "doc_id", "left_semi")
    known = quality_rules(texts).where("not base_failed and n_tokens > 0")
    known = materialize(known.select("script", F.log2("n_tokens").alias("x"), F.col("entropy").alias("y"), (F.col("word_chars") / F.col("n_tokens")).alias("ratio")))
    powers = [F.sum(F.pow("x", F.lit(i))).alias(f"x{i}") for i in range(5)] + [F.sum(F.pow("x", F.lit(i)) * F.col("y")).alias(f"y{i}") for i in range(3)]
    out = dict(BANDS)
    for row in known.groupBy("script").agg(F.count(F.lit(1)).alias("n"), *powers).where(F.col("n") >= least_texts).collect():
        matrix = np.array([[row[f"x{i + j}"] for j in range(3)] for i in range(3)])
        curve = np.linalg.lstsq(matrix, np.array([row[f"y{i}"] for i in range(3)]), rcond=None)[0]
        over = F.col("y") - sum(F.pow("x", F.lit(i)) * float(c) for i, c in enumerate(curve))
        mine = known.where(F.col("script") == row.script)
        found = mine.agg(F.percentile_approx(over, outside, 100_000).alias("low"), F.percentile_approx("ratio", F.array(F.lit(outside), F.lit(1 - outside)), F.lit(100_000)).alias("ratio"), F.min("x").alias("from"), F.max("x").alias("to")).first()
        old = out[row.script]
        # a parabola that opens downwards must not turn down within the span
        top = -curve[1] / (2 * curve[2]) if curve[2] < 0 else found["to"]
        out[row.script] = old._replace(
            least=min(old.least, found.ratio[0]), most=max(old.most, found.ratio[1]), upto=found.ratio[1] * 1.03,
            curve=tuple(map(float, curve)), slack=1.1 * max(-found.low, 0.0), span=(found["from"], min(found["to"], float(top))),
        )
    return out
