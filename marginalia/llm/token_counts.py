"""Token counts under a unigram model, by dynamic programming shared in a trie.

Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+``, each with the word mark in front.
The distinct ones of a worker are inserted in a trie. A node is a prefix and holds
the best score of a segmentation of that prefix and its number of tokens, computed
once when the node is made, so words with a common prefix share it. A word's count
is read at its terminal node. A pre-token of over ``LONG`` letters is counted by the same
recurrence outside the trie, of which only the last values are kept, so memory does not
grow with a pre-token.

The public piece vocabulary at hand is a merge vocabulary: its scores are ranks, not
probabilities. The unigram model is therefore made from its order: the log probability of
a piece is in proportion to 1 / (position + 1); a character without a piece costs its
UTF-8 bytes, one token each. The forward score of a prefix is that of its best
segmentation, since a count needs one; equal scores: fewer tokens, then less fallback.

Result for every row: doc_id, n_words, n_tokens, n_fallback (byte tokens, of the
chosen segmentation). A null or empty text has zeros; rows with a null or repeated id,
and repeated rows, are each returned; extra columns of any name are ignored. The trie is
emptied beyond ``max_nodes`` nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.public_vocab import default_path, pieces
from marginalia.llm.words import WordTable, quoted, split_slices, sum_by_doc, worker_table

WORD_MARK = "▁"
#: Log score of one fallback byte.
BYTE_SCORE = -20.0
#: Letters of a pre-token beyond which it shares no prefix and stays out of the trie: the same scores, but only the last ones are kept.
LONG = 1024


def piece_scores(path: str) -> dict[str, float]:
    """Log scores of the text pieces."""
    text, _ = pieces(path)
    order = sorted(text, key=text.get)
    total = math.log(sum(1 / (i + 1) for i in range(len(order))))
    return {piece: -math.log(i + 1) - total for i, piece in enumerate(order)}


class ForwardTrie:
    """Prefixes with the score, tokens and fallback bytes of their best segmentation."""

    def __init__(self, scores: dict[str, float], max_nodes: int = 1_500_000):
        self.scores, self.longest, self.max_nodes = scores, max(map(len, scores), default=1), max_nodes
        self._reset()

    def _reset(self) -> None:
        self.children: list[dict[str, int] | None] = [None]
        self.values: list[tuple[float, int, int]] = [(0.0, 0, 0)]

    def _best(self, word: str, i: int, past: list[tuple[float, int, int]], offset: int) -> tuple[float, int, int]:
        """(score, -tokens, -fallback bytes) of the prefix that ends with letter ``i``; ``past[j - offset]`` has those of the first j letters."""
        best, scores, end = None, self.scores, i + 1
        for j in range(max(0, end - self.longest), end):
            gain = scores.get(word[j:end])
            if gain is not None:
                score, tokens, fallback = past[j - offset]
                here = (score + gain, tokens - 1, fallback)
                if best is None or here > best:
                    best = here
        if word[i] not in scores:
            size = len(word[i].encode("utf-8", "surrogatepass"))
            score, tokens, fallback = past[i - offset]
            here = (score + BYTE_SCORE * size, tokens - size, fallback - size)
            if best is None or here > best:
                best = here
        return best

    def count(self, word: str) -> tuple[int, int]:
        """(tokens, fallback bytes) of the best segmentation of ``word``."""
        past, offset = [(0.0, 0, 0)], 0
        if len(word) > LONG:
            for i in range(len(word)):
                past.append(self._best(word, i, past, offset))
                if len(past) > LONG + self.longest:
                    offset += LONG
                    del past[:LONG]
            return -past[-1][1], -past[-1][2]
        if len(self.values) > self.max_nodes:
            self._reset()
        children, values, node = self.children, self.values, 0
        for i, letter in enumerate(word):
            below = children[node]
            if below is None:
                below = children[node] = {}
            step = below.get(letter)
            if step is None:
                step = below[letter] = len(values)
                children.append(None)
                values.append(self._best(word, i, past, 0))
            node = step
            past.append(values[node])
        return -values[node][1], -values[node][2]


def _describe(path: str, max_nodes: int):
    trie = ForwardTrie(piece_scores(path), max_nodes)

    def describe(words: list[bytes]) -> tuple[np.ndarray, ...]:
        found = {w: trie.count(WORD_MARK + w.decode("utf-8", "replace")) for w in sorted(words)}
        return (np.array([found[w] for w in words], np.int32).reshape(-1, 2),)

    return describe


def token_counts(docs: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = 1_500_000) -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_fallback)`` of every row."""
    path = vocabulary or default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(("token_counts", path, max_nodes), lambda: WordTable(_describe(path, max_nodes)))
        for batch in batches:
            for lo, hi, words, counts in split_slices(batch, 1):
                rows = table.index(words)
                sums = sum_by_doc(table.columns[0][rows], counts) if words else np.zeros((hi - lo, 2), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["doc_id", "n_words", "n_tokens", "n_fallback"])

    picked = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_fallback long")
