"""Secret scan: fixed patterns, and novelty under a dictionary-primed zstandard compressor.

Base kinds, leftmost matches that do not overlap others of their kind: ``assign``
(a secret's name, ``:`` or ``=``, a value of 8 characters or more), ``access``
(``AKIA...``, 16 or more), ``hex`` (32 or more). Letters of a name match in either
case, ASCII only.

``novel`` spans are added by measuring. Candidates are runs of 16 or more characters
of base64, hex or url alphabets, whatever their shape, in sensitive context, that touch
no base span. Runs that follow one another with at most 64 characters between them (lines
of a key block, items of a list) are a chain; a chain is in sensitive context as a whole
where one of its runs lies within 64 characters of a sensitive name, before or after it.
Of a run that holds a name and is not novel as a whole, the parts between names are
measured. The compressor is primed with a dictionary of identifiers and of the words of a
public vocabulary; a candidate's novelty is the number of bytes it adds to the compressed
surrounding text (ordinary prose, for its letter frequencies, and 200 characters on either
side without its own copies, so a repeated secret does not explain itself). A string that
the context or the dictionary already explains adds a few bytes; a candidate that adds
0.6 bytes a character or more is reported.

Offsets are code points, ends exclusive. A null text is an empty one. Every row is
returned.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.public_vocab import default_path, rank_file
from marginalia.llm.words import quoted, release_tables, spare

KINDS = ["assign", "access", "hex", "novel"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is always taken whole, so shorter runs can be passed over
_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "api key", "access_key", "access-key", "accesskey", "auth", "bearer", "credential", "private")
_SENSITIVE = re.compile("|".join(_NAMES), re.ASCII | re.IGNORECASE)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile("[a-zà-ÿ]{4,}")
REACH, MARGIN, LEAST_NOVELTY, LEVEL = 64, 200, 0.6, 19
# Identifiers that prime the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret client_id authorization bearer basic credential username user email host hostname port database "
    "config configuration environment production development staging example sample placeholder changeme your-token-here your_api_key_here xxxxxxxxxxxxxxxx 0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "abcdefghijklmnopqrstuvwxyz 0123456789 00000000-0000-0000-0000-000000000000 session request response header headers content-type application/json https://www. .com .org .net "
    "function return import export const static public class def self this null none true false string number integer boolean object array version release build commit branch master main "
    "sha256 sha512 base64 encode decode encrypt decrypt signature certificate BEGIN END PUBLIC PRIVATE KEY rsa id uuid timestamp created_at updated_at get set create update delete select insert"
)
# Text that gives the compressor the letter frequencies of prose where the surroundings are short.
ORDINARY = (
    "It rained all week, so she read her book by the window; he wrote letters home. Im Garten blühten Rosen, niemand kam vorbei. Le chat dort encore sous la vieille table. "
    "Los niños juegan cerca del río. Go to step-by-step notes, see my_file_name or someValueHere, e.g. one-off or up-to-date text.\n"
)


def _dictionary() -> bytes:
    """Identifiers, and before them the longer words of a public vocabulary, common ones last: as in slugs, and with capitals."""
    ranked = (t.decode("utf-8", "ignore").strip().lower() for t in islice(rank_file(default_path("byte_bpe_multi_50k.tiktoken")), 20_000))
    words = [t for t in dict.fromkeys(ranked) if _WORD.fullmatch(t)][::-1]
    return ("".join(w.title() for w in words[-8000:]) + "-".join(words) + IDENTIFIERS).encode()


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(_dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(text: str, start: int, end: int) -> float:
    """Compressed bytes that [start, end) adds to its surroundings, for each of its characters."""
    own = text[start:end]
    around = ORDINARY + (text[max(0, start - MARGIN) : start] + text[end : end + MARGIN]).replace(own, "")
    size = _compressor()
    without = len(size.compress(around.encode("utf-8", "surrogatepass")))
    return (len(size.compress(f"{around}\n{own}".encode("utf-8", "surrogatepass"))) - without) / (end - start)


def base_spans(text: str, lowered: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    lowered = text.lower() if lowered is None else lowered
    found = []
    if any(name in lowered for name in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def _candidates(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, names inside) of the runs of chains that lie near a sensitive name."""
    names = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [s for s, _ in names], [e for _, e in names]
    found, chain, near = [], [], False
    for m in _CANDIDATE.finditer(text):
        if chain and m.start() > chain[-1][1] + REACH:
            found += chain if near else []
            chain, near = [], False
        inside = names[bisect_left(starts, m.start()) : bisect_left(starts, m.end())]
        chain.append((m.start(), m.end(), [n for n in inside if n[1] <= m.end()]))
        first = bisect_left(ends, m.start() - REACH)
        near = near or (first < len(names) and starts[first] <= m.end() + REACH)
    return found + (chain if near else [])


def novel_spans(text: str, base: list[tuple[int, int, str]], lowered: str | None = None) -> list[tuple[int, int, str]]:
    """Incompressible strings in sensitive context that touch no base span."""
    lowered = text.lower() if lowered is None else lowered
    if not any(name in lowered for name in _NAMES):
        return []
    starts, upto = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))

    def is_novel(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return (not before or upto[before - 1] <= start) and novelty(text, start, end) >= LEAST_NOVELTY

    found = []
    for start, end, names in _candidates(text):
        if is_novel(start, end):
            found.append((start, end, "novel"))
        elif names:
            edges = [start, *(x for name in names for x in name), end]
            found += [(s, e, "novel") for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s >= 16 and is_novel(s, e)]
    return found


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    lowered = text.lower()
    base = base_spans(text, lowered)
    both = base + novel_spans(text, base, lowered)
    return base, sorted(both, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    parts, at, upto = [], 0, -1
    for start, end, _ in spans:
        if start >= upto:
            parts += [text[at:start], "[SECRET]"]
        upto = at = max(upto, end)
    return "".join([*parts, text[at:]])


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_novel, base_sha256, spans)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                base, both = scan(text.as_py() or "")
                kinds = [k for _, _, k in both]
                out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True))], names)

    names = ["id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
    picked = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    found = picked.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
    return found.toDF(id_col, *names[1:])


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets of each text replaced by ``[SECRET]`` and its length renewed.

    A null text stays null. Other columns are untouched.
    """

    @F.pandas_udf("string")
    def clean(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_tables()
        for texts in frames:
            yield texts.map(lambda t: t if t is None else _redacted(t, scan(t)[1]))

    cleaned = spare(docs.columns, "cleaned")
    out = docs.select("*", clean(quoted(text_col).cast("string")).alias(cleaned))
    new = {text_col: quoted(cleaned)}
    if length_col and length_col in docs.columns:
        new[length_col] = F.length(cleaned).cast(docs.schema[length_col].dataType)
    return out.select(*(new[c].alias(c) if c in new else quoted(c) for c in docs.columns))
