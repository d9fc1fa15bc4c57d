"""Numeric and hashing functions as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n: Column, df: Column) -> Column:
    """Smoothed inverse document frequency (10.9)."""
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 if one has no length (10.11)."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def token_cost(prompt: Column, cached: Column, output: Column, rates: tuple[float, float, float] = (1.25, 0.31, 10.0)) -> Column:
    """Price in USD; ``rates`` per million input, cached and output tokens (10.14). Null counts are 0."""
    prompt, cached, output = (F.coalesce(c, F.lit(0)) for c in (prompt, cached, output))
    seen = F.least(cached, prompt)
    return ((prompt - seen) * F.lit(rates[0]) + seen * F.lit(rates[1]) + output * F.lit(rates[2])) / F.lit(1e6)


def cache_action(record_hash: Column, current_hash: Column, expires_ms: Column, now_ms: Column) -> Column:
    """Reuse a record of the same content that has not expired (10.17)."""
    return F.when(record_hash.isNull(), "create").when(record_hash != current_hash, "recreate").when(expires_ms > now_ms, "reuse").otherwise("recreate")


def trust_band(kappa: Column) -> Column:
    """Band of an agreement figure (10.18)."""
    return F.when(kappa >= 0.61, "trusted").when(kappa >= 0.41, "published-with-analysis").otherwise("not-trusted")


def kappa_of(observed: Column, human: Column, judge: Column) -> Column:
    """Cohen's kappa from observed agreement and the two raters' shares (5.15)."""
    chance = human * judge + (F.lit(1.0) - human) * (F.lit(1.0) - judge)
    return F.when(chance >= 1.0, F.when(observed >= 1.0, 1.0).otherwise(0.0)).otherwise((observed - chance) / (F.lit(1.0) - chance))


def summary_stage(stages: Column) -> Column:
    """``hybrid`` for several stages, else the one (10.21)."""
    return F.when(F.size(stages) > 1, "hybrid").otherwise(F.element_at(stages, 1))


def failure_stage(hit_rate: Column) -> Column:
    """Where an item failed (10.19)."""
    return F.when(hit_rate < 1.0, "retrieval").otherwise("synthesis")


# Fixed value: what marks a line that the network puts into pages.
WAF_MARKER = "__uzdbm_1"


def normalize_bytes(content: Column, policy: str) -> Column:
    """Bytes under a policy: ``none``, ``crlf-to-lf`` or ``strip-waf``: lines with the marker go, with their line feed (10.2)."""
    if policy == "none":
        return content
    text = F.decode(content, "ISO-8859-1")  # a character for each byte
    if policy == "crlf-to-lf":
        return F.encode(F.regexp_replace(text, "\r\n?", "\n"), "ISO-8859-1")
    if policy == "strip-waf":
        return F.encode(F.regexp_replace(text, f"(?md)^[^\n]*{WAF_MARKER}[^\n]*\n?", ""), "ISO-8859-1")
    raise ValueError(f"unknown normalization policy: {policy}")


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces (10.3)."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def chunk_hash(chunk_id: Column, key: Column, text: Column) -> Column:
    """Digest of a chunk's id, key and text (10.6)."""
    return F.sha2(F.to_json(F.array(chunk_id, key, text)), 256)
