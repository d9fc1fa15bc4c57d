"""Manifest checks, completeness and fidelity of parsed texts, build digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verify_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """ok, mismatch or error for each source (12.15): ``manifest(id, sha256, bytes)``, ``actual(id, content)``."""
    found = actual.select("id", F.sha2("content", 256).alias("found_sha256"), F.octet_length("content").alias("found_bytes"))
    out = manifest.join(found, "id", "left")
    same = (F.col("sha256") == F.col("found_sha256")) & (F.col("bytes") == F.col("found_bytes"))
    return out.withColumn("status", F.when(F.col("found_sha256").isNull(), "error").when(same, "ok").otherwise("mismatch"))


def summarize(results: DataFrame) -> DataFrame:
    """Counts of a verification, and whether none failed (5.23)."""
    return results.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed")).withColumn("all_ok", F.col("failed") == 0)


def invalid_sources(manifest: DataFrame) -> DataFrame:
    """Rows that break a rule of the manifest, with the first rule broken (1.2)."""
    w = Window.partitionBy("id")
    rule = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id is empty").when(~F.coalesce("sha256", F.lit("")).rlike("^[0-9a-f]{64}$"), "sha256 is not 64 hex digits")
        .when(~F.coalesce(F.col("consolidationDate"), F.lit("")).rlike("^\\d{4}-\\d{2}-\\d{2}$"), "date is not ISO").when(F.coalesce("bytes", F.lit(-1)) < 0, "bytes is negative")
        .when(~F.coalesce("normalization", F.lit("none")).isin("none", "strip-waf", "crlf-to-lf"), "unknown normalization").when(F.count(F.lit(1)).over(w) > 1, "id repeats")
    )
    return manifest.withColumn("problem", rule).where("problem is not null")


def select_sources(manifest: DataFrame, only: list[str]) -> DataFrame:
    """Named sources in manifest order; an unknown name is an error (1.3)."""
    known = {r.id for r in manifest.where(F.col("id").isin(only)).select("id").distinct().collect()}
    if missing := [i for i in only if i not in known]:
        raise ValueError(f"unknown source ids: {missing}")
    return manifest.where(F.col("id").isin(only))


def set_difference(expected: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing, unexpected and duplicated labels (5.27)."""
    e, p = expected.select(key).distinct(), parsed.groupBy(key).agg(F.count(F.lit(1)).alias("__count"))
    missing = e.join(p, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = p.join(e, key, "left_anti").select(key, F.lit("unexpected").alias("problem"))
    return missing.unionByName(extra).unionByName(p.where("__count > 1").select(key, F.lit("duplicated").alias("problem")))


def multiset_difference(expected: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """(key, expected, parsed) where counts differ (5.26, 8.4)."""
    both = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(parsed.select(key, F.lit(0).alias("e"), F.lit(1).alias("p")))
    return both.groupBy(key).agg(F.sum("e").alias("expected"), F.sum("p").alias("parsed")).where("expected <> parsed")


def cite_round_trip(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts whose key resolves to no node or to one with another text (5.28)."""
    joined = texts.select("key", "text").join(nodes.select("key", F.col("text").alias("node_text"), F.lit(True).alias("known")), "key", "left")
    return joined.where(F.col("known").isNull() | ~F.col("text").eqNullSafe(F.col("node_text"))).select("key")


def text_fidelity(parts: DataFrame, sources: DataFrame) -> DataFrame:
    """(document_id, parts, verbatim, ratio): parts that are substrings of their source (5.29)."""
    joined = sources.select("document_id", F.col("text").alias("source")).join(parts.select("document_id", F.col("text").alias("part")), "document_id", "left")
    ok = F.contains("source", "part")
    return joined.groupBy("document_id").agg(F.count("part").alias("parts"), F.count_if(ok).alias("verbatim"), F.round(F.coalesce(F.avg(ok.cast("double")), F.lit(1.0)), 6).alias("ratio"))


def occurrences(haystack: str, needle: str):
    """Non-overlapping occurrences as a column (5.30)."""
    h, n = F.col(haystack), F.col(needle)
    return F.when(F.length(n) > 0, ((F.length(h) - F.length(F.replace(h, n, F.lit("")))) / F.length(n)).cast("long")).otherwise(F.lit(0))


def coverage(parts: DataFrame, reference: DataFrame) -> DataFrame:
    """Parts that occur less often in the reference text than among the parts (5.30)."""
    clean = lambda c: F.trim(F.regexp_replace(c, "(?U)[\\s\\uFEFF]+", " "))
    need = parts.select("document_id", clean("text").alias("part")).where("part <> ''").groupBy("document_id", "part").agg(F.count(F.lit(1)).alias("needed"))
    kind = need.schema["document_id"].dataType.simpleString()
    listed = need.groupBy("document_id").agg(F.collect_list(F.struct("part", "needed")).alias("parts"))  # the parts of one document
    found = listed.join(reference.select("document_id", clean("text").alias("whole")), "document_id", "left")
    return found.select("document_id", "parts", "whole").mapInArrow(_scarce_parts, f"document_id {kind}, part string, needed long, found long")


def _scarce_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each document that its text holds too seldom: a text is sent once, not once a part."""
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # texts are as long as they are
        rows, parts, needed, found = [], [], [], []
        for i, (listed, whole) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for one in listed:
                n = (whole or "").count(one["part"])
                if n < one["needed"]:
                    rows.append(i)
                    parts.append(one["part"])
                    needed.append(one["needed"])
                    found.append(n)
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.string()), pa.array(needed, pa.int64()), pa.array(found, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["document_id", "part", "needed", "found"])


def tree_digest(rows: DataFrame, by: str, value: str, group: str, levels: tuple[int, ...] = (6, 3, 0)) -> DataFrame:
    """(group, n, digest) of a group of any size: digests of digests, by prefixes of the sha256 of the key (10.8).

    The leaves hold the lines of keys whose hashes share six hex digits, in key order; the
    next level the digests that share three, then all: no task collects over 4,096 digests,
    or more than a sixteen millionth of the lines.
    """
    name = F.sha2(F.col(by).cast("string"), 256)
    out = rows.select(group, name.alias("at"), F.struct(F.col(by), F.concat_ws(":", by, value).alias("line")).alias("item"), F.lit(1).cast("long").alias("n"))
    for digits in levels:
        lines = F.transform(F.array_sort(F.collect_list("item")), lambda s: s["line"])
        out = out.groupBy(group, F.substring("at", 1, digits).alias("at")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
        out = out.select(group, "at", F.struct(F.col("at"), F.col("digest").alias("line")).alias("item"), "n")
    return out.select(group, "n", F.col("item.line").alias("digest"))


def ordered_digest(rows: DataFrame, by: str, value: str, group: str) -> DataFrame:
    """A digest of a group's values in key order (1.9, 7.16, 10.8)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda s: F.concat_ws(":", s[by], s[value]))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
