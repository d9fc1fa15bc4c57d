"""Citable paths: ``doc|kind:label|...`` keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of path segments, from the outermost in; words of the human form.
KINDS = ["part", "section", "subsection", "clause"]


def path_key(document_id: Column, segments: Column) -> Column:
    """The key of a document id and an array of (kind, label) (9.17)."""
    return F.concat_ws("|", document_id, F.transform(segments, lambda s: F.concat(s["kind"], F.lit(":"), s["label"])))


def parse_key(key: Column) -> Column:
    """(document_id, segments) of a key; null if a segment is malformed (9.18)."""
    parts = F.split(key, "\\|")
    rest = F.slice(parts, F.lit(2), F.size(parts))
    segments = F.transform(rest, lambda s: F.struct(F.substring_index(s, ":", 1).alias("kind"), F.regexp_replace(s, "^[^:]*:", "").alias("label")))
    fine = (F.element_at(parts, 1) != "") & F.forall(rest, lambda s: F.substring_index(s, ":", 1).isin(KINDS) & s.contains(":") & (F.length(F.regexp_replace(s, "^[^:]*:", "")) > 0))
    return F.when(fine, F.struct(F.element_at(parts, 1).alias("document_id"), segments.alias("segments")))


def document_of(key: Column) -> Column:
    return F.substring_index(key, "|", 1)


def is_proper_ancestor(ancestor: Column, key: Column) -> Column:
    """Same document, strictly shorter, a prefix segment by segment (3.2)."""
    return F.startswith(key, F.concat(ancestor, F.lit("|")))


def is_proper_descendant(key: Column, ancestor: Column) -> Column:
    return is_proper_ancestor(ancestor, key)


def cite_verdict(required: Column, candidate: Column, resolves: Column) -> Column:
    """How a candidate meets a requirement; ``resolves``: the candidate is a known node (3.5)."""
    return (
        F.when(~resolves, "unresolvable").when(required == candidate, "exact").when(is_proper_ancestor(required, candidate), "descendant-satisfies-ancestor")
        .when(is_proper_ancestor(candidate, required), "ancestor-partial").otherwise("no-match")
    )


def satisfies(verdict: Column) -> Column:
    return verdict.isin("exact", "descendant-satisfies-ancestor")


def human_path(document_id: Column, segments: Column) -> Column:
    """``doc / Part I / s. 5 / (2)`` (9.19)."""
    named = F.transform(segments, lambda s: F.when(s["kind"] == "part", F.concat(F.lit("Part "), s["label"])).when(s["kind"] == "section", F.concat(F.lit("s. "), s["label"])).otherwise(F.concat(F.lit("("), s["label"], F.lit(")"))))
    return F.concat_ws(" / ", document_id, named)


def breadcrumb_text(document_id: Column, segments: Column, text: Column) -> Column:
    """The human path, a blank line, the text (9.20)."""
    return F.concat(human_path(document_id, segments), F.lit("\n\n"), text)
