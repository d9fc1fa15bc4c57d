"""Content addresses, build guards, the corpus registry, strict artifacts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.numbers import canonical_json
from marginalia.operators.agent import enrich_missing
from marginalia.operators.artifacts import cli_envelope, label_rows  # noqa: F401 (part of this module's names)
from marginalia.operators.envelopes import require
from marginalia.operators.routing import CORPORA

# What may be decided about a queued failure.
DISPOSITIONS = ["bug", "rubric-wrong", "known-limitation", "noise"]


# --- hashes and guards ------------------------------------------------------------------


def config_hash(config: dict) -> str:
    """The address of a configuration (10.4)."""
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def build_metadata(manifest_hash: str, config: dict) -> dict:
    """What a build records of itself (10.4)."""
    return {"buildHash": config_hash({"manifestHash": manifest_hash, "pipelineConfig": config}), "manifestHash": manifest_hash, "pipelineConfig": config, "enrichmentModel": config["enrichmentModel"]}


def tree_hashes(nodes: DataFrame) -> DataFrame:
    """(document_id, tree_hash) by structure in document order and by text in key order (10.5): ``nodes(document_id, pos, path_key, text)``."""
    skeleton = F.transform(F.array_sort(F.collect_list(F.struct("pos", "path_key"))), lambda s: s["path_key"])
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.length("text") > 0, F.struct("path_key", "text")))), lambda s: F.array(s["path_key"], s["text"]))
    listed = nodes.groupBy("document_id").agg(skeleton.alias("skeleton"), texts.alias("text"))
    return listed.select("document_id", F.sha2(F.to_json(F.struct(F.col("document_id").alias("documentId"), "skeleton", "text")), 256).alias("tree_hash"))


def facts_digests(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """(document_id, digest) of a document's cross-references in order and its definitions by term (10.7).

    A side without rows is an empty list in the digested JSON, never left out.
    """
    listed = edges.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_pos", "source", "target", "kind"))), lambda e: F.struct(e["source"].alias("from"), e["kind"].alias("kind"), e["target"].alias("to"))).alias("crossReferences"))
    terms = definitions.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("term", "path_key"))).alias("definitions"))
    both = listed.join(terms, "document_id", "full")
    whole = [F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("crossReferences", "definitions")]
    return both.select("document_id", F.sha2(F.to_json(F.struct(*whole)), 256).alias("digest"))


# The first part of the keys of both caches, and the order of their parts.


def tree_cache_key(stage: Column, model: Column, prompt_version: Column, tree_hash: Column) -> Column:
    """Where a tree's enrichment is kept (10.7): a JSON array, so no two keys fall together."""
    return F.to_json(F.array(F.lit("tree"), stage, model, prompt_version, tree_hash))


def chunk_cache_key(stage: Column, chunker: Column, model: Column, prompt_version: Column, tree_hash: Column, facts: Column, chunk: Column) -> Column:
    """Where a chunk's context is kept (10.7)."""
    return F.to_json(F.array(F.lit("chunk"), stage, chunker, model, prompt_version, tree_hash, facts, chunk))


def check_build(artifact: dict, corpus_build_hash: str, config: dict) -> None:
    """An artifact must belong to the corpus and configuration that serve it (11.13)."""
    if artifact["corpusBuildHash"] != corpus_build_hash:
        raise ValueError(f"the artifact belongs to corpus {artifact['corpusBuildHash']!r}, not to {corpus_build_hash!r}")
    if artifact["configHash"] != config_hash(config):
        raise ValueError(f"the artifact was made with configuration {artifact['configHash']!r}, not with {config_hash(config)!r}")


def enrichment_build(nodes: DataFrame, chunks: DataFrame, cache: DataFrame, config: dict, enrich: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Enriched chunks and the new rows of the cache (11.12): a chunk is made once for each text, tree, model and prompt.

    ``chunks(document_id, id, citable_path_key, text, chunker)``, ``cache(key, value)``;
    ``config`` names enrichmentModel and promptVersion.
    """
    if missing := [k for k in ("enrichmentModel", "promptVersion") if not config.get(k)]:
        raise ValueError(f"the configuration lacks {missing}")
    rows = chunks.join(tree_hashes(nodes), "document_id")
    chunk = F.sha2(F.to_json(F.array("id", "citable_path_key", "text")), 256)
    key = chunk_cache_key(F.lit("situating-context"), F.col("chunker"), F.lit(config["enrichmentModel"]), F.lit(config["promptVersion"]), F.col("tree_hash"), F.lit(""), chunk)
    return enrich_missing(rows.withColumn("key", F.sha2(key, 256)), cache, "key", enrich)


# --- registry, scans and sinks ------------------------------------------------------------


def corpus_source_ids(registry: DataFrame) -> DataFrame:
    """Ids of the registry's corpus documents in its order (1.10): ``registry(id, kind, doc_pos)``."""
    return registry.where("kind = 'corpus'").select("id", "doc_pos")


def load_corpus(registry: DataFrame, content: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes of every registered document with its place in the registry (1.8); one without content is an error.

    ``registry(id, kind, doc_pos, title, family)``, ``content(id, html)``.
    """
    rows = registry.join(content, "id", "left").withColumn("html", require(F.col("html"), F.col("html").isNotNull(), "a registered document was not read", "string"))
    nodes = parse(rows.select(F.col("id").alias("document_id"), "title", "family", "html"))
    return nodes.join(registry.select(F.col("id").alias("document_id"), "doc_pos", F.col("kind").alias("registry_kind")), "document_id")


def chunk_count(chunks: DataFrame) -> DataFrame:
    """Stored chunks, in all and by document (1.13)."""
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


def vector_index(chunks: DataFrame, dimensions: int) -> DataFrame:
    """Vectors ready for a cosine scan (1.14): with their norm, filterable by document; another length is an error."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    checked = require(F.col("vector"), F.size("vector") == dimensions, f"a vector has not {dimensions} components", "array<double>")
    return chunks.select("document_id", "id", checked.alias("vector"), norm.alias("norm"))


def retrieval_corpus(chunks: DataFrame, path: str) -> None:
    """Hierarchy chunks as rows of JSON (1.26)."""
    chunks.select(F.col("document_id").alias("documentId"), F.col("citable_path_key").alias("citablePathKey"), "text").write.mode("overwrite").json(path)


def read_retrieval_corpus(spark, path: str) -> DataFrame:
    """``(document_id, id, text)`` of such rows (1.27); malformed JSON is an error."""
    rows = spark.read.schema("documentId string, citablePathKey string, text string").option("mode", "FAILFAST").json(path)
    return rows.select(F.col("documentId").alias("document_id"), F.col("citablePathKey").alias("id"), "text")


def read_conformance(spark, path: str) -> DataFrame:
    """Cases of a conformance file, a JSON object for each (1.23); a version below 1 or no case is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    version = F.try_variant_get("v", "$.version", "int")
    cases = F.try_variant_get("v", "$.cases", "array<variant>")
    cases = require(cases, (version >= 1) & (F.size(cases) > 0), "not a conformance file", "array<variant>")
    return whole.select(version.alias("version"), F.posexplode(cases).alias("pos", "case")).select("version", "pos", F.to_json("case").alias("case"))


def read_extraction_set(spark, folder: str) -> DataFrame:
    """Extraction items of a folder, by file name (1.24); a malformed one is an error that names its file."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), "value")
    parsed = F.try_parse_json("value")
    item = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("malformed extraction item "), F.col("file"))).cast("variant")).otherwise(parsed)
    return files.select("file", item.alias("item")).select("file", F.try_variant_get("item", "$.id", "string").alias("id"), F.to_json("item").alias("item"))


# The fields of a context cache's record.


def cache_record(text: Column) -> Column:
    """A stored record of a context cache, null where it is absent or malformed (1.29)."""
    found = F.from_json(text, "struct<name:string,contentHash:string,expiresAt:string>", {"mode": "PERMISSIVE"})
    return F.when(found["name"].isNotNull() & found["contentHash"].isNotNull() & found["expiresAt"].isNotNull(), found)


# --- strict artifacts (JSON ones are read in operators/artifacts.py) --------------------------------------------------------------------------


def answers_map(outcomes: DataFrame) -> DataFrame:
    """(item_id, answer) of a run (10.30); a repeated item or a blank answer is an error."""
    each = outcomes.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.first("answer_text").alias("answer"))
    answer = require(F.col("answer"), F.col("n") == 1, "an item has two answers", "string")
    return each.select("item_id", require(answer, F.trim("answer") != "", "an answer is blank", "string").alias("answer"))


def strict_verdicts(points: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``points(item_id, point_id)`` with ``credited`` (4.14): ``verdicts(item_id, point_id, value)``, JSON texts; an absent one or no boolean is an error."""
    joined = points.join(verdicts.hint("merge"), ["item_id", "point_id"], "left")  # as many as the points: never broadcast
    value = F.trim("value")
    return joined.select("item_id", "point_id", require(value == "true", value.isin("true", "false"), "a verdict is missing or no boolean", "boolean").alias("credited"))


def is_valid_disposition(value: Column) -> Column:
    """Whether a failure was decided in one of the known ways (3.29)."""
    return F.coalesce(value.isin(DISPOSITIONS), F.lit(False))


def failed_corpus(routed: Column) -> Column:
    """The first canonical corpus of an item's cites, ``none`` without any (10.20)."""
    return F.coalesce(F.try_element_at(F.array_intersect(F.array(*map(F.lit, CORPORA)), routed), F.lit(1)), F.lit("none"))


def tier_items(items: DataFrame, tier: str, include_holdout: bool) -> DataFrame:
    """Items of a tier (3.25): ``items(..., side)``; the holdout outside the release tier is an error."""
    if tier not in ("smoke", "full", "release"):
        raise ValueError(f"unknown tier {tier!r}")
    if include_holdout and tier != "release":
        raise ValueError(f"the holdout runs at the release tier only, not at {tier!r}")
    return items if include_holdout else items.where("side = 'dev'")


# The first and the longest pause before another try, in milliseconds.
FIRST_MS, LONGEST_MS = 1000, 30_000


def backoff_ms(attempt: Column, jitter: Column) -> Column:
    """How long to wait before the next try (10.16)."""
    return F.least(F.lit(FIRST_MS) * F.pow(F.lit(2), attempt), F.lit(LONGEST_MS)).cast("long") + jitter


def pdf_read_problems(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keys of texts that are no node of the tree (2.14); none may be."""
    return texts.select("document_id", "path_key").join(nodes.select("document_id", "path_key").distinct(), ["document_id", "path_key"], "left_anti")


def read_pdfs(files: DataFrame, reader: Callable[[Column], Column]) -> DataFrame:
    """``files(document_id, content)`` through a reader seam (2.15): ``(document_id, lines)``; a reader that gives nothing is an error."""
    lines = reader(F.col("content"))
    return files.select("document_id", require(lines, F.size(lines) > 0, "a file has no text", "array<string>").alias("lines"))


# --- flags -----------------------------------------------------------------------------------------

# Flags of the consumers and of a query, all off; providers of reranks.
CONSUMER_FLAGS = {"xrefExpansion": False, "definitionsInPrompt": False, "chunkContext": False}
QUERY_FLAGS = {"xrefExpansion": False, "definitionsInPrompt": False, "queryReformulation": False, "rerank": False, "rerankProvider": "authority"}
RERANK_PROVIDERS = ["authority", "llm", "cohere"]


def parse_flags(given: dict, known: dict = CONSUMER_FLAGS) -> dict:
    """Flags with their defaults (3.34): unknown names, other types and unknown providers are errors."""
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown flags {unknown}")
    out = known | given
    if wrong := [k for k, v in out.items() if type(v) is not type(known[k])]:
        raise ValueError(f"flags of a wrong type: {wrong}")
    if out.get("rerankProvider", "authority") not in RERANK_PROVIDERS:
        raise ValueError(f"unknown provider {out['rerankProvider']!r}")
    return out


def flags_from_environment(environ: dict, prefix: str) -> dict:
    """Query flags from variables ``<prefix>XREF_EXPANSION`` and so on: on by ``1`` or ``true`` (3.34)."""
    name = lambda flag: prefix + "".join(f"_{c}" if c.isupper() else c for c in flag).upper()
    on = {flag: environ.get(name(flag), "").strip().lower() in ("1", "true") for flag, v in QUERY_FLAGS.items() if v is False}
    return parse_flags(on | {"rerankProvider": environ.get(name("rerankProvider"), "").strip() or "authority"}, QUERY_FLAGS)


def gated_artifacts(artifacts: dict[str, DataFrame], flags: dict) -> dict[str, DataFrame | None]:
    """Edges and definitions, each only with its flag (3.35)."""
    return {"edges": artifacts["edges"] if flags["xrefExpansion"] else None, "definitions": artifacts["definitions"] if flags["definitionsInPrompt"] else None}


def rung_environment(on: list[str], prefix: str) -> dict[str, str]:
    """The variables that switch a rung's query-time components (10.23)."""
    expansion, planner = "graph-expansion" in on, "planner" in on
    flags = {"XREF_EXPANSION": expansion, "RERANK": "authority-rerank" in on, "DEFINITIONS_IN_PROMPT": expansion and planner, "QUERY_REFORMULATION": planner}
    return {prefix + k: "1" if v else "0" for k, v in flags.items()}
