"""Cite matching and item scores.

Cites are rows: ``required(item_id, key)`` and ``candidate(item_id, key)``; ``nodes(key)``
are the paths that resolve. Matching joins on the item and, for prefixes, on the
document, so a theta condition never meets more than one document's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.paths import cite_verdict, document_of, is_proper_ancestor, satisfies


def resolves(cites: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cites`` with ``resolves``: whether the key is a known node (3.4)."""
    known = nodes.select(F.col("key").alias("__node")).distinct()
    return cites.join(known, cites["key"] == known["__node"], "left").withColumn("resolves", F.col("__node").isNotNull()).drop("__node")


def verdicts(required: DataFrame, candidate: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, required, candidate, verdict) of every pair of an item (3.5)."""
    mine = resolves(candidate, nodes).select("item_id", F.col("key").alias("candidate"), "resolves")
    pairs = required.select("item_id", F.col("key").alias("required")).join(mine, "item_id")
    return pairs.select("item_id", "required", "candidate", cite_verdict(F.col("required"), F.col("candidate"), F.col("resolves")).alias("verdict"))


def precision_recall(items: DataFrame, required: DataFrame, candidate: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, cite_precision, cite_recall) of every item (5.3); an empty side scores 1."""
    met = verdicts(required, candidate, nodes).where(satisfies(F.col("verdict")))
    good = met.select("item_id", F.col("candidate").alias("key")).distinct().withColumn("ok", F.lit(1.0))
    done = met.select("item_id", F.col("required").alias("key")).distinct().withColumn("ok", F.lit(1.0))
    share = F.avg(F.coalesce("ok", F.lit(0.0)))
    precision = candidate.join(good, ["item_id", "key"], "left").groupBy("item_id").agg(share.alias("cite_precision"))
    recall = required.join(done, ["item_id", "key"], "left").groupBy("item_id").agg(share.alias("cite_recall"))
    out = items.select("item_id").join(precision, "item_id", "left").join(recall, "item_id", "left")
    return out.select("item_id", F.coalesce("cite_precision", F.lit(1.0)).alias("cite_precision"), F.coalesce("cite_recall", F.lit(1.0)).alias("cite_recall"))


def hit_rate(items: DataFrame, required: DataFrame, retrieved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, retrieval_hit_rate): required cites reached by retrieved keys (5.4)."""
    return precision_recall(items, required, retrieved, nodes).select("item_id", F.col("cite_recall").alias("retrieval_hit_rate"))


def score_items(items: DataFrame, outcomes: DataFrame, required: DataFrame, candidate: DataFrame, retrieved: DataFrame, nodes: DataFrame) -> DataFrame:
    """The deterministic score of each item (5.5): strict pass is a behaviour match with recall 1."""
    out = items.join(outcomes, "item_id").join(precision_recall(items, required, candidate, nodes), "item_id").join(hit_rate(items, required, retrieved, nodes), "item_id")
    match = F.col("observed_behavior") == F.col("behavior_class")
    return out.select("item_id", "behavior_class", match.alias("behavior_match"), "cite_precision", "cite_recall", "retrieval_hit_rate", (match & (F.col("cite_recall") == 1.0)).alias("strict_pass"))


# The stages that always have a row.
RESCUE_STAGES = ["vector", "bm25", "graph-expansion", "rerank-survivor"]


def rescue_stats(required: DataFrame, candidate: DataFrame, nodes: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """(stage, reached, rescued_only) over all items (5.13, 5.14).

    ``candidate`` has ``stages``, an array. A stage rescues a cite alone if no other stage
    reached it.
    """
    known = nodes.select("key").distinct()
    found = candidate.join(known, "key", "left_semi").select("item_id", F.col("key").alias("candidate"), "stages")
    pairs = required.select("item_id", F.col("key").alias("required")).distinct().join(found, "item_id")
    met = pairs.where((F.col("required") == F.col("candidate")) | is_proper_ancestor(F.col("required"), F.col("candidate")))
    reached = met.select("item_id", "required", F.explode("stages").alias("stage")).distinct()
    alone = reached.groupBy("item_id", "required").agg(F.count(F.lit(1)).alias("n"))
    each = reached.join(alone, ["item_id", "required"]).groupBy("stage").agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("n") == 1).alias("rescued_only"))
    fixed = stages or RESCUE_STAGES
    present = candidate.select(F.explode("stages").alias("stage")).unionByName(candidate.sparkSession.createDataFrame([(s,) for s in fixed], "stage string")).distinct()
    out = present.join(each, "stage", "left").select("stage", F.coalesce("reached", F.lit(0)).alias("reached"), F.coalesce("rescued_only", F.lit(0)).alias("rescued_only"))
    return out.withColumn("stage_pos", F.when(F.col("stage").isin(fixed), F.array_position(F.array(*map(F.lit, fixed)), F.col("stage"))).otherwise(99).cast("int"))


def clamp_claims(claims: DataFrame, allowed: DataFrame) -> DataFrame:
    """``claims(id, claims)`` with cites that were not retrieved dropped; emptied claims stay (3.26)."""
    keys = allowed.groupBy("id").agg(F.collect_set("key").alias("__keys"))
    known = F.coalesce("__keys", F.array().cast("array<string>"))
    kept = F.transform("claims", lambda c: F.struct(c["text"].alias("text"), F.filter(c["cites"], lambda x: F.array_contains(known, x)).alias("cites")))
    return claims.join(keys, "id", "left").select("id", kept.alias("claims"))


def documents_of(keys: DataFrame) -> DataFrame:
    return keys.withColumn("document_id", document_of(F.col("key")))
