"""Strict parsing of JSON that models and raters return.

Spark drops unknown fields of JSON silently, so the keys of every object are read as a
map first and held against the schema; a row that breaks a rule raises an error that
says which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import strip_code_fence

CLASSES = ["answer", "flag-void-clause", "refuse-out-of-scope", "refuse-advice-escalate", "refuse-jurisdiction"]
PATH = "struct<documentId:string,segments:array<struct<kind:string,label:string>>>"
ENVELOPE = f"struct<behaviorClass:string,answer:string,claims:array<struct<text:string,cites:array<{PATH}>>>>"


def keys_of(json: Column) -> Column:
    """Sorted keys of a JSON object; null if it is none."""
    return F.array_sort(F.json_object_keys(json))


def require(value: Column, rule: Column, problem: str, kind: str) -> Column:
    """``value`` where the rule holds, else an error."""
    return F.when(F.coalesce(rule, F.lit(False)), value).otherwise(F.raise_error(F.lit(problem)).cast(kind))


def parse_envelope(text: Column) -> Column:
    """Answer, class and claims with cites (10.25); unknown keys and classes are errors."""
    body = strip_code_fence(text)
    parsed = F.from_json(body, ENVELOPE)
    claims = F.from_json(F.get_json_object(body, "$.claims"), "array<map<string,string>>")
    exact = lambda m, names: F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, names))
    rule = (keys_of(body) == F.array(F.lit("answer"), F.lit("behaviorClass"), F.lit("claims"))) & parsed["behaviorClass"].isin(CLASSES) & parsed["answer"].isNotNull() & F.forall(claims, lambda c: exact(c, ["cites", "text"]))
    kinds = F.forall(F.flatten(F.transform(parsed["claims"], lambda c: F.flatten(F.transform(c["cites"], lambda p: p["segments"])))), lambda s: s["kind"].isin("part", "section", "subsection", "clause") & (F.length(s["label"]) > 0))
    return require(parsed, rule & kinds, "not an answer envelope", ENVELOPE)


def cite_keys(claims: Column) -> Column:
    """All cites of the claims as path keys, in order (10.24)."""
    key = lambda p: F.concat_ws("|", p["documentId"], F.transform(p["segments"], lambda s: F.concat(s["kind"], F.lit(":"), s["label"])))
    return F.flatten(F.transform(claims, lambda c: F.transform(c["cites"], key)))


def truth(value: Column) -> Column:
    """Whether a JSON value counts as true: not if it is absent, null, false, zero, or empty."""
    kind, text = F.coalesce(F.schema_of_variant(value), F.lit("VOID")), F.to_json(value)
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(kind == "VOID", False).when(kind == "BOOLEAN", text == "true").when(number, text.cast("double") != 0).otherwise(~text.isin('""', "[]", "{}"))


def judge_verdicts(responses: DataFrame, points: DataFrame) -> DataFrame:
    """(item_id, point_id, credited) of ``responses(item_id, text)`` for ``points(item_id, point_id)`` (10.26).

    A point without a verdict is an error; a repeated one counts as last given.
    """
    whole = F.parse_json(strip_code_fence(F.col("text")))
    rows = responses.select("item_id", F.posexplode(F.try_variant_get(whole, "$.verdicts", "array<variant>")).alias("pos", "v"))
    rows = rows.where(F.schema_of_variant(F.try_variant_get("v", "$.pointId", "variant")) == "STRING")
    said = truth(F.try_variant_get("v", "$.credited", "variant"))
    last = rows.groupBy("item_id", F.try_variant_get("v", "$.pointId", "string").alias("point_id")).agg(F.max_by(said, "pos").alias("credited"))
    # the planner takes the verdicts for no more rows than the responses' compressed bytes and would broadcast them: both sides are sorted instead
    joined = points.select("item_id", "point_id").join(last.hint("merge"), ["item_id", "point_id"], "left")
    return joined.withColumn("credited", require(F.col("credited"), F.col("credited").isNotNull(), "the judge left out a point", "boolean"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges(source, target, ...)`` of a model, all between known nodes or an error (10.27)."""
    keys = nodes.select(F.col("key").alias("__key")).distinct()
    both = edges.join(keys.withColumnRenamed("__key", "__s"), F.col("source") == F.col("__s"), "left").join(keys.withColumnRenamed("__key", "__t"), F.col("target") == F.col("__t"), "left")
    return both.withColumn("source", require(F.col("source"), F.col("__s").isNotNull() & F.col("__t").isNotNull(), "an edge names an unknown path", "string")).drop("__s", "__t")
