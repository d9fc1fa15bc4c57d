"""Golden items, document trees, conformance vectors, server-sent events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM_SCHEMA = "file string, version int, item_id string, behavior_class string, corpus string, verified boolean, question string, points array<struct<id:string,text:string>>, cites array<string>, paraphrase_of string"
# Keys of a golden item, the needed ones first; behaviour classes.
NEEDED = ["id", "behavior_class", "corpus", "verified", "question", "answer_points", "required_cites", "provenance"]
KEYS = [*NEEDED, "paraphrase_of", "tags"]
CLASSES = ["answer", "flag-void-clause", "refuse-out-of-scope", "refuse-advice-escalate", "refuse-jurisdiction"]


def key_of(path: dict) -> str:
    """The path key of ``{documentId, segments}``; strict."""
    if set(path) != {"documentId", "segments"} or not path["documentId"]:
        raise ValueError(f"not a citable path: {path}")
    parts = [path["documentId"]]
    for segment in path["segments"]:
        if segment["kind"] not in ("part", "section", "subsection", "clause") or not segment["label"] or "|" in segment["label"]:
            raise ValueError(f"not a path segment: {segment}")
        parts.append(f"{segment['kind']}:{segment['label']}")
    return "|".join(parts)


def items_of(text: str, file: str) -> list[tuple]:
    """Items of one YAML document (1.20, 3.31): closed keys, types, unique points."""
    import yaml

    whole = yaml.safe_load(text)
    if not isinstance(whole, dict) or set(whole) != {"version", "items"} or not isinstance(whole["version"], int) or whole["version"] < 1 or not whole["items"]:
        raise ValueError(f"{file}: needs a version and items")
    out = []
    for item in whole["items"]:
        if unknown := set(item) - set(KEYS):
            raise ValueError(f"{file}: unknown keys {sorted(unknown)}")
        if missing := [k for k in NEEDED if k not in item]:
            raise ValueError(f"{file}: missing keys {missing}")
        if item["behavior_class"] not in CLASSES or not isinstance(item["verified"], bool):
            raise ValueError(f"{file}: item {item['id']}: bad class or verified")
        points = [(p["id"], p["text"]) for p in item["answer_points"]]
        if not points or len({i for i, _ in points}) < len(points):
            raise ValueError(f"{file}: item {item['id']}: points are empty or repeat")
        out.append((file, whole["version"], item["id"], item["behavior_class"], item["corpus"], item["verified"], item["question"], points, [key_of(c) for c in item["required_cites"]], item.get("paraphrase_of")))
    return out


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Items of a YAML file or folder (1.19); versions must agree, parents must exist and be parents."""
    files = spark.read.option("pathGlobFilter", "*.y*ml").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [x for r in frame.itertuples(index=False) for x in items_of(r.text, r.file)]
            yield pd.DataFrame([(*r[:7], [{"id": i, "text": t} for i, t in r[7]], *r[8:]) for r in rows], columns=[c.split()[0] for c in ITEM_SCHEMA.split(", ")])

    items = files.mapInPandas(run, ITEM_SCHEMA)
    seen = items.agg(F.count_distinct("version").alias("versions"), F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("ids")).first()
    if seen.versions > 1:
        raise ValueError("golden files have different versions")
    if seen.n != seen.ids:
        raise ValueError("golden item ids repeat")
    parents = items.where("paraphrase_of is null").select(F.col("item_id").alias("paraphrase_of"))
    if items.where("paraphrase_of is not null").join(parents, "paraphrase_of", "left_anti").limit(1).count():
        raise ValueError("a paraphrase names no parent")
    return items


def verified_items(items: DataFrame) -> DataFrame:
    """Verified items; paraphrases only of verified parents (3.23)."""
    good = items.where("verified")
    parents = good.where("paraphrase_of is null").select(F.col("item_id").alias("__parent"))
    return good.join(parents, F.coalesce("paraphrase_of", "item_id") == F.col("__parent"), "left_semi")


def tree_rows(tree: dict) -> list[tuple]:
    """Rows of a nested tree in document order (3.8-3.10)."""
    if tree.get("kind") != "document" or not tree.get("documentId"):
        raise ValueError("the root must be a document with an id")
    out, todo = [], [(tree, 0, tree["documentId"], None)]
    while todo:
        node, depth, key, parent = todo.pop()
        if set(node) - {"kind", "label", "documentId", "children"}:
            raise ValueError(f"unknown keys in node {key}")
        out.append((tree["documentId"], len(out), depth, node["kind"], node["label"], key, parent))
        todo += [(c, depth + 1, f"{key}|{c['kind']}:{c['label']}", key) for c in reversed(node.get("children", []))]
    return out


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of JSON trees, one file a tree (1.21); of trees with one id the first by name counts."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.file, *x) for r in frame.itertuples(index=False) for x in tree_rows(json.loads(r.text))]
            yield pd.DataFrame(rows, columns=["file", "document_id", "pos", "depth", "kind", "label", "key", "parent_key"])

    nodes = files.mapInPandas(run, "file string, document_id string, pos int, depth int, kind string, label string, key string, parent_key string")
    return nodes.withColumn("__first", F.min("file").over(Window.partitionBy("document_id"))).where("file = __first").drop("__first", "file")


def parse_sse(lines: DataFrame) -> DataFrame:
    """Events of ``lines(stream, pos, line)`` (1.32): (stream, event, data).

    Frames end at blank lines; data lines join with line breaks; comments and frames whose
    data is not JSON are skipped; an unended last frame counts.
    """
    w = Window.partitionBy("stream").orderBy("pos")
    framed = lines.withColumn("frame", F.sum((F.col("line") == "").cast("int")).over(w))
    kind = F.regexp_extract("line", "^event: ?(.*)$", 1)
    data = F.regexp_extract("line", "^data: ?(.*)$", 1)
    rows = framed.where(F.col("line").rlike("^(event|data):")).select("stream", "frame", "pos", F.when(F.startswith("line", F.lit("event:")), kind).alias("event"), F.when(F.startswith("line", F.lit("data:")), F.struct("pos", data.alias("d"))).alias("data"))
    out = rows.groupBy("stream", "frame").agg(F.max("event").alias("event"), F.array_join(F.transform(F.array_sort(F.collect_list("data")), lambda s: s["d"]), "\n").alias("data"))
    return out.where(F.try_parse_json("data").isNotNull()).select("stream", "frame", F.coalesce("event", F.lit("message")).alias("event"), "data")
