"""Manifest and byte sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "struct<id:string,title:string,url:string,file:string,sha256:string,bytes:bigint,consolidationDate:string,licence:struct<holder:string,note:string>,normalization:string>"
MANIFEST = f"version int, generatedAt string, sources array<{SOURCE}>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a source, in manifest order (1.1); malformed JSON is an error."""
    whole = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = whole.select(F.posexplode("sources").alias("pos", "s")).select("pos", "s.*")
    return rows.withColumn("normalization", F.coalesce("normalization", F.lit("none")))


def read_bytes(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``content``; null where a file is not there (1.4)."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base).toUri().getPath().rstrip("/")
    relative = F.expr(f"substring(path, instr(path, '{folder}/') + {len(folder) + 1})")
    return manifest.join(files.select(relative.alias("file"), "content"), "file", "left")


def generate_manifest(content: DataFrame, version: int, generated_at: str) -> DataFrame:
    """One JSON document of checksummed sources (1.7): ``content(id, title, url, file, content, ...)``."""
    entry = F.struct("id", "title", "url", "file", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"), "consolidationDate")
    listed = content.agg(F.array_sort(F.collect_list(entry)).alias("sources"))
    return listed.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(generated_at).alias("generatedAt"), "sources")).alias("manifest"))


def manifest_snapshot(manifest: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, sha256, consolidationDate) of wanted ids; a missing one is an error (1.18)."""
    rows = manifest.where(F.col("id").isin(wanted)).select("id", "sha256", "consolidationDate")
    have = {r.id for r in rows.select("id").collect()}
    if missing := sorted(set(wanted) - have):
        raise ValueError(f"manifest has no sources {missing}")
    return rows


def replace_chunks(rows: DataFrame, path: str) -> int:
    """Replace the stored chunks (1.11); their number."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def list_chunks(spark: SparkSession, path: str, documents: list[str] | None = None) -> DataFrame:
    """Stored chunks, of some documents only if named: the filter reaches the scan (1.12)."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("document_id").isin(documents)) if documents is not None else rows


def append_scores(scores: DataFrame, path: str) -> None:
    """Long scores to the sink (1.30); rows without a trace drop."""
    scores.where("trace_id is not null").write.mode("append").parquet(path)


def upsert(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A key-value table with changed rows in place of old ones (1.28)."""
    return store.join(changes.select(key), key, "left_anti").unionByName(changes)


def write_artifact(build: DataFrame, path: str) -> None:
    """An enrichment artifact as JSON (1.16)."""
    build.write.mode("overwrite").json(path)


ARTIFACT = "corpusBuildHash string, configHash string, trees array<struct<documentId:string,crossReferences:array<struct<from:string,to:string,kind:string>>,definitions:map<string,string>,amendmentFlags:array<struct<path:string,note:string>>>>"


def read_artifact(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Edges, definitions and flags of an artifact (1.17); malformed JSON is an error."""
    trees = spark.read.schema(ARTIFACT).option("mode", "FAILFAST").json(path).select(F.posexplode("trees").alias("doc_pos", "t"))
    edges = trees.select("doc_pos", "t.documentId", F.posexplode("t.crossReferences").alias("edge_pos", "e"))
    return {
        "edges": edges.select(F.col("documentId").alias("document_id"), (F.col("doc_pos") * 1_000_000 + F.col("edge_pos")).alias("edge_pos"), F.col("e.from").alias("source"), F.col("e.to").alias("target"), "e.kind"),
        "definitions": trees.select(F.col("t.documentId").alias("document_id"), "doc_pos", F.explode("t.definitions").alias("term", "path_key")),
        "flags": trees.select(F.col("t.documentId").alias("document_id"), F.explode("t.amendmentFlags").alias("f")).select("document_id", "f.*"),
    }
