"""Authority levels, corpora, slices of golden items.

Registries are small dimension tables, passed in: ``levels(document_id, level)``,
``corpora(document_id, corpus)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.paths import document_of

# Levels from the highest authority down; corpora in canonical order.
AUTHORITY_LEVELS = ["act", "regulation", "guideline", "declaration", "bylaw", "rule", "contract"]
CORPORA = ["tenancy", "insurance", "governing", "selling"]
GUIDELINE_PREFIX = "ltb-guideline-"


def authority_rank(level: Column) -> Column:
    """0 for the highest level (3.13)."""
    return F.array_position(F.array(*map(F.lit, AUTHORITY_LEVELS)), level) - 1


def authority_of(rows: DataFrame, levels: DataFrame, key: str = "document_id") -> DataFrame:
    """``rows`` with ``level`` (3.12): listed, else by the family's prefix, else an error."""
    known = levels.select(F.col("document_id").alias("__doc"), F.col("level").alias("__level"))
    joined = rows.join(known, F.col(key) == F.col("__doc"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown document "), F.col(key))).cast("string")
    level = F.when(F.col("__level").isNotNull(), F.col("__level")).when(F.startswith(key, F.lit(GUIDELINE_PREFIX)), "guideline").otherwise(unknown)
    return joined.withColumn("level", level).drop("__doc", "__level")


def documents_at(documents: DataFrame, levels: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids at the wanted levels, each once, in first-seen order (3.14): ``documents(document_id, pos)``."""
    at = authority_of(documents, levels).where(F.col("level").isin(wanted))
    return at.groupBy("document_id").agg(F.min("pos").alias("pos"))


def corpus_of_file(path: Column) -> Column:
    """The folder after ``raw/`` or ``fixtures/`` (3.18); anything else is an error."""
    found = F.regexp_extract(path, "(?:^|/)(?:raw|fixtures)/([^/]+)", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no corpus in path "), path)).cast("string"))


def corpora_of_items(cites: DataFrame, corpora: DataFrame) -> DataFrame:
    """(item_id, routed): corpora of an item's cites in canonical order (12.12); unmapped cites are skipped."""
    found = cites.withColumn("document_id", document_of(F.col("key"))).join(corpora, "document_id").groupBy("item_id").agg(F.collect_set("corpus").alias("s"))
    return found.select("item_id", F.array_intersect(F.array(*map(F.lit, CORPORA)), F.col("s")).alias("routed"))


def corpus_conflicts(items: DataFrame, cites: DataFrame, corpora: DataFrame) -> DataFrame:
    """(item_id, corpus, expected) where the declared corpus is not that of the cites (4.10)."""
    routed = corpora_of_items(cites, corpora)
    expected = F.when(F.size("routed") > 1, "cross-corpus").otherwise(F.element_at("routed", 1))
    return items.join(routed, "item_id").select("item_id", "corpus", expected.alias("expected")).where("corpus <> expected")


def serviceable(items: DataFrame, cites: DataFrame, indexed: DataFrame) -> DataFrame:
    """Items all of whose cited documents are indexed (3.22); no cites: serviceable."""
    absent = cites.withColumn("document_id", document_of(F.col("key"))).join(indexed.select("document_id"), "document_id", "left_anti")
    return items.join(absent.select("item_id").distinct(), "item_id", "left_anti")


def run_items(items: DataFrame, cites: DataFrame, indexed: DataFrame, sides: DataFrame, holdout: bool = False) -> DataFrame:
    """Verified, serviceable items of the dev side, or of both (3.24)."""
    good = serviceable(items.where("verified"), cites, indexed).join(sides.select("item_id", "side"), "item_id")
    return good if holdout else good.where("side = 'dev'")


def slice_problems(wanted: DataFrame, items: DataFrame, cites: DataFrame, indexed: DataFrame, sides: DataFrame, classes: list[str]) -> DataFrame:
    """(problem, what): why a named slice may not run (4.18); empty if it may.

    ``wanted(item_id, pos)``. Items must exist, be verified, dev and serviceable; every class
    and every corpus of the runnable items must occur.
    """
    named = wanted.join(items, "item_id")
    tell = lambda df, problem, col="item_id": df.select(F.lit(problem).alias("problem"), F.col(col).cast("string").alias("what"))
    able = run_items(items, cites, indexed, sides)
    every = items.sparkSession.createDataFrame([(c,) for c in classes], "behavior_class string")
    return (
        tell(wanted.join(items, "item_id", "left_anti"), "missing").unionByName(tell(named.where("not verified"), "unverified")).unionByName(tell(named.join(sides.where("side = 'dev'"), "item_id", "left_anti"), "not dev"))
        .unionByName(tell(named.join(serviceable(named.select("item_id"), cites, indexed), "item_id", "left_anti"), "not serviceable")).unionByName(tell(every.join(named, "behavior_class", "left_anti"), "class absent", "behavior_class"))
        .unionByName(tell(able.select("corpus").distinct().join(named, "corpus", "left_anti"), "corpus absent", "corpus"))
    )


def comment_to_update(comments: DataFrame, marker: str) -> int | None:
    """The id of the first comment whose body starts with the marker (12.14): ``comments(pos, id, body)``."""
    row = comments.where(F.col("id").isNotNull() & F.startswith("body", F.lit(marker))).orderBy("pos").select("id").first()
    return row.id if row else None


def mismatches(points: DataFrame) -> DataFrame:
    """Points that the two raters judge differently (12.10)."""
    return points.where("human <> judge")


def triage_report(points: DataFrame, corrections: DataFrame) -> DataFrame:
    """Mismatches by bucket (5.22); one without a correction is an error."""
    out = mismatches(points).join(corrections.select("item_id", "point_id", "bucket"), ["item_id", "point_id"], "left")
    bucket = F.when(F.col("bucket").isNull(), F.raise_error(F.concat(F.lit("untriaged mismatch "), F.col("item_id").cast("string"))).cast("string")).otherwise(F.col("bucket"))
    return out.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


