"""Dashboards, agreement and digests over scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.numbers import kappa_of, trust_band

DIGITS = 6


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def slices_and_all(rows: DataFrame, by: str, *measures: Column) -> DataFrame:
    """Measures for each value of ``by`` and for ``all``: one pass with grouping sets."""
    keyed = rows.withColumn("__by", F.col(by))
    out = keyed.groupingSets([["__by"], []], "__by").agg(F.grouping("__by").alias("__all"), *measures)
    return out.withColumn("slice", F.when(F.col("__all") == 1, "all").otherwise(F.col("__by"))).drop("__by", "__all")


def score_dashboard(scores: DataFrame, by: str = "behavior_class") -> DataFrame:
    """The table of a run (5.8): counts, rates, median latency and cost by class and over all."""
    r = lambda c: F.round(c, DIGITS)
    return slices_and_all(
        scores, by, F.count(F.lit(1)).alias("n"), r(share(F.col("strict_pass"))).alias("strict_pass_rate"), r(share(F.col("behavior_match"))).alias("behavior_rate"),
        r(F.avg("cite_precision")).alias("cite_precision"), r(F.avg("cite_recall")).alias("cite_recall"), r(F.avg("retrieval_hit_rate")).alias("hit_rate"),
        r(F.median("latency_ms")).alias("p50_latency_ms"), r(F.sum("cost_usd")).alias("cost_usd"),
    )


def require_same_items(arms: dict[str, DataFrame]) -> None:
    """All arms cover the same item ids (4.8, 8.6): only a count reaches the driver."""
    names = list(arms)
    ids = [arms[n].select("item_id").distinct().withColumn("arm", F.lit(n)) for n in names]
    partial = reduce(DataFrame.unionByName, ids).groupBy("item_id").count().where(F.col("count") < len(names))
    if partial.limit(1).count():
        raise ValueError("arms must cover the same item ids")


def arm_comparison(baseline: DataFrame, treatment: DataFrame, measure: str, by: str = "behavior_class") -> DataFrame:
    """Mean of a measure in two arms and the difference, by class and over all (5.9)."""
    joined = baseline.select("item_id", by, F.col(measure).alias("a")).join(treatment.select("item_id", F.col(measure).alias("b")), "item_id")
    out = slices_and_all(joined, by, F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), DIGITS).alias("baseline"), F.round(F.avg("b"), DIGITS).alias("treatment"), F.round(F.avg("b") - F.avg("a"), DIGITS).alias("delta"))
    return out


def arm_table(scores: DataFrame, arms: list[str] | None, rag_arms: list[str], by: str = "behavior_class") -> DataFrame:
    """Cells of (slice, arm) (5.11): retrieval measures are null outside the retrieval arms."""
    keyed = (scores if arms is None else scores.where(F.col("arm").isin(arms))).withColumn("__by", F.col(by))
    out = keyed.groupingSets([["__by", "arm"], ["arm"]], "__by", "arm").agg(
        F.grouping("__by").alias("__all"), F.count(F.lit(1)).alias("n"), F.round(share(F.col("strict_pass")), DIGITS).alias("strict_pass_rate"), F.round(F.avg("retrieval_hit_rate"), DIGITS).alias("__hit")
    )
    rag = F.col("arm").isin(rag_arms)
    return out.select(F.when(F.col("__all") == 1, "all").otherwise(F.col("__by")).alias("slice"), "arm", "n", "strict_pass_rate", F.when(rag, F.col("__hit")).alias("hit_rate"))


def agreement(points: DataFrame, by: str | None = None) -> DataFrame:
    """Kappa, observed agreement, prevalence and band over (human, judge) booleans (5.15-5.18)."""
    h, j = F.col("human").cast("double"), F.col("judge").cast("double")
    measures = [F.count(F.lit(1)).alias("n"), F.avg((F.col("human") == F.col("judge")).cast("double")).alias("__o"), F.avg(h).alias("__h"), F.avg(j).alias("__j")]
    out = slices_and_all(points, by, *measures) if by else points.agg(*measures).withColumn("slice", F.lit("all"))
    kappa = F.round(kappa_of(F.col("__o"), F.col("__h"), F.col("__j")), DIGITS)
    out = out.withColumn("kappa", kappa).withColumn("observed_agreement", F.round("__o", DIGITS)).withColumn("positive_prevalence", F.round((F.col("__h") + F.col("__j")) / 2, DIGITS))
    return out.withColumn("band", trust_band(F.col("kappa"))).drop("__o", "__h", "__j")


def rater_kappas(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """Kappa of every pair of raters over (point_id, rater, credited) (5.18)."""
    wide = ratings.groupBy("point_id").pivot("rater", raters).agg(F.first("credited"))
    pairs = [(a, b) for i, a in enumerate(raters) for b in raters[i + 1 :]]
    parts = [agreement(wide.select(F.col(a).alias("human"), F.col(b).alias("judge"))).select(F.lit(f"{a}~{b}").alias("pair"), "n", "kappa") for a, b in pairs]
    return reduce(DataFrame.unionByName, parts)


def noise_floor(repeats: DataFrame) -> DataFrame:
    """Per arm the least and greatest rate over repeats, and the spread (5.19)."""
    rates = repeats.groupBy("arm", "repeat").agg(F.avg(F.col("strict_pass").cast("double")).alias("rate"))
    return rates.groupBy("arm").agg(F.count(F.lit(1)).alias("repeats"), F.round(F.min("rate"), DIGITS).alias("low"), F.round(F.max("rate"), DIGITS).alias("high"), F.round(F.max("rate") - F.min("rate"), DIGITS).alias("spread"))


def failure_digest(failures: DataFrame) -> DataFrame:
    """Clusters of stage, class and corpus: number, sorted ids, dispositions (5.21)."""
    keys = ["stage", "behavior_class", "corpus"]
    tally = failures.groupBy(*keys, "disposition").agg(F.count(F.lit(1)).alias("m"))
    tallies = tally.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce("disposition", F.lit("none")), F.col("m")))), ",").alias("dispositions"))
    clusters = failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item"))
    return clusters.join(tallies, keys)


def failed_items(scores: DataFrame, items: DataFrame, traces: DataFrame) -> DataFrame:
    """Failures with a trace, their stage and corpus (4.16); an unknown item is an error."""
    failed = scores.where(~F.col("strict_pass")).join(traces.where("trace_id is not null"), "item_id")
    known = failed.join(items.select("item_id", "corpus"), "item_id", "left")
    corpus = F.when(F.col("corpus").isNull(), F.raise_error(F.concat(F.lit("unknown item "), F.col("item_id").cast("string"))).cast("string")).otherwise(F.col("corpus"))
    return known.withColumn("corpus", corpus).withColumn("stage", F.when(F.col("retrieval_hit_rate") < 1.0, "retrieval").otherwise("synthesis"))


def undispositioned(queue: DataFrame, dispositions: DataFrame, valid: list[str]) -> DataFrame:
    """Queued objects without a valid disposition (4.17)."""
    return queue.join(dispositions.where(F.col("disposition").isin(valid)).select("object_id").distinct(), "object_id", "left_anti")


def apply_corrections(points: DataFrame, corrections: DataFrame) -> DataFrame:
    """Relabel the human side where triage says so (4.15): (item_id, point_id, human, judge)."""
    out = points.join(corrections.select("item_id", "point_id", "bucket", "corrected"), ["item_id", "point_id"], "left")
    human = F.when((F.col("bucket") == "human-error") & (F.col("human") != F.col("judge")), F.col("corrected")).otherwise(F.col("human"))
    return out.withColumn("human", human).drop("bucket", "corrected")


def long_scores(scores: DataFrame, measures: list[str], trace: str = "trace_id") -> DataFrame:
    """(trace_id, name, value): one row a measure; rows without a trace or value drop (1.30)."""
    wide = scores.where(F.col(trace).isNotNull()).select(F.col(trace).alias("trace_id"), *[F.col(m).cast("double").alias(m) for m in measures])
    return wide.unpivot("trace_id", measures, "name", "value").where("value is not null")


def point_scores(verdicts: DataFrame) -> DataFrame:
    """Credited share of an item's points, and whether all are (5.25)."""
    return verdicts.groupBy("item_id").agg(F.round(share(F.col("credited")), DIGITS).alias("point_score"), F.every("credited").alias("all_credited"))


def within_noise(gaps: DataFrame, floors: DataFrame) -> DataFrame:
    """Whether each gap lies within the greatest spread (3.30)."""
    return gaps.join(F.broadcast(floors.agg(F.coalesce(F.max("spread"), F.lit(0.0)).alias("floor")))).withColumn("within_noise", F.abs("gap") <= F.col("floor"))
