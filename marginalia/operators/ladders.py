"""Ablation ladders: components, rungs, builds and the live run plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.stats import DIGITS, resampled_sums
from marginalia.plans.scratch import materialize

# Components in order of dependency, with how each is switched off; builds.
COMPONENTS = [
    ("hierarchy-chunks", "corpus-build"), ("contextual-enrichment", "corpus-build"), ("hybrid-bm25", "unsupported"), ("metadata-filters", "unsupported"),
    ("graph-expansion", "query-env"), ("authority-rerank", "query-env"), ("planner", "query-env"), ("critic", "unsupported"),
]
BUILDS = ["naive-chunks", "no-enrichment", "full"]
KEYS = [k for k, _ in COMPONENTS]
LIVE = [k for k, how in COMPONENTS if how != "unsupported"]
PLAN = "ladder string, rung int, rung_id string, component string, components array<string>, build string"


def build_for(on: list[str], pinned: list[str]) -> str:
    """The corpus build of a set of components (10.22); one that is not pinned is an error."""
    build = BUILDS[0] if "hierarchy-chunks" not in on else BUILDS[1] if "contextual-enrichment" not in on else BUILDS[2]
    if build not in pinned:
        raise ValueError(f"build {build!r} is not pinned")
    return build


def rungs(pinned: list[str] | None = None, live: bool = False) -> list[tuple]:
    """Rungs of both ladders (12.6-12.8): each component added in turn, then each taken from the whole.

    ``live``: only components that can be switched off; the others are always on.
    """
    keys, pinned = (LIVE if live else KEYS), pinned or BUILDS
    out = []
    for n in range(len(keys) + 1):
        on = [k for k in KEYS if k in keys[:n] or k not in keys]
        out.append(("build-up", n, f"buildup-{n:02d}-{keys[n - 1] if n else 'floor'}", keys[n - 1] if n else None, on, build_for(on, pinned)))
    for n, key in enumerate(keys):
        on = [k for k in KEYS if k != key]
        out.append(("knock-out", n, f"knockout-{n:02d}-{key}", key, on, build_for(on, pinned)))
    return out


def run_plan(spark: SparkSession, pinned: list[str] | None = None, live: bool = True) -> DataFrame:
    """The rungs as a table."""
    return spark.createDataFrame(rungs(pinned, live), PLAN)


def scored_plan(plan: DataFrame, scores: DataFrame) -> DataFrame:
    """Rungs with their rates (4.19); a rung without a score is an error, never 0."""
    missing = [r.rung_id for r in plan.select("rung_id").join(scores, "rung_id", "left_anti").collect()]
    if missing:
        raise ValueError(f"rungs without a score: {sorted(missing)}")
    return plan.join(scores.select("rung_id", "rate"), "rung_id")


def compared_rungs(seed: int) -> list[tuple[str, str, int]]:
    """(rung, the rung it is held against, its seed): build-up rungs against the one before, knock-outs against the whole."""
    both = rungs()
    up, out = ([r[2] for r in both if r[0] == ladder] for ladder in ("build-up", "knock-out"))
    built = [(rung, up[n - 1], seed + n) for n, rung in enumerate(up) if n]
    return built + [(rung, up[-1], seed + len(KEYS) + 1 + n) for n, rung in enumerate(out)]


def ladder_run(spark: SparkSession, scores: DataFrame, seed: int, iterations: int = 2000, confidence: float = 0.95) -> DataFrame:
    """Both ladders with rates, changes and their intervals (12.7): ``scores(rung_id, item_id, strict_pass)``.

    ``(ladder, rung, rung_id, component, build, rate, delta, low, high, iterations)``; the floor's change is 0.
    A change is the mean over items of a rung's pass less that of the rung it is held against; items are resampled
    with that rung's seed. All rungs are resampled in one pass: a task sends two sums for each rung and resample.
    A rung without scores, or two compared rungs that do not cover the same items, are errors.
    """
    if iterations <= 0 or not 0.0 < confidence < 1.0:
        raise ValueError("iterations must be positive and confidence between 0 and 1")
    plan = run_plan(spark, live=False)
    pairs = spark.createDataFrame(compared_rungs(seed), "rung_id string, base_id string, seed int")
    known = scores.select("rung_id", "item_id", F.col("strict_pass").cast("int").alias("pass")).where("pass is not null")
    rates = scored_plan(plan, known.groupBy("rung_id").agg(F.round(F.avg("pass"), DIGITS).alias("rate")))
    roles = pairs.select("rung_id", "seed", F.explode(F.array(F.struct(F.col("rung_id").alias("of"), F.lit(1).alias("sign")), F.struct(F.col("base_id").alias("of"), F.lit(-1).alias("sign")))).alias("r"))
    roles = roles.select("rung_id", "seed", F.col("r.of").alias("of"), F.col("r.sign").alias("sign"))  # two rows a rung
    each = known.withColumnRenamed("rung_id", "of").join(F.broadcast(roles), "of")
    gaps = each.groupBy("rung_id", "seed", "item_id").agg(F.sum(F.col("sign") * F.col("pass")).alias("gap"), F.sum("sign").alias("left"), F.count(F.lit(1)).alias("n"))
    gaps = materialize(gaps)
    if odd := gaps.where("left <> 0 or n <> 2").first():
        raise ValueError(f"rung {odd.rung_id!r} and the one it is held against do not cover the same items once each: {odd.item_id!r}")
    point = gaps.groupBy("rung_id").agg(F.round(F.avg("gap"), DIGITS).alias("delta"))
    drawn = resampled_sums(gaps.select(F.col("rung_id").alias("grp"), "seed", F.col("item_id").cast("string").alias("item"), F.col("gap").cast("double").alias("value")), iterations)
    means = drawn.where("below > 0").select(F.col("grp").alias("rung_id"), "iteration", (F.col("above") / F.col("below")).alias("mean"))
    tail = (1.0 - confidence) / 2
    bound = lambda at: F.round(F.percentile("mean", F.lit(at)), DIGITS)
    spread = means.groupBy("rung_id").agg(bound(tail).alias("low"), bound(1.0 - tail).alias("high"))
    out = rates.join(point, "rung_id", "left").join(spread, "rung_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select("ladder", "rung", "rung_id", "component", "build", "rate", zero("delta"), zero("low"), zero("high"), F.lit(iterations).alias("iterations"))
