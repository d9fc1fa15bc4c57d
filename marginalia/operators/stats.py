"""Resampling, splits, slices and ladders.

Two generators of resamples: ``hash`` draws item ``md5(seed:iteration:slot) mod n``,
which any engine can repeat, and ``mersenne`` draws as Python's ``random.Random(seed)``
does, iteration after iteration.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.numbers import kappa_of
from marginalia.functions.poisson import LIMITS, POISSON, sums_of  # noqa: F401 (part of this module's names)

DIGITS = 6
# The generator of permutations.
LCG_FACTOR, LCG_STEP, LCG_MODULUS = 1664525, 1013904223, 1 << 32


#: Draws of the sequential generator that are made together.
DRAWS_AT_ONCE = 100_000


def hash_draw(seed: int, iteration: Column, slot: Column, n: Column) -> Column:
    """An item number in [0, n) from 48 bits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), iteration, slot).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % n).cast("bigint")


def numbered(items: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Items with ``idx`` from 0 by key, and their number. Items are a golden set, not a corpus."""
    n = items.count()
    return items.withColumn("idx", F.row_number().over(Window.orderBy(key)) - 1), n


def draws(spark: SparkSession, n: int, iterations: int, seed: int, generator: str = "hash") -> DataFrame:
    """(iteration, idx): n draws with replacement for each iteration."""
    if generator == "hash":
        grid = spark.range(iterations * n).select(F.expr(f"id div {max(n, 1)}").alias("iteration"), (F.col("id") % max(n, 1)).alias("slot"))  # a range is dealt to all cores
        return grid.select("iteration", hash_draw(seed, F.col("iteration"), F.col("slot"), F.lit(n)).alias("idx"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            rng = random.Random(seed)  # one generator runs through all iterations, as in the sequential definition
            for i in range(iterations):
                for at in range(0, n, DRAWS_AT_ONCE):
                    yield pd.DataFrame({"iteration": i, "idx": [rng.randrange(n) for _ in range(min(DRAWS_AT_ONCE, n - at))]})

    return spark.range(1).coalesce(1).mapInPandas(run, "iteration long, idx long")


def drawn_items(drawn: DataFrame, items: DataFrame) -> DataFrame:
    """``drawn(iteration, idx)`` with the columns of the numbered ``items``.

    Each side is shuffled: the planner takes n x iterations draws for the few rows that they are made of, and would
    send all of them through the driver as a broadcast.
    """
    return drawn.join(items.hint("shuffle_hash"), "idx")


def interval(resampled: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    """Percentiles by linear interpolation (10.12)."""
    tail = (1.0 - confidence) / 2
    return resampled.agg(F.round(F.percentile(value, F.lit(tail)), DIGITS).alias("low"), F.round(F.percentile(value, F.lit(1.0 - tail)), DIGITS).alias("high"), F.count(F.lit(1)).alias("iterations"))


def paired_bootstrap(pairs: DataFrame, seed: int, iterations: int = 2000, confidence: float = 0.95, generator: str = "hash") -> DataFrame:
    """(point, low, high, iterations) of mean(treatment - baseline) over items (12.1)."""
    if iterations <= 0 or not 0.0 < confidence < 1.0:
        raise ValueError("iterations must be positive and confidence between 0 and 1")
    items, n = numbered(pairs.select("item_id", (F.col("treatment") - F.col("baseline")).cast("double").alias("gap")), "item_id")
    if not n:
        raise ValueError("no items")
    gaps = drawn_items(draws(pairs.sparkSession, n, iterations, seed, generator), items).groupBy("iteration").agg(F.avg("gap").alias("gap"))
    return interval(gaps, "gap", confidence).join(items.agg(F.round(F.avg("gap"), DIGITS).alias("point")))


def poisson_weight(seed: Column, iteration: Column, item: Column) -> Column:
    """How often an item is in a resample: a Poisson draw by the hash of seed, iteration and item."""
    digest = F.substring(F.md5(F.concat_ws(":", seed, iteration, item.cast("string")).cast("binary")), 1, 8)
    limits = [f"{limit:08x}" for limit in LIMITS]  # of 32 bits in hex, which sort as numbers do

    def weight(drawn: Column) -> Column:
        out = F.when(drawn < limits[0], 0)
        for n, limit in enumerate(limits[1:], 1):
            out = out.when(drawn < limit, n)
        return out.otherwise(len(limits))

    # the one-element array binds the digest, which is so made once
    return F.get(F.transform(F.array(digest), weight), F.lit(0))


def resampled_sums(rows: DataFrame, iterations: int) -> DataFrame:
    """(grp, iteration, above, below) of ``rows(grp string, seed int, item string, value double)``: the sums of weight x value and
    of Poisson weights over a group's items in each resample, with that group's seed.

    A row stands for a hash a resample, far more work than its bytes tell, so rows are dealt to all cores first;
    a task sends a row for each group and resample, however many items it holds.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = rows.repartition(parts, "grp", "item").mapInArrow(sums_of(iterations), "grp string, iteration int, above double, below long")
    return each.groupBy("grp", "iteration").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))


#: A statistic of weighted rows: given the weight's column, an aggregate over the columns of the items.
Statistic = Callable[[Column], Column]


def mean_of(value: Column) -> Statistic:
    """The mean of a column."""
    return lambda w: F.sum(w * value.cast("double")) / F.sum(w)


def ratio_of(above: Column, below: Column) -> Statistic:
    """The ratio of two sums; null where the lower one is 0."""
    return lambda w: F.try_divide(F.sum(w * above.cast("double")), F.sum(w * below.cast("double")))


def percentile_of(value: Column, fraction: float) -> Statistic:
    """A percentile by linear interpolation, of rows repeated as often as their weight."""
    return lambda w: F.percentile(value.cast("double"), F.lit(fraction), w)


def kappa_between(one: Column, other: Column) -> Statistic:
    """Cohen's kappa of two yes-or-no columns."""
    a, b = one.cast("double"), other.cast("double")
    share = lambda x, w: F.sum(w * x) / F.sum(w)
    return lambda w: kappa_of(share((a == b).cast("double"), w), share(a, w), share(b, w))


def bootstrap_of(
    items: DataFrame, key: str, statistic: Statistic, seed: int, iterations: int = 2000, confidence: float = 0.95, *,
    by: str | None = None, generator: str = "poisson",
) -> DataFrame:
    """(by, point, low, high, iterations) of any statistic of ``items``, resampled with replacement (2.15, 12.1, 12.2).

    ``statistic`` is a weighted aggregate; a resample only changes the weights. ``poisson`` weights come from a hash of
    the item's key, so items need no numbers and no join, groups of ``by`` are resampled in one pass, and a task sends
    what the aggregate merges. ``hash`` and ``mersenne`` draw as ``draws`` does, for all items together.
    """
    if iterations <= 0 or not 0.0 < confidence < 1.0:
        raise ValueError("iterations must be positive and confidence between 0 and 1")
    groups = [by] if by else []
    if generator == "poisson":
        each = items.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        each = each.withColumn("weight", poisson_weight(F.lit(seed), F.col("iteration"), F.col(key))).where("weight > 0")
    else:
        placed, n = numbered(items, key)
        weights = draws(items.sparkSession, n, iterations, seed, generator).groupBy("iteration", "idx").agg(F.count(F.lit(1)).alias("weight"))
        each = drawn_items(weights, placed)
    found = each.groupBy(*groups, "iteration").agg(statistic(F.col("weight")).alias("value"))
    tail = (1.0 - confidence) / 2
    bound = lambda at: F.round(F.percentile("value", F.lit(at)), DIGITS)
    spread = found.groupBy(*groups).agg(bound(tail).alias("low"), bound(1.0 - tail).alias("high"), F.count(F.lit(1)).alias("iterations"))
    point = items.withColumn("weight", F.lit(1)).groupBy(*groups).agg(F.round(statistic(F.col("weight")), DIGITS).alias("point"))
    joined = point.join(spread, groups) if groups else point.join(F.broadcast(spread))  # one row each
    return joined.select(*groups, "point", "low", "high", "iterations")


def poisson_bootstrap(pairs: DataFrame, seed: int, iterations: int = 2000, confidence: float = 0.95) -> DataFrame:
    """(point, low, high, iterations) of mean(treatment - baseline) over items of any number (12.1).

    An item's weight in a resample is a Poisson draw by the hash of its id, so items need no
    numbers and no join, and a task sends one sum for each resample.
    """
    items = pairs.select("item_id", (F.col("treatment") - F.col("baseline")).cast("double").alias("gap"))
    each = items.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    weight = poisson_weight(F.lit(seed), F.col("iteration"), F.col("item_id"))
    means = each.groupBy("iteration").agg((F.sum(weight * F.col("gap")) / F.sum(weight)).alias("gap"))
    return interval(means, "gap", confidence).join(items.agg(F.round(F.avg("gap"), DIGITS).alias("point")))


def kappa_bootstrap(points: DataFrame, seed: int, iterations: int = 2000, confidence: float = 0.95, generator: str = "hash") -> DataFrame:
    """The interval of kappa over resampled points (12.2)."""
    items, n = numbered(points.select("point_id", F.col("human").cast("double").alias("h"), F.col("judge").cast("double").alias("j")), "point_id")

    def kappa(df: DataFrame, *by: str) -> DataFrame:
        sums = df.groupBy(*by).agg(F.avg((F.col("h") == F.col("j")).cast("double")).alias("o"), F.avg("h").alias("h"), F.avg("j").alias("j"))
        return sums.select(*by, kappa_of(F.col("o"), F.col("h"), F.col("j")).alias("kappa"))

    each = kappa(drawn_items(draws(points.sparkSession, n, iterations, seed, generator), items), "iteration")
    return interval(each, "kappa", confidence).join(kappa(items).select(F.round("kappa", DIGITS).alias("point")))


def stratified_split(parents: DataFrame, strata: list[str], key: str = "item_id", frozen: str | None = None) -> DataFrame:
    """``parents`` with ``side`` (6.5): per stratum 70 % dev by sha256 of the key; frozen sides stay.

    New parents fill what the frozen ones leave of the dev quota floor(0.7 n + 0.5).
    """
    pinned = F.col(frozen) if frozen else F.lit(None).cast("string")
    cell = Window.partitionBy(*strata)
    df = parents.withColumn("__pin", pinned).withColumn("__hash", F.sha2(F.col(key).cast("string"), 256))
    quota = F.floor(F.lit(0.7) * F.count(F.lit(1)).over(cell) + F.lit(0.5)) - F.count_if(F.col("__pin") == "dev").over(cell)
    place = F.row_number().over(Window.partitionBy(*strata, F.col("__pin").isNull()).orderBy("__hash", key))
    df = df.withColumn("__quota", F.greatest(quota, F.lit(0))).withColumn("__place", place)
    return df.withColumn("side", F.coalesce("__pin", F.when(F.col("__place") <= F.col("__quota"), "dev").otherwise("holdout"))).drop("__pin", "__hash", "__quota", "__place")


def inherit_sides(items: DataFrame, sides: DataFrame) -> DataFrame:
    """Paraphrases take their parent's side (4.11)."""
    return items.join(sides.select(F.col("item_id").alias("__parent"), "side"), F.coalesce("paraphrase_of", "item_id") == F.col("__parent")).drop("__parent")


def hash_slice(pool: DataFrame, size: int, floors: dict[str, int], rest: str, seed: int, key: str = "item_id") -> DataFrame:
    """A slice of ``size`` items (6.12): a floor for each named class in order, the rest from one class.

    Within a class items are taken in the order of sha256(seed:key).
    """
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256)
    ranked = pool.withColumn("__n", F.row_number().over(Window.partitionBy("behavior_class").orderBy(order, key)))
    counts = {r.behavior_class: r.n for r in pool.where(F.col("behavior_class").isin([*floors, rest])).groupBy("behavior_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, take = size, {}
    for name, floor in floors.items():
        take[name] = max(0, min(floor, counts.get(name, 0), left))
        left -= take[name]
    take[rest] = max(0, min(left, counts.get(rest, 0)))
    limit = F.create_map(*[x for n, k in take.items() for x in (F.lit(n), F.lit(k))])
    return ranked.where(F.col("__n") <= F.coalesce(limit[F.col("behavior_class")], F.lit(0))).drop("__n")


def seeded_slice(ids: list[str], size: int, seed: int) -> list[str]:
    """A sample without replacement of first-seen ids, as Python's generator draws it (12.4)."""
    distinct = list(dict.fromkeys(ids))
    return random.Random(seed).sample(distinct, min(size, len(distinct)))


def permuted(values: list, seed: int) -> list:
    """Seed 0: as they are; else Fisher-Yates from the end with a linear congruential generator (7.13)."""
    out, state = list(values), seed % LCG_MODULUS or 1
    if seed == 0:
        return out
    for i in range(len(out) - 1, 0, -1):
        state = (LCG_FACTOR * state + LCG_STEP) % LCG_MODULUS
        j = state * (i + 1) // LCG_MODULUS  # by the upper bits
        out[i], out[j] = out[j], out[i]
    return out


def ladder_deltas(rates: DataFrame) -> DataFrame:
    """``rates(rung, rate)`` with the change from the rung before (6.8) and from the top rung (6.9)."""
    w = Window.orderBy("rung")
    full = F.max_by("rate", "rung").over(Window.partitionBy())
    return rates.withColumn("step_delta", F.round(F.col("rate") - F.lag("rate").over(w), DIGITS)).withColumn("full_delta", F.round(F.col("rate") - full, DIGITS))


def redundancies(build_up: DataFrame, knock_out: DataFrame, gain: float = 0.10, loss: float = 0.05) -> DataFrame:
    """Components that help when added and are not missed when removed (5.32)."""
    return build_up.select("component", F.col("delta").alias("build_delta")).join(knock_out.select("component", F.col("delta").alias("knock_delta")), "component").where((F.col("build_delta") >= gain) & (F.abs("knock_delta") <= loss))
