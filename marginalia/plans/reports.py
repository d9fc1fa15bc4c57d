"""The reports of runs, one of a kind each, as tables of lines.

Every report takes result tables of ``operators`` and gives ``(part, key, line)``: lines to be read in the order of part and
key. They are made by column expressions, so a report costs what its tables cost; ``text_of`` joins the few lines
that a report has. Rates are percentages with two places, changes have a sign, what is not there is a dash or says
why: a sealed holdout is ``sealed``, a gap without an audit has no label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DASH = "–"


def number(value: Column, places: int) -> Column:
    """A number with so many places; null as a dash."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value.cast("double"))).otherwise(DASH)


def percent(value: Column, places: int = 2) -> Column:
    """0.5 as ``50.00%``; null as a dash."""
    return F.when(value.isNotNull(), F.concat(number(value * 100, places), F.lit("%"))).otherwise(DASH)


def signed(value: Column, places: int = 2) -> Column:
    """A change as a percentage with its sign; null as a dash."""
    shown = F.concat(F.when(value < 0, "-").otherwise("+"), percent(F.abs(value), places))
    return F.when(value.isNull(), DASH).otherwise(shown)


def _cells(*values: Column) -> Column:
    return F.concat_ws(" | ", *values)


def _line(of: DataFrame, part: int, key: Column, line: Column) -> DataFrame:
    return of.select(F.lit(part).alias("part"), key.cast("string").alias("key"), line.alias("line"))


def _fixed(of: DataFrame, part: int, *lines: str) -> DataFrame:
    rows = [(part, f"{i:03d}", line) for i, line in enumerate(lines)]
    return of.sparkSession.createDataFrame(rows, "part int, key string, line string")


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def text_of(report: DataFrame, most: int = 2000) -> str:
    """A report as text; more than ``most`` lines are an error."""
    lines = report.orderBy("part", "key").limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"a report has at most {most} lines")
    return "\n".join(r.line for r in lines)


def _slices(rows: DataFrame, part: int, line: Column, name: str = "slice") -> DataFrame:
    """The lines of slices by name, the one over all last."""
    return _line(rows, part, F.concat(F.when(F.col(name) == "all", "1").otherwise("0"), F.col(name)), line)


def score_report(dashboard: DataFrame, run: str) -> DataFrame:
    """``evaluation.score_dashboard`` with a headline: rates of each slice, median latency, cost."""
    head = dashboard.where("slice = 'all'")
    line = _cells(
        F.col("slice"), F.col("n").cast("string"), percent(F.col("strict_pass_rate")), percent(F.col("behavior_rate"), 0), percent(F.col("cite_precision")),
        percent(F.col("cite_recall")), percent(F.col("hit_rate"), 0), number(F.col("p50_latency_ms"), 0), number(F.col("cost_usd"), 4),
    )
    headline = F.concat(F.lit("strict pass, all items: "), percent(F.col("strict_pass_rate")), F.lit(" of "), F.col("n"))
    return _all(
        _fixed(dashboard, 0, f"# {run}: scores"), _line(head, 1, F.lit(""), headline),
        _fixed(dashboard, 2, "slice | n | strict | behaviour | cite precision | cite recall | hits | p50 ms | cost USD"), _slices(dashboard, 3, line),
        _fixed(dashboard, 4, "The last row is over all items, no mean of slices."),
    )


def arm_report(dashboard: DataFrame, run: str, arms: tuple[str, str] = ("naive", "agent")) -> DataFrame:
    """``runs.arm_dashboard`` with who is ahead: the change in strict pass, paired by item, as measured."""
    a, b = arms
    delta = F.col("strict_pass_delta")
    ahead = F.when(delta > 0, f"{b} ahead").when(delta < 0, f"{a} ahead").otherwise("tied")
    headline = F.concat(F.lit("change in strict pass, all items: "), signed(delta), F.lit(" ("), ahead, F.lit(") of "), F.col("n"))
    rate = lambda arm, what, places=2: percent(F.col(f"{arm}_{what}"), places)
    line = _cells(
        F.col("slice"), F.col("n").cast("string"), rate("naive", "strict_pass"), rate("agent", "strict_pass"), signed(delta),
        rate("naive", "behavior_match", 0), rate("agent", "behavior_match", 0), rate("naive", "cite_recall", 0), rate("agent", "cite_recall", 0),
    )
    return _all(
        _fixed(dashboard, 0, f"# {run}: {b} against {a}, paired by item"), _line(dashboard.where("slice = 'all'"), 1, F.lit(""), headline),
        _fixed(dashboard, 2, f"slice | n | {a} strict | {b} strict | change | {a} behaviour | {b} behaviour | {a} cite recall | {b} cite recall"), _slices(dashboard, 3, line),
    )


def gap_report(gaps: DataFrame, sides: DataFrame, run: str, confidence: float = 0.95) -> DataFrame:
    """``runs.gap_dashboard``: each gap with its interval and whether it stands out of the noise, and both sides of each arm."""
    label = F.when(F.col("within_noise").isNull(), "no audit").when(F.col("within_noise"), "within noise").otherwise("real")
    between = F.concat(F.lit("["), signed(F.col("low")), F.lit(", "), signed(F.col("high")), F.lit("]"))
    pair = F.concat("treatment_arm", F.lit(" - "), "baseline_arm")
    sealed = lambda c, shown: F.when(c.isNull(), "sealed").otherwise(shown)
    side = _cells(F.col("arm"), percent(F.col("dev_rate")), sealed(F.col("holdout_rate"), percent(F.col("holdout_rate"))), sealed(F.col("divergence"), signed(F.col("divergence"))))
    return _all(
        _fixed(gaps, 0, f"# {run}: gaps of arms, {confidence:.0%} intervals of paired resamples", "gap | change | interval | label"),
        _line(gaps, 1, pair, _cells(pair, signed(F.col("point")), between, label)), _fixed(gaps, 2, "arm | dev | holdout | dev less holdout"), _line(sides, 3, F.col("arm"), side),
    )


def noise_report(floors: DataFrame, run: str) -> DataFrame:
    """``evaluation.noise_floor``: the spread of repeated runs of each arm."""
    spread = F.col("spread")
    return _all(_fixed(floors, 0, f"# {run}: spread of repeated runs", "arm | spread"), _line(floors, 1, F.col("arm"), _cells(F.col("arm"), percent(spread))))


def order_report(probe: DataFrame, run: str) -> DataFrame:
    """``runs.order_probe``: strict pass by order of the corpus, and whether order matters."""
    tag = F.when(F.col("seed") == 0, " (as it is)").otherwise("")
    line = F.concat(_cells(F.col("seed").cast("string"), F.col("n").cast("string"), percent(F.col("rate"))), tag)
    matters = F.concat(F.lit("order matters: strict pass moves by "), percent(F.max("spread")))
    verdict = probe.agg(F.when(F.bool_or("is_order_sensitive"), matters).otherwise("order does not matter").alias("line"))
    return _all(
        _fixed(probe, 0, f"# {run}: orders of the corpus", "seed | n | strict"), _line(probe, 1, F.lpad(F.col("seed").cast("string"), 20, "0"), line),
        verdict.select(F.lit(2).alias("part"), F.lit("").alias("key"), "line"),
    )


def ladder_report(run_rows: DataFrame, run: str) -> DataFrame:
    """``ladders.ladder_run``: both ladders, each rung with its rate, its change and the interval of that."""
    between = F.concat(F.lit("["), signed(F.col("low")), F.lit(", "), signed(F.col("high")), F.lit("]"))
    floor = (F.col("ladder") == "build-up") & (F.col("rung") == 0)
    line = _cells(F.col("ladder"), F.coalesce("component", F.lit("floor")), F.col("build"), percent(F.col("rate")), F.when(floor, DASH).otherwise(signed(F.col("delta"))), F.when(floor, DASH).otherwise(between))
    return _all(
        _fixed(run_rows, 0, f"# {run}: ladders", "ladder | component | build | strict | change | interval"), _line(run_rows, 1, F.concat("ladder", F.format_string("%04d", "rung")), line),
        _fixed(run_rows, 2, "Build-up rungs change against the rung before, knock-outs against the whole."),
    )


def verification_report(checked: DataFrame, run: str) -> DataFrame:
    """``corpus.verify_sources``-like rows ``(id, status, detail)``: sources that are not as the manifest says, and counts."""
    counts = checked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    odd = checked.where("status <> 'ok'")
    return _all(
        _fixed(checked, 0, f"# {run}: sources against the manifest"), _line(odd, 1, F.col("id"), F.concat_ws(": ", "id", "status", "detail")),
        _line(counts, 2, F.col("status"), F.concat_ws(" ", "status", "n")),
    )
