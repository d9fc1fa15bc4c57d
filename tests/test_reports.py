"""Reports as lines: headlines, signs, sealed holdouts, missing audits, orders."""

import pytest

from marginalia.operators import ladders
from marginalia.plans import reports


def test_gaps_and_sides(spark):
    gaps = spark.createDataFrame([("a", "b", -0.125, -0.2, 0.05, None), ("b", "c", 0.1, 0.05, 0.2, False), ("a", "c", 0.0, 0.0, 0.0, True)], "baseline_arm string, treatment_arm string, point double, low double, high double, within_noise boolean")
    sides = spark.createDataFrame([("a", 0.5, None, None), ("b", 0.25, 0.5, -0.25)], "arm string, dev_rate double, holdout_rate double, divergence double")
    lines = reports.text_of(reports.gap_report(gaps, sides, "run")).split("\n")
    assert lines[2:5] == ["b - a | -12.50% | [-20.00%, +5.00%] | no audit", "c - a | +0.00% | [+0.00%, +0.00%] | within noise", "c - b | +10.00% | [+5.00%, +20.00%] | real"]
    assert lines[6:] == ["a | 50.00% | sealed | sealed", "b | 25.00% | 50.00% | -25.00%"]


def test_scores(spark):
    rows = [("all", 3, 0.5, 1.0, None, 0.25, 0.5, 12.6, 0.1), ("answer", 2, 0.0, 0.5, 0.1, 0.2, 0.3, None, None)]
    frame = spark.createDataFrame(rows, "slice string, n long, strict_pass_rate double, behavior_rate double, cite_precision double, cite_recall double, hit_rate double, p50_latency_ms double, cost_usd double")
    lines = reports.text_of(reports.score_report(frame, "run")).split("\n")
    assert lines[1] == "strict pass, all items: 50.00% of 3"
    assert lines[3:5] == ["answer | 2 | 0.00% | 50% | 10.00% | 20.00% | 30% | – | –", "all | 3 | 50.00% | 100% | – | 25.00% | 50% | 13 | 0.1000"]


@pytest.mark.parametrize(("delta", "said"), [(0.1, "agent ahead"), (-0.1, "naive ahead"), (0.0, "tied")])
def test_arms(spark, delta, said):
    names = ["naive_strict_pass", "agent_strict_pass", "naive_behavior_match", "agent_behavior_match", "naive_cite_recall", "agent_cite_recall"]
    frame = spark.createDataFrame([("all", 5, *[0.5] * 6, delta)], "slice string, n long, " + ", ".join(f"{n} double" for n in names) + ", strict_pass_delta double")
    assert f"({said}) of 5" in reports.text_of(reports.arm_report(frame, "run"))


def test_order_noise_and_verification(spark):
    probe = spark.createDataFrame([(0, 4, 0.5, 0.25, True), (10, 4, 0.75, 0.25, True), (9, 4, 0.5, 0.25, True)], "seed int, n long, rate double, spread double, is_order_sensitive boolean")
    assert reports.text_of(reports.order_report(probe, "r")).split("\n")[2:] == ["0 | 4 | 50.00% (as it is)", "9 | 4 | 50.00%", "10 | 4 | 75.00%", "order matters: strict pass moves by 25.00%"]
    assert reports.text_of(reports.order_report(probe.withColumn("is_order_sensitive", probe.n < 0), "r")).endswith("order does not matter")
    assert reports.text_of(reports.noise_report(spark.createDataFrame([("a", 0.02)], "arm string, spread double"), "r")).endswith("a | 2.00%")
    checked = spark.createDataFrame([("x", "ok", None), ("y", "mismatch", "sha256"), ("z", "error", "absent")], "id string, status string, detail string")
    assert reports.text_of(reports.verification_report(checked, "r")).split("\n")[1:] == ["y: mismatch: sha256", "z: error: absent", "error 1", "mismatch 1", "ok 1"]


def test_ladders(spark):
    rows = [(r[2], i, (i + n) % 3 == 0) for n, r in enumerate(ladders.rungs()) for i in range(12)]
    run = ladders.ladder_run(spark, spark.createDataFrame(rows, "rung_id string, item_id long, strict_pass boolean"), 7, 20)
    lines = reports.text_of(reports.ladder_report(run, "r")).split("\n")
    assert len(lines) == 2 + 17 + 1 and lines[2].startswith("build-up | floor | naive-chunks | ") and lines[2].endswith("| – | –") and lines[11].startswith("knock-out | hierarchy-chunks")
    with pytest.raises(ValueError):
        reports.text_of(reports.ladder_report(run, "r"), most=5)
