"""The shared cache with overlapping and failing runs; the embedding seam with a provider that fails."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from marginalia.operators import embedding
from marginalia.operators.memo import Memo


def asked(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n int")


class Maker:
    """Counts the keys it makes; the first call may be slow or fail."""

    def __init__(self, slow=0.0, fails=0):
        self.made, self.slow, self.fails, self.entered = [], slow, fails, threading.Event()

    def __call__(self, requests):
        keys = [r.key for r in requests.select("key").collect()]
        self.entered.set()
        time.sleep(self.slow)
        self.slow = 0
        if self.fails:
            self.fails -= 1
            raise RuntimeError("provider down")
        self.made += keys
        return requests.select("key", F.upper("key").alias("value"))


def test_hits_and_misses(spark, tmp_path):
    make = Maker()
    memo = Memo(spark, str(tmp_path), make, "value string")
    rows, counts = memo.get(asked(spark, ["a", "b", "a", None]))
    assert counts == {"hits": 0, "misses": 3, "coalesced": 0} and sorted(make.made) == ["a", "b"]
    assert {(r.key, r.n, r.value) for r in rows.collect()} == {("a", 0, "A"), ("b", 1, "B"), ("a", 2, "A"), (None, 3, None)}
    _, counts = Memo(spark, str(tmp_path), make, "value string").get(asked(spark, ["b", "c", "c", "b"]))
    assert counts == {"hits": 2, "misses": 2, "coalesced": 0} and sorted(make.made) == ["a", "b", "c"]
    assert memo.get(asked(spark, []).where("false"))[1] == {"hits": 0, "misses": 0, "coalesced": 0}


def test_overlapping_runs_make_each_key_once(spark, tmp_path):
    """The second run starts while the first is making: common keys are made by the first alone."""
    make, out = Maker(slow=6), {}
    run = lambda name, keys: out.__setitem__(name, Memo(spark, str(tmp_path), make, "value string").get(asked(spark, keys)))
    first = threading.Thread(target=run, args=("first", ["a", "b", "b"]))
    first.start()
    assert make.entered.wait(60)
    run("second", ["b", "c", "a", "b"])
    first.join()
    assert sorted(make.made) == ["a", "b", "c"]
    assert out["first"][1] == {"hits": 0, "misses": 3, "coalesced": 0} and out["second"][1] == {"hits": 0, "misses": 1, "coalesced": 3}
    assert {r.value for r in out["second"][0].collect()} == {"A", "B", "C"}


def test_keys_of_a_failed_run_are_claimed_anew(spark, tmp_path):
    make, out = Maker(slow=5, fails=1), []

    def failing():
        try:
            Memo(spark, str(tmp_path), make, "value string").get(asked(spark, ["a", "b"]))
        except RuntimeError as error:
            out.append(str(error))

    first = threading.Thread(target=failing)
    first.start()
    assert make.entered.wait(60)
    rows, counts = Memo(spark, str(tmp_path), make, "value string").get(asked(spark, ["b", "c"]))
    first.join()
    assert out == ["provider down"] and counts == {"hits": 0, "misses": 2, "coalesced": 0} and sorted(make.made) == ["b", "c"]
    assert rows.where("value is null").count() == 0


def test_silent_runs_count_as_failed(spark, tmp_path):
    """A ticket whose run died before it claimed holds nobody up for longer than the patience."""
    make = Maker()
    memo = Memo(spark, str(tmp_path), make, "value string", patience=1.0)
    assert memo._ticket() == 1 and memo._ticket() == 2
    assert memo.get(asked(spark, ["a"]))[1] == {"hits": 0, "misses": 1, "coalesced": 0}


# --- embedding --------------------------------------------------------------------------


def flaky(texts):
    """Fails the first two times that a task sees a batch."""
    seen = flaky.__dict__.setdefault("seen", {})
    key = tuple(texts)
    seen[key] = seen.get(key, 0) + 1
    if seen[key] < 3:
        raise embedding.ProviderError("busy")
    return embedding.counting_provider(texts)


@pytest.mark.parametrize("arrow", ["7", "10000"])
def test_batches_cross_arrow_borders(spark, arrow):
    rows = spark.range(250).select("id", F.when(F.col("id") % 50 != 0, F.concat(F.lit(f"text e {arrow} "), "id")).alias("text")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        found = embedding.embed(rows, flaky, spacing=0, first_ms=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = [sum(r.batch == b for r in found) for b in range(3)]
    assert [r.id for r in found] == list(range(250)) and sizes == [96, 96, 58] and {r.tries for r in found} == {3}
    assert all(r.vector == embedding.counting_provider(["" if r.id % 50 == 0 else f"text e {arrow} {r.id}"])[0] for r in found)


def test_calls_of_all_tasks_keep_their_distance(spark):
    """Three lanes, a provider that tells when it was called: never two calls within the spacing, retries too."""

    def clock(texts):
        now, seen = time.time(), clock.__dict__.setdefault("seen", set())
        if tuple(texts) not in seen:
            seen.add(tuple(texts))
            raise embedding.ProviderError(str(now))
        return [[now]] * len(texts)

    rows = spark.range(60).select("id", F.col("id").cast("string").alias("text"))
    found = embedding.embed(rows, clock, batch=8, lanes=3, spacing=0.3, first_ms=10).collect()
    assert sorted(r.id for r in found) == list(range(60)) and {r.tries for r in found} == {2}
    calls = sorted({(r.slot, r.vector[0]) for r in found})
    assert len({s for s, _ in calls}) == len(calls) >= 8
    assert all(b - a >= 0.3 * (t - s) - 0.15 for (s, a), (t, b) in zip(calls, calls[1:], strict=False))


def test_failures_that_last_and_wrong_answers(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")

    def down(texts):
        raise embedding.ProviderError("down for good")

    with pytest.raises(Exception, match="down for good"):
        embedding.embed(rows, down, spacing=0, first_ms=1, tries=2).collect()
    with pytest.raises(Exception, match="1 texts, 2 vectors"):
        embedding.embed(rows, lambda texts: [[1.0], [2.0]], spacing=0).collect()
    assert embedding.embed(rows.limit(0), down, spacing=0).collect() == []


def test_slots_and_backoff():
    lanes = [embedding.Slots(100.0, 2.0, lane, 3) for lane in range(3)]
    taken = [lane.next(now)[0] for now in (100.0, 100.5, 117.0) for lane in lanes]
    assert len(set(taken)) == 9 and all(s % 3 == i % 3 for i, s in enumerate(taken)) and min(taken[6:]) >= 9
    assert [embedding.backoff_ms(i, 5) for i in range(7)] == [1005, 2005, 4005, 8005, 16005, 30005, 30005]
