"""A memoising cache that concurrent runs share: every key is made once.

    memo = Memo(spark, folder, make, "value string")
    values, counts = memo.get(requests)      # requests(key, more columns that make needs)

Values lie as Parquet below the folder. A run first looks keys up; what is missing it claims, makes and stores. Of two
runs that miss a key at the same time only one makes it, the other waits for its value (coalescing).

Runs take tickets, numbers of files that only one of them can create. A run writes its claims and marks them as
written; before it looks at the claims of others it waits for the marks of all smaller tickets. So of two runs that
claim a key the one with the larger ticket sees both, and leaves the key to the other. A run that fails says so, and
one that is silent for ``patience`` seconds counts as failed: its keys are claimed anew by those that wait.

``counts``: hits (found), misses (made here) and coalesced (made by another run meanwhile), in requests, from
``Observation``s of the frames as they are written. Only tickets and marks, a few files a run, are seen by the driver.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.plans.scratch import materialize


class Memo:
    """Values by key below ``folder``; ``make(requests)`` gives ``(key, value columns)`` for distinct keys."""

    def __init__(self, spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame], schema: str | StructType, *, patience: float = 600.0, pause: float = 0.2):
        self.spark, self.folder, self.make, self.patience, self.pause = spark, folder.rstrip("/"), make, patience, pause
        fields = spark.createDataFrame([], schema).schema
        self.schema = StructType().add("key", "string")
        for field in fields:
            self.schema.add(field)

    # files of the shared folder, by the session's file system

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _is(self, name: str) -> bool:
        return self._files().exists(self._path(name))

    def _mark(self, name: str) -> bool:
        """Create an empty file; False if it is there already."""
        return bool(self._files().createNewFile(self._path(name)))

    def _tables(self, kind: str, schema: StructType | str) -> DataFrame:
        """All tables of one kind that runs have finished to write."""
        found = self._files().globStatus(self._path(f"{kind}/*/_SUCCESS"))
        places = [s.getPath().getParent().toString() for s in found or []]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def stored(self) -> DataFrame:
        """``(key, value columns)`` of all values."""
        return self._tables("values", self.schema)

    def _ticket(self) -> int:
        files = self._files()
        files.mkdirs(self._path("marks"))
        known = files.globStatus(self._path("marks/ticket-*"))
        n = max((int(s.getPath().getName().rpartition("-")[2]) for s in known or []), default=0) + 1
        while not self._mark(f"marks/ticket-{n:012d}"):
            n += 1
        return n

    def _ended(self, ticket: int) -> bool:
        return self._is(f"marks/done-{ticket:012d}") or self._is(f"marks/failed-{ticket:012d}")

    def _await(self, tickets: list[int], written: Callable[[int], bool]) -> None:
        """Wait until each of the tickets has its mark; those that stay silent too long are marked as failed."""
        for ticket in tickets:
            since = self._files().getFileStatus(self._path(f"marks/ticket-{ticket:012d}")).getModificationTime() / 1000
            while not (written(ticket) or self._ended(ticket)):
                if time.time() - since > self.patience:
                    self._mark(f"marks/failed-{ticket:012d}")
                time.sleep(self.pause)

    def _before(self, ticket: int) -> list[int]:
        known = self._files().globStatus(self._path("marks/ticket-*"))
        return sorted(n for s in known or [] if (n := int(s.getPath().getName().rpartition("-")[2])) < ticket)

    def _live(self, tickets: list[int]) -> list[int]:
        return [t for t in tickets if not self._is(f"marks/failed-{t:012d}")]

    def _run(self, missing: DataFrame) -> tuple[DataFrame, bool]:
        """One claim round over ``missing(key, ...)``: the keys that this run made, and whether others' keys were waited for."""
        ticket = self._ticket()
        name = f"{ticket:012d}"
        try:
            missing.select("key", F.lit(ticket).cast("long").alias("ticket")).write.parquet(f"{self.folder}/claims/{name}")
            self._mark(f"marks/claimed-{name}")
            earlier = self._before(ticket)
            self._await(earlier, lambda t: self._is(f"marks/claimed-{t:012d}"))
            rivals = [t for t in self._live(earlier) if not self._is(f"marks/done-{t:012d}")]
            held = self._tables("claims", "key string, ticket long").where(F.col("ticket").isin(rivals)).select("key").distinct()
            # what a run that has ended meanwhile has stored is there by now
            mine = missing.join(held, "key", "left_anti").join(self.stored().select("key"), "key", "left_anti")
            made = self.make(mine).select(*self.schema.names)
            made.write.parquet(f"{self.folder}/values/{name}-{uuid.uuid4().hex[:8]}")
            self._mark(f"marks/done-{name}")
        except BaseException:
            self._mark(f"marks/failed-{name}")
            raise
        self._await(rivals, lambda t: False)
        return mine.select("key"), bool(rivals)

    def get(self, requests: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """``requests`` with the value columns of their keys, and the counts of hits, misses and coalesced requests.

        Requests with a null key have null values and count as nothing. An error of ``make`` is raised, after the run's
        keys are free again for others.
        """
        asked = materialize(requests)
        known = self.stored().select("key")
        observed = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("hits", "misses")}
        hit = asked.select("key").join(known, "key", "left_semi")
        _write_nothing(hit.observe(observed["hits"], F.count(F.lit(1)).alias("n")))
        keyed = asked.where(F.col("key").isNotNull())
        made: list[DataFrame] = []
        while True:
            missing = materialize(keyed.join(self.stored().select("key"), "key", "left_anti").dropDuplicates(["key"]))
            if missing.isEmpty():
                break
            keys, waited = self._run(missing)
            made.append(materialize(keys))
            if not waited:
                break
        mine = reduce(DataFrame.unionByName, made).distinct() if made else known.limit(0)
        _write_nothing(asked.select("key").join(mine, "key", "left_semi").observe(observed["misses"], F.count(F.lit(1)).alias("n")))
        counts = {name: o.get["n"] for name, o in observed.items()}
        counts["coalesced"] = keyed.count() - counts["hits"] - counts["misses"]
        return asked.join(self.stored(), "key", "left"), counts


def _write_nothing(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
