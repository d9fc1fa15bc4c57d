"""Key-value stores: a bucketed table with upserts, and the states of streams by key.

A store is a folder of Parquet files partitioned by a hash of the key. An upsert reads and replaces
the buckets that its changes fall in and leaves the files of all others untouched; a lookup
reads the buckets of its keys, and within them only row groups that may hold one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from marginalia.plans.scratch import materialize


class KeyedStore:
    """A table of one row a key below ``path``; rows with a null key are not kept."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, n_buckets: int = 64):
        self.spark, self.path, self.key, self.n_buckets = spark, path.rstrip("/"), key, n_buckets
        empty = spark.createDataFrame([], schema)
        if "bucket" in (c.lower() for c in empty.columns):
            raise ValueError("the column name bucket is taken by the store")
        self.schema = empty.schema
        self.stored = StructType([*self.schema.fields]).add("bucket", IntegerType())

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.n_buckets)).cast("int")

    def _rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(self.path)

    def read(self) -> DataFrame:
        """All rows."""
        return self._rows().drop("bucket")

    def load(self, keys: list) -> DataFrame:
        """The rows of some keys; the scan skips all buckets without one."""
        if not keys:
            return self.read().limit(0)
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]])).select(self._bucket().alias("b")).distinct()
        return self._rows().where(F.col("bucket").isin([r.b for r in wanted.collect()]) & F.col(self.key).isin(keys)).drop("bucket")

    def upsert(self, changes: DataFrame, order: str | None = None) -> list[int]:
        """Put rows in place of those with their key; the buckets that were written.

        Of several changes of one key the one with the largest ``order`` counts, ties and no order: any
        one of them. ``order`` need not be a column of the store.
        """
        known = changes.where(F.col(self.key).isNotNull())
        newest = F.row_number().over(Window.partitionBy(self.key).orderBy(*([F.desc(order)] if order else []), F.lit(0)))
        rows = known.withColumn("newest", newest).where("newest = 1").select(*self.schema.names).withColumn("bucket", self._bucket())
        rows = materialize(rows)
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most n_buckets
        if not touched:
            return []
        old = self._rows().where(F.col("bucket").isin(touched)).join(rows.select(self.key), self.key, "left_anti")
        merged = materialize(old.select(*self.stored.names).unionByName(rows.select(*self.stored.names)))
        dealt = merged.repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched


def stream_states(spark: SparkSession, checkpoint: str, variable: str, store: str | None = None) -> DataFrame:
    """(key, value, partition_id) of a state variable of a stream, as of its last committed batch."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return (reader.option("storeName", store) if store else reader).load(checkpoint)


def load_states(spark: SparkSession, checkpoint: str, variable: str, keys: list, key: str) -> DataFrame:
    """The states of some keys, as columns of the key and the value."""
    found = stream_states(spark, checkpoint, variable)
    return found.where(F.col(f"key.{key}").isin(keys)).select("key.*", "value.*")
