"""A table that is kept by a key, such as an author, and rewritten only where that key's rows have changed.

The rows of a key are one partition. An update compares a signature of each key's rows with
that of the last commit, overwrites the partitions of keys that differ, and commits the
signatures at the end. A key that is gone stays on disk until `vacuum`, but is no longer in
the manifest, which is what readers go by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import store
from lexispark.commits import CommitLog


class KeyedTable:
    """A table under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.log = CommitLog(spark, f"{self.path}/commits", "manifest string, n_written bigint")

    def signatures(self, rows: DataFrame) -> DataFrame:
        """key, signature: the number of a key's rows and a sum over their hashes, the same in every order."""
        others = sorted(c for c in rows.columns if c != self.key)
        one = F.xxhash64(*[F.col(c) for c in others]) if others else F.lit(0)
        sums = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s"))
        return sums.select(self.key, F.concat_ws(":", "n", "s").alias("signature"))

    def manifest(self) -> DataFrame | None:
        last = self.log.last()
        return None if last is None else self.spark.read.parquet(f"{self.path}/manifests/{last.manifest}")

    def plan(self, rows: DataFrame) -> DataFrame:
        """key, status (added, changed, same, removed): what an update with rows would do."""
        now, was = self.signatures(rows).withColumnRenamed("signature", "now"), self.manifest()
        if was is None:
            return now.select(self.key, F.lit("added").alias("status"))
        both = now.join(was.select(F.col(self.key).alias("_was"), F.col("signature").alias("was")), F.col(self.key).eqNullSafe(F.col("_was")), "full_outer")
        status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed").otherwise("same")
        return both.select(F.when(F.col("now").isNull(), F.col("_was")).otherwise(F.col(self.key)).alias(self.key), status.alias("status"))

    def update(self, rows: DataFrame) -> int:
        """Make the table that of rows; the number of keys that were written. The manifest is written before the commit that names it."""
        last = self.log.last()
        plan = store.written(self.plan(rows))
        wanted = plan.where("status IN ('added', 'changed')").select(F.col(self.key).alias("_key"))
        n = wanted.count()
        if n:
            fresh = rows.join(wanted, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi")
            fresh.repartition(self.key).write.partitionBy(self.key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/rows")
        name = f"{(last.version if last else 0) + 1:09d}-{store.mark()}"
        self.signatures(rows).write.parquet(f"{self.path}/manifests/{name}")
        self.log.add(last.version if last else 0, name, n)
        return n

    def read(self) -> DataFrame:
        """The rows of all keys of the last commit."""
        keys = self.manifest()
        if keys is None:
            raise ValueError("nothing has been committed")
        kind = keys.schema[self.key].dataType
        rows = self.spark.read.parquet(f"{self.path}/rows").withColumn(self.key, F.col(self.key).cast(kind))
        return rows.join(keys.select(F.col(self.key).alias("_key")), F.col(self.key).eqNullSafe(F.col("_key")), "left_semi")
