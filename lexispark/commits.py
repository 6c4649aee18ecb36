"""A log of commits beside data that Spark writes: readers see a whole update or none, and of two writers that begin from one commit the second is refused."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class ConcurrentUpdate(RuntimeError):
    """Another writer updated the data first; read it again and repeat."""


class CommitLog:
    """Commits with the given fields (a DDL string) under a folder, one small file each.

    Every commit has a number and a mark of its own. Stores that do not refuse to create
    what is there may take two commits of one number: the one with the lesser mark counts.
    """

    def __init__(self, spark: SparkSession, path: str, fields: str) -> None:
        self.spark, self.path, self.schema = spark, path, f"version int, mark string, {fields}"

    def all(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.schema).json(f"{self.path}/*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)
        names = [c for c in rows.columns if c not in ("version", "mark")]
        return rows.groupBy("version").agg(F.min_by(F.struct(*names), "mark").alias("c"), F.min("mark").alias("mark")).select("version", "mark", "c.*")

    def last(self) -> Row | None:
        return self.all().orderBy(F.desc("version")).first()

    def add(self, base: int, *values) -> int:
        """Write the commit after `base`. If another writer has written it, this update does not count."""
        version, mark = base + 1, uuid.uuid4().hex
        row = self.spark.createDataFrame([(version, mark, *values)], self.schema)
        try:
            row.coalesce(1).write.mode("error").json(f"{self.path}/{version:09d}")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            raise ConcurrentUpdate(f"commit {version} is there already") from e
        if self.all().where(F.col("version") == version).first().mark != mark:
            raise ConcurrentUpdate(f"another writer made commit {version}")
        return version
