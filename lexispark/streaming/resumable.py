"""Builds over many files that can be stopped and resumed.

A file stream hands out each file once, whatever stops the build; what was done with a file is a
row of a ledger, one folder for each batch, so that a batch that is repeated after a failure
replaces its own rows. Files that failed are tried again by the next build until they
have failed `attempts` times. A build ends when no file is left or its time is spent; time is
looked at between batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "path string, status string, result string, error string, attempt int"


def _work(files: DataFrame, process: Callable[[str, bytes], str]) -> DataFrame:
    """A ledger row for each file (path, content, attempt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, attempt in zip(batch["path"], batch["content"], batch["attempt"], strict=True):
                try:
                    rows.append((path, "ok", process(path, bytes(content)), None, attempt))
                except Exception as e:  # a file's own fault must not end the build: it is in the ledger
                    rows.append((path, "fail", None, f"{type(e).__name__}: {e}", attempt))
            yield pd.DataFrame(rows, columns=["path", "status", "result", "error", "attempt"])

    return files.select("path", "content", "attempt").mapInPandas(run, LEDGER)


class Build:
    """A build under `at`, a folder that driver and executors share: its ledger and its stream's checkpoint."""

    def __init__(self, spark: SparkSession, source: str, at: str, process: Callable[[str, bytes], str], attempts: int = 2, files_per_batch: int = 64) -> None:
        self.spark, self.source, self.at = spark, source, at.rstrip("/")
        self.process, self.attempts, self.files_per_batch = process, attempts, files_per_batch

    def ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{self.at}/ledger")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def state(self) -> DataFrame:
        """path, status (ok, retry, given up), attempts, result of every file that was handed out."""
        rows = self.ledger().groupBy("path").agg(F.max(F.col("status") == "ok").alias("ok"), F.max("attempt").alias("attempts"), F.max("result").alias("result"))
        status = F.when(F.col("ok"), "ok").when(F.col("attempts") >= self.attempts, "given up").otherwise("retry")
        return rows.select("path", status.alias("status"), "attempts", "result")

    def _retry(self) -> None:
        again = self.state().where("status = 'retry'").select("path", (F.col("attempts") + 1).alias("attempt"))
        turn = self.ledger().agg(F.coalesce(F.max("attempt"), F.lit(0))).first()[0]
        if not turn or again.isEmpty():
            return
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.source)
        _work(files.join(again, "path"), self.process).write.mode("overwrite").parquet(f"{self.at}/ledger/retry={int(time.time() * 1000)}")

    def run(self, seconds: float | None = None) -> bool:
        """Go on with the build; whether all files have been handed out. A spent budget ends it after the batch at hand."""
        began = time.monotonic()
        self._retry()
        spent = lambda: seconds is not None and time.monotonic() - began >= seconds
        schema = "path string, modificationTime timestamp, length bigint, content binary"
        stream = self.spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", self.files_per_batch).load(self.source)
        stopped = []

        def each(batch: DataFrame, n: int) -> None:
            if spent():
                stopped.append(n)
                raise TimeoutError  # this batch is not committed: the next build begins with it
            _work(batch.withColumn("attempt", F.lit(1)), self.process).write.mode("overwrite").parquet(f"{self.at}/ledger/batch={n}")

        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.at}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            if not stopped:
                raise
        return not stopped
