"""Folders for tables that the library writes for itself, such as indexes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_FOLDERS: dict[str, list[str]] = {}
_MADE: dict[tuple, object] = {}


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset and the session is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="lexispark-"))
        base = _LOCAL[0]
    path = f"{base.rstrip('/')}/lexispark-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete the folders that this application has made so far; how many were there. For when its results have been written elsewhere."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    for path in _FOLDERS.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(conf).delete(at, True))
    for key in [k for k in _MADE if k[0] == spark.sparkContext.applicationId]:
        del _MADE[key]
    return gone


def written(df):
    """df as a table under `folder`, read back: it cuts lineage, and is computed once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(spark: SparkSession, path: str) -> str:
    """What changes when a file under path does: a hash over names, sizes and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x")).first()
    return f"{row['n']}:{row['x']}"


def mark() -> str:
    """A name that no other writer has."""
    return uuid.uuid4().hex


def once(spark: SparkSession, name: str, source: str, make):
    """What make(folder) wrote for this application, name and source in its present state; made once."""
    key = (spark.sparkContext.applicationId, name, source, state(spark, source))
    if key not in _MADE:
        _MADE[key] = make(folder(spark))
    return _MADE[key]
