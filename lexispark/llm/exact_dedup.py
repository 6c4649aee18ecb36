"""Exact deduplication as a stateful stream, DataFrame operations only.

The stream keeps one state row per digest, in RocksDB, without a watermark and
so without expiry: how many rows had it, which row stays, and that row's content
locator (file and row). Rows that hit a digest another row has are then compared,
byte for byte, with the text found at that locator. The state can be named and grows
with files that are added later.

Defined results: null text counts as empty; empty texts form one group; repeated
rows (same id and text) are rows of their group like any other, and one of them
stays; among equal texts the longest original stays, then the smallest id (a null
id after all others), then the greatest locator. An empty table gives no rows.
Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.scratch import materialize, scratch_dir

#: The characters that equality ignores.
IGNORED = r"[\x20\x09-\x0D]"

#: Digests of several rows that are sent to every task for the byte check; more are joined by a shuffle.
BROADCAST_KEYS = 200_000

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    # a store's files hold what it keeps, not what it may come to keep, and go when its task has committed
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


def _rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, n_points and the content locator of every row of a Parquet source."""
    return texts.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
        F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias("locator"),
    )


def _grouped(rows: DataFrame, by: str) -> DataFrame:
    """group_size and keeper (most code points, then the smallest id) of the rows' groups."""
    rank = F.struct("n_points", (-F.col("doc_id")).alias("neg_id"), "locator")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("keeper"))


def _globbed(path: str) -> str:
    """The same path as a glob, which a file stream takes for a single file as well as for a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run_stream(spark: SparkSession, path: str, key, id_col: str, text_col: str, max_bytes: int, at: str) -> None:
    """Consume every file under path into the digest state at `at`; restartable from there."""
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(_globbed(path))
    rows = _rows(stream, id_col, text_col).withColumn("digest", key(F.col("text"))).drop("text")
    state = _grouped(rows, "digest")
    # the state is the result; what the sink gets is not used
    query = (
        state.writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", at).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_state(spark: SparkSession, at: str) -> DataFrame:
    """digest, group_size, keep_id, keep_locator of every key in the state at `at`."""
    state = spark.read.format("statestore").load(at)
    fields = [f.name for f in state.schema["value"].dataType.fields]
    size, keeper = (F.col("value").getField(f) for f in fields[-2:])
    return state.select(
        F.col("key.digest").alias("digest"),
        size.alias("group_size"),
        (-keeper.getField("neg_id")).alias("keep_id"),
        keeper.getField("locator").alias("keep_locator"),
    )


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    key=digest,
    max_bytes_per_trigger: int = 1 << 40,
    state_at: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, keep_locator.

    `key` maps the text column to the state key; a weaker key than SHA-256 only
    makes more hits fail the byte check, not the result wrong: the rows of a key
    that holds different texts are grouped anew by their whole text. `state_at` is
    a folder of the stream's state: a later run with it reads only files that are new.
    """
    at = state_at or scratch_dir(spark)
    with _conf(spark, STATE_CONF):
        run_stream(spark, path, key, id_col, text_col, max_bytes_per_trigger, at)
        state = materialize(read_state(spark, at))

    texts = _rows(spark.read.parquet(path), id_col, text_col).withColumn("digest", key(F.col("text")))
    rows = texts.select("doc_id", "digest", digest(F.col("text")).alias("text_sha256"), "locator")
    shared = state.where("group_size > 1")
    if shared.count() <= BROADCAST_KEYS:  # of some 150 bytes each
        shared = F.broadcast(shared)
    # Byte check of the hits: equal to the text at their keeper's locator if and only if the least and
    # the greatest are. Partial aggregation leaves one pair per digest and task, however many copies there are.
    hits = texts.join(shared, "digest").select("digest", normalised(F.col("text")).alias("norm"), (F.col("locator") == F.col("keep_locator")).alias("keeper"))
    clashes = materialize(
        hits.groupBy("digest")
        .agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"), F.max(F.when(F.col("keeper"), F.col("norm"))).alias("kept"))
        .where("not (least <=> kept and greatest <=> kept)")
        .select("digest")
    )
    kept = F.col("locator") == F.col("keep_locator")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "keep_locator"]
    labelled = rows.join(state, "digest")
    if clashes.isEmpty():
        return labelled.withColumn("kept", kept).select(names)
    exact = texts.join(clashes, "digest", "left_semi").withColumn("norm", normalised(F.col("text")))
    regrouped = exact.join(_grouped(exact, "norm"), "norm").select(
        "doc_id",
        (-F.col("keeper.neg_id")).alias("keep_id"),
        "group_size",
        (F.col("locator") == F.col("keeper.locator")).alias("kept"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.col("keeper.locator").alias("keep_locator"),
    )
    return labelled.join(clashes, "digest", "left_anti").withColumn("kept", kept).select(names).unionByName(regrouped.select(names))
