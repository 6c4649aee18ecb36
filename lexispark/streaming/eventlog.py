"""The append-only event log: hash chain, retraction, fold to current state; as batch and as stream.

A card's status after a list of presses depends on their order, but not on all of them:
the last press that sets a status whatever came before decides, and a directive after it
reopens the card unless it is approved or applied. Two maxima per card say the same as the
fold, so the state of a card has a fixed size, combines before the shuffle, and is the
same aggregation in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark import store

#: What a press sets; a directive only where the card is open.
SETS = {"approve": "approved", "edit": "submitted", "withdraw": "yours", "reopen": "yours", "applied": "applied", "leave": "superseded"}
CLOSED = ("approved", "applied")
GENESIS = "0" * 16


def entry_hash(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256), F.lit(16))


def body(ts: Column, *payload: str) -> Column:
    """What an entry's hash covers besides the hash before it: its time to the microsecond, and its payload as JSON with sorted keys."""
    fields = F.struct(*[F.col(c).alias(c) for c in sorted(payload)])
    return F.concat_ws("|", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.to_json(fields, {"ignoreNullFields": "false"}))


def chained(rows: DataFrame, chain: str, order: list[str], what: Column) -> DataFrame:
    """rows with prev (the hash before it in its chain) and hash, which covers prev and `what`.

    A hash needs the one before, so a chain is walked in order: rows are dealt and sorted by
    chain, and a task holds no more of it than the last hash.
    """
    place = len(rows.columns)
    full = rows.select("*", what.alias("_what"), F.col(chain).alias("_chain")).repartition(chain).sortWithinPartitions(chain, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("prev", T.StringType()), T.StructField("hash", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, prev = False, None, GENESIS
        for batch in batches:
            before, after = [], []
            for own, what in zip(batch.column(place + 1).to_pylist(), batch.column(place).to_pylist(), strict=True):
                if not begun or own != last:
                    begun, last, prev = True, own, GENESIS
                before.append(prev)
                prev = hashlib.sha256(f"{prev}|{what}".encode()).hexdigest()[:16]
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(before, pa.string()), pa.array(after, pa.string())], schema.names)

    return full.mapInArrow(walk, schema)


def verify(rows: DataFrame, chain: str, order: list[str], what: Column) -> DataFrame:
    """chain, n_events, n_bad_hash, n_bad_link: each row's hash again from its own prev, all rows at once, and the links of every chain.

    A changed payload or time, and a prev that was set anew, show as bad hashes; a lost,
    doubled or inserted row as bad links.
    """
    at = F.struct(*order)
    seen = rows.select(chain, "hash", "prev", entry_hash(F.col("prev"), what).alias("again"), at.alias("at"))
    # a row links to the one whose hash it names, which must come earlier and be named once: an equi-join, so that one long chain is dealt over all tasks
    linked = seen.groupBy(chain, "prev").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    before = seen.groupBy(chain, F.col("hash").alias("prev")).agg(F.min("at").alias("was")).withColumn("known", F.lit(True))
    links = linked.join(before, [chain, "prev"], "left")
    good = (F.col("prev") == GENESIS) | (F.col("known") & (F.col("was") < F.col("at")))
    bad = links.groupBy(chain).agg(F.sum(F.when(F.coalesce(good, F.lit(False)), F.col("n") - 1).otherwise(F.col("n"))).alias("n_bad_link"))
    sums = seen.groupBy(chain).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("again") != F.col("hash")).alias("n_bad_hash"))
    return sums.join(bad, chain).select(chain, "n_events", "n_bad_hash", "n_bad_link")


def retract(rows: DataFrame, hash_col: str = "hash", retracts: str = "retracts") -> DataFrame:
    """rows without those whose hash a later row retracts, and without the retractions."""
    gone = rows.where(F.col(retracts).isNotNull()).select(F.col(retracts).alias(hash_col)).distinct()
    return rows.where(F.col(retracts).isNull()).join(gone, hash_col, "left_anti")


def fold_aggregates(at: Column, kind: Column) -> list[Column]:
    """The two maxima of the fold; at orders the events of a card."""
    names = F.create_map(*[F.lit(x) for kv in SETS.items() for x in kv])
    return [
        F.max(F.when(kind.isin(*SETS), F.struct(at.alias("at"), names[kind].alias("status")))).alias("decided"),
        F.max(F.when(kind == "directive", at)).alias("directed"),
        F.count(F.lit(1)).alias("n_events"),
    ]


def folded_status(decided: Column, directed: Column, first: str = "yours") -> Column:
    base = F.coalesce(decided["status"], F.lit(first))
    later = directed.isNotNull() & (decided.isNull() | (directed > decided["at"]))
    return F.when(later & ~base.isin(*CLOSED), "submitted").otherwise(base)


def fold(events: DataFrame, card: str, at: Column, kind: Column) -> DataFrame:
    """card, status, n_events."""
    state = events.groupBy(card).agg(*fold_aggregates(at, kind))
    return state.select(card, folded_status(F.col("decided"), F.col("directed")).alias("status"), "n_events")


def settle(status: Column, approved_at: Column, as_of: Column, wait_seconds: int) -> Column:
    """approving until the wait after an approval is over; the time is a parameter, never the clock."""
    return F.when((status == "approved") & (as_of < approved_at + F.make_dt_interval(secs=F.lit(wait_seconds))), "approving").otherwise(status)


def fold_stream(spark: SparkSession, path: str, card: str, at, kind, max_files: int = 64, checkpoint: str | None = None) -> DataFrame:
    """The same fold over every file under path, as a stream that can be stopped and resumed from its checkpoint.

    The state is read back from the checkpoint, so nothing passes through the driver.
    """
    where = checkpoint or store.folder(spark)
    glob = f"{path[:-1]}[{path[-1]}]"  # a file stream takes a glob for a file as well as for a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files).parquet(glob)
    state = stream.groupBy(card).agg(*fold_aggregates(at(stream), kind(stream)))
    state.writeStream.outputMode("update").format("noop").option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.format("statestore").load(where)
    # both maxima's buffers have one name: the fields are told apart by place
    names = [*(f"key{i}" for i in range(len(kept.schema["value"].dataType) - 3)), "decided", "directed", "n"]
    renamed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kept.schema["value"].dataType, strict=True)])
    value = F.col("value").cast(renamed)
    decided, directed, n = (value.getField(f) for f in ("decided", "directed", "n"))
    return kept.select(F.col(f"key.{card}").alias(card), folded_status(decided, directed).alias("status"), n.alias("n_events"))
