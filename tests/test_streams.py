"""Timers and resumable builds, stopped and started again."""

import datetime as dt

import pytest
from lexispark.streaming import resumable, timers
from pyspark.sql import functions as F

SCHEMA = "card string, kind string, ts timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_approvals_settle_after_the_wait_across_a_restart(rocks, tmp_path):
    spark, source, out, check = rocks, *(str(tmp_path / x) for x in ("in", "out", "check"))

    def add(*rows):
        spark.createDataFrame([(c, k, at(m)) for c, k, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        timers.settled(stream, 600).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.card, r.status, r.at) for r in spark.read.schema(timers.OUT).parquet(out).collect())

    add(("a", "approve", 0), ("b", "approve", 1), ("c", "note", 2))
    assert go() == [("a", "approving", at(0)), ("b", "approving", at(1))]
    add(("b", "withdraw", 5), ("d", "approve", 6))
    got = go()
    assert ("b", "taken back", at(5)) in got and not any(s == "approved" for _, s, _ in got)
    add(("e", "note", 12))  # the watermark passes a's wait, not d's
    got = go()
    assert [(c, t) for c, s, t in got if s == "approved"] == [("a", at(10))]
    add(("e", "note", 60))
    got = go()
    assert [(c, t) for c, s, t in got if s == "approved"] == [("a", at(10)), ("d", at(16))]
    assert len(got) == len(set(got)) == 6


def test_a_build_is_resumed_no_file_twice_two_failures_given_up(spark, tmp_path):
    def flaky(path, content):
        if content.startswith(b"bad"):
            raise ValueError("broken file")
        return content.decode().upper()

    source = tmp_path / "files"
    source.mkdir()
    for i in range(7):
        (source / f"f{i}.txt").write_text(f"bad {i}" if i == 3 else f"text {i}")
    build = resumable.Build(spark, str(source), str(tmp_path / "build"), flaky, files_per_batch=2)
    assert build.run(seconds=0) is False  # no time: nothing is done, nothing lost
    assert build.run() is True
    state = {r.path[-6:-4]: (r.status, r.attempts) for r in build.state().collect()}
    assert state["f3"] == ("retry", 1) and sum(s == ("ok", 1) for s in state.values()) == 6
    (source / "f9.txt").write_text("later")
    again = resumable.Build(spark, str(source), str(tmp_path / "build"), flaky, files_per_batch=2)
    assert again.run() is True
    state = {r.path[-6:-4]: (r.status, r.attempts, r.result) for r in again.state().collect()}
    assert state["f3"] == ("given up", 2, None) and state["f9"] == ("ok", 1, "LATER") and len(state) == 8
    again.run()
    rows = again.ledger().groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.path[-6:-4]: r.n for r in rows} == {f"f{i}": 2 if i == 3 else 1 for i in (*range(7), 9)}
