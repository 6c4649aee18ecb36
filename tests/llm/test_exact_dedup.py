import hashlib
import random
import re

from lexispark.llm import exact_dedup as x
from pyspark.sql import functions as F


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    out, done = [], set()
    for d, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[k])[1]
        out.append((d, keep, len(groups[k]), d == keep and k not in done, hashlib.sha256(k.encode()).hexdigest()))
        if d == keep:  # of rows that repeat the keeper one stays
            done.add(k)
    return sorted(out)


def rows(n=300):
    rnd = random.Random(1)
    texts = [None, "", " \t", "a", " a", "a\n", "é é", "éé", "x" * 9000, "x" * 4500 + " " + "x" * 4500, "a "]
    out = [(i, rnd.choice(texts)) for i in range(n)]
    return [*out, out[5], out[5]]


def got(spark, path, **k):
    return sorted(tuple(r) for r in x.exact_dedup(spark, path, **k).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_equals_brute_force_over_many_batches(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("digest", F.lit(1))
    df.repartition(5).write.parquet(str(tmp_path / "d"))
    assert got(spark, str(tmp_path / "d"), max_bytes_per_trigger=1) == brute(data)


def test_clashing_keys_are_told_apart_by_bytes(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    weak = lambda t: F.substring(x.digest(t), 1, 1)
    assert got(spark, str(tmp_path / "d"), key=weak) == brute(data)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert got(spark, str(tmp_path / "d")) == []


def test_state_grows_with_new_files(spark, tmp_path):
    data, at = rows(), str(tmp_path / "state")
    path = str(tmp_path / "d")
    spark.createDataFrame(data[:100], "doc_id long, text string").write.parquet(path)
    assert got(spark, path, state_at=at) == brute(data[:100])
    spark.createDataFrame(data[100:], "doc_id long, text string").write.mode("append").parquet(path)
    assert got(spark, path, state_at=at) == brute(data)


def test_null_ids_and_clashing_names(spark, tmp_path):
    data = [(None, "a b", 1), (3, "ab", 2), (None, "x", 3), (None, "x", 4), (5, "x", 5)]
    spark.createDataFrame(data, "doc_id long, text string, locator int").withColumn("norm", F.lit(1)).withColumn("keeper", F.lit("k")).withColumn("group_size", F.lit(0)).write.parquet(str(tmp_path / "d"))
    out = x.exact_dedup(spark, str(tmp_path / "d")).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in out) == [(0, 0, 2, True), (0, 5, 3, False), (0, 5, 3, False), (3, 0, 2, False), (5, 5, 3, True)]


def test_shared_digests_beyond_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(x, "BROADCAST_KEYS", 0)
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert got(spark, str(tmp_path / "d")) == brute(data)
