import math
import zlib

import numpy as np
import pyarrow as pa
from lexispark.llm import quality as q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = q.query(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 50 and right / n > 0.95


def test_features_of_whole_texts_and_slices():
    texts = pa.array(["", "A b!! C", "x" * 5000 + " end\nend", "é ü"])
    whole = q.features(texts)
    assert np.allclose(whole, np.concatenate([q.features(texts.slice(i, 1)) for i in range(4)]))
    assert not whole[0].any()


def test_edges(spark):
    d = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "ok text", 2), (3, "ok text", 2)], "doc_id long, text string, row int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.keep_good(d, none).count() == 4  # nothing learned: every score is the cut's
    some = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert q.keep_good(d, some).columns == ["doc_id", "text", "row"]
    assert q.keep_good(d.limit(0), some).count() == 0


def plain_features(text):
    """The features of one text, byte by byte."""
    data = (text or "").encode()
    out = [0.0] * q.WIDTH
    if not data:
        return out
    for i, b in enumerate(data):
        out[b] += 1
        if i:
            out[256 + int(q._CLASS[data[i - 1]]) * q._CLASSES + int(q._CLASS[b])] += 1
    out = [math.log1p(1000 * v / len(data)) for v in out]
    words = data.split()
    many = max(1, len(words))
    out[-5:] = [math.log1p(len(words)), sum(map(len, words)) / many / 5, len(set(words)) / many, math.log1p(1000 * data.count(b"\n") / len(data)), sum(len(w) == 1 for w in words) / many]
    return out


def test_query_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = q.train(docs, labels)
    got = {r.doc_id: r for r in q.query(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = np.array(plain_features(r.text))
        n = math.expm1(x[-5])
        z = ((x - m["centre"]) * m["weights"]).sum() * n / (n + q.SHRINK_WORDS) - m["cut"]
        want = 1 / (1 + math.exp(-max(-30, min(30, z * m["slope"] + math.log(q.CUT / (1 - q.CUT))))))
        g = got[r.doc_id]
        assert abs(g.score - want) < 1e-4 and g.predicted == int(g.score >= 0.3) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_threshold_is_a_quantile_of_the_validation_part():
    rnd = np.random.default_rng(3)
    good, bad = rnd.normal(1, 1, (200, q.WIDTH)), rnd.normal(0, 1, (100, q.WIDTH))
    m = q.fit(good, bad, 0.25)
    z = np.concatenate([q.centred(x[::5], m["centre"]) @ m["weights"] for x in (good, bad)])
    assert np.isclose(np.quantile(z, 0.25), m["cut"])
    assert q.best_quantile(np.array([1.0, 2, 3, 4]), np.array([0, 0, 1, 1])) == 0.5
    assert q.best_quantile(np.array([1.0, 2, 2, 2, 3]), np.array([0, 0, 1, 0, 1])) in (0.125, 0.875)


def test_hostile_columns_and_ties(spark):
    d = spark.createDataFrame([(1, "good words here", 1, 2), (1, "good words here", 3, 4), (None, "w " * 200_000, 5, 6)], "doc_id long, text string, result int, score int").withColumn("row", F.lit(0))
    model = q.train(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    out = q.score(d, model).select("row.doc_id", "row.score", "result.score").collect()
    assert len(out) == 3 and out[0][2] == out[1][2]


def test_every_labelled_row_is_learned_from(spark):
    n = 9000
    text = F.concat(F.lit("w "), F.repeat(F.when(F.col("doc_id") % 3 == 0, "Zq! ").otherwise("ab "), (F.col("doc_id") % 11 + 1).cast("int")), F.col("doc_id").cast("string"))
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", text)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    m = q.train(docs.repartition(7), labels)
    good = [r.text for r in docs.collect() if r.doc_id % 3 and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert np.abs(m["centre"] - q.features(pa.array(good)).astype(np.float64).mean(0)).max() < 1e-6
    again = q.train(docs.coalesce(1), labels)  # whatever the partitions
    assert all(np.array_equal(m[k], again[k]) for k in m)


def test_all_pairs_pull():
    rnd = np.random.default_rng(5)
    good, bad = rnd.normal(0.3, 1, (60, q.WIDTH)), rnd.normal(0, 1, (30, q.WIDTH))
    good[:, -5] = bad[:, -5] = 3
    m = q.fit(good, bad)
    spread = np.concatenate([good, bad]).std(0) + 0.05
    g, b = (np.delete(q.centred(x, m["centre"]) / spread, np.s_[:: q.VALIDATE_OF], 0) for x in (good, bad))
    slope = lambda w: ((b[None] - g[:, None]) / (1 + np.exp(g @ w)[:, None, None] / np.exp(b @ w)[None, :, None])).mean((0, 1)) + q.RIDGE * w
    assert np.linalg.norm(slope(m["weights"] * spread)) < 0.02 * np.linalg.norm(slope(np.zeros(q.WIDTH)))


def test_cuts_from_counts():
    rnd = np.random.default_rng(2)
    point, bad, good = np.arange(40) / 4, rnd.integers(0, 4, 40), rnd.integers(0, 4, 40) * (np.arange(40) > 9)
    scores, marks = np.concatenate([np.repeat(point, bad), np.repeat(point, good)]), np.repeat([0, 1], [bad.sum(), good.sum()])
    assert np.isclose(q._quantile(point, bad + good, 0.37), np.quantile(scores, 0.37))
    lost = lambda cut: (scores[marks == 1] < cut).mean() + (scores[marks == 0] >= cut).mean()
    cut, share = q._best_cut(point, bad, good)
    assert np.isclose(lost(cut), min(lost(c) for c in [*point, 11])) and np.isclose(share, (scores < cut).mean())
