import collections
import math

import pytest
from lexispark.llm import mixing as m


def docs(spark, n=4000):
    rows = [(i, None if i % 50 == 0 else "t" * (i % 3), ["big", "big", "small", None][i % 4], 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_row int")


def brute(rows, weights, default, total, seed):
    import hashlib

    counts = collections.Counter(r.source for r in rows)
    w = {s: weights.get(s, default) for s in counts}
    out = collections.Counter()
    for r in rows:
        s = r.source
        if not w[s]:
            continue
        rate = w[s] / sum(w.values()) * total * len(rows) / counts[s]
        u = int(hashlib.md5(f"{seed}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while u >= c and k < 500:
            k += 1
            p *= rate / k
            c += p
        out[r.doc_id] += k
    return {d: k for d, k in out.items() if k}


def test_counts_and_shares(spark):
    d = docs(spark)
    got = m.mix_sources(d, {"big": 1.0, "small": 2.0}, 0.0, 1.5, 3)
    assert set(got.columns) == {*d.columns, *m.ADDED}
    rows = got.collect()
    assert collections.Counter(r.doc_id for r in rows) == brute(d.collect(), {"big": 1.0, "small": 2.0}, 0.0, 1.5, 3)
    share = collections.Counter(r.source for r in rows)
    assert abs(share["small"] / len(rows) - 2 / 3) < 0.03 and None not in share
    assert all(1 <= r.copy_no <= r.n_copies for r in rows)


def test_salted_join_equals_broadcast(spark, monkeypatch):
    d = docs(spark, 400)
    key = lambda x: sorted((r.doc_id, r.copy_no, r.shuffle_key) for r in x.collect())
    want = key(m.mix_sources(d, {}, 1.0, 2.0, 5))
    monkeypatch.setattr(m, "BROADCAST_BYTES", 0)
    assert key(m.mix_sources(d, {}, 1.0, 2.0, 5)) == want


def test_edges(spark):
    d = docs(spark, 40)
    assert m.mix_sources(d, {}, 0.0).count() == 0
    assert m.mix_sources(d.limit(0), {}).count() == 0
    twice = d.union(d)
    n = collections.Counter(r.doc_id for r in m.mix_sources(twice, {}, 1.0, 3.0).collect())
    assert all(k % 2 == 0 for k in n.values())


def test_high_rates_equal_brute_force(spark):
    import hashlib

    for rate in (100, 800, 5000):
        rows = m.mix_sources(spark.range(12).selectExpr("id AS doc_id", "'a' AS source"), {}, 1.0, float(rate), 4).groupBy("doc_id").count().collect()
        sums, c = [], 0.0
        for k in range(2 * rate):
            c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            sums.append(c)
        u = [int(hashlib.md5(f"4:{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(12)]
        assert {r.doc_id: r["count"] for r in rows} == {i: sum(x >= c for c in sums) for i, x in enumerate(u)}


def test_clashing_names_and_null_ids(spark):
    rows = [(i if i % 9 else None, None, "a", 1.0, "x", 2, 3, "r") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, cdf double, mix_source string, u int, id int, row string")
    got = m.mix_sources(d, {"a": 1.0}, 1.0, 2.0, 3)
    assert got.columns == [*d.columns, *m.ADDED]
    out = got.collect()
    assert {(r.cdf, r.mix_source, r.u, r.id, r.row) for r in out} == {(1.0, "x", 2, 3, "r")}
    assert collections.Counter(r.doc_id for r in out if r.doc_id is not None) == {k: v for k, v in brute([r for r in d.collect() if r.doc_id is not None], {"a": 1.0}, 1.0, 2.0, 3).items()}


def test_names_that_mixing_adds(spark):
    d = spark.range(30).selectExpr("id AS doc_id", "'a' AS source", "id AS copy_no", "'k' AS Shuffle_key")
    with pytest.raises(ValueError, match="copy_no, shuffle_key"):
        m.mix_sources(d, {})
    rows = m.mixed_rows(d, {}, 1.0, 3.0)
    assert rows.columns == ["row", *m.ADDED]
    out = rows.collect()
    assert out and all(r.row.copy_no == r.row.doc_id for r in out)


def test_null_and_empty_sources_are_two(spark):
    d = spark.range(400).selectExpr("id AS doc_id", "IF(id % 4 = 0, '', NULL) AS source")
    share = collections.Counter(r.source for r in m.mix_sources(d, {"": 3.0}, 1.0, 2.0).collect())
    assert share[""] > 2 * share[None] > 0
