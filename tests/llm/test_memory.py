"""What a worker holds: rows are worked on in parts of bounded size, and freed memory goes back after a partition."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import arrowmap, ngram_join, quality, token_output


def _peak(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_folds_of_many_short_rows():
    n = 10_000
    row = np.repeat(np.arange(n), 3)
    h = np.random.default_rng(5).integers(0, 1 << 63, 3 * n).astype(np.uint64)
    out, peak = _peak(lambda: ngram_join._folds(row, h, n))
    assert peak < 50 << 20
    assert (out[4000:4010] == ngram_join._folds(row[12_000:12_030] - 4000, h[12_000:12_030], 10)).all()
    assert out.shape == (n, ngram_join.FOLD_BITS // 8) and not ngram_join._folds(row[:0], h[:0], 0).size
    gaps = ngram_join._folds(np.array([1, 700]), h[:2], 1200)  # rows without shingles
    assert np.flatnonzero(gaps.any(1)).tolist() == [1, 700] and np.bitwise_count(gaps).sum() == 2


def test_quality_sums_by_parts():
    n = 2 * quality.AT_ONCE + 7
    x = np.random.default_rng(6).random((n, quality.WIDTH), np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.arange(n) % 2, pa.int32()), pa.array(np.arange(n) % 5 == 0)], ["x", "label", "aside"])
    parts = list(quality._parts(batch))
    assert max(len(p[0]) for p in parts) == quality.AT_ONCE
    for k, whole in enumerate((x, np.arange(n) % 2, np.arange(n) % 5 == 0)):
        assert (np.concatenate([p[k] for p in parts]) == whole).all()


def test_freed_memory_goes_back():
    def held() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) >> 10

    if not hasattr(arrowmap.ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")
    kept = []

    def run(batches):
        for batch in batches:
            many = []
            for _ in range(2000):  # small arrays that stay lie between large ones that go
                many.append(np.ones(12_000))
                kept.append(np.ones(100))
            del many
            yield batch

    before = held()
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    assert len(list(arrowmap.freeing(run)(iter([batch])))) == 1
    assert held() - before < 40


def test_segments_hold_many_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        token_output.write_tokens(docs, str(tmp_path / "t"), token_output.vocabulary_path())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert spark.read.parquet(str(tmp_path / "t")).select("part").distinct().count() <= 4
