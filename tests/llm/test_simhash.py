import random

import numpy as np
import pyarrow as pa
import pytest
from lexispark.llm import simhash as sh
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def result(df):
    return {r.doc: (f"{r.fp & (2**64 - 1):016x}", r.component) for r in df.collect()}


def corpus(n=160):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["ÉTÉ", "été", "A", "a"]
    out = [None, "", " \n", "one", "One two", "one\ttwo", "one two three", "a" * 50_000]
    while len(out) < n:
        base = [rnd.choice(vocab) for _ in range(rnd.choice((3, 40, 400)))]
        out.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            near = list(base)
            near[rnd.randrange(len(near))] = rnd.choice(vocab)
            out.append("  ".join(near))
    return list(enumerate(out))


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).repartition(5)
    assert result(sh.near_duplicates(df, block=8)) == sh.brute_force(rows)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.query(spark, SF).collect()}
    want = sh.brute_force(rows)
    assert got == want
    assert any(c != d for d, (_, c) in want.items())


@pytest.mark.parametrize("same", [True, False])
def test_trie_pairs(same, monkeypatch):
    monkeypatch.setattr(sh, "CHUNK", 50)
    rnd = np.random.default_rng(1)
    centres = rnd.integers(0, 2**64, 20, dtype=np.uint64)
    flips = np.uint64(1) << rnd.integers(0, 64, 600).astype(np.uint64)
    ball = np.unique(np.concatenate((centres, rnd.choice(centres, 600) ^ flips ^ np.roll(flips, 1), rnd.integers(0, 9, 9, dtype=np.uint64))))
    a, b = (ball, ball) if same else (ball[::2], ball[1::2])
    got = {(int(i), int(j)) for x, y in sh.close_pairs(a, b, same) for i, j in zip(x, y)}
    want = {(i, j) for i, x in enumerate(a.tolist()) for j, y in enumerate(b.tolist()) if (x ^ y).bit_count() <= sh.BUDGET and (i < j or not same)}
    assert got == want and want


def test_blocks_cover_the_trie_and_crowded_prefixes_are_split(spark):
    near = [2**63 + i for i in range(300)]  # all in one prefix of 55 bits
    far = [int(x) for x in np.random.default_rng(2).integers(0, 2**63, 100)]
    fps = sorted({*near, *far, 0, 2**64 - 1})
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    blocks = sh.trie_blocks(df, 16)
    held = [sum(x >> (64 - d) == p if d else True for x in fps) for p, d in blocks]
    assert max(held) <= 16 and sum(held) == len(fps)
    links = {(r.a, r.b) for r in sh.links(df, 16).collect()}
    assert {x - 2**64 for x in near} <= {x for pair in links for x in pair}


def test_long_texts_and_many_words():
    texts = ["x y z " * 100_000, "q"]
    fps = sh.fingerprint_rows(pa.array(texts))
    want = sh.brute_force(list(enumerate(texts)))
    assert [f"{int(x):016x}" for x in fps] == [want[0][0], want[1][0]]


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s t u v w x y z"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc or 0, r.component or 0) for r in sh.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 7), (3, 3), (7, 7), (7, 7)]
    assert sh.near_duplicates(df.limit(0)).collect() == []
