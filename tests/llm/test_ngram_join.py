import random

import numpy as np
import pyarrow as pa

from lexispark.llm import ngram_join as nj
from lexispark.llm.components import components

SF = "/root/testdata/sf0.01"


def made(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: rnd.choice([f"W{i}" for i in range(300)])
    line = " ".join(word() for _ in range(25))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one Two"), (9, "ONE two"), (10, "one two three"), (11, "a b c d e"), (12, "A b C d e")]
    base = []
    for i in range(20, 20 + n):
        kind = rnd.random()
        if kind < 0.4 or not base:
            ws = [word() for _ in range(rnd.choice([3, 12, 40, 120]))]
            base.append(ws)
        else:
            ws = list(rnd.choice(base))
            for _ in range(rnd.randrange(4)):
                ws[rnd.randrange(len(ws))] = word()
            if rnd.random() < 0.3:
                ws = ws[: rnd.randrange(1, len(ws) + 1)]
            base.append(ws)
        if rnd.random() < 0.3:
            ws = [line, *ws]
        rows.append((i * 3, " ".join(ws)))
    return rows


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(spark):
    for seed in (1, 2, 3):
        rows = made(seed)
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert got(nj.join_components(d)) == nj.brute_force(rows)


def test_frequent_bins_blocks_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 4)
    monkeypatch.setattr("lexispark.llm.textvec.row_slices.__defaults__", (500,))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = made(4)
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert got(nj.join_components(d)) == nj.brute_force(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(nj.query(spark, SF)) == nj.brute_force(rows)


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200 + k, 230) for k in range(29)] + [(7, 7)]
    label = {r.node: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert label == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 130)} | {k: 200 for k in [*range(201, 229), 230]}


def test_edges(spark):
    t = "p q r s t u v w x y z"
    d = spark.createDataFrame([(1, t, 1), (1, t, 1), (None, t, 2), (3, None, 3), (4, t.upper(), 4)], "doc_id long, text string, doc int")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nj.join_components(d).collect())[:2] == [("1", 7, "1"), ("1", 7, "1")]
    assert sorted((r.doc_id or 0, r.doc) for r in nj.keep_first(d).collect()) == [(0, 2), (1, 1), (1, 1), (3, 3)]
    assert nj.join_components(d.limit(0)).count() == 0 and nj.keep_first(d.limit(0)).columns == d.columns


def test_long_documents_and_large_groups(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5000)}"
    base = [[word() for _ in range(2500)] for _ in range(3)]
    rows = []
    for i in range(90):
        ws = list(base[i % 3])
        for _ in range(rnd.choice([0, 20, 70, 75, 80, 85, 200])):  # about 75 changed words leave a similarity of 3 in 4
            ws[rnd.randrange(len(ws))] = word()
        rows.append((i, " ".join(ws if i % 5 else ws[: rnd.randrange(1700, 2500)])))
    rows += [(200 + i, " ".join(base[0][:300] + [word() for _ in range(1800)])) for i in range(45)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(nj.join_components(d)) == nj.brute_force(rows)


def test_prefixes_of_a_text_and_one_short_of_a_word_before_an_empty_text():
    emit = nj._prefix_rows(np.zeros(1 << nj.BIN_BITS, np.uint8))
    for seed in range(12):  # both orders of the hashes
        words = [f"w{seed}x{i}" for i in range(9)]
        texts = [" ".join(words[:-1]), " ".join(words), "", None]
        for ids in ([1, 2, 3], [2, 1, 3]):
            out = emit(pa.array(ids), pa.array([texts[i - 1] for i in ids]))
            assert set(out["doc"].tolist()) == {1, 2}
