import random

from lexispark.llm import substring_dedup as sd

SF = "/root/testdata/sf0.01"


def made(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "bb", "ç", "d"] if seed % 2 else [f"w{i}" for i in range(400)])
    passages = [[word() for _ in range(rnd.choice([19, 20, 21, 60]))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "\t x \n")]
    for i in range(3, n):
        ws = [word() for _ in range(rnd.randrange(50))]
        for _ in range(rnd.randrange(3)):
            ws += rnd.choice(passages) + [word() for _ in range(rnd.randrange(9))]
        if rnd.random() < 0.2:
            ws += ["z"] * rnd.choice([20, 45])
        rows.append((i * 7 - 3000, (" " if i % 2 else "\n").join(ws)))
    rows += [(9000 + i, rows[10 + i][1]) for i in range(10)]
    return rows


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert got(sd.dedup_report(d)) == sd.brute_force(rows)


def test_small_slices_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr("lexispark.llm.textvec.row_slices.__defaults__", (300,))
    rows = made(3)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(sd.dedup_report(d)) == sd.brute_force(rows)


def test_walk_carries_nodes_over_batches(spark):
    rows = made(5)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(sd.dedup_report(d)) == sd.brute_force(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(sd.query(spark, SF)) == sd.brute_force(rows)


def test_spans_and_edges(spark):
    p = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, p, 1), (2, "x " + p + " y", 2), (2, "x " + p + " y", 2), (None, p, 3), (4, None, 4)], "doc_id long, text string, doc int")
    assert [tuple(r) for r in sd.maximal_repeats(d).collect()] == [(2, 1, 30)]
    out = sorted((r.doc_id or 0, r.text or "", r.doc) for r in sd.remove_repeats(d).collect())
    assert out == [(0, p, 3), (1, p, 1), (2, "x y", 2), (2, "x y", 2), (4, "", 4)]
    assert sd.remove_repeats(d.limit(0)).count() == 0 and sd.dedup_report(d.limit(0)).count() == 0
