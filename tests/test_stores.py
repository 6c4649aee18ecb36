import pytest
from lexispark.functions import text as tx
from lexispark.operators import cards, findings, fulltext, relational, vectors
from lexispark.sources import formats
from lexispark.streaming import eventlog as log
from pyspark.sql import functions as F


def test_index_equals_scan(spark, tmp_path):
    d = spark.createDataFrame([(1, "the quick brown fox the"), (2, "Quick the fox"), (3, None), (4, ""), (5, "fox the quick the quick")], "doc_id long, text string")
    index = fulltext.build_index(d, str(tmp_path / "i"))
    for q, style in (("quick", "and"), ("the qu*", "and"), ('"the quick" fox', "and"), ("the quick the", "phrase"), ("qu f", "prefix"), ("none", "and"), ("", "and")):
        clauses = fulltext.parse(q, style)
        key = lambda x: [(r.doc_id, round(r.score, 9)) for r in x.orderBy("doc_id").collect()]
        assert key(index.search(clauses)) == key(fulltext.search(d, clauses)), q


def test_saved_index_guards_its_model_and_keeps_versions(spark, tmp_path):
    e = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    c = vectors.kmeans(e, 4)
    path = str(tmp_path / "x")
    vectors.ListIndex.build(e.where("vec_id < 30"), path, c, "m1", 2)
    index = vectors.ListIndex.build(e, path, c, "m1", 1, floor=3)
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    key = lambda d: sorted((r.query_id, r.rank, r.vec_id) for r in d.collect())
    assert key(index.search(q, 3)) == key(vectors.search_lists(index.lists, q, c, 3, 3))  # the floor raised 1 to 3
    index.set_search_params(4)
    assert key(index.search(q, 3)) == key(vectors.search(e, q, 3))
    assert vectors.ListIndex.open(spark, path, "m1", version=1).lists.count() == 30
    with pytest.raises(ValueError, match="m1"):
        vectors.ListIndex.open(spark, path, "m2")
    assert vectors.ListIndex.open(spark, path, "m2", allow_model_change=True).params["version"] == 2


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    got = {r.node: r.hops for r in relational.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_every_match_is_reported(spark):
    lines = spark.createDataFrame([("b", 1, "bad and bad, so Bad"), ("b", 2, "fine"), ("b", 3, None), ("b", 4, "worse bad")], "book string, line_no int, text string")
    got = sorted((r.place, r["class"], r.what) for r in findings.banned(lines, [("x", "(?i)bad"), ("y", "worse")], around=4).collect())
    assert got == [("b:1:1", "x", "bad and"), ("b:1:17", "x", " so Bad"), ("b:1:9", "x", "and bad, so"), ("b:4:1", "y", "worse bad"), ("b:4:7", "x", "rse bad")]
    once = findings.banned(lines, [("x", "bad")], carve="so", ruled=spark.createDataFrame([("none",)], "fingerprint string"))
    assert once.count() == 1


def test_sentences(spark):
    text = "Dr. A. Smith came, cf. p. 3. He said \"No.\" Then?  1. One item. Done"
    assert spark.range(1).select(tx.sentences(F.lit(text))).first()[0] == ["Dr. A. Smith came, cf. p. 3. He said \"No.\"", "Then?", "1. One item.", "Done"]


def test_forks_and_reordering_break_a_chain(spark):
    what = F.col("body")
    rows = log.chained(spark.createDataFrame([(1, i, f"b{i}") for i in range(6)], "c long, n long, body string"), "c", ["n"], what)
    fork = rows.unionByName(rows.where("n = 4").withColumn("n", F.lit(7).cast("long")).withColumn("hash", F.lit("f")))
    assert log.verify(fork, "c", ["n"], what).first().n_bad_link == 1
    swapped = rows.withColumn("n", F.when(F.col("n") == 2, 3).when(F.col("n") == 3, 2).otherwise(F.col("n")))
    assert log.verify(swapped, "c", ["n"], what).first().n_bad_link >= 1


def test_log_numbers_run_over_partitions(spark):
    base = spark.createDataFrame([(10,)], "base int")
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(5)
    got = [(r.k, r.number) for r in cards.numbered(rows, ["k"], "number", base).orderBy("k").collect()]
    assert got == [(k, 11 + k) for k in range(500)]


def test_card_store_refuses_a_mix_and_broken_lines(spark, tmp_path):
    (tmp_path / "cards.jsonl").write_text('{"card": 1}\n')
    assert formats.card_store(spark, str(tmp_path), "card long").count() == 1
    (tmp_path / "2026-01-01.jsonl").write_text('{"card": 2}\n')
    with pytest.raises(ValueError):
        formats.card_store(spark, str(tmp_path), "card long")
    d = tmp_path / "days"
    d.mkdir()
    (d / "a.jsonl").write_text('{"card": 1}\n{"card"\n')
    with pytest.raises(Exception):  # noqa: B017
        formats.card_store(spark, str(d), "card long").collect()


def test_claims_leave_backups_and_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t": 1}\n{"t"\n')
    (tmp_path / "a.jsonl.bak").write_text('{"t": 2}\n')
    assert [r["t"] for r in formats.claims(spark, str(tmp_path)).select(F.variant_get("row", "$.t", "int").alias("t")).collect()] == [1]
