import itertools
import random

from lexispark.functions import text as tx
from lexispark.operators import chunks, findings, fulltext, relational, vectors
from lexispark.streaming import eventlog as log
from pyspark.sql import functions as F


def test_chunks_cover_every_word(spark):
    rows = [(i, " ".join(str(k) for k in range(n))) for i, n in enumerate([0, 1, 199, 200, 201, 360, 1000])]
    got = chunks.chunk(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, t in rows:
        parts = [set(r.chunk.split()) for r in got if r.doc_id == i]
        assert set(t.split()) == set().union(*parts) and len(parts) == -(-len(t.split()) // 160)


def test_text_functions(spark):
    one = spark.createDataFrame([("Ärger JUVENIS vij", "‘Genesis’", "-750.5,300.0", "327a-328b", "1 John 3:16-18")], "a string, b string, y string, p string, v string")
    r = one.select(tx.fold(F.col("a"), latin=True).alias("f"), tx.slugify(F.col("b")).alias("s"), tx.year_span(F.col("y")).alias("y"), tx.passage_reference(F.col("p")).alias("p"), tx.verse_reference(F.col("v")).alias("v"), tx.folio(F.lit(3)).alias("d"), tx.catalogue_number(F.lit("p 123")).alias("c")).first()
    assert r.f == "arger iuuenis uii" and r.s == "genesis" and tuple(r.y) == (-750, 300) and (r.p.first, r.p.last) == ("327a", "328b")
    assert tuple(r.v) == ("1 John", 3, 16, 18) and r.d == "2b" and r.c == "P000123"
    assert [x.r for x in spark.createDataFrame([("Genesis 1:1",), ("Genesis 11:1",), ("Genesis 1",)], "r string").where(tx.reference_in(F.col("r"), "Genesis 1")).collect()] == ["Genesis 1:1", "Genesis 1"]
    assert one.select(tx.wikitext(F.lit("'''A''' {{x|{{y}}}} [[b|c]] [[d]] <ref>z</ref>\n== H =="))).first()[0].split() == ["A", "c", "d", "H"]
    sizes = spark.createDataFrame([(2048,), (512,), (100,), (None,)], "n int").select(*tx.chunk_sizing(F.col("n"))).collect()
    assert [tuple(r) for r in sizes] == [(400, 80), (353, 70), (200, 40), (200, 40)]


def test_search_styles(spark):
    d = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick fox brown"), (3, "foxes are quick"), (4, None)], "doc_id long, text string")
    ids = lambda q, style="and": [r.doc_id for r in fulltext.search(d, fulltext.parse(q, style)).orderBy("doc_id").collect()]
    assert ids("quick fox") == [1, 2] and ids("quick fox*") == [1, 2, 3] and ids('"brown fox"') == [1] and ids("brown fox", "phrase") == [1] and ids("") == []


def test_probing_every_list_equals_exact_search(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    c = vectors.kmeans(e, 6)
    exact, listed = vectors.search(e, q, 5, block=2), vectors.search_lists(vectors.assign(e, c), q, c, 6, 5)
    key = lambda d: sorted((r.query_id, r.rank, r.vec_id) for r in d.collect())
    assert key(exact) == key(listed)
    assert vectors.recall(listed, exact, 5).first().recall_pct == 100.0


def test_fold_equals_the_state_machine(spark):
    def step(status, kind):
        if kind == "directive":
            return status if status in log.CLOSED else "submitted"
        return log.SETS.get(kind, status)

    kinds = ["approve", "edit", "withdraw", "directive", "applied", "note"]
    rows, want = [], {}
    for card, seq in enumerate(itertools.product(kinds, repeat=4)):
        status = "yours"
        for at, kind in enumerate(seq):
            rows.append((card, at, kind))
            status = step(status, kind)
        want[card] = status
    got = log.fold(spark.createDataFrame(rows, "card long, at int, kind string"), "card", F.col("at"), F.col("kind")).collect()
    assert {r.card: r.status for r in got} == want


def test_stream_equals_batch_in_many_triggers(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(20), rnd.choice(["approve", "edit", "withdraw", "directive", "x"])) for i in range(400)]
    d = spark.createDataFrame(rows, "at long, card long, kind string")
    path = str(tmp_path / "ev")
    d.repartition(5).write.parquet(path)
    streamed = log.fold_stream(spark, path, "card", lambda e: e["at"], lambda e: e["kind"], max_files=2)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, log.fold(d, "card", F.col("at"), F.col("kind")).collect()))


def test_one_edit_breaks_a_chain(spark):
    what = F.concat_ws("|", "n", "body")
    rows = log.chained(spark.createDataFrame([(1, i, f"b{i}") for i in range(6)], "c long, n long, body string"), "c", ["n"], what)
    assert tuple(log.verify(rows, "c", ["n"], what).first()) == (1, 6, 0, 0)
    assert tuple(log.verify(rows.withColumn("body", F.when(F.col("n") == 3, "z").otherwise(F.col("body"))), "c", ["n"], what).first()) == (1, 6, 1, 0)
    assert tuple(log.verify(rows.where("n <> 3"), "c", ["n"], what).first()) == (1, 5, 0, 1)


def test_chain_covers_prev_time_and_payload(spark):
    import hashlib

    df = spark.sql("SELECT id % 3 AS card, id, TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' + make_dt_interval(0, 0, 0, id) AS ts, IF(id % 5 = 0, NULL, 'q\"é') AS note FROM range(60)").repartition(4)
    what = log.body(F.col("ts"), "note", "id")
    rows = log.chained(df, "card", ["ts"], what)
    assert rows.columns == [*df.columns, "prev", "hash"]
    made = sorted(rows.collect(), key=lambda r: (r.card, r.ts))
    prev = None
    for r, json in zip(made, [x.j for x in rows.orderBy("card", "ts").select(what.alias("j")).collect()]):
        prev = log.GENESIS if r.ts.second == r.card and r.ts.minute == 0 else prev
        assert r.prev == prev and r.hash == hashlib.sha256(f"{prev}|{json}".encode()).hexdigest()[:16]
        prev = r.hash
    bad = lambda d: [tuple(r)[2:] for r in log.verify(d, "card", ["ts"], what).orderBy("card").collect()]
    assert bad(rows) == [(0, 0)] * 3
    fixed = spark.createDataFrame(made, rows.schema)
    later = F.when(F.col("id") == 30, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    assert bad(fixed.withColumn("ts", later))[0][0] == 1  # re-timed
    other = made[5].hash
    relinked = fixed.withColumn("prev", F.when(F.col("id") == 31, F.lit(other)).otherwise(F.col("prev")))
    assert bad(relinked)[1][0] == 1 and bad(relinked)[1][1] >= 1
    swapped = fixed.withColumn("ts", F.when(F.col("id") == 32, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:35.000001'")).when(F.col("id") == 35, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:32.000001'")).otherwise(F.col("ts")))
    assert bad(swapped)[2][0] == 2  # reordered
    assert bad(fixed.where("id <> 33"))[0] == (0, 1) and bad(fixed.union(fixed.where("id = 33")))[0][1] >= 1


def test_footnote_findings(spark):
    book = ["# Head", 'He said "one two three four five" here.', "Plain.[^a]", 'She wrote "a b c d e" too.', "[^a]: Author, *Work*, p. 12.", "[^b]: Nothing more.", "stray text"]
    ls = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(book)], "book string, line_no int, text string")
    assert [r.place for r in findings.orphans(ls).collect()] == ["b:7"]
    assert findings.unmarked_quotes(ls).collect() == []  # both stand beside an anchored line
    assert sorted((r["class"], r.what) for r in findings.anchor_mismatches(ls).collect()) == [("NO ANCHOR", "b")]
    notes = findings.classified(ls).where("is_note").select(findings.locator(F.col("text")).alias("l")).collect()
    assert sorted(r.l for r in notes) == ["NO ANCHOR", "page"]


def test_nearest_within_a_band(spark):
    rows = [(i, i % 3, float((i * 37) % 100)) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, k long, at double")
    got = {r.left_id: (r.right_id, r.n_near) for r in relational.nearest_within(d, d, "k", "at", 7.0, "id").collect()}
    for i, k, at in rows:
        near = sorted((abs(at - b), j) for j, k2, b in rows if k2 == k and j != i and abs(at - b) <= 7)
        assert got.get(i) == ((near[0][1], len(near)) if near else None)
