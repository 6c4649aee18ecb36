"""Queries over guarded writes, word checks of cards, healing of an index, ledgers and search surfaces, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark import store
from lexispark.functions import text as tx
from lexispark.operators import cards, fulltext, shelf, workflow
from lexispark.plans.registry import query, table


@query("""
WITH b AS (SELECT doc_id AS block, text FROM documents WHERE doc_id % 9 > 0), a AS (SELECT doc_id AS block, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 > 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 50 = 1),
n AS (SELECT block, count(*) AS n, min(text) AS now FROM a GROUP BY block)
SELECT count(*) FILTER (n IS NULL) AS n_lost, count(*) FILTER (n > 1) AS n_twice, count(*) FILTER (n IS NOT NULL AND b.text IS DISTINCT FROM now) AS n_changed, 'LOST' AS verdict FROM b FULL JOIN n ON b.block = n.block""")
def guarded_write(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("block"), "text")
    edited = d.where("block % 10 > 0").withColumn("text", F.when(F.col("block") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return cards.write_guard(d.where("block % 9 > 0"), edited.unionByName(d.where("block % 50 = 1")), "me", ["me"])


@query("SELECT 0::BIGINT AS n_lost, 0::BIGINT AS n_twice, 0::BIGINT AS n_changed, 'UNCHANGED' AS verdict")
def guarded_write_unchanged(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("block"), "text")
    return cards.write_guard(d, d, "me", ["me"])





@query(r"""
WITH c AS (SELECT p_partkey AS card, p_size AS block, 'It is ' || p_name || ' and "red" or *blue* here, see ' || p_type AS text FROM part),
p AS (SELECT card, block, regexp_replace(regexp_replace(regexp_replace(text, '`[^`]*`', ' ', 'g'), '[“"][^”"]*[”"]', ' ', 'g'), '[*_][^*_]+[*_]', ' ', 'g') AS t FROM c),
a AS (SELECT card, block, unnest(regexp_extract_all(t, '(?i)(.{0,20}\b(?:red|blue|small|old)\b.{0,20})', 1)) AS around FROM p),
h AS (SELECT card, block, lower(regexp_extract(around, '(?i)\b(red|blue|small|old)\b', 1)) AS hit FROM a WHERE NOT regexp_matches(around, 'bolt'))
SELECT card, hit FROM h WHERE hit <> 'old' AND NOT (block % 4 = 0 AND contains('a small thing', hit))""")
def card_word_hits(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit("It is "), "p_name", F.lit(' and "red" or *blue* here, see '), "p_type")
    chapters = p.select(F.col("p_size").alias("block")).distinct().where("block % 4 = 0").withColumn("text", F.lit("A small thing"))
    own = spark.createDataFrame([("Old",)], "word string")
    return cards.word_hits(p.select(F.col("p_partkey").alias("card"), F.col("p_size").alias("block"), text.alias("text")), chapters, "red|blue|small|old", "bolt", own)


@query("SELECT vec_id AS place, label FROM embeddings WHERE vec_id < (SELECT count(*) * 3 // 4 FROM embeddings)")
def index_healed(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("place"), "label")
    n = e.agg((F.floor(F.count(F.lit(1)) * 3 / 4)).alias("n"))
    # vectors were written up to three quarters, and one place beyond the gap
    vectors = e.join(F.broadcast(n), (F.col("place") < F.col("n")) | (F.col("place") == F.col("n") + 3)).select("place")
    return cards.healed(vectors, e)


@query("SELECT count(DISTINCT o_custkey % 50) AS n_folders, max(o_orderdate) AS newest FROM orders")
def shelf_signature(spark, sf):
    path = F.concat(F.lit("/s/"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    return shelf.shelf_signature(table(spark, sf, "orders").select(path.alias("path"), F.col("o_orderdate").alias("modified")))


@query("""
WITH r AS (SELECT p_type, p_size % 6 + 1 AS s, p_partkey, p_name, row_number() OVER (PARTITION BY p_type, p_size % 6 ORDER BY p_partkey) AS n FROM part)
SELECT p_type AS book, s::INTEGER AS section_no, 'Part ' || s AS section, n::INTEGER AS row_no, p_name || ',' || p_partkey AS cells FROM r""")
def fact_check_ledger(spark, sf):
    p = table(spark, sf, "part")
    s, room = F.col("p_size") % 6 + 1, 10**12  # lines of a section, more than there are keys
    rows = p.select(F.col("p_type").alias("book"), (s * room + F.col("p_partkey")).alias("line_no"), F.concat(F.lit("| "), "p_name", F.lit(" | "), F.col("p_partkey").cast("string"), F.lit(" |")).alias("text"))
    heads = p.select(F.col("p_type").alias("book"), s.alias("s")).distinct()
    line = lambda at, text: heads.select("book", (F.col("s") * room + at).cast("bigint").alias("line_no"), text.alias("text"))
    title = F.concat(F.lit("## "), F.col("s").cast("string"), F.lit(". Part "), F.col("s").cast("string"))
    lines = rows.unionByName(line(-9, title)).unionByName(line(-8, F.lit("| Name | Id |"))).unionByName(line(-7, F.lit("|---|---|"))).unionByName(line(-9_000, F.lit("prose")))
    return shelf.ledger(lines).withColumn("cells", F.array_join("cells", ","))


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 2")
def ocr_ledger_append(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"))
    at = store.folder(spark)
    entry = lambda k, status, ts: o.where(F.col("path") % 3 == k).select("path", F.lit("ocr").alias("mode"), F.lit(status).alias("status"), F.lit(ts).alias("ts")).write.mode("append").json(at)
    entry(0, "start", 1)
    entry(0, "ok", 2)
    entry(1, "fail", 1)
    entry(1, "fail", 2)
    return workflow.ocr_queue(o, spark.read.schema("path bigint, mode string, status string, ts int").json(at), "ocr")


@query("""
SELECT p_partkey, CASE WHEN p_size * 60 >= 2048 THEN 400 WHEN p_size * 60 >= 512 THEN floor(p_size * 60 / 1.45)::INTEGER ELSE 200 END AS words,
  CASE WHEN p_size * 60 >= 2048 THEN 80 WHEN p_size * 60 >= 512 THEN floor(floor(p_size * 60 / 1.45) * 0.2)::INTEGER ELSE 40 END AS overlap FROM part""")
def chunk_sizing_by_limit(spark, sf):
    words, overlap = tx.chunk_sizing(F.col("p_size") * 60)
    return table(spark, sf, "part").select("p_partkey", words.alias("words"), overlap.alias("overlap"))


@query(r"""
WITH c AS (SELECT conv_id AS card, conv_id * 1000 + turn AS note, text, CASE WHEN turn % 2 = 0 THEN 'keep' ELSE 'cut' END AS action, lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS around, turn FROM conversations),
w AS (SELECT *, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: length(w) > 3) AS mine, list_filter(string_split_regex(lower(around), '[^\p{L}]+'), lambda w: length(w) > 3) AS other FROM c)
SELECT card, note, CASE WHEN note % 7 = 0 AND action <> 'keep' THEN 'CONFLICT' WHEN len(mine) > 0 AND len(list_filter(mine, lambda w: list_contains(other, w))) / len(mine) >= 0.2 THEN 'PARAPHRASE' ELSE 'OK' END AS class FROM w""")
def card_note_checks(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    note = (F.col("conv_id") * 1000 + F.col("turn")).alias("note")
    around = F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    notes = c.select(F.col("conv_id").alias("card"), note, "text", F.when(F.col("turn") % 2 == 0, "keep").otherwise("cut").alias("action"))
    rulings = notes.where("note % 7 = 0").select("note", F.lit("keep").alias("ruling"))
    return cards.note_checks(notes, c.select(note, around.alias("text")), rulings, 0.2)


@query("""
WITH e AS (SELECT user_id AS card, CASE event_type WHEN 'click' THEN 'directive' WHEN 'purchase' THEN 'applied' WHEN 'view' THEN 'version' ELSE 'note' END AS kind, event_id AS at_ FROM events),
l AS (SELECT card, max(at_) FILTER (kind = 'directive') AS d, max(at_) FILTER (kind = 'applied') AS c FROM e GROUP BY card), s AS (SELECT * FROM l WHERE d IS NOT NULL AND (c IS NULL OR c < d))
SELECT s.card, d AS directed_at, count(e.card) AS n_versions FROM s LEFT JOIN e ON s.card = e.card AND kind = 'version' AND at_ > d GROUP BY s.card, d""")
def directives_open(spark, sf):
    t = F.col("event_type")
    kind = F.when(t == "click", "directive").when(t == "purchase", "applied").when(t == "view", "version").otherwise("note")
    return cards.directives_open(table(spark, sf, "events").select(F.col("user_id").alias("card"), kind.alias("kind"), F.col("event_id").alias("at")), ["applied"])


@query("""
WITH RECURSIVE l AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey * 7 + 3) % (SELECT count(*) FROM part) END AS next FROM part),
w AS (SELECT node AS start, node AS last, [node] AS path, 0 AS hops FROM l UNION ALL SELECT w.start, l.next, list_append(path, l.next), hops + 1 FROM w JOIN l ON w.last = l.node WHERE l.next IS NOT NULL AND NOT list_contains(path, l.next) AND hops < 30),
m AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops DESC) AS r FROM w)
SELECT start, hops::INTEGER AS hops, last, hops < 30 AND l.next IS NOT NULL AND list_contains(path, l.next) AS cyclic FROM m LEFT JOIN l ON m.last = l.node WHERE r = 1""")
def queue_chain_walk(spark, sf):
    from lexispark.operators import relational as rel

    p = table(spark, sf, "part")
    p = p.join(F.broadcast(p.agg(F.count(F.lit(1)).alias("n"))))  # one row
    links = p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 11 != 0, (F.col("p_partkey") * 7 + 3) % F.col("n")).alias("next"))
    return rel.chain_walk(links.where("next is not null"), links.select("node"))


@query("""
SELECT o_orderkey AS path, o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 AND o_custkey % 5 > 0 AS skip FROM orders""")
def manifest_unchanged(spark, sf):
    from lexispark.operators import relational as rel

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("modified"))
    known = o.where("path % 3 > 0").select("path", F.when(F.col("path") % 4 > 0, F.col("size")).otherwise(-1).alias("size"), F.when(F.col("size") % 5 > 0, F.col("modified")).alias("modified"))
    return rel.unchanged(o, known).select("path", "skip")


@query(r"""
WITH t AS (SELECT DISTINCT p_name AS title FROM part), f AS (SELECT DISTINCT p_brand || ' - ' || p_name || CASE WHEN p_size % 2 = 0 THEN ', ' || p_type ELSE 's' END AS name, p_name, p_size % 2 = 0 AS ok FROM part)
SELECT DISTINCT title, name FROM t JOIN f ON p_name = title WHERE ok""")
def titles_in_file_names(spark, sf):
    from lexispark.operators import relational as rel

    p = table(spark, sf, "part")
    name = F.concat("p_brand", F.lit(" - "), "p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(", "), "p_type")).otherwise("s"))
    return rel.titles_in_names(p.select(F.col("p_name").alias("title")).distinct(), p.select(name.alias("name")).distinct(), tx.title_norm)
