"""Queries that run the lookups, reading registers and note checks over tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import findings, lookups, workflow
from lexispark.plans.check_queries import _LINES, _lines
from lexispark.plans.registry import query, table
from lexispark.streaming import eventlog as log


def _parts(spark, sf):
    return table(spark, sf, "part")


@query("SELECT p_partkey AS pid, p_name AS title FROM part WHERE lower(p_name) = 'red widget' ORDER BY length(p_name), p_partkey LIMIT 1")
def lookup_place_exact(spark, sf):
    places = _parts(spark, sf).select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("title"), F.col("p_type").alias("description"))
    return lookups.place(places, "Red Widget").select("pid", "title")


@query("SELECT p_partkey AS pid, p_name AS title FROM part WHERE starts_with(lower(p_name), 'red w') ORDER BY length(p_name), p_partkey LIMIT 1")
def lookup_place_prefix(spark, sf):
    places = _parts(spark, sf).select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("title"), F.col("p_type").alias("description"))
    return lookups.place(places, "red w").select("pid", "title")


_KEYS = "SELECT p_partkey AS key, p_name AS headword, regexp_replace(translate(lower(p_name), 'vj', 'ui'), '[^a-z]', '', 'g') AS norm, p_type AS text FROM part"


def _dictionary(spark, sf):
    return _parts(spark, sf).select(F.col("p_partkey").alias("key"), F.col("p_name").alias("headword"), tx.lexicon_key(F.col("p_name")).alias("norm"), F.col("p_type").alias("text"))


@query(f"WITH e AS ({_KEYS}) SELECT key, headword, left(text, 3) AS text FROM e WHERE norm = 'smallring' ORDER BY length(headword), key LIMIT 5")
def lookup_dictionary_exact(spark, sf):
    return lookups.dictionary(_dictionary(spark, sf), "Small Ring", 5, 3).select("key", "headword", "text")


@query(f"WITH e AS ({_KEYS}) SELECT key, headword, left(text, 3000) AS text FROM e WHERE norm = 'smallring' ORDER BY length(headword), key LIMIT 5")
def lookup_dictionary_inflected(spark, sf):
    return lookups.dictionary(_dictionary(spark, sf), "small ringum").select("key", "headword", "text")


@query("""
WITH s AS (SELECT p_type AS lang, p_partkey, p_size, p_brand FROM part WHERE p_name = 'small ring'),
g AS (SELECT lang, p_partkey, unnest([1, 2]) AS n, p_size, p_brand FROM s)
SELECT lang, p_partkey::VARCHAR AS pos, n::INTEGER AS sense_no, CASE n WHEN 1 THEN 'a; b ' || p_size ELSE 'raw ' || p_size END AS gloss, CASE n WHEN 1 THEN 'x,y' ELSE '' END AS examples FROM g""")
def lookup_numbered_senses(spark, sf):
    size = F.col("p_size").cast("string")
    none = F.lit(None).cast("array<string>")
    sense = lambda g, raw, ex: F.struct(g.alias("glosses"), raw.alias("raw_glosses"), F.array(F.lit("t")).alias("tags"), ex.alias("examples"))
    senses = F.array(
        sense(F.array(F.lit("a"), F.concat(F.lit("b "), size)), none, F.array(*[F.lit(x) for x in "xyz"])),
        sense(F.array(F.lit("")), none, none), sense(none, F.array(F.concat(F.lit("raw "), size)), none),
    )
    e = _parts(spark, sf).select(F.col("p_name").alias("word"), F.col("p_type").alias("lang"), F.col("p_partkey").cast("string").alias("pos"), senses.alias("senses"))
    return lookups.numbered_senses(e, "small ring").select("lang", "pos", "sense_no", "gloss", F.array_join("examples", ",").alias("examples"))


@query("""
WITH t AS (SELECT p_type AS sense, p_brand || p_partkey AS word, p_partkey FROM part WHERE p_name = 'small ring' AND p_size % 2 = 0),
n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM t)
SELECT sense, string_agg(word, ',' ORDER BY r) AS words FROM n WHERE r <= 60 GROUP BY sense""")
def lookup_translations(spark, sf):
    even = _parts(spark, sf).where("p_name = 'small ring' and p_size % 2 = 0")
    one = F.struct("p_partkey", F.col("p_type").alias("sense"), F.concat("p_brand", F.col("p_partkey").cast("string")).alias("word"))
    e = even.groupBy(F.col("p_name").alias("word")).agg(F.array_sort(F.collect_list(one)).alias("translations")).withColumn("lang_code", F.lit("en"))
    return lookups.translations(e, "small ring").withColumn("words", F.array_join("words", ","))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 1 AND (l_suppkey % 7) < 4 THEN '+' WHEN l_linenumber % 2 = 0 AND (l_suppkey % 7) >= 4 THEN '-' WHEN l_linenumber % 2 = 1 AND l_partkey % 3 = 0 THEN '≈' ELSE '' END AS mark FROM lineitem""")
def lookup_edition_marks(spark, sf):
    modern = ["m1", "m2", "m3", "m4", "m5", "m6"]
    eds = F.concat(F.slice(F.array(*[F.lit(m) for m in modern]), 1, F.least(F.lit(6), F.col("l_suppkey") % 7).cast("int")), F.when(F.col("l_linenumber") % 2 == 1, F.array(F.lit("Byz"))).otherwise(F.array().cast("array<string>")))
    words = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", eds.alias("editions"), F.create_map(F.lit("Byz"), F.when(F.col("l_partkey") % 3 == 0, 2).otherwise(0)).alias("offsets"))
    return lookups.edition_marks(words, "Byz", modern).select("l_orderkey", "l_linenumber", "l_partkey", "mark")


@query("SELECT p_name, 'P000012' AS pnum FROM part WHERE p_partkey = 12")
def lookup_record(spark, sf):
    d = _parts(spark, sf).select("p_name", tx.catalogue_number(F.col("p_partkey").cast("string")).alias("pnum"))
    return lookups.record(d, "p 12")


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), '\b(the|a|an|of|and|in|on|to|for|its|his|her|their)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
WITH w AS (SELECT DISTINCT p_name || ' ' || p_type AS title FROM part WHERE p_size < 25), k AS (SELECT title, {_NORM.format('title')} AS k FROM w),
c AS (SELECT DISTINCT {_NORM.format("p_name || ' ' || p_type || ' vol'")} AS o FROM part WHERE p_size = 30), h AS (SELECT DISTINCT {_NORM.format('p_name')} AS o FROM part WHERE p_size > 46),
j AS (SELECT title, bool_or(c.o = k OR (length(k) >= 10 AND length(c.o) >= 10 AND (contains(k, c.o) OR contains(c.o, k)))) AS rd FROM k, c GROUP BY title),
l AS (SELECT title, bool_or(h.o = k OR (length(k) >= 10 AND length(h.o) >= 10 AND (contains(k, h.o) OR contains(h.o, k)))) AS hd FROM k, h GROUP BY title)
SELECT title, CASE WHEN rd THEN 'READ' WHEN hd THEN 'UNREAD' ELSE 'NOT IN LIBRARY' END AS status FROM j JOIN l USING (title)""")
def cited_read_status(spark, sf):
    p = _parts(spark, sf)
    title = F.concat_ws(" ", "p_name", "p_type")
    return workflow.read_status(p.where("p_size < 25").select(title.alias("title")), p.where("p_size = 30").select(F.concat(title, F.lit(" vol")).alias("title")), p.where("p_size > 46").select(F.col("p_name").alias("title")))


@query("""
SELECT 'footnotes' AS "check", o_custkey::VARCHAR AS place, CASE WHEN d IS NULL THEN 'NO DEFINITION' WHEN u IS NULL THEN 'NO ANCHOR' ELSE 'DEFINED TWICE' END AS class, k AS what FROM (
  SELECT o_custkey, 'n' || (o_orderkey % 10) AS k, count(*) FILTER (o_orderkey % 3 = 0) AS n, max(1) FILTER (o_orderkey % 3 = 0) AS d, max(1) FILTER (o_orderkey % 3 > 0) AS u FROM orders GROUP BY ALL)
WHERE d IS NULL OR u IS NULL OR n > 1""")
def footnote_mismatches(spark, sf):
    slug = F.concat(F.lit("n"), (F.col("o_orderkey") % 10).cast("string"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("[^"), slug, F.lit("]: note"))).otherwise(F.concat(F.lit("prose[^"), slug, F.lit("] goes on")))
    lines = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("book"), F.col("o_orderkey").alias("line_no"), text.alias("text"))
    return findings.anchor_mismatches(lines)


_BOOK = "SELECT o_custkey::VARCHAR AS book, o_orderkey AS line_no, CASE WHEN o_orderkey % 5 = 0 THEN '[^a]: note' WHEN o_orderkey % 5 = 1 THEN '  indented' WHEN o_orderkey % 5 = 2 THEN 'He said \"one two three four\" ' || o_orderkey WHEN o_orderkey % 5 = 3 THEN 'plain[^a] ' || o_orderkey ELSE 'plain ' || o_orderkey END AS text FROM orders"


def _book(spark, sf):
    k, n = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    text = F.when(k == 0, "[^a]: note").when(k == 1, "  indented").when(k == 2, F.concat(F.lit('He said "one two three four" '), n)).when(k == 3, F.concat(F.lit("plain[^a] "), n)).otherwise(F.concat(F.lit("plain "), n))
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("book"), F.col("o_orderkey").alias("line_no"), text.alias("text"))


@query(f"""
WITH l AS ({_BOOK}), s AS (SELECT *, max(CASE WHEN starts_with(text, '[^a]:') THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l)
SELECT 'footnotes' AS "check", book || ':' || line_no AS place, 'ORPHAN' AS class, left(text, 70) AS what FROM s WHERE seen = 1 AND NOT starts_with(text, ' ') AND NOT starts_with(text, '[^')""")
def footnote_orphans(spark, sf):
    return findings.orphans(_book(spark, sf))


@query(f"""
WITH l AS ({_BOOK}), c AS (SELECT *, starts_with(text, '[^a]:') AS note, contains(text, '[^a]') AND NOT starts_with(text, '[^a]:') AS anchor FROM l),
n AS (SELECT *, coalesce(lag(NOT note AND anchor) OVER w, false) OR coalesce(lead(NOT note AND anchor) OVER w, false) AS near FROM c WINDOW w AS (PARTITION BY book ORDER BY line_no))
SELECT 'footnotes' AS "check", book || ':' || line_no AS place, 'UNMARKED' AS class, left(text, 70) AS what FROM n WHERE NOT note AND NOT anchor AND NOT near AND contains(text, '"one')""")
def footnote_unmarked_quotes(spark, sf):
    return findings.unmarked_quotes(_book(spark, sf))


@query("""
SELECT user_id, event_id, CASE WHEN event_type = 'purchase' AND TIMESTAMP '2024-01-20 00:00:00' < ts + INTERVAL 86400 SECOND THEN 'approving' WHEN event_type = 'purchase' THEN 'approved' ELSE 'yours' END AS status FROM events""")
def event_settled(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "approved").otherwise("yours")
    return table(spark, sf, "events").select("user_id", "event_id", log.settle(status, F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 86_400).alias("status"))


@query(_LINES + r"""
, h AS (SELECT book, line_no, unnest(regexp_extract_all(text, 'der [a-z]+')) AS hit, left(text, 2) AS head FROM l)
SELECT count(*) AS n, count(DISTINCT book) AS n_books FROM h WHERE left(sha1(hit), 10) NOT IN (SELECT left(sha1(hit), 10) FROM h WHERE book::BIGINT % 10 = 0)""")
def banned_less_ruled(spark, sf):
    lines = _lines(spark, sf)
    ruled = findings.banned(lines.where("cast(book AS bigint) % 10 = 0"), [("der", "der [a-z]+")], around=0).select(tx.fingerprint(F.col("what")).alias("fingerprint"))
    hits = findings.banned(lines, [("der", "der [a-z]+")], ruled=ruled, around=0)
    return hits.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.split_part("place", F.lit(":"), F.lit(1))).alias("n_books"))


@query(r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, lower(unnest(ls)) AS line FROM d),
t AS (SELECT doc_id, array_to_string(string_split(ls[1], ' ')[3:5], ' ') AS term, doc_id + CASE WHEN doc_id % 200 = 0 THEN 0 ELSE 1 END AS target FROM d WHERE len(string_split(ls[1], ' ')) > 8),
b AS (SELECT *, lower(trim(term)) AS b FROM t),
v AS (SELECT DISTINCT doc_id, term, target, unnest(list_filter([b, replace(b, '-', ' '), replace(b, ' ', '-'), b || 's', CASE WHEN b NOT LIKE '%s' THEN b || 'es' END, CASE WHEN b LIKE '%y' THEN b[:-2] || 'ies' END, CASE WHEN b LIKE '%man' THEN b[:-4] || 'men' END, CASE WHEN b LIKE '%s' THEN b[:-2] END], lambda x: x IS NOT NULL AND x <> '')) AS v FROM b),
h AS (SELECT v.doc_id, term, target, list_sort(list(DISTINCT l.doc_id::VARCHAR) FILTER (l.doc_id IS NOT NULL)) AS places FROM v LEFT JOIN l ON contains(line, v) GROUP BY ALL)
SELECT 'crossrefs' AS "check", doc_id::VARCHAR AS place, 'NOT THERE' AS class, term || ': ' || array_to_string(coalesce(places, []), ', ') AS what FROM h WHERE NOT list_contains(coalesce(places, []), target::VARCHAR)""")
def cross_references(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split(F.split("text", "\n")[0], " ").alias("ws")).where("size(ws) > 8")
    target = (F.col("doc_id") + F.when(F.col("doc_id") % 200 == 0, 0).otherwise(1)).cast("string")
    terms = d.select(F.col("doc_id").cast("string").alias("book"), F.array_join(F.slice("ws", 3, 3), " ").alias("term"), target.alias("target"))
    return findings.cross_references(_lines(spark, sf), terms)


@query("""
WITH w AS (SELECT p_partkey, p_size, p_brand, p_type FROM part WHERE p_name = 'small ring'),
r AS (SELECT 'synonyms' AS relation, p_partkey, 1 AS i, p_brand AS x FROM w UNION ALL SELECT 'synonyms', p_partkey, 2, p_type FROM w UNION ALL SELECT 'derived', p_partkey, 1, 'd' || p_size FROM w WHERE p_size > 10),
f AS (SELECT relation, x, min((p_partkey, i)) AS pl FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY pl) AS k FROM f)
SELECT relation, string_agg(x, ',' ORDER BY k) AS words FROM n WHERE k <= 40 GROUP BY relation""")
def lookup_entry_relations(spark, sf):
    derived = F.when(F.col("p_size") > 10, F.array(F.concat(F.lit("d"), F.col("p_size").cast("string"))))
    e = _parts(spark, sf).select(F.col("p_name").alias("word"), F.col("p_partkey").alias("entry_no"), F.array("p_brand", "p_type").alias("synonyms"), derived.alias("derived"))
    return lookups.entry_relations(e, "small ring").withColumn("words", F.array_join("words", ","))


@query("""
WITH s AS (SELECT p_partkey, unnest([1, 2]) AS i, p_brand, p_size FROM part WHERE p_name = 'small ring'),
f AS (SELECT CASE WHEN i = 1 THEN '/' || p_brand || '/' ELSE 'enPR: ' || p_size END AS form, min((p_partkey, i)) AS pl FROM s WHERE i = 1 OR p_size % 2 = 0 GROUP BY 1)
SELECT string_agg(form, ',' ORDER BY pl) AS sounds FROM f""")
def lookup_pronunciations(spark, sf):
    none = F.lit(None).cast("string")
    ipa = F.struct(F.concat(F.lit("/"), "p_brand", F.lit("/")).alias("ipa"), none.alias("enpr"))
    enpr = F.struct(none.alias("ipa"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).alias("enpr"))
    e = _parts(spark, sf).select(F.col("p_name").alias("word"), F.col("p_partkey").alias("entry_no"), F.array(ipa, enpr).alias("sounds"))
    return lookups.pronunciations(e, "small ring").withColumn("sounds", F.array_join("sounds", ","))
