"""Queries over registers, shelves, passages and cards, derived from the relational tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import cards, findings, lookups, passages, shelf, workflow
from lexispark.plans.check_queries import _LINES, _lines
from lexispark.plans.registry import query, table


def _t(name):
    return lambda spark, sf: table(spark, sf, name)


_docs, _orders, _items, _parts, _pages, _events = (_t(n) for n in ("documents", "orders", "lineitem", "part", "pages", "events"))

# ---- passages


@query("""
WITH s AS (SELECT l_orderkey % 50 AS work, (l_suppkey % 12)::VARCHAR || '.' || l_linenumber AS location, l_suppkey % 12 AS c, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
r AS (SELECT o_orderkey AS ref_id, o_orderkey % 55 AS work, (o_custkey % 14)::VARCHAR || '.' || (o_orderkey % 9) AS ref, o_custkey % 14 AS c FROM orders),
a AS (SELECT ref_id, 0 AS tier, seq FROM r JOIN s ON r.work = s.work AND ref = location),
b AS (SELECT ref_id, 1, seq FROM r JOIN s ON r.work = s.work AND r.c = s.c WHERE ref_id NOT IN (SELECT ref_id FROM a)),
n AS (SELECT work, count(DISTINCT c) AS chapters FROM s GROUP BY work)
SELECT ref_id, tier::INTEGER AS tier, seq, NULL::BIGINT AS chapters FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
UNION ALL SELECT ref_id, 2, NULL, coalesce(chapters, 0) FROM r LEFT JOIN n USING (work) WHERE ref_id NOT IN (SELECT ref_id FROM a) AND ref_id NOT IN (SELECT ref_id FROM b)""")
def passage_fallbacks(spark, sf):
    seg = _items(spark, sf).select((F.col("l_orderkey") % 50).alias("work"), F.concat_ws(".", (F.col("l_suppkey") % 12).cast("string"), F.col("l_linenumber").cast("string")).alias("location"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    refs = _orders(spark, sf).select(F.col("o_orderkey").alias("ref_id"), (F.col("o_orderkey") % 55).alias("work"), F.concat_ws(".", (F.col("o_custkey") % 14).cast("string"), (F.col("o_orderkey") % 9).cast("string")).alias("ref"))
    return passages.resolved(refs, seg)


_STEPS = "SELECT l_suppkey AS work, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber = 1 THEN l_orderkey % 400 END AS page, CASE WHEN l_linenumber = 1 THEN chr((97 + p % 5)::INTEGER) END AS letter FROM (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY ALL)"


@query(f"""
WITH s AS ({_STEPS}), u AS (SELECT *, last_value(CASE WHEN page IS NOT NULL THEN {{'p': page, 'l': letter}} END IGNORE NULLS) OVER (PARTITION BY work ORDER BY seq) AS under FROM s)
SELECT work, seq, under.p AS under_page, under.l AS under_letter FROM u WHERE (under.p > 327 OR (under.p = 327 AND under.l >= 'b')) AND (under.p < 354 OR (under.p = 354 AND under.l <= 'c'))""")
def passage_milestone_span(spark, sf):
    first = F.col("l_linenumber") == 1
    each = _items(spark, sf).groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    seg = each.select(F.col("l_suppkey").alias("work"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(first, F.col("l_orderkey") % 400).alias("page"), F.when(first, F.char((97 + F.col("l_partkey") % 5).cast("int"))).alias("letter"))
    at = lambda p, l: F.struct(F.lit(p).cast("bigint").alias("page"), F.lit(l).alias("letter"))
    out = passages.milestone_span(seg, at(327, "b"), at(354, "c"))
    return out.select("work", "seq", F.col("under.page").alias("under_page"), F.col("under.letter").alias("under_letter"))


@query("""
WITH v AS (SELECT l_suppkey % 66 AS book, l_partkey % 40 AS chapter, l_linenumber AS verse, CASE l_returnflag WHEN 'A' THEN 'grc1' WHEN 'R' THEN 'grc2' ELSE 'eng1' END AS edition, l_orderkey * 10 + l_linenumber AS id FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY book, chapter, verse ORDER BY CASE edition WHEN 'grc1' THEN 1 WHEN 'grc2' THEN 2 ELSE 3 END, edition, id) AS r FROM v)
SELECT book, chapter, verse, any_value(edition) FILTER (r = 1) AS edition, any_value(id) FILTER (r = 1) AS id, count(DISTINCT edition) AS n_editions FROM r GROUP BY book, chapter, verse""")
def passage_preferred_edition(spark, sf):
    edition = F.when(F.col("l_returnflag") == "A", "grc1").when(F.col("l_returnflag") == "R", "grc2").otherwise("eng1")
    v = _items(spark, sf).select((F.col("l_suppkey") % 66).alias("book"), (F.col("l_partkey") % 40).alias("chapter"), F.col("l_linenumber").alias("verse"), edition.alias("edition"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return passages.preferred_edition(v, ["book", "chapter", "verse"], "edition", ["grc1", "grc2"], ["id"])


@query(_LINES + """
, f AS (SELECT book, line_no, strip_accents(lower(text)) AS t FROM l)
SELECT book, line_no::INTEGER AS line_no, strpos(t, 'tion de')::INTEGER AS at, substr(t, greatest(1, strpos(t, 'tion de') - 40), strpos(t, 'tion de') - greatest(1, strpos(t, 'tion de') - 40) + 47) AS context FROM f WHERE contains(t, 'tion de')""")
def verse_concordance(spark, sf):
    return passages.concordance(_lines(spark, sf), "tion de")


@query(r"""
WITH e AS (SELECT p_partkey AS entry_id, p_name || CASE WHEN p_partkey % 3 > 0 THEN '-' || p_partkey % 3 ELSE '' END AS key FROM part),
k AS (SELECT entry_id, key, regexp_replace(lower(key), '-\d+$', '') AS k FROM e), w AS (SELECT DISTINCT p_name AS word FROM part)
SELECT word, entry_id, key FROM w JOIN k ON k = lower(word)""")
def lexicon_variant_entries(spark, sf):
    k = F.col("p_partkey") % 3
    entries = _parts(spark, sf).select(F.col("p_partkey").alias("entry_id"), F.concat("p_name", F.when(k > 0, F.concat(F.lit("-"), k.cast("string"))).otherwise("")).alias("key"))
    return passages.variant_entries(_parts(spark, sf).select(F.col("p_name").alias("word")).distinct(), entries)


@query(r"""
WITH p AS (SELECT doc_id, string_split(replace(text, ', ', '[^n] '), '[^n]') AS ps FROM documents)
SELECT doc_id, i::INTEGER AS anchor_no, trim(ps[i], ' ') AS span FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM p)""")
def footnote_anchor_spans(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.replace("text", F.lit(", "), F.lit("[^n] ")).alias("text"))
    return passages.anchor_spans(rows, findings.ANCHOR).select("doc_id", "anchor_no", "span")


_CUTS = """
WITH w AS (SELECT doc_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS ws FROM documents),
q AS (SELECT doc_id AS quote_id, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id END AS source_id, array_to_string(ws[3:5], ' ') AS head, array_to_string(ws[(30 + doc_id % 60):(33 + doc_id % 60)], ' ') AS tail FROM w WHERE len(ws) > 120),
s AS (SELECT doc_id AS source_id, regexp_replace(text, '\\s+', ' ', 'g') AS body FROM documents),
b AS (SELECT quote_id, body, head, tail, strpos(body, head) AS h, substr(body, strpos(body, head) + length(head)) AS rest FROM q LEFT JOIN s USING (source_id)),
c AS (SELECT *, strpos(rest, tail) AS t FROM b),
r AS (SELECT quote_id, rest, t, CASE WHEN body IS NULL THEN 'NO SOURCE' WHEN h = 0 THEN 'NO HEAD' WHEN t = 0 THEN 'NO TAIL' WHEN t - 1 > 400 THEN 'FAR' ELSE 'CUT' END AS status FROM c)
SELECT quote_id, status, CASE WHEN status = 'CUT' THEN trim(left(rest, t - 1), ' ') END AS cut FROM r"""


@query(_CUTS)
def ellipsis_cuts(spark, sf):
    flat = _docs(spark, sf).select(F.col("doc_id"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    part = lambda a, n: F.array_join(F.slice("ws", a, n), " ")
    d = F.col("doc_id")
    source = F.when(d % 7 == 0, d + 1).when(d % 11 == 0, F.lit(-1)).otherwise(d)
    quotes = flat.select("doc_id", F.split("text", " ").alias("ws")).where(F.size("ws") > 120).select(d.alias("quote_id"), source.alias("source_id"), part(3, 3).alias("head"), part((30 + d % 60).cast("int"), 4).alias("tail"))
    return passages.ellipsis_cuts(quotes, flat.withColumnRenamed("doc_id", "source_id"))


# ---- shelves and registers


@query("""
WITH c AS (SELECT p_partkey, p_name, p_type, 'no. ' || p_partkey AS number FROM part WHERE lower(p_type) IN ('small') OR contains(lower(p_type || ' ' || p_name), 'ring')),
t AS (SELECT doc_id AS k, text FROM documents WHERE length(text) >= 30)
SELECT p_partkey, 'P' || lpad(p_partkey::VARCHAR, 6, '0') AS pnum, length(text) AS n_chars FROM c JOIN t ON p_partkey = k""")
def catalogue_texts(spark, sf):
    c = _parts(spark, sf).select("p_partkey", "p_name", "p_type", F.concat(F.lit("no. "), F.col("p_partkey").cast("string")).alias("number"))
    texts = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("number"), "text")
    return shelf.catalogued(c, texts, shelf.in_scope(F.col("p_type"), F.col("p_name"), ["Small"], ["ring"])).select("p_partkey", "pnum", F.length("text").cast("bigint").alias("n_chars"))


@query("""
SELECT o_orderkey AS page_id, 'T' || o_orderkey AS title, p_name AS text FROM orders
JOIN (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey JOIN part ON p = p_partkey
WHERE o_orderkey % 4 = 0 AND o_orderstatus <> 'P' AND l_linenumber = 1 AND s % 10 <> 3""")
def wiki_dump_chain(spark, sf):
    pages = _orders(spark, sf).select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("title"), (F.col("o_orderkey") % 4).alias("namespace"), (F.col("o_orderstatus") == "P").alias("is_redirect"), F.col("o_orderkey").alias("latest"))
    i = _items(spark, sf).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey")).withColumn("content_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    slots = i.select(F.col("l_orderkey").alias("revision_id"), F.when(F.col("l_linenumber") == 1, "main").otherwise("aux").alias("role"), "content_id")
    contents = i.select("content_id", F.concat(F.when(F.col("l_suppkey") % 10 == 3, "es:").otherwise("tt:"), F.col("l_partkey").cast("string")).alias("address"))
    return shelf.page_texts(pages, slots, contents, _parts(spark, sf).select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text")))


@query("""
WITH s AS (SELECT o_custkey AS stem, max(o_orderdate) AS changed FROM orders GROUP BY 1), o AS (SELECT l_suppkey AS stem, max(l_shipdate) AS made FROM lineitem WHERE l_suppkey % 3 > 0 AND l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1)
SELECT stem, CASE WHEN made IS NULL THEN 'missing' WHEN changed > made THEN 'stale' ELSE 'current' END AS status FROM s LEFT JOIN o USING (stem)""")
def published_state(spark, sf):
    src = _orders(spark, sf).select(F.col("o_custkey").alias("stem"), F.col("o_orderdate").alias("modified"))
    out = _items(spark, sf).where("l_suppkey % 3 > 0 AND l_shipdate < TIMESTAMP '1998-06-01'").select(F.col("l_suppkey").alias("stem"), F.col("l_shipdate").alias("modified"))
    return shelf.published(src, out)


@query("""
WITH p AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 20), f AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 40)
SELECT name, name IN (SELECT name FROM f) AS covered FROM p""")
def open_problems(spark, sf):
    files = _parts(spark, sf).where("p_size > 40").select(F.concat("p_name", F.lit(" - OCR")).alias("name")).unionByName(_parts(spark, sf).select(F.col("p_name").alias("name")))
    return shelf.open_problems(_parts(spark, sf).where("p_size < 20").select(F.col("p_name").alias("name")).distinct(), files)


@query("""
WITH c AS (SELECT p_brand, p_size AS score, length(p_type) AS tier, p_retailprice AS size, p_partkey AS candidate FROM part),
t AS (SELECT * FROM c QUALIFY score = max(score) OVER (PARTITION BY p_brand))
SELECT p_brand, candidate, score, row_number() OVER (PARTITION BY p_brand ORDER BY tier, size DESC, candidate)::INTEGER AS place FROM t""")
def best_editions(spark, sf):
    c = _parts(spark, sf).select("p_brand", F.col("p_size").alias("score"), F.length("p_type").alias("tier"), F.col("p_retailprice").alias("size"), F.col("p_partkey").alias("candidate"))
    return shelf.best_editions(c, "p_brand", "score", "tier", "size").select("p_brand", "candidate", "score", "place")


_CITED = "SELECT p_name || ' ' || l_suppkey AS title, l_orderkey % 40 AS chapter, 'n' || l_orderkey AS note, l_suppkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey"


def _cited(spark, sf):
    rows = _items(spark, sf).join(_parts(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.concat_ws(" ", "p_name", F.col("l_suppkey").cast("string")).alias("title"), (F.col("l_orderkey") % 40).alias("chapter"), F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("note"), "l_suppkey", "p_size")


@query(f"""
WITH c AS ({_CITED}), r AS (SELECT DISTINCT title FROM c WHERE l_suppkey % 5 = 0), s AS (SELECT DISTINCT title FROM c WHERE l_suppkey % 3 = 0)
SELECT title, CASE WHEN title IN (SELECT title FROM s) THEN 'unread' ELSE 'notondrive' END AS lane, count(*) AS cites, array_to_string(list_sort(list(DISTINCT note))[1:3], ',') AS notes
FROM c WHERE title NOT IN (SELECT title FROM r) GROUP BY title""")
def backlog(spark, sf):
    c = _cited(spark, sf)
    out = shelf.backlog(c.select("title", "note"), c.where("l_suppkey % 5 = 0").select("title"), c.where("l_suppkey % 3 = 0").select("title"))
    return out.withColumn("notes", F.array_join("notes", ","))


@query(f"""
WITH c AS ({_CITED}) SELECT title, count(*) AS cites FROM c GROUP BY title HAVING bool_and(l_suppkey % 5 > 0) AND bool_and(l_suppkey % 3 > 0) AND bool_and(l_suppkey % 7 > 0)""")
def unplaced_works(spark, sf):
    c = _cited(spark, sf)
    return shelf.unplaced(c, *[c.where(f"l_suppkey % {k} = 0").select("title") for k in (5, 3, 7)])


@query(f"""
WITH c AS ({_CITED}), e AS (SELECT title, chapter, count(*) AS n FROM c GROUP BY ALL)
SELECT title, sum(n)::BIGINT AS total, string_agg(chapter || ':' || n, ',' ORDER BY chapter) AS per_chapter FROM e GROUP BY title""")
def cited_works_counter(spark, sf):
    out = shelf.citations(_cited(spark, sf).select("title", "chapter"))
    return out.select("title", "total", F.array_join(F.transform(F.map_entries("per_chapter"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("per_chapter"))


@query("""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/tmp/x' || page_id WHEN 2 THEN 'name ' || page_id WHEN 3 THEN '/shelf/smith work ' || page_id || '.pdf' ELSE '/shelf/other ' || page_id || '.pdf' END AS path FROM pages)
SELECT path, CASE page_id % 5 WHEN 0 THEN 'URL' WHEN 1 THEN 'SANDBOX' WHEN 2 THEN 'NOT A PATH' ELSE CASE WHEN page_id % 4 = 0 THEN 'MISSING' WHEN page_id % 5 = 4 THEN 'AUTHOR' ELSE 'OK' END END AS class FROM p""")
def path_findings(spark, sf):
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    path = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/tmp/x"), i)).when(k == 2, F.concat(F.lit("name "), i)).when(k == 3, F.concat(F.lit("/shelf/smith work "), i, F.lit(".pdf"))).otherwise(F.concat(F.lit("/shelf/other "), i, F.lit(".pdf")))
    rows = _pages(spark, sf).select("page_id", path.alias("path"), F.lit("Smith, J.").alias("author"))
    return shelf.path_findings(rows.select("path", "author"), rows.where("page_id % 4 <> 0"))


@query(r"""
SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text || chr(10) || '[^a]: a note' || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```', '(?s)```.*?```', ' ', 'g'), '\s+'), lambda w: w <> ''))::INTEGER - 3 AS n_words FROM documents""")
def prose_word_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", shelf.prose_words(F.concat("text", F.lit("\n[^a]: a note\n```\ncode\n```"))).alias("n_words"))


@query("SELECT count(*) AS n_rows, count(DISTINCT source) AS n_keys, round(sum(n_chars) / 1048576.0, 2) AS mb, max(doc_id) AS made FROM documents")
def index_stats(spark, sf):
    return shelf.index_stats(_docs(spark, sf), "source", "n_chars", "doc_id")


@query("""
SELECT count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'O') AS n_waiting, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n_other,
  round(avg(o_custkey) FILTER (o_orderstatus = 'F') * count(*) FILTER (o_orderstatus = 'O'), 1) AS seconds_left FROM orders""")
def extraction_eta(spark, sf):
    return shelf.eta(_orders(spark, sf), "o_orderstatus", "o_custkey", "F", "O")


@query("SELECT p_type AS book, min_by(p_name, (-length(p_name), p_name)) AS canonical FROM part GROUP BY p_type")
def longest_alias(spark, sf):
    return shelf.longest_alias(_parts(spark, sf).select(F.col("p_type").alias("book"), F.col("p_name").alias("alias")))


@query("""
WITH e AS (SELECT p_brand AS author, p_name AS title, array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS langs FROM part GROUP BY ALL)
SELECT author, string_agg(title || ' (' || langs || ')', '; ' ORDER BY title || ' (' || langs || ')') AS works FROM e WHERE contains(lower(author), '#1') GROUP BY author ORDER BY author LIMIT 120""")
def works_by_author(spark, sf):
    return shelf.works_by_author(_parts(spark, sf).select(F.col("p_brand").alias("author"), F.col("p_name").alias("title"), F.col("p_type").alias("lang")), "#1")


@query("SELECT p_type, sum(p_size)::BIGINT AS n FROM part GROUP BY p_type UNION ALL SELECT 'total', sum(p_size)::BIGINT FROM part")
def list_subjects(spark, sf):
    return shelf.subjects(_parts(spark, sf), "p_type", "p_size")


@query("SELECT DISTINCT p_type AS lang FROM part WHERE p_name = 'small ring' AND NOT EXISTS (SELECT 1 FROM part WHERE p_name = 'small ring' AND p_type = 'NONE') ORDER BY 1 LIMIT 25")
def language_hint(spark, sf):
    return shelf.language_hint(_parts(spark, sf).select(F.col("p_name").alias("word"), F.col("p_type").alias("lang")), "small ring", "NONE")


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], '|') AS words FROM documents")
def pruned_lists(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.split("text", " ").alias("words"), "lang")
    return shelf.pruned(rows, {"words": 5}, ["lang"]).select("doc_id", F.array_join("words", "|").alias("words"))


_FAULTS = {"doubled space": "[.] [.]", "entity": "&[a-z]+;", "menu": "(?i)cookie|subscribe"}
_PLAIN_PAGE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"WITH p AS (SELECT page_id, {_PLAIN_PAGE} AS t FROM pages), f AS (" + " UNION ALL ".join(f"SELECT page_id, '{k}' AS fault, len(regexp_extract_all(t, '{p}'))::INTEGER AS n FROM p" for k, p in _FAULTS.items()) + ") SELECT * FROM f WHERE n > 0")
def page_audit(spark, sf):
    return shelf.page_faults(_pages(spark, sf), _FAULTS)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 < 2 ORDER BY o_orderkey LIMIT 30")
def clamped_results(spark, sf):
    return _orders(spark, sf).where("o_orderkey % 6 < 2").select("o_orderkey").orderBy("o_orderkey").limit(tx.clamp(5000, 10, 30))


@query("""
WITH h AS (SELECT doc_id, source FROM documents WHERE contains(text, 'the '))
SELECT doc_id, source, (SELECT count(*) FROM h) AS n_all FROM h ORDER BY doc_id LIMIT 15""")
def first_n_with_total(spark, sf):
    hits = _docs(spark, sf).where(F.col("text").contains("the ")).select("doc_id", "source")
    return hits.orderBy("doc_id").limit(15).join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("n_all"))))  # one row


# ---- cards


@query("""
WITH s AS (SELECT o_custkey AS card, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders WHERE o_orderkey % 3 > 0),
l AS (SELECT card, max(version) AS last FROM s GROUP BY card)
SELECT card, id, version::INTEGER AS version FROM s
UNION ALL SELECT o_custkey, o_orderkey, (coalesce(last, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER FROM orders LEFT JOIN l ON card = o_custkey WHERE o_orderkey % 3 = 0""")
def card_versions_appended(spark, sf):
    from pyspark.sql import Window

    o = _orders(spark, sf).select(F.col("o_custkey").alias("card"), F.col("o_orderkey").alias("id"))
    store = o.where("id % 3 > 0").withColumn("version", F.row_number().over(Window.partitionBy("card").orderBy("id")))
    return cards.appended(store, o.where("id % 3 = 0"), "id")


@query("SELECT o_orderstatus AS status, o_orderpriority AS lane, count(*) AS n FROM orders GROUP BY ALL")
def card_counts(spark, sf):
    return cards.counts(_orders(spark, sf).select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("lane")), "status", "lane")


@query("""
WITH t AS (SELECT l_orderkey AS card, CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey END AS block, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS note FROM lineitem),
n AS (SELECT p_partkey AS note, (p_size + 1000)::BIGINT AS block FROM part),
b AS (SELECT card, block FROM t WHERE block IS NOT NULL UNION SELECT card, n.block FROM t JOIN n USING (note))
SELECT card, string_agg(block::VARCHAR, ',' ORDER BY block) AS blocks FROM b GROUP BY card""")
def card_families(spark, sf):
    odd = F.col("l_linenumber") % 2 == 1
    touched = _items(spark, sf).select(F.col("l_orderkey").alias("card"), F.when(odd, F.col("l_suppkey")).alias("block"), F.when(~odd, F.col("l_partkey")).alias("note"))
    notes = _parts(spark, sf).select(F.col("p_partkey").alias("note"), (F.col("p_size") + 1000).cast("bigint").alias("block"))
    out = cards.families(touched, notes)
    return out.select("card", F.array_join(F.transform("blocks", lambda b: b.cast("string")), ",").alias("blocks"))


@query("""
WITH s AS (SELECT user_id AS block, max(ts) FILTER (event_type IN ('purchase', 'signup')) AS closed_at, max(ts) FILTER (event_type = 'error') AS opened_at FROM events GROUP BY user_id)
SELECT DISTINCT o_orderkey AS card, block, closed_at FROM orders JOIN s ON o_custkey = block WHERE closed_at IS NOT NULL AND (opened_at IS NULL OR opened_at <= closed_at)""")
def cards_on_closed_blocks(spark, sf):
    c = _orders(spark, sf).select(F.col("o_orderkey").alias("card"), F.col("o_custkey").alias("block"))
    ev = _events(spark, sf).select(F.col("user_id").alias("block"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    return cards.on_closed(c, ev, ["purchase", "signup"], "error")


@query("""
WITH n AS (SELECT doc_id AS block, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS now FROM documents WHERE doc_id % 9 > 0),
s AS (SELECT doc_id AS segment_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id END AS block, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'gone' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS was,
  CASE WHEN doc_id % 6 = 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE trim(regexp_replace(text || ' x', '\\s+', ' ', 'g')) END AS too FROM documents),
p AS (SELECT now AS was, count(*) AS places FROM n GROUP BY now)
SELECT segment_id, CASE WHEN now IS NOT NULL THEN CASE WHEN now = too THEN 'already-applied' WHEN now = was THEN 'replace' ELSE 'drift' END
  ELSE CASE WHEN was = '' THEN 'insert' WHEN coalesce(places, 0) = 1 THEN 'replace' WHEN coalesce(places, 0) = 0 THEN 'refuse-none' ELSE 'refuse-many' END END AS action
FROM s LEFT JOIN n USING (block) LEFT JOIN p USING (was)""")
def card_apply_plan(spark, sf):
    d = F.col("doc_id")
    before = F.when(d % 5 == 0, "").when(d % 5 == 1, "gone").otherwise(F.col("text"))
    seg = _docs(spark, sf).select(d.alias("segment_id"), F.when(d % 4 != 3, d).alias("block"), before.alias("before"), F.when(d % 6 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" x"))).alias("after"))
    return cards.apply_plan(seg, _docs(spark, sf).where("doc_id % 9 > 0").select(d.alias("block"), "text"))


@query("""
WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), c AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1), e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 2),
f AS (SELECT * FROM r EXCEPT SELECT * FROM c EXCEPT SELECT * FROM e)
SELECT l_suppkey, l_partkey, (SELECT max(l_orderkey) FROM lineitem WHERE l_linenumber = 1) + row_number() OVER (ORDER BY l_suppkey, l_partkey) AS number FROM f""")
def card_read_log(spark, sf):
    keys = ["l_suppkey", "l_partkey"]
    i = _items(spark, sf)
    claims = i.where("l_linenumber = 1").select(*keys, F.col("l_orderkey").alias("number"))
    return cards.read_log(i.select(*keys), claims, i.where("l_linenumber = 2").select(*keys), keys, keys)


@query("""
WITH c AS (SELECT user_id AS card, count(*) AS n, max_by(event_type, event_id) AS last, max(value) AS top, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)
SELECT card, CASE WHEN top < 20 THEN 'FIELDS' WHEN last = 'purchase' THEN 'CLOSED' WHEN card % 5 = 0 THEN 'HELD' WHEN n > 110 THEN 'STOP' WHEN last = 'click' AND card % 2 = 0 THEN 'OLD VERSION' ELSE 'OK' END AS guard,
  CASE WHEN n > 110 THEN 'words' WHEN kinds < 5 THEN 'reads' WHEN top > 90 THEN 'notes' ELSE 'ready' END AS lane FROM c""")
def card_guards_and_gates(spark, sf):
    c = _events(spark, sf).groupBy(F.col("user_id").alias("card")).agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", "event_id").alias("last"), F.max("value").alias("top"), F.count_distinct("event_type").alias("kinds"))
    status = F.when(F.col("last") == "purchase", "applied").when(F.col("last") == "click", "approved").otherwise("submitted")
    g = cards.guard(status, F.col("card") % 5 == 0, F.col("n"), F.when(F.col("top") < 20, 1).otherwise(0), F.col("card") % 2 == 1, 110)
    return c.select("card", g.alias("guard"), cards.gate({"words": F.col("n") > 110, "reads": F.col("kinds") < 5, "notes": F.col("top") > 90}).alias("lane"))


@query("""
SELECT doc_id AS id, CASE WHEN quality IS NULL THEN 'unrun' WHEN doc_id % 6 = 0 THEN 'stale' WHEN toxic = 1 THEN 'own-session' ELSE 'audited' END AS state FROM documents LEFT JOIN labels USING (doc_id)""")
def prose_audit_state(spark, sf):
    d = _docs(spark, sf)
    audits = d.join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256).alias("hash"), F.when(F.col("toxic") == 1, "w").otherwise("r").alias("session"))
    return cards.audit_state(d.select(F.col("doc_id").alias("id"), "text", F.lit("w").alias("session")), audits)


@query("SELECT o_custkey AS batch, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey HAVING count(*) > 10")
def uat_gate(spark, sf):
    accepted = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("batch"))
    return cards.unaccepted_bulks(_orders(spark, sf).select(F.col("o_custkey").alias("batch")), accepted, 10)


@query(r"""
WITH b AS (SELECT o_custkey::VARCHAR AS book, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey FROM orders),
l AS (SELECT book, n, o_orderkey, n // 2 AS item FROM b WHERE n BETWEEN 2 AND 7)
SELECT book, (item * 2)::INTEGER AS line_no, string_agg(CASE WHEN n % 2 = 0 THEN 'ask ' ELSE 'more ' END || o_orderkey, ' ' ORDER BY n) AS ask FROM l GROUP BY book, item""")
def open_asks(spark, sf):
    from pyspark.sql import Window

    o = _orders(spark, sf).select(F.col("o_custkey").cast("string").alias("book"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("line_no"), F.col("o_orderkey").cast("string").alias("k"))
    text = F.when(F.col("line_no") == 1, "## Open").when(F.col("line_no") == 8, "## Answered").when(F.col("line_no") % 2 == 0, F.concat(F.lit("- ask "), "k")).otherwise(F.concat(F.lit("  more "), "k"))
    return cards.open_asks(o.select("book", "line_no", text.alias("text")))




def _pile_sql():
    from lexispark.plans.function_queries import _SENTENCES

    anchored = " OR ".join(f"regexp_matches(s, '{p}')" for p in findings.LOCATORS.values())
    return f"""
WITH c AS (SELECT conv_id * 1000 + turn AS note, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS around FROM conversations),
x AS (SELECT note, around, {_SENTENCES} AS ss FROM c), e AS (SELECT note, around, i, ss[i] AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM x)),
w AS (SELECT *, regexp_extract_all(s, '([A-Za-z]{{4,}})', 1) AS ws FROM e)
SELECT note, i::INTEGER AS sentence_no, CASE WHEN {anchored} THEN 'locator' WHEN regexp_matches(s, '{cards.WARNING}') THEN 'warning'
  WHEN len(ws) >= 3 AND len(list_filter(ws, lambda w: w[1] = upper(w[1]))) * 10 >= len(ws) * 6 THEN 'title' WHEN coalesce(contains(around, s), false) THEN 'body' ELSE 'content' END AS pile FROM w"""


def _piles(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("note"), "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("around"))
    return cards.note_piles(c.select("note", "text"), c.select("note", F.col("around").alias("text")), findings.LOCATORS)


@query(_pile_sql())
def note_content_piles(spark, sf):
    return _piles(spark, sf)


@query(f"""
WITH p AS ({_pile_sql()}), n AS (SELECT note, count(*) FILTER (pile = 'content') AS c, count(*) FILTER (pile = 'body') AS b FROM p GROUP BY note)
SELECT note, CASE WHEN c > 0 AND b > 0 THEN 'MIXED' WHEN c > 0 THEN 'CARRIES CONTENT' WHEN b > 0 THEN 'REDUNDANT' ELSE 'CLEAN' END AS verdict FROM n""")
def note_verdicts(spark, sf):
    return workflow.verdict(_piles(spark, sf))


# ---- registers of chapters, files, words


@query("""
WITH l AS (SELECT l_suppkey AS chapter, l_orderkey * 10 + l_linenumber AS line_no, CASE l_returnflag WHEN 'A' THEN 'LOCKED' WHEN 'R' THEN 'UNLOCKED' ELSE 'DEFERRED' END AS state, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem),
d AS (SELECT chapter, max((date, line_no, state)) AS r FROM l GROUP BY chapter),
p AS (SELECT s_suppkey AS chapter, s_nationkey % 3 AS open FROM supplier WHERE s_suppkey % 4 > 0)
SELECT chapter, CASE WHEN r[3] = 'LOCKED' AND coalesce(open, 0) > 0 THEN 'UNLOCKED' ELSE coalesce(r[3], CASE WHEN coalesce(open, 0) > 0 THEN 'UNLOCKED' ELSE 'OUT OF SYNC' END) END AS status, coalesce(open, 0)::BIGINT AS open, CASE WHEN open IS NULL THEN 0 ELSE 3 END::BIGINT AS total
FROM d FULL JOIN p USING (chapter)""")
def chapter_locks(spark, sf):
    word = F.when(F.col("l_returnflag") == "A", "locked").when(F.col("l_returnflag") == "R", "UNLOCKED again").otherwise("Deferred, not locked")
    text = F.concat(word, F.lit(" ("), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" LOCKED)"))
    lines = _items(spark, sf).select(F.col("l_suppkey").alias("chapter"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), text.alias("text"))
    punch = table(spark, sf, "supplier").where("s_suppkey % 4 > 0").select(F.col("s_suppkey").alias("chapter"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), "s_nationkey")
    return workflow.reconciled(workflow.latest_declared(lines), punch.select("chapter", (F.col("i") >= F.col("s_nationkey") % 3).alias("done")))


@query("""
WITH b AS (SELECT l_orderkey AS block, list_sort(list(DISTINCT l_suppkey)) AS cards FROM lineitem GROUP BY 1) SELECT block, array_to_string(cards, ',') AS cards FROM b WHERE len(cards) > 1""")
def card_collisions(spark, sf):
    out = workflow.collisions(_items(spark, sf).select(F.col("l_orderkey").alias("block"), F.col("l_suppkey").alias("card")))
    return out.select("block", F.array_join(F.transform("cards", lambda c: c.cast("string")), ",").alias("cards"))


@query("""
WITH v AS (SELECT user_id % 40 AS card, event_id % 6 AS reviewer, CASE WHEN value > 30 THEN 'FAIL' ELSE 'PASS' END AS verdict, event_id FROM events WHERE event_type <> 'view'),
l AS (SELECT card, reviewer, max_by(verdict, event_id) AS v FROM v GROUP BY ALL)
SELECT card, CASE WHEN count(*) FILTER (v = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) >= 6 THEN 'PASS' ELSE 'PENDING' END AS result FROM l GROUP BY card""")
def reviewer_quorum(spark, sf):
    ev = _events(spark, sf).where("event_type <> 'view'")
    return workflow.quorum(ev.select((F.col("user_id") % 40).alias("card"), (F.col("event_id") % 6).alias("reviewer"), F.when(F.col("value") > 30, "FAIL").otherwise("PASS").alias("verdict"), F.col("event_id").alias("at")))


@query("""
WITH l AS (SELECT l_suppkey AS path, l_orderkey * 10000 + l_partkey AS ts, CASE l_returnflag WHEN 'A' THEN 'fail' WHEN 'R' THEN 'ok' ELSE 'start' END AS status FROM lineitem WHERE l_linenumber = 3),
o AS (SELECT path, max_by(status, ts) AS last, count(*) FILTER (status = 'fail') AS failures FROM l GROUP BY path)
SELECT s_suppkey AS path FROM supplier WHERE s_suppkey NOT IN (SELECT path FROM o WHERE last IN ('ok', 'skip', 'reject') OR failures >= 2)""")
def ocr_queue(spark, sf):
    status = F.when(F.col("l_returnflag") == "A", "fail").when(F.col("l_returnflag") == "R", "ok").otherwise("start")
    i = _items(spark, sf)
    row = lambda d, mode: d.select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("ts"), status.alias("status"), F.lit(mode).alias("mode"))
    ledger = row(i.where("l_linenumber = 3"), "ocr").unionByName(row(i.where("l_linenumber = 4"), "shrink"))
    return workflow.ocr_queue(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path")), ledger, "ocr")


@query("""
SELECT o_orderkey, (o_custkey % 3 = 0 OR o_orderkey % 2 = 0) AND CASE WHEN o_custkey % 200 < greatest(100, (o_orderkey % 9 + 1) * 15) THEN o_totalprice / 1000 >= greatest(100, (o_orderkey % 9 + 1) * 15) ELSE o_totalprice / 1000 * 100 >= (o_custkey % 200) * 98 END AS accepted FROM orders""")
def ocr_verification(spark, sf):
    pages = F.col("o_orderkey") % 9 + 1
    row = {"pages_before": pages, "pages_after": F.when((F.col("o_custkey") % 3 == 0) | (F.col("o_orderkey") % 2 == 0), pages).otherwise(pages + 1), "chars_before": F.col("o_custkey") % 200, "chars_after": F.col("o_totalprice") / 1000}
    return _orders(spark, sf).select("o_orderkey", workflow.ocr_accepts(row).alias("accepted"))


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'gone' WHEN b.doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS status
FROM (SELECT doc_id FROM documents WHERE doc_id % 5 > 0) a FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 6 > 0) b ON a.doc_id = b.doc_id""")
def snapshot_verified(spark, sf):
    tree = lambda keep, edit: _docs(spark, sf).where(keep).select(F.col("doc_id").alias("path"), F.concat("text", edit).cast("binary").alias("content"))
    return workflow.snapshot_check(tree("doc_id % 5 > 0", F.lit("")), tree("doc_id % 6 > 0", F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")))


@query(r"""
SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) = trim(regexp_replace(lower(CASE WHEN p_size % 3 = 0 THEN p_name || ' too' ELSE upper(p_name) || '!' END), '[^\p{L}\p{N}]+', ' ', 'g')) AS format_only FROM part""")
def format_only_change(spark, sf):
    after = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" too"))).otherwise(F.concat(F.upper("p_name"), F.lit("!")))
    return _parts(spark, sf).select("p_partkey", workflow.same_words(F.col("p_name"), after).alias("format_only"))


@query("""
WITH w AS (SELECT p_partkey AS sense, p_name AS lemma, p_size AS synset FROM part), m AS (SELECT DISTINCT synset FROM w WHERE lower(lemma) = 'small ring'),
r AS (SELECT s_suppkey % 50 AS source, CASE s_suppkey % 3 WHEN 0 THEN 'hypernym' WHEN 1 THEN 'instance_hypernym' ELSE 'hyponym' END AS reltype, s_nationkey AS target FROM supplier)
SELECT DISTINCT lemma, reltype FROM r JOIN m ON source = synset JOIN w ON target = w.synset WHERE reltype IN ('hypernym', 'instance_hypernym')""")
def word_relations(spark, sf):
    words = _parts(spark, sf).select(F.col("p_partkey").alias("sense"), F.col("p_name").alias("lemma"), F.col("p_size").alias("synset"))
    k = F.col("s_suppkey") % 3
    rel = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("source"), F.when(k == 0, "hypernym").when(k == 1, "instance_hypernym").otherwise("hyponym").alias("reltype"), F.col("s_nationkey").alias("target"))
    return lookups.related(words, rel, "Small Ring", "broader")


@query("""
WITH w AS (SELECT p_partkey AS sense, p_name AS lemma FROM part), r AS (SELECT o_orderkey % 2000 AS source, 'antonym' AS reltype, o_custkey AS target FROM orders WHERE o_orderkey % 5 = 0)
SELECT DISTINCT b.lemma FROM w a JOIN r ON source = a.sense JOIN w b ON target = b.sense WHERE lower(a.lemma) = 'small ring'""")
def word_antonyms(spark, sf):
    words = _parts(spark, sf).select(F.col("p_partkey").alias("sense"), F.col("p_name").alias("lemma"))
    rel = _orders(spark, sf).select((F.col("o_orderkey") % 2000).alias("source"), F.when(F.col("o_orderkey") % 5 == 0, "antonym").otherwise("pertainym").alias("reltype"), F.col("o_custkey").alias("target"))
    return lookups.antonyms(words, rel, "small ring")


@query("""
WITH w AS (SELECT p_name AS lemma, p_size AS synset, p_type AS pos FROM part), m AS (SELECT DISTINCT synset FROM w WHERE lower(lemma) = 'small ring' AND pos = 'SMALL'),
o AS (SELECT synset, array_to_string(list_sort(list(DISTINCT lemma))[1:12], ',') AS others FROM w WHERE synset IN (SELECT synset FROM m) AND lower(lemma) <> 'small ring' GROUP BY synset)
SELECT n AS id, 'x' AS pos, 'def ' || n AS definition, 'a' || n AS example, coalesce(others, '') AS others FROM (SELECT unnest(range(0, 60))::INTEGER AS n) JOIN m ON n = m.synset LEFT JOIN o ON n = o.synset""")
def word_senses(spark, sf):
    words = _parts(spark, sf).select(F.col("p_name").alias("lemma"), F.col("p_size").alias("synset"), F.col("p_type").alias("pos"))
    n = F.col("id").cast("string")
    synsets = _parts(spark, sf).select(F.col("p_size").alias("id")).distinct().select("id", F.lit("x").alias("pos"), F.concat(F.lit("def "), n).alias("definition"), F.concat(F.lit("a"), n, F.lit(" | b")).alias("examples"))
    return lookups.senses(words, synsets, "small ring", "SMALL").withColumn("others", F.array_join("others", ","))


@query("""
WITH d AS (SELECT o_custkey AS source, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS seq, o_orderpriority AS text FROM orders)
SELECT seq, text, seq = 5 AS is_target FROM d WHERE source = 7 AND seq BETWEEN 3 AND 7""")
def segment_neighbours(spark, sf):
    from pyspark.sql import Window

    d = _orders(spark, sf).select(F.col("o_custkey").alias("source"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("seq"), F.col("o_orderpriority").alias("text"))
    return lookups.segment_context(d, 7, 5, 2)


@query("""
WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'Genesis ' || l_linenumber || ':' || (l_suppkey % 40) AS ref, CASE l_returnflag WHEN 'A' THEN 'he' WHEN 'R' THEN 'ar' ELSE 'en' END AS lang, l_shipdate::VARCHAR AS body FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 40 = 3),
p AS (SELECT ref, lang, arg_max(body, id) AS body, min(id) AS first FROM b GROUP BY ALL)
SELECT ref, string_agg(lang || '=' || left(body, 10), ';' ORDER BY CASE lang WHEN 'he' THEN 1 WHEN 'ar' THEN 2 ELSE 3 END) AS bodies FROM p GROUP BY ref""")
def verse_in_languages(spark, sf):
    lang = F.when(F.col("l_returnflag") == "A", "he").when(F.col("l_returnflag") == "R", "ar").otherwise("en")
    ref = F.concat(F.lit("Genesis "), F.col("l_linenumber").cast("string"), F.lit(":"), (F.col("l_suppkey") % 40).cast("string"))
    d = _items(spark, sf).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ref.alias("ref"), lang.alias("lang"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("body"), F.lit("c").alias("corpus"))
    out = lookups.passage(d, "Genesis 1:3", most=1_000_000)
    return out.select("ref", F.array_join(F.transform(F.map_entries("bodies"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("bodies"))


@query("""
WITH e AS (SELECT p_partkey AS id, p_name AS headword, lower(p_name) AS plain, p_type AS definition FROM part)
SELECT id, headword FROM e WHERE plain = 'red bolt' ORDER BY length(headword), id LIMIT 10""")
def lexicon_lookup(spark, sf):
    e = _parts(spark, sf).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), F.lower("p_name").alias("headword_plain"), F.col("p_type").alias("definition"))
    return lookups.lexicon(e, "Red Bolt").select("id", "headword")


@query("""
SELECT p_partkey AS id FROM part WHERE p_partkey::VARCHAR = '12' OR p_brand = 'Brand#12' OR p_type || '.' || p_size = '12'""")
def by_identifier(spark, sf):
    d = _parts(spark, sf).select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("tm"), F.concat("p_type", F.lit("."), F.col("p_size").cast("string")).alias("hybrid"))
    return lookups.by_identifier(d, "12", "Brand#12").select(F.col("id").cast("bigint").alias("id"))
