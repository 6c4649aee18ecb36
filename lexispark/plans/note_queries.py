"""Queries over notes, quotations and tables kept by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark import store
from lexispark.functions import text as tx
from lexispark.operators import findings, partitioned, passages
from lexispark.plans.check_queries import _FAMILIES
from lexispark.plans.registry import query, table

_TAILS = " TODO: see again.", " It is a reliable study of its time.", " His study of trade shows it.", " His study of trade shows it, p. 12.", " This supports the text.", ""
_TAILED = "CASE (conv_id + turn) % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAILS)) + " END"


def _notes(spark, sf):
    k = (F.col("conv_id") + F.col("turn")) % len(_TAILS)
    tail = F.get(F.array(*[F.lit(t) for t in _TAILS]), k.cast("int"))
    text = F.concat(F.lit("[^n"), F.col("turn").cast("string"), F.lit("]: "), F.regexp_replace("text", r"\s+", " "), tail, F.when(F.col("turn") % 5 == 1, " See [^n0] and [^x].").otherwise(""))
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("book"), F.col("turn").alias("line_no"), text.alias("text"))


_NOTES = rf"""
WITH l AS (SELECT conv_id::VARCHAR AS book, turn AS line_no, '[^n' || turn || ']: ' || regexp_replace(text, '\s+', ' ', 'g') || {_TAILED} || CASE WHEN turn % 5 = 1 THEN ' See [^n0] and [^x].' ELSE '' END AS text FROM conversations)"""


@query(
    _NOTES
    + f"""
, k AS (SELECT *, CASE
{_FAMILIES}
  ELSE 'NO ANCHOR' END AS anchor FROM l),
f AS ("""
    + " UNION ALL ".join(f"SELECT book, line_no, '{name}' AS class FROM k WHERE regexp_matches(text, '{p}')" + (" AND anchor = 'NO ANCHOR'" if name in findings.PLACED else "") for name, p in findings.NOTE_TALK.items())
    + ") SELECT book || ':' || line_no AS place, class FROM f"
)
def footnote_talk(spark, sf):
    """Classes of talk in notes; a thesis with a place in the work stays."""
    return findings.note_talk(_notes(spark, sf)).select("place", "class")


@query(_NOTES + r""", x AS (SELECT book, line_no, unnest(regexp_extract_all(regexp_replace(text, '^\[\^([^\]]+)\]', ''), '\[\^([^\]]+)\]', 1)) AS slug FROM l)
SELECT book || ':' || line_no AS place, 'XREF' AS class, '[^' || slug || ']' AS what FROM x""")
def footnote_xrefs(spark, sf):
    return findings.notes_to_notes(_notes(spark, sf)).select("place", "class", "what")


@query("""
WITH c AS (SELECT o_custkey::VARCHAR AS book, o_orderkey AS n, 'Author' || chr((65 + o_orderkey % 3)::INTEGER) AS author, left('A History of ' || p_name || ' and ' || p_type, 28) AS title FROM orders JOIN part ON p_partkey = 1 + o_orderkey % 7)
SELECT book AS place, 'FULL-CITE x' || count(*) AS class, author || ', ' || title || ': ' || string_agg('n' || n, ', ' ORDER BY n) AS what FROM c GROUP BY book, author, title HAVING count(*) > 1""")
def footnote_full_citations(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    o = table(spark, sf, "orders").join(p, 1 + F.col("o_orderkey") % 7 == F.col("p_partkey"))
    n = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("[^n"), n, F.lit("]: J. Author"), F.chr((65 + F.col("o_orderkey") % 3).cast("int")), F.lit(", *A History of "), "p_name", F.lit(" and "), "p_type", F.lit("* (Press, 1900), p. "), n, F.lit("."))
    return findings.repeated_citations(o.select(F.col("o_custkey").cast("string").alias("book"), F.col("o_orderkey").alias("line_no"), text.alias("text"))).select("place", "class", "what")


_HALF = "(len(w) // 2)"


@query(rf"""
WITH d AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[\[\]^#]', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM d),
n AS (SELECT doc_id, t AS span, 'x' || CASE WHEN doc_id % 3 = 0 THEN repeat(' other', 90) ELSE ' ' || array_to_string(w[{_HALF} + 1 :], ' ') END AS note, len(w) - len(w) // 2 AS n_half FROM w WHERE len(w) >= 200),
s AS (SELECT doc_id, regexp_extract_all(lower(span), '([a-z0-9'']+)', 1) AS a, regexp_extract_all(lower('[^a]: ' || note), '([a-z0-9'']+)', 1) AS b FROM n),
g AS (SELECT doc_id, list_distinct([array_to_string(a[i : i + 5], ' ') FOR i IN range(1, len(a) - 4)]) AS ga, list_distinct([array_to_string(b[i : i + 5], ' ') FOR i IN range(1, len(b) - 4)]) AS gb FROM s),
v AS (SELECT doc_id, CASE WHEN len(ga) = 0 THEN 0.0 ELSE len(list_intersect(ga, gb)) / len(ga) END AS share FROM g)
SELECT doc_id::VARCHAR || ':1' AS place, 'DUPLICATE' AS class, round(share, 4) > 0.18 AS over FROM v WHERE share > 0.18""")
def footnote_restated(spark, sf):
    """Notes that repeat half of the text before their anchor, and others of which nothing is repeated."""
    t = F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), r"[\[\]^#]", "")
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"), F.split(t, " ").alias("w")).where(F.size("w") >= 200)
    half = F.floor(F.size("w") / 2).cast("int")
    note = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit(" other"), F.lit(90))).otherwise(F.concat(F.lit(" "), F.array_join(F.slice("w", half + 1, F.size("w")), " ")))
    rows = d.select(F.col("doc_id").cast("string").alias("book"), F.explode(F.array(F.struct(F.lit(1).alias("line_no"), F.concat("t", F.lit("[^a]")).alias("text")), F.struct(F.lit(2).alias("line_no"), F.concat(F.lit("[^a]: x"), note).alias("text")))).alias("l"))
    return findings.restated(rows.select("book", "l.line_no", "l.text")).select("place", "class", F.lit(True).alias("over"))


_VERSES = "SELECT p_partkey, 1 + p_partkey // 20 AS chapter, 1 + p_partkey % 20 AS verse, p_name || ' ' || p_type AS body, split_part(p_name, ' ', 1) AS word, p_size FROM part"


@query(f"""
WITH v AS ({_VERSES}), lex AS (SELECT DISTINCT word FROM v WHERE p_size % 2 = 0),
q AS (SELECT o_orderkey AS k, v.* FROM orders JOIN v ON o_custkey = p_partkey),
j AS (SELECT q.*, n.body AS next_body, lex.word IS NOT NULL AS known FROM q LEFT JOIN v AS n ON n.chapter = q.chapter AND n.verse = q.verse + 1 LEFT JOIN lex ON lower(lex.word) = lower(q.word))
SELECT k AS doc_id, CASE WHEN k % 7 <> 0 AND k % 11 = 0 THEN '«' || word || '»' ELSE '«' || body || '»' END AS quote,
  CASE WHEN k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 THEN NULL WHEN k % 5 = 0 THEN 'Genesis ' || chapter || ':' || (verse + 1) ELSE 'Genesis ' || chapter || ':' || verse END AS ref,
  CASE WHEN k % 7 = 0 THEN 'NO-REF' WHEN k % 11 = 0 THEN CASE WHEN known THEN 'LSJ-OK' ELSE 'LSJ-MISS' END WHEN k % 13 = 0 THEN 'NO-REF' WHEN k % 5 = 0 THEN
    CASE WHEN next_body IS NULL THEN 'MISMATCH' WHEN contains(lower(next_body), lower(body)) THEN 'MATCH' ELSE 'CITATION-PRECISION' END ELSE 'MATCH' END AS status FROM j""")
def quote_audit(spark, sf):
    """Quotations with the right place, the next one, none, one too far off, or a false one that is nearer, of a chapter that no table has; and terms."""
    p = table(spark, sf, "part")
    at = lambda n: (1 + F.floor(F.col("p_partkey") / 20)).cast("int") if n == "chapter" else (1 + F.col("p_partkey") % 20).cast("int")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    v = p.select("p_partkey", F.lit("Genesis").alias("book"), at("chapter").alias("chapter"), at("verse").alias("verse"), F.concat("p_name", F.lit(" "), "p_type").alias("body"), word.alias("word"), "p_size")
    k = F.col("o_orderkey")
    place = lambda n: F.concat(F.lit("Genesis "), F.col("chapter").cast("string"), F.lit(":"), (F.col("verse") + n).cast("string"))
    said = F.concat(F.lit("«"), "body", F.lit("»"))
    text = F.when(k % 7 == 0, said).when(k % 11 == 0, F.concat(F.lit("The word «"), "word", F.lit("» (Genesis 1:1)"))).when(k % 13 == 0, F.concat(said, F.repeat(F.lit(" and on"), F.lit(60)), place(0)))
    text = text.when(k % 5 == 0, F.concat(said, F.lit(" ("), place(1), F.lit(")"))).when(k % 3 == 0, F.concat(F.lit("Against Genesis 0:1, "), said, F.lit(" stands in "), place(0))).otherwise(F.concat(said, F.lit(" ("), place(0), F.lit(")")))
    docs = table(spark, sf, "orders").join(v, F.col("o_custkey") == F.col("p_partkey")).select(k.alias("doc_id"), text.alias("text"))
    return passages.quote_audit(docs, v, v.where("p_size % 2 = 0"), "«[^»]+»").select("doc_id", "quote", "ref", "status")


@query("""
WITH w AS (SELECT p_brand AS author, bool_or(p_size % 25 = 0) AS changed, count(*) AS n FROM part GROUP BY p_brand)
SELECT author, n AS n_rows, CASE WHEN author = (SELECT min(p_brand) FROM part) THEN 'added' WHEN changed THEN 'changed' ELSE 'same' END AS status FROM w""")
def author_reindex(spark, sf):
    """A table by author brought up to date: only authors whose rows differ are written again."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("author"), "p_partkey", "p_name", "p_size")
    first = p.agg(F.min("author").alias("least"))
    old = p.join(F.broadcast(first), F.col("author") != F.col("least")).drop("least").withColumn("p_name", F.when(F.col("p_size") % 25 == 0, "old").otherwise(F.col("p_name")))
    kept = partitioned.KeyedTable(spark, store.folder(spark), "author")
    kept.update(old.unionByName(p.limit(1).withColumn("author", F.lit("gone"))))
    plan = store.written(kept.plan(p))
    kept.update(p)
    n = kept.read().groupBy("author").agg(F.count(F.lit(1)).alias("n_rows"))
    return n.join(plan, "author").select("author", "n_rows", "status")
