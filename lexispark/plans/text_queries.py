"""Queries over documents and pages: cleaning, chunks, full-text search, duplicates, language votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispark import store
from lexispark.functions import text as tx
from lexispark.operators import chunks, fulltext, impacts, segments, stems, trigrams
from lexispark.plans.registry import query, table

TOKENS = r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS clean, length(text) AS n_chars FROM documents")
def sanitize_control_chars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.sanitize(F.col("text")).alias("clean"), F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT doc_id, md5(translate(strip_accents(lower(text)), 'vj', 'ui')) AS folded_md5 FROM documents")
def fold_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.fold(F.col("text"), latin=True).cast("binary")).alias("folded_md5"))


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS plain
FROM pages""")
def html_strip_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_html(F.col("html")).alias("plain"))


@query(r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g'),
  '\b(the|a|an|of|and|in|on|to|for|its|his|her|their)\b', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM part""")
def title_norm(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.title_norm(F.col("p_name")).alias("title"))


@query(r"""
SELECT doc_id, left(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 16) AS hash, left(sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))), 10) AS fingerprint
FROM documents""")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"), tx.fingerprint(F.col("text")).alias("fingerprint"))


_CHUNKS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
c AS (SELECT doc_id, ws, len(range(0, len(ws), 160)) AS total_chunks, unnest(range(0, len(ws), 160)) AS i FROM w)
SELECT doc_id, (i // 160)::INTEGER AS chunk_idx, total_chunks::INTEGER AS total_chunks, len(ws[i + 1:i + 200])::INTEGER AS chunk_words, array_to_string(ws[i + 1:i + 200], ' ') AS chunk FROM c"""


@query(f"SELECT doc_id, chunk_idx, total_chunks, chunk_words, md5(chunk) AS chunk_md5 FROM ({_CHUNKS})")
def chunk_words_200_40(spark, sf):
    rows = chunks.chunk(table(spark, sf, "documents"))
    return rows.select("doc_id", "chunk_idx", "total_chunks", "chunk_words", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query(f"SELECT doc_id, chunk_idx, CASE WHEN length(chunk) > 200 THEN substr(chunk, 1, 200) || '...' ELSE chunk END AS preview FROM ({_CHUNKS})")
def chunk_preview(spark, sf):
    return chunks.chunk(table(spark, sf, "documents")).select("doc_id", "chunk_idx", tx.preview(F.col("chunk")).alias("preview"))


@query(f"SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, sum(chunk_words)::BIGINT AS n_words FROM ({_CHUNKS}) JOIN documents USING (doc_id) GROUP BY source")
def chunks_per_source(spark, sf):
    docs = table(spark, sf, "documents")
    per_doc = docs.select("source", tx.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    parts = per_doc.select("source", F.transform(tx.windows(F.col("ws"), 200, 160), lambda x: F.size(x)).alias("sizes"))
    return parts.groupBy("source").agg(
        F.sum(F.size("sizes")).alias("n_chunks"), F.count(F.lit(1)).alias("n_docs"), F.sum(F.aggregate("sizes", F.lit(0), lambda a, x: a + x)).alias("n_words")
    )


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
c AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 180], ' ') AS segment FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 180)) AS i FROM w))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS seq, md5(segment) AS segment_md5, length(segment)::INTEGER AS n_chars FROM c WHERE length(segment) >= 40""")
def chunk_segments_180(spark, sf):
    rows = chunks.segments(table(spark, sf, "documents"))
    return rows.select("doc_id", "seq", F.md5(F.col("segment").cast("binary")).alias("segment_md5"), F.length("segment").alias("n_chars"))


@query(r"""
WITH p AS (SELECT doc_id, string_split_regex(text, '\n') AS ps FROM documents),
e AS (SELECT doc_id, i, trim(regexp_replace(ps[i], '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p))
SELECT doc_id, i::INTEGER AS line_no, length(line)::INTEGER AS n_chars, left(sha1(line), 10) AS fingerprint FROM e WHERE length(line) > 40""")
def long_lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    rows = rows.select("doc_id", (F.col("at") + 1).alias("line_no"), tx.collapse(F.col("raw")).alias("line")).where(F.length("line") > 40)
    return rows.select("doc_id", "line_no", F.length("line").alias("n_chars"), tx.fingerprint(F.col("line")).alias("fingerprint"))


@query(f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), f AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM f GROUP BY term""")
def fts_terms_df(spark, sf):
    return _index(spark, sf).term_counts()


@query(f"""
WITH t AS (SELECT doc_id, {TOKENS} AS ts FROM documents), e AS (SELECT doc_id, ts[i] AS term, i - 1 AS p FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM t))
SELECT term, doc_id, count(*)::INTEGER AS tf, min(p)::INTEGER AS first_position FROM e GROUP BY term, doc_id""")
def fts_postings_long_terms(spark, sf):
    """The first place of every term: terms of all lengths, from the positions of the postings."""
    return fulltext.postings(table(spark, sf, "documents")).select("term", "doc_id", "tf", F.get("positions", F.lit(0)).alias("first_position"))


@query(f"""
WITH t AS (SELECT doc_id, {TOKENS} AS ts FROM documents), e AS (SELECT doc_id, ts[i] AS term, i - 1 AS p FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM t))
SELECT term, doc_id, count(*)::INTEGER AS tf, string_agg(p::VARCHAR, ',' ORDER BY p) AS positions FROM e GROUP BY term, doc_id""")
def fts_postings(spark, sf):
    rows = fulltext.postings(table(spark, sf, "documents"))
    return rows.withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


def _index(spark, sf) -> fulltext.Index:
    """The index of the documents, built by the first search."""
    return store.once(spark, "documents", f"{sf}/documents.parquet", lambda path: fulltext.build_index(table(spark, sf, "documents"), path, keep=("lang", "source")))


def _equals(word: str):
    return lambda t: t == word


def _among(words: str):
    return lambda t: t.isin(sorted(set(words.split())))


def _bm25(counts: list[str], where: str = "true") -> str:
    tf = ", ".join(f"{c} AS tf{i}" for i, c in enumerate(counts))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(counts)))
    score = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * len_ / mean_len))" for i in range(len(counts)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(counts)))
    return f"""
WITH t AS (SELECT doc_id, lang, {TOKENS} AS ts FROM documents),
c AS (SELECT doc_id, lang, len(ts) AS len_, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(len_) AS mean_len, {df} FROM c)
SELECT doc_id, round({score}, 6) AS score FROM c, s WHERE {every} AND {where}"""


_TERM = "len(list_filter(ts, lambda t: t = '{}'))"
_PREFIX = "len(list_filter(ts, lambda t: starts_with(t, '{}')))"


@query(_bm25([_TERM.format("and"), _TERM.format("that")]))
def fts_bm25_and(spark, sf):
    return _index(spark, sf).search(fulltext.parse("and that")).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25([_PREFIX.format("thing"), _PREFIX.format("on")]))
def fts_prefix_and(spark, sf):
    return _index(spark, sf).search(fulltext.parse("thing on", "prefix")).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25(["len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the'))"]))
def fts_phrase(spark, sf):
    return _index(spark, sf).search(fulltext.parse("of the", "phrase")).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25([_TERM.format("de")], "lang = 'fr'"))
def fts_filtered_by_lang(spark, sf):
    return _index(spark, sf).search([("term", "de")], where=F.lower("lang") == "fr").select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25([_TERM.format("the"), _PREFIX.format("th"), "len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'in' AND ts[i + 1] = 'the'))"]))
def fts_scan_mixed_clauses(spark, sf):
    clauses = [*fulltext.parse('the th* "in the"')]
    return fulltext.search(table(spark, sf, "documents"), clauses).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25(["len(list_filter(range(1, len(ts) - 1), lambda i: ts[i] = 'in' AND ts[i + 1] = 'the' AND ts[i + 2] = 'and'))", _TERM.format("on")]))
def fts_quoted_and_index(spark, sf):
    return _index(spark, sf).search(fulltext.parse('"in the and" on')).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25([_TERM.format("the"), _TERM.format("by")]))
def fts_plain_operators_dropped(spark, sf):
    return _index(spark, sf).search(fulltext.parse('+the "by"*', "plain")).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25([_TERM.format("the")]) + " ORDER BY 2 DESC, 1 LIMIT 10")
def fts_topk(spark, sf):
    hits = _index(spark, sf).search([("term", "the")]).select("doc_id", F.round("score", 6).alias("score"))
    return hits.orderBy(F.desc("score"), "doc_id").limit(10)


@query(_bm25([_TERM.format("and"), _TERM.format("that")]))
def fts_segmented_updates(spark, sf):
    """The ranking of `fts_bm25_and` from an index that has seen every kind of update: an old state, a sync, batches of a stream, removals, a merge."""
    return _updated(spark, sf).search(fulltext.parse("and that")).select("doc_id", F.round("score", 6).alias("score"))


def _updated(spark, sf) -> segments.SegmentedIndex:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kind = F.pmod("doc_id", F.lit(4))
    old = docs.where(kind != 0).select("doc_id", F.when(kind == 1, F.concat("text", F.lit(" and that"))).otherwise(F.col("text")).alias("text"))
    gone = docs.where(kind == 2).select((F.col("doc_id") + 10**9).alias("doc_id"), "text")

    def make(path):
        index = segments.SegmentedIndex(spark, path)
        index.update(old)
        index.update(gone)
        index.sync(docs)
        index.remove(docs.where(kind == 3).select("doc_id"))
        index.update(docs.where(kind == 3))
        index.merge(index.head()[1][:2])
        return index

    return store.once(spark, "segmented", f"{sf}/documents.parquet", make)


@query("""
SELECT CASE WHEN doc_id % 4 = 0 THEN 'added' WHEN doc_id % 4 = 1 THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM documents GROUP BY 1
UNION ALL SELECT 'removed', n FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 4 = 2) WHERE n > 0""")
def fts_sync_report(spark, sf):
    """A dry run: what bringing an old index up to date would do. Nothing is written to the index."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kind = F.pmod("doc_id", F.lit(4))

    def make(path):
        index = segments.SegmentedIndex(spark, path)
        index.update(docs.where(kind != 0).select("doc_id", F.when(kind == 1, F.concat("text", F.lit(" and that"))).otherwise(F.col("text")).alias("text")))
        index.update(docs.where(kind == 2).select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))
        return index

    old = store.once(spark, "outdated", f"{sf}/documents.parquet", make)
    return old.diff(docs).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _trigrams(spark, sf) -> trigrams.TrigramIndex:
    return store.once(spark, "trigrams", f"{sf}/documents.parquet", lambda path: trigrams.build(table(spark, sf, "documents"), path))


@query("""
WITH f AS (SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents)
SELECT doc_id, (strpos(folded, 'api_key') > 0) AS found FROM f WHERE contains(folded, 'api_key')""")
def fts_trigram_substring(spark, sf):
    hits = _trigrams(spark, sf).containing(table(spark, sf, "documents"), "API_Key")
    return hits.select("doc_id", F.lit(True).alias("found"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?:https?://|www\.)[a-z]+\.(?:com|org|net|example)|[0-9]+ [A-Z][a-z]+ Street'))::INTEGER AS n FROM documents
WHERE regexp_matches(text, '(?:https?://|www\.)[a-z]+\.(?:com|org|net|example)|[0-9]+ [A-Z][a-z]+ Street')""")
def fts_trigram_regex(spark, sf):
    pattern = r"(?:https?://|www\.)[a-z]+\.(?:com|org|net|example)|[0-9]+ [A-Z][a-z]+ Street"
    hits = _trigrams(spark, sf).matching(table(spark, sf, "documents"), pattern)
    return hits.select("doc_id", F.regexp_count("text", F.lit(pattern)).alias("n"))


def _impacts(spark, sf) -> impacts.ImpactIndex:
    return store.once(spark, "impacts", f"{sf}/documents.parquet", lambda path: impacts.build(_index(spark, sf), path))


@query(_bm25([_TERM.format("der"), _TERM.format("und")]) + " ORDER BY 2 DESC, 1 LIMIT 10")
def fts_topk_bounded(spark, sf):
    """The first ten of a ranking, from the ranges of documents that can hold them."""
    return _impacts(spark, sf).top(["der", "und"], 10).select("doc_id", F.round("score", 6).alias("score"))


def _stems(spark, sf) -> fulltext.Index:
    return store.once(spark, "stems", f"{sf}/documents.parquet", lambda path: stems.build_stemmed(_index(spark, sf), path))


@query(_bm25(["len(list_filter(ts, lambda t: regexp_full_match(t, 'thing(e|s|es|ed|ing|ings)?')))", "len(list_filter(ts, lambda t: t IN ('the', 'thes')))"]))
def fts_stemmed_and(spark, sf):
    """A search by stems; the words of the test tables with these stems are those that the SQL names."""
    return _stems(spark, sf).search(stems.stemmed(fulltext.parse("things the"))).select("doc_id", F.round("score", 6).alias("score"))


@query("""
WITH f AS (SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents)
SELECT doc_id, strpos(folded, 'token')::INTEGER AS at, substr(folded, greatest(1, strpos(folded, 'token') - 80), strpos(folded, 'token') - greatest(1, strpos(folded, 'token') - 80) + 85) AS snippet
FROM f WHERE contains(folded, 'token')""")
def fts_substring_context(spark, sf):
    return fulltext.substring(table(spark, sf, "documents"), "token", 80)


@query(r"SELECT count(*) AS n_match, count(DISTINCT source) AS n_sources FROM documents WHERE regexp_matches(text, '(?i)of\s+the')")
def fts_match_total(spark, sf):
    hits = table(spark, sf, "documents").where(F.col("text").rlike(fulltext.phrase_pattern("of the")))
    return hits.agg(F.count(F.lit(1)).alias("n_match"), F.count_distinct("source").alias("n_sources"))


_NEAR = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q0 AS (SELECT v AS q FROM e WHERE vec_id = 0),
near AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v)), 9) DESC, vec_id) AS rank FROM e, q0)"""


@query(f"""
WITH s AS ({_bm25([_TERM.format("and"), _TERM.format("that")])}),
{_NEAR.strip()},
words AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT doc_id, rank FROM words WHERE rank <= 100 UNION ALL SELECT doc_id, rank FROM near WHERE rank <= 100) GROUP BY doc_id""")
def hybrid_rrf(spark, sf):
    """Ranks by words (BM25) and by vectors, fused; a document's vector is the one of its id."""
    from lexispark.operators import vectors

    words = _index(spark, sf).search(fulltext.parse("and that")).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(100)
    words = words.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # a hundred rows
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = vectors.search(e, asked, 100).select(F.col("vec_id").alias("doc_id"), "rank")
    return fulltext.fuse([words, near], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""
WITH s AS ({_bm25([_TERM.format("and"), _TERM.format("that")])}),
{_NEAR.strip()}
SELECT 'names' AS surface, true AS ran, doc_id FROM documents WHERE contains(lower(source), '1') UNION ALL
SELECT 'text', true, doc_id FROM s UNION ALL
SELECT 'cache', true, doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'and that') UNION ALL
SELECT 'vectors', true, doc_id FROM near WHERE rank <= 10 UNION ALL SELECT 'offline', false, NULL""")
def search_surfaces(spark, sf):
    """One question to names, ranked text, cached text and vectors; a surface that did not run says so."""
    from lexispark.operators import vectors

    docs, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    asked = e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    parts = {
        "names": docs.where(F.lower("source").contains("1")),
        "text": _index(spark, sf).search(fulltext.parse("and that")),
        "cache": _trigrams(spark, sf).containing(docs, "and that"),
        "vectors": vectors.search(e, asked, 10).select(F.col("vec_id").alias("doc_id")),
        "offline": None,
    }
    return fulltext.surfaces(parts, "doc_id")


_STOP_SQL = ", ".join("('{}', {}, [{}])".format(k, i, ", ".join(f"'{w}'" for w in sorted(set(v.split())))) for i, (k, v) in enumerate(tx.STOPWORDS.items()))


@query(rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: length(x) >= 2) AS ws FROM documents),
s(lang, ord, stop) AS (VALUES {_STOP_SQL}),
c AS (SELECT doc_id, lang, ord, len(ws) AS total, len(list_filter(ws, lambda x: list_contains(stop, x))) AS hits FROM w, s)
SELECT doc_id, CASE WHEN any_value(total) < 60 THEN 'eng' ELSE max_by(lang, hits * 10 - ord) END AS voted,
  CASE WHEN any_value(total) < 60 THEN 0.0 ELSE round(max(hits) / any_value(total), 6) END AS share
FROM c GROUP BY doc_id""")
def lang_vote_stopwords(spark, sf):
    ws = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 2)
    rows = table(spark, sf, "documents").select("doc_id", ws.alias("ws"))
    hits = [F.size(F.filter("ws", _among(v))).alias(k) for k, v in tx.STOPWORDS.items()]
    rows = rows.select("doc_id", F.size("ws").alias("total"), *hits)
    ranked = F.array_max(F.array(*[F.struct(F.col(k).alias("hits"), F.lit(-i).alias("turn"), F.lit(k).alias("lang")) for i, k in enumerate(tx.STOPWORDS)]))
    few = F.col("total") < 60
    return rows.withColumn("best", ranked).select(
        "doc_id", F.when(few, "eng").otherwise(F.col("best.lang")).alias("voted"), F.when(few, 0.0).otherwise(F.round(F.col("best.hits") / F.col("total"), 6)).alias("share")
    )


@query(r"""
WITH h AS (SELECT doc_id, left(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 16) AS hash FROM documents)
SELECT hash, min(doc_id) AS first_id, count(*) AS n FROM h GROUP BY hash HAVING count(*) > 1""")
def dup_docs_exact(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


_SIX = r"""
WITH w AS (SELECT {0} AS id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ws FROM {1}),
s AS (SELECT DISTINCT id, array_to_string(ws[i:i + 5], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 6))"""


#: Shingles (three numbers each) that are broadcast; more are joined by a shuffle.
SENT_SHINGLES = 1_000_000


def _six(rows, key):
    """Hashes of six-word shingles. To be exploded with explode_outer: for explode, Spark derives a size filter and pushes the whole expression below."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9']+)"), F.lit(1))
    return rows.select(key, tx.shingle_hashes(ws, 6).alias("gs"))


@query(_SIX.format("doc_id", "documents") + """
, h AS (SELECT g, min(id) AS first_id, count(*) AS holders FROM s GROUP BY g)
SELECT s.id AS doc_id, count(*) AS n_shingles, count(*) FILTER (holders > 1) AS n_shared, count(*) FILTER (first_id < s.id) AS n_seen_before FROM s JOIN h USING (g) GROUP BY s.id""")
def dup_docs_shingle6(spark, sf):
    path = store.folder(spark)
    _six(table(spark, sf, "documents"), "doc_id").write.parquet(path)  # read three times below
    sets = spark.read.parquet(path).where(F.size("gs") > 0)
    rows = sets.select("doc_id", F.explode_outer("gs").alias("g"))
    # a task sends each shingle's least holder and number once; only shingles with several holders come back
    shared = rows.groupBy("g").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("holders")).where("holders > 1").select("g", "first_id")
    hits = rows.join(shared, "g").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("first_id") < F.col("doc_id")).alias("n_seen_before"))
    out = sets.select("doc_id", F.size("gs").cast("bigint").alias("n_shingles")).join(hits, "doc_id", "left")
    return out.select("doc_id", "n_shingles", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_shared", "n_seen_before")])


@query(_SIX.format("doc_id", "documents") + r"""
, bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 5], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 4)) AS i FROM bw WHERE len(ws) >= 6))
SELECT item_id, s.id AS doc_id, count(*) AS shared, round(count(*) / any_value(n), 6) AS containment
FROM b JOIN s USING (g) JOIN (SELECT item_id, count(*) AS n FROM b GROUP BY item_id) USING (item_id) GROUP BY item_id, s.id HAVING count(*) * 2 >= any_value(n)""")
def benchmark_containment(spark, sf):
    items = _six(table(spark, sf, "benchmark"), "item_id").select("item_id", F.size("gs").alias("n"), F.explode_outer("gs").alias("g")).where("g is not null")
    rows = _six(table(spark, sf, "documents"), "doc_id").select("doc_id", F.explode_outer("gs").alias("g")).where("g is not null")
    items = store.written(items)
    # a benchmark's shingles are sent to the documents where they are few enough for that
    items = F.broadcast(items) if items.count() <= SENT_SHINGLES else items
    hits = rows.join(items, "g").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n")).where("shared * 2 >= n")
    return hits.select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))
