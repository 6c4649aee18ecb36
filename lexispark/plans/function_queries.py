"""Queries that run the text functions over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.plans.registry import query, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _md5(c):
    return F.md5(c.cast("binary"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(lower(text), '''ʼ᾽᾿ʹ´`', '’’’’’’’'), '[^\p{L}\p{M}\p{N}\s’]+', ' ', 'g'), '\s+', ' ', 'g'))) AS norm_md5 FROM documents""")
def fn_audit_norm(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(tx.audit_norm(F.col("text"))).alias("norm_md5"))


@query("SELECT doc_id, md5(nfc_normalize(text || chr(769))) AS nfc_md5 FROM documents")
def fn_composed(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(tx.composed(F.concat("text", F.lit("́")))).alias("nfc_md5"))


_GREEK = "translate(lower(p_name), 'abgdezhqiklmncoprstufxyw', 'αβγδεζηθικλμνξοπρστυφχψω')"


@query(rf"""
WITH g AS (SELECT p_partkey, p_name, regexp_replace({_GREEK} || ' ', 'σ([^\p{{L}}])', 'ς\1', 'g') AS g FROM part)
SELECT p_partkey, left(g, length(p_name)) AS greek, translate(left(g, length(p_name)), 'αβγδεζηθικλμνξοπρστυφχψως', 'abgdezhqiklmncoprstufxyws') AS beta FROM g""")
def fn_beta_code(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", tx.from_beta(F.col("p_name")).alias("greek"))
    return rows.select("p_partkey", "greek", tx.to_beta(F.col("greek")).alias("beta"))


@query(r"""
SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<a\b[^>]*>.*?</a>', ' [cite] ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 4000) AS entry FROM pages""")
def fn_entry_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.entry_text(F.col("html"), "a", 4000).alias("entry"))


_SAFE = r"regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '" + tx._PROTECTED + r"', '\1\2․', 'g')"
_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace({_SAFE}, '([.!?]["”’)]*) ', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(replace(s, '․', '.'))), lambda s: s <> '')"""


@query(f"""
WITH s AS (SELECT conv_id, turn, {_SENTENCES} AS ss FROM conversations)
SELECT conv_id, turn, i::INTEGER AS sentence_no, ss[i] AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)""")
def fn_sentences(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("at", "sentence"))
    return rows.select("conv_id", "turn", (F.col("at") + 1).alias("sentence_no"), "sentence")


def _facts_sql():
    """Each kind is looked for in what the kinds before it left."""
    quoted = tx._QUOTED.replace("'", "''")
    steps, rest = [], f"regexp_replace(text, '{quoted}', ' | ', 'g')"
    title = "len(regexp_extract_all(q, '([A-Za-z]{4,})', 1)) >= 3 AND len(list_filter(regexp_extract_all(q, '([A-Za-z]{4,})', 1), lambda w: w[1] = upper(w[1]))) * 10 >= len(regexp_extract_all(q, '([A-Za-z]{4,})', 1)) * 6"
    steps.append(f"SELECT doc_id, CASE WHEN {title} THEN 'title' ELSE 'quotation' END AS kind, q AS what FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{quoted}', 1))) AS q FROM documents) WHERE len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) >= 3")
    for kind, pattern in tx.FACTS.items():
        p = pattern.replace("'", "''")
        steps.append(f"SELECT doc_id, '{kind}', unnest(list_distinct(regexp_extract_all({rest}, '{p}', 1))) FROM documents")
        rest = f"regexp_replace({rest}, '{p}', ' | ', 'g')"
    return " UNION ALL ".join(steps)


_FACTS = _facts_sql()


@query(_FACTS)
def fn_facts(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.explode_outer(tx.facts(F.col("text"))).alias("f")).where("f is not null")
    return rows.select("doc_id", "f.kind", "f.what")


_LONG = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}]+'), lambda w: length(w) > 3)"


@query(f"""
WITH l AS (SELECT conv_id, turn, {_LONG.format('text')} AS mine, {_LONG.format("lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn)")} AS other FROM conversations)
SELECT conv_id, turn, CASE WHEN len(mine) = 0 THEN 0.0 ELSE round(len(list_filter(mine, lambda w: list_contains(other, w))) / len(mine), 6) END AS share FROM l""")
def fn_word_share(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("before", F.lag("text", 1, "").over(w))
    return rows.select("conv_id", "turn", F.round(tx.word_share(F.col("text"), F.col("before")), 6).alias("share"))


@query(r"""
WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS k FROM part UNION SELECT 'paulus' UNION SELECT 'rhode'),
v AS (SELECT k, unnest([k] || list_filter([CASE WHEN k LIKE '%us' THEN k[:-3] || 'os' END, CASE WHEN k LIKE '%os' THEN k[:-3] || 'us' END, CASE WHEN k LIKE '%a' THEN k[:-2] || 'e' END,
  CASE WHEN k LIKE '%e' THEN k[:-2] || 'a' END, CASE WHEN k LIKE '%is' THEN k[:-3] || 'es' END, CASE WHEN k LIKE '%es' THEN k[:-3] || 'is' END,
  CASE WHEN k LIKE '%um' THEN k[:-3] || 'on' END, CASE WHEN k LIKE '%on' THEN k[:-3] || 'um' END], lambda x: x IS NOT NULL)) AS variant FROM w)
SELECT DISTINCT k AS key, variant FROM v""")
def fn_name_variants(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("key")).distinct()
    words = words.unionByName(spark.createDataFrame([("paulus",), ("rhode",)], "key string")).distinct()
    return words.select("key", F.explode(tx.name_variants(F.col("key"))).alias("variant"))


@query(r"""
WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '.grc1.xml' WHEN 1 THEN url || '-lat.txt' ELSE url END AS path FROM pages),
l AS (SELECT page_id, regexp_extract(lower(path), '[-._](grc|lat|eng|fra|deu|ger|ita)\d*\.[a-z]+$', 1) AS l FROM u)
SELECT page_id, CASE WHEN l = '' THEN 'eng' ELSE l END AS lang FROM l""")
def fn_file_language(spark, sf):
    end = F.when(F.col("page_id") % 3 == 0, ".grc1.xml").when(F.col("page_id") % 3 == 1, "-lat.txt").otherwise("")
    return table(spark, sf, "pages").select("page_id", tx.file_language(F.concat("url", end)).alias("lang"))


@query("""
WITH d AS (SELECT p_partkey, list_filter(range(1, p_size + 1), lambda d: p_size % d = 0) AS ds FROM part)
SELECT p_partkey, list_sort(list_transform(ds, lambda d: [abs(d - 8), d]))[1][2]::INTEGER AS divisor FROM d""")
def fn_nearest_divisor(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.nearest_divisor(F.col("p_size"), F.lit(8)).alias("divisor"))


@query("""
WITH t AS (SELECT doc_id, text, (doc_id % 40)::INTEGER AS o FROM documents), f AS (SELECT *, strpos(substr(lower(text), o + 1), 'the ') AS place FROM t)
SELECT doc_id, substr(text, o + 1, 200) AS plain, CASE WHEN place > 0 THEN substr(text, greatest(0, o + place - 1 - 30) + 1, 120) END AS found FROM f""")
def fn_window_text(spark, sf):
    at = (F.col("doc_id") % 40).cast("int")
    return _docs(spark, sf).select("doc_id", tx.window_text(F.col("text"), at, 200).alias("plain"), tx.window_text(F.col("text"), at, 120, "the ", 30).alias("found"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' OR lower(source) = 'src1'")
def fn_language_clause(spark, sf):
    code, name = tx.language_clause(F.col("source"), F.col("lang"), "de"), tx.language_clause(F.col("source"), F.col("lang"), "SRC1")
    return _docs(spark, sf).where(code | name).select("doc_id", "source")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_type), 'eco')")
def fn_like_filters(spark, sf):
    return table(spark, sf, "part").where(tx.like_any(F.col("p_name"), "RING") & tx.like_any(F.col("p_type"), "Eco")).select("p_partkey", "p_name")


@query(r"""
WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN '.bak' WHEN 1 THEN '~' WHEN 2 THEN '.backup-2' ELSE '.txt' END AS name FROM part)
SELECT p_partkey, name FROM n WHERE NOT regexp_matches(lower(name), '(\.bak|\.orig|\.old|~|\.tmp|\.backup[-.\w]*)$|^\.|conflicted copy')""")
def fn_backups_left_out(spark, sf):
    k = F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(k == 0, ".bak").when(k == 1, "~").when(k == 2, ".backup-2").otherwise(".txt"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).where(~tx.is_backup(F.col("name")))


@query(r"""
SELECT p_partkey, regexp_replace(translate(strip_accents(lower(p_brand || p_name)), 'vj', 'ui'), '[^a-z]', '', 'g') AS lexicon_key,
  CASE WHEN trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') END AS slug,
  'P' || lpad(p_partkey::VARCHAR, 6, '0') AS pnum, (p_size // 2 + 1) || CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS folio,
  least(1800.0, greatest(90.0, p_retailprice * 6.0 / 100, p_size * 0.5)) AS timeout FROM part""")
def fn_keys_and_numbers(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", tx.lexicon_key(F.concat("p_brand", "p_name")).alias("lexicon_key"), tx.slugify(F.col("p_name")).alias("slug"),
        tx.catalogue_number(F.col("p_partkey").cast("string")).alias("pnum"), tx.folio(F.col("p_size")).alias("folio"),
        tx.extraction_timeout(F.col("p_retailprice") / 100, F.col("p_size")).alias("timeout"),
    )


@query(r"SELECT doc_id, md5(regexp_replace(text || 'שָׁלוֹם سَلاَم', '[֑-ׇً-ْٰـ]', '', 'g')) AS bare_md5 FROM documents")
def fn_semitic_marks(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(tx.strip_semitic(F.concat("text", F.lit("שָׁלוֹם سَلاَم")))).alias("bare_md5"))


@query(r"""
WITH w AS (SELECT doc_id, '== ' || lang || ' ==' || chr(10) || '[[' || source || '|S]] {{x|{{y}}}} ''''''b'''''' <ref>r</ref>' || regexp_replace(text, '[^\p{L} ]', '', 'g') AS t FROM documents)
SELECT doc_id, trim(regexp_replace(coalesce(regexp_extract(t, '^== (.*?) ==', 1), '') || chr(10) || 'S b ' || ' ' || regexp_replace(text, '[^\p{L} ]', '', 'g'), '[ \t]+', ' ', 'g')) AS plain FROM w JOIN documents USING (doc_id)""")
def fn_wikitext(spark, sf):
    letters = F.regexp_replace("text", r"[^\p{L} ]", "")
    page = F.concat(F.lit("== "), "lang", F.lit(" ==\n[["), "source", F.lit("|S]] {{x|{{y}}}} '''b''' <ref>r</ref>"), letters)
    return _docs(spark, sf).select("doc_id", tx.wikitext(page).alias("plain"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, regexp_extract_all(line, '([A-Za-z]{4,})', 1) AS ws FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (len(ws) >= 3 AND len(list_filter(ws, lambda w: w[1] = upper(w[1]))) * 10 >= len(ws) * 6) AS n_titles FROM w GROUP BY doc_id""")
def fn_title_cased_lines(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(tx.is_title_cased(F.col("line"))).alias("n_titles"))


@query(r"""
WITH n AS (SELECT DISTINCT lower(p_name) AS b FROM part)
SELECT DISTINCT b AS term, unnest([b, replace(b, '-', ' '), replace(b, ' ', '-'), b || 's'] || list_filter([CASE WHEN b NOT LIKE '%s' THEN b || 'es' END, CASE WHEN b LIKE '%y' THEN b[:-2] || 'ies' END,
  CASE WHEN b LIKE '%man' THEN b[:-4] || 'men' END, CASE WHEN b LIKE '%s' THEN b[:-2] END], lambda v: v IS NOT NULL)) AS variant FROM n""")
def fn_term_variants(spark, sf):
    rows = table(spark, sf, "part").select(F.lower("p_name").alias("term")).distinct()
    return rows.select("term", F.explode(tx.term_variants(F.col("term"))).alias("variant"))


@query("""
WITH n AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS k FROM part)
SELECT k AS key, unnest(list_filter([left(k, length(k) - 1), left(k, length(k) - 2), left(k, length(k) - 3), left(k, length(k) - 4)], lambda s: length(s) >= 3)) AS stem FROM n""")
def fn_trimmed_stems(spark, sf):
    rows = table(spark, sf, "part").select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("key")).distinct()
    return rows.select("key", F.explode(tx.trimmed_stems(F.col("key"))).alias("stem"))


@query("""
SELECT l_orderkey, l_linenumber, l_linenumber::VARCHAR AS book, (l_suppkey % 30)::VARCHAR AS part, l_partkey::VARCHAR || 'a' AS first, (l_partkey + 3)::VARCHAR AS last,
  (l_suppkey % 30)::INTEGER AS chapter, l_linenumber AS verse, l_linenumber + 2 AS last_verse, '1 John' AS verse_book FROM lineitem""")
def fn_references(spark, sf):
    l = table(spark, sf, "lineitem")
    ref = F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 30).cast("string"), F.concat(F.col("l_partkey").cast("string"), F.lit("a-"), (F.col("l_partkey") + 3).cast("string")))
    verse = F.concat(F.lit("1 John "), (F.col("l_suppkey") % 30).cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit("–"), (F.col("l_linenumber") + 2).cast("string"))
    p, v = tx.passage_reference(ref), tx.verse_reference(verse)
    return l.select("l_orderkey", "l_linenumber", p["book"].alias("book"), p["part"].alias("part"), p["first"].alias("first"), p["last"].alias("last"), v["chapter"].alias("chapter"), v["verse"].alias("verse"), v["last"].alias("last_verse"), v["book"].alias("verse_book"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, 'Genesis ' || (l_suppkey % 15) || ':' || l_linenumber AS ref FROM lineitem)
SELECT l_orderkey, l_linenumber, ref FROM r WHERE ref = 'Genesis 1' OR starts_with(ref, 'Genesis 1:')""")
def fn_reference_filter(spark, sf):
    ref = F.concat(F.lit("Genesis "), (F.col("l_suppkey") % 15).cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref")).where(tx.reference_in(F.col("ref"), "Genesis 1"))


@query("""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' - ' ELSE 'x - ' END || p_name AS n FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN split_part(n, ' - ', 1) END AS author, CASE WHEN p_partkey % 2 = 0 THEN split_part(n, ' - ', 2) ELSE n END AS title FROM n""")
def fn_author_title(spark, sf):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(" - "))).otherwise(F.lit("x - ")), "p_name")
    rows = table(spark, sf, "part").select("p_partkey", tx.author_title(name).alias("a"))
    return rows.select("p_partkey", "a.author", "a.title")


@query("SELECT event_id, round_even(value * 10 - 300, 0)::INTEGER AS from_year, round_even(value, 0)::INTEGER AS to_year FROM events")
def fn_year_span(spark, sf):
    span = tx.year_span(F.concat_ws(",", (F.col("value") * 10 - 300).cast("string"), F.col("value").cast("string")))
    return table(spark, sf, "events").select("event_id", span["from"].alias("from_year"), span["to"].alias("to_year"))


@query(r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS lines_md5,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS raw_md5 FROM pages""")
def fn_strip_html_variants(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", _md5(tx.strip_html(h, entities=False, keep_lines=True)).alias("lines_md5"), _md5(tx.strip_html(h, entities=False)).alias("raw_md5"))


@query("""
SELECT doc_id, list_distinct_in_order AS firsts FROM (
  SELECT doc_id, list_transform(list_filter(range(1, len(ws) + 1), lambda i: list_position(ws, ws[i]) = i), lambda i: ws[i]) AS list_distinct_in_order
  FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))""")
def fn_ordered_distinct(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_distinct(F.split("text", " ")).alias("firsts"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 25")
def sample_by_hash(spark, sf):
    from lexispark.operators import shelf

    return shelf.sample(_docs(spark, sf), "doc_id", 25, 7).select("doc_id", "lang")
