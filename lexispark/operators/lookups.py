"""Lookups of corpus stores: places, verses, lexicon entries, word relations, dictionary senses, catalogue records."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import fulltext, relational

#: Names that users give to word relations.
RELATIONS = {"broader": ["hypernym", "instance_hypernym"], "narrower": ["hyponym", "instance_hyponym"], "part": ["mero_part", "mero_member", "mero_substance"], "whole": ["holo_part", "holo_member", "holo_substance"], "like": ["similar"]}
#: The order in which a passage's languages are shown.
LANG_ORDER = ("he", "ar", "en")


def place(places: DataFrame, title: str) -> DataFrame:
    """The place of that title: as written but for case, else the shortest title that begins so, else the best by its words."""
    low = title.lower()
    exact = places.where(F.lower("title") == low)
    prefix = places.where(F.lower("title").startswith(low))
    hits = fulltext.search(places, fulltext.parse(title, "prefix"), 1, "pid", "description").select("pid")
    parts = [exact, prefix.orderBy(F.length("title"), "pid").limit(1), places.join(hits, "pid", "left_semi")]
    found = relational.tiers([p.withColumn("one", F.lit(1)) for p in parts], ["one"])
    return found.orderBy("tier", F.length("title"), "pid").limit(1).drop("one", "tier")


def passage(docs: DataFrame, ref: str, lang: str | None = None, corpus: str | None = None, most: int = 400) -> DataFrame:
    """ref, bodies (map from language to body, the last row of a language) of a verse or a whole chapter."""
    rows = docs.where(tx.reference_in(F.col("ref"), ref))
    if lang:
        rows = rows.where(F.lower("lang") == lang.lower())
    if corpus:
        rows = rows.where(F.lower("corpus") == corpus.lower())
    rows = rows.orderBy("id").limit(most)
    per = rows.groupBy("ref", "lang").agg(F.max(F.struct("id", "body")).alias("last"), F.min("id").alias("first"))
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in LANG_ORDER]), F.col("lang")), F.lit(0)), F.lit(99))
    grouped = per.groupBy("ref").agg(F.min("first").alias("at"), F.array_sort(F.collect_list(F.struct(order.alias("o"), "lang", F.col("last.body").alias("body")))).alias("bs"))
    return grouped.select("at", "ref", F.map_from_entries(F.transform("bs", lambda b: F.struct(b["lang"], b["body"]))).alias("bodies")).orderBy("at").drop("at")


def lexicon(entries: DataFrame, word: str, n: int = 10) -> DataFrame:
    """Entries whose plain headword is the word, else begins with it, else whose definition has it; shortest headwords first."""
    plain = tx.strip_semitic(F.lower(F.lit(word)))
    exact = entries.where(F.lower("headword_plain") == plain)
    prefix = entries.where(F.lower("headword_plain").startswith(plain))
    hits = fulltext.search(entries, fulltext.parse(word, "plain"), n, "id", "definition").select("id")
    parts = [p.withColumn("one", F.lit(1)) for p in (exact, prefix, entries.join(hits, "id", "left_semi"))]
    found = relational.tiers(parts, ["one"])
    return found.orderBy(F.length("headword"), "id").limit(n).drop("one")


def dictionary(entries: DataFrame, word: str, n: int = 5, most_chars: int = 3000) -> DataFrame:
    """Entries by normalised key: exact, beginning so, then with 1 to 4 final letters taken off, the longest stem first."""
    key = tx.lexicon_key(F.lit(word))
    stems = tx.trimmed_stems(key)
    exact, prefix = entries.where(F.col("norm") == key), entries.where(F.col("norm").startswith(key))
    cut = entries.where(F.array_contains(stems, F.col("norm")))
    longest = cut.agg(F.max(F.length("norm")).alias("longest"))  # one row
    cut = cut.join(F.broadcast(longest), F.length("norm") == F.col("longest")).drop("longest")
    found = relational.tiers([p.withColumn("one", F.lit(1)) for p in (exact, prefix, cut)], ["one"])
    return found.orderBy(F.length("headword"), "key").limit(n).withColumn("text", F.substring("text", 1, most_chars)).drop("one")


def senses(words: DataFrame, synsets: DataFrame, lemma: str, pos: str | None = None) -> DataFrame:
    """synset, pos, definition, example, others: the senses of a word and up to 12 other words of each."""
    mine = words.where(F.lower("lemma") == lemma.lower())
    if pos:
        mine = mine.where(F.col("pos").isin(["a", "s"] if pos in ("a", "adj") else [pos]))
    mine = mine.select("synset").distinct()
    others = words.join(mine, "synset", "left_semi").where(F.lower("lemma") != lemma.lower()).groupBy("synset").agg(F.slice(F.array_sort(F.collect_set("lemma")), 1, 12).alias("others"))
    rows = synsets.join(mine, synsets["id"] == mine["synset"], "left_semi").join(others, synsets["id"] == others["synset"], "left")
    return rows.select("id", "pos", "definition", F.split_part("examples", F.lit(" | "), F.lit(1)).alias("example"), F.coalesce("others", F.array().cast("array<string>")).alias("others"))


def related(words: DataFrame, relations: DataFrame, lemma: str, name: str) -> DataFrame:
    """lemma, reltype: words one relation away; relations has source, reltype, target of synsets."""
    kinds = RELATIONS.get(name, [name])
    mine = words.where(F.lower("lemma") == lemma.lower()).select("synset").distinct()
    hop = relations.where(F.col("reltype").isin(kinds)).join(mine, relations["source"] == mine["synset"], "left_semi")
    return hop.join(words, hop["target"] == words["synset"]).select("lemma", "reltype").distinct()


def antonyms(words: DataFrame, sense_relations: DataFrame, lemma: str) -> DataFrame:
    mine = words.where(F.lower("lemma") == lemma.lower()).select("sense")
    hop = sense_relations.where("reltype = 'antonym'").join(mine, sense_relations["source"] == mine["sense"], "left_semi")
    return hop.join(words, hop["target"] == words["sense"]).select("lemma").distinct()


def numbered_senses(entries: DataFrame, word: str) -> DataFrame:
    """lang, pos, sense_no, gloss, tags, examples of a word; senses without a gloss are not numbered."""
    rows = entries.where(F.col("word") == word).select("lang", "pos", "senses")
    gloss = lambda s: F.array_join(F.coalesce(s["glosses"], s["raw_glosses"]), "; ")
    kept = F.filter("senses", lambda s: gloss(s) != "")
    one = rows.select("lang", "pos", F.posexplode(kept).alias("at", "s"))
    return one.select("lang", "pos", (F.col("at") + 1).alias("sense_no"), gloss(F.col("s")).alias("gloss"), F.col("s.tags").alias("tags"), F.slice(F.coalesce("s.examples", F.array().cast("array<string>")), 1, 2).alias("examples"))


def segment_context(docs: DataFrame, source: str, seq: int, around: int = 1) -> DataFrame:
    """seq, text, is_target of a segment and its neighbours."""
    rows = docs.where((F.col("source") == source) & F.col("seq").between(seq - around, seq + around))
    return rows.select("seq", "text", (F.col("seq") == seq).alias("is_target")).orderBy("seq")


def record(docs: DataFrame, number: str) -> DataFrame:
    return docs.where(F.col("pnum") == tx.catalogue_number(F.lit(number)))


def by_identifier(docs: DataFrame, *wanted: str) -> DataFrame:
    """The documents of ids, TM numbers or hybrid names, as given or else with ; for . ; a document that several of them name is there once."""
    dotted = lambda c: F.replace(c, F.lit(";"), F.lit("."))
    exact = [(F.col("id") == x) | (F.col("tm") == x) | (F.col("hybrid") == x) for x in wanted]
    loose = [(dotted("id") == x.replace(";", ".")) | (dotted("hybrid") == x.replace(";", ".")) for x in wanted]
    known = docs.agg(*[F.coalesce(F.bool_or(x), F.lit(False)).alias(f"known{i}") for i, x in enumerate(exact)])
    hit = functools.reduce(operator.or_, [x | (y & ~F.col(f"known{i}")) for i, (x, y) in enumerate(zip(exact, loose, strict=True))])
    return docs.join(F.broadcast(known)).where(hit).select(*docs.columns)  # one row


def edition_marks(words: DataFrame, base: str, modern: list[str], majority: int = 4) -> DataFrame:
    """words with a mark: + in the base but few modern editions, - in most modern ones only, ≈ moved, else empty."""
    n = F.size(F.array_intersect("editions", F.array(*[F.lit(m) for m in modern])))
    has = F.array_contains("editions", base)
    moved = F.coalesce(F.col("offsets")[base], F.lit(0)) > 0
    return words.withColumn("mark", F.when(has & (n < majority), "+").when(~has & (n >= majority), "-").when(has & moved, "≈").otherwise(""))


def translations(entries: DataFrame, word: str, lang: str = "en", most: int = 60) -> DataFrame:
    """sense, words: the first `most` translations, grouped by sense in the order of first appearance."""
    rows = entries.where((F.col("word") == word) & (F.col("lang_code") == lang)).select(F.posexplode(F.slice("translations", 1, most)).alias("at", "t"))
    return rows.groupBy(F.coalesce(F.col("t.sense"), F.lit("")).alias("sense")).agg(F.min("at").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("t.word").alias("w")))), lambda x: x["w"]).alias("words")).orderBy("first").drop("first")


#: Fields of a dictionary entry that name related words.
RELATION_FIELDS = ("synonyms", "antonyms", "hypernyms", "hyponyms", "derived", "related", "coordinate_terms", "meronyms")


def entry_relations(entries: DataFrame, word: str, most: int = 40) -> DataFrame:
    """relation, words: the first `most` distinct words of every relation field that an entry of the word has."""
    own = entries.where(F.col("word") == word)
    fields = [f for f in RELATION_FIELDS if f in entries.columns]
    each = F.array(*[F.struct(F.lit(f).alias("relation"), F.coalesce(f, F.array().cast("array<string>")).alias("words")) for f in fields])
    rows = own.select("entry_no", F.explode(each).alias("r")).where(F.size("r.words") > 0)
    grouped = rows.groupBy("r.relation").agg(F.array_sort(F.collect_list(F.struct("entry_no", F.col("r.words").alias("ws")))).alias("all"))
    return grouped.select("relation", F.slice(F.array_distinct(F.flatten(F.transform("all", lambda a: a["ws"]))), 1, most).alias("words"))


def pronunciations(entries: DataFrame, word: str) -> DataFrame:
    """sounds: distinct IPA forms of a word's entries in order, else its enPR forms."""
    rows = entries.where(F.col("word") == word).select("entry_no", F.posexplode("sounds").alias("at", "s"))
    form = F.coalesce(F.col("s.ipa"), F.concat(F.lit("enPR: "), F.col("s.enpr")))
    lists = rows.where(form.isNotNull()).agg(F.array_sort(F.collect_list(F.struct("entry_no", "at", form.alias("f")))).alias("fs"))
    return lists.select(F.array_distinct(F.transform("fs", lambda x: x["f"])).alias("sounds"))
