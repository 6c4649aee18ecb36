"""Consistency checks over prose. Every check returns findings: check, place, class, what.

Prose is a table of lines (book, line_no, text), one block per line; notes are lines that
start with [^name]. Pattern lists are data, so a check is a join or a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import relational

NOTE = r"^\[\^([^\]]+)\]"
ANCHOR = r"\[\^([^\]]+)\](?!:)"
QUOTE = "[“\"]([^”\"]{1,600})[”\"]"

#: Parts of works that a numeral follows, parts that are places by themselves, hosts' endings, and months.
NUMBERED = (
    "act appendix article bk book books canto ch chap chapter chapters column entry epistle f fol folio hymn leaf letter line lines "
    "note number oration p page pages para paragraph part parts pl plate pp psalm pt scene sec section sections stanza verse vol volume volumes"
)
UNNUMBERED = "afterword appendix colophon conclusion dedication epilogue foreword frontispiece glossary introduction preamble preface prologue"
PAGED = "f fol folio leaf p page pages pp"
HOSTS = "com edu gov io net org uk"
MONTHS = "January February March April May June July August September October November December"


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _word(inner: str) -> str:
    """inner where no letter or digit stands before it; the engines' own word edges know ASCII only."""
    return r"(?:^|[^\p{L}\p{N}])" + inner


_NUMERAL = "(?:[0-9]+|[IVXLC]+)"
_SPAN = "[0-9]+(?:[-–][0-9]+)?"
#: What a note may name as the place of its source, a grammar each: a kind of part and a numeral, a chain of numbers, a shelf mark,
#: an address, a day. Tried in this order.
LOCATORS = {
    "page": _word(f"(?i:{_any(PAGED)})[.]? ?{_SPAN}") + f"|[*)”\"], ?{_SPAN}(?:[.,;]|$)",
    "structure": _word(f"(?i:{_any(NUMBERED)})[.]? {_NUMERAL}(?:[^\\p{{L}}]|$)") + "|" + _word(f"(?i:{_any(UNNUMBERED)})(?:[^\\p{{L}}]|$)") + "|§ ?[0-9]",
    "canonical": _word("[0-9]+(?:[.:][0-9]+)+[a-e]?(?:[^\\p{L}\\p{N}]|$)") + "|" + _word("[0-9]+[a-e](?:[^\\p{L}\\p{N}]|$)"),
    "archival": _word("[A-Z]{1,5}[ .-]?[0-9]{2,}(?:[./-][0-9A-Z]+)*") + "|" + _word("[0-9]+(?:-[0-9]+){2,}"),
    "url": "(?i:https?://)|" + _word(f"[A-Za-z0-9-]+[.](?:[A-Za-z0-9-]+[.])*(?i:{_any(HOSTS)})(?:[^\\p{{L}}\\p{{N}}]|$)"),
    "date": _word(f"(?:[0-9]{{1,2}} {_any(MONTHS)},? [0-9]{{4}}|{_any(MONTHS)} [0-9]{{1,2}}, [0-9]{{4}}|{_any(MONTHS)} [0-9]{{4}})"),
}


def classified(lines: DataFrame) -> DataFrame:
    """lines with is_note, is_body and has_anchor."""
    note = F.col("text").rlike(NOTE)
    head = F.col("text").rlike(r"^(#|---|\*\*Section)")
    return lines.withColumn("is_note", note).withColumn("is_body", (F.trim("text") != "") & ~note & ~head).withColumn("has_anchor", F.col("text").rlike(ANCHOR))


def orphans(lines: DataFrame) -> DataFrame:
    """Unindented prose after the first note: it renders as body text."""
    w = Window.partitionBy("book").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.col("text").rlike(NOTE + ":").cast("int")).over(w) == 1
    rows = lines.withColumn("seen", seen).where(F.col("seen") & (F.trim("text") != "") & ~F.col("text").rlike(r"^(\s|\[\^)"))
    return _findings(rows, "footnotes", F.lit("ORPHAN"), F.substring("text", 1, 70))


def unmarked_quotes(lines: DataFrame, least_words: int = 4) -> DataFrame:
    """Body lines with a quotation of `least_words` or more, without an anchor there or on the nearest body line before or after; a note ends the look."""
    w = Window.partitionBy("book").orderBy("line_no")
    rows = classified(lines).where(F.col("is_body") | F.col("is_note"))
    near = lambda f: F.coalesce(f("is_body").over(w) & f("has_anchor").over(w), F.lit(False))
    rows = rows.withColumn("near", near(F.lag) | near(F.lead))
    spans = F.transform(F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1)), lambda s: F.size(tx.words(s)))
    rows = rows.withColumn("longest", F.coalesce(F.array_max(spans), F.lit(0)))
    hit = F.col("is_body") & ~F.col("has_anchor") & ~F.col("near") & (F.col("longest") >= least_words)
    return _findings(rows.where(hit), "footnotes", F.lit("UNMARKED"), F.substring("text", 1, 70))


def long_notes(lines: DataFrame, cap: int = 150) -> DataFrame:
    words = F.size(tx.words(F.regexp_replace("text", r"<!--.*?-->", "")))
    return _findings(classified(lines).where(F.col("is_note") & (words > cap)), "footnotes", F.lit("LONG"), words.cast("string"))


def anchor_mismatches(lines: DataFrame) -> DataFrame:
    """Anchors without a definition, definitions without an anchor, names defined twice."""
    uses = lines.select("book", F.explode_outer(F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(1))).alias("slug")).where("slug is not null").distinct()
    defs = lines.where(F.col("text").rlike(NOTE + ":")).select("book", F.regexp_extract("text", NOTE, 1).alias("slug")).groupBy("book", "slug").agg(F.count(F.lit(1)).alias("n"))
    both = uses.withColumn("used", F.lit(True)).join(defs, ["book", "slug"], "full_outer")
    kind = F.when(F.col("n").isNull(), "NO DEFINITION").when(F.col("used").isNull(), "NO ANCHOR").when(F.col("n") > 1, "DEFINED TWICE")
    return both.select(F.lit("footnotes").alias("check"), F.col("book").alias("place"), kind.alias("class"), F.col("slug").alias("what")).where(F.col("class").isNotNull())


#: What notes should not say, as words of a small grammar each: talk of the writing itself, support that the
#: note claims for the text, how far a source is to be believed, and what a work argues.
_OPINIONS = "authoritative balanced careful comprehensive contested controversial credible definitive dependable dubious excellent flawed indispensable magisterial outdated partisan reliable speculative standard trustworthy unreliable useful"
_WORKS = "account analysis article biography book chapter edition essay history monograph paper source study survey translation treatment work"
_ARGUES = "argues claims concludes contends demonstrates describes explains explores holds maintains shows suggests surveys traces"
NOTE_TALK = {
    "SELF-TALK": r"(?i)\b(?:todo|fixme|tbd|note to self|check (?:this|that|whether)|to be (?:checked|verified|confirmed)|I (?:think|believe|should|need to)|we (?:should|need to))\b",
    "WARRANT": r"(?i)\b(?:this|which) (?:supports|confirms|proves|bears out|corroborates) (?:the|our|this|that)\b|\b(?:is|are) (?:good |strong )?evidence (?:for|that)\b",
    "VERDICT": rf"(?i)\b(?:{'|'.join(_OPINIONS.split())}) (?:{'|'.join(_WORKS.split())})\b|\b(?:{'|'.join(_WORKS.split())}) (?:is|remains) (?:an? |the |still )?(?:{'|'.join(_OPINIONS.split())})\b",
    "THESIS": rf"(?i)\b(?:{'|'.join(_WORKS.split())}) (?:{'|'.join(_ARGUES.split())})\b|\b(?:his|her|their) (?:{'|'.join(_WORKS.split())}) (?:of|on) \w+",
}
#: Classes whose notes may say so in a sentence that names a place in the work.
PLACED = ("THESIS",)


def note_talk(lines: DataFrame, patterns: dict[str, str] | None = None, around: int = 40) -> DataFrame:
    """The first match of each class of NOTE_TALK in each note, with the characters around it; one note may be of several classes."""
    notes = classified(lines).where("is_note").select("book", "line_no", "text")
    kinds = []
    for name, pattern in (patterns or NOTE_TALK).items():
        hit = F.get(tx.located(F.col("text"), pattern), F.lit(0))
        ok = hit.isNotNull()
        if name in PLACED:
            ok = ok & locator(F.col("text")).isin("NO ANCHOR", "SEARCH-ONLY")
        kinds.append(F.when(ok, F.struct(F.lit(name).alias("name"), hit.alias("f"))))
    rows = notes.select("*", F.explode_outer(F.array_compact(F.array(*kinds))).alias("k")).where("k IS NOT NULL")
    begin = F.greatest(F.lit(1), F.col("k.f.at") - around)
    return _findings(rows, "footnotes", F.col("k.name"), F.substring(F.col("text"), begin, F.col("k.f.at") + F.length("k.f.hit") + around - begin))


def notes_to_notes(lines: DataFrame) -> DataFrame:
    """Anchors of other notes inside a note."""
    notes = classified(lines).where("is_note").select("book", "line_no", F.regexp_replace("text", NOTE, "").alias("rest"))
    rows = notes.select("book", "line_no", F.explode_outer(F.regexp_extract_all("rest", F.lit(r"\[\^([^\]]+)\]"), F.lit(1))).alias("to")).where("to IS NOT NULL")
    return _findings(rows, "footnotes", F.lit("XREF"), F.concat(F.lit("[^"), F.col("to"), F.lit("]")))


#: An author, a title in italics, and what opens the publisher's brackets.
CITATION = r"([A-Z][\p{L}.' -]*), \*([^*]{6,70})\*\s*\("
TITLE_KEY = 28


def repeated_citations(lines: DataFrame) -> DataFrame:
    """Works that a book cites in full more than once: by the author's last name and the beginning of the title."""
    notes = classified(lines).where("is_note").select("book", "line_no", F.regexp_extract("text", NOTE, 1).alias("slug"), F.regexp_extract_all("text", F.lit(CITATION), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(CITATION), F.lit(2)).alias("t"))
    rows = notes.select("book", "line_no", "slug", F.posexplode(F.arrays_zip("a", "t")).alias("at", "c"))
    key = [F.element_at(F.split(F.trim("c.a"), " "), -1).alias("author"), F.substring("c.t", 1, TITLE_KEY).alias("title")]
    held = rows.select("book", "line_no", "at", "slug", *key).groupBy("book", "author", "title").agg(F.array_sort(F.collect_list(F.struct("line_no", "at", "slug"))).alias("where")).where(F.size("where") > 1)
    what = F.concat(F.col("author"), F.lit(", "), F.col("title"), F.lit(": "), F.array_join(F.transform("where", lambda w: w["slug"]), ", "))
    return held.select(F.lit("footnotes").alias("check"), F.col("book").alias("place"), F.concat(F.lit("FULL-CITE x"), F.size("where").cast("string")).alias("class"), what.alias("what"))


def restated(lines: DataFrame, least_words: int = 80, share: float = 0.18, n: int = 6) -> DataFrame:
    """Long notes that say again what the body says before their anchor: the share of that span's n-word shingles that the note has."""
    from lexispark.operators import passages

    rows = classified(lines)
    body = rows.where("is_body AND has_anchor").select("book", "line_no", "text", F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(1)).alias("slugs"))
    spans = passages.anchor_spans(body, ANCHOR).withColumn("slug", F.get("slugs", F.col("anchor_no") - 1))
    notes = rows.where(F.col("text").rlike(NOTE + ":")).where(F.size(tx.words(F.col("text"))) >= least_words)
    notes = notes.groupBy("book", F.regexp_extract("text", NOTE, 1).alias("slug")).agg(F.min_by("text", "line_no").alias("note"))
    both = spans.join(notes, ["book", "slug"]).withColumn("share", tx.overlap_share(F.col("span"), F.col("note"), n)).where(F.col("share") > share)
    return _findings(both, "footnotes", F.lit("DUPLICATE"), F.concat(F.lit("[^"), F.col("slug"), F.lit("] "), F.round(F.col("share") * 100).cast("int").cast("string"), F.lit(" %")))


def locator(note: Column) -> Column:
    """The first family of locators in a note without its quotations; SEARCH-ONLY with a quotation of eight words, else NO ANCHOR."""
    bare = F.regexp_replace(note, QUOTE, " ")
    out = None
    for name, pattern in LOCATORS.items():
        hit = bare.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    longest = F.array_max(F.transform(F.regexp_extract_all(note, F.lit(QUOTE), F.lit(1)), lambda s: F.size(tx.words(s))))
    return out.when(longest >= 8, "SEARCH-ONLY").otherwise("NO ANCHOR")


def banned(lines: DataFrame, patterns: list[tuple[str, str]], carve: str | None = None, ruled: DataFrame | None = None, around: int = 40) -> DataFrame:
    """Every match of each (name, pattern), with the characters around it, less those near a carve-out, less ruled fingerprints.

    place is book:line:column. One pass over the lines; those that no pattern matches are dropped first.
    """
    kinds = [F.struct(F.lit(name).alias("name"), tx.located(F.col("text"), p).alias("found")) for name, p in patterns]
    some = None
    for _, p in patterns:
        some = F.col("text").rlike(p) if some is None else some | F.col("text").rlike(p)
    rows = lines.where(some).select("book", "line_no", "text", F.explode_outer(F.array(*kinds)).alias("k"))
    rows = rows.select("book", "line_no", "text", F.col("k.name").alias("name"), F.explode_outer("k.found").alias("f")).where("f is not null")
    begin = F.greatest(F.lit(1), F.col("f.at") - around)
    out = rows.withColumn("hit", F.substring(F.col("text"), begin, F.col("f.at") + F.length("f.hit") + around - begin))
    if carve:
        out = out.where(~F.col("hit").rlike(carve))
    out = out.withColumn("fingerprint", tx.fingerprint(F.col("hit")))
    if ruled is not None:
        out = out.join(ruled.select("fingerprint"), "fingerprint", "left_anti")
    place = F.concat_ws(":", "book", F.col("line_no").cast("string"), F.col("f.at").cast("string"))
    return out.select(F.lit("words").alias("check"), place.alias("place"), F.col("name").alias("class"), F.col("hit").alias("what"))


def cross_references(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """terms (book, term, target): whether a line of the target book has the term or a variant, else where it is found.

    The places of a term are found once, however many books refer to it.
    """
    terms = terms.select("book", "term", "target").distinct()
    wanted = terms.select("term").distinct().select("term", F.explode(tx.term_variants(F.col("term"))).alias("variant"))
    items = wanted.select(F.col("variant").alias("item_id"), F.col("variant").alias("item")).distinct()
    at = lines.select(F.struct("book", "line_no").alias("doc_id"), F.lower("text").alias("text"))
    hits = relational.containing(items, at).select(F.col("item_id").alias("variant"), F.col("doc_id.book").alias("where")).distinct()
    places = wanted.join(hits, "variant", "left").groupBy("term").agg(F.array_sort(F.collect_set("where")).alias("places"))
    bad = terms.join(places, "term").where(~F.array_contains("places", F.col("target")))
    return bad.select(F.lit("crossrefs").alias("check"), F.col("book").alias("place"), F.lit("NOT THERE").alias("class"), F.concat(F.col("term"), F.lit(": "), F.array_join("places", ", ")).alias("what"))


def drift(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """id, status (UNCHANGED, DRIFTED, MISSING) of known block hashes against the blocks as they are."""
    now = blocks.select("id", tx.content_hash(F.col("text")).alias("now"))
    status = F.when(F.col("now").isNull(), "MISSING").when(F.col("now") == F.col("hash"), "UNCHANGED").otherwise("DRIFTED")
    return known.select("id", "hash").join(now, "id", "left").select("id", status.alias("status"))


def _findings(rows: DataFrame, check: str, kind: Column, what: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.concat_ws(":", "book", F.col("line_no").cast("string")).alias("place"), kind.alias("class"), what.alias("what"))
