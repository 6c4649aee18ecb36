"""Text functions as column expressions: cleaning, folding, hashing, tokens, references."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters that extracted text must not hold (tab and line ends stay).
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: Hebrew points, Arabic marks, superscript alef, tatweel.
SEMITIC_MARKS = r"[֑-ׇً-ْٰـ]"
#: Words that titles are compared without; the wider list serves file names.
TITLE_STOP = "the a an of and in on to for its his her their"
FILE_STOP = TITLE_STOP + " de la le"
#: Stopword lists for the language vote, in the order in which ties are won.
STOPWORDS = {
    "eng": "the of and to in a is that it was for as with on his by at from not are this but had which have were or been their",
    "fra": "le la les de des du et est une dans que qui pour pas sur au aux ce cette il elle nous vous ils sont plus avec par",
    "ita": "il lo la le gli dei della delle che non per con una sono anche come più questo quella nel alla dal degli negli",
    "por": "de do da os as um uma que não para com por mais como mas ao seu sua ou pelo pela nos nas dos das",
    "lat": "et in est non ad cum qui quae quod sed ut ex de per se hoc esse autem enim atque nec ab si",
}


def _base_letters() -> tuple[str, str]:
    """Accented lower-case letters and their bases, by Unicode decomposition of Latin, Greek and Greek Extended."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c and c == c.lower():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _base_letters()


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def fold(text: Column, latin: bool = False) -> Column:
    """Lower case without diacritics; latin also writes v as u and j as i."""
    low = F.lower(text)
    bare = F.regexp_replace(F.translate(low, ACCENTED, PLAIN), r"\p{Mn}", "")
    out = F.when(low.rlike(r"[^\x00-\x7F]"), bare).otherwise(low)  # most texts need no table look-up
    return F.translate(out, "vj", "ui") if latin else out


def plain_fold(text: str) -> str:
    """`fold` of one text in the driver, such as a needle."""
    low = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return "".join(c for c in low if unicodedata.category(c) != "Mn")


def lexicon_key(headword: Column) -> Column:
    """Folded headword of Latin dictionaries: letters only, j as i, v as u."""
    return F.regexp_replace(fold(headword, latin=True), "[^a-z]", "")


def strip_semitic(text: Column) -> Column:
    return F.regexp_replace(text, SEMITIC_MARKS, "")


def slugify(text: Column, default: str = "unknown") -> Column:
    slug = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _entities(text: Column) -> Column:
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def strip_html(html: Column, entities: bool = True, keep_lines: bool = False) -> Column:
    """Text of a page: script and style blocks out, tags to spaces, common entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    out = _entities(out) if entities else out
    if keep_lines:
        out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
        return F.trim(out)
    return collapse(out)


#: Markup of wiki pages: what opens a frame, what closes it, and what stands alone.
_WIKI_OPEN = {"{{": "}}", "{|": "|}", "[[": "]]", "[": "]"}
_WIKI_TOKEN = re.compile(r"<!--|-->|<[^<>]*>|\{\{|\}\}|\{\||\|\}|\[\[|\]\]|\[(?=https?:)|\]|''+|\|", re.I)
_WIKI_MEDIA = ("file", "image", "category")


def _wiki_frame(opener: str, parts: list[str]) -> str:
    """What a closed frame leaves: nothing of templates and tables, of links what is shown."""
    if opener in ("{{", "{|"):
        return " "
    if opener == "[[":
        media = parts[0].partition(":")
        return " " if media[1] and media[0].strip().lower() in _WIKI_MEDIA else parts[-1]
    return "|".join(parts).partition(" ")[2]


def plain_wiki(page: str) -> str:
    """Text of one page of wiki markup, in one scan; frames nest to any depth, and one that is not closed is text."""
    stack: list[tuple[str, list[str]]] = [("", [""])]  # opener, parts so far
    at, skip = 0, ""  # what ends a comment or a reference in which the scan is
    for m in _WIKI_TOKEN.finditer(page):
        token = m[0]
        if skip:
            if token == "-->" == skip or token.startswith("<") and token.lower().startswith(skip):
                skip, at = "", m.end()
            continue
        stack[-1][1][-1] += page[at : m.start()]
        at = m.end()
        opener, parts = stack[-1]
        if token == "<!--":
            skip = "-->"
            parts[-1] += " "
        elif token.startswith("<"):
            parts[-1] += " "
            if re.match(r"<ref\b", token, re.I) and not token.endswith("/>"):
                skip = "</ref"
        elif token in _WIKI_OPEN:
            stack.append((token, [""]))
        elif token == _WIKI_OPEN.get(opener):
            stack.pop()
            stack[-1][1][-1] += _wiki_frame(opener, parts)
        elif token == "|" and opener == "[[":
            parts.append("")
        elif not token.startswith("''") and token != "-->":
            parts[-1] += token
    if not skip:
        stack[-1][1][-1] += page[at:]
    while len(stack) > 1:  # frames left open
        opener, parts = stack.pop()
        stack[-1][1][-1] += opener + "|".join(parts)
    lines = []
    for line in stack[0][1][0].split("\n"):
        bare = " ".join(line.replace("\t", " ").split(" ")).strip(" ")
        if bare.startswith("=") and bare.endswith("="):
            bare = bare.strip("=").strip(" ")
        lines.append(re.sub(" +", " ", bare))
    return re.sub("\n\n\n+", "\n\n", "\n".join(lines)).strip()


def wikitext(text: Column) -> Column:
    """Plain text of wiki markup. Frames nest, which no fixed number of patterns can follow: pages go through `plain_wiki` by Arrow batches."""

    @F.pandas_udf("string")
    def scan(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else plain_wiki(p))

    return scan(text)


def title_norm(title: Column, stop: str = TITLE_STOP) -> Column:
    words = F.regexp_replace(F.lower(title), "[^a-z0-9 ]+", " ")
    bare = F.regexp_replace(words, r"\b(" + "|".join(stop.split()) + r")\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(collapse(text).cast("binary"), 256), F.lit(16))


def fingerprint(text: Column) -> Column:
    return F.left(F.sha1(collapse(text).cast("binary")), F.lit(10))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, the terms of the full-text index."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(items: Column, size: int, step: int) -> Column:
    """Slices of `size` items every `step`, the last one included even if a longer one covers it."""

    def cut(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(xs, i + 1, size))

    return bound(items, cut)


def shingles(items: Column, n: int) -> Column:
    """Distinct runs of n items, joined by spaces."""

    def cut(xs: Column) -> Column:
        last = F.size(xs) - n + 1
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), lambda i: F.concat_ws(" ", *[F.get(xs, i + k) for k in range(n)]))
        return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return bound(items, cut)


def shingle_hashes(items: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the runs of n items."""

    def cut(xs: Column) -> Column:
        last = F.size(xs) - n + 1
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(xs, i + k) for k in range(n)]))
        return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    return bound(items, cut)


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def context(text: Column, needle: Column, around: int) -> Column:
    """The first place of the needle with `around` characters on both sides; null if it is not there."""
    at = F.locate(needle, text) if isinstance(needle, str) else F.instr(text, needle)
    begin = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, begin, at - begin + F.length(needle if isinstance(needle, Column) else F.lit(needle)) + around))


def located(text: Column, pattern: str) -> Column:
    """Array of structs at (from 1) and hit: every match of a pattern. Matches are not empty."""
    hits, rest = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    # a match begins after the pieces before it and the matches between them
    steps = F.zip_with(hits, F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), lambda h, r: F.struct(h.alias("hit"), r.alias("rest")))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,hit:string>>").alias("found"))

    def step(acc: Column, s: Column) -> Column:
        at = acc["next"] + F.length(s["rest"])
        return F.struct((at + F.length(s["hit"])).alias("next"), F.concat(acc["found"], F.array(F.struct(at.alias("at"), s["hit"].alias("hit")))).alias("found"))

    return F.aggregate(steps, start, step)["found"]


def ungrouped(pattern: str) -> str:
    """The pattern with groups that capture nothing, for `located`, which has a group of its own."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def is_title_cased(text: Column) -> Column:
    """At least three words of four or more letters, six tenths of them capitalised."""
    long = F.regexp_extract_all(text, F.lit(r"([A-Za-z]{4,})"), F.lit(1))
    capital = F.filter(long, lambda w: F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1)))
    return (F.size(long) >= 3) & (F.size(capital) * 10 >= F.size(long) * 6)


def overlap_share(left: Column, right: Column, n: int = 6) -> Column:
    """Share of the left text's n-word shingles that the right one has; 0 without shingles."""
    own = shingles(F.regexp_extract_all(F.lower(left), F.lit("([a-z0-9']+)"), F.lit(1)), n)
    other = shingles(F.regexp_extract_all(F.lower(right), F.lit("([a-z0-9']+)"), F.lit(1)), n)
    return bound(own, lambda xs: F.when(F.size(xs) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(xs, other)) / F.size(xs)))


def term_variants(term: Column) -> Column:
    """Spellings under which a term may stand: hyphen or space, plural, -y/-ies, -man/-men."""
    base = F.lower(F.trim(term))
    return F.array_distinct(
        F.filter(
            F.array(
                base, F.replace(base, F.lit("-"), F.lit(" ")), F.replace(base, F.lit(" "), F.lit("-")), F.concat(base, F.lit("s")),
                F.when(base.endswith("s"), F.expr("null")).otherwise(F.concat(base, F.lit("es"))), F.when(base.endswith("y"), F.regexp_replace(base, "y$", "ies")),
                F.when(base.endswith("man"), F.regexp_replace(base, "man$", "men")), F.when(base.endswith("s"), F.regexp_replace(base, "s$", "")),
            ),
            lambda v: v.isNotNull() & (v != ""),
        )
    )


def trimmed_stems(key: Column, most: int = 4, least: int = 3) -> Column:
    """The key less 1 to `most` final letters, longest first, of at least `least` letters."""
    cuts = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.substring(key, F.lit(1), F.length(key) - k))
    return F.filter(cuts, lambda s: F.length(s) >= least)


def passage_reference(ref: Column) -> Column:
    """Struct book, part, first, last of references such as 2.3.10-12 or 327a-328b."""
    pattern = r"^\s*(?:(\d+)\.)?(?:(\d+)\.)?(\d+[a-e]?)(?:\s*[-–]\s*(\d+[a-e]?))?\s*$"
    group = lambda i: F.nullif(F.regexp_extract(ref, pattern, i), F.lit(""))
    return F.struct(group(1).alias("book"), group(2).alias("part"), group(3).alias("first"), F.coalesce(group(4), group(3)).alias("last"))


def verse_reference(ref: Column) -> Column:
    """Struct book, chapter, verse, last verse of references such as 1 John 3:16-18; verse is null for a whole chapter."""
    pattern = r"^\s*((?:[1-4]\s*)?\p{L}[\p{L} .]*?)\s*(\d+)(?::(\d+)(?:\s*[-–]\s*(\d+))?)?\s*$"
    number = lambda i: F.nullif(F.regexp_extract(ref, pattern, i), F.lit("")).cast("int")
    return F.struct(F.nullif(F.regexp_extract(ref, pattern, 1), F.lit("")).alias("book"), number(2).alias("chapter"), number(3).alias("verse"), F.coalesce(number(4), number(3)).alias("last"))


def reference_in(ref: Column, wanted: str) -> Column:
    """A verse itself, or any verse of a chapter: 'Genesis 1' must not find 'Genesis 11:1'."""
    return (ref == wanted) | ref.startswith(wanted + ":")


def folio(index: Column) -> Column:
    """Leaf and side of the i-th page, from 0: 2a, 2b, ..."""
    return F.concat((F.floor(index / 2) + 1).cast("string"), F.when(index % 2 == 0, F.lit("a")).otherwise(F.lit("b")))


def catalogue_digits(text: Column) -> Column:
    """The digits of a catalogue number, without zeros before them."""
    return F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0+(?=.)", "")


def catalogue_number(text: Column) -> Column:
    """P and six digits."""
    return F.concat(F.lit("P"), F.lpad(F.regexp_replace(text, "[^0-9]", ""), 6, "0"))


def year_span(text: Column) -> Column:
    """Struct from, to of '-750.0,300.0', as integers rounded half to even."""
    part = lambda i: F.bround(F.split_part(text, F.lit(","), F.lit(i)).try_cast("double")).cast("int")
    return F.struct(part(1).alias("from"), part(2).alias("to"))


def author_title(name: Column) -> Column:
    """Struct author, title of 'Author - Title'; no author unless it has 3 to 79 characters."""
    parts = F.split(name, " - ", 2)
    author = F.trim(parts[0])
    known = (F.size(parts) == 2) & F.length(author).between(3, 79)
    return F.struct(F.when(known, author).alias("author"), F.when(known, F.trim(parts[1])).otherwise(F.trim(name)).alias("title"))


def chunk_sizing(token_limit: Column) -> tuple[Column, Column]:
    """Words and overlap of a chunk for a model that takes so many tokens; an unknown limit is a small one."""
    middle = F.floor(token_limit / 1.45).cast("int")
    words = F.when(token_limit >= 2048, 400).when(token_limit >= 512, middle).otherwise(200)
    overlap = F.when(token_limit >= 2048, 80).when(token_limit >= 512, F.floor(middle * 0.2).cast("int")).otherwise(40)
    return words, overlap


def extraction_timeout(megabytes: Column, pages: Column) -> Column:
    return F.least(F.lit(1800.0), F.greatest(F.lit(90.0), megabytes * 6.0, pages * 0.5))


#: Signs that write an elision in editions, unified to the first.
ELISION = "’'ʼ᾽᾿ʹ´`"
#: Letters of beta code and the Greek letters that they stand for.
BETA, GREEK = "abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω"
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "Mr Mrs Ms Dr St vs cf ed eds trans vol vols no nos ch chs p pp e.g i.e etc"


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """NFC; of texts without combining marks nothing goes to Python."""
    marked = text.rlike(r"\p{M}")
    return F.when(marked, F.pandas_udf(_nfc, T.StringType())(F.when(marked, text))).otherwise(text)


def audit_norm(text: Column) -> Column:
    """Lower case with diacritics kept, elision marks unified, other signs dropped, white space collapsed."""
    one = F.translate(F.lower(text), ELISION, ELISION[0] * len(ELISION))
    return collapse(F.regexp_replace(one, rf"[^\p{{L}}\p{{M}}\p{{N}}\s{ELISION[0]}]+", " "))


def from_beta(text: Column) -> Column:
    """Greek letters of plain beta code; a sigma that no letter follows is final."""
    return F.regexp_replace(F.concat(F.translate(F.lower(text), BETA, GREEK), F.lit(" ")), r"σ([^\p{L}])", "ς$1").substr(F.lit(1), F.length(text))


def to_beta(text: Column) -> Column:
    return F.translate(fold(text), GREEK + "ς", BETA + "s")


def entry_text(xml: Column, cite: str = "bibl", most: int = 8000) -> Column:
    """Text of a lexicon entry: citations as [cite], other tags as spaces, cut at `most` characters."""
    out = F.regexp_replace(xml, rf"(?s)<{cite}\b[^>]*>.*?</{cite}>", " [cite] ")
    return F.substring(collapse(F.regexp_replace(out, r"(?s)<[^>]+>", " ")), 1, most)


_STOPPED = "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS.split())
#: Where a full stop ends no sentence: abbreviations, initials, and numbers of a list. A mark stands for the stop meanwhile.
_PROTECTED = rf"(^|[^\p{{L}}\p{{N}}_])({_STOPPED}|\p{{Lu}}|\d{{1,3}})[.]"


def sentences(text: Column) -> Column:
    """Sentences: white space after . ! or ? (and a closing quotation mark) parts them, unless the stop is an abbreviation's, an initial's or a list number's."""
    safe = F.regexp_replace(collapse(text), _PROTECTED, "$1$2\u2024")
    parts = F.split(F.regexp_replace(safe, "([.!?][\"”’)]*) ", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u2024"), F.lit(".")))), lambda s: s != "")


#: What a text states that a source can be asked for, by kind.
_QUOTED = "[“\"]([^”\"]*)[”\"]"
_MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_CAPITAL = r"[\p{Lu}][\p{L}'’-]+"
#: What facts are found by outside quotations. A kind's facts are taken out of the text before the next kind looks.
FACTS = {
    "full name": rf"{_CAPITAL}\s*\(({_CAPITAL}(?: \p{{L}}[\p{{L}}'’-]*){{2,}})\)",
    "title": r"[*]([^*]{3,})[*]",
    "date": rf"\b((?:(?:\d{{1,2}} )?{_MONTHS} (?:\d{{1,2}}, )?)?(?:1\d{{3}}|20\d{{2}})s?)\b",
    "number": r"\b(\d+(?:[.,]\d+)*(?:\s?[-–]\s?\d+(?:[.,]\d+)*)?(?:\s?%)?)",
    "name": rf"(?:^|[^\p{{L}}\p{{N}}])({_CAPITAL}(?: (?:of|the|de|von|van|la|du|di) {_CAPITAL}| {_CAPITAL})+)",
}


def facts(text: Column) -> Column:
    """Array of structs kind and what: distinct facts of a text, in the order of kinds, then of first places.

    Quotations come first: those of three words or more are facts, titles if they are
    title-cased, and what stands inside any is no other fact. What follows `FACTS`.
    """
    quoted = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(1)), lambda q: F.size(words(q)) >= 3))
    out = F.transform(quoted, lambda q: F.struct(F.when(is_title_cased(q), "title").otherwise("quotation").alias("kind"), q.alias("what")))
    rest = F.regexp_replace(text, _QUOTED, " | ")
    for kind, pattern in FACTS.items():
        part = F.transform(F.array_distinct(F.regexp_extract_all(rest, F.lit(pattern), F.lit(1))), _as_fact(kind))
        out = F.concat(out, part)
        rest = F.regexp_replace(rest, pattern, " | ")
    return out


def _as_fact(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("what"))


def word_share(note: Column, body: Column) -> Column:
    """Share of the note's words of more than three letters that the body has; 0 without any. Give columns."""
    long = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) > 3)
    mine, other = long(note), long(body)
    return F.when(F.size(mine) == 0, F.lit(0.0)).otherwise(F.size(F.filter(mine, lambda w: F.array_contains(other, w))) / F.size(mine))


#: Endings that headwords of a dictionary of names trade.
NAME_ENDINGS = (("us", "os"), ("a", "e"), ("is", "es"), ("um", "on"))


def name_variants(key: Column) -> Column:
    """The key and its spellings with traded endings, in a fixed order, each once."""
    base = F.lower(F.trim(key))
    swaps = [F.when(base.endswith(x), F.concat(base.substr(F.lit(1), F.length(base) - len(x)), F.lit(y))) for a, b in NAME_ENDINGS for x, y in ((a, b), (b, a))]
    return F.array_distinct(F.array_compact(F.array(base, *swaps)))


def file_language(path: Column, default: str = "eng") -> Column:
    """The language that a file's name ends in: name-grc1.xml, name.lat.txt."""
    found = F.regexp_extract(F.lower(path), r"[-._](grc|lat|eng|fra|deu|ger|ita)\d*\.[a-z]+$", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def nearest_divisor(n: Column, wanted: Column) -> Column:
    """The divisor of n nearest to the one wanted, the smaller of two."""
    found = F.filter(F.sequence(F.lit(1), n), lambda d: n % d == 0)
    return F.array_min(F.transform(found, lambda d: F.struct(F.abs(d - wanted).alias("apart"), d.alias("d"))))["d"]


def window_text(text: Column, offset: Column, most: int = 60_000, find: str | None = None, lead: int = 500) -> Column:
    """`most` characters from an offset (from 0), or from `lead` characters before the first place of `find` at or after it; null if it is not there."""
    if find is None:
        return text.substr(offset + 1, F.lit(most))
    tail = F.lower(text).substr(offset + 1, F.length(text))
    at = F.instr(tail, find.lower())
    begin = F.greatest(F.lit(0), offset + at - 1 - lead)
    return F.when(at > 0, text.substr(begin + 1, F.lit(most)))


def language_clause(lang: Column, code: Column, wanted: str) -> Column:
    """A code of up to three lower-case letters, else a language's name whatever its case."""
    return code == wanted if len(wanted) <= 3 and wanted == wanted.lower() else F.lower(lang) == wanted.lower()


def like_any(column: Column, part: str) -> Column:
    """Contains, whatever the case of ASCII letters; % and _ are characters like any other."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low(column).contains("".join(c.lower() if c.isascii() else c for c in part))


def is_backup(name: Column) -> Column:
    """Copies that editors and sync tools leave beside a file."""
    return F.lower(name).rlike(r"(\.bak|\.orig|\.old|~|\.tmp|\.backup[-.\w]*)$|^\.|conflicted copy")


def clamp(wanted: int | None, default: int, cap: int) -> int:
    return max(1, min(int(wanted or default), cap))
