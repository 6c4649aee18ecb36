"""Readers of corpus formats: each turns files, read by Spark, into rows.

Line formats stay DataFrame expressions; documents that need a parser (XML, database dumps)
are parsed one file per row inside tasks. Paths may be in any store that Spark reads.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark import store
from lexispark.functions import text as tx


def files(spark: SparkSession, path: str, suffixes: list[str], skip_dirs: list[str] = (), exclude: DataFrame | None = None, content: bool = False) -> DataFrame:
    """path, title, length, modified (and content) of files below path, without skipped folders and excluded paths, one per path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    rows = rows.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin([s.lower().lstrip(".") for s in suffixes]))
    if skip_dirs:
        rows = rows.where(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in skip_dirs])))
    if exclude is not None:
        rows = rows.join(exclude.where(~F.col("path").startswith("#")).select("path"), "path", "left_anti")
    title = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return rows.select("path", title.alias("title"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else [])).dropDuplicates(["path"])


def signature(files_: DataFrame) -> DataFrame:
    """path, sig: what changes when a file does."""
    return files_.select("path", F.concat_ws(" ", F.unix_micros("modified").cast("string"), F.col("length").cast("string")).alias("sig"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, text of every line, numbered from 1 within its file.

    Files are read in splits; the lines of a split are counted, and its numbers begin after
    those of the splits before it, so that a file of any size is many tasks.
    """
    read = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    rows = store.written(read)
    counts = rows.groupBy(F.col("path").alias("_path"), F.col("start").alias("_start")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_path").orderBy("_start")) - F.col("n")  # a row for each split
    placed = rows.join(counts.withColumn("before", before), (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")))
    return placed.select("path", (F.col("id") - F.col("first") + F.col("before") + 1).cast("int").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, required: str | None = None) -> DataFrame:
    """Rows of JSON lines, gzipped or not; broken lines, and rows without the required field, are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(required).isNotNull() & (F.col(required) != "")) if required else rows


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of an append-only log; a broken line is refused unless it is the last line of the last file."""
    rows = lines(spark, path).where(F.trim("text") != "").withColumn("event", F.try_parse_json("text"))
    bad = rows.where(F.col("event").isNull()).select("path", "line_no")
    last = rows.agg(F.max(F.struct("path", "line_no")).alias("m")).select("m.path", "m.line_no")
    wrong = bad.join(last, ["path", "line_no"], "left_anti").take(1)
    if wrong:
        raise ValueError(f"broken line {wrong[0].line_no} in {wrong[0].path}")
    return rows.where(F.col("event").isNotNull())


def markdown_table(lines_: DataFrame) -> DataFrame:
    """path, row_no, cells (map from header to cell) of the first pipe table of each file."""
    w = Window.partitionBy("path").orderBy("line_no")
    bare = F.trim("text")
    rows = lines_.withColumn("pipe", bare.startswith("|"))
    rows = rows.withColumn("first", F.min(F.when(F.col("pipe"), F.col("line_no"))).over(Window.partitionBy("path")))
    rows = rows.withColumn("gap", F.max((~F.col("pipe") & (F.col("line_no") > F.col("first"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col("pipe") & (F.coalesce("gap", F.lit(0)) == 0) & ~bare.rlike(r"^\|[\s:|-]+\|?$"))
    cells = F.transform(F.split(F.regexp_replace(bare, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells).withColumn("header", F.first("cells").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("row_no", F.row_number().over(w) - 1)
    full = F.transform("header", lambda h, i: F.coalesce(F.get("cells", i), F.lit("")))
    return rows.where("row_no > 0").select("path", "row_no", F.map_from_arrays("header", full).alias("cells"))


def checkboxes(lines_: DataFrame) -> DataFrame:
    """path, line_no, heading, done, item of '- [ ]' and '- [x]' lines; the heading is the last one above."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("text").rlike(r"^#{1,3} "), F.regexp_replace("text", r"^#+\s*", ""))
    rows = lines_.withColumn("heading", F.last(head, True).over(w)).where(F.col("text").rlike(r"^\s*- \[[ xX]\]"))
    return rows.select("path", "line_no", "heading", (F.lower(F.regexp_extract("text", r"\[([ xX])\]", 1)) == "x").alias("done"), F.trim(F.regexp_replace("text", r"^\s*- \[[ xX]\]", "")).alias("item"))


def word_lists(lines_: DataFrame, name: str) -> DataFrame:
    """pattern, note, carve of the lines between NAME:BEGIN and NAME:END."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    begin, end = F.col("text").contains(f"{name}:BEGIN"), F.col("text").contains(f"{name}:END")
    inside = F.sum(begin.cast("int") - end.cast("int")).over(w) > 0
    rows = lines_.withColumn("inside", inside).where(F.col("inside") & ~begin & (F.trim("text") != "") & ~F.col("text").startswith("#"))
    part = lambda i: F.nullif(F.trim(F.get(F.split("text", ";;"), F.lit(i))), F.lit(""))
    return rows.select(part(0).alias("pattern"), part(1).alias("note"), part(2).alias("carve"))


def blocks(lines_: DataFrame) -> DataFrame:
    """path, line_no, id, text, hash of lines with a block id; an id that occurs twice is refused."""
    ident = F.regexp_extract("text", r"<!--\s*b:([0-9a-f]{6})\s*-->", 1)
    rows = lines_.withColumn("id", ident).where("id <> ''").withColumn("text", F.trim(F.regexp_replace("text", r"<!--\s*b:[0-9a-f]{6}\s*-->", "")))
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    if twice:
        raise ValueError(f"block {twice[0].id} stands {twice[0].n} times")
    return rows.select("path", "line_no", "id", "text", tx.content_hash(F.col("text")).alias("hash"))


def transliterations(lines_: DataFrame) -> DataFrame:
    """pnum, designation, text of records that start with &P; numbered lines without their numbers, English translations; the last of a repeated number stays."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("text", r"^&(P\d+)", 1)
    rows = lines_.withColumn("start", F.when(head != "", F.col("line_no"))).withColumn("rec", F.last("start", True).over(w)).where("rec is not null")
    kept = F.when(F.col("text").rlike(r"^\d+['.]*\.?\s"), F.regexp_replace("text", r"^\d+['.]*\.?\s+", "")).when(F.col("text").startswith("#tr.en:"), F.trim(F.regexp_replace("text", "^#tr.en:", "")))
    rec = rows.groupBy("path", "rec").agg(
        F.max(F.when(head != "", head)).alias("pnum"),
        F.max(F.when(head != "", F.trim(F.regexp_extract("text", r"=\s*(.*)$", 1)))).alias("designation"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept.isNotNull(), F.struct("line_no", kept.alias("t"))))), lambda x: x["t"]), "\n").alias("text"),
    )
    last = rec.groupBy("pnum").agg(F.max(F.struct("path", "rec", "designation", "text")).alias("r"))
    return last.select("pnum", "r.designation", "r.text")


def tagged_words(lines_: DataFrame) -> DataFrame:
    """book, chapter, verse, n, type, greek, english, editions (array), offsets (map edition to places moved) of tab-separated word lines."""
    f = F.split("text", "\t")
    rows = lines_.withColumn("f", f).where(F.col("text").rlike(r"^[1-3]?[A-Za-z]+\.\d+\.\d+#\d+=") & (F.size("f") >= 6))
    head = lambda i: F.regexp_extract(F.col("f")[0], r"^([1-3]?[A-Za-z]+)\.(\d+)\.(\d+)#(\d+)=(.*)$", i)
    eds = F.filter(F.split(F.col("f")[5], r"\+"), lambda e: e != "")
    names = F.transform(eds, lambda e: F.regexp_replace(e, "»\\d+$", ""))
    moved = F.transform(eds, lambda e: F.coalesce(F.nullif(F.regexp_extract(e, "»(\\d+)$", 1), F.lit("")).cast("int"), F.lit(0)))
    return rows.select(head(1).alias("book"), head(2).cast("int").alias("chapter"), head(3).cast("int").alias("verse"), head(4).cast("int").alias("n"), F.trim(head(5)).alias("type"), F.trim(F.col("f")[1]).alias("greek"), F.trim(F.col("f")[2]).alias("english"), names.alias("editions"), F.map_from_arrays(F.array_distinct(names), F.slice(moved, F.lit(1), F.size(F.array_distinct(names)))).alias("offsets"))


def edition_order(words: DataFrame, edition: str) -> DataFrame:
    """Words of one edition in its order: by place moved to, unmoved words first at equal places."""
    off = F.coalesce(F.col("offsets")[edition], F.lit(0))
    rows = words.where(F.array_contains("editions", edition)).withColumn("key", F.struct((F.col("n") + off).alias("at"), F.when(off > 0, 1).otherwise(0).alias("moved"), "n", "greek"))
    return rows.groupBy("book", "chapter", "verse").agg(F.transform(F.array_sort(F.collect_list("key")), lambda k: k["greek"]).alias("words"))


def _parsed(docs: DataFrame, schema: str, parse: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """Rows that parse(path, content) makes of every file; a file that cannot be parsed makes none here, and one in `unparsed`."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = parse(path, bytes(content))
                except ET.ParseError:
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    return docs.select("path", "content").mapInPandas(run, schema)


def unparsed(docs: DataFrame) -> DataFrame:
    """path, error of the XML files (path, content) that cannot be parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    ET.fromstring(bytes(content))
                except ET.ParseError as e:
                    bad.append((path, str(e)))
            yield pd.DataFrame(bad, columns=["path", "error"])

    return docs.select("path", "content").mapInPandas(run, "path string, error string")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text_of(node: ET.Element, skip: tuple[str, ...] = ("note",)) -> str:
    out = [node.text or ""]
    for child in node:
        if _local(child.tag) not in skip:
            out.append(_text_of(child, skip))
        out.append(child.tail or "")
    return re.sub(r"\s+", " ", "".join(out)).strip()


def tei_segments(docs: DataFrame, verses: int = 12) -> DataFrame:
    """path, seq, location, text of TEI files: verse lines in groups within a division, prose blocks one each; notes left out."""

    def parse(path: str, content: bytes) -> list[tuple]:
        rows: list[tuple] = []

        def add(where: list[str], text: str) -> None:
            if text:
                rows.append((path, len(rows) + 1, ".".join(where), text))

        def walk(node: ET.Element, where: list[str]) -> None:
            pending: list[tuple[str, str]] = []

            def flush() -> None:
                for i in range(0, len(pending), verses):
                    part = pending[i : i + verses]
                    span = part[0][0] if len(part) == 1 else f"{part[0][0]}-{part[-1][0]}"
                    add([*where, span], "\n".join(t for _, t in part))
                pending.clear()

            for child in node:
                tag, n = _local(child.tag), child.get("n")
                if tag == "l":
                    pending.append((n or str(len(pending) + 1), _text_of(child)))
                    continue
                if tag in ("lg",):
                    for line in child.iter():
                        if _local(line.tag) == "l":
                            pending.append((line.get("n") or str(len(pending) + 1), _text_of(line)))
                    continue
                flush()
                if tag in ("p", "sp", "quote", "said"):
                    add(where, _text_of(child))
                elif tag.startswith("div") or tag in ("text", "body", "group", "front", "back", "TEI", "TEI.2"):
                    skip = not tag.startswith("div") or n is None or child.get("type") in ("edition", "translation")
                    walk(child, where if skip else [*where, n])
            flush()

        walk(ET.fromstring(content), [])
        return rows

    return _parsed(docs, "path string, seq int, location string, text string", parse)


def papyri(docs: DataFrame) -> DataFrame:
    """id, tm, hybrid, langs, text of EpiDoc files; texts under three characters dropped; one row per id, of the first path.

    A file is a document, or a teiCorpus of many.
    """

    def document(path: str, at: int, root: ET.Element) -> tuple:
        ids: dict[str, str] = {}
        for node in root.iter():
            if _local(node.tag) == "idno":
                ids.setdefault(node.get("type", ""), (node.text or "").strip())
        langs = sorted({v for node in root.iter() if _local(node.tag) in ("div", "ab", "foreign") for k, v in node.attrib.items() if _local(k) == "lang"})
        text = " ".join(_text_of(node) for node in root.iter() if _local(node.tag) == "div" and node.get("type") == "edition")
        return path, at, ids.get("filename", ""), ids.get("TM", ""), ids.get("ddb-hybrid", ""), langs, text

    def parse(path: str, content: bytes) -> list[tuple]:
        root = ET.fromstring(content)
        own = [node for node in root if _local(node.tag) == "TEI"] if _local(root.tag) == "teiCorpus" else [root]
        return [row for at, node in enumerate(own) if len((row := document(path, at, node))[-1]) >= 3]

    rows = _parsed(docs, "path string, at int, id string, tm string, hybrid string, langs array<string>, text string", parse)
    return rows.groupBy("id").agg(F.min_by(F.struct("tm", "hybrid", "langs", "text"), F.struct("path", "at")).alias("r")).select("id", "r.*")


def wordnet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """senses (lemma, pos, synset, sense) and synsets (id, pos, definition, examples) of lexical XML."""
    lexical = "_id STRING, Lemma STRUCT<_writtenForm: STRING, _partOfSpeech: STRING>, Sense ARRAY<STRUCT<_id: STRING, _synset: STRING>>"
    entries = spark.read.format("xml").option("rowTag", "LexicalEntry").schema(lexical).load(path)
    senses = entries.select(F.col("Lemma._writtenForm").alias("lemma"), F.col("Lemma._partOfSpeech").alias("pos"), F.explode("Sense").alias("s")).select("lemma", "pos", F.col("s._synset").alias("synset"), F.col("s._id").alias("sense"))
    sets = spark.read.format("xml").option("rowTag", "Synset").schema("_id STRING, _partOfSpeech STRING, Definition ARRAY<STRING>, Example ARRAY<STRING>").load(path)
    return senses, sets.select(F.col("_id").alias("id"), F.col("_partOfSpeech").alias("pos"), F.get("Definition", F.lit(0)).alias("definition"), F.array_join("Example", " | ").alias("examples"))


_INSERT = re.compile(rb"INSERT INTO `(\w+)` VALUES ", re.I)
_VALUE = re.compile(rb"\s*(?:'((?:[^'\\]|\\.|'')*)'|0x([0-9A-Fa-f]+)|(NULL)|([-+.\w]+))\s*([,)])", re.S)
#: Escapes of MySQL string literals.
_ESCAPES = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"0": b"\0", b"Z": b"\x1a", b"b": b"\b"}


def mysql_rows(lines_: DataFrame, tables: list[str]) -> DataFrame:
    """table, values (array of strings, null for NULL) of INSERT lines of a dump: one statement per line, as dumps are written."""
    names = {t.encode() for t in tables}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for line in batch["text"]:
                raw = line.encode()
                m = _INSERT.match(raw)
                if not m or m[1] not in names:
                    continue
                at = m.end()
                while at < len(raw) and raw[at : at + 1] == b"(":
                    row, at = [], at + 1
                    while v := _VALUE.match(raw, at):
                        at = v.end()
                        if v[1] is not None:
                            s = re.sub(rb"\\(.)|''", lambda e: b"'" if e[1] is None else _ESCAPES.get(e[1], e[1]), v[1], flags=re.S)
                            row.append(s.decode("utf-8", "replace"))
                        elif v[2] is not None:
                            row.append(bytes.fromhex(v[2].decode()).decode("utf-8", "replace"))
                        else:
                            row.append(None if v[3] is not None else v[4].decode())
                        if v[5] == b")":
                            break
                    out.append((m[1].decode(), row))
                    at += 1 if raw[at : at + 1] == b"," else len(raw)
            yield pd.DataFrame(out, columns=["table", "values"])

    return lines_.select("text").mapInPandas(run, "table string, values array<string>")


def verses(df: DataFrame, book: str = "book", chapters: str = "text") -> DataFrame:
    """book, ref, body of nested arrays chapters[verses]; empty verses left out."""
    c = df.select(F.col(book).alias("book"), F.posexplode(chapters).alias("c", "vs"))
    v = c.select("book", "c", F.posexplode("vs").alias("v", "body")).where(F.trim("body") != "")
    return v.select("book", F.format_string("%s %d:%d", "book", F.col("c") + 1, F.col("v") + 1).alias("ref"), "body")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every line, in splits of any size: for files too large to be read whole, and formats that need no line numbers."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("text"))


def csv_rows(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The wanted columns, by their names in the header, as strings; rows with fewer fields than the header are left out."""
    quoted = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = quoted.csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in [*names, "_broken"])
    rows = quoted.schema(schema).option("columnNameOfCorruptRecord", "_broken").csv(path)
    return rows.where("_broken is null").select(*wanted)


def mysql_table(lines_: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One table of a dump under its columns' names, given in the order of its CREATE TABLE; rows of another width are left out."""
    rows = mysql_rows(lines_, [table]).where(F.size("values") == len(columns))
    return rows.select(*[F.col("values")[i].alias(c) for i, c in enumerate(columns)])


def lexicon_entries(df: DataFrame, xml: str = "xml", key: str = "key") -> DataFrame:
    """df with headword (the first <orth> or <w>, else the key without a number at its end), norm, and definition without a leading headword."""
    first = F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract(xml, rf"(?s)<{t}\b[^>]*>(.*?)</{t}>", 1), "<[^>]+>", "")), F.lit("")) for t in ("orth", "w")])
    head = F.coalesce(first, F.regexp_replace(key, r"\d+$", ""))
    rows = df.withColumn("headword", head)
    rows = rows.withColumn("norm", F.coalesce(F.nullif(tx.lexicon_key(F.col("headword")), F.lit("")), tx.lexicon_key(F.col(key))))
    text = tx.entry_text(F.col(xml))
    lead = F.when(text.startswith(F.col("headword")), F.length("headword")).otherwise(0)
    return rows.withColumn("definition", F.trim(text.substr(lead + 1, F.length(text))))


def first_definition(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def verse_languages(df: DataFrame, fields: dict[str, str], fallbacks: dict[str, str], key: list[str]) -> DataFrame:
    """key, lang, body: a row per field that a verse has; the fallbacks' fields only where none of the first has text."""
    has = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    own = F.lit(False)
    for c in fields:
        own = own | has(c)
    parts = [F.when(has(c), F.struct(F.lit(l).alias("lang"), F.col(c).alias("body"))) for c, l in fields.items()]
    parts += [F.when(has(c) & ~own, F.struct(F.lit(l).alias("lang"), F.col(c).alias("body"))) for c, l in fallbacks.items()]
    rows = df.select(*key, F.explode_outer(F.array_compact(F.array(*parts))).alias("v")).where("v is not null")
    return rows.select(*key, "v.lang", "v.body")


def card_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a card store: one file, or files by day, never both; a broken line anywhere is refused."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    held = spark.read.format("binaryFile").load(path).select(name.alias("name")).agg(F.max(F.col("name").startswith("cards.")).alias("single"), F.min(F.col("name").startswith("cards.")).alias("all"), F.count(F.lit(1)).alias("n")).first()
    if held["single"] and held["n"] > 1:
        raise ValueError("a single card file and day files")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def claims(spark: SparkSession, path: str) -> DataFrame:
    """path, row (variant) of the JSON lines under path, backups and broken lines left out."""
    rows = raw_lines(spark, path).where(~tx.is_backup(F.element_at(F.split("path", "/"), -1)))
    return rows.select("path", F.try_parse_json("text").alias("row")).where("row is not null")


def titled_paths(df: DataFrame, column: str = "json") -> DataFrame:
    """title, path pairs of JSON of any shape: objects that have both as strings, in any order, at any depth. Broken JSON has none.

    Objects and lists are opened level by level, as variants, until none holds another.
    """
    level = store.written(df.select(F.try_parse_json(column).alias("v")).where("v IS NOT NULL"))
    pairs = None
    while pairs is None or not level.isEmpty():
        own = level.select(F.try_variant_get("v", "$.title", "string").alias("title"), F.try_variant_get("v", "$.path", "string").alias("path"), *[F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")).alias(f"{k}_is") for k in ("title", "path")])
        own = own.where("title_is = 'STRING' AND path_is = 'STRING'").select("title", "path")
        pairs = own if pairs is None else pairs.unionByName(own)
        level.createOrReplaceTempView("opened_level")
        below = df.sparkSession.sql("SELECT e.value AS v FROM opened_level, LATERAL variant_explode(v) AS e")
        level = store.written(below.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")))
    return pairs


def text_cache(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """wanted with text from a cache written by write_text_cache; '' where the cache has none."""
    have = spark.read.parquet(path)
    return wanted.join(have.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def write_text_cache(docs: DataFrame, path: str, key: str, text_col: str = "text") -> None:
    """Sanitised texts with the signature of what they were made from."""
    docs.select(key, tx.sanitize(F.col(text_col)).alias("text"), tx.content_hash(F.col(text_col)).alias("signature")).write.parquet(path)
