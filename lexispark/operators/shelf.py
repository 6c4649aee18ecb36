"""Shelves, catalogues and dumps: joins of records with their texts, coverage of a library, samples and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import text as tx


def sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """The same n rows in every run and engine: those with the least MD5 of seed and id."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def catalogued(catalogue: DataFrame, texts: DataFrame, scope: Column, number: str = "number", least: int = 30) -> DataFrame:
    """Catalogue records in scope with their text, met by all digits of the catalogue number; texts of `least` characters and more.

    pnum has six digits, so that longer numbers may share one.
    """
    digits = tx.catalogue_digits(F.col(number)).alias("_digits")
    keyed = texts.select(digits, "text").where(F.length("text") >= least)
    records = catalogue.where(scope).select("*", digits, tx.catalogue_number(F.col(number)).alias("pnum"))
    return records.join(keyed, "_digits").drop("_digits")


def in_scope(genre: Column, subgenre: Column, genres: list[str], keywords: list[str]) -> Column:
    """Records of certain genres, or with a keyword in genre or subgenre."""
    words = F.lower(F.concat_ws(" ", genre, subgenre))
    hit = F.lower(genre).isin([g.lower() for g in genres])
    for k in keywords:
        hit = hit | words.contains(k.lower())
    return hit


def page_texts(pages: DataFrame, slots: DataFrame, contents: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id, title, text of a wiki dump: pages that are articles and no redirects, by revision, main slot, content and text address.

    Four equi-joins; the order of the tables in the dump does not matter.
    """
    articles = pages.where("namespace = 0 AND NOT is_redirect").select("page_id", "title", "latest")
    main = slots.where("role = 'main'").select(F.col("revision_id").alias("latest"), "content_id")
    address = contents.where(F.col("address").startswith("tt:")).select("content_id", F.regexp_extract("address", r"^tt:(\d+)", 1).cast("bigint").alias("text_id"))
    return articles.join(main, "latest").join(address, "content_id").join(texts.select("text_id", "text"), "text_id").select("page_id", "title", "text")


def published(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """stem, status of every source: missing without an output, stale if the source is newer, else current."""
    out = outputs.groupBy("stem").agg(F.max("modified").alias("made"))
    rows = sources.groupBy("stem").agg(F.max("modified").alias("changed")).join(out, "stem", "left")
    status = F.when(F.col("made").isNull(), "missing").when(F.col("changed") > F.col("made"), "stale").otherwise("current")
    return rows.select("stem", status.alias("status"))


def open_problems(problems: DataFrame, files: DataFrame, suffix: str = " - OCR") -> DataFrame:
    """problems with covered: whether a sibling of the same name with the suffix exists."""
    siblings = files.where(F.col("name").endswith(suffix)).select(F.expr(f"left(name, length(name) - {len(suffix)})").alias("name")).distinct().withColumn("covered", F.lit(True))
    return problems.join(siblings, "name", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def best_editions(candidates: DataFrame, key: str, score: str, tier: str, size: str) -> DataFrame:
    """All candidates with the greatest score of their key, by tier, then the largest first, with their place."""
    top = candidates.groupBy(key).agg(F.max(score).alias(score))
    w = Window.partitionBy(key).orderBy(tier, F.desc(size), "candidate")
    return candidates.join(top, [key, score]).withColumn("place", F.row_number().over(w))


def backlog(cited: DataFrame, read: DataFrame, shelf: DataFrame, notes: int = 3) -> DataFrame:
    """title, lane, cites, notes of cited works (title, note) that nobody has read: unread if the shelf has them, else notondrive; lane, most cited, title."""
    works = cited.groupBy("title").agg(F.count(F.lit(1)).alias("cites"), F.slice(F.array_sort(F.collect_set("note")), 1, notes).alias("notes"))
    rest = works.join(read.select("title").distinct(), "title", "left_anti")
    held = shelf.select("title").distinct().withColumn("held", F.lit(True))
    rows = rest.join(held, "title", "left").select("title", F.when(F.col("held"), "unread").otherwise("notondrive").alias("lane"), "cites", "notes")
    return rows.orderBy("lane", F.desc("cites"), "title")


def unplaced(cited: DataFrame, *known: DataFrame) -> DataFrame:
    """title, cites of cited works that none of the known tables (paths, declarations, holdings) has, most cited first."""
    works = cited.groupBy("title").agg(F.count(F.lit(1)).alias("cites"))
    for k in known:
        works = works.join(k.select("title").distinct(), "title", "left_anti")
    return works.orderBy(F.desc("cites"), "title")


def citations(cited: DataFrame) -> DataFrame:
    """title, total, per_chapter (map from chapter to count)."""
    each = cited.groupBy("title", "chapter").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("title").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", "n")))).alias("per_chapter"))


def path_class(path: Column) -> Column:
    """URL, SANDBOX, NOT A PATH or PATH."""
    return F.when(path.rlike("(?i)^https?://"), "URL").when(path.rlike("^/(tmp|mnt|sandbox|sessions)/"), "SANDBOX").when(~path.contains("/"), "NOT A PATH").otherwise("PATH")


def path_findings(paths: DataFrame, files: DataFrame) -> DataFrame:
    """path, class of given paths (path, author): those that are none, that no file has, or whose name has no word of the author's."""
    rows = paths.withColumn("class", path_class(F.col("path"))).join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    words = lambda c: F.split(F.lower(c), "[^a-z]+")
    other = ~F.arrays_overlap(words(F.element_at(F.split("path", "/"), -1)), words(F.col("author")))
    kind = F.when(F.col("class") != "PATH", F.col("class")).when(F.col("there").isNull(), "MISSING").when(other, "AUTHOR").otherwise("OK")
    return rows.select("path", kind.alias("class"))


def prose_words(text: Column) -> Column:
    """Words of prose without note definitions and fenced code."""
    prose = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"(?m)^\[\^[^\]]+\]:.*$", " ")
    return F.size(tx.words(prose))


def index_stats(df: DataFrame, key: str, size: str, made: str) -> DataFrame:
    """One row: rows, distinct keys, megabytes with two decimals, when the newest was made."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.round(F.sum(size) / F.lit(1 << 20), 2).alias("mb"), F.max(made).alias("made"))


def eta(rows: DataFrame, status: str, seconds: str, done: str = "done", waiting: str = "waiting") -> DataFrame:
    """One row: how many are done, fail and wait, and the seconds left at the mean pace so far."""
    n = lambda s: F.count_if(F.col(status) == s)
    out = rows.agg(n(done).alias("n_done"), n(waiting).alias("n_waiting"), F.count_if(~F.col(status).isin(done, waiting)).alias("n_other"), F.avg(F.when(F.col(status) == done, F.col(seconds))).alias("pace"))
    return out.select("n_done", "n_waiting", "n_other", F.round(F.col("pace") * F.col("n_waiting"), 1).alias("seconds_left"))


def longest_alias(aliases: DataFrame) -> DataFrame:
    """book, canonical: the longest alias of each book, the first in order of equals."""
    return aliases.groupBy("book").agg(F.min(F.struct((-F.length("alias")).alias("n"), "alias"))["alias"].alias("canonical"))


def works_by_author(works: DataFrame, part: str = "", most: int = 120) -> DataFrame:
    """author, works ("title (languages)" in order) of the first `most` authors whose name has the part."""
    each = works.groupBy("author", "title").agg(F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("langs"))
    rows = each.groupBy("author").agg(F.array_join(F.array_sort(F.collect_list(F.concat("title", F.lit(" ("), "langs", F.lit(")")))), "; ").alias("works"))
    return rows.where(F.lower("author").contains(part.lower())).orderBy("author").limit(most)


def subjects(entries: DataFrame, subset: str, count: str) -> DataFrame:
    """subset, n per subset, and the total under 'total'."""
    rows = entries.groupBy(subset).agg(F.sum(count).alias("n"))
    return rows.unionByName(entries.agg(F.lit("total").alias(subset), F.sum(count).alias("n")))


def language_hint(entries: DataFrame, word: str, lang: str, most: int = 25) -> DataFrame:
    """lang of the first `most` languages that have a word, if the language asked for has not."""
    have = entries.where(F.col("word") == word).select("lang").distinct()
    asked = have.where(F.col("lang") == lang).select(F.lit(True).alias("has"))
    return have.join(asked.limit(1), how="left").where("has is null").select("lang").orderBy("lang").limit(most)


def pruned(entries: DataFrame, caps: dict[str, int], drop: list[str] = ()) -> DataFrame:
    """entries without the dropped columns, and with arrays cut to their caps."""
    return entries.select(*[F.slice(c, 1, caps[c]).alias(c) if c in caps else F.col(c) for c in entries.columns if c not in drop])


def page_faults(pages: DataFrame, patterns: dict[str, str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, fault, n: how often each pattern is in a page's text, for those that are."""
    text = pages.select(id_col, tx.strip_html(F.col(html_col)).alias("plain"))
    each = F.array(*[F.struct(F.lit(k).alias("fault"), F.regexp_count("plain", F.lit(p)).alias("n")) for k, p in patterns.items()])
    return text.select(id_col, F.explode_outer(each).alias("f")).select(id_col, "f.fault", "f.n").where("n > 0")


def shelf_signature(files: DataFrame) -> DataFrame:
    """One row: n_folders, newest: what changes when a shelf of files (path, modified) does."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.agg(F.count_distinct(folder).alias("n_folders"), F.max("modified").alias("newest"))


def ledger(lines: DataFrame) -> DataFrame:
    """book, section_no, section, row_no, cells of the pipe tables under numbered '## 1. Name' headings; header and ruler rows are not rows."""
    w = Window.partitionBy("book").orderBy("line_no")
    head = F.when(F.col("text").rlike(r"^## \d+\."), F.struct(F.regexp_extract("text", r"^## (\d+)\.", 1).cast("int").alias("no"), F.trim(F.regexp_replace("text", r"^## \d+\.", "")).alias("name")))
    rows = lines.withColumn("under", F.last(head, ignorenulls=True).over(w)).where(F.trim("text").startswith("|") & F.col("under").isNotNull() & ~F.col("text").rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    section = Window.partitionBy("book", "under.no").orderBy("line_no")
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.select("book", "under.no", "under.name", (F.row_number().over(section) - 1).alias("row_no"), cells.alias("cells"))
    return rows.where("row_no > 0").select("book", F.col("no").alias("section_no"), F.col("name").alias("section"), "row_no", "cells")
