"""Workflow rules over registers: chapter locks, cards, reading backlogs, OCR ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import relational


def newest_date(text: Column) -> Column:
    return F.array_max(F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)))


def lock_status(text: Column) -> Column:
    """DEFERRED, UNLOCKED or LOCKED from the words before a parenthesis, tried in this order."""
    head = F.upper(F.regexp_extract(text, r"^([^(]*)", 1))
    return F.when(head.contains("DEFERRED"), "DEFERRED").when(head.contains("UNLOCKED"), "UNLOCKED").when(head.contains("LOCKED"), "LOCKED")


def latest_declared(lines: DataFrame, chapter: str = "chapter") -> DataFrame:
    """chapter, state, date: of all dated lines the latest date's, the later line of equals."""
    rows = lines.withColumn("state", lock_status(F.col("text"))).withColumn("date", newest_date(F.col("text"))).where("state is not null")
    return rows.groupBy(chapter).agg(F.max(F.struct(F.coalesce("date", F.lit("")).alias("date"), "line_no", "state")).alias("r")).select(chapter, "r.state", "r.date")


def reconciled(declared: DataFrame, punch: DataFrame, chapter: str = "chapter") -> DataFrame:
    """chapter, status: a locked chapter with open items is unlocked; a chapter without a declaration is taken from its items."""
    items = punch.groupBy(chapter).agg(F.count_if(~F.col("done")).alias("open"), F.count(F.lit(1)).alias("total"))
    both = declared.join(items, chapter, "full_outer").withColumn("open", F.coalesce("open", F.lit(0)))
    status = F.when((F.col("state") == "LOCKED") & (F.col("open") > 0), "UNLOCKED").otherwise(F.coalesce("state", F.when(F.col("open") > 0, "UNLOCKED").otherwise("OUT OF SYNC")))
    return both.select(chapter, status.alias("status"), "open", F.coalesce("total", F.lit(0)).alias("total"))


def read_status(works: DataFrame, claims: DataFrame, library: DataFrame, least: int = 10) -> DataFrame:
    """title, status (READ, UNREAD, NOT IN LIBRARY) of cited works against claims and library titles.

    Equal normalised titles join by equality; containment either way, also inside words, of
    titles of at least `least` characters by `relational.containing`.
    """
    key = lambda d, c: d.select(F.col(c), tx.title_norm(F.col(c)).alias("k")).where("k <> ''")
    w = key(works.select("title").distinct(), "title")

    def found(other: DataFrame) -> DataFrame:
        o = other.select(tx.title_norm(F.col("title")).alias("ok")).where("ok <> ''").distinct()
        equal = w.join(o, w["k"] == o["ok"], "left_semi").select("title")
        long_w, long_o = w.where(F.length("k") >= least), o.where(F.length("ok") >= least)
        of_w = long_w.select(F.col("title").alias("doc_id"), F.col("k").alias("text"), F.col("title").alias("item_id"), F.col("k").alias("item"))
        of_o = long_o.select(F.col("ok").alias("doc_id"), F.col("ok").alias("text"), F.col("ok").alias("item_id"), F.col("ok").alias("item"))
        inside = relational.containing(of_o.select("item_id", "item"), of_w.select("doc_id", "text")).select(F.col("doc_id").alias("title"))
        around = relational.containing(of_w.select("item_id", "item"), of_o.select("doc_id", "text")).select(F.col("item_id").alias("title"))
        return equal.unionByName(inside).unionByName(around).distinct()

    read, held = found(claims).withColumn("read", F.lit(True)), found(library).withColumn("held", F.lit(True))
    rows = works.select("title").distinct().join(read, "title", "left").join(held, "title", "left")
    return rows.select("title", F.when(F.col("read"), "READ").when(F.col("held"), "UNREAD").otherwise("NOT IN LIBRARY").alias("status"))


def collisions(blocks: DataFrame) -> DataFrame:
    """block, cards: blocks that more than one card touches (blocks has card and block)."""
    return blocks.groupBy("block").agg(F.array_sort(F.collect_set("card")).alias("cards")).where(F.size("cards") > 1)


def new_reads(reads: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Reads whose keys, with white space collapsed, no claim has; each once."""
    plain = [tx.collapse(F.coalesce(F.col(k), F.lit(""))).alias(f"_{k}") for k in keys]
    mine = reads.select("*", *plain).dropDuplicates([f"_{k}" for k in keys])
    return mine.join(claims.select(*plain).distinct(), [f"_{k}" for k in keys], "left_anti").drop(*[f"_{k}" for k in keys])


def verdict(piles: DataFrame, key: str = "note") -> DataFrame:
    """note, verdict from its clauses' piles (column pile: locator, warning, title, body, content, judgement)."""
    has = lambda p: F.count_if(F.col("pile") == p)
    rows = piles.groupBy(key).agg(has("judgement").alias("j"), has("content").alias("c"), has("body").alias("b"), F.count(F.lit(1)).alias("n"))
    out = F.when(F.col("j") > 0, "JUDGING").when((F.col("c") > 0) & (F.col("b") > 0), "MIXED").when(F.col("c") > 0, "CARRIES CONTENT").when(F.col("b") > 0, "REDUNDANT").otherwise("CLEAN")
    return rows.select(key, out.alias("verdict"))


def quorum(verdicts: DataFrame, reviewers: int = 6) -> DataFrame:
    """card, result: the newest verdict of each reviewer; PASS if all are in and none fails."""
    last = verdicts.groupBy("card", "reviewer").agg(F.max_by("verdict", "at").alias("v"))
    rows = last.groupBy("card").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "FAIL").alias("bad"))
    return rows.select("card", F.when(F.col("bad") > 0, "FAIL").when(F.col("n") >= reviewers, "PASS").otherwise("PENDING").alias("result"))


def same_words(before: Column, after: Column) -> Column:
    """Whether only case and punctuation changed."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return plain(before) == plain(after)


def ocr_queue(files: DataFrame, ledger: DataFrame, mode: str, most_failures: int = 2) -> DataFrame:
    """Files still to do in a mode: their last entry is not ok, skip or reject, and they have not failed `most_failures` times."""
    own = ledger.where(F.col("mode") == mode).groupBy("path").agg(F.max_by("status", "ts").alias("last"), F.count_if(F.col("status") == "fail").alias("failures"))
    done = own.where(F.col("last").isin("ok", "skip", "reject") | (F.col("failures") >= most_failures))
    return files.join(done, "path", "left_anti")


def ocr_accepts(row: dict[str, Column] | None = None) -> Column:
    """Pages equal; enough characters for a scan, or at least 98 in 100 of before for a rewrite."""
    c = row or {k: F.col(k) for k in ("pages_before", "pages_after", "chars_before", "chars_after")}
    scan = c["chars_before"] < F.greatest(F.lit(100), c["pages_before"] * 15)
    enough = F.when(scan, c["chars_after"] >= F.greatest(F.lit(100), c["pages_before"] * 15)).otherwise(c["chars_after"] * 100 >= c["chars_before"] * 98)
    return (c["pages_before"] == c["pages_after"]) & enough


def snapshot_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, status of two trees by content digest: same, changed, new, gone."""
    a, b = left.select("path", F.sha2("content", 256).alias("was")), right.select("path", F.sha2("content", 256).alias("now"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))
