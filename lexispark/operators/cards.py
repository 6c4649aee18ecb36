"""Cards: versioned proposals over blocks of text, their reads, closings, plans and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import text as tx


def appended(store: DataFrame, new: DataFrame, order: str, card: str = "card", version: str = "version") -> DataFrame:
    """store and new, whose rows get the next version numbers of their cards in `order`."""
    last = store.groupBy(card).agg(F.max(version).alias("last"))
    w = Window.partitionBy(card).orderBy(order)
    numbered = new.join(last, card, "left").withColumn(version, (F.coalesce("last", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("last")
    return store.unionByName(numbered)


def counts(cards: DataFrame, status: str, lane: str) -> DataFrame:
    return cards.groupBy(status, lane).agg(F.count(F.lit(1)).alias("n"))


def families(touched: DataFrame, notes: DataFrame) -> DataFrame:
    """card, blocks: the blocks a card touches (card, block, note), and those that define the notes it touches (note, block)."""
    own = touched.where("block is not null").select("card", "block")
    through = touched.where("note is not null").select("card", "note").join(notes, "note").select("card", "block")
    return own.unionByName(through).groupBy("card").agg(F.array_sort(F.collect_set("block")).alias("blocks"))


def on_closed(cards: DataFrame, events: DataFrame, closing: list[str], reopening: str) -> DataFrame:
    """card, block, closed_at: cards (card, block) on blocks that an event (block, kind, at) has closed and none has reopened since."""
    state = events.groupBy("block").agg(F.max(F.when(F.col("kind").isin(closing), F.col("at"))).alias("closed_at"), F.max(F.when(F.col("kind") == reopening, F.col("at"))).alias("opened_at"))
    shut = state.where("closed_at is not null and (opened_at is null or opened_at <= closed_at)").select("block", "closed_at")
    return cards.select("card", "block").distinct().join(shut, "block").select("card", "block", "closed_at")


def apply_plan(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """segment_id, action of segments (segment_id, block, before, after) against the lines as they are (block, text).

    By block: already-applied if the line is what it should become, replace if it is what it
    was, else drift. Without a block, or without a line of that name, by the text before: replace where it stands
    once, insert for an empty one, else refuse-none or refuse-many.
    """
    now = lines.select("block", tx.collapse(F.col("text")).alias("now"))
    plain = segments.select("segment_id", "block", tx.collapse(F.coalesce("before", F.lit(""))).alias("was"), tx.collapse(F.col("after")).alias("to"))
    by_text = now.groupBy(F.col("now").alias("was")).agg(F.count(F.lit(1)).alias("places"))
    rows = plain.join(now, "block", "left").join(by_text, "was", "left").withColumn("places", F.coalesce("places", F.lit(0)))
    named = F.when(F.col("now") == F.col("to"), "already-applied").when(F.col("now") == F.col("was"), "replace").otherwise("drift")
    loose = F.when(F.col("was") == "", "insert").when(F.col("places") == 1, "replace").when(F.col("places") == 0, "refuse-none").otherwise("refuse-many")
    return rows.select("segment_id", F.when(F.col("now").isNotNull(), named).otherwise(loose).alias("action"))


def read_log(reads: DataFrame, claims: DataFrame, events: DataFrame, keys: list[str], order: list[str], number: str = "number") -> DataFrame:
    """New rows of the log: reads whose keys, white space collapsed, neither claims nor events have, each once, numbered on from the claims' greatest number.

    The numbers run over the whole log: rows are counted by partition of a range, so that no task orders them all.
    """
    plain = [tx.collapse(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(f"_{k}") for k in keys]
    names = [f"_{k}" for k in keys]
    fresh = reads.select("*", *plain).dropDuplicates(names)
    for known in (claims, events):
        fresh = fresh.join(known.select(*plain).distinct(), names, "left_anti")
    return numbered(fresh.drop(*names), order, number, claims.agg(F.coalesce(F.max(number), F.lit(0)).alias("base")))


def numbered(rows: DataFrame, order: list[str], number: str, base: DataFrame) -> DataFrame:
    """rows with consecutive numbers in `order`, after the one of the table base (one row): ranks inside parts of a range of the order, and the parts' sizes."""
    part = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part").orderBy(*order)
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    out = part.withColumn("inside", F.row_number().over(inner)).join(F.broadcast(before), "part").join(F.broadcast(base))
    return out.withColumn(number, (F.col("base") + F.col("before") + F.col("inside")).cast("bigint")).drop("part", "inside", "before", "base")


def guard(status: Column, held: Column, n_versions: Column, missing: Column, newest: Column, most_versions: int = 3) -> Column:
    """Why a card may not go on, or OK: fields first, then closings, holds, the version stop, and only the newest approved version is applied."""
    return (
        F.when(missing > 0, "FIELDS").when(status.isin("applied", "superseded"), "CLOSED").when(held, "HELD").when(n_versions > most_versions, "STOP").when((status == "approved") & ~newest, "OLD VERSION").otherwise("OK")
    )


def gate(failed: dict[str, Column]) -> Column:
    """The first failed gate's lane in the given order, else ready."""
    out = None
    for lane, hit in failed.items():
        out = F.when(hit, lane) if out is None else out.when(hit, lane)
    return out.otherwise("ready")


def audit_state(texts: DataFrame, audits: DataFrame) -> DataFrame:
    """id, state of texts (id, text, session) against audits (id, hash, session): audited, stale, own-session (audited by who wrote it) or unrun."""
    now = texts.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("now"), F.col("session").alias("writer"))
    rows = now.join(audits.select("id", "hash", "session"), "id", "left")
    state = F.when(F.col("hash").isNull(), "unrun").when(F.col("hash") != F.col("now"), "stale").when(F.col("session") == F.col("writer"), "own-session").otherwise("audited")
    return rows.select("id", state.alias("state"))


def unaccepted_bulks(writes: DataFrame, accepted: DataFrame, sample_max: int) -> DataFrame:
    """batch, n of batches of more writes than a sample that nobody has accepted."""
    big = writes.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > sample_max)
    return big.join(accepted.select("batch").distinct(), "batch", "left_anti")


def open_asks(lines: DataFrame, opens: str = "## Open", closes: str = "## Answered") -> DataFrame:
    """book, line_no, ask: list items between the two headings; lines that follow an item belong to it until the next one."""
    w = Window.partitionBy("book").orderBy("line_no")
    head = F.when(F.col("text").startswith("## "), F.col("text"))
    rows = lines.withColumn("under", F.last(head, ignorenulls=True).over(w)).where((F.col("under") == opens) & head.isNull())
    item = F.when(F.col("text").startswith("- "), F.col("line_no"))
    rows = rows.withColumn("item", F.last(item, ignorenulls=True).over(w)).where("item is not null and trim(text) <> ''")
    joined = rows.groupBy("book", "item").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    return joined.select("book", F.col("item").alias("line_no"), F.regexp_replace(F.array_join(F.transform("ls", lambda l: F.trim(l["text"])), " "), "^- ", "").alias("ask"))


#: A warning to the reader, as notes word it.
WARNING = r"(?i)^(?:note that|beware|caution|but see|compare|cf\.)"


def note_piles(notes: DataFrame, body: DataFrame, locators: dict[str, str], key: str = "note") -> DataFrame:
    """note, sentence_no, pile of every sentence of notes (note, text): locator, warning, title, body (its words are the body's) or content."""
    rows = notes.select(key, F.posexplode(tx.sentences(F.col("text"))).alias("at", "sentence")).join(body.select(key, F.col("text").alias("around")), key, "left")
    anchored = None
    for p in locators.values():
        anchored = F.col("sentence").rlike(p) if anchored is None else anchored | F.col("sentence").rlike(p)
    said = F.coalesce(F.col("around").contains(F.col("sentence")), F.lit(False))
    pile = F.when(anchored, "locator").when(F.col("sentence").rlike(WARNING), "warning").when(tx.is_title_cased(F.col("sentence")), "title").when(said, "body").otherwise("content")
    return rows.select(key, (F.col("at") + 1).alias("sentence_no"), pile.alias("pile"))


def write_guard(before: DataFrame, after: DataFrame, writer: str, declared: list[str]) -> DataFrame:
    """One row: n_lost, n_twice, n_changed, verdict of a write of blocks (block, text) over what was there.

    An undeclared writer, lost blocks and blocks that stand twice are refused; a write that
    changes nothing makes no event.
    """
    twice = after.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    now = after.groupBy("block").agg(F.min("text").alias("now"))
    both = before.select("block", F.col("text").alias("was")).join(now, "block", "full_outer").join(twice, "block", "left")
    rows = both.agg(
        F.count_if(F.col("n").isNull()).alias("n_lost"),
        F.count_if(F.col("n") > 1).alias("n_twice"),
        F.count_if(F.col("n").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))).alias("n_changed"),
    )
    verdict = F.when(F.lit(writer not in declared), "UNDECLARED").when(F.col("n_lost") > 0, "LOST").when(F.col("n_twice") > 0, "TWICE").when(F.col("n_changed") == 0, "UNCHANGED").otherwise("WRITE")
    return rows.withColumn("verdict", verdict)


#: Parts of a text that are not its author's prose: code, quotations, italics.
NOT_PROSE = ("`[^`]*`", "[“\"][^”\"]*[”\"]", r"[*_][^*_]+[*_]")


def word_hits(cards_: DataFrame, chapters: DataFrame, pattern: str, carve: str | None = None, own: DataFrame | None = None) -> DataFrame:
    """card, hit: banned words of cards (card, block, text) outside code, quotations and italics, without those near a carve-out,
    those that the author uses themselves (own: word), and those that the chapter's block has unchanged (chapters: block, text)."""
    prose = F.col("text")
    for p in NOT_PROSE:
        prose = F.regexp_replace(prose, p, " ")
    rows = cards_.select("card", "block", F.explode_outer(F.regexp_extract_all(prose, F.lit(f"(?i)(.{{0,20}}\\b(?:{pattern})\\b.{{0,20}})"), F.lit(1))).alias("around")).where("around is not null")
    if carve:
        rows = rows.where(~F.col("around").rlike(carve))
    rows = rows.withColumn("hit", F.lower(F.regexp_extract("around", f"(?i)\\b({pattern})\\b", 1)))
    if own is not None:
        rows = rows.join(own.select(F.lower("word").alias("hit")).distinct(), "hit", "left_anti")
    there = chapters.select("block", F.lower("text").alias("chapter"))
    rows = rows.join(there, "block", "left").where(~F.coalesce(F.col("chapter").contains(F.col("hit")), F.lit(False)))
    return rows.select("card", "hit")


def healed(vectors: DataFrame, metadata: DataFrame, place: str = "place") -> DataFrame:
    """metadata cut to what the vectors have: rows beyond the first gap of places that both have are an interrupted write and go."""
    have = vectors.select(place).distinct().join(metadata.select(place).distinct(), place)
    n = have.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(place), F.lit(-1)).alias("last"))
    # without a gap the places are 0 .. n - 1; else they end where the first place is missing
    gap = have.select((F.col(place) + 1).alias(place)).join(have, place, "left_anti").agg(F.min(place).alias("first"))
    start = have.where(F.col(place) == 0).agg(F.count(F.lit(1)).alias("zero"))
    bound = n.join(gap).join(start).select(F.when(F.col("zero") > 0, F.col("first")).otherwise(0).alias("bound"))  # one row each
    return metadata.join(F.broadcast(bound), F.col(place) < F.col("bound")).drop("bound")


def note_checks(notes: DataFrame, body: DataFrame, rulings: DataFrame, paraphrase: float = 0.8) -> DataFrame:
    """card, note, class of what cards do with notes (card, note, text, action): CONFLICT with a ruling (note, ruling) for another
    action, PARAPHRASE if so great a share of its longer words is the body's (note, text), else OK."""
    rows = notes.join(rulings.groupBy("note").agg(F.collect_set("ruling").alias("ruled")), "note", "left").join(body.select("note", F.col("text").alias("around")), "note", "left")
    against = F.coalesce(F.size(F.array_except("ruled", F.array("action"))) > 0, F.lit(False))
    share = tx.word_share(F.col("text"), F.coalesce("around", F.lit("")))
    return rows.select("card", "note", F.when(against, "CONFLICT").when(share >= paraphrase, "PARAPHRASE").otherwise("OK").alias("class"))


def directives_open(events: DataFrame, closing: list[str]) -> DataFrame:
    """card, directed_at, n_versions of cards (card, kind, at) whose last directive no closing event has answered, with the versions since."""
    last = events.groupBy("card").agg(F.max(F.when(F.col("kind") == "directive", F.col("at"))).alias("directed_at"), F.max(F.when(F.col("kind").isin(closing), F.col("at"))).alias("closed_at"))
    still = last.where("directed_at is not null and (closed_at is null or closed_at < directed_at)").select("card", "directed_at")
    since = events.where("kind = 'version'").join(still, "card").where("at > directed_at").groupBy("card").agg(F.count(F.lit(1)).alias("n"))
    return still.join(since, "card", "left").select("card", "directed_at", F.coalesce("n", F.lit(0)).alias("n_versions"))
