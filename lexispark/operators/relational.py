"""Joins, aggregations and ordered-group operators of corpus stores, on any DataFrame."""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark import store


def top_groups(df: DataFrame, key: str, n: int, missing: str = "(unspecified)") -> DataFrame:
    """key, n of the most frequent keys, ties by key; null keys are named."""
    named = df.groupBy(F.coalesce(F.col(key), F.lit(missing)).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return named.orderBy(F.desc("n"), key).limit(n)


def joined_names(df: DataFrame, key: str, name: str, sep: str = "; ") -> DataFrame:
    """key, names: distinct names in order, joined."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), sep).alias("names"))


def latest(df: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """The last row of each key by `order`, as an aggregation that combines before the shuffle."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in take if c not in order])).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in take])


def best_record(df: DataFrame, key: str, rank: Column, seq: str, take: list[str]) -> DataFrame:
    """The row of the greatest rank per key, the earliest of equals."""
    best = df.groupBy(key).agg(F.max(F.struct(rank.alias("rank"), (-F.col(seq)).alias("neg"), *take)).alias("best"))
    return best.select(key, F.col("best.rank").alias("rank"), *[F.col(f"best.{c}").alias(c) for c in take])


def tiers(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first non-empty tier per key: exact, then prefix, then search."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("tier", F.lit(i))
        out = p if out is None else out.unionByName(p)
    first = out.groupBy(*key).agg(F.min("tier").alias("tier"))
    return out.join(first, [*key, "tier"])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, signature: str) -> DataFrame:
    """key, status (added, removed, changed, same) of two snapshots."""
    a = old.select(key, F.col(signature).alias("was"))
    b = new.select(key, F.col(signature).alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def merge_index(index: DataFrame, fresh: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    """The index with rows of removed and changed keys taken out and the fresh ones put in."""
    gone = diff.where(F.col("status").isin("removed", "changed")).select(key)
    return index.join(gone, key, "left_anti").unionByName(fresh)


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows on either side alone, and whether the tables align."""
    both = left.select(key, F.lit(1).alias("l")).join(right.select(key, F.lit(1).alias("r")), key, "full_outer")
    return both.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only")).withColumn("aligned", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def synonyms(words: DataFrame, word: str = "word", group: str = "group") -> DataFrame:
    """word, n_synonyms: other words that share a group, without listing the pairs of a group."""
    pairs = words.select(word, group).distinct()
    size = pairs.groupBy(group).agg((F.count(F.lit(1)) - 1).alias("others"))
    return pairs.join(size, group).groupBy(word).agg(F.sum("others").alias("n_synonyms"))


def reachable(edges: DataFrame, start: DataFrame, most_hops: int | None = None) -> DataFrame:
    """node, hops: breadth-first from the start nodes until no node is new, or most_hops; cycles end by themselves.

    Every frontier is a written table, so that plans stay short and lost executors cost one hop.
    """
    spark, base = start.sparkSession, store.folder(start.sparkSession)

    def written(rows: DataFrame, hop: int) -> DataFrame:
        rows.select("node", F.lit(hop).alias("hops")).write.parquet(f"{base}/{hop}")
        return spark.read.schema(schema).parquet(f"{base}/{hop}")

    first = start.select("node").distinct()
    schema = first.select("node", F.lit(0).alias("hops")).schema
    frontier, hops = written(first, 0), 1
    while most_hops is None or hops <= most_hops:
        seen = spark.read.schema(schema).parquet(*[f"{base}/{h}" for h in range(hops)])
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti"), hops)
        if frontier.isEmpty():
            break
        hops += 1
    return spark.read.schema(schema).parquet(*[f"{base}/{h}" for h in range(hops)])


#: Short items that one automaton holds at most: rows, and characters.
ITEM_BLOCK, ITEM_CHARS = 200_000, 4_000_000


def _item_blocks(items: DataFrame, most_rows: int, most_chars: int):
    """(item ids as Arrow, items) of blocks of bounded size; one block in the driver at a time."""
    from pyspark.sql.pandas.types import to_arrow_type

    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("chars")).first()
    blocks = max(-(-size["n"] // most_rows), -(-size["chars"] // most_chars))
    if not blocks:
        return
    kind = to_arrow_type(items.schema["item_id"].dataType)
    dealt = items.withColumn("ib", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).repartition(blocks, "ib")
    for row in dealt.groupBy("ib").agg(F.collect_list(F.struct("item_id", "item")).alias("rows")).toLocalIterator():
        yield pa.array([r["item_id"] for r in row["rows"]], kind), [r["item"] for r in row["rows"]]


_AUTOMATA: dict = {}


def _automaton(packed: bytes):
    """The automaton of a block of terms, made once by a worker: each distinct term leads to the rows that have it."""
    import ahocorasick

    if packed not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        rows: dict[str, list[int]] = {}
        for i, term in enumerate(json.loads(zlib.decompress(packed))):
            rows.setdefault(term, []).append(i)
        for term, own in rows.items():
            if term:
                made.add_word(term, own)
        made.make_automaton()
        _AUTOMATA[packed] = made, rows.get("", [])
    return _AUTOMATA[packed]


def terms_in(items: DataFrame, docs: DataFrame, most_rows: int | None = None, most_chars: int | None = None) -> DataFrame:
    """item_id, doc_id of the docs (doc_id, text) that contain an item (item_id, item), each pair once.

    The items of a block are one Aho-Corasick automaton, through which every text is read
    once, whatever the number of items. An empty item is in every text, a null one in none.
    """
    items, docs = items.select("item_id", "item").where("item IS NOT NULL"), docs.select("doc_id", "text").where("text IS NOT NULL")
    schema = T.StructType([items.schema["item_id"], docs.schema["doc_id"]])

    def search(ids: pa.Array, packed: bytes):
        def each(batches):
            made, everywhere = _automaton(packed)
            for batch in batches:
                found, at = [], []
                for n, text in enumerate(batch.column(1).to_pylist()):
                    hits = set(everywhere)
                    if len(made):
                        for _, rows in made.iter(text):
                            hits.update(rows)
                    found += hits
                    at += [n] * len(hits)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found, pa.int64())), batch.column(0).take(pa.array(at, pa.int64()))], ["item_id", "doc_id"])

        return each

    out = None
    for ids, terms in _item_blocks(items, most_rows or ITEM_BLOCK, most_chars or ITEM_CHARS):
        part = docs.mapInArrow(search(ids, zlib.compress(json.dumps(terms).encode())), schema)
        out = part if out is None else out.unionByName(part)
    return items.sparkSession.createDataFrame([], schema) if out is None else out


def containing(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id of the docs (doc_id, text) that contain an item (item_id, item).

    Items of five words or more meet documents by their second to fourth word, which are whole words of any text
    around them. Shorter items have no such words: `terms_in` finds them.
    """
    words = lambda c: F.split(c, r"[ \n]")
    split = items.withColumn("ws", words(F.col("item")))
    keyed = split.where(F.size("ws") >= 5).select("item_id", F.concat_ws(" ", F.get("ws", F.lit(1)), F.get("ws", F.lit(2)), F.get("ws", F.lit(3))).alias("key"))
    run = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)))
    runs = docs.select("doc_id", words(F.col("text")).alias("ws")).select("doc_id", F.explode_outer(F.array_distinct(run)).alias("key"))
    pairs = runs.join(keyed, "key").select("doc_id", "item_id").distinct()
    hits = pairs.join(items, "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("item"))).select("item_id", "doc_id")
    return hits.unionByName(terms_in(split.where(F.size("ws") < 5), docs))


def nearest_within(left: DataFrame, right: DataFrame, key: str, at: str, width: float, id_col: str) -> DataFrame:
    """For each left row the nearest right row of the same key within `width`: an equi-join on key and bucket, then the distance.

    A right row stands in its bucket and both neighbours, so every pair within the width meets once.
    """
    bucket = F.floor(F.col(at) / width)
    l = left.select(F.col(id_col).alias("left_id"), key, F.col(at).alias("left_at"), bucket.alias("bucket"))
    r = right.select(F.col(id_col).alias("right_id"), key, F.col(at).alias("right_at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    near = l.join(r, [key, "bucket"]).where((F.col("left_id") != F.col("right_id")) & (F.abs(F.col("left_at") - F.col("right_at")) <= width))
    best = near.groupBy("left_id").agg(F.min(F.struct(F.abs(F.col("left_at") - F.col("right_at")).alias("distance"), "right_id")).alias("b"), F.count(F.lit(1)).alias("n_near"))
    return best.select("left_id", F.col("b.right_id").alias("right_id"), F.col("b.distance").alias("distance"), "n_near")


def chain_walk(links: DataFrame, starts: DataFrame, most: int = 30) -> DataFrame:
    """start, hops, last, cyclic: how far links (node, next: one per node) lead from every start, `most` steps at most.

    All walks step together, one join a hop on a written table; a walk that comes back to its own path ends there.
    """
    spark = starts.sparkSession
    base = store.folder(spark)
    step = links.select(F.col("node").alias("last"), F.col("next").alias("then"))
    walks = starts.select(F.col("node").alias("start"), F.col("node").alias("last"), F.array("node").alias("path"), F.lit(False).alias("cyclic"))
    done = None
    for hop in range(1, most + 1):
        moved = walks.join(step, "last", "left")
        back = F.array_contains("path", F.col("then"))
        stay = moved.where(F.col("then").isNull() | F.coalesce(back, F.lit(False))).select("start", (F.size("path") - 1).alias("hops"), "last", F.coalesce(back, F.lit(False)).alias("cyclic"))
        on = moved.where(F.col("then").isNotNull() & ~F.coalesce(back, F.lit(False))).select("start", F.col("then").alias("last"), F.concat("path", F.array("then")).alias("path"), F.lit(False).alias("cyclic"))
        stay.write.parquet(f"{base}/done/{hop}")
        on.write.parquet(f"{base}/on/{hop}")
        done = spark.read.schema(stay.schema).parquet(*[f"{base}/done/{h}" for h in range(1, hop + 1)])
        walks = spark.read.schema(on.schema).parquet(f"{base}/on/{hop}")
        if walks.isEmpty():
            return done
    return done.unionByName(walks.select("start", (F.size("path") - 1).alias("hops"), "last", "cyclic"))


def unchanged(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """files with skip: whether the manifest has the file with the same size and time."""
    known = manifest.select(key, F.col("size").alias("was_size"), F.col("modified").alias("was_modified"))
    rows = files.join(known, key, "left")
    return rows.withColumn("skip", F.coalesce((F.col("size") == F.col("was_size")) & (F.col("modified") == F.col("was_modified")), F.lit(False))).drop("was_size", "was_modified")


def titles_in_names(titles: DataFrame, files: DataFrame, norm) -> DataFrame:
    """title, name: files whose name has the title, both normalised, from the start of a segment (between ' - ').

    A title of one word must be a whole segment; a longer one may go on inside its segment
    and past its end, as long as it ends with a whole word. They meet by the segment's first word.
    """
    t = titles.select("title", norm(F.col("title")).alias("k")).where("k <> ''").withColumn("first", F.split("k", " ")[0])
    parts = F.transform(F.split("name", " - "), lambda p: norm(p))
    f = files.select("name", F.posexplode(parts).alias("at", "segment"), parts.alias("parts")).where("segment <> ''")
    rest = F.array_join(F.filter(F.slice("parts", F.col("at") + 1, F.size("parts")), lambda p: p != ""), " ")
    f = f.select("name", "segment", rest.alias("rest")).withColumn("first", F.split("segment", " ")[0])
    whole = F.col("segment") == F.col("k")
    begun = F.col("k").contains(" ") & ((F.col("rest") == F.col("k")) | F.col("rest").startswith(F.concat("k", F.lit(" "))))
    return t.join(f, "first").where(whole | begun).select("title", "name").distinct()
