"""A full-text index that is updated in place: immutable segments, tombstones, commits.

A segment is what one update added: documents and their postings. A document that is
replaced or removed gets a tombstone, which hides it in all segments before the update. A commit names
the segments and tombstones that count; it is written last, under its own number, so that a
reader sees a whole update or none of it, and of two writers that begin from one commit the
second is refused. `merge` rewrites live rows of several segments as one.

Searches are those of a written index over the live rows, and all statistics are sums over
live rows, so an updated index ranks as a fresh one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import store
from lexispark.commits import CommitLog
from lexispark.operators import fulltext

#: Segments and tombstones are named by the number of the update that wrote them and a mark of their own.
_COMMIT = "segments array<string>, tombstones array<string>, batch bigint, note string"


def _number(name: str) -> int:
    return int(name[:9])


class SegmentedIndex:
    """An updatable index under a folder that driver and executors share; one commit is one small file."""

    def __init__(self, spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.log = CommitLog(spark, f"{self.path}/commits", _COMMIT)

    def head(self) -> tuple[int, list[str], list[str]]:
        """Version, segments and tombstones of the last commit."""
        last = self.log.last()
        return (last.version, list(last.segments), list(last.tombstones)) if last else (0, [], [])

    # what is live

    def _read(self, kind: str, names: list[str]) -> DataFrame | None:
        parts = None
        for n in names:
            own = self.spark.read.parquet(f"{self.path}/{kind}/{n}").withColumn("segment", F.lit(_number(n)))
            parts = own if parts is None else parts.unionByName(own)
        return parts

    def _live(self, segments: list[str], tombstones: list[str]) -> DataFrame:
        docs = self._read("documents", segments)
        if docs is None:
            columns = "".join(f", {c} string" for c in self.keep)
            return self.spark.createDataFrame([], f"doc_id bigint, len int, content string{columns}, segment int")
        gone = self._read("tombstones", tombstones)
        if gone is None:
            return docs
        last = gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("segment").alias("upto"))
        return docs.join(last, (F.col("doc_id") == F.col("gone_id")) & (F.col("segment") < F.col("upto")), "left_anti")

    def documents(self) -> DataFrame:
        """Live documents: doc_id, len, content, kept columns, segment."""
        _, segments, tombstones = self.head()
        return self._live(segments, tombstones)

    def index(self) -> fulltext.Index:
        """The live rows as an index to search, as the last commit has them; later updates do not change it."""
        _, segments, tombstones = self.head()
        documents = self._live(segments, tombstones)
        postings = self._read("postings", segments)
        if postings is None:
            postings = self.spark.createDataFrame([], "term string, doc_id bigint, tf int, positions array<int>, segment int")
        elif tombstones:  # a term's postings are filtered before they meet the live documents
            postings = postings.join(documents.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        return fulltext.Index(postings.select("term", "doc_id", "tf", "positions"), documents.drop("segment"))

    def search(self, clauses, k: int | None = None, where=None) -> DataFrame:
        return self.index().search(clauses, k, where)

    # updates

    def diff(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, status (added, changed, same, removed): what `sync` with docs would do. Nothing is written."""
        content = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
        now = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), content.alias("now"))
        both = self.documents().select("doc_id", F.col("content").alias("was")).join(now, "doc_id", "full_outer")
        status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
        return both.select("doc_id", status.alias("status"))

    def _apply(self, fresh: DataFrame | None, gone: DataFrame | None, id_col: str, text_col: str, note: str, batch: int | None = None) -> int:
        """Write what an update adds, and tombstones of what it hides in all segments so far; then the commit."""
        base, segments, tombstones = self.head()
        name = f"{base + 1:09d}-{store.mark()}"
        if gone is not None and segments:
            gone.select("doc_id").distinct().write.parquet(f"{self.path}/tombstones/{name}")
            tombstones = [*tombstones, name]
        if fresh is not None:
            fulltext.write_postings(fresh, self.path, id_col, text_col, self.keep, name=name)
            segments = [*segments, name]
        return self.log.add(base, segments, tombstones, batch, note)

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int | None = None) -> int:
        """Add documents, or replace those that are there; a batch number that was committed before is skipped."""
        if batch is not None and not self.log.all().where(F.col("batch") == batch).isEmpty():
            return self.head()[0]
        return self._apply(docs, docs.select(F.col(id_col).cast("bigint").alias("doc_id")), id_col, text_col, "update", batch)

    def remove(self, ids: DataFrame) -> int:
        """Hide the documents of ids (doc_id)."""
        return self._apply(None, ids.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "text", "remove")

    def sync(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Make the index that of docs: only added and changed documents are read and written, removed ones are hidden."""
        plan = store.written(self.diff(docs, id_col, text_col).where("status <> 'same'"))
        wanted = plan.where("status IN ('added', 'changed')").select(F.col("doc_id").alias("_id"))
        fresh = docs.join(wanted, F.col(id_col).cast("bigint") == F.col("_id"), "left_semi")
        return self._apply(fresh, plan.where("status IN ('changed', 'removed')"), id_col, text_col, "sync")

    def merge(self, names: list[str] | None = None) -> int:
        """Rewrite the live rows of the named segments (all) as one; with all of them, no tombstone is left."""
        base, segments, tombstones = self.head()
        chosen = [s for s in segments if names is None or s in names]
        if not chosen:
            return base
        name = f"{base + 1:09d}-{store.mark()}"
        documents = self._live(segments, tombstones).where(F.col("segment").isin([_number(s) for s in chosen]))
        postings = self._read("postings", chosen).join(documents.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        documents.drop("segment").write.parquet(f"{self.path}/documents/{name}")
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        postings.drop("segment").repartitionByRange(width, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{self.path}/postings/{name}")
        rest = [s for s in segments if s not in chosen]
        return self.log.add(base, [*rest, name], tombstones if rest else [], None, "merge")

    def follow(self, stream: DataFrame, checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
        """Take every batch of a stream of documents as an update; the query, which can be stopped and resumed from its checkpoint."""
        write = lambda batch, n: self.update(batch, id_col, text_col, n)
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
