"""Exact top-k retrieval that reads only postings that can matter.

Documents are cut into ranges: by length, as that and the term's count decide what a term
adds to a score, and within a length by id. For each term and range the greatest
impact is known (what the term adds before its idf). A search adds the bounds of its terms
by range, scores the ranges with the greatest bounds first, and then those whose bound
reaches the k-th best score so far: the others hold no document of the first k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import fulltext

#: Ids of a range are those that differ in so many low bits; lengths of a range are within a factor of 2^(1/STEPS).
RANGE_BITS, STEPS = 10, 4
#: Ranges that are scored first.
FIRST = 16
_TOLERANCE = 1e-9


def _impact() -> Column:
    """What a term adds to a document's score, over its idf."""
    tf, k1, b = F.col("tf"), fulltext.K1, fulltext.B
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))


def build(index: fulltext.Index, path: str) -> ImpactIndex:
    """Write impacts by term and range, and the bounds of each range, under path."""
    stats = index.documents.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"))
    stats.write.parquet(f"{path}/stats")
    place = F.floor(F.log2(F.col("len") + 1) * STEPS).cast("bigint")
    known = "len" in index.postings.columns
    rows = index.postings.select("term", "doc_id", "tf", "len") if known else index.postings.select("term", "doc_id", "tf").join(index.documents.select("doc_id", "len"), "doc_id")
    rows = rows.join(F.broadcast(stats.select("mean_len")))  # one row
    # equal high bits of the id and equal lengths are one range
    rows = rows.select("term", F.struct(place.alias("len"), F.shiftright("doc_id", RANGE_BITS).alias("ids")).alias("range"), "doc_id", _impact().alias("impact"))
    width = int(index.documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(width, "term", "range", "doc_id").sortWithinPartitions("term", "range", "doc_id").write.option("compression", "zstd").parquet(f"{path}/impacts")
    made = index.documents.sparkSession.read.parquet(f"{path}/impacts")
    bounds = made.groupBy("term", "range").agg(F.max("impact").alias("best"), F.count(F.lit(1)).alias("n"))
    bounds.repartitionByRange(width, "term", "range").sortWithinPartitions("term", "range").write.parquet(f"{path}/bounds")
    return ImpactIndex(index.documents.sparkSession, path)


class ImpactIndex:
    """Impacts, bounds and statistics as written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.impacts, self.bounds, self.stats = (spark.read.parquet(f"{path}/{p}") for p in ("impacts", "bounds", "stats"))

    def weights(self, terms: list[str]) -> DataFrame:
        """term, idf of the terms that the collection has."""
        df = self.bounds.where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.greatest(F.lit(fulltext.LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        return df.join(F.broadcast(self.stats.select("n"))).select("term", idf.alias("idf"))  # one row of statistics

    def ranges(self, weights: dict[str, float], every: bool) -> DataFrame:
        """range, bound: how much a document of the range can score at most; with `every`, only ranges that have all terms."""
        own = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        rows = self.bounds.where(F.col("term").isin(list(weights)))
        out = rows.groupBy("range").agg(F.sum(F.col("best") * F.element_at(own, F.col("term"))).alias("bound"), F.count(F.lit(1)).alias("n_terms"))
        return (out.where(F.col("n_terms") == len(weights)) if every else out).select("range", "bound")

    def scores(self, weights: dict[str, float], ranges: DataFrame, every: bool) -> DataFrame:
        """doc_id, score of the documents of the ranges."""
        own = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        hits = self.impacts.where(F.col("term").isin(list(weights))).join(ranges.select("range"), "range", "left_semi")
        out = hits.groupBy("doc_id").agg(F.sum(F.element_at(own, F.col("term")) * F.col("impact")).alias("score"), F.count(F.lit(1)).alias("n_terms"))
        return (out.where(F.col("n_terms") == len(weights)) if every else out).select("doc_id", "score")

    def top(self, terms: list[str], k: int, every: bool = True) -> DataFrame:
        """doc_id, score of the k best documents with every term (or any), ties by id: those of the full ranking."""
        terms = sorted(set(terms))
        weights = {r.term: r.idf for r in self.weights(terms).collect()}  # the query's terms
        if not weights or (every and len(weights) < len(terms)) or k <= 0:
            return self.impacts.sparkSession.createDataFrame([], "doc_id bigint, score double")
        return self._best(self.scores(weights, self.wanted(weights, k, every), every), k)

    def wanted(self, weights: dict[str, float], k: int, every: bool = True) -> DataFrame:
        """range, bound of the ranges that may hold one of the k best."""
        ranges = self.ranges(weights, every)
        first = ranges.orderBy(F.desc("bound"), "range").limit(FIRST)
        best = self._best(self.scores(weights, first, every), k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        return ranges if best.n < k else ranges.where(F.col("bound") >= best.least - _TOLERANCE)

    @staticmethod
    def _best(scores: DataFrame, k: int) -> DataFrame:
        return scores.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)
