"""Queries over embeddings. Searches take every vector whose id is divisible by 100 as a query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispark import store
from lexispark.operators import vectors as v
from lexispark.plans.registry import query, table

_D = "list_transform(embedding, lambda x: x::DOUBLE)"
_BASE = f"WITH e AS (SELECT vec_id, label, {_D} AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 100 = 0)"
_COS = "list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v))"


def _queries(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(_BASE + f"""
, s AS (SELECT query_id, vec_id, label, {_COS} AS s FROM e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, label, round(s, 6) AS similarity FROM r WHERE rank <= 10""")
def vec_topk_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    return v.search(e, _queries(spark, sf), 10).join(e.select("vec_id", "label"), "vec_id").select("query_id", "rank", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(_BASE + """
, s AS (SELECT query_id, vec_id, 1 / (1 + list_distance(q, v) ** 2) AS s FROM e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def vec_topk_l2_similarity(spark, sf):
    return v.search(table(spark, sf, "embeddings"), _queries(spark, sf), 5, "l2").withColumn("similarity", F.round("similarity", 6))


@query(_BASE + " SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM e")
def vec_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    unit = v.normalize(F.col("embedding"))
    return e.select("vec_id", F.round(v.norm(F.col("embedding")), 6).alias("norm"), F.round(unit[0], 6).alias("first"), F.round(F.element_at(unit, -1), 6).alias("last"))


@query(_BASE + ", p AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY label, i) SELECT label, (i - 1)::INTEGER AS pos, round(m, 6) AS mean FROM p")
def vec_label_centroid(spark, sf):
    rows = v.centroids_by(table(spark, sf, "embeddings"), "label")
    return rows.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


@query(_BASE + """
, p AS (SELECT b.vec_id, a.vec_id AS other, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT vec_id, min(other) AS duplicate_of, round(min_by(s, other), 6) AS similarity FROM p WHERE s >= 0.35 GROUP BY vec_id""")
def vec_earlier_duplicate(spark, sf):
    return v.earlier_duplicate(table(spark, sf, "embeddings"), 0.35).withColumn("similarity", F.round("similarity", 6))


_PLANTED = """
WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
a AS (SELECT vec_id, v FROM e UNION ALL SELECT vec_id + 1000000, [CASE WHEN i = 1 + vec_id % 64 THEN v[i] * 1.01 ELSE v[i] END FOR i IN range(1, 65)] FROM e UNION ALL SELECT vec_id + 2000000, v FROM e WHERE vec_id % 3 = 0)"""


@query(_PLANTED + """
, p AS (SELECT b.vec_id, a.vec_id AS other, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s FROM a JOIN a AS b ON a.vec_id < b.vec_id)
SELECT vec_id, min(other) AS duplicate_of, round(min_by(s, other), 5) AS similarity FROM p WHERE s >= 0.95 GROUP BY vec_id""")
def vec_near_duplicates(spark, sf):
    """Near and exact copies of every vector, made from the table, found by pivots and rings."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    bent = F.transform("embedding", lambda x, i: F.when(i == F.col("vec_id") % 64, (x * 1.01).cast("float")).otherwise(x))
    planted = e.unionByName(e.select((F.col("vec_id") + 1_000_000).alias("vec_id"), bent.alias("embedding"))).unionByName(e.where("vec_id % 3 = 0").select((F.col("vec_id") + 2_000_000).alias("vec_id"), "embedding"))
    return v.earlier_duplicate(planted, 0.95, pivots=16).withColumn("similarity", F.round("similarity", 5))


@query()
def vec_ivfpq(spark, sf):
    """Residual codes in lists; as random vectors have few neighbours, a good recall probes most lists here. Tests have clustered ones."""
    e, q = table(spark, sf, "embeddings"), _queries(spark, sf)
    index = store.once(spark, "ivfpq", f"{sf}/embeddings.parquet", lambda _: v.ResidualIndex.build(e, 16, m=16))
    return index.search(e, q, KMEANS_PROBES, 10, CANDIDATES)


@query()
def vec_graph(spark, sf):
    """Best-first search of a graph of nearest neighbours."""
    e, q = table(spark, sf, "embeddings"), _queries(spark, sf)
    graph = store.once(spark, "graph", f"{sf}/embeddings.parquet", lambda _: v.neighbour_graph(e, 16))
    return v.search_graph(graph, e, q, 10, GRAPH_EF)


def _fixed_centroids(spark, sf):
    rows = table(spark, sf, "embeddings").where("vec_id < 16").select("vec_id", "embedding").orderBy("vec_id").collect()  # the index's parameter: 16 lists
    return pd.DataFrame({"list_id": [int(r.vec_id) for r in rows], "centroid": [np.array(r.embedding, np.float64) for r in rows]})


_LISTS = """
, c AS (SELECT vec_id AS list_id, v AS c FROM e WHERE vec_id < 16),
n AS (SELECT e.vec_id, list_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(v, c), 9) DESC, list_id) AS r FROM e, c),
a AS (SELECT vec_id, list_id::INTEGER AS list_id FROM n WHERE r = 1)"""


@query(_BASE + _LISTS + " SELECT list_id, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM a GROUP BY list_id")
def vec_ivf_assign(spark, sf):
    rows = v.assign(table(spark, sf, "embeddings"), _fixed_centroids(spark, sf))
    return rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


_PROBE = """
, p AS (SELECT query_id, q, list_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, c), 9) DESC, list_id) AS r FROM q, c),
s AS (SELECT query_id, e.vec_id, list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v)) AS s FROM p JOIN a USING (list_id) JOIN e USING (vec_id) WHERE r <= 4),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s)"""


#: Lists probed of 16 for a recall of nine tenths and more on these vectors, which have few neighbours; the floor of the indexes here.
PROBES = 13
_PROBE_MORE = _PROBE.replace("r <= 4", f"r <= greatest(4, {PROBES})")


@query(_BASE + _LISTS + _PROBE_MORE + " SELECT query_id, rank::INTEGER AS rank, vec_id, round(s, 6) AS similarity FROM k WHERE rank <= 10")
def vec_ivf_topk_nprobe4(spark, sf):
    c = _fixed_centroids(spark, sf)
    lists = v.assign(table(spark, sf, "embeddings"), c)
    return v.search_lists(lists, _queries(spark, sf), c, 4, floor=PROBES).withColumn("similarity", F.round("similarity", 6))


#: The same for the trained lists of `vec_ivf_kmeans`.
KMEANS_PROBES = 14
#: Vectors per query that the product codes choose and exact similarities rank.
CANDIDATES = 100
#: Vectors that a search of the graph keeps.
GRAPH_EF = 128


@query(_BASE + _LISTS + _PROBE_MORE + " SELECT query_id, rank::INTEGER AS rank, vec_id, round(s, 6) AS similarity FROM k WHERE rank <= 10")
def vec_ivf_topk(spark, sf):
    c = _fixed_centroids(spark, sf)
    lists = v.assign(table(spark, sf, "embeddings"), c)
    return v.search_lists(lists, _queries(spark, sf), c, PROBES).withColumn("similarity", F.round("similarity", 6))


@query(_BASE + _LISTS + _PROBE_MORE + f"""
, f AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round({_COS}, 9) DESC, vec_id) AS rank FROM e, q),
o AS (SELECT f.query_id, count(k.vec_id) AS hit FROM f LEFT JOIN k ON f.query_id = k.query_id AND f.vec_id = k.vec_id AND k.rank <= 10 WHERE f.rank <= 10 GROUP BY f.query_id)
SELECT round(avg(hit / 10) * 100, 1) AS recall_pct, count(*) AS n_queries FROM o""")
def vec_recall_at_k(spark, sf):
    e, q, c = table(spark, sf, "embeddings"), _queries(spark, sf), _fixed_centroids(spark, sf)
    return v.recall(v.search_lists(v.assign(e, c), q, c, PROBES), v.search(e, q, 10), 10)


@query(_BASE + _LISTS + """
, p AS (SELECT query_id, q, list_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, c), 9) DESC, list_id) AS turn FROM q, c),
s AS (SELECT query_id, turn, e.vec_id, list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v)) AS s FROM p JOIN a USING (list_id) JOIN e USING (vec_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s)
SELECT n::INTEGER AS nprobe, round(count(*) FILTER (rank <= 10 AND turn <= n) * 100 / count(*) FILTER (rank <= 10), 1) AS recall_pct, count(*) FILTER (turn <= n) AS n_candidates FROM t, (SELECT unnest([1, 2, 4, 8, 13, 16]) AS n) GROUP BY n""")
def vec_probe_sweep(spark, sf):
    c = _fixed_centroids(spark, sf)
    return v.probe_sweep(v.assign(table(spark, sf, "embeddings"), c), _queries(spark, sf), c, [1, 2, 4, 8, 13, 16])


@query(_BASE + _LISTS + _PROBE_MORE + " SELECT query_id, rank::INTEGER AS rank, vec_id, round(s, 6) AS similarity FROM k WHERE rank <= 10")
def vec_saved_index(spark, sf):
    e, c, path = table(spark, sf, "embeddings"), _fixed_centroids(spark, sf), store.folder(spark)
    v.ListIndex.build(e.where("vec_id % 2 = 0"), path, c, "m", 16)
    v.ListIndex.build(e, path, c, "m", 2, floor=PROBES)  # the version before stays as a backup
    index = v.ListIndex.open(spark, path, "m")
    index.set_search_params(1)
    return index.search(_queries(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query(_BASE + _LISTS + _PROBE_MORE + """
, h AS (SELECT query_id, label FROM k JOIN embeddings USING (vec_id) WHERE rank <= 10) SELECT label, count(DISTINCT query_id) AS n_queries, count(*) AS n_hits FROM h GROUP BY label""")
def vec_label_hits(spark, sf):
    e, c = table(spark, sf, "embeddings"), _fixed_centroids(spark, sf)
    hits = v.search_lists(v.assign(e, c), _queries(spark, sf), c, PROBES).join(e.select("vec_id", "label"), "vec_id")
    return hits.groupBy("label").agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_hits"))


@query()
def vec_ivf_kmeans(spark, sf):
    e, q = table(spark, sf, "embeddings"), _queries(spark, sf)
    c = v.kmeans(e, 16)
    return v.search_lists(v.assign(e, c), q, c, KMEANS_PROBES)


@query()
def vec_pq(spark, sf):
    e, q = table(spark, sf, "embeddings"), _queries(spark, sf)
    books = v.train_books(e, nbits=8)
    return v.rerank(v.search_codes(v.product_codes(e, books), q, books, CANDIDATES), e, q)


@query(_BASE + f"""
, s AS (SELECT query_id, vec_id, label, {_COS} AS s FROM e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s)
SELECT label, count(DISTINCT query_id) AS matches, round(max(s), 6) AS best FROM r WHERE rank <= 10 GROUP BY label""")
def multi_query_vote(spark, sf):
    from lexispark.operators import fulltext

    e = table(spark, sf, "embeddings")
    hits = v.search(e, _queries(spark, sf), 10).join(e.select("vec_id", "label"), "vec_id")
    return fulltext.vote(hits, "label", "query_id").select("label", "matches", F.round("best", 6).alias("best"))


@query("""
WITH p AS (SELECT l_linenumber AS x, avg(l_discount) AS r, avg(l_extendedprice) AS t FROM lineitem GROUP BY 1),
g AS (SELECT x, r, max(r) OVER () AS top, (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) - (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()) AS gain FROM p)
SELECT max_by(x, gain) AS elbow, min(x) FILTER (r >= 0.99 * top) AS near_exact FROM g""")
def kneedle_elbow(spark, sf):
    points = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("r"), F.avg("l_extendedprice").alias("t"))
    return v.elbow(points, "l_linenumber", "r", "t")


@query("""
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn FROM embeddings)
SELECT vec_id, label, turn::INTEGER AS turn FROM r ORDER BY turn, label LIMIT 50""")
def round_robin_interleave(spark, sf):
    from lexispark.operators import fulltext

    return fulltext.interleave(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 50)
