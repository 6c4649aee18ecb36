"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate so that its expected number of rows is its
share of the target total. A document's count is the hash-seeded Poisson quantile of
that rate: a uniform number from MD5(seed, id) is looked up in the distribution's
cumulative table. Each copy is a row of its own, and rows leave in the order of a hash
of (seed, id, copy), dealt over the partitions by that hash.

Defined results: null sources form a source of their own; a source without a
weight (also the null one) gets `default_weight`; repeated rows draw the same count; null ids draw as the id
'' does; null and empty texts are rows like any other; weights that are all 0 or an empty
table give no rows. Extra columns of any name travel along in `mixed_rows`; `mix_sources`, which has the
columns of docs side by side with those in `ADDED`, refuses docs that have one of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.scratch import materialize

ADDED = ("copy_no", "n_copies", "shuffle_key")
_HEX = 13  # hex digits of the uniform number: 52 bits, exact in a double
#: Bytes of rates (names and tables) that are broadcast; more are joined by (source, salt).
BROADCAST_BYTES = 32 << 20
SALTS = 64
_TABLE = 64  # entries of the cumulative table beyond the mean
_REACH = 10  # standard deviations about the mean that it spans


def uniform(seed: int, doc_id: Column) -> Column:
    """In [0, 1), the same in every engine that has MD5."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, _HEX)
    return F.conv(hexed, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << (4 * _HEX)))


def poisson_least(rate: Column) -> Column:
    """The number of events where the table of this rate begins; 0 for rates of up to _REACH squared."""
    return F.greatest(F.lit(0), F.floor(rate - _REACH * F.sqrt(rate))).cast("int")


def poisson_table(rate: Column, least: Column) -> Column:
    """Cumulative probabilities of least, least + 1, ... events at this rate; fewer and more are below what a double tells.

    exp(-rate) is 0 at high rates: a table that begins above 0 starts from 1 and is divided by its sum.
    """
    start = F.when(least == 0, F.exp(-rate)).otherwise(F.lit(1.0))
    return F.aggregate(
        F.sequence(least + 1, (F.ceil(rate + _REACH * F.sqrt(rate)) + _TABLE).cast("int")),
        F.struct(start.alias("p"), F.array(start).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf"),
        ),
        lambda acc: F.when(least == 0, acc["cdf"]).otherwise(F.transform(acc["cdf"], lambda c: c / F.element_at(acc["cdf"], -1))),
    )


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, total_rate: float, source_col: str) -> DataFrame:
    """Per source: n_rows, rate, least, cdf; one row per source."""
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("n_rows"))
    weight = F.lit(float(default_weight))
    if weights:
        given = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(w))])
        weight = F.coalesce(F.element_at(given, F.col("mix_source")), weight)
    sums = counts.withColumn("weight", weight)
    totals = sums.agg(F.sum("weight").alias("sum_weight"), F.sum("n_rows").alias("sum_rows"))
    return (
        sums.join(totals, how="cross")  # one row
        .where("weight > 0")
        .withColumn("rate", F.col("weight") / F.col("sum_weight") * F.lit(float(total_rate)) * F.col("sum_rows") / F.col("n_rows"))
        .withColumn("least", poisson_least(F.col("rate")))
        .withColumn("cdf", poisson_table(F.col("rate"), F.col("least")))
        .select("mix_source", "n_rows", "rate", "least", "cdf")
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    default_weight: float = 1.0,
    total_rate: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The rows of docs, each as often as drawn, with copy_no (from 1), n_copies and shuffle_key, in shuffled order.

    total_rate is the expected number of rows as a multiple of the input's.
    """
    if clash := sorted({c.lower() for c in docs.columns} & set(ADDED)):
        raise ValueError(f"docs has columns that mixing adds: {', '.join(clash)}; use mixed_rows or rename them")
    return mixed_rows(docs, weights, default_weight, total_rate, seed, id_col, source_col).select("row.*", *ADDED)


def mixed_rows(
    docs: DataFrame,
    weights: dict[str, float],
    default_weight: float = 1.0,
    total_rate: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """As `mix_sources`, with the columns of docs in one column `row`."""
    rates = materialize(source_rates(docs, weights, default_weight, total_rate, source_col)).select("mix_source", F.col("least").alias("mix_least"), "cdf")
    # the row travels as one column, so that its names meet none of ours
    tagged = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("mix_source"))
    size = rates.agg(F.sum(F.length(F.coalesce("mix_source", F.lit(""))) + 8 * F.size("cdf") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = tagged.join(F.broadcast(rates.withColumnRenamed("mix_source", "of")), F.col("mix_source").eqNullSafe(F.col("of")))
    else:  # deal each source's documents over SALTS keys; the table of rates is repeated for each
        salted = tagged.withColumn("mix_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        copies = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        copies = copies.withColumnsRenamed({"mix_source": "of", "mix_salt": "of_salt"})
        joined = salted.join(copies, F.col("mix_source").eqNullSafe(F.col("of")) & (F.col("mix_salt") == F.col("of_salt")))
    drawn = joined.withColumn("u", uniform(seed, F.col("id")))
    drawn = drawn.select("row", "id", (F.col("mix_least") + F.size(F.filter("cdf", lambda c: F.col("u") >= c))).alias("n_copies")).where("n_copies > 0")
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), "id", F.col("copy_no").cast("string")))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.withColumn("shuffle_key", key).repartition(width, "shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("row", *ADDED)


#: Production mix of the corpus query: the oversized source comes down, two come up.
MIX = {"src0": 2.0, "src1": 3.0, "src2": 1.5, "src3": 0.5}
MIX_TOTAL, MIX_SEED = 1.1, 17


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_sources(docs, MIX, 1.0, MIX_TOTAL, MIX_SEED)
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "copy_no", "n_copies", "shuffle_key")


ORACLE = f"""
WITH RECURSIVE counts AS (
  SELECT source AS mix_source, count(*) AS n_rows FROM documents GROUP BY 1),
weights AS (
  SELECT *, CASE mix_source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 3.0 WHEN 'src2' THEN 1.5 WHEN 'src3' THEN 0.5 ELSE 1.0 END AS weight
  FROM counts),
rates AS (
  SELECT mix_source, weight / (SELECT sum(weight) FROM weights) * {MIX_TOTAL}::DOUBLE * (SELECT sum(n_rows) FROM weights) / n_rows AS rate
  FROM weights),
cdf AS (
  SELECT mix_source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT mix_source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < rate + 10 * sqrt(rate) + 64),
tables AS (SELECT mix_source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY 1),
drawn AS (
  SELECT d.*, len(list_filter(t.cdf, lambda c: ('0x' || substr(md5('{MIX_SEED}:' || d.doc_id), 1, {_HEX}))::BIGINT::DOUBLE / {float(1 << (4 * _HEX))} >= c)) AS n_copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.mix_source),
copies AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM drawn WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no, n_copies::INTEGER AS n_copies,
  md5('{MIX_SEED}:order:' || doc_id || ':' || copy_no) AS shuffle_key
FROM copies
"""
