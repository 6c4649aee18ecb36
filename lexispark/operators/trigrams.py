"""Substring and regular-expression search by an index of trigrams.

Every text is folded, and each of its distinct runs of three characters is a posting. What a
needle or a pattern demands of the trigrams of a text is a formula of `all` and `any`, which
the postings decide; only texts that pass are read and verified. Patterns are read with the
standard library's parser; of what it cannot say (case folding beyond ASCII, references, look-arounds,
classes) nothing is demanded, so the candidates are always a superset.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as tx

N = 3


def grams(text: Column) -> Column:
    """Distinct runs of N characters, found in one scan: a look-ahead matches at every place. Nulls have none."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{N}}}))"), F.lit(1)))


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> TrigramIndex:
    """Write the postings (gram, doc_id) of docs under path, dealt and sorted by gram, so that a search reads its own row groups.

    A very frequent gram lies in several files, as the ranges are of (gram, id).
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.explode_outer(grams(tx.fold(F.col(text_col)))).alias("gram")).where("gram IS NOT NULL")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.select("gram", "doc_id").repartitionByRange(width, "gram", "doc_id").sortWithinPartitions("gram", "doc_id").write.parquet(path)
    return TrigramIndex(docs.sparkSession, path)


def of_text(needle: str):
    """What a text that contains the needle must have: a formula of strings and ('all' | 'any', parts); None demands nothing."""
    runs = sorted({needle[i : i + N] for i in range(len(needle) - N + 1)})
    return ("all", runs) if runs else None


def _both(parts: list):
    parts = [p for p in parts if p is not None]
    return ("all", parts) if parts else None


def _of_nodes(nodes, parser) -> object:
    """The demands of a parsed sequence: its runs of ASCII literals, and of its groups what each cannot do without."""
    demands, run = [], []

    def end() -> None:
        demands.append(of_text("".join(run).lower()))
        run.clear()

    for op, arg in nodes:
        if op is parser.LITERAL and arg < 128:
            run.append(chr(arg))
            continue
        if op is parser.SUBPATTERN and len(arg[3]) and all(o is parser.LITERAL and a < 128 for o, a in arg[3]):
            run += [chr(a) for _, a in arg[3]]
            continue
        end()
        if op is parser.SUBPATTERN:
            demands.append(_of_nodes(arg[3], parser))
        elif op is parser.BRANCH:
            each = [_of_nodes(b, parser) for b in arg[1]]
            demands.append(("any", each) if all(e is not None for e in each) else None)
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] > 0:
            demands.append(_of_nodes(arg[2], parser))
    end()
    return _both(demands)


def of_pattern(pattern: str):
    """What a text in which the pattern is found must have; None where that cannot be told."""
    from re import _parser as parser

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _of_nodes(parser.parse(pattern), parser)
    except re.error:
        return None


def _leaves(formula) -> set[str]:
    return {formula} if isinstance(formula, str) else set().union(*[_leaves(p) for p in formula[1]])


def _holds(formula, have: Column) -> Column:
    if isinstance(formula, str):
        return F.array_contains(have, formula)
    out = None
    for p in formula[1]:
        one = _holds(p, have)
        out = one if out is None else out & one if formula[0] == "all" else out | one
    return out


class TrigramIndex:
    """Written postings of trigrams."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.postings = spark.read.parquet(path)

    def candidates(self, formula) -> DataFrame:
        """doc_id of the texts whose trigrams satisfy the formula."""
        needed = sorted(_leaves(formula))
        hits = self.postings.where(F.col("gram").isin(needed))
        if formula[0] == "all" and all(isinstance(p, str) for p in formula[1]):
            return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(needed)).select("doc_id")
        have = hits.groupBy("doc_id").agg(F.collect_set("gram").alias("have"))
        return have.where(_holds(formula, F.col("have"))).select("doc_id")

    def _texts(self, docs: DataFrame, formula, id_col: str) -> DataFrame:
        """Rows of docs that may match; all where nothing is demanded."""
        if formula is None:
            return docs
        return docs.join(self.candidates(formula).withColumnRenamed("doc_id", "_found"), F.col(id_col).cast("bigint") == F.col("_found"), "left_semi")

    def containing(self, docs: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows of docs whose folded text has the needle, which is folded like a text."""
        plain = tx.plain_fold(needle)
        return self._texts(docs, of_text(plain), id_col).where(tx.fold(F.col(text_col)).contains(plain))

    def matching(self, docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows of docs in whose text the pattern is found."""
        return self._texts(docs, of_pattern(pattern), id_col).where(F.col(text_col).rlike(pattern))
