"""A Merkle manifest of a dataset as a postorder append log, with proofs and their check.

Each language has a binary tree over its rows in order of doc_id; the roots of these trees, in
order of language, are the leaves of one more tree. A tree is a log of nodes in the order in
which an appender completes them: a node stands after its two subtrees. Where a node stands
follows from sizes alone (`position`), so a sibling's place is computed, never searched.

Builders are aligned: each takes 2^LEVELS consecutive leaves, whose subtree is one contiguous
piece of the log, and writes the nodes that it completes in their order. The roots of such
subtrees are the leaves of the next tier of builders, until one builder reaches the top. A
proof reads the piece of the row's own builder, and the nodes above it by their positions,
once a builder instead of once a row.

Leaves are indexed without one global sort in one task: rows are sorted in ranges, counted by
range and language, and numbered from those counts.

Defined results: a null in any hashed column is `-`; a null language is a tree of its own, the
first; rows of equal (or null, the first) doc_id stand in order of their leaf digests; equal
rows are equal leaves; an empty table has no trees and gives no rows. Extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm.scratch import materialize

#: A builder's subtrees are so high: 4096 leaves.
LEVELS = 12
#: Where TAMPER divides the checksum of a row's id, `audit` changes the row.
TAMPER = 7
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of trees; the others are named by the hashed form of their language.
ROOTS = "roots"
_NODE = "tree string, height int, index bigint, leaves bigint, position bigint, digest string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_height(leaves: int) -> int:
    return max(leaves - 1, 0).bit_length()


def position(height, index, leaves):
    """Where a node stands in its tree's log (numpy). A node is complete if its whole range of leaves exists.

    Before the leaf i, i leaves and as many inner nodes as pairs have been completed stand: 2 i - (ones of i).
    A complete node follows its last leaf after `height` others. Incomplete nodes, one at
    each height above the trailing zeros of `leaves`, close the log in order of height.
    """
    height, index, leaves = np.int64(height), np.asarray(index, np.int64), np.asarray(leaves, np.int64)
    last = np.left_shift(index + 1, height) - 1
    zeros = np.bitwise_count((leaves & -leaves) - 1).astype(np.int64)
    closed = 2 * last - np.bitwise_count(last).astype(np.int64) + height
    edge = 2 * leaves - np.bitwise_count(leaves).astype(np.int64) + height - zeros - 1
    return np.where(last < leaves, closed, edge)


def position_of(height: Column, index: Column, leaves: Column) -> Column:
    """`position` as a column expression."""
    last = F.call_function("shiftleft", index + 1, height) - 1
    zeros = F.bit_count(leaves.bitwiseAND(-leaves) - 1)
    edge = 2 * leaves - F.bit_count(leaves) + height - zeros - 1
    return F.when(last < leaves, 2 * last - F.bit_count(last) + height).otherwise(edge)


def _top(leaves: Column) -> Column:
    return F.when(leaves <= 1, 0).otherwise(F.length(F.bin(leaves - 1)))


def hashed_form(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[hashed_form(v) for v in values]).cast("binary"), 256)


def numbered(df: DataFrame, tree: str, *order: str) -> DataFrame:
    """df with `index`, each row's place in its tree by `order`, and `leaves`, the tree's size."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(ranged).withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_tree")
    placed = counts.withColumn("_before", F.sum("_n").over(own.orderBy("_p")) - F.col("_n")).withColumn("leaves", F.sum("_n").over(own)).drop("_n")
    joined = rows.join(materialize(placed), (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("index", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_tree", "_p", "_first", "_before")


def _builder(base: int) -> Callable[[pa.Table], pa.Table]:
    """Nodes above aligned nodes of one height, as far up as a builder reaches; with the leaves themselves at base 0."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        tree, leaves, first = table["tree"][0].as_py(), table["leaves"][0].as_py(), table["index"][0].as_py()
        level = table["digest"].to_pylist()
        height, index, made = [], [], []
        for h in range(base, min(base + LEVELS, tree_height(leaves)) + 1):
            if h > base:
                level = [digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
            if h > base or not base:
                height += [h] * len(level)
                index += range(first >> (h - base), (first >> (h - base)) + len(level))
                made += level
        at = _positions(height, index, leaves)
        order = np.argsort(at)  # completion order
        n = len(made)
        return pa.table({
            "tree": pa.array([tree] * n, pa.string()),
            "height": pa.array(np.array(height, np.int32)[order]),
            "index": pa.array(np.array(index, np.int64)[order]),
            "leaves": pa.array(np.full(n, leaves, np.int64)),
            "position": pa.array(at[order]),
            "digest": pa.array(np.array(made, object)[order], pa.string()),
        })

    return build


def append_log(leaves: DataFrame) -> DataFrame:
    """The log of each tree: (tree, height, index, leaves, position, digest) of every node of leaves (tree, index, leaves, digest)."""
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    nodes, base, log = leaves.select("tree", "index", "leaves", "digest"), 0, None
    while log is None or most > 1 << base:
        block = F.shiftright("index", LEVELS).alias("block")
        tier = materialize(nodes.groupBy("tree", block).applyInArrow(_builder(base), _NODE))
        log = tier if log is None else log.unionByName(tier)
        base += LEVELS
        nodes = tier.where((F.col("height") == base) & (F.col("leaves") > 1 << base)).select("tree", "index", "leaves", "digest")
    return log


def tops(log: DataFrame) -> DataFrame:
    """(tree, digest): each tree's root."""
    return log.where(F.col("height") == _top(F.col("leaves"))).select("tree", "digest")


def paths(log: DataFrame, nodes: DataFrame, base: int) -> DataFrame:
    """(tree, index, height, right, digest) of the siblings on the way up from nodes (tree, index, leaves) of height `base`.

    One row for each height; where a node has no sibling its digest is null. Siblings are
    found by their positions in the log.
    """
    up = nodes.where(_top(F.col("leaves")) > base).withColumn("height", F.explode(F.sequence(F.lit(base), _top(F.col("leaves")) - 1)))
    own = F.call_function("shiftright", F.col("index"), F.col("height") - base)
    up = up.withColumn("beside", own.bitwiseXOR(F.lit(1).cast("bigint"))).withColumn("right", own % 2 == 0)
    there = F.call_function("shiftleft", F.col("beside"), F.col("height")) < F.col("leaves")
    up = up.withColumn("position", F.when(there, position_of(F.col("height"), F.col("beside"), F.col("leaves"))))
    high = log.where(F.col("height") >= base).select("tree", "position", "digest")
    return up.join(high, ["tree", "position"], "left").select("tree", "index", "height", "right", "digest")


class Manifest:
    """rows: a leaf each; log: nodes of the trees by language; roots: nodes of the tree over their roots."""

    def __init__(self, docs: DataFrame):
        wide = F.col("n_chars").cast("decimal(20,0)")
        chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
        values = [F.col(c) for c in HASHED]
        changed = [wide + 1 if c == "n_chars" else F.col(c) for c in HASHED]
        leaf = docs.select("doc_id", "lang", hashed_form(F.col("lang")).alias("tree"), leaf_digest(*values).alias("digest"), F.when(chosen, leaf_digest(*changed)).alias("changed"))
        self.rows = materialize(numbered(materialize(leaf), "tree", "lang", "doc_id", "digest"))
        self.log = append_log(self.rows)
        names = self.rows.where("index = 0").select("tree", "lang", "leaves")
        subroots = tops(self.log).join(names, "tree").select(F.lit(ROOTS).alias("of"), F.col("tree").alias("name"), "lang", "digest")
        self.trees = materialize(numbered(subroots, "of", "lang"))
        self.roots = append_log(self.trees.select(F.col("of").alias("tree"), "index", "leaves", "digest"))

    def _beside(self) -> DataFrame:
        """What a proof needs, by builder: (tree, block, part, at, right, digest).

        Parts: 0 the builder's piece of the log, 1 the path from its top to the tree's,
        2 the path from there to the root, 3 the tree's root, 4 the root.
        """
        block = F.shiftright(F.call_function("shiftleft", F.col("index"), F.col("height")), LEVELS)
        own = self.log.where(F.col("height") < LEVELS).select("tree", block.alias("block"), F.lit(0).alias("part"), F.col("position").alias("at"), F.lit(None).cast("boolean").alias("right"), "digest")
        blocks = self.rows.where(F.col("index") % (1 << LEVELS) == 0).select("tree", F.shiftright("index", LEVELS).alias("index"), "leaves")
        above = paths(self.log, blocks, LEVELS).select("tree", F.col("index").alias("block"), F.lit(1).alias("part"), F.col("height").cast("bigint").alias("at"), "right", "digest")
        of = self.trees.select(F.col("of").alias("tree"), "index", "leaves")
        beyond = paths(self.roots, of, 0).join(self.trees.select("index", "name"), "index")
        beyond = beyond.select(F.col("name").alias("tree"), F.lit(2).alias("part"), F.col("height").cast("bigint").alias("at"), "right", "digest")
        ends = self.trees.join(tops(self.roots).select(F.col("tree").alias("of"), F.col("digest").alias("root")), "of")
        ends = ends.select(F.col("name").alias("tree"), F.explode(F.array(F.struct(F.lit(3).alias("part"), F.col("digest").alias("d")), F.struct(F.lit(4).alias("part"), F.col("root").alias("d")))).alias("e"))
        ends = ends.select("tree", "e.part", F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("boolean").alias("right"), F.col("e.d").alias("digest"))
        shared = blocks.select("tree", F.col("index").alias("block")).join(beyond.unionByName(ends), "tree").select("tree", "block", "part", "at", "right", "digest")
        return own.unionByName(above).unionByName(shared)

    def _by_builder(self, each: Callable, schema: str) -> DataFrame:
        rows = self.rows.withColumn("block", F.shiftright("index", LEVELS)).groupBy("tree", "block")
        return rows.cogroup(self._beside().groupBy("tree", "block")).applyInArrow(lambda rows, beside: each(*_proofs(rows, beside)), schema)

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, siblings): the path of each row to the root; a sibling without digest is none, its level has one child."""
        kind = self.rows.schema["doc_id"].dataType.simpleString()

        def each(rows: pa.Table, found, subroot: str, root: str) -> pa.Table:
            steps = [[{"right": bool(right), "digest": d} for right, d in path] for path in found]
            return pa.table({"doc_id": rows["doc_id"], "leaf": rows["digest"], "siblings": pa.array(steps, pa.list_(pa.struct([("right", pa.bool_()), ("digest", pa.string())])))})

        return self._by_builder(each, f"doc_id {kind}, leaf string, siblings array<struct<right: boolean, digest: string>>")

    def audit(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each proof folded from the row as it is found, some rows having been changed."""
        kind = self.rows.schema["doc_id"].dataType.simpleString()

        def each(rows: pa.Table, found, subroot: str, root: str) -> pa.Table:
            proof, folded = [], []
            for leaf, changed, path in zip(rows["digest"].to_pylist(), rows["changed"].to_pylist(), found, strict=True):
                proof.append(digest(*[d for _, d in path if d is not None]))
                folded.append(fold(changed or leaf, path))
            n = len(proof)
            return pa.table({
                "doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
            })

        return self._by_builder(each, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def fold(leaf: str, path: list[tuple[bool, str | None]]) -> str:
    """The root that a leaf and its path give."""
    for right, beside in path:
        leaf = digest(leaf) if beside is None else digest(leaf, beside) if right else digest(beside, leaf)
    return leaf


def _positions(height: list[int], index: list[int], leaves: int) -> np.ndarray:
    h, i = np.array(height), np.array(index, np.int64)
    out = np.zeros(len(h), np.int64)
    for x in np.unique(h):
        out[h == x] = position(x, i[h == x], leaves)
    return out


def _proofs(rows: pa.Table, beside: pa.Table):
    """A builder's rows, their paths, the tree's root and the root."""
    part = beside["part"].to_numpy()
    beside = beside.take(pa.array(np.lexsort((beside["at"].to_numpy(), part))))
    edges = np.searchsorted(np.sort(part), np.arange(6)).tolist()
    digests, right = beside["digest"].to_pylist(), beside["right"].to_pylist()
    piece = digests[: edges[1]]
    shared = [(right[k], digests[k]) for k in range(edges[1], edges[3])]
    leaves, index = rows["leaves"][0].as_py(), rows["index"].to_numpy()
    start = position(0, [index[0] >> LEVELS << LEVELS], leaves)[0]
    found = [[] for _ in range(len(index))]
    for h in range(min(LEVELS, tree_height(leaves))):
        own = index >> h
        there = (own ^ 1) << h < leaves
        at = np.where(there, position(h, own ^ 1, leaves) - start, -1)
        for path, k, odd in zip(found, at.tolist(), (own & 1).tolist(), strict=True):
            path.append((not odd, piece[k] if k >= 0 else None))
    return rows, [path + shared for path in found], digests[edges[3]], digests[edges[4]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).audit()


ORACLE = r"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    sha256(concat(
      CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
      CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END,
      CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    sha256(concat(
      CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
      CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen((n_chars + 1)::VARCHAR), ':', n_chars + 1) END,
      CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS changed
  FROM documents),
nodes AS (
  SELECT coalesce('=' || lang, '-') AS tree, 0 AS h, i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT tree, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, h, i // 2, n),
subroots AS (
  SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS h, i, n, subroot AS d FROM subroots
  UNION ALL
  SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY h, i // 2, n),
root AS (SELECT d AS root FROM upper WHERE n = 1),
own AS (
  SELECT doc_id, lang, leaf, coalesce('=' || lang, '-') AS tree, i, n,
    CASE WHEN n_chars IS NOT NULL AND (4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 7 = 0
      THEN changed ELSE leaf END AS found
  FROM leaves),
folds AS (
  SELECT doc_id, leaf, tree, 0 AS h, i, n, found AS d, '' AS proof FROM own
  UNION ALL
  SELECT f.doc_id, f.leaf, f.tree, f.h + 1, f.i // 2, (f.n + 1) // 2,
    sha256(CASE WHEN s.d IS NULL THEN f.d WHEN f.i % 2 = 0 THEN f.d || s.d ELSE s.d || f.d END), f.proof || coalesce(s.d, '')
  FROM folds AS f LEFT JOIN nodes AS s ON s.tree = f.tree AND s.h = f.h AND s.i = xor(f.i, 1) WHERE f.n > 1),
high AS (
  SELECT f.doc_id, f.leaf, t.subroot, 0 AS h, t.i, t.n, f.d, f.proof FROM folds AS f JOIN subroots AS t USING (tree) WHERE f.n = 1
  UNION ALL
  SELECT f.doc_id, f.leaf, f.subroot, f.h + 1, f.i // 2, (f.n + 1) // 2,
    sha256(CASE WHEN s.d IS NULL THEN f.d WHEN f.i % 2 = 0 THEN f.d || s.d ELSE s.d || f.d END), f.proof || coalesce(s.d, '')
  FROM high AS f LEFT JOIN upper AS s ON s.h = f.h AND s.i = xor(f.i, 1) WHERE f.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified FROM high, root WHERE n = 1
"""


def brute_force(rows: list[dict]) -> list[tuple]:
    """The rows of `audit`, from trees built whole in memory."""
    import zlib

    def hashed(row: dict) -> str:
        out = []
        for c in HASHED:
            v = row[c]
            out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
        return digest(*out)

    def tree(level: list[str]) -> tuple[str, list[list[tuple[bool, str | None]]]]:
        """The root, and each leaf's path."""
        found = [[] for _ in level]
        at = list(range(len(level)))
        while len(level) > 1:
            for p, i in enumerate(at):
                j = i ^ 1
                found[p].append((i < j, level[j] if j < len(level) else None))
            level = [digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
            at = [i // 2 for i in at]
        return level[0], found

    by_lang: dict = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, hashed(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for x in langs:
        by_lang[x].sort(key=lambda e: e[:3])
        trees.append(tree([e[2] for e in by_lang[x]]))
    if not trees:
        return []
    root, above = tree([t[0] for t in trees])
    out = []
    for x, (subroot, found), up in zip(langs, trees, above):
        for (_, _, leaf, r), path in zip(by_lang[x], found):
            start = leaf
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % TAMPER == 0:
                start = hashed(r | {"n_chars": r["n_chars"] + 1})
            path = path + up
            folded = fold(start, path)
            out.append((r["doc_id"], leaf, subroot, root, digest(*[d for _, d in path if d is not None]), folded, folded == root))
    return out
