"""SimHash near duplicates: a self-join of distinct fingerprints by a binary trie.

The fingerprints stand in one binary trie. Two subtrees are traversed together from the
root, the bits in which their paths differ are added up, and a pair of nodes is left as soon
as they are more than BUDGET. The top of the trie is cut into blocks, the highest nodes that
hold no more than an even share of fingerprints; the pairs of blocks that the budget leaves
are the groups that Spark deals out, and each group goes on from there with arrays of node
pairs, in chunks of bounded size.

A group gives out a spanning forest of the pairs it finds, not the pairs: a large ball of
near fingerprints makes no more rows than it has members. Documents of one fingerprint are
one node, whose copies are never paired.

Defined results: null, empty and word-less texts have the fingerprint zero and are linked
like any other; texts of one or two words have one shingle; repeated rows each give a row;
a row with a null id gets a fingerprint, connects what it lies between, and its component is
the least id among those, or null without any. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.arrowmap import over_texts
from lexispark.llm.components import components
from lexispark.llm.scratch import materialize

WORDS, SEED, BUDGET = 3, 42, 2
#: Fingerprints of a block: BLOCK, or more where that makes more than MOST_BLOCKS blocks.
BLOCK, MOST_BLOCKS = 4096, 4096
#: Bits by which the trie is opened at first and from then on.
FIRST_BITS, MORE_BITS = 14, 6
#: Node pairs of at most so many pairs of fingerprints are compared outright; so many node pairs are taken in one step.
SMALL, CHUNK = 32, 1 << 17
HASHES = 1 << 15


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and XXH64 of every shingle, repeats included, by row."""
    import xxhash

    raw, off = tv.text_bytes(texts)
    buf = tv.LOWER[raw]
    starts, ends, row = tv.words(buf, off, tv.NOT_SPACE)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data, starts, ends = tv.squeezed(buf, starts, ends)
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    head = np.flatnonzero(tv.same_row(row, WORDS))
    short = np.flatnonzero((count > 0) & (count < WORDS))
    at = np.concatenate((head, first[short]))
    last = np.concatenate((head + WORDS - 1, (first + count - 1)[short]))
    order = np.argsort(at)
    at, last = at[order], last[order]
    text, of = data.tobytes(), xxhash.xxh64_intdigest
    made = (of(text[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True))
    return row[at], np.fromiter(made, np.uint64, len(at))


def fingerprint_rows(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    row, h = shingle_hashes(texts)
    total = np.bincount(row, minlength=len(texts))
    ones = np.zeros((len(texts), 64), np.int64)
    for lo in range(0, len(h), HASHES):
        part, r = h[lo : lo + HASHES], row[lo : lo + HASHES]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        ones[r[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp) of every row; fp holds the 64 bits of the fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()
    return over_texts(docs, id_col, text_col, f"doc {kind}, fp bigint", lambda ids, texts: {"doc": ids, "fp": fingerprint_rows(texts).view(np.int64)})


def _children(nodes: DataFrame, opened: list[int] | None, depth: int, more: int) -> dict[int, int]:
    """How many fingerprints each node `more` bits below the opened ones holds (None: below the root)."""
    at = nodes if opened is None else nodes.where(F.shiftrightunsigned("fp", 64 - depth).isin(opened))
    rows = at.groupBy(F.shiftrightunsigned("fp", 64 - depth - more).alias("p")).count().collect()
    return {r["p"] & tv.M64: r["count"] for r in rows}


def trie_blocks(nodes: DataFrame, block: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the highest trie nodes that hold no more than `block` fingerprints, in order.

    At most MOST_BLOCKS nodes are open at a time, each with 2^MORE_BITS children: what
    comes to the driver is bounded by parameters, not by the table.
    """
    out: list[tuple[int, int]] = []
    opened: list[int] | None = None
    depth, more = 0, FIRST_BITS
    while opened is None or opened:
        counts = _children(nodes, opened, depth, more)
        levels = [counts]  # from the children up to the opened nodes
        for _ in range(more):
            up: dict[int, int] = {}
            for p, n in levels[-1].items():
                up[p >> 1] = up.get(p >> 1, 0) + n
            levels.append(up)
        tops = levels[more] if opened is None else {p: levels[more][p] for p in opened}
        below = [(p, depth) for p in tops]
        opened = []
        while below:
            p, d = below.pop()
            level = levels[depth + more - d]
            if p not in level:
                continue
            if level[p] <= block:
                out.append((p, d))
            elif d == depth + more:
                opened.append(p)
            else:
                below += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        depth += more
        more = min(MORE_BITS, 64 - depth)
    return sorted(out, key=lambda b: b[0] << (64 - b[1]))


def block_pairs(blocks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i <= j of blocks whose paths differ in no more than BUDGET bits as far as both go."""
    low = np.array([p << (64 - d) if d else 0 for p, d in blocks], np.uint64)
    depth = np.array([d for _, d in blocks], np.int64)
    mask = np.array([tv.M64 ^ (tv.M64 >> d) for d in range(65)], np.uint64)
    left, right = [], []
    for i in range(len(blocks)):
        apart = np.bitwise_count((low[i:] ^ low[i]) & mask[np.minimum(depth[i:], depth[i])])
        j = np.flatnonzero(apart <= BUDGET) + i
        left.append(np.full(len(j), i))
        right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _crossed(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b) of the ranges, which are small."""
    wide = b_hi - b_lo
    n = (a_hi - a_lo) * wide
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return a_lo[which] + k // wide[which], b_lo[which] + k % wide[which]


def close_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of entries of two sorted arrays at BUDGET bits or fewer; of one array with itself (same) i < j.

    A node is a range of an array. A step takes up to CHUNK node pairs one bit down: the
    pairs of children whose differing bits are within the budget stay.
    """
    ones = {}

    def ones_before(bit: int) -> tuple[np.ndarray, np.ndarray]:
        if bit not in ones:
            ones[bit] = [np.concatenate(([0], np.cumsum((x >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))) for x in ((a,) if same else (a, b))]
        return ones[bit][0], ones[bit][-1]

    start = np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([0])
    todo = [(63, start)] if len(a) and len(b) else []
    while todo:
        bit, (a_lo, a_hi, b_lo, b_hi, err) = todo.pop()
        small = (a_hi - a_lo) * (b_hi - b_lo) <= SMALL if bit >= 0 else np.ones(len(err), bool)
        if small.any():
            i, j = _crossed(a_lo[small], a_hi[small], b_lo[small], b_hi[small])
            near = np.bitwise_count(a[i] ^ b[j]) <= BUDGET
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if small.all():
            continue
        a_lo, a_hi, b_lo, b_hi, err = (x[~small] for x in (a_lo, a_hi, b_lo, b_hi, err))
        in_a, in_b = ones_before(bit)
        a_mid, b_mid = a_hi - (in_a[a_hi] - in_a[a_lo]), b_hi - (in_b[b_hi] - in_b[b_lo])
        kids = [
            (a_lo, a_mid, b_lo, b_mid, err),
            (a_mid, a_hi, b_mid, b_hi, err),
            (a_lo, a_mid, b_mid, b_hi, err + 1),
            (a_mid, a_hi, b_lo, b_mid, err + 1),
        ]
        down = [np.concatenate(x) for x in zip(*kids, strict=True)]
        stay = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= BUDGET)
        if same:
            stay &= down[0] <= down[2]  # of two different nodes, one order
        down = [x[stay] for x in down]
        for lo in range(0, len(down[0]), CHUNK):
            todo.append((bit - 1, tuple(x[lo : lo + CHUNK] for x in down)))


class Forest:
    """Least position in each set of positions that pairs connect."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        top = self.top
        while True:
            p, q = top[i], top[j]
            apart = p != q
            if not apart.any():
                return
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
            while True:
                up = top[top]
                if (up == top).all():
                    break
                top[:] = up


def _links(table: pa.Table) -> pa.Table:
    """A spanning forest of the close pairs of one pair of blocks."""
    fp, side = table.column("fp").to_numpy().view(np.uint64), table.column("side").to_numpy()
    a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
    same = not len(b)
    forest = Forest(len(a) + len(b))
    for i, j in close_pairs(a, a if same else b, same):
        forest.add(i, j if same else j + len(a))
    all_fp = np.concatenate((a, b)).view(np.int64)
    low = np.flatnonzero(forest.top != np.arange(len(all_fp)))
    return pa.table({"a": all_fp[low], "b": all_fp[forest.top[low]]})


def links(nodes: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints `nodes.fp` at BUDGET bits or fewer that connect all such pairs."""
    blocks = trie_blocks(nodes, block or max(BLOCK, -(-nodes.count() // MOST_BLOCKS)))
    left, right = block_pairs(blocks)
    low = np.array([p << (64 - d) if d else 0 for p, d in blocks], np.uint64)
    # for each block the pairs in which it stands, and its side there
    member = np.concatenate((left, right[left != right]))
    pair = np.concatenate((np.arange(len(left)), np.flatnonzero(left != right)))
    side = np.concatenate((np.zeros(len(left), np.int32), np.ones(int((left != right).sum()), np.int32)))
    order = np.argsort(member, kind="stable")
    pair, side = pair[order], side[order]
    first = np.searchsorted(member[order], np.arange(len(blocks) + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            if not len(fp):
                continue
            mine = np.searchsorted(low, fp.view(np.uint64), side="right") - 1
            n = first[mine + 1] - first[mine]
            at = np.repeat(first[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(pair[at]), pa.array(side[at]), pa.array(np.repeat(fp, n))], ["pair", "side", "fp"])

    dealt = nodes.select("fp").mapInArrow(deal, "pair bigint, side int, fp bigint")
    return dealt.groupBy("pair").applyInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int | None = None) -> DataFrame:
    """(doc, fp, component) of every row: its fingerprint, and the least id that links reach."""
    marked = materialize(fingerprints(docs, id_col, text_col))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc").alias("least")))
    tops = components(links(nodes, block)).select(F.col("node").alias("fp"), F.col("component").alias("top"))
    placed = materialize(nodes.join(tops, "fp", "left").select("fp", F.coalesce("top", "fp").alias("top"), "least"))
    named = placed.groupBy("top").agg(F.min("least").alias("component"))
    # a component's members may be many: Spark may split this join on the side of its members
    return marked.join(placed.join(named, "top").select("fp", "component"), "fp").select("doc", "fp", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict:
    """doc -> (fingerprint, component), by definition."""
    import re

    import xxhash

    fps = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + WORDS]) for i in range(max(len(w) - WORDS + 1, min(len(w), 1)))]
        h = [xxhash.xxh64_intdigest(x.encode(), SEED) for x in s]
        fps[d] = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    top = {d: d for d in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(fps)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if (fps[x] ^ fps[y]).bit_count() <= BUDGET:
                p, q = sorted((find(x), find(y)))
                top[q] = p
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}
