"""N-gram Jaccard self-join by vertical partitioning, and its link components.

The n-grams (word shingles) of all documents stand in one global order: by the level of
their bin in a frequency histogram, rare ones first, then by hash. A document's prefix is
its first n - ceil(t n) + m shingles in that order. Of two
documents with Jaccard similarity t or more, the one whose prefix ends first has at most
ceil(t n) - m shingles behind it and shares ceil(t n) at least, so m of them in both
prefixes: candidates share as many as the smaller m (1, more for long documents).

The order is also cut into FRAGMENTS: level 0 in ranges of the hash, and the frequent levels
behind it. A document's set is stored in one segment per fragment; a pair's overlap is counted fragment by fragment, and the partial overlaps are
summed per pair.

Nothing needs all pairs of a large group of near copies. Each document is first paired
with the least id of the prefix bucket in which it shares most; an exact lower bound of
the symmetric difference, from folded bit strings, drops pairs that cannot be links. Then
buckets are searched, in blocks of bounded size, for pairs between documents that those
pairs do not connect, under a size filter and the same bound. All pairs found are counted.
Where counting breaks up a group that the first pairs seemed to connect, the pairs inside
it are searched and counted in the same way. So every pair of a bucket is linked through
its component, excluded by a bound, or counted.

Shingles are compared by 64-bit hashes in candidate search and by fragment and 40 bits of
them in counting. Documents with equal sets (64-bit sum of hashes, and size) are joined first.

Defined results: null, empty and word-less texts have empty sets and no links; texts of
fewer than N words have one shingle, the whole sequence; rows repeated with an id are one
document (their texts should be equal); rows with a null id get their set size and a null
component. Extra columns are ignored here and kept by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.arrowmap import freeing, over_texts
from lexispark.llm.components import components
from lexispark.llm.scratch import materialize, shuffle_width

N = 5
#: Similarity as a fraction: PART / WHOLE.
PART, WHOLE = 75, 100
FRAGMENTS, OFFSET_BITS = 8, 40
#: The histogram has 2^BIN_BITS counters, and more on a corpus with over 2^BIN_FILL shingles for each, up to 2^MOST_BIN_BITS. A bin's level is 0 up to FREQUENT standard deviations
#: (of a count with the bins' mean) above the mean, and one more for each doubling of that excess, LEVELS at most.
BIN_BITS, MOST_BIN_BITS, BIN_FILL, PIECE_BITS, FREQUENT, LEVELS = 20, 24, 9, 14, 3, 12
FOLD_BITS, SMALL_FOLD_BITS = 2048, 512
_FOLDED = 512  # rows that are folded at once
#: Sets over LONG shingles have a longer prefix, so that similar ones share more of it: one shingle more for each STEP.
LONG, STEP = 512, 16
#: Groups of up to this many are compared side by side.
SMALL_GROUP = 32
#: Members of a bucket that are compared in one group; larger buckets are compared in pairs of blocks.
BLOCK = 16_384


def shingle_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, by row, then hash."""
    raw, off = tv.text_bytes(texts)
    buf = tv.LOWER[raw]
    starts, ends, row = tv.words(buf, off, tv.NOT_SPACE)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wh = tv.hash_spans(buf, starts, ends)
    ok = tv.same_row(row, n)
    rows, hashes = [row[: len(ok)][ok]], [tv.window_hashes(wh, n, 5)[ok]]
    words = np.bincount(row, minlength=len(texts))
    first = np.cumsum(words) - words
    for k in range(1, n):
        short = np.flatnonzero(words == k)
        if len(short):
            rows.append(short)
            hashes.append(tv.window_hashes(wh, k, 100 + k)[first[short]])
    r, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[keep], h[keep]


def _sizes(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(row, minlength=n)
    return size, np.cumsum(size) - size


def bin_bits(shingles: int) -> int:
    return min(MOST_BIN_BITS, max(BIN_BITS, shingles.bit_length() - BIN_FILL))


def bins_of(h: np.ndarray, levels: int) -> np.ndarray:
    """The bins of shingles in a histogram of that many."""
    return (h >> np.uint64(65 - levels.bit_length())).astype(np.int64)


def bin_levels(texts: DataFrame, bits: int = BIN_BITS) -> np.ndarray:
    """Level of each of 2^bits histogram bins. Counts cover every shingle of every text."""
    piece = 1 << PIECE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for _, part in tv.row_slices(batch, tv.filled(batch.column(1))):
                _, h = shingle_sets(part)
                np.add.at(bins, bins_of(h, len(bins)), 1)
        if bins.any():
            parts = bins.reshape(-1, piece)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # the pieces of one partition, of 2^PIECE_BITS numbers
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(raw.as_buffer(), np.int32)
                sums[k] = sums[k] + counts if k in sums else counts.astype(np.int64)
        for k, s in sums.items():
            mean = s.mean()
            over = (s - mean) / (FREQUENT * np.sqrt(mean) + 1)
            many = np.flatnonzero(over > 1)
            if len(many):
                level = np.minimum(LEVELS, 1 + np.log2(over[many]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(many + (k << PIECE_BITS)), pa.array(level)], ["bin", "level"])

    counts = texts.mapInArrow(freeing(count), "piece bigint, counts binary")
    many = counts.repartition(1 << (bits - PIECE_BITS), "piece").mapInArrow(add, "bin bigint, level bigint")
    out = np.zeros(1 << bits, np.uint8)
    for r in many.collect():  # bins, not shingles: a fixed number at most
        out[r.bin] = r.level
    return out


def least_shared(size):
    """How many prefix shingles two similar sets share at least: the smaller of their numbers."""
    return 1 + np.maximum(size - LONG, 0) // STEP


def _least_shared(size: Column) -> Column:
    return F.lit(1) + F.floor(F.greatest(size - LONG, F.lit(0)) / STEP)


def _prefix_rows(levels: np.ndarray):
    import zlib

    packed = zlib.compress(levels.tobytes())
    opened: list[np.ndarray] = []

    def emit(ids: pa.Array, texts: pa.Array):
        row, h = shingle_sets(texts)
        if not len(row):
            return None
        n = len(texts)
        size, first = _sizes(row, n)
        full = np.flatnonzero(size)
        signature = np.add.reduceat(tv.mix(h), first[full])
        alike = np.lexsort((size[full], signature))
        new = np.ones(len(full), bool)
        new[1:] = (np.diff(signature[alike]) != 0) | (np.diff(size[full][alike]) != 0)
        own = np.zeros(n, bool)
        own[full[alike[new]]] = True  # of equal sets in this slice, one speaks for all
        if not opened:
            opened.append(np.frombuffer(zlib.decompress(packed), np.uint8))
        late = opened[0][bins_of(h, len(opened[0]))]
        order = np.lexsort((h, late, row))
        rank = np.arange(len(h)) - first[row]
        take = (rank < (size - -(-size * PART // WHOLE) + least_shared(size))[row]) & own[row]
        return {"h": h[order][take].view(np.int64), "doc": np.asarray(ids)[row[take]]}

    return emit


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by (h, doc): those of buckets with more than one document, with the bucket's least document as leader."""
    held = None  # last row's h, leader, doc; whether it has been given out
    for batch in batches:
        h, doc = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if held is not None and not held[3]:
            h, doc = np.concatenate(([held[0]], h)), np.concatenate(([held[2]], doc))
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        if held is not None and held[3]:
            keep[0] = (h[0], doc[0]) != (held[0], held[2])
        h, doc = h[keep], doc[keep]
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        goes_on = held is not None and held[3] and h[0] == held[0]
        heads = np.flatnonzero(new)
        leader = doc[heads][np.cumsum(new) - 1]
        if goes_on:
            leader[np.cumsum(new) == 1] = held[1]
        alone = new & np.concatenate((new[1:], [True]))
        if goes_on:
            alone[0] = False
        last_alone = bool(alone[-1])
        give = ~alone
        yield pa.RecordBatch.from_arrays([pa.array(h[give]), pa.array(doc[give]), pa.array(leader[give])], ["h", "doc", "leader"])
        held = (h[-1], leader[-1], doc[-1], not last_alone)


def _segment_rows(levels: np.ndarray):
    import zlib

    packed = zlib.compress(levels.tobytes())
    opened: list[np.ndarray] = []

    def emit(ids: pa.Array, texts: pa.Array):
        """One row per document and fragment: set size, 40-bit offsets (five bytes each)."""
        row, h = shingle_sets(texts)
        if not len(row):
            return None
        if not opened:
            opened.append(np.frombuffer(zlib.decompress(packed), np.uint8))
        n = len(texts)
        size, _ = _sizes(row, n)
        # ranges of the global order: level 0 by hash, then all that is frequent
        fragment = np.where(opened[0][bins_of(h, len(opened[0]))] > 0, FRAGMENTS - 1, ((h >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)).astype(np.int64))
        cut = row * FRAGMENTS + fragment
        order = np.argsort(cut, kind="stable")
        edges = np.searchsorted(cut[order], np.arange(n * FRAGMENTS + 1))
        offset = h[order] >> np.uint64(20) & np.uint64((1 << OFFSET_BITS) - 1)
        raw = np.ascontiguousarray(offset.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
        full = np.flatnonzero(np.repeat(size > 0, FRAGMENTS))
        return {
            "doc": np.asarray(ids)[full // FRAGMENTS],
            "fragment": (full % FRAGMENTS).astype(np.int32),
            "size": size[full // FRAGMENTS],
            "segment": [raw[5 * lo : 5 * hi] for lo, hi in zip(edges[full].tolist(), edges[full + 1].tolist(), strict=True)],
        }

    return emit


def _folds(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """FOLD_BITS bits per row: each shingle flips one, so two rows differ in no more bits than their sets in shingles."""
    out = np.zeros((n, FOLD_BITS // 8), np.uint8)
    for lo in range(0, n, _FOLDED):
        hi = min(n, lo + _FOLDED)
        a, b = np.searchsorted(row, (lo, hi))
        flips = np.bincount((row[a:b] - lo) * FOLD_BITS + (tv.mix(h[a:b]) % np.uint64(FOLD_BITS)).astype(np.int64), minlength=(hi - lo) * FOLD_BITS)
        out[lo:hi] = np.packbits((flips & 1).astype(np.uint8).reshape(hi - lo, FOLD_BITS), axis=1)
    return out


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _may_link(apart: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """overlap/union >= t if and only if difference <= (1-t)/(1+t) (sum of sizes)."""
    return apart * (WHOLE + PART) <= sizes * (WHOLE - PART)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size_a, size_b = np.asarray(batch.column("size_a")), np.asarray(batch.column("size_b"))
        apart = np.bitwise_count(_bits(batch.column("fold_a")) ^ _bits(batch.column("fold_b"))).sum(1, dtype=np.int64)
        ok = _may_link(apart, size_a + size_b) & (np.minimum(size_a, size_b) * WHOLE >= np.maximum(size_a, size_b) * PART)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in (0, 1)], ["a", "b"])


def prune(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b, n: prefix shingles shared), (a, b) of those that the bounds on n, sizes and folded bits leave."""
    left = nodes.select(F.col("doc").alias("a"), F.col("size").alias("size_a"), F.col("fold").alias("fold_a"))
    right = nodes.select(F.col("doc").alias("b"), F.col("size").alias("size_b"), F.col("fold").alias("fold_b"))
    enough = F.col("n") >= _least_shared(F.least("size_a", "size_b"))
    sized = pairs.join(left.drop("fold_a"), "a").join(right.drop("fold_b"), "b").where(enough).select("a", "b")
    return sized.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "fold_a", "fold_b").mapInArrow(freeing(_prune), "a bigint, b bigint")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 40-bit value of each entry of a column of packed segments."""
    raw, off = tv.text_bytes(column)
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return np.repeat(np.arange(len(column)), np.diff(off) // 5), wide.view(np.uint64).ravel()


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _ in tv.row_slices(batch, batch.column(5)):
            keys = []
            for c in (4, 5):
                row, value = _values(part.column(c))
                keys.append((row.astype(np.uint64) << np.uint64(OFFSET_BITS)) | value)
            both = np.sort(np.concatenate(keys))
            same = both[1:][both[1:] == both[:-1]]
            overlap = np.bincount((same >> np.uint64(OFFSET_BITS)).astype(np.int64), minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(overlap, pa.int64())], ["a", "b", "size_a", "size_b", "overlap"])


def count_overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, overlap) of each pair: partial overlaps counted by fragment, summed by pair."""
    left = segments.select(F.col("doc").alias("a"), "fragment", F.col("size").alias("size_a"), F.col("segment").alias("segment_a"))
    right = segments.select(F.col("doc").alias("b"), "fragment", F.col("size").alias("size_b"), F.col("segment").alias("segment_b"))
    # a is the side with one pair or few; b may be the leader of many
    joined = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])
    parts = joined.select("a", "b", "size_a", "size_b", "segment_a", "segment_b").mapInArrow(freeing(_partial), "a bigint, b bigint, size_a bigint, size_b bigint, overlap bigint")
    return parts.groupBy("a", "b", "size_a", "size_b").agg(F.sum("overlap").alias("overlap"))


def similar(overlaps: DataFrame) -> DataFrame:
    return overlaps.where(F.col("overlap") * WHOLE >= (F.col("size_a") + F.col("size_b") - F.col("overlap")) * PART).select("a", "b")


_GROUP = ("h", "grp", "i", "j")


def _bucket_pairs(block_pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by group: pairs of one group in different components that the bounds leave."""
    held: list[pa.RecordBatch] = []

    def group(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        col = {n: t.column(n).to_numpy() for n in ("i", "j", "blk", "doc", "component", "size")}
        cross = col["i"][0] != col["j"][0]
        order = np.argsort(col["size"], kind="stable")
        doc, comp, size, blk, bits = col["doc"][order], col["component"][order], col["size"][order], col["blk"][order], _bits(t.column("fold"))[order]
        # partners of x, at or after x by size: sizes up to WHOLE/PART of its own
        reach = np.searchsorted(size, size * WHOLE // PART, side="right")
        for x in range(len(doc)):
            lo, hi = x + 1, int(reach[x])
            if hi <= lo:
                continue
            may = np.flatnonzero((comp[lo:hi] != comp[x]) & ((blk[lo:hi] != blk[x]) if cross else True)) + lo
            if not len(may):
                continue
            may = may[_may_link(np.bitwise_count(bits[may] ^ bits[x]).sum(1, dtype=np.int64), size[may] + size[x])]
            if len(may):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(doc[may], doc[x])), pa.array(np.minimum(doc[may], doc[x]))], ["a", "b"])

    def key(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(n)[0].as_py() for n in _GROUP)

    def small(rows: pa.RecordBatch, member: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs inside groups of up to SMALL_GROUP rows, for all of them at once; member numbers the groups."""
        col = {n: np.asarray(rows.column(n)) for n in ("i", "j", "blk", "doc", "component", "size")}
        bits = _bits(rows.column("fold"))
        for d in range(1, min(SMALL_GROUP, len(member))):
            x = np.flatnonzero(member[d:] == member[:-d])
            if not len(x):
                break
            y = x + d
            sx, sy = col["size"][x], col["size"][y]
            ok = (col["component"][x] != col["component"][y]) & (np.minimum(sx, sy) * WHOLE >= np.maximum(sx, sy) * PART)
            ok &= (col["i"][x] == col["j"][x]) | (col["blk"][x] != col["blk"][y])
            x, y = x[ok], y[ok]
            ok = _may_link(np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64), col["size"][x] + col["size"][y])
            if ok.any():
                a, b = col["doc"][x[ok]], col["doc"][y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    for batch in block_pairs:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(n)) for n in _GROUP]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = np.concatenate(([0], edges, [batch.num_rows]))
        # the first group may go on from the last batch, and the last into the next
        first = batch.slice(0, bounds[1])
        if held and key(held[0]) != key(first):
            yield from group(held)
            held = []
        held.append(first)
        if len(bounds) == 2:
            continue
        yield from group(held)
        held = [batch.slice(bounds[-2])]
        counts = np.diff(bounds)[1:-1]
        if len(counts):
            inner = batch.slice(bounds[1], bounds[-2] - bounds[1])
            member = np.repeat(np.arange(len(counts)), counts)
            few = counts <= SMALL_GROUP
            keep = np.flatnonzero(few[member])
            if len(keep):
                yield from small(inner.take(pa.array(keep)), member[keep])
            for g in np.flatnonzero(~few).tolist():
                yield from group([batch.slice(bounds[g + 1], counts[g])])
    if held:
        yield from group(held)


def _named(buckets: DataFrame, label: DataFrame, name: str) -> DataFrame:
    known = label.select(F.col("node").alias("doc"), F.col("component").alias(name))
    return buckets.join(known, "doc", "left").withColumn(name, F.coalesce(name, "doc"))


def _open_pairs(named: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Pairs of rows (h, doc, grp, component) that share h and grp and not component, unless the bounds exclude them."""
    mixed = named.groupBy("h", "grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi")
    rows = named.join(mixed.select("h", "grp", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int").alias("blocks")), ["h", "grp"])
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("h", "grp", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "doc", "component")
    full = rows.join(nodes.select("doc", "size", F.col("small_fold").alias("fold")), "doc").select(*_GROUP, "blk", "doc", "component", "size", "fold")
    dealt = full.repartition(width, *_GROUP).sortWithinPartitions(*_GROUP)
    shared = dealt.mapInArrow(freeing(_bucket_pairs), "a bigint, b bigint").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return prune(shared, nodes)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes (doc, size, signature, folded bits: one row per id with a shingle) and links (a, b) that connect the same
    documents as all pairs of PART/WHOLE similarity or more do."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def sign(ids, part):
        row, h = shingle_sets(part)
        size, first = _sizes(row, len(part))
        some = size > 0
        sums = np.add.reduceat(tv.mix(h), first[some]) if some.any() else np.zeros(0, np.uint64)
        folds = _folds(row, h, len(part))[some]
        small = np.bitwise_xor.reduce(folds.reshape(len(folds), -1, SMALL_FOLD_BITS // 8), axis=1)
        bits = {"fold": [f.tobytes() for f in folds], "small_fold": [f.tobytes() for f in small]}
        return {"doc": np.asarray(ids)[some], "size": size[some], "signature": sums.view(np.int64)} | bits

    nodes = materialize(over_texts(texts, "id", "text", "doc bigint, size bigint, signature bigint, fold binary, small_fold binary", sign).dropDuplicates(["doc"]))
    first = nodes.groupBy("signature", "size").agg(F.min("doc").alias("b"), F.max("doc").alias("most")).where("most > b")
    equal = nodes.select("doc", "signature", "size").join(first, ["signature", "size"]).where("doc <> b").select(F.col("doc").alias("a"), "b")

    levels = bin_levels(texts, bin_bits(nodes.agg(F.sum("size")).first()[0] or 0))
    prefixes = over_texts(texts, "id", "text", "h bigint, doc bigint", _prefix_rows(levels))
    buckets = materialize(prefixes.repartition(width, "h").sortWithinPartitions("h", "doc").mapInArrow(_buckets, "h bigint, doc bigint, leader bigint"))

    # one pair per document: the leader with which it shares most of its prefix
    shared = buckets.where("doc <> leader").groupBy("doc", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("doc").agg(F.max(F.struct("n", (-F.col("leader")).alias("neg"))).alias("best"))
    likely = materialize(prune(best.select(F.col("doc").alias("a"), (-F.col("best.neg")).alias("b"), F.col("best.n").alias("n")), nodes).unionByName(equal).distinct())
    guess = components(likely)
    among = _named(buckets.select("h", "doc"), guess, "component").withColumn("grp", F.lit(0).cast("bigint"))
    others = materialize(_open_pairs(among, nodes, width))

    pairs = likely.unionByName(others)
    wanted = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    # one plan at every size: texts are dealt by id, never met by a broadcast of the wanted ids
    chosen = texts.join(wanted.hint("merge"), texts["id"] == wanted["doc"], "left_semi").dropDuplicates(["id"])
    segments = materialize(over_texts(chosen, "id", "text", "doc bigint, fragment int, size bigint, segment binary", _segment_rows(levels)))
    found = materialize(similar(count_overlaps(pairs, segments)))

    lost = likely.join(found, ["a", "b"], "left_anti")
    if lost.isEmpty():
        return nodes, found
    # groups that the likely pairs seemed to connect: search inside them, between what is connected indeed
    inside = _named(_named(buckets.select("h", "doc"), guess, "grp"), components(found), "component")
    more = materialize(similar(count_overlaps(_open_pairs(inside, nodes, width), segments)))
    return nodes, found.unionByName(more)


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs."""
    nodes, linked = links(docs, id_col, text_col)
    label = components(linked)
    known = nodes.join(label, nodes["doc"] == label["node"], "left")
    known = known.select("doc", "size", F.coalesce("component", "doc").alias("component"))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    out = ids.join(known, ids["doc_id"].cast("bigint") == known["doc"], "left")
    return out.select("doc_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("n_shingles"), F.coalesce("component", F.col("doc_id").cast("bigint")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not the least id of their component, same columns."""
    label = components(links(docs, id_col, text_col)[1])
    return docs.join(label, docs[id_col].cast("bigint") == label["node"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute_force(rows: list[tuple[int, str | None]], n: int = N) -> dict[int, tuple[int, int]]:
    lower = bytes(range(256)).lower()
    sets = {}
    for d, t in rows:
        ws = (t or "").encode().translate(lower).split()
        sets[d] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()
    holders: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    parent = {d: d for d in sets}

    def root(d: int) -> int:
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    for d, s in sets.items():
        for other in {x for g in s for x in holders[g] if x < d}:
            o = len(s & sets[other])
            if o * WHOLE >= (len(s) + len(sets[other]) - o) * PART:
                a, b = sorted((root(d), root(other)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
sets AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
heads AS (SELECT k, min(doc_id) AS head, any_value(n) AS n FROM sets GROUP BY k),
own AS (SELECT s.doc_id, g, n FROM s JOIN heads ON doc_id = head),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM own AS a JOIN own AS b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT head AS node, head AS seen FROM heads UNION SELECT reach.node, links.y FROM reach JOIN links ON links.x = reach.seen),
tops AS (SELECT node, min(seen) AS top FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(tops.top, d.doc_id) AS component_id
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN heads ON heads.k = sets.k LEFT JOIN tops ON tops.node = heads.head
"""
