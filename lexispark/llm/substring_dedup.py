"""Substring deduplication over prefix-partitioned suffix trees.

Suffixes are word sequences. What has to be found are the nodes of WINDOW words or more
with more than one leaf: their repeats. The trees are sparse: of every window the suffix
that starts at its anchor, the least-hashed run of ANCHOR words in it, is a leaf, with the
words before it at hand. Equal windows have equal anchors at the same place, so that they
are leaves of one tree, and neighbouring windows mostly share a leaf.

1. Windows whose anchor occurs once have no such node and are dropped. Each task merges
   equal anchors before the shuffle.
2. The other leaves are dealt to trees by the prefix that the anchor is, with the text of
   their windows. A prefix with more leaves than an even share is made longer, to a whole
   window. Each task builds the trees of its slice of text first and sends no leaf whose
   windows all start earlier in the slice, so that a passage, however common, sends one
   leaf per slice.
3. Each partition builds the subtrees of its prefixes: leaves in the order of the words to
   come, with the words that neighbours have in common, and once more in the order of the
   words before. A window that starts j words before its anchor repeats where leaves have
   a node of WINDOW - j words in the first order and one of j words in the second. The
   first leaf of such a node (least id, then least start) stays, the others are reported;
   consecutive ones make up the maximal repeats.

Words are compared by 64-bit hashes, anchors by 62 bits.

Defined results: null and empty texts have no words; texts under WINDOW words lose
nothing; rows repeated with the same id are one document that occurs once (rows that share
an id should have equal texts; else the spans found in any of them are cut from each). Rows
with a null id keep their words and are not compared. Extra columns are kept by
`remove_repeats`. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.arrowmap import over_texts
from lexispark.llm.scratch import materialize, shuffle_width

WINDOW, ANCHOR = 20, 8
_LEFT_BITS = 8
_KEY_BITS = 62
#: Kinds of rows of the first pass, in the two upper bits of the key.
_ONE, _MANY, _KNOWN = range(3)


class _Suffixes:
    """Words, windows and anchors of a slice of texts; owner is the word at which a window's anchor starts."""

    def __init__(self, texts: pa.Array, window: int, anchor: int) -> None:
        buf, off = tv.text_bytes(texts)
        self.buf = buf
        self.starts, self.ends, self.row = starts, ends, row = tv.words(buf, off, tv.NOT_SPACE)
        self.first = np.searchsorted(row, np.arange(len(texts)))
        self.wh = tv.hash_spans(buf, starts, ends)
        self.window = window
        self.at = np.flatnonzero(tv.same_row(self.row, window))
        short = tv.window_hashes(self.wh, anchor, 1)
        n = len(self.at)
        self.owner = np.zeros(n, np.int64)
        if n:
            span = window - anchor + 1
            total = len(short) - span + 1
            least = short[:total].copy()
            for j in range(1, span):
                np.minimum(least, short[j : j + total], out=least)
            owner = np.zeros(total, np.int64)
            for j in range(span - 1, -1, -1):
                owner[short[j : j + total] == least] = j
            self.owner = self.at + owner[self.at]
        self.keys = short >> np.uint64(64 - _KEY_BITS)


def _anchor_rows(window: int, anchor: int):
    def emit(ids: pa.Array, texts: pa.Array):
        s = _Suffixes(texts, window, anchor)
        if not len(s.at):
            return None
        ids = np.asarray(ids)
        places = np.unique(s.owner)
        keys, back, count = np.unique(s.keys[places], return_inverse=True, return_counts=True)
        many = count > 1
        out_key = [keys | (np.where(many, _MANY, _ONE).astype(np.uint64) << np.uint64(_KEY_BITS))]
        out_doc = [np.zeros(len(keys), np.int64)]
        out_doc[0][back[::-1]] = ids[s.row[places[::-1]]]
        known = many[back]
        pairs = np.unique(np.stack([keys[back[known]].view(np.int64), ids[s.row[places[known]]]]), axis=1)
        out_key.append(pairs[0].view(np.uint64) | np.uint64(_KNOWN << _KEY_BITS))
        out_doc.append(pairs[1])
        return {"key": np.concatenate(out_key).view(np.int64), "doc": np.concatenate(out_doc)}

    return emit


def _kind(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(_KEY_BITS)).astype(np.int64)


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their 62-bit key: (key, doc) of anchors in more than one slice or place."""
    names = ["key", "doc"]
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # the last key's rows so far: one is enough to go on
    seen = False
    mask = np.int64((1 << _KEY_BITS) - 1)
    for batch in batches:
        key, doc = (np.asarray(batch.column(i)) for i in (0, 1))
        kind = _kind(key)
        through = kind >= _KNOWN
        if through.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[through] & mask), pa.array(doc[through])], names)
        key, doc = np.concatenate([held[0], key[~through]]), np.concatenate([held[1], doc[~through]])
        if not len(key):
            continue
        bare = key & mask
        same = bare[1:] == bare[:-1]
        shared = np.zeros(len(key), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= seen and bool(len(held[0]))
        done = shared & (_kind(key) == _ONE)
        if len(held[0]) and seen:
            done[0] = False  # reported already
        pending = not shared[-1]
        yield pa.RecordBatch.from_arrays([pa.array(bare[done]), pa.array(doc[done])], names)
        held, seen = (key[-1:], doc[-1:]), not pending


class _Tree:
    """The subtrees of prefixes: leaves in order of their words, and how many words each has in common with the leaf before."""

    def __init__(self, prefix: np.ndarray, words: np.ndarray) -> None:
        self.order = np.lexsort((*words.T[::-1], prefix))
        p, w = prefix[self.order], words[self.order]
        self.common = np.full(len(p), -1)
        self.common[1:] = np.where(p[1:] == p[:-1], np.logical_and.accumulate(w[1:] == w[:-1], axis=1).sum(axis=1), -1)

    def node(self, depth: int) -> np.ndarray:
        """Every leaf's ancestor that is `depth` words under the prefix, by number."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


class _Leaves:
    """Occurrences of anchors in order of document and place; left and n say which windows each stands for."""

    def __init__(self, prefix: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, n: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        self.columns = [prefix, doc, pos, left, n, before, after]
        self.prefix, self.doc, self.pos, self.left, self.n, self.before, self.after = self.columns
        offsets = np.arange(before.shape[1] + 1)
        self.windows = (offsets <= left[:, None]) & (offsets > (left - n)[:, None])  # by how far a window starts before the anchor

    @staticmethod
    def at(hashes: np.ndarray, place: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """Words before and after the anchors at these places (what lies outside their windows is not looked at)."""
        reach = np.arange(window - anchor)
        return (hashes.take(place[:, None] + step, mode="clip") for step in (-1 - reach, anchor + reach))

    def take(self, rows: np.ndarray) -> _Leaves:
        return _Leaves(*(c[rows] for c in self.columns))

    def join(self, other: _Leaves) -> _Leaves:
        return _Leaves(*(np.concatenate(x) for x in zip(self.columns, other.columns, strict=True)))

    def later(self) -> np.ndarray:
        """Of the leaves' windows, those that start earlier too."""
        out = np.zeros(self.windows.shape, bool)
        ahead, behind = _Tree(self.prefix, self.after), _Tree(self.prefix, self.before)
        reach = self.before.shape[1]
        for j in range(reach + 1):
            some = np.flatnonzero(self.windows[:, j])
            node = ahead.node(reach - j)[some] * (len(self.doc) + 1) + behind.node(j)[some]
            order = np.argsort(node, kind="stable")
            node, some = node[order], some[order]
            new = np.append(True, node[1:] != node[:-1])[: len(node)]
            head = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
            out[some, j] = (self.doc[some] != self.doc[head]) | (self.pos[some] != self.pos[head])
        return out

    def runs(self, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, j = np.nonzero(later)
        return _runs(self.doc[row], self.pos[row] - j)


def _leaf_rows(window: int, anchor: int, docs_with_keys: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(prefix, doc, loc, n, text): leaves that are to be compared between slices, and (loc < 0) runs already known to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in tv.row_slices(batch, tv.filled(batch.column(1))):
                s = _Suffixes(texts, window, anchor)
                if not len(s.at):
                    continue
                ids = np.asarray(part.column(0))
                lists = part.column(2)
                whose = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
                wanted = np.sort(np.asarray(lists.flatten()).view(np.uint64) ^ tv.mix(whose.astype(np.uint64)))
                mine = s.keys[s.owner] ^ tv.mix(s.row[s.at].astype(np.uint64))
                hit = np.searchsorted(wanted, mine)
                ok = np.flatnonzero((hit < len(wanted)) & (wanted[np.minimum(hit, len(wanted) - 1)] == mine)) if len(wanted) else np.zeros(0, np.int64)
                if not len(ok):
                    continue
                owner, start = s.owner[ok], s.at[ok]
                head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                place, n = owner[head], np.diff(np.append(head, len(owner)))
                row = s.row[place]
                order = np.lexsort((place, ids[row]))
                place, n, row, start = place[order], n[order], row[order], start[head][order]
                leaves = _Leaves(s.keys[place].view(np.int64), ids[row], place - s.first[row], place - start, n, *_Leaves.at(s.wh, place, window, anchor))
                later = leaves.later()
                d, p, m = leaves.runs(later)
                stay = leaves.windows & ~later
                long = stay.any(axis=1) & np.isin(leaves.prefix, heavy)
                whole, j = np.nonzero(stay & long[:, None])
                short = np.flatnonzero(stay.any(axis=1) & ~long)
                most = stay.shape[1] - 1 - np.argmax(stay[short, ::-1], axis=1)
                least = np.argmax(stay[short], axis=1)
                full = tv.window_hashes(s.wh, window, 3)
                first = np.concatenate((place[whole] - j, place[short] - most))
                last = np.concatenate((place[whole] - j, place[short] - least)) + window - 1
                size = s.ends[last] - s.starts[first]
                offsets = np.concatenate(([0], np.cumsum(size)))
                text = s.buf[np.repeat(s.starts[first] - offsets[:-1], size) + np.arange(offsets[-1])]
                given = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(text)).cast(pa.string())
                prefix = np.concatenate((full[place[whole] - j].view(np.int64), leaves.prefix[short], tv.mix(d.astype(np.uint64)).view(np.int64)))
                loc = np.concatenate(((leaves.pos[whole] - j) << _LEFT_BITS, leaves.pos[short] << _LEFT_BITS | most, -p - 1))
                doc = np.concatenate((leaves.doc[whole], leaves.doc[short], d))
                count = np.concatenate((np.zeros(len(size), np.int64), m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix), pa.array(doc), pa.array(loc), pa.array(count), pa.concat_arrays([given, pa.nulls(len(d), pa.string())])],
                    ["prefix", "doc", "loc", "n", "text"],
                )

    return docs_with_keys.mapInArrow(run, "prefix bigint, doc bigint, loc bigint, n bigint, text string")


def _runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive positions of a document: document, first position, number."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    doc, pos = doc[keep], pos[keep]
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)))) if len(doc) else np.zeros(0, np.int64)
    return doc[edge], pos[edge], np.diff(np.concatenate((edge, [len(doc)])))


def _walk(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Later windows of every tree, from leaves in order of prefix, document and place: (doc, start, n) runs."""
        held = None  # leaves of the last prefix that stay
        for batch in batches:
            prefix, doc, loc, n = (np.asarray(batch.column(i)) for i in range(4))
            known = loc < 0
            out = [(doc[known], -loc[known] - 1, n[known])]
            if not known.all():
                leaf = np.flatnonzero(~known)
                texts = batch.column(4).take(pa.array(leaf))
                buf, off = tv.text_bytes(texts)
                starts, ends, row = tv.words(buf, off, tv.NOT_SPACE)
                hashes = tv.hash_spans(buf, starts, ends)
                left = loc[leaf] & (1 << _LEFT_BITS) - 1
                place = np.searchsorted(row, np.arange(len(leaf))) + left
                leaves = _Leaves(prefix[leaf], doc[leaf], loc[leaf] >> _LEFT_BITS, left, np.bincount(row, minlength=len(leaf)) - window + 1, *_Leaves.at(hashes, place, window, anchor))
                if held is not None:
                    leaves = held.join(leaves)
                later = leaves.later()
                stay = (leaves.prefix == leaves.prefix[-1]) & (leaves.windows & ~later).any(axis=1)
                later[: 0 if held is None else len(held.doc)] = False  # reported already
                out.append(leaves.runs(later))
                held = leaves.take(np.flatnonzero(stay))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc", "start", "n"])

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, start, n): runs of n consecutive windows of a document, from word `start`, that also start earlier."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    texts = _texts(docs, id_col, text_col)
    anchors = over_texts(texts, "id", "text", "key bigint, doc bigint", _anchor_rows(window, anchor))
    bare = F.col("key").bitwiseAND(F.lit((1 << _KEY_BITS) - 1))
    dealt = anchors.repartition(width, F.when(F.shiftrightunsigned("key", _KEY_BITS) >= _KNOWN, F.xxhash64("doc", "key")).otherwise(bare)).sortWithinPartitions(bare)
    shared = materialize(dealt.mapInArrow(_shared_anchors, "key bigint, doc bigint"))

    total = shared.count()
    # fewer than 8 * width prefixes can have so many of all leaves
    heavy = [r.key for r in shared.groupBy("key").count().where(F.col("count") > max(1.0, total / max(1, width) / 8)).collect()]

    # the texts' exchange by id serves this join and the one of the caller
    keys = shared.repartition(width, "doc").groupBy("doc").agg(F.collect_list("key").alias("keys"))
    rows = _leaf_rows(window, anchor, texts.join(keys, texts["id"] == keys["doc"]).select("id", "text", "keys"), np.array(heavy, np.int64))
    return rows.repartition(width, "prefix").sortWithinPartitions("prefix", "doc", "loc").mapInArrow(_walk(window, anchor), "doc bigint, start bigint, n bigint")


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int) -> DataFrame:
    """id, text, and spans: array of (start, n) of the removed windows; null without any."""
    found = repeated_windows(docs, id_col, text_col, window, anchor)
    # runs are dealt as they are: lists made before the exchange would take several times the room
    spans = found.repartition(shuffle_width(docs.sparkSession), "doc").groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    # the same exchange of texts by id as the one for the anchors' join
    texts = _texts(docs, id_col, text_col)
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("array<struct<start:bigint,n:bigint>>").alias("spans"))
    return texts.join(spans, texts["id"] == spans["doc"], "left").select("id", "text", "spans").unionByName(nameless)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, start, n_words): maximal stretches of a document, in words, covered by windows that start earlier elsewhere."""
    runs = repeated_windows(docs, id_col, text_col, window, anchor).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n") - 1 + window).alias("stop")))).alias("runs"))

    def join(acc, r):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], r["stop"]).alias("stop"))))
        return F.when(F.size(acc) == 0, F.array(r)).when(r["start"] <= last["stop"], longer).otherwise(F.concat(acc, F.array(r)))

    merged = F.aggregate("runs", F.array().cast("array<struct<start:bigint,stop:bigint>>"), join)
    return runs.select("doc", F.explode(merged).alias("r")).select("doc", F.col("r.start").alias("start"), (F.col("r.stop") - F.col("r.start")).alias("n_words"))


def _kept(text: str, starts: np.ndarray, sizes: np.ndarray, window: int) -> tuple[int, int, bytes]:
    words = text.encode().split()  # splits at the six ASCII white-space characters
    if not len(starts):
        return len(words), 0, b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.minimum(starts, len(words)), 1)
    np.add.at(step, np.minimum(starts + sizes - 1 + window, len(words)), -1)
    keep = np.cumsum(step[:-1]) == 0
    return len(words), int(len(words) - keep.sum()), b" ".join(compress(words, keep.tolist()))


def _cut(spanned: DataFrame, schema: str, window: int, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            starts, sizes = (np.asarray(flat.field(i)) if len(flat) else np.zeros(0, np.int64) for i in (0, 1))
            size = np.asarray(lists.value_lengths().fill_null(0))
            head = np.concatenate(([0], np.cumsum(size)))
            out = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                out.append(make(*_kept(text, starts[head[i] : head[i + 1]], sizes[head[i] : head[i + 1]], window)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), list(arrow)[1:], strict=True)]], schema=arrow) if out else pa.RecordBatch.from_pylist([], schema=arrow)

    return spanned.mapInArrow(run, schema)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return _cut(_with_spans(docs, id_col, text_col, window, anchor), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", window, lambda n, r, kept: (n, r, hashlib.sha256(kept).hexdigest()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with the repeated words taken out (kept words joined by one space); untouched texts stay as they are."""
    cut = _cut(_with_spans(docs, id_col, text_col, window, anchor), "id bigint, n bigint, removed bigint, kept string", window, lambda n, r, kept: (n, r, kept.decode()))
    changed = cut.where("removed > 0").groupBy("id").agg(F.first("kept").alias("__kept"))
    out = docs.join(changed, docs[id_col].cast("bigint") == changed["id"], "left")
    return out.select(*[F.coalesce(changed["__kept"], docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    words = {d: (t or "").encode().split() for d, t in rows}
    first: dict[tuple, tuple[int, int]] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] != (d, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS turn FROM win) WHERE turn > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT w.doc_id, count(g.doc_id) AS n_removed, string_agg(x, ' ' ORDER BY w.p) FILTER (g.doc_id IS NULL) AS t
  FROM words AS w LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) AS g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(kept.n_removed, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
