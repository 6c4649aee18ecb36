"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the items' normalised words, block by block, so that a
block has a bounded number of words however large the benchmark is. Training words are
streamed through it: after each word it knows the longest suffix that some item
contains. Where that reaches the window length (or a whole shorter item ends), the
words of the window are hit. Runs of words whose neighbours never meet in the items
cannot reach that length and are skipped before the automaton.

Defined results: null and empty texts have no words and are never hit; items without
words are ignored; items with equal text are all reported; a null item id is reported
as ''; repeated rows are judged alike; an empty benchmark hits nothing; extra columns
of either table are ignored by `find_hits` and kept by `decontaminate`.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.arrowmap import annotate
from lexispark.llm.scratch import materialize

WINDOW = 13
#: A document is contaminated from this share of hit words on: n_hit * COVER >= n_words.
COVER = 20
#: Words of items in one automaton; the driver and each task hold one block at a time.
BLOCK_WORDS = 200_000

FIELDS = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:int,end:int>>"


def item_words(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    buf = tv.LOWER[raw]
    starts, ends, _ = tv.words(buf, np.array([0, len(buf)]), tv.ALNUM)
    return [buf[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]


class Automaton:
    """Suffix automaton of many word sequences; states know the items whose windows end there."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.link, self.size, self.next = [-1], [0], [{}]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.whole: dict[int, list[tuple[int, str]]] = {}  # state -> (length, item) of whole short items
        self.inside: dict[int, set[str]] = {}  # state of a full window -> items that contain it
        for item, ws in items:
            state = length = 0
            for i, w in enumerate(ws):
                state, length = self.step(state, length, w)
                if i + 1 >= window:
                    self.inside.setdefault(self.cut(state), set()).add(item)
            if 0 < len(ws) < window:
                self.whole.setdefault(self.cut(state, len(ws)), []).append((len(ws), item))
        self.short_up = [-1] * len(self.size)  # nearest state up the links, itself included, with a whole short item
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.short_up[s] = s if s in self.whole else self.short_up[self.link[s]] if self.link[s] > 0 else -1
        shortest = min((len(ws) for _, ws in items if ws), default=window)
        self.least = min(window, shortest)
        pairs = {(a, b) for _, ws in items for a, b in zip(ws, ws[1:], strict=False)}
        singles = {w for _, ws in items for w in ws}
        self.gate = Gate(singles, pairs)

    def _extend(self, last: int, w: bytes) -> int:
        link, size, nxt = self.link, self.size, self.next
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, q, w)
        cur = len(size)
        size.append(size[last] + 1)
        link.append(0)
        nxt.append({})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: bytes) -> int:
        link, size, nxt = self.link, self.size, self.next
        copy = len(size)
        size.append(size[p] + 1)
        link.append(link[q])
        nxt.append(dict(nxt[q]))
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def step(self, state: int, length: int, w: bytes) -> tuple[int, int]:
        """After one more word: the state and length of the longest suffix that an item contains."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        if w in self.next[state]:
            return self.next[state][w], length + 1
        return 0, 0

    def cut(self, state: int, length: int | None = None) -> int:
        """The state of the suffix of `length` words (a window's, if not given)."""
        length = length or self.window
        while self.link[state] >= 0 and self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, run: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (start, end) in a run of words, and the items."""
        state = length = 0
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for i, w in enumerate(run):
            state, length = self.step(state, length, w)
            if length >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                found |= self.inside.get(self.cut(state), set())
            up = self.short_up[state] if state else -1
            while up > 0:
                for n, item in self.whole[up]:
                    if n <= length:
                        spans.append((i + 1 - n, i + 1))
                        found.add(item)
                parent = self.link[up]
                up = self.short_up[parent] if parent > 0 else -1
        return spans, found


class Gate:
    """Which neighbouring words can meet in an item; may say yes wrongly, never no."""

    def __init__(self, singles: set[bytes], pairs: set[tuple[bytes, bytes]]) -> None:
        ws = sorted(singles)
        joined = np.frombuffer(b"".join(ws), np.uint8)
        ends = np.cumsum([len(w) for w in ws], dtype=np.int64)
        h = tv.hash_spans(joined, np.concatenate(([0], ends[:-1])).astype(np.int64), ends) if ws else np.zeros(0, np.uint64)
        at = {w: i for i, w in enumerate(ws)}
        self.shift = np.uint64(64 - max(20, int(np.ceil(np.log2(16 * max(1, len(pairs)))))))
        size = 1 << (64 - int(self.shift))
        self.one = np.zeros(size, bool)
        self.one[h >> self.shift] = True
        self.two = np.zeros(size, bool)
        if pairs:
            a = np.array([at[x] for x, _ in pairs])
            b = np.array([at[y] for _, y in pairs])
            self.two[self.joint(h[a], h[b])] = True

    def joint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(tv.BASE)) ^ b) * np.uint64(0x94D049BB133111EB) >> self.shift

    def runs(self, h: np.ndarray, row: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Runs (start, end) of at least `least` words in one row whose neighbours all may meet."""
        if least <= 1:
            ok = self.one[h >> self.shift]
            edge = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            starts = np.flatnonzero(ok & (edge | ~np.concatenate(([False], ok[:-1]))))
            after = np.concatenate((edge[1:] | ~ok[1:], [True])) if len(row) else edge
            return list(zip(starts.tolist(), (np.flatnonzero(ok & after) + 1).tolist(), strict=True))
        if len(h) < least:
            return []
        ok = self.two[self.joint(h[:-1], h[1:])] & (row[1:] == row[:-1])
        edges = np.diff(np.concatenate(([0], ok.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
        # neighbouring rows cannot join: the pair across them is never ok
        long = ends - starts >= least
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def hits_of(texts: pa.Array, automata: list[Automaton]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Per text: number of words, merged hit spans in words, items."""
    raw, off = tv.text_bytes(texts)
    buf = tv.LOWER[raw]
    starts, ends, row = tv.words(buf, off, tv.ALNUM)
    n = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    h = tv.hash_spans(buf, starts, ends)
    spans: list[list] = [[] for _ in range(len(texts))]
    items: list[set] = [set() for _ in range(len(texts))]
    for automaton in automata:
        for lo, hi in automaton.gate.runs(h, row, automaton.least):
            run = [buf[s:e].tobytes() for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
            got, found = automaton.scan(run)
            if got:
                d = row[lo]
                spans[d] += [(lo + s - first[d], lo + e - first[d]) for s, e in merged(got)]
                items[d] |= found
    return n, [merged(s) for s in spans], items


def blocks(items: list[tuple[str, list[bytes]]], most: int = BLOCK_WORDS) -> list[list]:
    out: list[list] = []
    room = 0
    for item in items:
        if room < len(item[1]) or not out:
            out.append([])
            room = most
        out[-1].append(item)
        room -= len(item[1])
    return out


def item_blocks(bench: DataFrame, id_col: str, text_col: str, most: int = BLOCK_WORDS):
    """Blocks of (id, words), fetched partition by partition: the benchmark need not fit in the driver at once."""
    block: list = []
    room = most
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    for item, text in rows.toLocalIterator():
        ws = item_words(text)
        if not ws:
            continue
        if block and room < len(ws):
            yield block
            block, room = [], most
        block.append((item, ws))
        room -= len(ws)
    if block:
        yield block


_AUTOMATON: dict[str, Automaton] = {}


def _automaton(name: str, shared, window: int) -> Automaton:
    """The automaton of a block, kept by the worker process from task to task until another is needed."""
    if name not in _AUTOMATON:
        _AUTOMATON.clear()
        _AUTOMATON[name] = Automaton(shared.value, window)
    return _AUTOMATON[name]


def find_hits(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns row (struct of all columns of docs) and result (FIELDS): hit words of each document and the items they come from.

    One pass over docs for each block of benchmark words; one block is the usual case. With
    more, docs are written once, each row with its place; a pass reads places and texts and
    writes only the hits, and the hits of all passes meet their rows by place. Driver and
    workers hold one block and its automaton at a time.
    """
    blocks = item_blocks(bench, item_id, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _pass(docs, text_col, first, window)[0]
    placed = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
    texts = placed.select("at", F.col("row").getField(text_col).alias("text"))
    hits = None
    for block in chain((first, second), blocks):
        found, shared = _pass(texts, "text", block, window)
        some = materialize(found.where("result.n_hit > 0").select("row.at", "result.item_ids", "result.spans"))
        shared.destroy()
        hits = some if hits is None else hits.unionByName(some)
    merged = hits.groupBy("at").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), _united(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    counted = _pass(placed, "text", None, window, inner=text_col)[0].select("row.row", "row.at", "result.n_words")
    out = counted.join(merged, "at", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + (s["end"] - s["start"]))
    return out.select(
        "row",
        F.struct("n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")).alias("result"),
    )


def _pass(docs: DataFrame, text_col: str, block: list | None, window: int, inner: str | None = None):
    """docs with the hits of one block (None: of no item), and the block as sent to the workers. The text may be a field of docs.row."""
    shared, name = None, uuid.uuid4().hex
    if inner is not None:
        docs = docs.select("row", "at", F.col("row").getField(inner).alias(text_col))
    if block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_WORDS words, or one longer item

    def compute(texts: pa.Array, _):
        n, spans, items = hits_of(texts, [] if shared is None else [_automaton(name, shared, window)])
        return n, [sum(e - s for s, e in sp) for sp in spans], [sorted(i) for i in items], [[{"start": int(s), "end": int(e)} for s, e in sp] for sp in spans]

    return annotate(docs, text_col, FIELDS, compute), shared


def _united(spans):
    """Sorted spans, with those that touch as one."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"], grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, start, add)


def is_contaminated(n_hit, n_words, cover: int = COVER):
    return (n_hit > 0) & (n_hit * cover >= n_words)


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW, cover: int = COVER, action: str = "drop", least_span: int = WINDOW) -> DataFrame:
    """docs without benchmark text, same columns.

    action "drop" removes documents over the coverage limit; "cut" removes, from every
    document, the words of hit spans of at least `least_span` words, and of all spans of
    a document over the coverage limit (words are then joined by one space).
    """
    found = find_hits(docs, bench, text_col, window=window)
    over = is_contaminated(F.col("result.n_hit"), F.col("result.n_words"), cover)
    if action == "drop":
        return found.where(~over).select("row.*")
    cut = F.filter("result.spans", lambda s: over | (s["end"] - s["start"] >= least_span))
    pieces = _words_of(F.col("row").getField(text_col))
    left = F.array_join(F.filter(pieces, lambda w, i: ~F.exists(cut, lambda s: (s["start"] <= i) & (i < s["end"]))), " ")
    text = F.when(F.size(cut) > 0, left).otherwise(F.col("row").getField(text_col))
    return found.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def _words_of(text):
    """Words as the automaton counts them, in their original case."""
    return F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_hits(docs, bench)
    r = F.col("result")
    return found.select(
        "row.doc_id",
        r.n_words.alias("n_words"),
        r.n_hit.alias("n_hit"),
        F.size(r.item_ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(r.item_ids, ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(r.n_hit, r.n_words).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """The same results by comparing every window with every window, for tests."""
    wanted: dict[tuple, set[str]] = {}
    for item, text in items:
        ws = item_words(text)
        k = min(window, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            wanted.setdefault(tuple(ws[i : i + k]), set()).add("" if item is None else str(item))
    out = {}
    for doc, text in docs:
        ws = item_words(text)
        hit, found = set(), set()
        for k in range(1, window + 1):
            for i in range(len(ws) - k + 1):
                if tuple(ws[i : i + k]) in wanted:
                    hit |= set(range(i, i + k))
                    found |= wanted[tuple(ws[i : i + k])]
        n = len(hit)
        out[doc] = (len(ws), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and n * COVER >= len(ws))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
sizes AS (SELECT DISTINCT n FROM wanted),
spots AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM spots JOIN wanted USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
