"""Phrase collocations from a prefix-free parse of the corpus.

Each piece of a text (pieces end at punctuation) is cut into overlapping chunks: a chunk ends
with the first window of OVERLAP words whose hash is 0 modulo TRIGGER, and the next one begins
with that window. What repeats in the corpus is cut alike wherever it stands, so the chunks
form a dictionary, which is written once with the frequency of each chunk by language. Phrases
are counted inside distinct chunks, weighted by those frequencies. A phrase that starts in the
shared window belongs to the later chunk: a chunk that is not the last of its piece owns the
starts before its last OVERLAP words, and as phrases have no more than OVERLAP + 1 words,
each lies whole inside the chunk that owns its start. So every occurrence counts once.

Only phrases found LEAST times or more matter, as parts of candidates are as frequent as they.
Before phrases are counted by their words, a histogram of hashed phrases over the whole
dictionary excludes those that cannot be frequent: a phrase is no more frequent than its
counter, nor than its own parts. Counters are summed up to LEAST, which decides alike. The
histogram grows with the corpus up to 2^MOST_BITS counters; past that it excludes less and
more rows are shuffled, with the same result.

A candidate is absorbed by a longer one of at least its frequency. Frequencies do not grow
with length, so then a candidate with one word more absorbs it too, and only those are asked.

Defined results: a null lang is `und`; null, empty and word-less texts have no words;
repeated rows count each; extra columns are not read. A language with no candidate, and an
empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.scratch import materialize

MOST_WORDS, LEAST, TOP = 5, 100, 2000
OVERLAP, TRIGGER = MOST_WORDS - 1, 24
#: Counters: so many phrases for each on average, and their number as powers of 2.
FILL, LEAST_BITS, MOST_BITS, PIECE_BITS = 40, 16, 25, 14
#: Distinct phrases that a task holds before it gives out their counts.
HELD = 400_000
#: Characters of the dictionary for a task that counts, or an even share of the cores if that is less: a frequent phrase
#: leaves a task once, so small tasks would send it too often.
TASK_CHARS = 64 << 20

#: Bytes that end pieces, and bytes that part words inside a piece.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_GAPS = b"\x20\x09"
_ENDS = tv.byte_table(PIECE_ENDS)
_WORD = ~tv.byte_table(PIECE_ENDS + WORD_GAPS)


def chunk_columns(langs: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """lang, chunk (words joined by a space) and last (whether it ends its piece) of every chunk."""
    raw, off = tv.text_bytes(texts)
    buf = tv.LOWER[raw]
    starts, ends, row = tv.words(buf, off, _WORD)
    if not len(row):
        return [langs.slice(0, 0), pa.array([], pa.string()), pa.array([], pa.bool_())]
    gaps = np.cumsum(_ENDS[buf])[starts]
    head = np.concatenate(([True], (row[1:] != row[:-1]) | (gaps[1:] != gaps[:-1])))  # first word of a piece
    piece = np.cumsum(head) - 1
    wh = tv.hash_spans(buf, starts, ends)
    window = tv.window_hashes(wh, OVERLAP, 11)
    cut = np.zeros(len(row), bool)
    cut[: len(window)] = (window % np.uint64(TRIGGER) == 0) & tv.same_row(piece, OVERLAP)
    first = np.flatnonzero(head | cut)
    nxt = np.concatenate((first[1:], [len(row)]))
    last = np.concatenate((head[first[1:]], [True]))
    stop = np.where(last, nxt, np.minimum(nxt + OVERLAP, len(row))) - 1
    data, starts, ends = tv.squeezed(buf, starts, ends)
    lo, hi = starts[first], ends[stop]
    size = hi - lo
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(lo - offsets[:-1], size) + np.arange(offsets[-1])
    chunks = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at]))
    return [langs.take(pa.array(row[first])), chunks.cast(pa.string()), pa.array(last)]


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, chunk, last, freq) of every distinct chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in tv.row_slices(batch, batch.column(1)):
                yield pa.RecordBatch.from_arrays(chunk_columns(part.column(0), text), ["lang", "chunk", "last"])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "lang string, chunk string, last boolean").groupBy("lang", "chunk", "last").agg(F.count(F.lit(1)).alias("freq"))


class _Slice:
    """The words of a slice of the dictionary, and the hashes of its phrases."""

    def __init__(self, batch: pa.RecordBatch):
        langs, chunks, last, freq = (batch.column(i) for i in range(4))
        self.raw, off = tv.text_bytes(chunks)
        self.starts, self.ends, self.row = tv.words(self.raw, off, _WORD)
        n = len(chunks)
        count = np.bincount(self.row, minlength=n)
        place = np.arange(len(self.row)) - (np.cumsum(count) - count)[self.row]
        owned = np.where(last.to_numpy(zero_copy_only=False), count, np.maximum(count - OVERLAP, 0))
        self.own = place < owned[self.row]
        self.freq = freq.to_numpy()
        names = langs.dictionary_encode() if not pa.types.is_dictionary(langs.type) else langs
        self.names = names.dictionary.to_pylist()
        self.lang = names.indices.to_numpy()
        self.words_by_lang = np.zeros(len(self.names), np.int64)
        np.add.at(self.words_by_lang, self.lang, owned * self.freq)
        salt = np.array([tv.hash_spans(b := np.frombuffer(f"{x} ".encode(), np.uint8), np.array([0]), np.array([len(b)]))[0] for x in self.names], np.uint64)
        self.salt = salt[self.lang]
        self.wh = tv.hash_spans(self.raw, self.starts, self.ends)

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are a phrase that this chunk owns."""
        h = tv.window_hashes(self.wh, k, 20 + k)
        return tv.mix(h ^ self.salt[self.row[: len(h)]]), tv.same_row(self.row, k) & self.own[: len(h)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch in batches:
        for part, _ in tv.row_slices(batch, batch.column(1)):
            yield _Slice(part)


def histogram(words: DataFrame, bits: int) -> np.ndarray:
    """2^bits counters of hashed phrases of all lengths, each summed up to LEAST."""
    piece = min(bits, PIECE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(1 << bits, np.int32)
        for s in _slices(batches):
            for k in range(1, MOST_WORDS + 1):
                h, ok = s.phrases(k)
                np.add.at(bins, (h[ok] >> np.uint64(64 - bits)).astype(np.int64), np.minimum(s.freq, LEAST).astype(np.int32)[s.row[: len(h)][ok]])
            np.minimum(bins, LEAST, out=bins)
        if bins.any():  # few bits a counter, as most are low: packed before the shuffle
            parts = bins.astype(np.uint8).reshape(-1, 1 << piece)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([pa.compress(p.tobytes(), "zstd", asbytes=True) for p in parts], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(pa.decompress(raw.as_buffer(), 1 << piece, "zstd"), np.uint8)
                sums[k] = np.minimum(sums[k] + one, LEAST) if k in sums else one.astype(np.uint16)
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(s >= LEAST).tobytes()], pa.binary())], ["piece", "often"])

    pieces = words.mapInArrow(count, "piece bigint, counts binary").repartition("piece").mapInArrow(add, "piece bigint, often binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces.collect():  # one bit a counter, 4 MB at most
        lo = r.piece << (piece - 3)
        out[lo : lo + len(r.often)] = np.frombuffer(r.often, np.uint8)
    return out


def frequent(words: DataFrame, bits: int) -> DataFrame:
    """(lang, phrase, k, f) of the phrases of 1 to MOST_WORDS words found LEAST times or more."""
    import zlib

    packed = zlib.compress(histogram(words, bits).tobytes(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(zlib.decompress(packed), np.uint8)
        held: dict[tuple[str, int], dict[bytes, int]] = {}  # by lang and number of words

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, k), own in held.items():
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array([k] * n, pa.int32()), pa.array(list(own.values()), pa.int64())], ["lang", "phrase", "k", "n"])
            held.clear()

        for s in _slices(batches):
            text, may = s.raw.tobytes(), None
            for k in range(1, MOST_WORDS + 1):
                h, ok = s.phrases(k)
                at = (h >> np.uint64(64 - bits)).astype(np.int64)
                hit = (often[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                may = hit if may is None else hit & may[:-1] & may[1:]  # both parts one word shorter
                i = np.flatnonzero(may & ok)
                rows = s.row[i]
                counts = [held.setdefault((x, k), {}) for x in s.names]
                for x, lo, hi, n in zip(s.lang[rows].tolist(), s.starts[i].tolist(), s.ends[i + k - 1].tolist(), s.freq[rows].tolist(), strict=True):
                    own, phrase = counts[x], text[lo:hi]
                    own[phrase] = own.get(phrase, 0) + n
            if sum(map(len, held.values())) > HELD:
                yield from give()
        yield from give()

    rows = words.mapInArrow(count, "lang string, phrase string, k int, n bigint")
    return rows.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST)


def _words_by_lang(words: DataFrame) -> DataFrame:
    """(lang, n, held, chars): all word occurrences; words and characters of the dictionary."""
    size = F.length("chunk") - F.length(F.replace("chunk", F.lit(" "))) + 1
    owned = F.when(F.col("last"), size).otherwise(size - OVERLAP)
    return words.groupBy("lang").agg(F.sum(owned * F.col("freq")).alias("n"), F.sum(size).alias("held"), F.sum(F.length("chunk")).alias("chars"))


def _part(words, lo, n):
    return F.array_join(F.slice(words, lo, n), " ")


def scored(often: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates that no longer one absorbs, with their lowest cut."""
    words = F.split("phrase", " ")
    long = often.where("k >= 2")
    shorter = F.array(_part(words, F.lit(1), F.col("k") - 1), _part(words, F.lit(2), F.col("k") - 1))
    absorbed = long.where("k >= 3").select("lang", F.explode(shorter).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("more"))
    left = long.join(absorbed, ["lang", "phrase"], "left").where("more IS NULL OR more < f").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(words, F.lit(1), F.col("cut")).alias("first"), _part(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    first = often.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = often.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # a frequent word may begin many candidates: Spark may split these joins on the candidates' side
    whole = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals.select("lang", "n"), "lang")
    # no product passes 38 digits, and a quotient is 10 n at most, since a <= l, r
    score = F.expr("(1000 * (CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)))) DIV (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    whole = whole.withColumn("score", score)
    return whole.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def histogram_bits(words: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (MOST_WORDS * words // FILL).bit_length()))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """The first `top` of each language by score, then frequency, then phrase."""
    words = materialize(dictionary(docs, lang_col, text_col))
    totals = materialize(_words_by_lang(words))
    size = totals.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size["chars"] // TASK_CHARS))
    often = materialize(frequent(words.coalesce(tasks), histogram_bits(size["held"])))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored(often, totals).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
  GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
inside AS (
  SELECT DISTINCT x.lang, x.phrase FROM c AS x JOIN c AS y ON x.lang = y.lang AND y.k > x.k AND y.a >= x.a
    AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c ANTI JOIN inside USING (lang, phrase)) AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 :], ' ')
  JOIN n ON n.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


def brute_force(rows: list[tuple[str | None, str | None]]) -> list[tuple]:
    """The result by definition."""
    import re
    from collections import Counter

    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, MOST_WORDS + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) >= 2 and a >= LEAST}
        gone = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= own[p[i : i + k]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, _, l, r = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(best)[:TOP]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)
