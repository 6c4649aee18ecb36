"""Language identification by a linear-chain conditional random field over words.

A word's evidence for each language is the sum of learned weights of its features: the
word itself (lexicon), its affixes, and its byte bigrams and trigrams with word edges.
Transitions between languages of neighbouring words are learned too. Forward-backward
gives every word of a text its language probabilities; a text's are their mean over its
words with letters. Training sequences join stretches of documents of different
languages, so that switches inside a text occur in them.

All languages are learned. Only a bounded sample is fitted: about SAMPLE_DOCS documents of
each language and SAMPLE_ALL of all, a stretch of STRETCH words of each, drawn by hashes of
the id, one row of each id. Fitting takes the chains in batches of bounded size; with many
languages features share weights. Every word of every text is labelled.

Defined results: null texts and texts without a letter are `und` with score 0; repeated
rows are labelled alike; null labels are not learned; with nothing to learn every text
is `und`. Extra columns are kept by `identify` inside its row column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.arrowmap import annotate, over_texts

HELD_OUT_OF, HELD_OUT_IS = 4, 2
#: Documents of a language that are fitted, and of all languages together (but one of each at least); words of each.
SAMPLE_DOCS, SAMPLE_ALL, STRETCH = 300, 12_000, 120
#: Features are told apart by so many bits, or by fewer where the weights of all languages would pass WEIGHT_CELLS numbers.
BITS, WEIGHT_CELLS = 16, 1 << 23
#: Languages whose sampling rates (a name and a number each) are broadcast; more are joined by a shuffle.
SENT_LANGS = 100_000
#: Numbers (chains x words x languages) that a step of fitting holds at once; it sums over all chains, so the result is the same.
FIT_CELLS = 1 << 22
STEPS, RATE, RIDGE = 40, 0.15, 1e-4
CHAIN = 36
SEGMENT = 32
#: Numbers in the transfer matrices that are held at once.
CARRY_CELLS = 1 << 23

_LETTERS = tv.byte_table([*range(0x61, 0x7B), *range(0x80, 0x100)])
#: Weights of the kinds of features in a word's sum; n-grams share theirs.
_NGRAM, _AFFIX, _WORD = 2.0, 0.7, 1.0


def feature_bits(langs: int) -> int:
    return min(BITS, max(1, (WEIGHT_CELLS // max(1, langs)).bit_length() - 1))


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their weights, and the first feature of each word and the end (buf is lower case)."""
    n = len(starts)
    size = ends - starts
    wide = size + 2  # with an edge mark on each side
    head = np.concatenate(([0], np.cumsum(wide)))
    who = np.repeat(np.arange(n), wide)
    place = np.arange(head[-1]) - head[who]
    b = np.full(head[-1], 2, np.uint64)
    inner = (place > 0) & (place <= size[who])
    b[inner] = buf[starts[who[inner]] + place[inner] - 1]
    b[head[1:] - 1] = 3
    shift = np.uint64(64 - bits)

    def numbered(x: np.ndarray, salt: int) -> np.ndarray:
        return (tv.mix(x + np.uint64(salt << 40)) >> shift).astype(np.int64)

    two = b[:-1] | (b[1:] << np.uint64(8))
    three = two[:-1] | (b[2:] << np.uint64(16))
    keep2 = place[:-1] < wide[who[:-1]] - 1
    keep3 = place[:-2] < wide[who[:-2]] - 2
    ids = [numbered(two[keep2], 2), numbered(three[keep3], 3)]
    words = [who[:-1][keep2], who[:-2][keep3]]
    count = np.maximum(1, wide * 2 - 3)
    weights = [_NGRAM / count[words[0]], _NGRAM / count[words[1]]]
    every = np.arange(n)
    for k in (2, 3, 4):
        last = np.minimum(size, k)
        ids.append(numbered(tv.hash_spans(buf, starts, starts + last) & np.uint64((1 << 40) - 1), 10 + k))
        ids.append(numbered(tv.hash_spans(buf, ends - last, ends) & np.uint64((1 << 40) - 1), 20 + k))
        words += [every, every]
        weights += [np.full(n, _AFFIX)] * 2
    ids.append(numbered(tv.hash_spans(buf, starts, ends) & np.uint64((1 << 40) - 1), 30))
    words.append(every)
    weights.append(np.full(n, _WORD))
    who = np.concatenate(words)
    order = np.argsort(who, kind="stable")
    return np.concatenate(ids)[order], np.concatenate(weights)[order], np.searchsorted(who[order], np.arange(n + 1))


def lettered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word has a letter, taking every non-ASCII byte for a part of one."""
    seen = np.concatenate(([0], np.cumsum(_LETTERS[buf])))
    return seen[ends] > seen[starts]


def emissions(weights: np.ndarray, ids: np.ndarray, share: np.ndarray, first: np.ndarray) -> np.ndarray:
    if len(first) < 2:
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[ids] * share[:, None], first[:-1], axis=0)


class Crf:
    def __init__(self, langs: list[str]) -> None:
        n = max(1, len(langs))
        self.langs = langs
        self.bits = feature_bits(n)
        self.weights = np.zeros((1 << self.bits, n))
        self.moves = np.zeros((n, n))
        self.start = np.zeros(n)

    def fit(self, stretches: list[tuple[int, list[bytes]]], seed: int = 13) -> Crf:
        """stretches: (language number, words). Adam on the conditional log likelihood of joined stretches."""
        rnd = np.random.default_rng(seed)
        vocabulary: dict[bytes, int] = {}
        chains, marks = [], []
        pool = [(k, [vocabulary.setdefault(w, len(vocabulary)) for w in ws]) for k, ws in stretches if ws]
        by_lang: dict[int, list[list[int]]] = {}
        for k, ws in pool:
            by_lang.setdefault(k, []).append(ws)
        for k, ws in pool:  # cut each stretch into pieces; half of the chains switch to another language
            at = 0
            while at < len(ws):
                chain, mark = [], []
                lang, own = k, ws[at : at + CHAIN]
                at += CHAIN
                if rnd.random() < 0.5 and len(by_lang) > 1:
                    other = int(rnd.choice([x for x in by_lang if x != k]))
                    text = by_lang[other][int(rnd.integers(len(by_lang[other])))]
                    cut, begin = int(rnd.integers(4, CHAIN - 4)), int(rnd.integers(max(1, len(text) - CHAIN)))
                    chain, mark = own[:cut] + text[begin : begin + CHAIN - cut], [lang] * len(own[:cut]) + [other] * len(text[begin : begin + CHAIN - cut])
                else:
                    chain, mark = own, [lang] * len(own)
                chains.append(chain)
                marks.append(mark)
        if not chains:
            return self
        n, t = len(chains), CHAIN
        x, y = np.zeros((n, t), np.int32), np.zeros((n, t), np.int32)
        live = np.zeros((n, t), bool)
        for i, (c, m) in enumerate(zip(chains, marks, strict=True)):
            x[i, : len(c)], y[i, : len(m)], live[i, : len(c)] = c, m, True
        ws = list(vocabulary)
        ends = np.cumsum([len(w) for w in ws])
        text, starts, ends = np.frombuffer(b"".join(ws), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64)
        width = len(self.langs)
        size = max(1, FIT_CELLS // (t * width))
        batches = [slice(lo, lo + size) for lo in range(0, n, size)]

        def prepared(part: slice):
            """A batch's words, their features, and its chains in terms of them."""
            own, back = np.unique(x[part][live[part]], return_inverse=True)
            at = np.zeros((len(x[part]), t), np.int64)
            at[live[part]] = back
            return (*word_features(text, starts[own], ends[own], self.bits), at, y[part], live[part])

        kept = [prepared(batches[0])] if len(batches) == 1 else None  # one batch: its features are made once
        params = {"weights": self.weights, "moves": self.moves, "start": self.start}
        m1 = {k: np.zeros_like(v) for k, v in params.items()}
        m2 = {k: np.zeros_like(v) for k, v in params.items()}
        total = live.sum()
        for step in range(1, STEPS + 1):
            g = {k: -RIDGE * total * v for k, v in params.items()}
            for ids, share, first, at, mark, ok in kept or map(prepared, batches):
                e = emissions(self.weights, ids, share, first)
                marginal, pairs, heads = self._expect(e[at], ok)
                ge = np.zeros_like(e)
                np.add.at(ge, (at[ok], mark[ok]), 1)
                for k in range(width):
                    ge[:, k] -= np.bincount(at[ok], marginal[:, :, k][ok], len(e))
                who = np.repeat(np.arange(len(e)), np.diff(first))
                for k in range(width):
                    g["weights"][:, k] += np.bincount(ids, ge[who, k] * share, 1 << self.bits)
                g["moves"] += self._gold_pairs(mark, ok, width) - pairs
                g["start"] += np.bincount(mark[:, 0], minlength=width) - heads
            for k, p in params.items():
                d = g[k] / total
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d**2
                p += RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self

    @staticmethod
    def _gold_pairs(y: np.ndarray, live: np.ndarray, width: int) -> np.ndarray:
        both = live[:, 1:]
        return np.bincount(y[:, :-1][both] * width + y[:, 1:][both], minlength=width * width).reshape(width, width)

    def _expect(self, e: np.ndarray, live: np.ndarray):
        """Marginals (n, t, k), expected transitions, and expected first labels, of chains of one padded length."""
        n, t, k = e.shape
        move = np.exp(self.moves)
        f = np.exp(e - e.max(2, keepdims=True))
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        alpha[:, 0] = np.exp(self.start) * f[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for i in range(1, t):
            a = (alpha[:, i - 1] @ move) * f[:, i]
            alpha[:, i] = np.where(live[:, i, None], a / a.sum(1, keepdims=True), alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            b = (f[:, i + 1] * beta[:, i + 1]) @ move.T
            beta[:, i] = np.where(live[:, i + 1, None], b / b.sum(1, keepdims=True), beta[:, i + 1])
        marginal = alpha * beta
        marginal /= marginal.sum(2, keepdims=True)
        pairs = np.zeros((k, k))
        for i in range(1, t):
            right = f[:, i] * beta[:, i]
            z = ((alpha[:, i - 1] @ move) * right).sum(1)
            ok = live[:, i]
            pairs += move * (alpha[ok, i - 1].T @ (right[ok] / z[ok, None]))
        return marginal, pairs, marginal[:, 0].sum(0)

    def marginals(self, e: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Language probabilities of every word by forward-backward over each row's whole chain.

        Rows are cut into segments that run side by side: each segment's transfer matrix
        carries forward and backward messages over segment borders, exactly. The more
        languages, the fewer and longer the segments, so that their matrices stay under CARRY_CELLS.
        """
        n, k = e.shape
        if not n:
            return e
        segment = max(SEGMENT, -(-n * k * k // CARRY_CELLS))
        move = np.exp(self.moves)
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        lengths = np.diff(np.concatenate((heads, [n])))
        count = -(-lengths // segment)
        seg_row = np.repeat(np.arange(len(heads)), count)
        seg_no = np.arange(len(seg_row)) - np.repeat(np.cumsum(count) - count, count)
        begin = heads[seg_row] + seg_no * segment
        size = np.minimum(segment, heads[seg_row] + lengths[seg_row] - begin)
        place = np.minimum(begin[:, None] + np.arange(segment), n - 1)
        live = np.arange(segment) < size[:, None]
        f = np.exp(e - e.max(1, keepdims=True))
        s = len(begin)
        carry = np.broadcast_to(np.eye(k), (s, k, k)).copy()
        for i in range(segment):
            new = (carry.reshape(-1, k) @ move).reshape(s, k, k) * f[place[:, i]][:, None, :]
            new /= new.max((1, 2), keepdims=True)
            carry = np.where(live[:, i, None, None], new, carry)
        # messages at segment borders, row by row in step
        a_in, b_out = np.zeros((s, k)), np.ones((s, k))
        first_seg = np.cumsum(count) - count
        at_start = np.exp(self.start) @ np.linalg.pinv(move)  # so that one move leads to the start weights
        a_in[first_seg] = at_start
        for j in range(1, int(count.max())):
            i = first_seg[count > j] + j
            m = np.einsum("ni,nij->nj", a_in[i - 1], carry[i - 1])
            a_in[i] = m / m.sum(1, keepdims=True)
        last_seg = first_seg + count - 1
        for j in range(1, int(count.max())):
            i = last_seg[count > j] - j
            m = np.einsum("nij,nj->ni", carry[i + 1], b_out[i + 1])
            b_out[i] = m / m.sum(1, keepdims=True)
        alpha = np.zeros((n, k))
        a = a_in
        for i in range(segment):
            ok = live[:, i]
            new = (a @ move) * f[place[:, i]]
            new /= new.sum(1, keepdims=True)
            a = np.where(ok[:, None], new, a)
            alpha[place[ok, i]] = new[ok]
        b = b_out
        for i in range(segment - 1, -1, -1):
            ok = live[:, i]
            alpha[place[ok, i]] *= b[ok]
            new = (f[place[:, i]] * b) @ move.T
            b = np.where(ok[:, None], new / new.sum(1, keepdims=True), b)
        return alpha / alpha.sum(1, keepdims=True)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start, end (bytes) and language probabilities of every word with letters."""
        raw, off = tv.text_bytes(texts)
        buf = tv.LOWER[raw]
        starts, ends, row = tv.words(buf, off, tv.NOT_SPACE)
        ok = lettered(buf, starts, ends)
        starts, ends, row = starts[ok], ends[ok], row[ok]
        _, one, back = np.unique(tv.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        e = emissions(self.weights, *word_features(buf, starts[one], ends[one], self.bits))
        return row, starts, ends, self.marginals(e[back], row)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT_IS


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # the labels of the model
    names = sorted(r.lang for r in langs)
    if not names:
        return Crf([])
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(langs)))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / r.n)) for r in langs], "lang string, share double")
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    # a row for each label of the model, which the driver and the tasks hold anyway
    picked = rows.join(F.broadcast(share) if len(langs) <= SENT_LANGS else share, "lang").where(u < F.col("share")).groupBy("id", "lang").agg(F.min("text").alias("text"))  # one row of each id
    picked = picked.select(F.concat_ws("\t", "id", "lang").alias("tag"), "text")

    def emit(tags, texts):
        raw, off = tv.text_bytes(texts)
        buf = tv.LOWER[raw]
        starts, ends, row = tv.words(buf, off, tv.NOT_SPACE)
        ok = lettered(buf, starts, ends)
        starts, ends, row = starts[ok], ends[ok], row[ok]
        out = []
        for i, tag in enumerate(tags.to_pylist()):
            lo, hi = np.searchsorted(row, (i, i + 1))
            spare = int(hi - lo) - STRETCH
            if spare > 0:
                lo += int.from_bytes(tag.encode()[:6], "little") * 2654435761 % (spare + 1)
                hi = lo + STRETCH
            out.append(b"\n".join(buf[s:e].tobytes() for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)))
        return {"tag": tags, "words": out}

    got = sorted((r.tag, bytes(r.words)) for r in over_texts(picked, "tag", "text", "tag string, words binary", emit).collect())
    number = {x: i for i, x in enumerate(names)}
    return Crf(names).fit([(number[t.split("\t", 1)[1]], w.split(b"\n")) for t, w in got if w])


def identify(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """Columns row (all columns of docs) and result: lang, score, and runs of words of one language (start word, words, lang)."""
    langs = model.langs

    def compute(texts: pa.Array, valid: np.ndarray):
        n = len(texts)
        lang, score = ["und"] * n, np.zeros(n)
        mixed = [[] for _ in range(n)]
        if not langs:
            return lang, score, mixed
        row, _, _, p = model.words(texts)
        if len(row):
            k = len(langs)
            mean = np.stack([np.bincount(row, p[:, i], n) for i in range(k)], 1) / np.maximum(1, np.bincount(row, minlength=n))[:, None]
            best = mean.argmax(1)
            buf, off = tv.text_bytes(texts)
            plain = np.concatenate(([0], np.cumsum(_LETTERS[tv.LOWER[buf]] & (buf < 0x80))))
            sure = plain[off[1:]] > plain[off[:-1]]
            for i in np.unique(row).tolist():
                if valid[i] and (sure[i] or any(c.isalpha() for c in texts[i].as_py())):
                    lang[i], score[i] = langs[best[i]], min(1.0, float(mean[i, best[i]]))
            at = p.argmax(1)
            edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
            size = np.diff(np.concatenate((edge, [len(at)])))
            head = np.searchsorted(row, row[edge])
            for e, s, h in zip(edge.tolist(), size.tolist(), head.tolist(), strict=True):
                mixed[row[e]].append({"start": e - h, "n": s, "lang": langs[at[e]]})
        return lang, score, mixed

    return annotate(docs, text_col, "lang string, score double, runs array<struct<start:int,n:int,lang:string>>", compute)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        F.col("result.lang").alias("lang_pred"),
        F.col("result.score").alias("score"),
        F.size("result.runs").alias("n_runs"),
    )
