"""Quality scores by Bradley-Terry pairwise ranking.

A document's features are shares of its bytes by value, shares of neighbouring byte
classes, and a few word and line statistics, all from the whole text. Weights are
learned from preference pairs (a document marked good against one marked bad) by
logistic loss on feature differences. The threshold is a quantile of the scores of a
validation part, on which nothing is fitted: a given one, or that at which the marks of
the validation part are best told apart. Scores are scaled so that it lies at `CUT`.

Every labelled row is fitted or validates, and every pair counts: a row's pull is that of
all rows of the other mark, by a histogram of their scores (a score's mass is shared by
its two nearest of `BINS` points). The rows' features are written once; a step of L-BFGS
is a pass for the histogram and one for the gradient. Sums are of whole numbers, so that
a model does not depend on partitions. Validation scores are told apart to 1 / `FINE`.

Defined results: null and empty texts have all features 0 and no words, and get the
score of the good documents' mean; repeated rows score alike; labels without a document, and null labels, are
ignored; a null id is never held out nor labelled; equal scores are on the same side of the
threshold; with no pair to learn from every score is the cut's. Extra columns are kept
by `score` inside its row column, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.arrowmap import annotate, freeing, over_texts
from lexispark.llm.scratch import materialize

CUT = 0.3
STEPS, RIDGE, MEMORY = 40, 1e-3, 10
#: Points of the histogram of scores, and how many lie in a unit; those of the validation part.
BINS, PER_UNIT, FINE = 8192, 64, 512
UNIT = 1 << 24
AT_ONCE = 2048  # rows whose numbers are held at once
HELD_OUT_OF = 5
VALIDATE_OF = 5
SHRINK_WORDS = 5.0

# byte classes: upper, lower, digit, space, line end, stop, other punctuation, non-ASCII
_CLASS = np.full(256, 6, np.uint8)
_CLASS[0x41:0x5B] = 0
_CLASS[0x61:0x7B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[[0x2E, 0x2C, 0x3B, 0x3A]] = 5
_CLASS[0x80:] = 7
_CLASSES = 8
_EXTRA = 5
WIDTH = 256 + _CLASSES * _CLASSES + _EXTRA


def features(texts: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers per text."""
    buf, off = tv.text_bytes(texts)
    n = len(texts)
    out = np.zeros((n, WIDTH), np.float32)
    size = np.diff(off)
    if not len(buf):
        return out
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    per = np.maximum(size, 1)[:, None]
    out[:, :256] = np.log1p(1000 * np.bincount(row * 256 + buf, minlength=n * 256).reshape(n, 256) / per)
    kind = _CLASS[buf].astype(np.int32)
    pair = kind[:-1] * _CLASSES + kind[1:]
    inner = row[:-1] == row[1:]
    cells = _CLASSES * _CLASSES
    out[:, 256 : 256 + cells] = np.log1p(1000 * np.bincount(row[:-1][inner] * cells + pair[inner], minlength=n * cells).reshape(n, cells) / per)
    starts, ends, at = tv.words(buf, off, tv.NOT_SPACE)
    words = np.bincount(at, minlength=n)
    kinds = np.bincount(at[_first_of(tv.hash_spans(buf, starts, ends), at)], minlength=n)
    many = np.maximum(words, 1)
    lines = np.bincount(row[buf == 0x0A], minlength=n)
    out[:, -5] = np.log1p(words)
    out[:, -4] = np.bincount(at, ends - starts, minlength=n) / many / 5
    out[:, -3] = kinds / many
    out[:, -2] = np.log1p(1000 * lines / per[:, 0])
    out[:, -1] = np.bincount(at[ends - starts == 1], minlength=n) / many
    return out


def _first_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of one occurrence of each distinct word of each row."""
    return np.unique(h ^ tv.mix(at.astype(np.uint64)), return_index=True)[1]


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Features less the good documents' means, drawn in to 0 where a text has too few words to show shares."""
    words = np.expm1(x[:, -5:-4].astype(np.float64))
    return (x - centre) * (words / (words + SHRINK_WORDS))


def fit(good: np.ndarray, bad: np.ndarray, quantile: float | None = None) -> dict:
    """`learn` from arrays of features of good and bad documents; every VALIDATE_OF-th row of either is for the threshold."""
    x = np.concatenate([good, bad]).reshape(-1, WIDTH)
    label = np.repeat([1, 0], [len(good), len(bad)])
    aside = np.concatenate([np.arange(len(p)) % VALIDATE_OF == 0 for p in (good, bad)])
    model = learn(lambda sums: _added([sums(x, label, aside)]), quantile)
    if len(good) and len(bad):
        check = [p[::VALIDATE_OF] if len(p) >= 2 * VALIDATE_OF else p for p in (good, bad)]
        scores = np.concatenate([centred(p, model["centre"]) @ model["weights"] for p in check])
        q = best_quantile(scores, np.repeat([1, 0], [len(p) for p in check])) if quantile is None else quantile
        model |= {"cut": float(np.quantile(scores, q)), "quantile": q}
    return model


def learn(total: Callable, quantile: float | None = None) -> dict:
    """Weights, centre, scale, threshold, its quantile and slope.

    total(sums) adds sums(features, labels, whether aside for the threshold) -> (keys, whole
    numbers) by key over all labelled rows, into a dict.
    """

    def moments(x, label, aside):
        x = x.astype(np.float64)
        parts = [(label == m) & (aside == a) for m in (0, 1) for a in (0, 1)]
        rows = [np.concatenate(([k.sum()], np.rint(x[k] * UNIT).sum(0), np.rint(x[k] ** 2 * UNIT).sum(0))) for k in parts]
        return np.arange(4 * (2 * WIDTH + 1)), np.concatenate(rows).astype(np.int64)

    got = _dense(total(moments), 4 * (2 * WIDTH + 1)).reshape(2, 2, 2 * WIDTH + 1)
    n = got[:, :, 0]
    many = n.sum(1)
    sums = got[:, :, 1:].sum(1) / UNIT
    both = sums.sum(0) / max(1, many.sum())
    mean, square = both[:WIDTH], both[WIDTH:]
    centre, spread = (sums[1, :WIDTH] / many[1] if many[1] else mean), np.sqrt(np.maximum(square - mean**2, 0)) + 0.05
    if not many.all():
        return {"centre": centre, "weights": np.zeros(WIDTH), "cut": 0.0, "quantile": quantile or 0.0, "slope": 1.0}
    # a mark of too few rows has them both fitted and for the threshold
    parted = (many >= 2 * VALIDATE_OF) & n.all(1)
    fitted = np.where(parted, n[:, 0], many)

    def scores(w, x, label, aside, validate=False):
        own = np.where(parted[label], aside == validate, True)
        x, label = centred(x[own], centre) / spread, label[own]
        return x, label, (x * w).sum(1)  # row by row, whatever rows stand beside it

    def places(s):
        return np.clip((s + BINS / PER_UNIT / 2) * PER_UNIT, 0, BINS - 1.001)

    def histogram(w):
        def sums(x, label, aside):
            _, label, s = scores(w, x, label, aside)
            at = places(s)
            low = at.astype(np.int64)
            upper = np.rint((at - low) * UNIT).astype(np.int64)
            key = label * BINS + low
            return np.concatenate((key, key + 1)), np.concatenate((UNIT - upper, upper))

        return _dense(total(sums), 2 * BINS).reshape(2, BINS) / (fitted[:, None] * UNIT)

    apart = np.arange(1 - BINS, BINS) / PER_UNIT
    share = 1 / (1 + np.exp(-apart))

    def over(h, k):
        """At every point the sum of k(point - point of h) over h."""
        return np.fft.irfft(np.fft.rfft(h, 4 * BINS) * np.fft.rfft(k, 4 * BINS), 4 * BINS)[BINS - 1 : 2 * BINS - 1]

    def loss(w):
        """Mean over pairs of log(1 + exp(bad's score - good's)), and both histograms."""
        h = histogram(w)
        return float(h[0] @ over(h[1], np.logaddexp(0, apart))) + RIDGE / 2 * float(w @ w), h

    def gradient(w, h):
        # the mean pull on a bad row by all good ones, and on a good row by all bad ones, by score
        pulls = over(h[1], share), -over(h[0], share[::-1])

        def sums(x, label, aside):
            x, label, s = scores(w, x, label, aside)
            at = places(s)
            low = at.astype(np.int64)
            out = []
            for m in (0, 1):
                k = label == m
                pull = pulls[m][low[k]] * (1 - (at - low)[k]) + pulls[m][low[k] + 1] * (at - low)[k]
                out.append(np.rint(x[k] * pull[:, None] * UNIT).sum(0))
            return np.arange(2 * WIDTH), np.concatenate(out).astype(np.int64)

        g = _dense(total(sums), 2 * WIDTH).reshape(2, WIDTH) / UNIT
        return (g / fitted[:, None]).sum(0) + RIDGE * w

    w = descend(loss, gradient, np.zeros(WIDTH))
    span = BINS // PER_UNIT * FINE

    def fine(x, label, aside):
        keys = []
        for validate in (False, True):
            _, m, s = scores(w, x, label, aside, validate)
            keys.append((2 * validate + m) * span + np.clip(np.rint((s + BINS / PER_UNIT / 2) * FINE), 0, span - 1).astype(np.int64))
        return np.concatenate(keys), np.ones(sum(map(len, keys)), np.int64)

    got = _dense(total(fine), 4 * span).reshape(2, 2, span)
    point = np.arange(span) / FINE - BINS / PER_UNIT / 2
    middle = [point[np.searchsorted(np.cumsum(h), h.sum() / 2)] for h in got[0]]
    cut, quantile = _best_cut(point, *got[1]) if quantile is None else (_quantile(point, got[1].sum(0), quantile), quantile)
    return {"centre": centre, "weights": w / spread, "cut": float(cut), "quantile": float(quantile), "slope": float(4.0 / max(1e-6, middle[1] - middle[0]))}


def descend(loss: Callable, gradient: Callable, w: np.ndarray) -> np.ndarray:
    """L-BFGS with steps halved until they lower the loss enough. loss(w) -> (value, what gradient(w, it) needs)."""
    value, seen = loss(w)
    g = gradient(w, seen)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        d, back = -g, []
        for s, y in reversed(past):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            d = d / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(past, reversed(back), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step, slope = 1.0, float(g @ d)
        while step > 1e-3:
            new, seen = loss(w + step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        fresh = gradient(w + step * d, seen)
        if (step * d) @ (fresh - g) > 1e-12:
            past = [*past[1 - MEMORY :], (step * d, fresh - g)]
        gain, w, g, value = value - new, w + step * d, fresh, new
        if gain < 1e-4 * value:
            break
    return w


def _added(parts) -> dict:
    out: dict = {}
    for keys, values in parts:
        at, inverse = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(at), np.int64)
        np.add.at(sums, inverse, values)
        for k, v in zip(at.tolist(), sums.tolist(), strict=True):
            out[k] = out.get(k, 0) + v
    return out


def _parts(batch: pa.RecordBatch):
    """Features, labels and places of at most AT_ONCE rows."""
    for i in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(i, AT_ONCE)
        yield tv.text_bytes(part.column(0))[0].view(np.float32).reshape(-1, WIDTH), part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)


def _dense(sums: dict, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[list(sums)] = list(sums.values())
    return out


def _quantile(point: np.ndarray, n: np.ndarray, quantile: float) -> float:
    """np.quantile of points that occur n times."""
    upto, at = np.cumsum(n), quantile * (n.sum() - 1)
    low, high = (point[np.searchsorted(upto, k, side="right")] for k in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def _best_cut(point: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The cut that `best_quantile` has for points that occur bad and good times, and its quantile."""
    some = np.flatnonzero(good + bad)
    point, bad, good = point[some], bad[some], good[some]
    wrong = np.concatenate(([0], np.cumsum(good))) / max(1, good.sum()) + 1 - np.concatenate(([0], np.cumsum(bad))) / max(1, bad.sum())
    best = np.flatnonzero(wrong == wrong.min())
    k = best[len(best) // 2]
    cut = (point[max(0, k - 1)] + point[min(k, len(point) - 1)]) / 2
    return cut, (good + bad)[:k].sum() / (good + bad).sum()


def best_quantile(scores: np.ndarray, marks: np.ndarray) -> float:
    """The quantile below which the share of good marks and above which that of bad marks are least; in the middle of a plateau."""
    order = np.argsort(scores, kind="stable")
    scores, marks = scores[order], marks[order]
    lost = np.concatenate(([0], np.cumsum(marks))) / max(1, marks.sum())
    left = 1 - np.concatenate(([0], np.cumsum(1 - marks))) / max(1, (1 - marks).sum())
    wrong = lost + left
    wrong[1:-1][scores[1:] == scores[:-1]] = np.inf  # no threshold parts equal scores
    best = np.flatnonzero(wrong == wrong.min())
    return float(np.clip((best[len(best) // 2] - 0.5) / max(1, len(scores) - 1), 0, 1))


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    z = (centred(x, model["centre"]) @ model["weights"] - model["cut"]) * model["slope"]
    return 1 / (1 + np.exp(-np.clip(z + np.log(CUT / (1 - CUT)), -30, 30)))


def held_out(doc_id, of: int = HELD_OUT_OF):
    return F.crc32(doc_id.cast("string").cast("binary")) % of == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", quantile: float | None = None) -> dict:
    """A model from all labelled rows outside the held-out part."""
    learned = F.col("id").isNotNull() & ~held_out(F.col("id"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & learned)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learned)

    def emit(ids, texts):
        return {"id": ids, "x": [r.tobytes() for r in features(texts)]}

    made = over_texts(rows, "id", "text", f"id {rows.schema['id'].dataType.simpleString()}, x binary", emit)
    # features meet labels, not texts; one row of each id
    both = made.withColumn("label", F.lit(None).cast("int")).unionByName(marked.select("id", F.col("label").cast("int").alias("label"), F.lit(None).cast("binary").alias("x")))
    one = both.groupBy("id").agg(F.max("label").alias("label"), F.min("x").alias("x")).where("label is not null and x is not null")
    aside = F.pmod(F.xxhash64("id"), F.lit(VALIDATE_OF)) == 0
    table = materialize(one.select("x", "label", aside.alias("aside")))

    def total(sums):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    got = _added(sums(*part) for part in _parts(batch))
                    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], ["key", "value"])

        got = table.mapInArrow(freeing(run), "key bigint, value bigint").groupBy("key").agg(F.sum("value").alias("value")).collect()
        return {r.key: r.value for r in got}

    return learn(total, quantile)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Columns row (all columns of docs) and result.score."""

    def compute(texts: pa.Array, _):
        return (apply(model, features(texts)),)

    return annotate(docs, text_col, "score double", compute)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that score at least the cut, same columns."""
    return score(docs, train(docs, labels)).where(F.col("result.score") >= cut).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score(docs, train(docs, labels))
    return scored.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        F.col("result.score").alias("score"),
        (F.col("result.score") >= CUT).cast("int").alias("predicted"),
    )
