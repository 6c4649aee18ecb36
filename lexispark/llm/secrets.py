"""Secret scan: fixed patterns, and a character convolutional network over every other candidate.

Candidates are all runs of token characters of at least `LEAST` that no pattern's
findings cover whole. The network sees the whole candidate, in windows of
`BODY` characters, each with the text around it; a candidate's score is its windows'
greatest. A first network is trained on generated tokens of both kinds in generated
surroundings. It then learns from all windows of all documents: what the patterns find
(positive) and all candidates that no finding touches (negative). Every slice of texts
trains a copy on its own windows, those with an error that rounds to 0 in parts of
`ERRORS` adding nothing, and the copies' means, weighted by windows, are the network. Its
calibration and threshold come from histograms of all documents' logits, told apart to
1 / `FINE`; generated tokens are at least half of each kind there. Candidates, with all their
windows, fall to one of three parts: one is fitted, on one the scores are calibrated, and on
one the threshold is set, the highest that still finds `RECALL` of the part's positives.
Slices follow the files' splits, and with them the model; histograms do not depend on them.

Defined results: null and empty texts have no spans; every row counts in training, whatever
its id; repeated rows scan alike; candidates of any length are scored whole, in slices of
windows; offsets are code points, end exclusive. Extra columns are kept by `scan` inside its
row column.
"""

from __future__ import annotations

import copy
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.arrowmap import annotate, over_texts

#: The patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "model")

LEAST = 8
BEFORE, BODY, AFTER = 24, 40, 8
WIDTH = BEFORE + BODY + AFTER
#: Windows that are held at once.
STEP = 8192
RECALL = 0.95
EMBED, KERNEL, FILTERS, EPOCHS, BATCH = 8, 5, 16, 12, 64
#: What errors are rounded to, windows that one state of a slice's network scores, and the rate of its steps; bins of logits in a unit, and the logits that have bins.
ERRORS, CHUNK, RATE = 256, 2048, 3e-3
FINE, FARTHEST = 256, 64

_TOKEN = tv.byte_table((string.ascii_letters + string.digits + "+/_.=-").encode())
_HEX = tv.byte_table(b"0123456789abcdef")


def find_all(data: bytes, literal: bytes) -> list[int]:
    out, at = [], data.find(literal)
    while at >= 0:
        out.append(at)
        at = data.find(literal, at + 1)
    return out


def base_spans(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(row, kind, start, end) in bytes of the whole buffer, of every pattern's findings."""
    out = []
    lower, raw = tv.LOWER[buf].tobytes(), buf.tobytes()

    def rows(hits: list[int]) -> list[int]:
        return sorted(set((np.searchsorted(off, np.array(hits, np.int64), side="right") - 1).tolist())) if hits else []

    for d in rows([h for cue in CUES for h in find_all(lower, cue)]):
        for m in ASSIGN.finditer(raw, int(off[d]), int(off[d + 1])):
            if len(m[2]) >= LEAST_VALUE:
                out.append((d, "assign", m.start(), m.end()))
    for d in rows(find_all(raw, b"AKIA")):
        for m in ACCESS.finditer(raw, int(off[d]), int(off[d + 1])):
            if m.end() - m.start() >= LEAST_ACCESS:
                out.append((d, "access", m.start(), m.end()))
    starts, ends, row = tv.words(buf, off, _HEX)
    long = ends - starts >= LEAST_HEX
    out += [(d, "hex", s, e) for d, s, e in zip(row[long].tolist(), starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def candidates(buf: np.ndarray, off: np.ndarray, base: list[tuple[int, str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end of the candidates, and how many of their bytes lie in findings; those wholly in findings are left out."""
    starts, ends, row = tv.words(buf, off, _TOKEN)
    long = ends - starts >= LEAST
    starts, ends, row = starts[long], ends[long], row[long]
    inside = np.zeros(len(starts), np.int64)
    if base and len(starts):
        spans = sorted((s, e) for _, _, s, e in base)
        cover = np.zeros(len(buf) + 1, np.int32)
        np.add.at(cover, [s for s, _ in spans], 1)
        np.add.at(cover, [e for _, e in spans], -1)
        taken = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        inside = taken[ends] - taken[starts]
    ok = inside < ends - starts
    return row[ok], starts[ok], ends[ok], inside[ok]


def places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidate and the first byte of every window."""
    count = np.maximum(1, -(-(ends - starts) // BODY))
    who = np.repeat(np.arange(len(starts)), count)
    return who, starts[who] + (np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)) * BODY


def windows(buf: np.ndarray, off: np.ndarray, row: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte windows (n, WIDTH), 0 beyond the text, from their rows, first bytes and candidates' ends."""
    place = np.arange(WIDTH)
    at = begin[:, None] + place - BEFORE
    # after the candidate's end the right context follows at once
    size = np.minimum(ends - begin, BODY)
    lo, hi = off[row], off[row + 1]
    ok = (at >= lo[:, None]) & (at < hi[:, None]) & (place < (BEFORE + size + AFTER)[:, None])
    out = np.zeros(at.shape, np.uint8)
    out[ok] = buf[at[ok]]
    return np.minimum(out, 128)


class CharCnn:
    """Embedding, one convolution, ReLU, greatest and mean over positions, a logistic unit; a linear calibration on top."""

    def __init__(self, seed: int = 3) -> None:
        rnd = np.random.default_rng(seed)
        self.p = {
            "e": rnd.normal(0, 0.3, (129, EMBED)).astype(np.float32),
            "k": rnd.normal(0, (2 / (KERNEL * EMBED)) ** 0.5, (KERNEL * EMBED, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "w": rnd.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.calibration = (1.0, 0.0)
        self.threshold = 0.5
        #: Windows of documents that it has learned from.
        self.learned = 0

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        n = x.shape[1] - KERNEL + 1
        cols = np.concatenate([e[:, j : j + n] for j in range(KERNEL)], axis=2)
        z = np.maximum(cols @ self.p["k"] + self.p["b"], 0)
        top = z.argmax(1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z.mean(1)], axis=1)
        return cols, z, top, pooled, pooled @ self.p["w"] + self.p["c"]

    def pooled(self, x: np.ndarray, step: int = 128) -> np.ndarray:
        """Greatest and mean of every filter, as _forward has them; embedding and convolution are looked up by pairs of bytes."""
        k = self.p["k"].reshape(KERNEL, EMBED, FILTERS)
        one = np.einsum("be,jef->jbf", self.p["e"], k).astype(np.float32)
        first, second = [(one[j][:, None] + one[j + 1][None]).reshape(-1, FILTERS) for j in (0, 2)]
        last = one[4] + self.p["b"]
        out = np.empty((len(x), 2 * FILTERS), np.float32)
        n = x.shape[1] - KERNEL + 1
        none = np.maximum(first[0] + second[0] + last[0], 0)  # where a window has no more bytes
        ends = x.shape[1] - (x[:, ::-1] != 0).argmax(1)
        wide = np.minimum(-(-(ends + KERNEL - 1) // 8) * 8, x.shape[1])  # a row's own, so that its sums do not depend on others
        for width in np.unique(wide):
            rows, m = np.flatnonzero(wide == width), width - KERNEL + 1
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                at = x[own, :width].astype(np.intp)
                pair = at[:, :-1] * len(one[0]) + at[:, 1:]
                z = first.take(pair[:, :m], 0)
                z += second.take(pair[:, 2 : 2 + m], 0)
                z += last.take(at[:, 4 : 4 + m], 0)
                np.maximum(z, 0, out=z)
                out[own, :FILTERS] = np.maximum(z.max(1), none) if m < n else z.max(1)
                out[own, FILTERS:] = (z.sum(1) + np.float32(n - m) * none) / np.float32(n)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (self.pooled(x) * self.p["w"]).sum(1) + self.p["c"]

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x) + b, -30, 30)))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        cols, z, top, pooled, logit = self._forward(x)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        g = {"w": pooled.T @ d, "c": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["w"]
        dz = np.repeat(dp[:, None, FILTERS:] / z.shape[1], z.shape[1], 1)
        i, f = np.ogrid[: len(x), :FILTERS]
        dz[i, top, f] += dp[:, :FILTERS]
        dz *= z > 0
        flat = dz.reshape(-1, FILTERS)
        g["k"] = cols.reshape(len(flat), -1).T @ flat
        g["b"] = flat.sum(0)
        dc = (flat @ self.p["k"].T).reshape(cols.shape)
        de = np.zeros((*x.shape, EMBED), np.float32)
        for j in range(KERNEL):
            de[:, j : j + z.shape[1]] += dc[:, :, j * EMBED : (j + 1) * EMBED]
        at = (x.astype(np.intp)[:, :, None] * EMBED + np.arange(EMBED)).ravel()
        g["e"] = np.bincount(at, de.ravel(), self.p["e"].size).reshape(self.p["e"].shape).astype(self.p["e"].dtype)
        return g

    def _step(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        """A step of Adam."""
        t = state["t"] = state.get("t", 0) + 1
        for k, g in self._gradients(x, y).items():
            m, v2 = state.get(k, (0, 0))
            m, v2 = state[k] = 0.9 * m + 0.1 * g, 0.999 * v2 + 0.001 * g * g
            self.p[k] = self.p[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.999**t)) + 1e-7)

    def fit(self, x: np.ndarray, y: np.ndarray, candidate: np.ndarray, seed: int = 5) -> CharCnn:
        """From windows, their marks, and numbers of their candidates: an eighth of these is for calibration, one for the threshold."""
        rnd = np.random.default_rng(seed)
        part = tv.mix(candidate.astype(np.uint64)) >> np.uint64(61)
        held, limit, own = (np.flatnonzero(p) for p in (part == 0, part == 1, part > 1))
        held, limit, own = (p if len(np.unique(y[p])) == 2 else np.arange(len(x)) for p in (held, limit, own))  # too few for parts
        state: dict = {}
        for _ in range(EPOCHS):
            rnd.shuffle(own)
            for i in range(0, len(own), BATCH):
                self._step(x[own[i : i + BATCH]], y[own[i : i + BATCH]], state, 3e-3)
        self._calibrate(self.logits(x[held]).astype(np.float64), y[held])
        self._limit(self.probability(x[limit][y[limit] == 1]))
        return self

    def tuned(self, x: np.ndarray, y: np.ndarray, secrets: np.ndarray, seed: int = 9) -> CharCnn:
        """A copy that has gone over windows x of marks y once, each batch of wrong negatives beside as many positives: x's own and `secrets`."""
        net, rnd, state = copy.deepcopy(self), np.random.default_rng(seed), {}
        pools = [p[rnd.permutation(len(p))] for p in (x[y == 1], secrets) if len(p)]
        plain = np.flatnonzero(y == 0)
        rnd.shuffle(plain)
        many, used = BATCH // 2, 0
        for i in range(0, len(plain), CHUNK):
            at = plain[i : i + CHUNK]
            wrong = at[np.rint(ERRORS / (1 + np.exp(-np.clip(net.logits(x[at]), -30, 30)))) > 0]
            for j in range(0, len(wrong), many):
                own = x[wrong[j : j + many]]
                turns = range(used, used + len(own))
                other = np.stack([pools[k % len(pools)][k // len(pools) % len(pools[k % len(pools)])] for k in turns])
                used = turns.stop
                net._step(np.concatenate([own, other]), np.repeat(np.array([0, 1], np.float32), [len(own), len(other)]), state, RATE)
        return net

    def _limit(self, found: np.ndarray, weight: np.ndarray | None = None) -> None:
        """The highest threshold that RECALL of these positives' scores reach."""
        order = np.argsort(found, kind="stable")
        weight = np.ones(len(found)) if weight is None else weight[order]
        below = np.cumsum(weight) - weight
        self.threshold = float(found[order[np.searchsorted(below, (1 - RECALL) * weight.sum(), side="right") - 1]]) if len(found) else 0.5

    def _calibrate(self, logit: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> None:
        a, b = 1.0, 0.0
        weight = np.full(len(y), 1 / len(y)) if weight is None else weight / weight.sum()
        for _ in range(300):  # logistic regression on the logit, with a pull to the identity
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            a -= 0.05 * ((weight * (p - y) * logit).sum() + 0.01 * (a - 1))
            b -= 0.05 * ((weight * (p - y)).sum() + 0.01 * b)
        self.calibration = (float(a), float(b))


_ALPHABETS = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.digits + "abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-", string.ascii_letters)
_STEMS = "in on re st er an or th al le de la en un pre con pro mail host file page data item node part user time site docs blog news shop test main".split()


def generated(n: int, secret: bool, seed: int) -> list[bytes]:
    """Random tokens: keys of several alphabets, or ordinary long tokens (hosts, paths, words with numbers, numbers, dates, versions)."""
    rnd = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rnd.integers(len(xs)))]
    word = lambda: "".join(pick(_STEMS) for _ in range(int(rnd.integers(1, 4))))
    out = []
    while len(out) < n:
        if secret:
            a = pick(_ALPHABETS)
            t = pick(["", "", "", "sk-", "ghp_", "key_", "xox-"]) + "".join(pick(a) for _ in range(int(rnd.integers(LEAST, 64))))
            t += pick(["", "", "", "=", "=="])
        else:
            num = lambda k: "".join(pick(string.digits) for _ in range(k))
            t = pick([
                f"{word()}{num(1)}.{word()}.{pick(['com', 'org', 'net'])}", f"/{word()}/{word()}/{num(3)}.html", f"{word()}-{word()}-{num(2)}", num(16), num(20),
                f"20{num(2)}-{num(2)}-{num(2)}T{num(2)}", f"{word()}_{word()}_{num(1)}.{word()}", f"v{num(1)}.{num(2)}.{num(2)}-{word()}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", f"{word()}={num(2)}.{num(6)}", f"{word()}{word()}{word()}{num(1)}", f"{word()}{word()}", f"{word()}.".capitalize(), f"{word()}-{word()}", f"{word()}/{word()}", num(8), f"20{num(2)}-{num(2)}-{num(2)}", f"{word()}{num(2)}",
            ])
        if len(t) >= LEAST:
            out.append(t.encode())
    return out


def surrounded(n: int, secret: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of generated tokens among ordinary words, every other secret after a cue, and the tokens' numbers."""
    rnd = np.random.default_rng(seed)
    word = lambda: "".join(_STEMS[int(rnd.integers(len(_STEMS)))] for _ in range(int(rnd.integers(1, 4)))).encode()
    texts, where = [], []
    for i, t in enumerate(generated(n, secret, seed)):
        cue = CUES[int(rnd.integers(len(CUES)))] + [b": ", b"=", b" = ", b'="'][int(rnd.integers(4))] if secret and i % 2 else b""
        before = b" ".join(word() for _ in range(6)) + b" " + cue
        texts.append((before + t + [b" ", b". ", b", ", b"\n"][int(rnd.integers(4))] + b" ".join(word() for _ in range(3))).decode())
        where.append((len(before), len(before) + len(t)))
    buf, off = tv.text_bytes(pa.array(texts, pa.string()))
    s, e = off[:-1] + [a for a, _ in where], off[:-1] + [b for _, b in where]
    who, begin = places(s, e)
    return windows(buf, off, who, begin, e[who]), who


def marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable]:
    """Marks and parts (0 to 7, by their candidate) of all windows of findings and of candidates that no finding touches; and the windows at given places."""
    buf, off = tv.text_bytes(texts)
    base = base_spans(buf, off)
    row, s, e, inside = candidates(buf, off, base)
    value = []
    for d, _, a, b in base:  # a finding's value: the last run of token characters in it
        k = b
        while k > a and _TOKEN[buf[k - 1]]:
            k -= 1
        value.append((d, k, b))
    row, s, e = np.concatenate([np.array(value, np.int64).reshape(-1, 3), np.stack([row, s, e], 1)[inside == 0]]).T
    who, begin = places(s, e)
    part = (tv.mix(tv.hash_spans(buf, s, e)) >> np.uint64(61)).astype(np.int64)[who]
    return (who < len(value)).astype(np.int64), part, lambda at: windows(buf, off, row[who[at]], begin[at], e[who[at]])


def train(docs: DataFrame, text_col: str = "text", each: int = 1500) -> CharCnn:
    """A network from all documents, and `each` generated tokens of a kind for its filters and as half of either kind."""
    made = [surrounded(each, bool(y), 11 + y) for y in (0, 1)]
    xs, ys = np.concatenate([x for x, _ in made]), np.repeat([0, 1], [len(x) for x, _ in made])
    net = CharCnn().fit(xs, ys.astype(np.float32), np.concatenate([2 * who + y for y, (_, who) in enumerate(made)]))
    bins = 2 * FARTHEST * FINE
    names, size = list(net.p), sum(v.size for v in net.p.values())
    flat = lambda p: np.concatenate([p[k].ravel() for k in names]).astype(np.float64)

    def learned(_, texts):
        y, part, x = marked(texts)
        own = np.flatnonzero(part > 1)
        own_x = np.concatenate([*(x(own[i : i + STEP]) for i in range(0, len(own), STEP)), made[0][0]])
        moved = flat(net.tuned(own_x, np.concatenate([y[own], np.zeros(len(made[0][0]), np.int64)]), made[1][0]).p) - flat(net.p)
        # whole numbers, of which sums are exact
        return {"key": np.arange(size + 1), "value": np.append(np.rint(moved * (1 << 20)).astype(np.int64) * len(own), len(own))}

    got = _total(docs, text_col, learned, size + 1)
    net.learned = int(got[-1])
    moved = got[:-1] / (1 << 20) / max(1, net.learned)
    for k, v in zip(names, np.split(moved, np.cumsum([net.p[k].size for k in names])[:-1]), strict=True):
        net.p[k] = (net.p[k] + v.reshape(net.p[k].shape)).astype(np.float32)

    def histogram(_, texts):
        y, part, x = marked(texts)
        own = np.flatnonzero((part == 0) | (part == 1) & (y == 1))
        keys = []
        for i in range(0, len(own), STEP):
            at = own[i : i + STEP]
            place = np.clip(np.floor((net.logits(x(at)).astype(np.float64) + FARTHEST) * FINE), 0, bins - 1).astype(np.int64)
            keys.append((y[at] + part[at]) * bins + place)  # 0 and 1: calibration; 2: threshold
        key, n = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
        # part 0: 0 or 1 by mark; part 1: 2
        return {"key": key, "value": n}

    counts = _total(docs, text_col, histogram, 3 * bins).reshape(3, bins)
    point = np.arange(bins) / FINE - FARTHEST
    own = [net.logits(x).astype(np.float64) for x, _ in made]

    def joined(m: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of a kind's generated and found windows, with weights: 1 for generated ones, as much or less in all for found ones."""
        some = np.flatnonzero(n)
        each_found = min(1.0, len(own[m]) / max(1, n.sum()))
        return np.concatenate([own[m], point[some]]), np.concatenate([np.ones(len(own[m])), n[some] * each_found])

    parts = [joined(m, counts[m]) for m in (0, 1)]
    net._calibrate(np.concatenate([x for x, _ in parts]), np.repeat([0.0, 1.0], [len(x) for x, _ in parts]), np.concatenate([w / w.sum() for _, w in parts]))
    logit, weight = joined(1, counts[2])
    a, b = net.calibration
    net._limit(1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30))), weight)
    return net


def _total(docs: DataFrame, text_col: str, emit: Callable, size: int) -> np.ndarray:
    """Sums of emitted values by key over all texts, keys from 0 to size."""
    got = over_texts(docs.select(F.lit(0).alias("none"), F.col(text_col).alias("text")), "none", "text", "key bigint, value bigint", emit)
    out = np.zeros(size)
    for r in got.groupBy("key").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        out[r.key] = float(r.value)
    return out


def spans_of(texts: pa.Array, model: CharCnn | None) -> list[list[tuple[str, int, int]]]:
    """Per text: (kind, start, end) in code points, by start, then kind."""
    buf, off = tv.text_bytes(texts)
    found = base_spans(buf, off)
    if model is not None:
        row, s, e, _ = candidates(buf, off, found)
        score = np.zeros(len(row))
        who, begin = places(s, e)
        for i in range(0, len(who), STEP):
            w = who[i : i + STEP]
            np.maximum.at(score, w, model.probability(windows(buf, off, row[w], begin[i : i + STEP], e[w])))
        if len(row):
            found += [(d, "model", a, b) for d, a, b, p in zip(row.tolist(), s.tolist(), e.tolist(), score.tolist(), strict=True) if p >= model.threshold]
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    by_row: dict[int, list] = {}
    for d, k, s, e in found:
        by_row.setdefault(d, []).append((s, KINDS.index(k), e))
    for d, spans in by_row.items():
        spans.sort()
        at = tv.code_points(buf, int(off[d]), np.array([x for s, _, e in spans for x in (s, e)], np.int64)).tolist()
        out[d] = [(KINDS[k], at[2 * i], at[2 * i + 1]) for i, (_, k, _) in enumerate(spans)]
    return out


FIELDS = "spans array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, model: CharCnn | None, text_col: str = "text") -> DataFrame:
    """Columns row (all columns of docs) and result.spans."""

    def compute(texts: pa.Array, _):
        return ([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in spans_of(texts, model)],)

    return annotate(docs, text_col, FIELDS, compute)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("result.spans")
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(spans, lambda s: s["kind"] != "model")
    return scan(docs, train(docs)).select(
        "row.doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(spans).alias("spans"),
    )
