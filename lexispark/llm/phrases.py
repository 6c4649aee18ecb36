"""Phrases of token ids: the frequent pieces of a segment become symbols of their own before it is coded.

A segment's alphabet is the ids that occur in it, in ascending order, and behind them the
pieces of two ids or more that save the most ids; the coder has fewer symbols to code and
to decode. The alphabet travels with the segment, and unfolding takes nothing else.
"""

from __future__ import annotations

import zlib

import numpy as np

MOST_SYMBOLS = 1 << 16
LEAST = 3  # times that a phrase occurs
_AT_ONCE = 1 << 18

#: A mark of every id: the number of the piece that begins there, ALONE for an id by itself, INSIDE for those that follow.
ALONE, INSIDE = 0, -1


def marks(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marks of the ids of pieces of these numbers (over 0) and sizes."""
    out = np.full(int(sizes.sum()), INSIDE, np.int32)
    some = sizes > 0
    out[(np.cumsum(sizes) - sizes)[some]] = np.where(sizes > 1, numbers, ALONE)[some]
    return out


def _pieces(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and number of every piece."""
    start = (mark != INSIDE).nonzero()[0]
    size = np.empty(len(start), np.int64)
    np.subtract(start[1:], start[:-1], out=size[:-1])
    size[-1:] = len(mark) - start[-1:]
    return start, size, mark.take(start)


def _at(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    behind = np.cumsum(n)
    out = np.repeat(first - behind + n, n)
    out += np.arange(len(out))
    return out


def fold(ids: list[np.ndarray], mark: list[np.ndarray], most: int = MOST_SYMBOLS) -> tuple[np.ndarray, dict]:
    """The symbols of a segment that comes in slices, each of whole pieces, and its alphabet."""
    held = np.zeros(1 + max(int(x.max(initial=0)) for x in ids), bool)
    room = 1 + max(int(m.max(initial=ALONE)) for m in mark)
    count, size, where = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
    done = 0
    for x, m in zip(ids, mark, strict=True):
        held[np.bincount(x).nonzero()[0]] = True
        start, n, number = _pieces(m)
        count += np.bincount(number, minlength=room)
        size[number] = n
        start += done
        where[number] = start
        done += len(x)
    count[ALONE] = 0
    kinds = np.flatnonzero(held)
    gain = (count - 1) * (size - 1)
    some = np.flatnonzero((count >= LEAST) & (size > 1))
    if len(some) > max(0, most - len(kinds)):
        some = some[np.lexsort((where[some], -gain[some]))[: max(0, most - len(kinds))]]
    some = some[np.argsort(where[some])]
    symbol_of = np.full(room, -1, np.int32)
    symbol_of[some] = len(kinds) + np.arange(len(some))
    rank = np.zeros(len(held), np.int32)
    rank[kinds] = np.arange(len(kinds))
    # a phrase's ids are those of its last place; phrases are in the order of these
    edges = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    of_slice = np.searchsorted(where[some], edges)
    symbols, phrases = [], [np.zeros(0, np.int32)]
    for i, (x, m) in enumerate(zip(ids, mark, strict=True)):
        here = some[of_slice[i] : of_slice[i + 1]]
        phrases.append(x[_at(where[here] - edges[i], size[here])])
        start, n, number = _pieces(m)
        symbol = symbol_of.take(number)
        chosen = (symbol >= 0).nonzero()[0]
        out = rank.take(x)
        start, n = start.take(chosen), n.take(chosen)
        out[start] = symbol.take(chosen)
        keep = np.ones(len(x), bool)
        keep[_at(start + 1, n - 1)] = False
        symbols.append(out[keep])
    pack = lambda values: zlib.compress(np.asarray(values).astype("<u4").tobytes(), 1)
    return np.concatenate(symbols), {"kinds": pack(kinds), "sizes": pack(size[some]), "ids": pack(np.concatenate(phrases))}


def unfold(symbols: np.ndarray, alphabet: dict) -> np.ndarray:
    """The ids of symbols."""
    kinds, sizes, ids = (np.frombuffer(zlib.decompress(alphabet[k]), "<u4") for k in ("kinds", "sizes", "ids"))
    values = np.concatenate((kinds, ids))
    size = np.concatenate((np.ones(len(kinds), np.int64), sizes.astype(np.int64)))
    first = np.cumsum(size) - size
    made = []
    for i in range(0, len(symbols), _AT_ONCE):
        some = symbols[i : i + _AT_ONCE].astype(np.int64)
        made.append(values.take(_at(first.take(some), size.take(some))))
    return np.concatenate([np.zeros(0, "<u4"), *made])
