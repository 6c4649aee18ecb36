"""Ids of whole texts by a byte-level BPE of the tokenizers library, each distinct piece encoded once.

Strings of the vocabulary's added tokens in a text are those tokens, as the library has it:
a text is cut around them first. The rest is cut where no pre-token can span. A pre-token is a run of letters, of digits or of
other signs, with at most one space before it, an English contraction, or white space; so
there is an edge before white space that follows a visible character, after single white
space other than a space, and between characters of different classes, but for an
apostrophe before a letter. Characters whose class is not listed here are not cut.

A worker keeps the ids of the pieces it has met in a hash table, of at most KEPT_BYTES:
beyond it, the pieces met more often stay. Pieces are told apart by 128 bits.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa

from lexispark.llm import phrases
from lexispark.llm import textvec as tv

KEPT_BYTES = 48 << 20
AT_ONCE = 1 << 14
_LISTS = 512  # few enough to start no garbage collection
_PIECE_BYTES = 76  # of a piece in the table at half load, but for its ids

_UNKNOWN, _LETTER, _DIGIT, _SIGN, _SPACE, _WHITE = range(6)
#: Ranges of code points that have kept their class in every version of the character database.
LETTER_RANGES = ((0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3041, 0x3093), (0x30A1, 0x30F6))
SIGN_RANGES = ((0x2010, 0x2027), (0x2030, 0x203A), (0x3001, 0x3003))


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of single bytes, and of code points of two and three bytes."""
    one = np.full(256, _UNKNOWN, np.uint8)
    one[0x21:0x7F] = _SIGN
    one[0x30:0x3A] = _DIGIT
    one[0x41:0x5B] = one[0x61:0x7B] = _LETTER
    one[0x20], one[0x09:0x0E] = _SPACE, _WHITE
    more = np.full(1 << 16, _UNKNOWN, np.uint8)
    for point in range(0xC0, 0x530):  # Latin, Greek and Cyrillic
        kind = unicodedata.category(chr(point))
        if kind != "Cn":
            more[point] = _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _SIGN
    for ranges, kind in ((LETTER_RANGES, _LETTER), (SIGN_RANGES, _SIGN)):
        for low, high in ranges:
            more[low : high + 1] = kind
    return one, more


_ONE, _MORE = _classes()


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of every byte's character."""
    out = _ONE[buf]
    high = np.flatnonzero(buf >= 0xC3)
    if len(high):
        lead = buf[high].astype(np.int64)
        two = high[(lead < 0xE0) & (high + 1 < len(buf))]
        out[two] = out[two + 1] = _MORE[(buf[two].astype(np.int64) & 0x1F) << 6 | buf[two + 1] & 0x3F]
        three = high[(lead >= 0xE0) & (lead < 0xF0) & (high + 2 < len(buf))]
        out[three] = out[three + 1] = out[three + 2] = _MORE[(buf[three].astype(np.int64) & 0xF) << 12 | (buf[three + 1].astype(np.int64) & 0x3F) << 6 | buf[three + 2] & 0x3F]
    return out


def _edges() -> np.ndarray:
    """Whether an edge is between characters of two classes, by first * 8 + second."""
    table = np.zeros(64, bool)
    for a in (_LETTER, _DIGIT, _SIGN):
        for b in (_LETTER, _DIGIT, _SIGN, _SPACE, _WHITE):
            table[a * 8 + b] = a != b
        table[_WHITE * 8 + a] = True
    return table


_EDGE = _edges()


def cut(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every piece, and its plain class: that of its run, or 0 if it is of another form. Text starts are piece starts."""
    kind = classes(buf)
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = _EDGE[kind[:-1] << 3 | kind[1:]]
    edge[1:-1] &= (buf[:-1] != 0x27) | (kind[1:] != _LETTER)
    run = np.flatnonzero((kind[1:-1] == _WHITE) & (kind[:-2] >= _SPACE)) + 1  # white space after white space
    starts = off[:-1][off[:-1] < len(buf)]
    run = run[~np.isin(run, starts)] if len(run) else run
    edge[run + 1] = False
    edge[starts] = True
    edge[len(buf)] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    inner = begin + (kind[begin] == _SPACE) * (end - begin > 1)
    plain = kind[inner]
    plain[plain > _SIGN] = 0
    mixed = np.zeros(len(buf) + 1, np.int32)  # changes of class before each byte
    np.cumsum(kind[1:] != kind[:-1], out=mixed[1:-1])
    plain[mixed[end - 1] != mixed[inner]] = 0
    return begin, end, plain


def _byte_letters() -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the letter that stands for each byte in byte-level vocabularies (two columns), and its length."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    made = [chr(b if b in visible else next(spare)).encode() for b in range(256)]
    return np.array([[m[0], m[-1]] for m in made], np.uint8), np.array([len(m) for m in made])


_LETTERS, _LENGTHS = _byte_letters()
_LINE_END = _LETTERS[0x0A].tobytes().decode()


def _spans(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The entries of values in spans, one after the other."""
    head = np.cumsum(size) - size
    return values[np.repeat(begin - head, size) + np.arange(int(size.sum()))]


def identity(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each span: a chained hash, and a sum over its first and last eight bytes."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[8 : 8 + len(buf)] = buf
    eights = np.lib.stride_tricks.as_strided(padded, (len(buf) + 9, 8), (1, 1))
    size = end - begin
    first = eights[begin + 8].view(np.uint64).ravel() & tv.LOW_BYTES[np.minimum(size, 8)]
    last = eights[end].view(np.uint64).ravel() & ~tv.LOW_BYTES[8 - np.minimum(size, 8)]
    check = first * np.uint64(0xD6E8FEB86659FD93) + last * np.uint64(0xA0761D6478BD642F) + size.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    return tv.hash_spans(buf, begin, end) | np.uint64(1), check


class _Growing:
    """A one-dimensional array that is appended to."""

    def __init__(self, values: np.ndarray) -> None:
        self.held, self.n = values, len(values)

    def append(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            held = np.empty(max(n, 3 * len(self.held) // 2, 1024), self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : n] = values
        self.n = n

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class _Table:
    """Open addressing of 128-bit identities to numbers."""

    def __init__(self, room: int) -> None:
        self.mask = np.uint64((1 << max(10, (2 * room - 1).bit_length())) - 1)
        self.slots = np.zeros((int(self.mask) + 1, 2), np.uint64)
        self.number = np.zeros(int(self.mask) + 1, np.int32)

    def room(self) -> int:
        return len(self.number) // 2

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers, -1 where absent."""
        out = np.full(len(key), -1, np.int32)
        left, slot = np.arange(len(key)), (key & self.mask).view(np.int64)
        while len(left):
            held = self.slots.view(np.complex128).ravel().take(slot, mode="clip").view(np.uint64)  # 16 bytes at a time
            same = (held[::2] == key) & (held[1::2] == check)
            out[left] = np.where(same, self.number.take(slot, mode="clip"), -1)
            on = np.flatnonzero(~same & (held[::2] != 0))
            left, key, check = left[on], key[on], check[on]
            slot = slot[on] + 1 & np.int64(self.mask)
        return out

    def put(self, key: np.ndarray, check: np.ndarray, number: np.ndarray) -> None:
        """Of identities that differ and are absent."""
        slot = (key & self.mask).view(np.int64)
        while len(key):
            free = np.flatnonzero(self.slots[slot, 0] == 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[won], 0], self.slots[slot[won], 1], self.number[slot[won]] = key[won], check[won], number[won]
            lost = np.ones(len(key), bool)
            lost[won] = False
            key, check, number = key[lost], check[lost], number[lost]
            slot = slot[lost] + 1 & np.int64(self.mask)


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def fits(path: str) -> bool:
    """Whether the vocabulary's pre-tokens are those that `cut` knows."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    before, model = kind.get("pre_tokenizer") or {}, kind["model"]
    added = kind.get("added_tokens") or []
    return (
        not any(t.get(x) for t in added for x in ("lstrip", "rstrip", "single_word")) and
        kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    )


class PieceEncoder:
    """Ids of whole texts from the ids of their pieces."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES) -> None:
        self.tokenizer = load_tokenizer(path)
        self.by_piece = fits(path)
        self.added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile(b"|".join(map(re.escape, longest_first))) if self.added else None
        self.kept_bytes = kept_bytes
        self.learned = 0
        self._hold(*(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int32, np.uint32, np.int32, np.int32)))

    def _hold(self, key: np.ndarray, check: np.ndarray, sizes: np.ndarray, hits: np.ndarray, ids: np.ndarray, serial: np.ndarray) -> None:
        self.key, self.check, self.hits, self.ids, self.serial = (_Growing(x) for x in (key, check, hits, ids, serial))
        self.first = _Growing(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))
        self.table = _Table(max(1 << 16, 2 * len(key)))
        self.table.put(key, check, np.arange(len(key), dtype=np.int32))

    def renumber(self) -> None:
        """Count pieces from 1 again: numbers hold from here to the next call."""
        self.learned = self.hits.n
        self.serial = _Growing(np.arange(1, self.learned + 1, dtype=np.int32))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        return self.encode_marked(texts)[:2]

    def encode_marked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of ids of each text, and marks of the ids by piece (see `phrases`)."""
        ids, sizes, mark = self._encode_texts(texts)
        return ids, sizes, np.full(len(ids), phrases.ALONE, np.int32) if mark is None else mark

    def _encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        n = len(texts)
        if not self.by_piece:
            made = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.array(x, np.int32) for x in [[], *made]]), np.array([len(x) for x in made], np.int64), None
        buf, off = tv.text_bytes(texts)
        found = self._added(buf, off)
        if not found:
            return self._encode(buf, off)
        # the texts between added tokens, and the tokens, are encoded side by side; then the tokens' ids take the place of their letters'
        start, stop, token = (np.array(x, np.int64) for x in zip(*found, strict=True))
        edges = np.sort(np.concatenate((off, start, stop)))
        ids, sizes, mark = self._encode(buf, edges)
        own = np.searchsorted(edges, start, side="right") - 1
        head = np.cumsum(sizes) - sizes
        after = sizes.copy()
        after[own] = 1
        place = np.cumsum(after) - after
        out = np.empty(int(after.sum()), np.int32)
        marks = np.full(len(out), phrases.ALONE, np.int32)
        rest = np.ones(len(sizes), bool)
        rest[own] = False
        keep = np.flatnonzero(rest & (sizes > 0))
        at = np.repeat(place[keep] - (np.cumsum(sizes[keep]) - sizes[keep]), sizes[keep]) + np.arange(int(sizes[keep].sum()))
        out[at] = _spans(ids, head[keep], sizes[keep])
        marks[at] = _spans(mark, head[keep], sizes[keep])
        out[place[own]] = token
        total = np.concatenate(([0], np.cumsum(after)))
        return out, np.diff(total[np.searchsorted(edges, off)]), marks

    def _added(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, end and id of the added tokens in the texts, leftmost and longest first; none spans two texts."""
        if self.added_pattern is None:
            return []
        data, at, out = buf.tobytes(), 0, []
        while m := self.added_pattern.search(data, at):
            at = m.end()
            border = int(off[np.searchsorted(off, m.start(), side="right")])
            if at > border:  # it would run into the next text: look again for a shorter one that ends before
                m = self.added_pattern.search(data, m.start(), border)
                at = m.end() if m else border
                if not m:
                    continue
            out.append((m.start(), m.end(), self.added[m[0]]))
        return out

    def _encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `encode_marked`, of texts without added tokens."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64), np.zeros(0, np.int32)
        begin, end, plain = cut(buf, off)
        key, check = identity(buf, begin, end)
        number = self.table.find(key, check)
        new = np.flatnonzero(number < 0)
        if len(new):
            order = np.argsort(key[new], kind="stable")
            k, c = key[new][order], check[new][order]
            if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
                order = np.lexsort((check[new], key[new]))
                k, c = key[new][order], check[new][order]
            head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
            first = new[order[head]]
            count = self.hits.n
            self._learn(buf, begin[first], end[first], plain[first], key[first], check[first])
            back = np.empty(len(new), np.int32)
            back[order] = count + np.repeat(np.arange(len(head)), np.diff(np.append(head, len(new))))
            number[new] = back
        self.hits.held[number] += np.uint32(1)  # once a slice
        first = self.first.held[number]
        size = self.first.held[number + 1] - first
        ids = _spans(self.ids.held, first, size)
        total = np.concatenate(([0], np.cumsum(size)))
        sizes = np.diff(total[np.searchsorted(begin, off)])
        mark = phrases.marks(self.serial.held[number], size)
        if self.hits.n * _PIECE_BYTES + 4 * self.ids.n > self.kept_bytes:
            self._forget()
        return ids, sizes, mark

    def _learn(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray, plain: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        sizes = np.zeros(len(begin), np.int64)
        where = np.zeros(len(begin), np.int64)
        parts: list[np.ndarray] = []
        done = 0
        for kind, some in ((True, np.flatnonzero(plain > 0)), (False, np.flatnonzero(plain == 0))):
            ids, n = self._plain(buf, begin[some], end[some]) if kind else self._whole(buf, begin[some], end[some])
            sizes[some], where[some] = n, done + np.cumsum(n) - n
            parts.append(ids)
            done += len(ids)
        self.ids.append(_spans(np.concatenate(parts), where, sizes))
        count = self.hits.n
        self.first.append(self.first.held[count] + np.cumsum(sizes))
        self.hits.append(np.zeros(len(begin), np.uint32))
        self.key.append(key)
        self.check.append(check)
        self.serial.append(np.arange(self.learned + 1, self.learned + 1 + len(begin), dtype=np.int32))
        self.learned += len(begin)
        if self.hits.n > self.table.room():
            self._hold(self.key.all(), self.check.all(), np.diff(self.first.all()), self.hits.all(), self.ids.all(), self.serial.all())
        else:
            self.table.put(key, check, np.arange(count, self.hits.n, dtype=np.int32))

    def _plain(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one pre-token each, and their numbers; their letters are made for all at once, parted by that of a line end."""
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        tokenize, number = self.tokenizer.model.tokenize, attrgetter("id")
        ids: list[np.ndarray] = []
        sizes: list[int] = []
        for i in range(0, len(begin), AT_ONCE):
            size = end[i : i + AT_ONCE] - begin[i : i + AT_ONCE]
            joined = np.full(int(size.sum()) + len(size), 0x0A, np.uint8)
            joined[np.repeat(np.arange(len(size)), size) + np.arange(int(size.sum()))] = _spans(buf, begin[i : i + AT_ONCE], size)
            two = np.stack((np.ones(len(joined), bool), _LENGTHS[joined] == 2), axis=1)
            words = _LETTERS[joined][two].tobytes().decode().split(_LINE_END)
            for j in range(0, len(size), _LISTS):
                made = list(map(tokenize, words[j : min(j + _LISTS, len(size))]))
                ids.append(np.fromiter(map(number, chain.from_iterable(made)), np.int32))
                sizes += map(len, made)
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _whole(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [buf[a:b].tobytes().decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        made = [e.ids for i in range(0, len(texts), 10_000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False)]
        return np.array([i for x in made for i in x], np.int32), np.array([len(x) for x in made], np.int64)

    def _forget(self) -> None:
        """Keep the half of the pieces that were met in more slices, later ones on ties."""
        hits, sizes = self.hits.all(), np.diff(self.first.all())
        keep = np.sort(np.argsort(hits, kind="stable")[len(hits) // 2 :])
        ids = _spans(self.ids.held, self.first.held[keep], sizes[keep])
        self._hold(self.key.all()[keep], self.check.all()[keep], sizes[keep], hits[keep] // 2, ids, self.serial.all()[keep])


_ENCODERS: dict[str, PieceEncoder] = {}


def worker_encoder(path: str, kept_bytes: int = KEPT_BYTES) -> PieceEncoder:
    """The encoder that this worker process keeps from task to task; it numbers pieces anew in each."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    _ENCODERS[path].kept_bytes = kept_bytes
    _ENCODERS[path].renumber()
    return _ENCODERS[path]
