"""Adaptive context-mixing range coder for blocks of token ids.

Blocks are independent: model and coder start anew in each, from the segment's header
alone, and each block carries a CRC of its ids. Many blocks are coded side by side, one per lane of numpy arrays.

An id is predicted in three orders. Order 2 names one id, that which followed the last two
ids the last time. Order 1 has the frequencies of the ids that followed the last one, order
0 those of all ids of the block so far, and an id that is new to the block falls to a prior:
the segment's header says how often each id occurs in it, in powers of two. Two sets of adaptive counts say which order holds
the id: one by how much is known in each order, one by the last two outcomes. Their counts
are summed (mixed in proportion to their evidence) and drive one step of a 64-bit
carry-less range coder; the frequency within the order drives a second.

Order 2 and the counts learn from every id. Frequencies are learnt at the ends of rounds
that grow with the block, by sorting what the block has shown: a range of equal entries of
the sorted list is the id's interval.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1 << 12
LANES = 2048
MOST_BITS = 20
MOST_BLOCK = 1 << 13
_FIRST, _GROWTH = 64, 4  # ids in the first round, and how fast the rounds' ends grow
_STEPS = 32  # positions whose counts and intervals are held at once
_LANES_AT_ONCE = 16  # lanes that are looked up at once
_T2, _HASH = 10, 11  # bits of the order-2 table and of the order-1 contexts
_HALVE = 128
_LOW = np.uint64((1 << 32) - 1)
_ONE, _S16, _S32, _S48 = np.uint64(1), np.uint64(16), np.uint64(32), np.uint64(48)
_FIELDS, _FIELD = np.uint64(0x0001000100010001), np.uint64(0xFFFF)
_UPPER = np.uint64(0x800080008000)
_ODD = np.int64(0x9E3779B1)
#: Outcomes that are possible, by whether order 2 and order 1 know anything; the others' counts are cleared.
_KNOWN = np.array([0xFFFF << (16 * j) for j in range(4)], np.uint64)
_POSSIBLE = np.array([(_KNOWN[0] if conf else 0) | (_KNOWN[1] if bucket else 0) | _KNOWN[2] | _KNOWN[3] for bucket in range(12) for conf in range(4)], np.uint64)
_FRESH = np.uint64(0xFFFF) << np.uint64(48)  # of a block's first round only the prior is possible, and order 2
#: Fields of a run (size, id, begin) and of a context (entries, begin, bucket).
_SIZE, _BEGIN, _ID = (1 << 14) - 1, (1 << 13) - 1, (1 << MOST_BITS) - 1
_CERTAIN = np.uint64((1 << 20) | (1 << 40))  # interval 0 to 1 of 1
_TWENTY = np.uint64((1 << 20) - 1)
#: Order-1 bucket by number of entries.
_BUCKET = np.minimum(5, np.frexp(np.arange(17))[1]).astype(np.int8)


def header(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, and the exponents of their weights."""
    counts = np.zeros(1 + int(ids.max(initial=0)), np.int64)
    for i in range(0, len(ids), 1 << 20):
        counts += np.bincount(ids[i : i + (1 << 20)], minlength=len(counts))
    kinds = np.flatnonzero(counts)
    counts, shift = counts[kinds], 0
    while np.maximum(1, counts >> shift).sum() > _most_parts(bits):
        shift += 1
    return kinds.astype(np.uint32), np.minimum(np.frexp(np.maximum(1, counts >> shift))[1] - 1, MOST_BITS - 1).astype(np.uint8)


def _most_parts(bits: int) -> int:
    """Bound of the prior's total; with that of the outcomes' counts it stays under the coder's 32 bits."""
    return 1 << (17 if bits <= 16 else MOST_BITS)


def _contexts(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.int64) * _ODD >> 13) & ((1 << _HASH) - 1)


def _rounds(size: int) -> list[tuple[int, int]]:
    """Begin and end of every round of blocks of that size."""
    ends = [0, _FIRST]
    while ends[-1] < size:
        ends.append(_GROWTH * ends[-1])
    return [(a, min(b, size)) for a, b in zip(ends, ends[1:])] if size else []


class _Sorted:
    """A sorted list per lane; for every entry of it, the id, and the begin and size of its run of equal entries."""

    def __init__(self, keys: np.ndarray) -> None:
        keys.sort(axis=1)
        self.lanes, self.size = keys.shape
        new = np.ones(keys.shape, bool)
        np.not_equal(keys[:, 1:], keys[:, :-1], out=new[:, 1:])
        self.keys = keys
        self.heads = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.heads, keys.size))
        self.head_keys = keys.reshape(-1)[self.heads]
        self.head_runs = self.heads % self.size << 34 | (self.head_keys & np.uint32(_ID)).astype(np.int64) << 14 | self.sizes

    def runs(self) -> np.ndarray:
        return np.repeat(self.head_runs, self.sizes)


class _Frequencies:
    """What the blocks have shown so far: ids by the id before (order 1), and ids alone (order 0)."""

    def __init__(self, shown: np.ndarray, context: np.ndarray) -> None:
        lanes, size = shown.shape
        self.size = size
        keys = shown.copy()
        keys[:, 1:] |= (_contexts(shown[:, :-1]) << MOST_BITS).astype(np.uint32)
        keys[:, 0] |= np.uint32(_contexts(np.zeros(1, np.int64))[0] << MOST_BITS)
        self.pairs = _Sorted(keys)
        self.singles = _Sorted(shown.copy())
        # per lane and context: bucket << 27 | begin << 14 | entries
        where = (self.pairs.heads // size << _HASH) + (self.pairs.head_keys >> np.uint32(MOST_BITS))
        edge = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        begin = self.pairs.heads[edge]
        n = np.diff(np.append(begin, keys.size))
        kinds = np.diff(np.append(edge, len(where)))
        bucket = np.minimum(5, np.frexp(n)[1]) + np.where(2 * kinds <= n, 6, 0)
        context.fill(0)
        context[where[edge]] = bucket << 27 | begin % size << 14 | n
        self.context = context


def _order2(last: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Place in a lane's order-2 table of the last two ids."""
    return (last * _ODD ^ back * np.int64(0x85EBCA6B)) >> 20 & ((1 << _T2) - 1)


class _Model:
    """Order-2 predictions, and counts of outcomes in 16-bit fields of one number."""

    def __init__(self, lanes: int, bits: int) -> None:
        step = 24 if bits <= 16 else 3
        self.steps = np.array([step << (16 * j) for j in range(4)], np.uint64)
        self.t2 = np.full(lanes << _T2, -4, np.int32)  # id << 2 | confidence (1 or 3)
        self.a = np.full(lanes * 48, _FIELDS, np.uint64)
        self.b = np.full(lanes << 4, _FIELDS, np.uint64)
        every = np.arange(lanes, dtype=np.int64)
        self.base2, self.base_a, self.base_b = every << _T2, every * 48, every << 4
        self.last = np.zeros(lanes, np.int64)
        self.back = np.zeros(lanes, np.int64)
        self.past = np.zeros(lanes, np.int64)
        self.n = 0

    def predict(self, buckets: np.ndarray, fresh: bool) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the outcomes' counts in 16-bit fields, and their total; buckets are four times those of order 1."""
        self.i2 = self.base2 + _order2(self.last, self.back)
        self.p2 = self.t2.take(self.i2, mode="clip")
        known = (self.p2 & 3) + buckets
        self.ia = self.base_a + known
        self.ib = self.base_b + self.past
        self.ca, self.cb = self.a.take(self.ia, mode="clip"), self.b.take(self.ib, mode="clip")
        possible = _POSSIBLE.take(known, mode="clip")
        if fresh:
            possible &= _KNOWN[0] | _FRESH
        ends = ((self.ca + self.cb) & possible) * _FIELDS
        return ends, ends >> _S48

    def update(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        more = self.steps.take(outcome, mode="clip")
        self.a[self.ia] = self.ca + more
        self.b[self.ib] = self.cb + more
        # a right prediction is confident from then on; a wrong one loses that, or is replaced
        hit = np.equal(outcome, 0)
        new = ids << 2 | 1
        new += hit.view(np.int8) << 1
        np.copyto(new, self.p2 ^ 2, where=np.greater(self.p2 & 2, hit.view(np.int8) << 1))
        self.t2[self.i2] = new
        self.past = (self.past << 2 & 12) + outcome
        self.back = self.last
        self.last = ids
        self._age()

    def _age(self) -> None:
        self.n += 1
        if self.n % _HALVE == 0:  # old evidence counts half
            for t in (self.a, self.b):
                t >>= np.uint64(1)
                t &= np.uint64(0x7FFF7FFF7FFF7FFF)
                t += _FIELDS

    def follow(self, ids: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ids by position and lane: whether order 2 names them, and what is known in both orders. As predict and update, where all ids are known."""
        behind = np.concatenate((self.back[None], self.last[None], ids))
        places = _order2(behind[1:-1], behind[:-2]) + self.base2
        self.back, self.last = behind[-2], behind[-1]
        once = (ids << 2 | 1).astype(np.int32)
        said, hit = np.empty(ids.shape, np.int32), np.empty(ids.shape, bool)
        for t in range(len(ids)):
            at, new = places[t], once[t]
            p2 = self.t2.take(at, out=said[t], mode="clip")
            # they differ at most in the confidence: 1 or 3 against 1
            right = np.equal(p2 | 2, new | 2, out=hit[t])
            new += right.view(np.int8) << 1
            np.copyto(new, p2 ^ 2, where=(p2 & 2 != 0) & ~right)
            self.t2[at] = new
        said &= 3
        return hit, said + buckets

    def count(self, known: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """The counts of the outcomes by position and lane, learnt from on the way."""
        before = np.concatenate((self.past[None] >> 2, self.past[None] & 3, outcome))
        at_a, at_b = known + self.base_a, (before[:-2] << 2 | before[1:-1]) + self.base_b
        self.past = before[-2] << 2 | before[-1]
        more = self.steps.take(outcome)
        sums = np.empty(known.shape, np.uint64)
        for t in range(len(known)):
            ca, cb = self.a.take(at_a[t], mode="clip"), self.b.take(at_b[t], mode="clip")
            np.add(ca, cb, out=sums[t])
            ca += more[t]
            cb += more[t]
            self.a[at_a[t]] = ca
            self.b[at_b[t]] = cb
            self._age()
        return sums


def _shift(low: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose interval is under 2^32, and the upper half of their low: the interval is cut to one value of it and widened."""
    out = (reach <= _LOW).nonzero()[0]
    lo, re = low.take(out, mode="clip"), reach.take(out, mode="clip")
    word = lo >> _S32
    re = np.where(word == (lo + re - _ONE) >> _S32, re, (~lo & _LOW) + _ONE)
    low[out] = lo << _S32
    reach[out] = re << _S32
    return out, word


def raw_bits(ids: np.ndarray) -> int:
    return max(1, int(ids.max()).bit_length() if len(ids) else 1)


class _Places:
    """Of every entry of some lanes, the number of its value among the lane's sorted ones (of_entry), and the numbers of the first value and behind the last of its context."""

    def __init__(self, keys: np.ndarray, high: int = 0) -> None:
        lanes, size = keys.shape
        made = keys << 13
        made |= np.arange(size, dtype=made.dtype)
        made.sort(axis=1)
        back = ((made & ((1 << 13) - 1)) + np.arange(lanes)[:, None] * size).reshape(-1)
        made >>= 13
        head = np.ones(keys.shape, bool)
        np.not_equal(made[:, 1:], made[:, :-1], out=head[:, 1:])
        number = (np.cumsum(head, axis=1, dtype=np.int32) - 1).reshape(-1)
        self.shape, self.of_entry = keys.shape, np.empty(lanes * size, np.int32)
        self.of_entry[back] = number
        if high:
            made >>= high
            np.not_equal(made[:, 1:], made[:, :-1], out=head[:, 1:])
            at = np.append(head.reshape(-1).nonzero()[0], lanes * size)
            both = np.empty(lanes * size, np.int32)
            both[back] = np.repeat(number[at[:-1]] | (number[at[1:] - 1] + 1) << 16, np.diff(at))
            self.first, self.last = (both & 0xFFFF).reshape(keys.shape), (both >> 16).reshape(keys.shape)
        self.of_entry = self.of_entry.reshape(keys.shape)

    def shown(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a lane's first entries, how many have values below each number, with the count of these values in the upper half; and where each lane begins."""
        lanes, size = self.shape
        base = np.arange(lanes, dtype=np.int32)[:, None] * np.int32(size + 1)
        count = np.bincount((self.of_entry[:, :start] + (base + 1)).reshape(-1), minlength=lanes * (size + 1)).astype(np.int32)
        count += (count > 0).astype(np.int32) << 16
        return np.cumsum(count.reshape(lanes, size + 1), axis=1, dtype=np.int32).reshape(-1), base


def _fallbacks(shown: np.ndarray, new: np.ndarray, rounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the ids of some lanes, by position and lane: four times the order-1 bucket, the outcome if order 2 fails, its interval."""
    ids = shown.astype(np.int64)
    inner = new.take(ids, mode="clip")
    outcome, buckets = np.full(shown.shape, 3, np.int8), np.zeros(shown.shape, np.int8)
    if len(rounds) > 1:
        keys = ids.copy()
        keys[:, 1:] |= _contexts(ids[:, :-1]) << MOST_BITS
        keys[:, 0] |= _contexts(np.zeros(1, np.int64))[0] << MOST_BITS
        pairs = _Places(keys, MOST_BITS)
        singles = _Places(ids if len(new) > 1 << 17 else ids.astype(np.int32))
        for start, end in rounds[1:]:
            some = slice(start, end)
            # order 0
            below, base = singles.shown(start)
            at = singles.of_entry[:, some] + base
            begin = below.take(at) & 0xFFFF
            size = (below.take(at + 1) & 0xFFFF) - begin
            found = size > 0
            of_0 = begin.astype(np.int64) | size.astype(np.int64) << 20 | start << 40
            # order 1
            below, base = pairs.shown(start)
            at = pairs.of_entry[:, some] + base
            begin, size = below.take(at), below.take(at + 1)
            size = (size & 0xFFFF) - (begin & 0xFFFF)
            first = below.take(pairs.first[:, some] + base)
            both = below.take(pairs.last[:, some] + base) - first
            n = both & 0xFFFF
            buckets[:, some] = (_BUCKET.take(n, mode="clip") + 6 * ((both >> 15 & ~1) <= n) * (n > 0)) << 2
            better = size > 0
            of_1 = (begin - first & 0xFFFF).astype(np.int64) | size.astype(np.int64) << 20 | n.astype(np.int64) << 40
            inner[:, some] = np.where(better, of_1, np.where(found, of_0, inner[:, some].view(np.int64))).view(np.uint64)
            outcome[:, some] = 3 - np.maximum(found, better.view(np.int8) << 1)
    return buckets.T, outcome.T, inner.T


def encode(ids: np.ndarray, block: int = BLOCK, bits: int | None = None) -> dict:
    """Arrays of a segment: per block its number of ids, CRC, number of 32-bit words; all words; the header."""
    bits = bits or raw_bits(ids)
    if bits > MOST_BITS or block > MOST_BLOCK:
        raise ValueError(f"ids of more than {MOST_BITS} bits, or blocks of more than {MOST_BLOCK} ids")
    n = -(-len(ids) // block)
    sizes = np.full(n, block)
    if n:
        sizes[-1] = len(ids) - block * (n - 1)
    shown = np.zeros((n, block), np.uint32)  # a shorter last block is coded with zeros behind
    shown.reshape(-1)[: len(ids)] = ids
    kinds, exponents = header(shown.reshape(-1), bits) if n else (np.zeros(0, np.uint32), np.zeros(0, np.uint8))
    weight = np.uint64(1) << exponents.astype(np.uint64)
    new = np.zeros(1 << bits, np.uint64)
    new[kinds] = np.cumsum(weight) - weight | weight << np.uint64(20) | weight.sum() << np.uint64(40)
    size = int(sizes.max()) if n else 0
    buckets, outcomes, inners = (np.empty((size, n), kind) for kind in (np.int8, np.int8, np.uint64))
    for i in range(0, n, _LANES_AT_ONCE):
        some = slice(i, i + _LANES_AT_ONCE)
        buckets[:, some], outcomes[:, some], inners[:, some] = _fallbacks(shown[some, :size], new, _rounds(size))
    model = _Model(n, bits)
    low, reach = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    lanes_said: list[np.ndarray] = []
    words_said: list[np.ndarray] = []
    every = np.arange(n, dtype=np.int32)
    for start in range(0, size, _STEPS):
        end = min(size, start + _STEPS)
        ids_now = np.ascontiguousarray(shown[:, start:end].T, dtype=np.int64)
        hit, known = model.follow(ids_now, buckets[start:end])
        outcome = np.where(hit, np.int8(0), outcomes[start:end])
        counts = model.count(known, outcome)
        possible = _POSSIBLE.take(known)
        possible[: max(0, _FIRST - start)] &= _KNOWN[0] | _FRESH  # nothing else is known yet
        counts &= possible
        ends = counts * _FIELDS
        total = ends >> _S48
        shift = (outcome.astype(np.int64) << 4).view(np.uint64)
        begin = (ends << _S16) >> shift & _FIELD
        width = (ends >> shift & _FIELD) - begin
        inner = np.where(hit, _CERTAIN, inners[start:end])
        inner_total, inner_begin, inner_width = inner >> np.uint64(40), inner & _TWENTY, inner >> np.uint64(20) & _TWENTY
        for t in range(end - start):
            r = reach // total[t]
            low += r * begin[t]
            reach = r * width[t]
            r = reach // inner_total[t]
            low += r * inner_begin[t]
            reach = r * inner_width[t]
            out, word = _shift(low, reach)
            lanes_said.append(out.astype(np.int32))
            words_said.append(word.astype(np.uint32))
    del buckets, outcomes, inners, model
    for word in (low >> _S32, low & _LOW):
        lanes_said.append(every)
        words_said.append(word.astype(np.uint32))
    lane, word = np.concatenate(lanes_said), np.concatenate(words_said)
    order = np.argsort(lane.astype(np.uint16) if n < 1 << 16 else lane, kind="stable")
    crc = np.array([zlib.crc32(ids[i * block : i * block + s].astype("<u4").tobytes()) for i, s in enumerate(sizes)], np.uint32)
    return {"bits": bits, "kinds": kinds, "exponents": exponents, "sizes": sizes.astype(np.int32), "crcs": crc, "words": np.bincount(lane, minlength=n).astype(np.int32), "payload": word[order]}


def decode(segment: dict) -> np.ndarray:
    """The ids of a segment; raises ValueError if a block does not match its CRC."""
    bits, sizes, words, payload = segment["bits"], segment["sizes"], segment["words"], segment["payload"]
    n = len(sizes)
    if not n:
        return np.zeros(0, np.uint32)
    data = np.concatenate((payload.astype(np.uint64), np.zeros(2, np.uint64)))
    at = (np.cumsum(words) - words).astype(np.int64)
    kinds = segment["kinds"].astype(np.int64)
    weight = 1 << segment["exponents"].astype(np.int64)
    prior = np.cumsum(weight) - weight
    of_part = np.repeat(kinds | prior << 20 | weight << 40, weight)
    model = _Model(n, bits)
    low, reach = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    code = data[at] << _S32 | data[at + 1]
    at += 2
    longest = int(sizes.max())
    shown = np.zeros((n, longest), np.uint32)
    every = np.arange(n, dtype=np.int64)
    context_of = _contexts(np.arange(1 << bits))
    base_context, context = every << _HASH, np.zeros(n << _HASH, np.int32)
    none = np.zeros(n, np.int64)
    for start, end in _rounds(longest):
        columns = np.empty((end - start, n), np.uint32)
        known = none
        if start:
            seen = _Frequencies(shown[:, :start], context)
            behind = n * start  # orders' runs are one behind the other
            seen.singles.head_runs += behind << 34
            runs = np.concatenate((seen.pairs.runs(), seen.singles.runs()))
            base = every * start
            del seen
        # by outcome: parts of the second step; order 1 has its own per lane
        totals = np.array([1, 1, max(start, 1), len(of_part)], np.int64)
        for t in range(end - start):
            if start:
                known = context.take(base_context + context_of.take(model.last, mode="clip"), mode="clip").astype(np.int64)
            ends, total = model.predict(known >> 25 & 0x3C, start == 0)
            r = reach // total
            value = (code - low) // r
            # the upper bit of a field stays where the value has reached its end
            outcome = np.bitwise_count(((value * _FIELDS | _UPPER) - ends) & _UPPER).astype(np.int64)
            shift = (outcome << 4).view(np.uint64)
            begin = (ends << _S16) >> shift & _FIELD
            low += r * begin
            reach = r * ((ends >> shift & _FIELD) - begin)
            parts = totals.take(outcome, mode="clip")
            first = outcome == 1
            if start:
                parts = np.where(first, known & _SIZE, parts)
            r = reach // parts.view(np.uint64)
            value = np.minimum(((code - low) // r).view(np.int64), parts - 1)
            if start:
                into = np.where(first, known >> 14 & _BEGIN, behind)
                run = runs.take(value + base + into, mode="clip")
                x = run >> 14 & _ID
                lower = (run >> 34) - into
                width = run & _SIZE
                sure = (outcome == 0).nonzero()[0]
                x[sure] = model.p2.take(sure, mode="clip") >> 2
                lower[sure] = 0
                width[sure] = 1
            else:
                x, lower, width = model.p2.astype(np.int64) >> 2, np.zeros(n, np.int64), np.ones(n, np.int64)
            new = (outcome == 3).nonzero()[0]
            if len(new):
                which = of_part.take(value.take(new, mode="clip"), mode="clip")
                x[new] = which & _ID
                lower[new] = which >> 20 & _ID
                width[new] = which >> 40
            low += lower.view(np.uint64) * r
            reach = width.view(np.uint64) * r
            columns[t] = x
            model.update(x, outcome)
            out, _ = _shift(low, reach)
            place = at.take(out, mode="clip")
            code[out] = code.take(out, mode="clip") << _S32 | data.take(place, mode="clip")
            at[out] = place + 1
        shown[:, start:end] = columns.T
    ids = shown.reshape(-1)[: int(sizes.sum())]
    edge = np.cumsum(sizes)
    for i, (e, s) in enumerate(zip(edge.tolist(), sizes.tolist(), strict=True)):
        if zlib.crc32(ids[e - s : e].astype("<u4").tobytes()) != segment["crcs"][i]:
            raise ValueError(f"block {i} does not match its checksum")
    return ids
