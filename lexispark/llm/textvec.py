"""Numpy views of Arrow text columns: words, word hashes and window hashes without per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words in the white-space word rule.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of the letter-digit word rule, after lower-casing: 0-9, a-z, and every byte of a non-ASCII character.
ALNUM_BYTES = (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100))

SLICE_BYTES = 4 << 20
_LONG_WORD = 1 << 12

M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
BASE_INV = pow(BASE, -1, 1 << 64)


def byte_table(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


NOT_SPACE = ~byte_table(SPACE_BYTES)
ALNUM = byte_table(ALNUM_BYTES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def row_slices(batch: pa.RecordBatch, column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive rows of at most `most` bytes of text; a longer text comes alone."""
    off = offsets(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo)
        lo = hi


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind) if column.buffers()[1] else np.zeros(1, kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def filled(column: pa.Array) -> pa.Array:
    """Nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column, and the offset of each row and the end."""
    off = offsets(column)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes in the table; runs end with their row."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = off[:-1][(off[:-1] < n)]
    first[heads] = inside[heads]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def squeezed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with one space where a word is followed by any separator, and the words' new starts and ends."""
    depth = np.zeros(len(buf) + 2, np.int8)
    depth[starts] += 1
    depth[ends] -= 1  # a word that starts where another ends stays inside
    inside = np.cumsum(depth[:-1], dtype=np.int8).view(bool)[: len(buf)]
    keep = inside.copy()
    keep[ends[ends < len(buf)]] = True
    out = np.where(inside, buf, np.uint8(0x20))[keep]
    at = np.cumsum(keep) - keep
    return out, at[starts], at[ends - 1] + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [M64], np.uint64)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes at a time over all spans at once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(buf) + 1, 8), (1, 1))
    size = ends - starts

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eights[at].view(np.uint64).ravel() & LOW_BYTES[np.minimum(left, 8)]

    h = mix(load(starts, size) ^ (size.astype(np.uint64) * np.uint64(BASE)))
    rest = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    at = 8
    while len(rest):
        h[rest] = mix(h[rest] ^ load(starts[rest] + at, size[rest] - at)) + np.uint64(at)
        at += 8
        rest = rest[size[rest] > at]
    if (size > _LONG_WORD).any():
        import hashlib

        for i in np.flatnonzero(size > _LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def window_hashes(wh: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries of wh; entry i covers i .. i+k-1. Windows may cross rows."""
    n = len(wh)
    if n < k:
        return np.zeros(0, np.uint64)
    source = mix(wh + np.uint64(salt)) if salt else wh
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(source * _powers(BASE, n), dtype=np.uint64, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(BASE_INV, n - k + 1))


def same_row(row: np.ndarray, k: int) -> np.ndarray:
    """Whether the window of k words that starts at each word stays in its row."""
    return row[: len(row) - k + 1] == row[k - 1 :] if len(row) >= k else np.zeros(0, bool)


def code_points(buf: np.ndarray, lo: int, at: np.ndarray) -> np.ndarray:
    """Code-point offsets, from byte lo, of the byte offsets at (all of one row)."""
    if not len(at):
        return at
    heads = np.concatenate(([0], np.cumsum((buf[lo : int(at.max())] & 0xC0) != 0x80)))
    return heads[at - lo]
