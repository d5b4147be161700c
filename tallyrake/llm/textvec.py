"""Vectorised word hashing over Arrow binary columns (whole texts, any length).

A batch is worked off in runs of whole documents of about ``CHUNK`` bytes, so the working
memory follows the longest document, not the batch.  Words are the runs of bytes other than
0x20 and 0x09-0x0D.  A word's hash is a polynomial over random byte values, mixed; sequences
of words are hashed by position-weighted sums of word hashes, mixed again (64 bits)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (a bijection on 64-bit words)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = stream(11, 256)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
POSITION = stream(29, 4096) | U(1)
_BASE = U(0xD1342543DE82EF95)


def _powers(n: int, _kept=[np.ones(1, U)]) -> np.ndarray:
    if len(_kept[0]) < n:
        size = 1 << max(8, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _kept[0] = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, _BASE, U)]), dtype=U)
    return _kept[0]


class Words(NamedTuple):
    first: int               # first row of the run in the batch
    rows: int
    hashes: np.ndarray       # of all words of the run
    offsets: np.ndarray      # rows + 1 word offsets
    starts: np.ndarray       # byte positions in the run
    ends: np.ndarray
    data: np.ndarray         # the run's bytes


def byte_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row offsets from 0, bytes) for runs of whole rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1))
        yield i, off[i:j + 1] - off[i], data[off[i]:off[j]]
        i = j


def words(column: pa.Array, lower: bool) -> Iterator[Words]:
    lut = BYTE_LOWER if lower else BYTE
    for first, off, data in byte_runs(column):
        n = len(data)
        space = SPACE[data]
        before = np.ones(n + 1, bool)
        before[1:] = space if n else True
        before[off] = True                       # a document's first byte follows a gap
        inside = ~space
        starts = np.flatnonzero(inside & before[:n])
        after = np.ones(n + 1, bool)
        after[:n] = space
        after[off] = True                        # and its last byte is followed by one
        ends = np.flatnonzero(inside & after[1:]) + 1
        if len(starts):
            lens = ends - starts
            at = np.cumsum(lens) - lens
            spot = np.arange(int(lens.sum())) - np.repeat(at, lens)
            with np.errstate(over="ignore"):
                h = np.add.reduceat(lut[data[inside]] * _powers(int(lens.max()))[spot], at)
                h = mix(h + lens.astype(U) * U(0x9E3779B97F4A7C15))
        else:
            h = np.zeros(0, U)
        yield Words(first, len(off) - 1, h, np.searchsorted(starts, off), starts, ends, data)


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words starting at each word (the last n - 1 starts are left out)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        h = hashes[:m] * POSITION[0]
        for j in range(1, n):
            h = h + hashes[j:j + m] * POSITION[j]
        return mix(h)


def valid_starts(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """True where n words from that start lie in one row (length total - n + 1)."""
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    for c in range(1, n):                        # starts within n - 1 words of a row's end
        at = offsets[1:] - c
        ok[at[(at >= 0) & (at < m)]] = False
    # a short row's end may reach into the row before it; those starts are cleared above too
    return ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:len(x) - step], x[step:])
        have += step
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def pack(columns) -> bytes:
    """Byte planes of equally long columns, so that high zero bytes lie together for the shuffle's compression."""
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in columns)


def unpack(block: bytes, kinds) -> list[np.ndarray]:
    n, at, out = len(block) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        w = np.dtype(k).itemsize
        planes = np.frombuffer(block, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(k))
        at += n * w
    return out


def packed_blocks(columns, bits: int) -> tuple[np.ndarray, list[bytes]]:
    """(buckets, blocks) of columns sorted by the first one, a 64-bit hash whose first bits are the bucket."""
    bucket = (columns[0] >> U(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket[cut], [pack([c[i:j] for c in columns]) for i, j in zip(cut, np.append(cut[1:], len(bucket)))]
