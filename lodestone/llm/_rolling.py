"""Vectorised rolling hashes over byte or word sequences, for the Arrow stages.

A substring's hash is a difference of prefix sums of ``symbol * base**i`` modulo 2**64, times the inverse
power, so any substring costs O(1). Symbols are 64-bit random images of bytes. Some long sequences collide under
every base, so these hashes only choose places (anchors, triggers, minima); whether texts are equal is decided by
BLAKE2 digests or on the texts themselves.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: 64-bit images of the 256 bytes, the same in every process.
BYTE_IMAGE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        inverse = pow(base, -1, 1 << 64)
        steps = np.full(size, base, np.uint64)
        back = np.full(size, inverse, np.uint64)
        steps[0] = back[0] = 1
        have = _POWERS[which] = (np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Prefix:
    """Prefix sums of a symbol sequence; ``of`` hashes the substrings [start, end)."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        forth, self.back = _powers(which, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * forth[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, by start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, concatenated, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, (offsets - offsets[0]) if len(column) else np.zeros(1, np.int64)


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of non-white-space bytes)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.concatenate(([False], ~SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def row_words(part: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends over concatenated rows, words cut at row edges, and the first word of each row."""
    starts, ends = words_of(part)
    inner = np.unique(edges[1:-1])
    if len(starts) and len(inner):
        owner = np.searchsorted(starts, inner, side="right") - 1
        cut = inner[(owner >= 0) & (starts[owner] < inner) & (inner < ends[owner])]
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    return starts, ends, np.searchsorted(starts, edges)


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def word_symbols(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit symbol for each word: of up to 8 bytes, one for each different word; beyond 16 bytes, from a BLAKE2 digest."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.concatenate((raw, np.zeros(24, np.uint8)))
    eight = np.ndarray(len(raw) + 16, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    low = eight[starts] & _MASKS[np.minimum(size, 8)]
    high = eight[np.minimum(starts + 8, len(raw))] & _MASKS[np.clip(size - 8, 0, 8)]
    # Bijective in each part, so words of up to 8 bytes never meet (the length parts those that end in NUL from shorter ones).
    out = mix(mix(low + U(0x9E3779B97F4A7C15)) ^ mix(high * U(0xC2B2AE3D27D4EB4F) + np.maximum(size, 8).astype(np.uint64)))
    short = size < 8
    out[short] ^= size[short].astype(np.uint64) << U(56)
    if len(long := np.flatnonzero(size > 16)):
        data = memoryview(raw.tobytes())
        out[long] = np.frombuffer(b"".join([blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), np.uint64)
    return out


def word_grams(symbols: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` symbols in a row, by start; not a polynomial, so no sequences collide by their form."""
    n = max(0, len(symbols) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix((out + U(0x9E3779B97F4A7C15)) ^ symbols[i : i + n])
    return out


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank where there was white space, and where they begin and end then."""
    if not len(starts):
        return raw[:0], starts, ends
    space = SPACE[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]
    place = np.cumsum(keep)
    out = raw[keep]
    out[space[keep]] = 32
    return out, place[starts] - 1, place[ends - 1]
