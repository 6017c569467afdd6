"""Shared parts of the corpus operators: vectorised word hashing, shared-folder checkpoints, and size-checked broadcasts.

Words are maximal runs of bytes outside `\\x20\\x09-\\x0D`; as UTF-8 never uses those bytes inside a character, a
text can be cut on its bytes. A null text has no words. All hashing works on whole Arrow buffers in bounded chunks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut, shared_folder, small

__all__ = ["CHUNK_BYTES", "WORD", "Words", "chunks", "cut", "fresh", "light", "mix", "sequences", "shared_folder", "shingles", "small", "text_buffer", "within"]

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1_000_000

_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of over so many bytes are hashed one by one.
_LONG = 64


@functools.lru_cache(4)
def _blocks(key: int, n: int) -> np.ndarray:
    """n random values that words' 8-byte blocks are scrambled with."""
    return np.random.default_rng((12, key)).integers(1, _M64, n, dtype=np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.ones(n, np.uint64)
                a[1:] = b
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_WORDS = _Powers(_Q)
#: For hashes of words' beginnings, in toxicity: powers, and a value for each byte, A-Z as a-z.
_BYTES, _FOLDED = _Powers(_P), np.random.default_rng(12).integers(1, _M64, 256, dtype=np.uint64)[_FOLD]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a chunk of texts. starts, ends: byte positions; doc: of each text, the range first[i]:first[i + 1] of its words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, fold: bool = False, separators: np.ndarray | None = None) -> None:
        self.buf, self.offsets, self.fold = buf, offsets, fold
        n = len(buf)
        if separators is None:
            solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        else:
            solid = ~separators[buf]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        edge = offsets[(offsets > 0) & (offsets < n)]
        first[edge] = solid[edge]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        last[edge - 1] = solid[edge - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, key: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: the sum of its 8-byte blocks, each scrambled by its place. Words of up to 8 bytes of equal length never collide; a key unknown to the texts' authors keeps longer ones apart."""
        n, size = len(self.buf), self.ends - self.starts
        raw = np.zeros(n + 8, np.uint8)
        if self.fold:
            np.take(_FOLD, self.buf, out=raw[:n])
        else:
            raw[:n] = self.buf
        eight = np.ndarray((n + 1,), "<u8", raw.data, 0, (1,))
        salt = _blocks(key, _LONG // 8)
        h = size.astype(np.uint64) * np.uint64(_P)
        h += mix(eight[self.starts] & _MASK[np.minimum(size, 8)] ^ salt[0])
        more = np.flatnonzero((size > 8) & (size <= _LONG))
        at = 8
        while len(more):
            left = size[more] - at
            h[more] += mix(eight[self.starts[more] + at] & _MASK[np.minimum(left, 8)] ^ salt[at // 8])
            more, at = more[left > 8], at + 8
        for i in np.flatnonzero(size > _LONG).tolist():
            one = np.zeros(-(-int(size[i]) // 8) * 8, np.uint8)
            one[: size[i]] = raw[self.starts[i] : self.ends[i]]
            h[i : i + 1] += mix(one.view("<u8") ^ _blocks(key, 1 << max(10, (len(one) // 8 - 1).bit_length()))[: len(one) // 8]).sum(dtype=np.uint64)
        return mix(h)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive of the hashes h; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    up, down = _WORDS.to(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1] + np.uint64(k))


def sequences(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k of the hashes h from each place; what shingles gives there."""
    up, _ = _WORDS.to(k)
    total = np.full(len(at), k, np.uint64)
    for i in range(k):
        total += h[at + i] * up[i]
    return mix(total)


def light(df: DataFrame, items: Column, rows: int = 500_000, most: int = 4_000_000) -> DataFrame:
    """df with a broadcast hint if it was counted to hold at most so many rows, and so many items in all; else unchanged."""
    n, m = df.agg(F.count("*"), F.coalesce(F.sum(items), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and m <= most else df


def within(first: np.ndarray, k: int) -> np.ndarray:
    """The positions where k words of one text start, given each text's word range."""
    n = int(first[-1])
    if n < k:
        return np.empty(0, np.int64)
    ok = np.ones(n, bool)
    stop = first[1:]
    for j in range(1, k):
        at = stop - j
        ok[at[(at >= first[:-1])]] = False
    return np.flatnonzero(ok)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of a string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (from, to, bytes, offsets) of texts holding about limit bytes; a longer text is alone."""
    if not len(col):
        return
    raw, off = text_buffer(col)
    a = 0
    while a < len(col):
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), len(col))
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def fresh(name: str, columns: list[str]) -> str:
    """name, or name with underscores before it, such that no column (in any case) is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
