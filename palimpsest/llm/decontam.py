"""Benchmark decontamination by CGK embedding and bit sampling.

A benchmark item has leaked into a document if some run of the document's words is within edit distance
floor((1 - SIMILARITY) * n) of the item's n words. Words are runs of letters and digits, A-Z lower-cased.

1. CGK walks. WALKS random walks start at every word of every document and item: step j copies the current word and
   moves on or stays by a random bit of (j, word), so that texts that differ by few edits have embeddings that differ in
   few places, without aligning anything. A walk is the same for windows of every size until it leaves them.
2. Bit sampling. A table a walk compares a few sampled places of its first steps, more of them for longer items (BANDS).
   An item is in its band's tables with the walks from each of its words: an edit spoils only the walks that pass over it,
   and as an item has more words to start from the longer it is, recall doesn't fall with its length. The tests hold
   it against brute force at the full number of edits (target 0.95).
3. A collision of a document's word and an item's names an item-sized window with its edits' margin on either side. It
   stays if enough of its words are the item's, a bound that no match fails.
4. Verification. What stays is aligned exactly.

Tables take about 60 bytes a word of the items, whatever the items' lengths, and are broadcast in blocks of BLOCK words
of items, each with one scan of the documents. Documents are cut to bounded chunks and no row leaves its task but matches.

Defined cases: a null text has no words; items without words match nothing; of several matches of an item in one
document the one of least distance, then the first, is returned; rows sharing ids are matched row by row, and the best
match of each pair of ids is returned; a null id is returned like any other; empty tables give no rows; extra columns are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import Words, chunks, mix, text_buffer

#: Similarity as a fraction of integers, 4 / 5.
NUM, DEN = 4, 5
#: From so many words on: how many places are sampled, of how many steps.
BANDS = [(1, 1, 1), (3, 2, 2), (5, 3, 3), (9, 5, 7), (15, 7, 9), (25, 8, 10)]
WALKS, BLOCK, PART = 4, 1_000_000, 1_000_000
_SEPARATORS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_STEPS = max(s for _, _, s in BANDS)
_ODD = np.random.default_rng(5).integers(1, 1 << 63, (WALKS, _STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of each band and walk, the sampled places; the first is always one, the last step too.
_PLACES = [[sorted({0, s - 1, *np.random.default_rng((6, r, s)).permutation(np.arange(1, max(1, s - 1)))[: max(0, p - 2)].tolist()}) for r in range(WALKS)] for _, p, s in BANDS]


def walks(h: np.ndarray, start: np.ndarray, r: int, bands: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, key, end) of the walk r from each start over the words h: a hash of the sampled places, and where the last one is."""
    at, last = start.copy(), len(h) - 1
    keys = {b: np.zeros(len(start), np.uint64) for b in bands}
    for j in range(max((BANDS[b][2] for b in bands), default=0)):
        w = h[np.minimum(at, last)]
        for b in bands:
            if j in _PLACES[b][r]:
                keys[b] = (keys[b] ^ w) * np.uint64(0x9E3779B97F4A7C15)
            if j == BANDS[b][2] - 1:
                yield b, mix(keys[b]), at
        at = at + ((w * _ODD[r, j]) >> np.uint64(63)).view(np.int64)


class _Table:
    """Entries by key, with a bitmap before them."""

    def __init__(self, keys: np.ndarray, entries: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.entries = keys[order], entries[order]
        self.bits = max(12, int(16 * len(keys)).bit_length())
        self.map = _bitmap(self.keys, self.bits)

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are in the table, and the range of each one's entries."""
        maybe = np.flatnonzero(self.map[(keys >> np.uint64(64 - self.bits)).view(np.int64)])
        lo, hi = (np.searchsorted(self.keys, keys[maybe], side) for side in ("left", "right"))
        ok = lo < hi
        return maybe[ok], lo[ok], hi[ok]


def _bitmap(keys: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, bool)
    out[(keys >> np.uint64(64 - bits)).view(np.int64)] = True
    return out


class Items:
    """A block of items: words, allowed edits, and the tables."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        buf, off = text_buffer(pa.array(texts, pa.string()))
        words = Words(buf, off, True, _SEPARATORS)
        n = words.counts()
        kept = np.flatnonzero(n > 0)
        self.ids = [ids[i] for i in kept]
        self.n = n[kept].astype(np.int64)
        self.edits = self.n * (DEN - NUM) // DEN
        self.flat, self.stop = words.hashes(), np.cumsum(self.n)
        self.tables: dict[int, list[_Table]] = {}
        if not len(kept):
            return
        item = np.repeat(np.arange(len(kept)), self.n)
        at = np.arange(len(self.flat))
        entry = item << 32 | at - (self.stop - self.n)[item]
        band = np.searchsorted([b[0] for b in BANDS], self.n, "right") - 1
        own = np.unique(band).tolist()
        for r in range(WALKS):
            for b, key, end in walks(self.flat, at, r, own):
                inside = (band[item] == b) & (end < self.stop[item])
                self.tables.setdefault(b, []).append(_Table(key[inside], entry[inside]))
        self.bits = max(16, int(16 * len(self.flat)).bit_length())
        self.vocabulary = _bitmap(self.flat, self.bits)
        self.has = _bitmap(self.pair(item, self.flat), self.bits)

    def words(self, i: int) -> np.ndarray:
        return self.flat[self.stop[i] - self.n[i] : self.stop[i]]

    @staticmethod
    def pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A hash of an item and a word."""
        return (word ^ item.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to a run of the text, and that run's end and start (the last start for the first end)."""
    m = len(text)
    place = np.arange(m + 1)
    row, begin = np.zeros(m + 1, np.int64), place.copy()
    for w in item:
        diag = row[:-1] + (text != w)
        up = row + 1
        best, source = up.copy(), begin.copy()
        take = diag <= up[1:]
        best[1:][take] = diag[take]
        source[1:][take] = begin[:-1][take]
        low = np.minimum.accumulate(best - place)
        lead = np.maximum.accumulate(np.where(best - place == low, place, 0))
        row, begin = low + place, source[lead]
    end = int(np.argmin(row))
    return int(row[end]), end, int(begin[end])


def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[i], lo[i] + 1, ... of each range."""
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _regions(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where a new region starts, of ranges sorted by group and place, if overlapping ones of a group join."""
    return np.r_[True, (group[1:] != group[:-1]) | (lo[1:] > hi[:-1])] if len(lo) else np.empty(0, bool)


def _likely(items: Items, h: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each window lo:hi holds so many of its item's words as a match needs. Windows are sorted by group (document and item) and place."""
    new = _regions(group, lo, hi)
    of = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    begin, size = lo[first], hi[np.r_[first[1:], len(lo)] - 1] - lo[first]
    keep = np.zeros(len(lo), bool)
    total = np.cumsum(size)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PART, "right")))
        at = _spread(begin[a:b], size[a:b])
        inside = items.has[(items.pair(np.repeat(item[first[a:b]], size[a:b]), h[at]) >> np.uint64(64 - items.bits)).view(np.int64)]
        count = np.r_[0, np.cumsum(inside)]
        s, e = first[a], first[b] if b < len(first) else len(lo)
        base = (total[a:b] - size[a:b] - (total[a - 1] if a else 0) - begin[a:b])[of[s:e] - a]
        keep[s:e] = count[base + hi[s:e]] - count[base + lo[s:e]] >= (items.n - items.edits)[item[s:e]]
        a = b
    return keep


def _candidates(items: Items, words: Words, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, item, start) of windows that collide with an item in a table, in parts."""
    live = np.flatnonzero(items.vocabulary[(h >> np.uint64(64 - items.bits)).view(np.int64)])
    for r in range(WALKS):
        for b, key, _ in walks(h, live, r, list(items.tables)):
            t = items.tables[b][r]
            hit, lo, hi = t.hits(key)
            done = np.cumsum(hi - lo)
            a = 0
            while a < len(hit):
                e = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PART, "right")))
                entry = t.entries[_spread(lo[a:e], hi[a:e] - lo[a:e])]
                at = np.repeat(live[hit[a:e]], hi[a:e] - lo[a:e])
                yield np.searchsorted(words.first, at, "right") - 1, entry >> 32, at - (entry & 0xFFFFFFFF)
                a = e


def find(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(item, text, start, words, distance) of the items' runs in the texts."""
    found: list[tuple] = []
    if not items.ids:
        return found
    for a, _, buf, off in chunks(texts):
        words = Words(buf, off, True, _SEPARATORS)
        h = words.hashes()
        left: list[tuple[np.ndarray, ...]] = []
        for doc, item, start in _candidates(items, words, h):
            group = doc * len(items.ids) + item
            order = np.lexsort((start, group))
            group, start = group[order], start[order]
            new = np.r_[True, (group[1:] != group[:-1]) | (start[1:] != start[:-1])]
            group, start = group[new], start[new]
            doc, item = np.divmod(group, len(items.ids))
            lo = np.maximum(start - items.edits[item], words.first[doc])
            hi = np.minimum(start + items.n[item] + items.edits[item], words.first[doc + 1])
            ok = _likely(items, h, item, lo, hi, group)
            left.append((group[ok], lo[ok], hi[ok]))
        if not sum(len(x[0]) for x in left):
            continue
        group, lo, hi = (np.concatenate(x) for x in zip(*left, strict=True))
        order = np.lexsort((lo, group))
        group, lo, hi = group[order], lo[order], hi[order]
        first = np.flatnonzero(_regions(group, lo, hi))
        last = np.r_[first[1:], len(lo)] - 1
        for g, s, e in zip(group[first].tolist(), lo[first].tolist(), hi[last].tolist(), strict=True):
            d, i = divmod(g, len(items.ids))
            far, end, begin = align(items.words(i), h[s:e])
            if far <= items.edits[i]:
                found.append((i, a + d, s + begin - int(words.first[d]), end - begin, far))
    return found


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[Broadcast]:
    """The items in blocks of BLOCK words, or of one longer item."""
    send = benchmark.sparkSession.sparkContext.broadcast
    ids: list = []
    texts: list[str | None] = []
    size = 0
    for i, t in benchmark.select(F.col(item_col).cast("long"), F.col(item_text)).toLocalIterator():
        n = len(t.split()) if t else 0
        if ids and size + n > BLOCK:
            yield send(Items(ids, texts))
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    if ids:
        yield send(Items(ids, texts))


def _matches(batches: Iterator[pa.RecordBatch], block: Broadcast) -> Iterator[pa.RecordBatch]:
    items = block.value
    for b in batches:
        ids = b.column(0).to_pylist()
        found = [(items.ids[i], ids[d], start, size, far, 1 - far / int(items.n[i])) for i, d, start, size, far in find(b.column(1), items)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["item_id", "_id", "start", "words", "distance", "similarity"])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, _id, start, words (the run's place, in words), distance and similarity of each leaked item and document."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = "item_id long, _id long, start long, words long, distance long, similarity double"
    out = None
    for block in _blocks(benchmark, item_col, item_text):
        part = rows.mapInArrow(functools.partial(_matches, block=block), schema)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.min(F.struct("distance", "start", "words", "similarity")).alias("b")
    return out.groupBy("item_id", "_id").agg(best).select("item_id", "_id", "b.start", "b.words", "b.distance", "b.similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents into which no item has leaked, with all their columns; nothing is shuffled."""
    def clean(batches: Iterator[pa.RecordBatch], block: Broadcast) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[x[1] for x in find(b.column(b.schema.get_field_index(text_col)), block.value)]] = False
            yield b.filter(pa.array(keep))

    for block in _blocks(benchmark, item_col, item_text):
        docs = docs.mapInArrow(functools.partial(clean, block=block), docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return out.withColumnRenamed("_id", "doc_id")
