"""SimHash near-dedup of whole documents at a stated similarity of their word shingles.

Documents are near-duplicates if the Jaccard similarity of their sets of SHINGLE-word shingles is at least SIMILARITY.
At 0.8 that means up to about 20 of 64 fingerprint bits, too many for shards of equal bit blocks: shards are cut by
least shingle hashes instead. A document goes to BANDS shards, each named by its least shingle hashes under two orders,
so that documents at the similarity share a shard with probability 1 - (1 - 0.8 ** 2) ** BANDS = 0.99996. Within a
shard a BK-tree of the fingerprints finds what lies within RADIUS bits, and bottom-K sketches estimate the similarity
(exactly, for up to SKETCH shingles). Pairs of SURE similarity link; pairs about the threshold are verified on full
shingle sets: a document first names at most NAMED in a shard, the most similar first. One that named not all is compared with
all the rest in a second pass, which gets the groups found so far and the full sets: in each shard, whatever isn't in
its group yet is verified, so nothing is lost. Equal texts are one from the start, and sketches are sent to shards that
hold several documents only.

Every document stays in its shard's tree; only pairs that links have already joined aren't compared. A shard over
CROWDED documents orders them by how usual their shingles are in it, so that what the others derive from comes first and
links are found early, and names half as many pairs at first.

Defined cases: a null text is a text of its own kind, equal to other nulls only; texts with fewer words than a shingle
are one shingle; texts without words form one group; rows sharing an id are judged each by its own text (those of equal texts count as
one); of a group the row of least id stays, then of least digest; rows with a null id stay; an empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import Words, chunks, cut, fresh, mix, shingles, small, within
from .graph import components
from .simhash import Tree, fingerprints

SHINGLE, RADIUS, BANDS, SKETCH, NAMED = 5, 22, 10, 256, 4
SIMILARITY, UNSURE, SURE = 0.8, 0.7, 0.92
CROWDED, FEW = 1_000, 8
MORE, ASK, LINK = range(3)
_SALT = np.random.default_rng(21).integers(1, 1 << 63, (BANDS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words = Words(buf, off, fold=True)
    h = words.hashes()
    ok = np.zeros(len(h) + 1, bool)
    ok[within(words.first, SHINGLE)] = True
    full = shingles(h, SHINGLE)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(full[lo : hi - SHINGLE + 1])
        else:
            yield shingles(h[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, _id, fp, bands, sketch) of rows (_id, text, digest)."""
    for b in batches:
        fp = fingerprints(b.column(1), SHINGLE).view(np.int64)
        bands, sketches = [], []
        for _, _, buf, off in chunks(b.column(1)):
            for s in _sets(buf, off):
                if not len(s):
                    bands.append([0])
                    sketches.append(b"")
                    continue
                least = (s[None, None, :] * _SALT[:, :, None] >> np.uint64(1)).min(2)
                bands.append(mix(least[:, 0] * np.uint64(31) + mix(least[:, 1]) + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist())
                sketches.append(np.sort((mix(s) >> np.uint64(32)).astype(np.uint32))[:SKETCH].tobytes())
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(fp), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["digest", "_id", "fp", "bands", "sketch"])


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from bottom-k sketches: over the hashes below both sketches' ends."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    end = min(int(a[-1]) if len(a) >= SKETCH else 1 << 32, int(b[-1]) if len(b) >= SKETCH else 1 << 32)
    n, m = (int(np.searchsorted(x, end, "right")) if end < 1 << 32 else len(x) for x in (a, b))
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (n + m - common)


class _Shard:
    """A shard's sketches, and which of its documents are known to be one group."""

    def __init__(self, sketches: list[bytes], group: np.ndarray) -> None:
        self.sketch = [np.frombuffer(s, np.uint32) for s in sketches]
        self.group = group
        self.ranks: np.ndarray | None = None

    def _rank(self) -> None:
        """Hashes by their rank in the shard, so that a table of one document's serves for comparing it with many."""
        size = np.array([len(s) for s in self.sketch])
        u, at = np.unique(np.concatenate(self.sketch), return_inverse=True)
        self.unlike = len(u)
        self.ranks = np.full((len(size), SKETCH), self.unlike, np.int32)
        self.ranks[np.arange(SKETCH) < size[:, None]] = at
        self.end = np.where(size >= SKETCH, self.ranks[:, -1], self.unlike - 1)
        self.has = np.zeros(self.unlike + 1, bool)

    def usual(self) -> np.ndarray:
        """How many documents of the shard share a document's hashes, on average."""
        u, at, n = np.unique(np.concatenate(self.sketch), return_inverse=True, return_counts=True)
        size = np.array([len(s) for s in self.sketch])
        return np.bincount(np.repeat(np.arange(len(size)), size), n[at], minlength=len(size)) / np.maximum(size, 1)

    def estimates(self, x: int, ys: np.ndarray) -> np.ndarray:
        if len(ys) <= FEW or not len(self.sketch[x]):
            return np.array([estimate(self.sketch[x], self.sketch[y]) for y in ys.tolist()])
        if self.ranks is None:
            self._rank()
        own = self.ranks[x, : len(self.sketch[x])]
        self.has[own] = True
        r, end = self.ranks[ys], np.minimum(self.end[ys], self.end[x])
        inside = r <= end[:, None]
        common, m, n = (self.has[r] & inside).sum(1), inside.sum(1), np.searchsorted(own, end, "right")
        self.has[own] = False
        return common / (n + m - common)

    def near(self, x: int, ys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, estimates) of those of ys that aren't of x's group by then, in blocks."""
        take = FEW
        while len(ys := ys[self.group[ys] != self.group[x]]):
            part, ys, take = ys[:take], ys[take:], min(8 * take, 4_096)
            yield part, self.estimates(x, part)

    def join(self, x: int, y: int) -> None:
        self.group[self.group == self.group[x]] = self.group[y]


def _earlier(order: list[int], fps: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each document, and those before it within RADIUS bits, in that order."""
    tree, by = Tree(), {}
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for x in order:
        fp = fps[x] & (1 << 64) - 1
        ys = np.array([y for f in tree.near(fp, RADIUS) for y in by[f]], np.int64)
        yield x, ys[np.argsort(place[ys])]
        if fp in by:
            by[fp].append(x)
        else:
            by[fp] = [x]
            tree.add(fp)


def _pairs(members: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(u, v, kind) of one shard: kind is LINK, or ASK of a pair to be verified, or MORE if u has others of that kind that aren't named."""
    ids, fps, sketches = zip(*members, strict=True)
    shard, most, order = _Shard(sketches, np.arange(len(members))), NAMED, list(range(len(members)))
    if len(members) > CROWDED:
        most, order = NAMED // 2, np.lexsort((ids, -shard.usual())).tolist()
    for x, ys in _earlier(order, fps):
        unsure, about = [], []
        for part, e in shard.near(x, ys):
            for y in part[e >= SURE].tolist():
                if shard.group[x] != shard.group[y]:
                    shard.join(x, y)
                    yield ids[x], ids[y], LINK
            ask = (e >= UNSURE) & (e < SURE)
            unsure.append(part[ask])
            about.append(e[ask])
        if unsure:
            y, e = np.concatenate(unsure), np.concatenate(about)
            y = y[np.lexsort((y, -e))]
            y = y[shard.group[y] != shard.group[x]]
            for v in y[:most].tolist():
                yield ids[x], ids[v], MORE if len(y) > most else ASK


def _rest(members: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links (u, v) between groups, of one shard's (id, fp, sketch, group, asked, bands, set): all pairs of an asked document are compared, each in the first shard that holds both."""
    ids, fps, sketches, group, asked, bands, sets = zip(*members, strict=True)
    shard, asked, bands = _Shard(sketches, np.array(group)), np.array(asked), np.array(bands)
    own = int((bands == bands[0]).all(0).argmax())
    sets = [np.frombuffer(s, np.uint64) for s in sets]
    for x, ys in _earlier(list(range(len(members))), fps):
        if not asked[x]:
            ys = ys[asked[ys]]
        ys = ys[shard.group[ys] != shard.group[x]]
        ys = ys[(bands[ys] == bands[x]).argmax(1) == own]
        for part, e in shard.near(x, ys):
            for y in part[np.argsort(-e, kind="stable")][: int((e >= UNSURE).sum())].tolist():
                if shard.group[x] != shard.group[y] and _alike(sets[x], sets[y]):
                    shard.join(x, y)
                    yield ids[x], ids[y]


def _shards(batches: Iterator[pa.RecordBatch], work: Callable[[list[tuple]], Iterator[tuple]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What the work finds in each shard, from rows (band, its columns) sorted by band."""
    shard, members, found = None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        if found:
            cols = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            found.clear()
            yield pa.RecordBatch.from_arrays(cols, names)

    for b in batches:
        if not b.num_rows:
            continue
        band = b.column(0).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        stop = np.r_[start[1:], len(band)]
        for i, (s, e) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
            if shard != band[s]:
                if len(members) > 1:
                    found.extend(work(members))
                shard, members = band[s], []
            if e - s > 1 or members or i == len(start) - 1:
                members.extend(zip(*(b.column(k)[s:e].to_pylist() for k in range(1, b.num_columns)), strict=True))
        yield from out()
    if len(members) > 1:
        found.extend(work(members))
    yield from out()


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sorted sets have the similarity."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
    return 5 * common >= 4 * (len(x) + len(y) - common)


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [s.tobytes() for _, _, buf, off in chunks(b.column(1)) for s in _sets(buf, off)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "set"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            keep.append(_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["u", "v"])


def _others(first: DataFrame, places: DataFrame, more: DataFrame, group: DataFrame, full: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v): what the documents in more (_id, asked) link to besides their group. Their shards, of places (band, _id), get full sets."""
    bands = places.join(small(more, 500_000), "_id").select("band").distinct()
    open_ = cut(places.join(small(cut(bands), 500_000), "band", "left_semi"))
    ids = small(cut(open_.select("_id").distinct()), 500_000)
    named = ids.join(first.select("_id", "fp", "sketch", "bands"), "_id").join(group, F.col("_id") == F.col("vertex"), "left").join(more, "_id", "left")
    known = named.select("_id", "fp", "sketch", F.coalesce("component", "_id").alias("group"), F.coalesce("asked", F.lit(False)).alias("asked"), "bands")
    ready = open_.join(known.join(full(ids).withColumnRenamed("id", "_id"), "_id"), "_id").select("band", "_id", "fp", "sketch", "group", "asked", "bands", "set")
    return ready.repartition("band").sortWithinPartitions("band").mapInArrow(functools.partial(_shards, work=_rest, names=["u", "v"]), "u long, v long")


def _digest(text: Column) -> Column:
    return F.when(text.isNotNull(), F.unhex(F.substring(F.sha2(text, 256), 1, 32))).otherwise(F.lit("null").cast("binary"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_gone, _digest, _kept): rows that go, by id and text, and the id that stays for them.

    Inside, each distinct text is a vertex with a number of its own, called _id; _doc is the least id that has it.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _digest(F.col(text_col)).alias("digest"))
    signed = rows.mapInArrow(_signatures, "digest binary, _id long, fp long, bands array<long>, sketch binary")
    first = signed.groupBy("digest").agg(F.min(F.struct("_id", "fp", "bands", "sketch")).alias("s"))
    first = cut(first.select("digest", F.monotonically_increasing_id().alias("_id"), F.col("s._id").alias("_doc"), "s.fp", "s.bands", "s.sketch"))
    keys = first.where(F.col("digest") != F.lit("null").cast("binary")).select(F.explode("bands").alias("band"), "_id")
    shared = keys.groupBy("band").count().where("count > 1").select("band")
    places = cut(keys.join(shared, "band", "left_semi"))
    dealt = places.join(first.select("_id", "fp", "sketch"), "_id").select("band", "_id", "fp", "sketch")
    found = cut(dealt.repartition("band").sortWithinPartitions("band").mapInArrow(functools.partial(_shards, work=_pairs, names=["u", "v", "kind"]), "u long, v long, kind long"))
    more = found.where(F.col("kind") == MORE).select(F.col("u").alias("_id")).distinct()
    found = cut(found.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.max("kind").alias("kind")))
    unsure = found.where(F.col("kind") < LINK).select("u", "v")

    def full(wanted: DataFrame) -> DataFrame:
        """(id, set) of the wanted _id."""
        owner = small(first.join(wanted, "_id").select(F.col("_id").alias("_v"), F.col("_doc").alias("_id"), "digest"), 500_000)
        return rows.join(owner, ["_id", "digest"]).dropDuplicates(["_v"]).select("_v", "text").mapInArrow(_full, "id long, set binary")

    sets = cut(full(unsure.select(F.col("u").alias("_id")).union(unsure.select("v")).distinct()))
    both = unsure.join(sets.select(F.col("id").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("y")), "v")
    links = cut(found.where(F.col("kind") == LINK).select("u", "v").union(both.select("u", "v", "x", "y").mapInArrow(_verify, "u long, v long")))
    group = components(links)
    more = cut(more.withColumn("asked", F.lit(True)))
    if not more.isEmpty():
        links = links.union(cut(_others(first, places, more, group, full)))
        group = components(links)
    of = first.join(group, F.col("_id") == F.col("vertex"), "left").select("digest", "_doc", F.coalesce("component", "_id").alias("_group"))
    least = of.groupBy("_group").agg(F.min(F.struct("_doc", "digest")).alias("s")).select("_group", F.col("s._doc").alias("_kept"), F.col("s.digest").alias("_stays"))
    named = rows.select("_id", "digest").distinct().join(of.join(least, "_group").select("digest", "_kept", "_stays"), "digest")
    return named.where("_id <> _kept or digest <> _stays").select(F.col("_id").alias("_gone"), F.col("digest").alias("_digest"), "_kept")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns."""
    key, text = fresh("_gone", docs.columns), fresh("_digest", docs.columns)
    gone = small(cut(representatives(docs, id_col, text_col).select(F.col("_gone").alias(key), F.col("_digest").alias(text))), 500_000)
    return docs.join(gone, (F.col(f"`{id_col}`") == F.col(f"`{key}`")) & (_digest(F.col(f"`{text_col}`")) == F.col(f"`{text}`")), "left_anti")
