"""SimHash near-duplicates, found in BK-trees.

A text's fingerprint has bit b set if over half of its shingles' hashes have. Fingerprints within RADIUS bits of each
other link, and linked ones form groups.

The distinct fingerprints are dealt to shards: two that differ in at most r bits agree on one of r + 1 blocks of bits,
so each goes to the shard of each of its blocks. A shard's BK-tree keys a node's children by their integer Hamming
distance to it, and a search follows only the edges within the radius of its own distance. Trees of all shards together
hold every fingerprint, so they have no size bound and aren't broadcast: each is built where its queries are sent. A
shard over CROWDED fingerprints, which agree on one block, is dealt again by blocks of the other bits, which is as exact.
Groups are joined by spanning edges, never by all pairs.

Defined cases: a null text has no words; a text with fewer words than a shingle is one shingle; without words the
fingerprint is zero, which links like any other; copies share a fingerprint and so a group; rows with a null id are
a group only through rows with ids (the group's id is the least non-null one, null if there is none); an empty table
gives no rows; extra columns are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import Words, chunks, cut
from .graph import components

SHINGLE, RADIUS, CROWDED = 3, 2, 2_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprints(col: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    out = np.zeros(len(col), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b, buf, off in chunks(col):
        words = Words(buf, off)
        size = words.ends - words.starts
        to = np.cumsum(size + 1) - 1
        at = to - size
        packed = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
        if len(to):
            run = np.repeat(words.starts - at, size)
            fill = np.ones(len(packed), bool)
            fill[to] = False
            packed[fill] = buf[np.flatnonzero(fill) + run]
        raw = packed.tobytes().translate(_LOWER)
        first = words.first.tolist()
        at, to = at.tolist(), to.tolist()
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if lo == hi:
                continue
            k = min(shingle, hi - lo)
            h = np.array([digest(raw[s:e], 42) for s, e in zip(at[lo : hi - k + 1], to[lo + k - 1 : hi], strict=True)], np.uint64)
            bits = np.zeros(64, np.int64)
            for j in range(0, len(h), 65_536):
                part = h[j : j + 65_536]
                bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[a + i] = np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), shingle).view(np.int64))], ["_id", "_fp"])


class Tree:
    """A BK-tree of integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            if d not in node[1]:
                node[1][d] = [x, {}]
                return
            node = node[1][d]

    def near(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            if len(children) <= 2 * radius:
                todo.extend(c for e, c in children.items() if -radius <= e - d <= radius)
            else:
                todo.extend(children[e] for e in range(max(1, d - radius), d + radius + 1) if e in children)
        return found


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges (u, v) of the links in each shard, of rows (key, sub, _fp, _id) sorted by key and sub."""
    edges: list[tuple[int, int]] = []

    def grow(members: list[tuple[int, int]]) -> None:
        tree, ids, root = Tree(), dict(members), {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x in ids:
            root[x] = x
            for y in tree.near(x, radius):
                if (p := find(y)) != (q := find(x)):
                    root[q] = p
                    edges.append((ids[x], ids[y]))
            tree.add(x)

    shard, members = None, []
    for b in batches:
        if not b.num_rows:
            continue
        key, sub, fp, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        stop = np.r_[start[1:], len(key)]
        for i, (s, e) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
            if shard != (key[s], sub[s]):
                if len(members) > 1:
                    grow(members)
                shard, members = (key[s], sub[s]), []
            if e - s > 1 or members or i == len(start) - 1:
                members.extend(zip(fp[s:e].view(np.uint64).tolist(), doc[s:e].tolist(), strict=True))
        if edges:
            u, v = zip(*edges, strict=True)
            edges.clear()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    if len(members) > 1:
        grow(members)
    if edges:
        u, v = zip(*edges, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _cuts(n: int, parts: int) -> list[tuple[int, int]]:
    """Splits n bits into parts: (lowest bit, bits)."""
    edge = [round(i * n / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def _block(x: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << bits) - 1))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning edges (u, v) between the ids of distinct fingerprints (_fp, _id) within radius bits."""
    parts = _cuts(64, radius + 1)
    rest = [[(a, n) for a, n in parts if a != low] for low, _ in parts]
    dealt = prints.select("_fp", "_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _block(F.col("_fp"), *p).alias("x")) for i, p in enumerate(parts)])).alias("k"))
    dealt = dealt.select("_fp", "_id", "k.i", F.xxhash64("k.i", "k.x").alias("key"))
    crowded = dealt.groupBy("key").count().where(F.col("count") > CROWDED).select("key", F.lit(True).alias("crowded"))
    dealt = dealt.join(crowded, "key", "left")
    again = [F.array(*[F.xxhash64(F.lit(j), *[_block(F.col("_fp"), a + lo, n) for a, lo, n in _pieces(rest[i], *p)]) for j, p in enumerate(_cuts(sum(n for _, n in rest[i]), radius + 1))]) for i in range(len(parts))]
    subs = F.when(F.col("crowded"), F.element_at(F.array(*again), F.col("i") + 1)).otherwise(F.array(F.lit(0).cast("long")))
    rows = dealt.select("key", F.explode(subs).alias("sub"), "_fp", "_id")
    return rows.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(functools.partial(_search, radius=radius), "u long, v long")


def _pieces(blocks: list[tuple[int, int]], low: int, bits: int) -> list[tuple[int, int, int]]:
    """The parts (block's lowest bit, offset, bits) that bits low.. of joined blocks fall on."""
    out, at = [], 0
    for a, n in blocks:
        lo, hi = max(low, at), min(low + bits, at + n)
        if lo < hi:
            out.append((a, lo - at, hi - lo))
        at += n
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """_id, _fp (a signed long) and component of each document."""
    prints = cut(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(functools.partial(_fingerprint, shingle=shingle), "_id long, _fp long"))
    first = cut(prints.groupBy("_fp").agg(F.min("_id").alias("_least")))
    found = components(links(first.where("_least is not null").select("_fp", F.col("_least").alias("_id")), radius))
    named = first.join(found, F.col("_least") == F.col("vertex"), "left").select("_fp", F.coalesce("component", "_least").alias("component"))
    return prints.join(named, "_fp").select("_id", "_fp", "component")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
