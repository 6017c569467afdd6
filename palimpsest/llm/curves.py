"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random onto a few axes, shifted, and ordered by Hilbert key, once for each curve. Spark sorts
(curve, key) by range, which gives every row its rank on every curve; a query meets the rows within `window` ranks of
its own on each. Not the vectors are sorted but codes of them, one byte an axis; the best by code merge over the curves
and are ranked by exact Euclidean distance in double precision. Where bytes are too coarse (tight clusters, norms of many sizes), as measured by the same
probes as the window, and in tables that are searched whole, the codes are the vectors themselves, from the middle.

The window is a number of rows, found by measuring: the true neighbours of PROBES rows are computed against all rows, and
the window is the least that would find TARGET of them. Clustered vectors get short windows whatever the table's size;
vectors without structure need windows that grow with the table (README has figures). Orderings are cut into blocks of at
most BLOCK rows, and queries come to them in a stream, so that no task holds more than a block.

Of rows that share a vector the k + 1 least ids are kept as candidates, which is exact: no query can return more of them.

Defined cases: vectors that are null, zero, or hold nulls or non-finite values take no part, nor do rows without an id
or whose vector has not the most common length; equal distances rank by smaller id; of rows repeating an id the
nearest counts; tables of up to EXACT rows are searched whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import cut

CURVES, AXES, BITS, SAMPLE = 32, 8, 6, 10_000
PROBES, TARGET, EXACT = 100, 0.95, 1_000
CODE, KEEP, BLOCK = 64, 5, 4_096
#: What part of the probes' neighbours must be among the 2 * k nearest by bytes; and how many times the median distance from the middle a sample's vector may be.
KNOWN, STRAY = 0.98, 10
#: By what part squared distances of the same value may differ through rounding.
TIE = 1e-9
_ROW = (1 << 33) - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of integer points (rows x axes) of so many bits an axis: Gray-code rotation from the top bit down, then interleaving."""
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(axes):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | x[i] >> bit & 1
    return key


def _frames(dim: int, curves: int, axes: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : min(axes, dim)] if dim else np.zeros((0, 0)) for _ in range(curves)])


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class _Space:
    """How vectors become keys and codes; fitted on a bounded sample without strays, which would set the scale for all others. whole: codes are the vectors, from the centre."""

    def __init__(self, sample: np.ndarray, curves: int) -> None:
        dim, self.whole = sample.shape[1], False
        with np.errstate(over="ignore"):
            far = np.sqrt(((sample - np.median(sample, 0)) ** 2).sum(1))
        if usual := np.median(far):
            sample = sample[far <= STRAY * usual]
        self.centre = np.median(sample, 0)
        self.frames = _frames(dim, curves, AXES)
        shown = np.einsum("nd,cda->cna", sample, self.frames)
        self.mean, self.std = shown.mean(1), shown.std(1) + 1e-12
        self.shift = np.random.default_rng(8).random((curves, self.frames.shape[2]))
        self.turn = np.linalg.qr(np.random.default_rng(9).normal(size=(dim, dim)))[0][:, :CODE]
        self.middle = (sample @ self.turn).mean(0)
        self.scale = 120 / (np.abs(sample @ self.turn - self.middle).max() + 1e-12)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, curves): the curve's number above its Hilbert key."""
        out = np.empty((len(x), len(self.frames)), np.int64)
        for c, frame in enumerate(self.frames):
            y = ((x @ frame - self.mean[c]) / self.std[c] + 3 + self.shift[c]) / 7 * (1 << BITS)
            out[:, c] = hilbert_keys(np.clip(y, 0, (1 << BITS) - 1).astype(np.int64), BITS) | c << AXES * BITS
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bytes of each vector, a row each."""
        if self.whole:
            return np.ascontiguousarray(x - self.centre, "<f8").view(np.int8)
        return np.clip(np.rint((x @ self.turn - self.middle) * self.scale), -127, 127).astype(np.int8)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _keyed(batches: Iterator[pa.RecordBatch], space: _Space) -> Iterator[pa.RecordBatch]:
    """From rows (_id, _vec, _query, _row): one for each curve, with key and code."""
    curves = len(space.frames)
    for b in batches:
        for at in range(0, b.num_rows, 1_000):
            part = b.slice(at, 1_000)
            x = _matrix(part.column(1))
            each = lambda i: pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), curves))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(space.keys(x).ravel()), each(0), each(2), each(3), _binary(np.repeat(space.codes(x), curves, 0))], ["_key", "_id", "_query", "_row", "_code"])


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of each row of y to each of x."""
    return (y * y).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * y @ x.T


def _best(d: np.ndarray, k: int) -> np.ndarray:
    """The places of each line's k smallest."""
    return np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)


def _least(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of each line's k smallest, of those that tie (but for rounding) the ones of least id."""
    best = _best(d, k)
    if d.shape[1] <= k:
        return best
    edge = np.take_along_axis(d, best, 1).max(1)
    edge[~np.isfinite(edge)] = -np.inf
    high = edge * (1 + TIE)
    for i in np.flatnonzero((d <= high[:, None]).sum(1) > k).tolist():
        near = np.flatnonzero(d[i] <= high[i])
        best[i] = near[np.lexsort((ids[near], d[i, near] >= edge[i] * (1 - TIE)))][:k]
    return best


def _probed(batches: Iterator[pa.RecordBatch], ids: np.ndarray, probes: np.ndarray, k: int, space: _Space) -> Iterator[pa.RecordBatch]:
    """(probe, by, id, d): the k rows of this task nearest to each probe, by vector (by is 0), and 2 * k by code (1)."""
    found = [(np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0)))] * 2
    codes = space.codes(probes).astype(np.float32)
    for b in batches:
        for at in range(0, b.num_rows, 2_000):
            own, x = b.column(0)[at : at + 2_000].to_numpy(), _matrix(b.column(1)[at : at + 2_000])
            for by, d in enumerate((_square(x - space.centre, probes - space.centre), _square(space.codes(x).astype(np.float32), codes))):
                d[own[None] == ids[:, None]] = np.inf
                near, far = (np.hstack(x) for x in zip(found[by], (np.broadcast_to(own, d.shape), d), strict=True))
                best = _best(far, (1 + by) * k)
                found[by] = np.take_along_axis(near, best, 1), np.take_along_axis(far, best, 1)
    for by, (near, far) in enumerate(found):
        keep = np.isfinite(far)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], near.shape)[keep]), pa.array(np.full(keep.sum(), by, np.int32)), pa.array(near[keep]), pa.array(far[keep].astype(np.float64))], ["_probe", "_by", "_id", "_d"])


def _rounded(d: np.ndarray) -> np.ndarray:
    """Squared distances to 36 bits, so that equal ones rank by id."""
    part, power = np.frexp(np.maximum(d.astype(np.float64), 0))
    return np.ldexp(np.rint(np.ldexp(part, 36)), power - 36)


def _meet(batches: Iterator[pa.RecordBatch], n: int, window: int, keep: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """From rows (block, ask, rank, _id, _code) sorted by block and ask: (query_id, vec_id, d) of the rows within the window that are nearest by code."""
    block, rows, held = None, [], None
    for b in batches:
        of, ask = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edge = np.r_[np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (ask[1:] != ask[:-1])]), len(of)] if len(of) else []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if of[s] != block:
                block, rows, held = of[s], [], None
            part = b.slice(s, e - s)
            code = np.frombuffer(b"".join(part.column(4).to_pylist()), "<f8" if whole else np.int8).reshape(e - s, -1)
            here = [part.column(i).to_numpy() for i in (2, 3)] + [code if whole else code.astype(np.float32)]
            if not ask[s]:
                rows.append(here)
                continue
            if not rows:
                continue
            held = held or [np.concatenate(x) for x in zip(*rows, strict=True)]
            for at in range(0, e - s, 256):
                rank, own, y = (x[at : at + 256] for x in here)
                d = _square(held[2], y)
                d[(np.abs(held[0][None] - rank[:, None]) > window) | (held[0][None] // n != rank[:, None] // n) | (held[1][None] == own[:, None])] = np.inf
                best = _least(d, held[1], keep)
                far = np.take_along_axis(d, best, 1)
                ok = np.isfinite(far)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(own[:, None], best.shape)[ok]), pa.array(held[1][best][ok]), pa.array(_rounded(far[ok]))], ["query_id", "vec_id", "d"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            score = np.sqrt(((_matrix(b.column(2)) - _matrix(b.column(3))) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["query_id", "vec_id", "score"])


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda v: v != 0), F.lit(False))


def _ranked(index: DataFrame, space: _Space) -> DataFrame:
    """(_id, _query, _row, _code, rank): ranks count on from curve to curve."""
    keyed = index.mapInArrow(functools.partial(_keyed, space=space), "_key long, _id long, _query boolean, _row boolean, _code binary")
    rows = cut(keyed.repartitionByRange("_key", "_code", "_id").sortWithinPartitions("_key", "_code", "_id").select("_id", "_query", "_row", "_code", F.monotonically_increasing_id().alias("_m")))
    part = F.shiftright("_m", 33)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())
    start = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    starts = index.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, start, strict=False)], "_part long, _start long")
    return rows.join(F.broadcast(starts), part == F.col("_part")).select("_id", "_query", "_row", "_code", (F.col("_start") + F.col("_m").bitwiseAND(F.lit(_ROW))).alias("rank"))


def probe(index: DataFrame, space: _Space, k: int) -> tuple[list[tuple[int, int]], float]:
    """(probe, id) of the true neighbours of PROBES rows, and the part of them that is among the 2 * k nearest by code."""
    probes = index.orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(PROBES).select("_id", "_vec").collect()
    ids, x = np.array([r[0] for r in probes]), np.array([r[1] for r in probes], np.float64)
    order = Window.partitionBy("_probe", "_by").orderBy("_d", "_id")
    near = index.where("_row").select("_id", "_vec").mapInArrow(functools.partial(_probed, ids=ids, probes=x, k=k, space=space), "_probe long, _by int, _id long, _d double")
    found = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= (F.col("_by") + 1) * k).select("_by", "_probe", "_id").collect()
    true, coded = ([(r[1], r[2]) for r in found if r[0] == by] for by in (0, 1))
    return true, len({*true} & {*coded}) / max(1, len({*true}))


def fit_window(ranked: DataFrame, true: list[tuple[int, int]], n: int, k: int, target: float = TARGET) -> int:
    """The least window of 4 * k or more that finds the target share of the true neighbours (probe, id)."""
    if not true:
        return n
    wanted = ranked.sparkSession.createDataFrame([(i,) for i in sorted({i for p in true for i in p})], "_id long")
    rank: dict[int, dict[int, list[int]]] = {}
    for r in ranked.join(F.broadcast(wanted), "_id").select("_id", "rank").collect():
        rank.setdefault(r[0], {}).setdefault(r[1] // n, []).append(r[1])
    gaps = sorted(min(abs(a - b) for c, xs in rank[p].items() for a in xs for b in rank[i].get(c, [])) for p, i in true)
    return max(4 * k, gaps[min(len(gaps) - 1, int(target * len(gaps)))])


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, curves: int = CURVES, target: float = TARGET, window: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows nearest to each row for which is_query holds; the window is measured unless given."""
    spark = vectors.sparkSession
    base = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"), F.coalesce(is_query, F.lit(False)).alias("_query"))
    sizes = base.groupBy(F.size("_vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = base.where(F.size("_vec") == sizes[0]["n"]).groupBy("_vec", "_id").agg(F.max("_query").alias("_query"))
    copy = F.row_number().over(Window.partitionBy("_vec").orderBy("_id"))
    lead = once.withColumn("_copy", copy).where(F.col("_copy") <= k + 1).select("_id", "_vec", F.lit(False).alias("_query"), F.lit(True).alias("_row"))
    asks = once.where("_query").select("_id", "_vec", "_query", F.lit(False).alias("_row"))
    index = cut(lead.union(asks))
    n = index.count()
    sample = np.array([r[0] for r in index.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_vec").collect()], np.float64)
    space = _Space(sample, curves if n > EXACT else 1)
    true, known = probe(index, space, k) if n > EXACT else ([], 0.0)
    space.whole = known < KNOWN
    ranked = _ranked(index, space)
    if n <= EXACT:
        window = n
    elif window is None:
        window = fit_window(ranked, true, n, k, target)
    size = min(max(window, 256), BLOCK)
    low, high = F.expr(f"rank div {n} * {n}"), F.expr(f"(rank div {n} + 1) * {n} - 1")
    rows = ranked.where("_row").select(F.expr(f"rank div {size}").alias("block"), F.lit(0).alias("ask"), "rank", "_id", "_code")
    reach = F.sequence(F.floor(F.greatest(low, F.col("rank") - window) / size), F.floor(F.least(high, F.col("rank") + window) / size))
    ask = ranked.where("_query").select(F.explode(reach).alias("block"), F.lit(1).alias("ask"), "rank", "_id", "_code")
    met = rows.union(ask).repartition("block").sortWithinPartitions("block", "ask").mapInArrow(functools.partial(_meet, n=n, window=window, keep=2 * k, whole=space.whole), "query_id long, vec_id long, d double")
    close = met.groupBy("query_id", "vec_id").agg(F.min("d").alias("d"))
    close = close.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("r") <= KEEP * k).select("query_id", "vec_id")
    x = index.where("_query").select(F.col("_id").alias("query_id"), F.col("_vec").alias("x"))
    y = index.where("_row").select(F.col("_id").alias("vec_id"), F.col("_vec").alias("y"))
    found = close.join(x, "query_id").join(y, "vec_id").select("query_id", "vec_id", "x", "y").mapInArrow(_exact, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
