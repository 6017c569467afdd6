"""Toxicity by nearest labelled examples.

Examples are at most EXAMPLES labelled rows, those whose ids have the smallest hashes. A text's terms are its words
(runs of letters, lower-cased) and the first PREFIXES bytes of longer ones, so that unseen forms of a known stem count. The vocabulary is what the examples' labels speak for or against: terms in MIN_ROWS examples or more whose
log-likelihood ratio with the label is at least LEAST_RATIO, and whose odds of being toxic differ from the usual ones by a
factor of LEAST_ODDS or more (so that no term of most texts, whose postings would be long, gets in).

An example's vector is its TF-IDF over the vocabulary, of unit length. For every whole text the NEIGHBOURS examples of
greatest cosine are found exactly in a block-max inverted index: postings lie in blocks of examples with the largest
weight of each term in each block, whose products bound what a block can reach; blocks that can't enter the best are
skipped. Neighbours vote, weighted by cosine against a fixed prior; leave-one-out votes of the examples, made monotone
(pool adjacent violators), turn a vote into a calibrated score. The neighbours are returned as evidence.

Defined cases: a null text is empty; texts that share no term with the vocabulary get the toxic share among such
examples; a row repeated in labels is toxic if one of its rows says so; null labels and ids teach nothing; equal
cosines rank by smaller example id; without examples every score is 0; extra columns are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import Words, _BYTES, _FOLDED, chunks, cut, mix

EXAMPLES, NEIGHBOURS, BLOCK = 8_000, 15, 64
MIN_ROWS, LEAST_RATIO, LEAST_ODDS, PRIOR = 3, 12.0, 2.0, 0.5
PREFIXES = range(3, 11)
THRESHOLD = 0.7
_NOT_LETTERS = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])


def terms(buf: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the distinct terms of each text; of those in the sorted vocabulary alone, as their places, if one is given."""
    if vocabulary is not None:
        maybe = np.zeros(1 << 16, bool)
        maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    words = Words(buf, offsets, True, _NOT_LETTERS)
    n = len(words.starts)
    doc = np.searchsorted(words.first, np.arange(n), "right") - 1
    up, down = _BYTES.to(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_FOLDED[buf] * up[: len(buf)], out=total[1:])
    size = words.ends - words.starts
    all_docs, all_terms = [], []
    for k in (0, *PREFIXES):
        own = np.flatnonzero(size > k)
        s = words.starts[own]
        e = s + k if k else words.ends[own]
        d, t = doc[own], mix((total[e] - total[s]) * down[s] + np.uint64(k))
        if vocabulary is not None:
            hit = np.flatnonzero(maybe[(t & np.uint64(0xFFFF)).astype(np.int64)])
            t, d = t[hit], d[hit]
            at, hit = _look(vocabulary, t)
            t, d = at[hit], d[hit]
        all_docs.append(d)
        all_terms.append(t)
    doc, term = np.concatenate(all_docs), np.concatenate(all_terms)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.empty(0, np.int64)
    return doc[at], term[at], np.diff(np.r_[at, len(doc)])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, rows, toxic) over a task's examples (text, toxic)."""
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False)
        parts = [(t, label[a + d]) for a, _, buf, off in chunks(pc.utf8_lower(b.column(0))) for d, t, _ in [terms(buf, off)]]
        if parts:
            t, y = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, at = np.unique(t, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(at, minlength=len(u)), pa.int64()), pa.array(np.bincount(at, y, minlength=len(u)).astype(np.int64))], ["term", "rows", "toxic"])


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(_id, toxic, terms, counts) of examples (text, toxic, _id), over the sorted vocabulary."""
    for b in batches:
        for a, e, buf, off in chunks(pc.utf8_lower(b.column(0))):
            d, i, n = terms(buf, off, vocabulary)
            at = pa.array(np.searchsorted(d, np.arange(e - a + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(2)[a:e], b.column(1)[a:e], pa.ListArray.from_arrays(at, pa.array(i, pa.int32())), pa.ListArray.from_arrays(at, pa.array(n, pa.int32()))], ["_id", "toxic", "terms", "counts"])


def _look(vocabulary: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i = np.minimum(np.searchsorted(vocabulary, t), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[i] == t)
    return i, hit


class Index:
    """Labelled unit vectors in a block-max inverted index."""

    def __init__(self, vocabulary: np.ndarray, df: np.ndarray, rows: list[tuple[int, int, list[int], list[int]]], total: int) -> None:
        self.vocabulary = vocabulary
        self.idf = np.log((total + 1) / (df + 1)) + 1
        vectors = [(i, y, np.array(t, np.int64), self.weights(np.array(t, np.int64), np.array(n, np.float64))) for i, y, t, n in rows]
        bare = [y for _, y, t, _ in vectors if not len(t)]
        self.bare = (sum(bare) + PRIOR * (np.mean([r[1] for r in rows]) if rows else 0)) / (len(bare) + PRIOR)
        kept = sorted((v for v in vectors if len(v[2])), key=lambda v: (int(v[2][np.argmax(v[3])]), v[0]))
        self.ids = np.array([v[0] for v in kept], np.int64)
        self.labels = np.array([v[1] for v in kept], np.float64)
        self.base = float(self.labels.mean()) if len(kept) else 0.0
        row = np.repeat(np.arange(len(kept)), [len(v[2]) for v in kept])
        term = np.concatenate([v[2] for v in kept]) if kept else np.empty(0, np.int64)
        weight = np.concatenate([v[3] for v in kept]) if kept else np.empty(0)
        order = np.lexsort((row, term))
        self.row, self.weight, term = row[order], weight[order], term[order]
        block = self.row // BLOCK
        at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.empty(0, np.int64)
        self.segment = np.r_[at, len(term)]
        self.segment_block = block[at]
        self.most = np.maximum.reduceat(self.weight, at) if len(at) else np.empty(0)
        self.first = np.searchsorted(term[at], np.arange(len(vocabulary) + 1))
        self.blocks = -(-len(kept) // BLOCK)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.0]))
        if len(kept):
            self._calibrate([(v[2], v[3]) for v in kept])

    def weights(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[t] if len(t) else np.empty(0)
        return w / np.sqrt((w**2).sum()) if len(w) else w

    def nearest(self, t: np.ndarray, w: np.ndarray, but: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Examples (their rows) and cosines of the k nearest, without the row `but`."""
        size = self.first[t + 1] - self.first[t]
        seg = np.repeat(self.first[t], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        bound = np.bincount(self.segment_block[seg], np.repeat(w, size) * self.most[seg], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        weight = np.zeros(self.blocks * BLOCK)
        found_rows, found = np.empty(0, np.int64), np.empty(0)
        chosen, least, take = 0, 0.0, 8
        while chosen < len(order) and bound[order[chosen]] > 0 and (len(found) < k or bound[order[chosen]] >= least - 1e-12):
            use = np.zeros(self.blocks, bool)
            part = order[chosen : chosen + take]
            use[part if len(found) < k else part[bound[part] >= least - 1e-12]] = True
            chosen, take = chosen + take, take * 8
            mine = np.flatnonzero(use[self.segment_block[seg]])
            s = seg[mine]
            n = self.segment[s + 1] - self.segment[s]
            p = np.repeat(self.segment[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            np.add.at(weight, self.row[p], np.repeat(np.repeat(w, size)[mine], n) * self.weight[p])
            rows = np.unique(self.row[p])
            rows = np.concatenate((found_rows, rows[rows != but]))
            best = np.lexsort((self.ids[rows], -weight[rows]))[:k]
            found_rows, found = rows[best], weight[rows[best]]
            least = found[-1] if len(found) == k else 0.0
        return found_rows, found

    def vote(self, t: np.ndarray, w: np.ndarray, but: int = -1) -> tuple[float, np.ndarray]:
        rows, cos = self.nearest(t, w, but)
        return float((cos @ self.labels[rows] + PRIOR * self.base) / (cos.sum() + PRIOR)), rows

    def _calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        votes = np.array([self.vote(t, w, i)[0] for i, (t, w) in enumerate(vectors)])
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []
        for v, y in zip(votes[order].tolist(), self.labels[order].tolist(), strict=True):
            pools.append([y, 1, v, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                y2, n2, _, high = pools.pop()
                pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2], high]
        x = np.array([b for p in pools for b in (p[2], p[3])])
        y = np.array([(p[0] + PRIOR * self.base) / (p[1] + PRIOR) for p in pools for _ in (0, 1)])
        self.steps = (x, y)

    def score(self, t: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
        if not len(t) or not len(self.ids):
            return float(self.bare), np.empty(0, np.int64)
        v, rows = self.vote(t, self.weights(t, n))
        return float(np.clip(np.interp(v, *self.steps), 0, 1)), self.ids[rows]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, examples: int = EXAMPLES) -> Index:
    """An index of at most `examples` labelled rows for which `usable` (of the labels) holds."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.lit(True) if usable is None else usable))
    by = rows.groupBy(F.col(id_col).cast("long").alias("_k")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    picked = cut(by.orderBy(F.xxhash64("_k"), "_k").limit(examples))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = cut(texts.join(F.broadcast(picked), F.col("_id") == F.col("_k")).select("text", "toxic", "_id"))
    ends = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    total, bad = ends[0], ends[1]
    stats = known.select("text", "toxic").mapInArrow(_statistics, "term long, rows long, toxic long").groupBy("term").agg(F.sum("rows").alias("n"), F.sum("toxic").alias("y")).where(F.col("n") >= MIN_ROWS)
    n, y, big, pos = F.col("n").cast("double"), F.col("y").cast("double"), F.lit(float(total)), F.lit(float(bad))

    def cell(o: Column, e: Column) -> Column:
        return F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)

    ratio = 2 * (cell(y, n * pos / big) + cell(n - y, n * (big - pos) / big) + cell(pos - y, (big - n) * pos / big) + cell(big - n - pos + y, (big - n) * (big - pos) / big))
    leaning = (y * (big - pos) >= LEAST_ODDS * (n - y) * pos) | (LEAST_ODDS * y * (big - pos) <= (n - y) * pos)
    chosen = stats.where((ratio >= LEAST_RATIO) & leaning).select("term", "n").collect() if total and 0 < bad < total else []
    vocabulary = np.array([r["term"] for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, df = vocabulary[order], np.array([r["n"] for r in chosen], np.float64)[order]
    vectors = known.mapInArrow(functools.partial(_vectors, vocabulary=vocabulary), "_id long, toxic int, terms array<int>, counts array<int>").collect() if total else []
    return Index(vocabulary, df, [tuple(r) for r in vectors], total)


def _score(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores, near = [], []
        for a, e, buf, off in chunks(pc.utf8_lower(b.column(1))):
            d, i, n = terms(buf, off, index.vocabulary)
            at = np.searchsorted(d, np.arange(e - a + 1))
            for j in range(e - a):
                s, ids = index.score(i[at[j] : at[j + 1]], n[at[j] : at[j + 1]])
                scores.append(s)
                near.append(ids)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64()))], ["_id", "score", "evidence"])


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, score and evidence (ids of the nearest examples, nearest first) of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(functools.partial(_score, index=index), "_id long, score double, evidence array<long>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = score(docs, fit(docs, labels, usable=~held)).withColumnRenamed("_id", "doc_id")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
