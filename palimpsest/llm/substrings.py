"""Substring dedup: repeated word windows, as compacted paths of a De Bruijn graph.

Windows of WINDOW words are the graph's edges, from their first WINDOW - 1 words to their last. Only edges that occur in
several documents matter; their least coordinate (document, place) is their source.

1. Anchors. Of each WINDOW words, the ANCHOR-word piece of least hash is selected. As the choice depends on the words
   alone, two equal windows select equal pieces; about a fifth of all pieces are, and a join on their hash finds those of
   several documents. Before the shuffle a task keeps one row for each piece it met in several documents.
2. Edges. Documents with matched anchors emit the windows over them; a join on the window's hash (96 bits) gives each
   edge its source, and every later document a mark: its own coordinate and the source's.
3. Compaction. A join by document brings its marks together. Where the next edge of the document is also the next of
   the same source, the node between them doesn't branch for this pair, and both become one path. So a passage of any
   length is one path with one coordinate in its source, in one round.
4. Verification. Each path's words are digested where they were found, and sent to the source's document, by a join on
   its id; there the words at the source's coordinate must have the same digest. Hashes are keyed anew for every run. If
   ever a path differs, the marks of that run are thrown away and all is run again under another key.

Whole copies of a text are found first, by digest: what the first copy holds, the others repeat. No row of a group is
sent to where another row of the same task has already settled it, so a passage in a third of all documents costs each
task a row a window; groups are read as sorted streams, never held. Texts are shuffled once, packed, and read four times.

Defined cases: a null text has no words; documents with a null id neither lose words nor cause others to; rows sharing
an id are judged each by its own text, and don't repeat each other; texts under WINDOW words lose nothing; an empty table
gives no rows; extra columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import CHUNK_BYTES, Words, cut, mix, shingles, small, within

WINDOW, ANCHOR = 13, 5
HELD, SEEN = 1_500_000, 200_000
#: A run of marked windows: where it starts (the row's tag, then the word), its source's document and place, and its windows.
MARK = np.dtype([("place", "<i8"), ("source", "<i8"), ("at", "<i8"), ("n", "<i4")])
#: What a source has to confirm: where, how many words, and the digest of the words.
CHECK = np.dtype([("at", "<i8"), ("words", "<i4"), ("digest", "V16")])


def _slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each w consecutive values."""
    n, done = len(x) - w + 1, 1
    out = x
    while done < w:
        step = min(done, w - done)
        out = f(out[:-step], out[step:])
        done += step
    return out[:n]


def anchors(h: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the pieces selected by the windows within texts, given word hashes."""
    starts = within(first, window)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    piece, w = shingles(h, anchor) | np.uint64(1), window - anchor + 1
    least = np.zeros(len(piece) + w - 1, np.uint64)
    least[starts + w - 1] = _slide(piece, w, np.minimum)[starts]
    chosen = np.flatnonzero(_slide(least, w, np.maximum) == piece)
    return chosen, piece[chosen]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_id, _tag, text) with the texts packed."""
    zstd = zstandard.ZstdCompressor(level=1, write_content_size=True)
    for b in batches:
        packed = [zstd.compress(t.as_buffer()) if t.is_valid else None for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["_id", "_tag", "_packed"])


def _unpack(col: pa.Array, wanted: np.ndarray) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """Of the wanted rows, in chunks: (bytes, which rows, buffer, offsets); a longer text is alone."""
    zstd = zstandard.ZstdDecompressor()
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0

    def out() -> tuple[int, list[int], np.ndarray, np.ndarray]:
        return size, rows, np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])]

    for i in np.flatnonzero(wanted & np.asarray(col.is_valid())).tolist():
        one = zstd.decompress(col[i].as_buffer())
        if size and size + len(one) > CHUNK_BYTES:
            yield out()
            rows, parts, size = [], [], 0
        rows.append(i)
        parts.append(one)
        size += len(one)
    if rows:
        yield out()


def _lists(docs: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of (doc, value) pairs, each document with its values, packed. (Spark takes many times longer to send null lists to Python than null bytes.)"""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], np.ascontiguousarray(values[order])
    at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.empty(0, np.int64)
    ends = (np.r_[at, len(docs)] * values.itemsize).astype(np.int32)
    return pa.array(docs[at], pa.int64()), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def _marks(place: np.ndarray, source: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(place), MARK)
    out["place"], out["source"], out["at"], out["n"] = place, source, at, 1
    return out


def _runs(doc: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks that follow each other both in the document and in their source become one."""
    order = np.lexsort((marks["place"], doc))
    doc, marks = doc[order], marks[order]
    if not len(doc):
        return doc, marks
    last = marks[:-1]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (marks["source"][1:] != last["source"]) | (marks["place"][1:] != last["place"] + last["n"]) | (marks["at"][1:] != last["at"] + last["n"])]
    first = np.flatnonzero(new)
    out = marks[first].copy()
    out["n"] = np.add.reduceat(marks["n"], first)
    return doc[first], out


def _send_anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int, key: int) -> Iterator[pa.RecordBatch]:
    """From rows (_id, _tag, _packed): (h, doc, hs): a piece's first document here, to be matched elsewhere; or, where h is null, a document's pieces that are matched."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        h, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.empty(0, bool)
        h, doc = h[~same], doc[~same]
        if not len(h):
            return
        lead = np.r_[True, h[1:] != h[:-1]]
        many = ~lead | np.r_[~lead[1:], False]
        one, sent = pa.array(h[lead].view(np.int64)), pa.array(doc[lead])
        yield pa.RecordBatch.from_arrays([one, sent, pa.nulls(len(one), pa.binary())], ["h", "doc", "hs"])
        if many.any():
            d, hs = _lists(doc[many], h[many])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()), d, hs], ["h", "doc", "hs"])

    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for _, rows, buf, off in _unpack(b.column(2), np.ones(b.num_rows, bool)):
            words = Words(buf, off)
            pos, h = anchors(words.hashes(key), words.first, window, anchor)
            held.append((h, ids[rows][np.searchsorted(words.first, pos, "right") - 1]))
            if sum(len(x) for x, _ in held) >= HELD:
                yield from flush()
    if held:
        yield from flush()


def _match_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, hs) from rows sorted by h: pieces that occur in several rows, and those matched before."""
    last: tuple[int, int, bool] | None = None
    for b in batches:
        null = np.asarray(b.column(0).is_null())
        if null.any():
            done = b.filter(pa.array(null))
            yield pa.RecordBatch.from_arrays([done.column(1), done.column(2)], ["doc", "hs"])
        h, doc = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False)[~null] for i in (0, 1))
        if not len(h):
            continue
        seen = np.zeros(len(h) + 1, bool)
        if last:
            h, doc = np.r_[last[0], h], np.r_[last[1], doc]
            seen[0] = last[2]
        seen = seen[: len(h)]
        same = h[1:] == h[:-1]
        seen[1:] |= same
        last = (int(h[-1]), int(doc[-1]), bool(seen[-1]))
        seen[:-1] |= same
        d, hs = _lists(doc[:-1][seen[:-1]], h[:-1][seen[:-1]])
        yield pa.RecordBatch.from_arrays([d, hs], ["doc", "hs"])
    if last and last[2]:
        yield pa.RecordBatch.from_arrays([pa.array([last[1]], pa.int64()), pa.array([np.int64(last[0]).tobytes()], pa.binary())], ["doc", "hs"])


def _send_windows(batches: Iterator[pa.RecordBatch], window: int, anchor: int, key: int) -> Iterator[pa.RecordBatch]:
    """From rows (_id, _tag, _packed, hs): (h, at, doc, tag, marked): windows over matched pieces, each from its smallest document here, with its first place and, packed, the others; or, where h is null, marks that are settled.

    at: the check above the word. Together they leave no gap of zeros between a row's significant bytes, which shrinks the shuffle by a sixth.
    """
    held: list[tuple[np.ndarray, ...]] = []
    names = ["h", "at", "doc", "tag", "marked"]

    def flush() -> Iterator[pa.RecordBatch]:
        h, check, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not len(h):
            return
        order = np.lexsort((place, doc, check, h))
        h, check, doc, place = h[order], check[order], doc[order], place[order]
        lead = np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])]
        first, group = np.flatnonzero(lead), np.cumsum(lead) - 1
        least, at = doc[first][group], place[first][group]
        rest = (doc == least) & ~lead
        ends = np.r_[0, np.cumsum(rest)][np.r_[first, len(h)]] * 8
        others = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(place[rest].tobytes())])
        where = check[first].astype(np.int64) << 32 | place[first] & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(where), pa.array(doc[first]), pa.array((place[first] >> 32).astype(np.int32)), others], names)
        later = doc > least
        if later.any():
            d, marked = _lists(*_runs(doc[later], _marks(place[later], least[later], at[later])))
            m = len(d)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), d, pa.nulls(m, pa.int32()), marked], names)

    for b in batches:
        ids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for _, rows, buf, off in _unpack(b.column(2), np.ones(b.num_rows, bool)):
            words = Words(buf, off)
            wh = words.hashes(key)
            at, h = anchors(wh, words.first, window, anchor)
            edge = np.searchsorted(at, words.first)
            hit = np.zeros(len(at), bool)
            for i, r in enumerate(rows):
                lo, hi = edge[i], edge[i + 1]
                hit[lo:hi] = np.isin(h[lo:hi], np.frombuffer(b.column(3)[r].as_buffer(), np.uint64))
            cover = np.zeros(len(wh) + window + 1, np.int64)
            np.add.at(cover, np.maximum(at[hit] - (window - anchor), 0), 1)
            np.add.at(cover, at[hit] + 1, -1)
            starts = within(words.first, window)
            starts = starts[np.cumsum(cover)[starts] > 0]
            if not len(starts):
                continue
            full = shingles(wh, window)[starts]
            other = shingles(mix(wh ^ np.uint64(0x5851F42D4C957F2D)), window)[starts]
            at = np.searchsorted(words.first, starts, "right") - 1
            own = np.array(rows)[at]
            held.append((full, (other >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[own], tags[own].astype(np.int64) << 32 | starts - words.first[at]))
            if sum(len(x[0]) for x in held) >= HELD:
                yield from flush()
    if held:
        yield from flush()


def _mark_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, marked) from rows (h, at, doc, tag, marked) sorted by h, check, doc and place: windows that start in a smaller document."""
    last: tuple[int, int, int, int] | None = None
    for b in batches:
        null = np.asarray(b.column(0).is_null())
        if null.any():
            done = b.filter(pa.array(null))
            yield pa.RecordBatch.from_arrays([done.column(2), done.column(4)], ["doc", "marked"])
        b = b.filter(pa.array(~null))
        h, at, doc, tag = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3))
        if not len(h):
            continue
        check, place = at >> 32, tag.astype(np.int64) << 32 | at & 0xFFFFFFFF
        lead = np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])]
        first = np.flatnonzero(lead)
        source, at = doc[first], place[first]
        if last and last[:2] == (h[0], check[0]):
            source[0], at[0] = last[2:]
        group = np.cumsum(lead) - 1
        source, at = source[group], at[group]
        last = (h[-1], check[-1], source[-1], at[-1])
        more = doc > source
        others = b.column(4)
        size = np.diff(np.frombuffer(others.buffers()[1], np.int32)[others.offset : others.offset + len(others) + 1])
        found = [(doc[more], _marks(place[more], source[more], at[more]))]
        for i in np.flatnonzero(more & (size > 0)):
            p = np.frombuffer(others[int(i)].as_py(), np.int64)
            found.append((np.full(len(p), doc[i]), _marks(p, source[i], at[i])))
        d, marked = _lists(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([d, marked], ["doc", "marked"])


def _covered(n: int, start: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the marked windows cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows + window - 1, -1)
    return np.cumsum(edge)[:n] > 0


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
_RESULT = "_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, words: long>>"


def _apply(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """From rows (_id, _tag, _packed, marked, _copy): each row's result; and rows (a source's id, `check`) of what its words must be."""
    names = ["_id", "n_words", "n_removed", "kept_sha256", "spans", "check"]
    seen: set[bytes] = set()
    zstd = zstandard.ZstdDecompressor()
    for b in batches:
        total, gone, digest, spans, source, checks = [], [], [], [], [], []
        for i in range(b.num_rows):
            packed, marked, tag = b.column(2)[i], b.column(3)[i], b.column(1)[i].as_py()
            words = zstd.decompress(packed.as_buffer()).split() if packed.is_valid else []
            n, span, kept = len(words), [], words
            if b.column(4)[i].as_py() and n >= window:
                kept, span = [], [{"start": 0, "words": n}]
            elif marked.is_valid:
                m = np.frombuffer(marked.as_buffer(), MARK)
                m = m[m["place"] >> 32 == tag]
                _, m = _runs(np.zeros(len(m), np.int64), m)
                start = m["place"] & 0xFFFFFFFF
                covered = _covered(n, start, m["n"], window)
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                edge = np.flatnonzero(np.diff(np.r_[0, covered, 0]))
                span = [{"start": int(s), "words": int(t - s)} for s, t in edge.reshape(-1, 2)]
                for s, k, doc, at in zip(start.tolist(), (m["n"] + window - 1).tolist(), m["source"].tolist(), m["at"].tolist(), strict=True):
                    one = np.array([(at, k, _digest(words[s : s + k]))], CHECK).tobytes()
                    if (name := one + doc.to_bytes(8, "little", signed=True)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        source.append(doc)
                        checks.append(one)
            total.append(n)
            gone.append(n - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans.append(span)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, _SPANS), pa.nulls(b.num_rows, pa.binary())], names)
        if checks:
            m = len(checks)
            yield pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, _SPANS), pa.array(checks, pa.binary())], names)


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(b.column(5).is_null()).select(range(5))


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(b.column(5).is_valid()).select([0, 5])


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (_id, _tag, _packed, check): (_id, n_words null and so on) of sources whose words aren't what was found elsewhere."""
    zstd = zstandard.ZstdDecompressor()
    for b in batches:
        wrong = []
        for i in range(b.num_rows):
            c = np.unique(np.frombuffer(b.column(3)[i].as_buffer(), CHECK))
            c = c[c["at"] >> 32 == b.column(1)[i].as_py()]
            if not len(c):
                continue
            words = zstd.decompress(b.column(2)[i].as_buffer()).split()
            at = c["at"] & 0xFFFFFFFF
            if any(_digest(words[s : s + k]) != d.tobytes() for s, k, d in zip(at.tolist(), c["words"].tolist(), c["digest"], strict=True)):
                wrong.append(b.column(0)[i].as_py())
        if wrong:
            m = len(wrong)
            yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, _SPANS)], ["_id", "n_words", "n_removed", "kept_sha256", "spans"])


def _attempt(known: DataFrame, window: int, anchor: int, key: int) -> DataFrame:
    """The results under a key, and rows without n_words of sources that don't hold what was found elsewhere; computed once.

    A row's tag tells it from others of its id; it is 0, which shrinks in the shuffle, where an id is alone.
    """
    named = known.select("_id", "_text", F.unhex(F.substring(F.sha2(F.col("_text"), 256), 1, 32)).alias("_d"))
    many = cut(known.groupBy("_id").count().where("count > 1").select("_id", F.lit(True).alias("_many")))
    tag = F.lit(0)
    if not many.isEmpty():
        named, tag = named.join(small(many), "_id", "left"), F.when(F.col("_many"), F.hash(F.lit(key), "_d")).otherwise(0)
    named = named.withColumn("_tag", tag)
    # Inner joins infer this filter and push it under the exchange; without it elsewhere too, they'd have an exchange of their own.
    texts = named.select("_id", "_tag", "_text").mapInArrow(_pack, "_id long, _tag int, _packed binary").where("_id is not null").repartition("_id")
    digests = named.where("_d is not null").select("_id", "_tag", "_d", F.pmod(F.xxhash64("_id"), F.lit(8)).alias("_salt"))
    least = digests.groupBy("_d").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most").select("_d", "_least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("_salt"))
    copies = digests.join(least, ["_d", "_salt"]).where("_id > _least").groupBy("_id").agg(F.collect_set("_tag").alias("_copies"))
    rows = texts.join(copies.hint("shuffle_hash"), "_id", "left").withColumn("_copy", F.coalesce(F.array_contains("_copies", F.col("_tag")), F.lit(False)))
    once = F.when(~F.col("_copy"), F.col("_packed")).alias("_packed")
    sent = rows.select("_id", "_tag", once).mapInArrow(functools.partial(_send_anchors, window=window, anchor=anchor, key=key), "h long, doc long, hs binary")
    matched = sent.repartition(F.coalesce("h", "doc")).sortWithinPartitions("h").mapInArrow(_match_anchors, "doc long, hs binary")
    flags = matched.groupBy("doc").agg(F.listagg("hs").alias("hs"))
    flagged = rows.join(flags.hint("shuffle_hash"), F.col("_id") == F.col("doc")).select("_id", "_tag", once, "hs")
    windows = flagged.mapInArrow(functools.partial(_send_windows, window=window, anchor=anchor, key=key), "h long, at long, doc long, tag int, marked binary")
    marks = windows.repartition(F.coalesce("h", "doc")).sortWithinPartitions("h", F.shiftright("at", 32), "doc", "tag", "at").mapInArrow(_mark_windows, "doc long, marked binary")
    marks = marks.groupBy("doc").agg(F.listagg("marked").alias("marked"))
    last = rows.join(marks.hint("shuffle_hash"), F.col("_id") == F.col("doc"), "left").select("_id", "_tag", "_packed", "marked", "_copy")
    out = last.mapInArrow(functools.partial(_apply, window=window), _RESULT + ", check binary").repartition("_id")
    checks = out.mapInArrow(_checks, "doc long, check binary").groupBy("doc").agg(F.listagg("check").alias("check"))
    wrong = texts.join(checks.hint("shuffle_hash"), F.col("_id") == F.col("doc")).select("_id", "_tag", "_packed", "check").mapInArrow(_unlike, _RESULT)
    return cut(out.mapInArrow(_results, _RESULT).union(wrong))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, key: int | None = None) -> DataFrame:
    """_id, n_words, n_removed, kept_sha256 and spans (start and length, in words, of removed paths) of each row. The key, drawn for each run unless given, sets the hashes and not the results."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    key = secrets.randbits(60) if key is None else key
    while not (out := _attempt(rows.where("_id is not null"), window, anchor, key)).where("n_words is null").isEmpty():
        key = secrets.randbits(60)
    nameless = rows.where("_id is null").select("_id", F.lit(0).alias("_tag"), "_text").mapInArrow(_pack, "_id long, _tag int, _packed binary")
    nameless = nameless.select("*", F.lit(None).cast("binary").alias("marked"), F.lit(False).alias("_copy")).mapInArrow(functools.partial(_apply, window=window), _RESULT + ", check binary").drop("check")
    return out.union(nameless)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("_id", "doc_id").drop("spans")
