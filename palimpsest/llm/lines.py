"""Line dedup by an exact set-similarity join.

A line's tokens are the set of its SHINGLE-word pieces, A-Z lower-cased; a line of fewer words is one piece. A line
goes if an earlier line, by (document id, place), has Jaccard similarity >= SIMILARITY with it; all is judged on
the input, not on what is left, so that order and retries don't matter.

1. Rarity. A count-min sketch of fixed size counts all tokens; tokens are ordered by (count, hash). Any total order
   gives the same matches, and this one puts frequent tokens last.
2. Prefixes. Two sets of n tokens that match share one of their first n - ceil(SIMILARITY * n) + 1 tokens, so only those
   are shuffled. Equal sets collapse, within a task before the shuffle and in each token's group after it, to the first.
3. Filters. In a token's group, pairs must pass the length filter, the positional filter (what can still overlap after
   the token's place in both) and a bound on the difference from 32-bit parity sketches; lines without such a pair are
   done. The others get 256-bit parity sketches, whose sharper bound leaves candidates. As one earlier match suffices,
   a line first names NAMED of them.
4. Verification. Candidates' token sets are compared exactly. A line that named not all its candidates and has found
   no match names all of them in a second pass, so nothing is lost.

Groups are compared in blocks of bounded size. Defined cases: a null text has no lines and stays null; lines
without words stay; rows with a null id keep all lines and match none; a document's own lines match each other; rows sharing an id
act as one document, the rows' lines after each other by text (then by the other columns), at most PLACES of
them; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import Words, chunks, cut, fresh, light, mix, sequences, shingles, small, within

SHINGLE = 5
#: Similarity as a fraction of integers: 4 / 5.
NUM, DEN = 4, 5
BUCKETS, SLICES = 1 << 18, 16
HELD, BLOCK = 600_000, 512
NAMED, WIDE, DOCUMENTS = 4, 4, 500_000
_CLIP, PLACES = (1 << 18) - 1, 1 << 27


def _by_line(line: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by line, then key: a fast sort by key, then a stable radix sort by line."""
    order = np.argsort(key)
    own = line[order]
    return order[np.argsort(own.astype(np.uint16) if own.max() < 1 << 16 else own, kind="stable")]


class _Lines:
    """Of a chunk of texts, the lines with words and their distinct tokens, ordered by rarity if counts are given, else by hash. plain: all tokens alone; places: the lines alone."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, counts: np.ndarray | None = None, plain: bool = False, places: bool = False) -> None:
        words = Words(buf, offsets, fold=True)
        none = np.empty(0, np.int64)
        self.tokens, self.line, self.doc, self.place = np.empty(0, np.uint64), none, none, none
        if not len(words.starts):
            return
        ends = np.flatnonzero(buf == 10) + 1
        cuts = np.unique(np.concatenate((offsets, ends)))
        first = np.searchsorted(words.starts, cuts)
        ids = np.flatnonzero(np.diff(first))
        if not len(ids):
            return
        if not plain:
            self.doc = np.searchsorted(offsets, cuts[ids], "right") - 1
            self.place = np.arange(len(ids)) - np.searchsorted(self.doc, self.doc)
            self.start, self.stop = cuts[ids], cuts[ids + 1]
        if places:
            return
        at, h = within(first, SHINGLE), words.hashes()
        tokens, size = [shingles(h, SHINGLE)[at]], np.diff(first)
        for k in range(1, SHINGLE):
            short = first[:-1][size == k]
            tokens.append(sequences(h, short, k))
            at = np.r_[at, short]
        tokens = np.concatenate(tokens)
        if plain:
            self.tokens = tokens
            return
        line = np.searchsorted(first, at, "right") - 1
        place = np.zeros(len(cuts), np.int64)
        place[ids] = np.arange(len(ids))
        line = place[line]
        key = tokens if counts is None else order_key(tokens, counts)
        order = _by_line(line, key)
        tokens, line = tokens[order], line[order]
        new = np.r_[True, (line[1:] != line[:-1]) | (tokens[1:] != tokens[:-1])]
        self.tokens, self.line = tokens[new], line[new]


def order_key(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rare tokens first: 8 bits for the count's size, 56 of the hash."""
    level = (8 * np.log2(counts + 1.0)).astype(np.uint64)
    return level[_bucket(tokens)] << np.uint64(56) | tokens >> np.uint64(8)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) % BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, buf, off in chunks(b.column(0)):
            total += np.bincount(_bucket(_Lines(buf, off, plain=True).tokens), minlength=BUCKETS)
    parts = np.minimum(total, 0xFFFFFFFF).astype("<u4").reshape(SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by[k] = by.get(k, 0) + np.frombuffer(c, "<u4").astype(np.int64)
    if by:
        yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in by.values()], pa.binary())], ["slice", "counts"])


def rarity(docs: DataFrame, text_col: str) -> np.ndarray:
    """The sketch's counts: BUCKETS numbers, whatever the input's size."""
    parts = docs.select(text_col).mapInArrow(_count, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(_add, "slice int, counts binary").collect()
    out = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for r in parts:
        out[r["slice"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, doc, shape, form, gone): a prefix token of a line; or, where h is null, places of lines that repeat another here."""
    held: list[tuple[np.ndarray, ...]] = []
    names = ["h", "doc", "shape", "form", "gone"]

    def flush() -> Iterator[pa.RecordBatch]:
        tokens, line, doc, place = [], [], [], []
        n = 0
        for t, ln, d, p in held:
            tokens.append(t)
            line.append(ln + n)
            doc.append(d)
            place.append(p)
            n += len(d)
        held.clear()
        t, ln, doc, place = (np.concatenate(x) for x in (tokens, line, doc, place))
        if not n:
            return
        head = np.searchsorted(ln, np.arange(n + 1))
        size = np.diff(head)
        form = np.add.reduceat(mix(t), head[:-1])
        odd = np.bitwise_xor.reduceat(np.uint64(1) << (t & np.uint64(31)), head[:-1])
        form = form >> np.uint64(32) << np.uint64(32) | odd
        order = np.lexsort((place, doc, size, form))
        lead = np.r_[True, (form[order][1:] != form[order][:-1]) | (size[order][1:] != size[order][:-1])]
        gone = np.sort(order[~lead])
        keep = np.ones(n, bool)
        keep[gone] = False
        at = np.arange(len(t)) - head[ln]
        prefix = size - -(-NUM * size // DEN) + 1
        chosen = np.flatnonzero((at < prefix[ln]) & keep[ln])
        h, own = t[chosen], ln[chosen]
        shape = place[own] << 36 | np.minimum(size[own], _CLIP) << 18 | np.minimum(at[chosen], _CLIP)
        m = len(h)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[own]), pa.array(shape), pa.array(form[own].view(np.int64)), pa.nulls(m, pa.int32())], names)
        if len(gone):
            m = len(gone)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(doc[gone]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(place[gone], pa.int32())], names)

    for b in batches:
        ids, known = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.asarray(b.column(0).is_valid())
        skip = b.column(2).to_numpy(zero_copy_only=False)
        for a, _, buf, off in chunks(b.column(1)):
            x = _Lines(buf, off, counts)
            ok = known[a + x.doc]
            if not ok.all():
                kept = ok[x.line]
                x.tokens, x.line = x.tokens[kept], (np.cumsum(ok) - 1)[x.line[kept]]
                x.doc, x.place = x.doc[ok], x.place[ok]
            held.append((x.tokens, x.line, ids[a + x.doc], x.place + skip[a + x.doc]))
            if sum(len(t[0]) for t in held) >= HELD:
                yield from flush()
    if held:
        yield from flush()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where rows differ from those before them."""
    lead = np.ones(len(keys[0]), bool)
    lead[1:] = False
    for k in keys:
        lead[1:] |= k[1:] != k[:-1]
    return lead


def _fits(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length and positional filters for sets of n and m tokens that share their tokens at and to, and the overlap needed; sets of clipped size pass."""
    need = -(-NUM * (n + m) // (NUM + DEN))
    most = np.maximum(n, m)
    return (NUM * most <= DEN * np.minimum(n, m)) & (np.minimum(n - at, m - to) >= need) | (most >= _CLIP), need


def _whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables that end where a value of the key column does; a group's rows are held, nothing else."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        if held and held[-1].column(key)[-1].as_py() == k[-1].as_py():
            held.append(b)
            continue
        last = k[-1].as_py()
        cutoff = b.num_rows if last is None else int(np.searchsorted(k.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), last))
        if cutoff:
            held.append(b.slice(0, cutoff))
        if held:
            yield pa.Table.from_batches(held)
        held = [b.slice(cutoff)] if cutoff < b.num_rows else []
    if held:
        yield pa.Table.from_batches(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From prefix rows sorted by h: (h, doc, line, n, at) of lines that may match another of their group; or, where h is null, lines that repeat an earlier set."""
    names = ["h", "doc", "line", "n", "at"]
    for t in _whole_groups(batches, 0):
        null = np.asarray(t["h"].is_null())
        if null.any():
            done = t.filter(pa.array(null))
            m = done.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), done["doc"].combine_chunks(), done["gone"].combine_chunks().cast(pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
            t = t.filter(pa.array(~null))
        h, doc, shape, form = (t[c].to_numpy() for c in ("h", "doc", "shape", "form"))
        lead = _runs(h) if len(h) else np.empty(0, bool)
        many = ~lead
        many[:-1] |= ~lead[1:]
        if not many.any():
            continue
        order = np.flatnonzero(many)
        order = order[np.lexsort((shape[many], doc[many], h[many]))]
        h, doc, shape, form = h[order], doc[order], shape[order], form[order]
        n = shape >> 18 & _CLIP
        group = np.cumsum(_runs(h))
        order = np.lexsort((np.arange(len(h)), n, form, group))
        new = _runs(group[order], form[order], n[order])
        again = np.sort(order[~new])
        if len(again):
            m = len(again)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(doc[again]), pa.array(shape[again] >> 36), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
        kept = np.sort(order[new])
        h, doc, shape, form, n = h[kept], doc[kept], shape[kept], form[kept], n[kept]
        at, odd = shape & _CLIP, form & 0xFFFFFFFF
        start = np.flatnonzero(_runs(h))
        size = np.diff(np.r_[start, len(h)])
        good = np.zeros(len(h), bool)
        two = start[size == 2]
        ok, need = _fits(n[two], at[two], n[two + 1], at[two + 1])
        ok &= np.bitwise_count(odd[two] ^ odd[two + 1]) <= n[two] + n[two + 1] - 2 * need
        good[two[ok]] = good[two[ok] + 1] = True
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for r in range(s, s + m, BLOCK):
                i = slice(r, min(r + BLOCK, s + m))
                for q in range(s, r + 1, BLOCK):
                    j = slice(q, min(q + BLOCK, s + m))
                    ok, need = _fits(n[i][:, None], at[i][:, None], n[j][None], at[j][None])
                    ok &= np.bitwise_count(odd[i][:, None] ^ odd[j][None]) <= n[i][:, None] + n[j][None] - 2 * need
                    if r == q:
                        np.fill_diagonal(ok, False)
                    good[i] |= ok.any(1)
                    good[j] |= ok.any(0)
        g = np.flatnonzero(good)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array(x[g]) for x in (h, doc, shape >> 36, n, at)], names)


def _name(batches: Iterator[pa.RecordBatch], every: bool, most: int) -> Iterator[pa.RecordBatch]:
    """(x_doc, x_line, y_doc, y_line, whole) from rows (h, doc, line, n, at, odd, asked) sorted by h, doc and line: each asked line's first `most` candidates, or all of them."""
    for t in _whole_groups(batches, 0):
        h, doc, line, n, at = (t[c].to_numpy() for c in ("h", "doc", "line", "n", "at"))
        odd = np.frombuffer(b"".join(t["odd"].to_pylist()), np.uint64).reshape(-1, WIDE)
        asked = t["asked"].to_numpy()
        start = np.flatnonzero(_runs(h))
        out: list[tuple[int, int, bool]] = []
        for s, e in zip(start.tolist(), np.r_[start[1:], len(h)].tolist(), strict=True):
            for y in range(s + 1, e) if e - s > 1 else ():
                if not asked[y]:
                    continue
                named = 0
                for q in range(s, y, 8 * BLOCK):
                    j = slice(q, min(q + 8 * BLOCK, y))
                    ok, need = _fits(n[j], at[j], n[y], at[y])
                    near = np.flatnonzero(ok)
                    far = np.bitwise_count(odd[j][near] ^ odd[y]).sum(1, dtype=np.int64)
                    near = near[far <= n[j][near] + n[y] - 2 * need[near]]
                    whole = every or named + len(near) <= most
                    out.extend((q + x, y, whole) for x in (near if every else near[: max(0, most - named)]).tolist())
                    named += len(near)
                    if not whole:
                        out[-1] = (out[-1][0], y, False)
                        break
        if out:
            x, y, whole = (np.array(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(line[x]), pa.array(doc[y]), pa.array(line[y]), pa.array(whole.astype(bool))], ["x_doc", "x_line", "y_doc", "y_line", "whole"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, line, tokens, odd) of the wanted lines of each document: packed sorted tokens, and a parity sketch of 64 * WIDE bits."""
    for b in batches:
        ids, wanted, skip = (b.column(i).to_pylist() for i in (0, 3, 2))
        for a, e, buf, off in chunks(b.column(1)):
            x = _Lines(buf, off)
            head = np.searchsorted(x.line, np.arange(len(x.doc) + 1))
            out: list[tuple] = []
            for i in range(e - a):
                lo, hi = np.searchsorted(x.doc, [i, i + 1])
                for line in set(wanted[a + i]):
                    if 0 <= (w := line - skip[a + i]) < hi - lo:
                        t = x.tokens[head[lo + w] : head[lo + w + 1]]
                        bits = np.zeros(64 * WIDE, np.int64)
                        np.add.at(bits, (t & np.uint64(64 * WIDE - 1)).astype(np.int64), 1)
                        out.append((ids[a + i], line, t.tobytes(), np.packbits((bits & 1).astype(np.uint8)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc", "line", "tokens", "odd"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y_doc, y_line) of rows (y_doc, y_line, x, y) whose sets match."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common * DEN >= NUM * (len(x) + len(y) - common))
        k = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], ["y_doc", "y_line"])


def _strip(batches: Iterator[pa.RecordBatch], text_at: int, skip_at: int, gone_at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, skip, gone = b.column(text_at), b.column(skip_at).to_pylist(), b.column(gone_at).to_pylist()
        new, lines, removed = [None] * b.num_rows, [0] * b.num_rows, [0] * b.num_rows
        for a, e, buf, off in chunks(text):
            x = _Lines(buf, off, places=True) if any(gone[a:e]) else None
            raw = buf.tobytes()
            for i in range(e - a):
                one = raw[off[i] : off[i + 1]]
                lines[a + i] = one.count(b"\n") + 1 if len(one) else 0
                if gone[a + i]:
                    lo, hi = np.searchsorted(x.doc, [i, i + 1])
                    out, at = [], int(off[i])
                    for line in sorted(set(gone[a + i])):
                        if 0 <= (w := line - skip[a + i]) < hi - lo:
                            out.append(raw[at : int(x.start[lo + w])])
                            at = int(x.stop[lo + w])
                            removed[a + i] += 1
                    one = b"".join(out) + raw[at : int(off[i + 1])]
                    if one.endswith(b"\n") and not raw[: int(off[i + 1])].endswith(b"\n"):
                        one = one[:-1]
                new[a + i] = one.decode()
        valid = text.is_valid().to_pylist()
        cols = [pa.array([t if v else None for t, v in zip(new, valid, strict=True)], pa.string()) if i == text_at else c for i, c in enumerate(b.columns) if i not in (skip_at, gone_at)]
        names = [n for i, n in enumerate(b.schema.names) if i not in (skip_at, gone_at)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, "_lines", "_removed"])


def _placed(docs: DataFrame, id_col: str, text_col: str, skip: str) -> DataFrame:
    """docs and skip: where a row's places start, after those of the rows of its id before it."""
    one = F.lit(0).cast("long").alias(skip)
    key = fresh("_many", docs.columns)
    many = cut(docs.select(F.col(f"`{id_col}`").cast("long").alias(key)).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    if many.isEmpty():
        return docs.select("*", one)
    own, many = F.col(f"`{id_col}`").cast("long"), small(many, DOCUMENTS)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    order = Window.partitionBy(own).orderBy(text, F.to_json(F.struct("*"))).rowsBetween(Window.unboundedPreceding, 0)
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    total = F.sum(lines).over(order)
    start = F.when(total <= PLACES, total - lines).otherwise(F.raise_error(F.lit("rows sharing an id hold too many lines")))
    again = docs.join(many, own == F.col(f"`{key}`"), "left_semi").select("*", start.alias(skip))
    return docs.join(many, own == F.col(f"`{key}`"), "left_anti").select("*", one).union(again)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts' later lines removed, and _lines and _removed, the numbers of all and of removed lines (own columns of those names give way)."""
    names = [c for c in docs.columns if c not in ("_lines", "_removed")]
    skip = fresh("_skip", docs.columns)
    placed = _placed(docs.select(*[F.col(f"`{c}`") for c in names]), id_col, text_col, skip)
    plain = placed.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.col(skip).alias("_skip"))
    counts = rarity(plain, "_text")
    kind = "h long, doc long, shape long, form long, gone int"
    rows = plain.mapInArrow(functools.partial(_prefixes, counts=counts), kind).repartition(F.coalesce("h", "doc")).sortWithinPartitions("h")
    met = cut(rows.mapInArrow(_meet, "h long, doc long, line long, n long, at long"))
    exact = met.where("h is null").select(F.col("doc").alias("y_doc"), F.col("line").alias("y_line"))
    near = met.where("h is not null").join(exact.distinct(), (F.col("doc") == F.col("y_doc")) & (F.col("line") == F.col("y_line")), "left_anti")
    wanted = light(cut(near.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("line").alias("_wanted"))), F.size("_wanted"), DOCUMENTS)
    sets = plain.join(wanted, F.col("_id") == F.col("_doc")).select("_id", "_text", "_skip", "_wanted").mapInArrow(_sets, "doc long, line long, tokens binary, odd binary")
    sets = cut(sets.groupBy("doc", "line").agg(F.max("tokens").alias("tokens"), F.max("odd").alias("odd")))

    def named(asked: DataFrame | None) -> DataFrame:
        """Candidates of the asked lines, or the first of all lines."""
        ready = near.join(sets.select("doc", "line", "odd"), ["doc", "line"])
        if asked is None:
            ready = ready.withColumn("asked", F.lit(True))
        else:
            ready = ready.join(asked.select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line"), F.lit(True).alias("asked")), ["doc", "line"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        ready = ready.select("h", "doc", "line", "n", "at", "odd", "asked").repartition("h").sortWithinPartitions("h", "doc", "line")
        pairs = ready.mapInArrow(functools.partial(_name, every=asked is not None, most=NAMED), "x_doc long, x_line long, y_doc long, y_line long, whole boolean")
        return cut(pairs.groupBy("x_doc", "x_line", "y_doc", "y_line").agg(F.min("whole").alias("whole")))

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("doc").alias(f"{c}_doc"), F.col("line").alias(f"{c}_line"), F.col("tokens").alias(c)) for c in ("x", "y"))
        both = pairs.join(x, ["x_doc", "x_line"]).join(y, ["y_doc", "y_line"])
        return both.select("y_doc", "y_line", "x", "y").mapInArrow(_verify, "y_doc long, y_line long").distinct()

    pairs = named(None)
    matched = cut(verified(pairs))
    left = cut(pairs.where("not whole").select("y_doc", "y_line").distinct().join(matched, ["y_doc", "y_line"], "left_anti"))
    gone = exact.union(matched)
    if not left.isEmpty():
        gone = gone.union(cut(verified(named(left))))
    key, list_ = fresh("_doc", docs.columns), fresh("_gone", docs.columns)
    by = light(cut(gone.groupBy(F.col("y_doc").alias(key)).agg(F.collect_set("y_line").alias(list_))), F.size(list_), DOCUMENTS)
    ready = placed.join(by, F.col(f"`{id_col}`") == F.col(f"`{key}`"), "left").drop(key)
    schema = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes if c != skip)
    return ready.mapInArrow(functools.partial(_strip, text_at=names.index(text_col), skip_at=len(names), gone_at=len(names) + 1), schema + ", _lines long, _removed long")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines, and the digest of the remaining text."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
