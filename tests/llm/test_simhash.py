import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from palimpsest.llm import similar, simhash

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text, k=3):
    w = (text or "").encode().translate(LOW).split()
    k = min(k, len(w))
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []
    bits = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(s))


def grouped(items, linked):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_against_all_pairs(spark, corpus):
    docs = sorted(corpus)
    out = sorted((r._id, r._fp % (1 << 64), r.component) for r in simhash.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    fp = [fingerprint(t) for _, t in docs]
    want = grouped(fp, lambda a, b: (a ^ b).bit_count() <= 2)
    assert out == [(i, f, docs[c][0]) for (i, _), f, c in zip(docs, fp, want, strict=True)]


@pytest.mark.parametrize("crowded", [2, 10_000])
def test_links_of_random_fingerprints(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "_fp long, _id long")
    from palimpsest.llm.graph import components

    got = dict((r.vertex, r.component) for r in components(simhash.links(df)).collect())
    want = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_tree():
    rng = random.Random(2)
    xs, t = [rng.getrandbits(12) for _ in range(300)], simhash.Tree()
    for x in xs:
        t.add(x)
    for q in range(0, 4096, 97):
        assert sorted(t.near(q, 2)) == sorted({x for x in xs if (x ^ q).bit_count() <= 2})


def test_odd_and_empty(odd, empty, odd_rows):
    out = simhash.groups(odd).collect()
    assert len(out) == len(odd_rows)
    by = {r._id: r for r in out if r._id is not None}
    assert by[1].component == by[2].component == 1 and by[4]._fp == by[5]._fp == by[6]._fp == 0 and by[6].component == 4
    assert by[11].component == by[13].component == 11
    assert {r.component for r in out if r._id is None} == {1, 4}
    assert simhash.groups(empty).count() == 0


def shingles(text):
    w = (text or "").encode().translate(LOW).split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def test_documents_at_the_similarity(spark, corpus):
    rng = random.Random(9)
    docs = list(corpus)
    for k in range(60):
        w = rng.choice(corpus)[1].split(" ")
        for _ in range(max(1, len(w) // rng.choice((40, 60, 90)))):
            w[rng.randrange(len(w))] = f"z{k}"
        docs.append((500 + k, " ".join(w)))
    docs.sort()
    sets = [shingles(t) for _, t in docs]
    want = grouped(sets, lambda a, b: not a and not b or 5 * len(a & b) >= 4 * len(a | b))
    kept = {r.doc_id for r in similar.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {docs[i][0] for i in set(want)}


def test_rows_sharing_an_id_are_judged_by_their_own_text(spark, corpus):
    texts = [" ".join(f"{k}{j}" for j in range(40)) for k in "abcd"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1] + " more"), (4, texts[2]), (4, texts[3]), (4, texts[3] + " more"), (4, texts[2]), (5, texts[2])]
    kept = sorted((r.doc_id, r.text) for r in similar.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    either = [r for r in kept if r[1].startswith(texts[3])]
    assert len(either) == 1 and [r for r in kept if r not in either] == sorted([(1, texts[0]), (2, texts[1]), (4, texts[2]), (4, texts[2])])


def test_documents_odd_and_empty(odd, empty, odd_rows):
    kept = similar.dedup(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids.count(0) == sum(r[0] is None for r in odd_rows) and 2 not in ids and 1 in ids and ids.count(11) == 2 and 13 not in ids and 4 in ids and 6 not in ids
    assert similar.dedup(empty).count() == 0


def test_one_crowded_shard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    members = [(0, 0, np.sort(base)[: similar.SKETCH].tobytes())]
    for i in range(1, similar.CROWDED + 200):
        s = base.copy()
        s[rng.integers(0, 200, 10)] = rng.integers(0, 1 << 32, 10, dtype=np.uint32)
        members.append((i, int(rng.integers(0, 8)), np.sort(s)[: similar.SKETCH].tobytes()))
    pairs = list(similar._pairs(members))
    seen = {0}
    for _ in range(6):
        seen |= {x for u, v, _ in pairs for x in (u, v) if u in seen or v in seen}
    assert len(seen) >= 0.99 * len(members) and len(pairs) < 3 * len(members)


def test_fingerprints_of_slices():
    col = pa.array(["a b c d", None, "", "A B  C\nD"]).slice(1)
    assert simhash.fingerprints(col).tolist() == [0, 0, fingerprint("a b c d")]


def replaced(rng, words, *runs):
    """The words with new ones in the given runs (from, number); a run of m words changes m + 4 shingles."""
    words = list(words)
    for a, m in runs:
        words[a : a + m] = [f"n{rng.getrandbits(40)}" for _ in range(m)]
    return words


def similarity(a, b):
    a, b = shingles(" ".join(a)), shingles(" ".join(b))
    return len(a & b) / len(a | b)


def test_chains_in_a_crowded_shard(spark):
    """Near copies of near copies are found among over CROWDED copies of what the first derive from."""
    rng = random.Random(3)
    docs = []
    base = [f"b{rng.getrandbits(40)}" for _ in range(304)]
    for _ in range(similar.CROWDED + 20):
        docs.append(replaced(rng, base, (rng.randrange(10, 290), 4)))
    for _ in range(30):
        x = replaced(rng, base, (rng.randrange(10, 130), 16))
        z = replaced(rng, x, (rng.randrange(150, 280), 18))
        assert similarity(x, base) > 0.86 and similarity(x, z) > 0.82 and similarity(z, base) < 0.8
        docs += [x, z]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    assert [r.doc_id for r in similar.dedup(df).collect()] == [0]


def test_partners_beyond_the_named(spark):
    """A true partner among many just below the similarity is found, on texts whose sketches only estimate."""
    rng = random.Random(5)
    docs = []
    for _ in range(8):
        base, family = [f"b{rng.getrandbits(40)}" for _ in range(1004)], []
        for _ in range(120):
            at = rng.sample(range(10, 990, 6), 13)
            family.append((at, replaced(rng, base, *[(a, 1) for a in at])))
        at, like = family[rng.randrange(120)]
        near = replaced(rng, base, *[(a, 1) for a in rng.sample(range(7, 990, 6), 11)])
        for a in at[:2]:
            near[a] = like[a]
        docs += [*[w for _, w in family], near]
    sets = [(i // 121, shingles(" ".join(w))) for i, w in enumerate(docs)]
    want = set(grouped(sets, lambda a, b: a[0] == b[0] and 9 * len(a[1] & b[1]) >= 4 * (len(a[1]) + len(b[1]))))
    kept = {r.doc_id for r in similar.dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()}
    assert len(want) < len(docs) and kept == want


def test_second_pass_shuffles_open_shards_only(spark, monkeypatch):
    """A family that needs the second pass costs its own shuffles, whatever the number of other documents."""
    rng = random.Random(8)
    base = [f"b{rng.getrandbits(40)}" for _ in range(104)]
    docs = [replaced(rng, base, (rng.randrange(10, 90), 8)) for _ in range(30)]
    docs += [[f"b{rng.getrandbits(40)}" for _ in range(300)] for _ in range(3_000)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    others, seen = similar._others, []

    def measured(*args):
        before = written()
        out = similar.cut(others(*args))
        seen.append(written() - before)
        return out

    monkeypatch.setattr(similar, "_others", measured)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    assert similar.dedup(df).count() >= 3_000
    assert 0 < seen[0] < 1_000_000
