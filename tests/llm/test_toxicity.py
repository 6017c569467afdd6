import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from palimpsest.llm import toxicity
from pyspark.sql import functions as F


def labelled(n=600):
    rng, docs, labels = random.Random(2), [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["awful", "horrid", f"grumble{rng.choice('abcdefgh')}"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_index_is_exact():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        t = np.sort(rng.choice(60, rng.integers(0, 8), replace=False))
        rows.append((i, int(rng.random() < 0.3), t.tolist(), rng.integers(1, 5, len(t)).tolist()))
    ix = toxicity.Index(np.arange(60, dtype=np.uint64), rng.integers(3, 50, 60).astype(float), rows, 500)
    dense = np.zeros((len(ix.ids), 60))
    by = {r[0]: r for r in rows}
    for k, i in enumerate(ix.ids):
        _, _, t, n = by[int(i)]
        dense[k, t] = ix.weights(np.array(t), np.array(n, float))
    for i, _, t, n in rows[:150]:
        if t:
            w = ix.weights(np.array(t), np.array(n, float))
            cos = dense[:, t] @ w
            near, got = ix.nearest(np.array(t), w)
            order = np.lexsort((ix.ids, -cos.round(12)))[: toxicity.NEIGHBOURS]
            order = order[cos[order] > 0]
            assert np.allclose(got, cos[order]) and np.allclose(cos[near], got)


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(d, toxicity.fit(d, y, usable=F.col("doc_id") % 3 != 1)).toPandas().set_index("_id")
    truth = dict(labels)
    held = [i for i in truth if i % 3 == 1]
    assert np.mean([out.score[i] >= 0.7 for i in held if truth[i]]) > 0.9
    assert np.mean([out.score[i] >= 0.7 for i in held if not truth[i]]) < 0.02
    assert all(len(e) <= toxicity.NEIGHBOURS and all(x % 3 != 1 for x in e) for e in out.evidence)


def test_odd_and_empty(odd, empty, spark):
    docs, labels = labelled(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0), (5, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    ix = toxicity.fit(d, y)
    out = toxicity.score(odd, ix).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty, ix).count() == 0
    none = toxicity.fit(d, y.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}


def brute(docs, labels):
    """The score of each text by the definition, on strings and dense vectors."""

    def terms(text):
        words = re.findall("[a-z]+", text.lower())
        return Counter(t for w in words for t in [w + "$", *[w[:k] for k in toxicity.PREFIXES if len(w) > k]])

    of = {i: terms(t) for i, t in docs}
    rows = [(i, y) for i, y in labels if i in of]
    total, bad = len(rows), sum(y for _, y in rows)
    n, y = Counter(t for i, _ in rows for t in of[i]), Counter(t for i, z in rows if z for t in of[i])

    def ratio(t):
        cells = [(y[t], n[t] * bad), (n[t] - y[t], n[t] * (total - bad)), (bad - y[t], (total - n[t]) * bad), (total - n[t] - bad + y[t], (total - n[t]) * (total - bad))]
        return 2 * sum(o * math.log(o * total / e) for o, e in cells if o > 0 and e > 0)

    odds = lambda t: (y[t] * (total - bad), (n[t] - y[t]) * bad)
    known = {t for t in n if n[t] >= toxicity.MIN_ROWS and ratio(t) >= toxicity.LEAST_RATIO and max(odds(t)) >= toxicity.LEAST_ODDS * min(odds(t))}

    def vector(i):
        v = {t: (1 + math.log(c)) * (math.log((total + 1) / (n[t] + 1)) + 1) for t, c in of[i].items() if t in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {i: vector(i) for i in of}
    kept, bare = [(i, z) for i, z in rows if vectors[i]], [z for i, z in rows if not vectors[i]]
    base = sum(z for _, z in kept) / len(kept)

    def vote(i, but=None):
        cos = [(-round(sum(x * vectors[k].get(t, 0) for t, x in vectors[i].items()), 12), k, z) for k, z in kept if k != but]
        near = [(-c, z) for c, _, z in sorted(cos)[: toxicity.NEIGHBOURS] if c < 0]
        return (sum(c * z for c, z in near) + toxicity.PRIOR * base) / (sum(c for c, _ in near) + toxicity.PRIOR)

    votes = sorted((vote(i, i), z) for i, z in kept)
    return {i: vote(i) if vectors[i] else None for i in of}, (sum(bare) + toxicity.PRIOR * bad / total) / (len(bare) + toxicity.PRIOR), votes


def test_against_the_definition(spark):
    rng, docs, labels = random.Random(4), [], []
    word = lambda k: "".join(chr(97 + int(c)) for c in f"{k:03d}") + "xyz"[: k % 4]
    for i in range(300):
        toxic = i % 4 == 0
        docs.append((i, " ".join(word(rng.randrange(30) if rng.random() < (0.3 if toxic else 0.08) else rng.randrange(30, 400)) for _ in range(rng.randrange(3, 40)))))
        labels.append((i, int(toxic)))
    votes, bare, fitted = brute(docs, labels)
    ix = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r._id: r.score for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), ix).collect()}
    steps = ix.steps
    assert len(set(votes.values())) > 20 and np.isclose(steps[0].min(), min(v for v, _ in fitted)) and np.isclose(steps[0].max(), max(v for v, _ in fitted)) and (np.diff(steps[1]) >= 0).all()
    for i, v in votes.items():
        assert np.isclose(got[i], bare if v is None else np.interp(v, *steps), atol=1e-6), i


@pytest.mark.parametrize("share", [2, 10])
def test_labels_that_are_mostly_toxic(spark, share):
    docs, labels = labelled()
    keep = [i for i, y in labels if y or i % share == 1]
    d = spark.createDataFrame([r for r in docs if r[0] in set(keep)], "doc_id long, text string")
    out = toxicity.score(d, toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    truth = dict(labels)
    assert np.mean([r.score >= 0.7 for r in out if truth[r._id]]) > 0.9
