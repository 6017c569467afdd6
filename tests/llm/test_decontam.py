import random

import numpy as np
import pyarrow as pa
import pytest
from palimpsest.llm import decontam


def distance(item, text):
    """Least edit distance of a list to a run of another, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment():
    rng = random.Random(4)
    for _ in range(60):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(0, 15))]
        far, end, begin = decontam.align(np.array(a), np.array(b, dtype=np.int64))
        assert far == distance(a, b) and 0 <= begin <= end <= len(b) and distance(a, b[begin:end]) == far


@pytest.fixture(scope="module")
def items():
    rng = random.Random(6)
    return [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 60)))) for k in range(40)]


def test_recall_and_precision(spark, items):
    rng, docs, n = random.Random(8), [], 0
    for k, t in items:
        for _ in range(12):
            w = t.split()
            for _ in range(rng.randint(0, len(w) // 5)):
                j, how = rng.randrange(len(w)), rng.random()
                if how < 0.4:
                    w[j] = f"new{rng.randrange(99)}"
                elif how < 0.7 and len(w) > 1:
                    del w[j]
                else:
                    w.insert(j, f"more{rng.randrange(99)}")
            pad = [f"w{rng.randrange(400)}" for _ in range(60)]
            docs.append((n, ", ".join([*pad[:30], *w, *pad[30:]])))
            n += 1
    docs += [(n + i, " ".join(f"w{rng.randrange(400)}" for _ in range(300))) for i in range(100)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r._id): r for r in decontam.leaks(df, bench).collect()}
    want = {}
    for i, t in docs:
        w = t.replace(",", "").split()
        for k, x in items:
            x = x.split()
            if (d := distance(x, w)) <= len(x) // 5:
                want[k, i] = d
    assert not set(got) - set(want)
    assert len(got) >= 0.95 * len(want)
    assert sum(got[p].distance == want[p] for p in got) >= 0.98 * len(got)
    clean = {r.doc_id for r in decontam.without_leaks(df, bench).collect()}
    assert clean == {i for i, _ in docs} - {i for _, i in got}


def test_odd_and_empty(odd, empty, spark, odd_rows):
    base = odd_rows[0][1]
    bench = spark.createDataFrame([(1, " ".join(base.split()[5:25]).upper().replace(" ", ", ")), (2, None), (3, ""), (4, "?!"), (None, "only five WORDS"), (5, "one"), (5, "one")], "item_id long, text string")
    got = {(r.item_id, r._id) for r in decontam.leaks(odd, bench).collect()}
    assert {(1, 1), (1, 2), (1, 3), (1, 9), (1, None), (None, 11), (None, 13), (5, 7)} <= got and not {i for _, i in got} & {4, 5, 6, 12}
    kept = decontam.without_leaks(odd, bench)
    assert kept.columns == odd.columns and {8, 10, 4, 5, 6, 12, 14} >= {r.doc_id for r in kept.collect() if r.doc_id is not None}
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(odd, bench.limit(0)).count() == 0
    assert decontam.without_leaks(odd, bench.limit(0)).count() == odd.count()


def edited(rng, words, how, even):
    """The words after all edits that their number allows, dealt evenly or at random; how: 0 replaces, 1 removes, 2 inserts."""
    w, n, k = list(words), len(words), len(words) // 5
    places = {int((q + 1) * n / (k + 1)) for q in range(k)} if even else set(rng.sample(range(n), k))
    for j in sorted(places, reverse=True):
        if how == 1:
            del w[j]
        else:
            w[j : j + (how == 0)] = [f"new{rng.randrange(9999)}"]
    return w


@pytest.mark.parametrize("n", [5, 9, 15, 20, 40, 59, 100, 300])
def test_recall_at_the_full_number_of_edits(n):
    rng, docs, of = random.Random(n), [], []
    texts = [[f"w{rng.randrange(3000)}" for _ in range(n)] for _ in range(60 if n < 200 else 15)]
    for i, w in enumerate(texts):
        for how in range(3):
            for even in (False, True):
                docs.append(" ".join([*rng.choices(texts[i - 1], k=20), *edited(rng, w, how, even), *rng.choices(texts[i - 1], k=20)]))
                of.append(i)
    found = {(i, d) for i, d, *_ in decontam.find(pa.array(docs), decontam.Items(list(range(len(texts))), [" ".join(w) for w in texts]))}
    assert sum((i, d) in found for d, i in enumerate(of)) >= 0.95 * len(of)


def test_one_very_long_item_costs_its_length_once():
    rng = random.Random(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    items = decontam.Items(list(range(201)), [" ".join(long)] + [" ".join(f"v{rng.randrange(900)}" for _ in range(30)) for _ in range(200)])
    assert sum(t.keys.nbytes + t.entries.nbytes + t.map.nbytes for tables in items.tables.values() for t in tables) < 200 * len(items.flat)
    doc = list(long)
    for j in rng.sample(range(20_000), 400):
        doc[j] = "new"
    assert [(i, d, far) for i, d, _, _, far in decontam.find(pa.array([" ".join(doc), " ".join(long[:9_000])]), items)] == [(0, 0, 400)]


def test_many_items_in_one_scan(spark, monkeypatch):
    rng = random.Random(12)
    bench = [(k, " ".join(f"q{rng.randrange(60_000)}" for _ in range(rng.randrange(15, 45)))) for k in range(20_000)]
    docs = [(d, " ".join(["x"] * 9 + edited(rng, bench[17 * d][1].split(), d % 3, False) + ["y"] * 9)) for d in range(1_000)] + [(5_000 + d, "z " * 50) for d in range(50)]
    sent = []
    blocks = decontam._blocks
    monkeypatch.setattr(decontam, "_blocks", lambda *a: (sent.append(b) or b for b in blocks(*a)))
    got = {(r.item_id, r._id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(sent) == 1 and len(got & {(17 * d, d) for d in range(1_000)}) >= 990 and all(d < 5_000 for _, d in got)


def test_blocks_of_items(spark, items, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 300)
    docs = spark.createDataFrame([(k, "a b " + t) for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(k, k) for k, _ in items} <= {(r.item_id, r._id) for r in decontam.leaks(docs, bench).collect()}
    assert decontam.without_leaks(docs, bench).count() == 0
