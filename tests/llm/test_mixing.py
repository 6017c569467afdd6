import math

from palimpsest.llm import mixing
from pyspark.sql import functions as F


def targets(sizes):
    """Targets by sharing the excess again and again; sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {s: 0.0 for s in sizes if sizes[s] == 0}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_copies(spark):
    rows = [(i, "w " * (5 + i % 17), s) for i in range(3000) for s in [("big", "tiny", "mid", None, "é")[0 if i % 3 else (i // 3) % 5]]] + [(9999, None, "none"), (9998, "", "none")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = {s: 0 for s in sizes}
    for r in out:
        assert math.isclose(r.target, want[r._source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.source_size == sizes[r._source] and r.copies <= 3
        taken[r._source] += r.copies * r._size
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 40 for s in sizes)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted((r._id, r.copies) for r in again) == sorted((r._id, r.copies) for r in out)


def test_odd_and_empty(odd, empty, spark):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(empty).count() == 0
    out = mixing.materialise(odd)
    assert out.columns == [*odd.columns, "copy"]
    want = {(r._id, r._size): r.copies for r in mixing.mix(odd).collect()}
    assert out.count() == mixing.mix(odd).agg(F.sum("copies")).first()[0] and want
    assert mixing.materialise(empty).count() == 0


def test_query_equals_sql(spark, small, oracle, same):
    same(mixing.op1_mix_sources(spark, small).toPandas(), oracle(mixing.SQL))
