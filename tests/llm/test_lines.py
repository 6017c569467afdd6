from collections import Counter

import numpy as np
import pytest
from palimpsest.llm import lines

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(docs):
    """Kept lines of each (id, text), by comparing all pairs."""
    seen, out = [], []
    for i, text in sorted(docs):
        keep = []
        for line in text.encode().split(b"\n"):
            w = line.translate(LOW).split()
            s = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None
            if not s:
                keep.append(line)
                continue
            if not any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                keep.append(line)
            seen.append(s)
        out.append((i, b"\n".join(keep).decode()))
    return out


@pytest.fixture
def crowded(corpus):
    """A family of many variants of one line, of which some match only the first."""
    base = [f"w{i}" for i in range(50)]
    out = [(1000, " ".join(base))]
    for k in range(40):
        w = list(base)
        w[(k * 7) % 50] = f"x{k}"
        if k % 3 == 0:
            w[(k * 11 + 20) % 50] = f"y{k}"
        out.append((1001 + k, " ".join(w)))
    return corpus + out


def test_against_all_pairs(spark, crowded):
    out = lines.dedup(spark.createDataFrame(crowded, "doc_id long, text string").repartition(7)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == brute(crowded)


def test_second_pass_names_every_candidate(spark, crowded, monkeypatch):
    monkeypatch.setattr(lines, "NAMED", 1)
    assert sorted((r.doc_id, r.text) for r in lines.dedup(spark.createDataFrame(crowded, "doc_id long, text string")).collect()) == brute(crowded)


def test_odd_and_empty(odd, empty, odd_rows):
    out = lines.dedup(odd)
    assert [c for c in out.columns if c not in ("_lines", "_removed")] == odd.columns
    kept = out.collect()
    assert Counter(r.doc_id for r in kept) == Counter(r[0] for r in odd_rows)
    by = {r.doc_id: r for r in kept if r.doc_id is not None}
    assert by[1]._removed == 0 and by[2]._removed == 1 and by[2].text == "" and by[5].text is None and by[4].text == ""
    assert by[13]._removed == 1 and by[6].text == " \t\n " and by[9]._removed == 2
    assert all(r.text == odd_rows[0][1] for r in kept if r.doc_id is None and r.text)
    assert lines.dedup(empty).count() == 0


def test_rows_sharing_an_id(spark):
    """One copy of each line stays, within a task and across tasks."""
    a, b, c = ("\n".join(f"{k} {i} " + " ".join(f"{k}{i}{j}" for j in range(6)) for i in range(3)) for k in "abc")
    docs = [(1, a), (1, a), (2, b), (2, b + "\n" + a), (2, c), (3, c), (1, "few words"), (2, None), (None, a)]
    for parts in (1, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = [(r.doc_id, r.text) for r in lines.dedup(df).collect() if r.doc_id is not None and r.text is not None]
        assert sorted(got) == sorted(brute([d for d in docs if None not in d]))


def test_short_lines(spark):
    docs = [(1, "All rights reserved.\nall rights reserved.\n\none"), (2, "ALL rights  reserved.\n \none two\none"), (3, "one two three four\none two three four five\none two three four"), (4, "\n\n")]
    got = sorted((r.doc_id, r.text) for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs) == [(1, "All rights reserved.\n\none"), (2, " \none two"), (3, "one two three four\none two three four five"), (4, "\n\n")]


def test_odd_rows_sharing_an_id(odd):
    assert sorted(r.text for r in lines.dedup(odd).collect() if r.doc_id == 11) == ["", "Only Five Words Are Here"]


def test_filters_of_clipped_sizes():
    clip = lines._CLIP
    n, at, m, to = (np.array(x) for x in ([clip, clip, 200_000], [111_000, 5, 50_000], [clip, 230_000, 200_000], [clip, 5, 50_000]))
    assert lines._fits(n, np.minimum(at, clip), m, to)[0].tolist() == [True, True, False]
