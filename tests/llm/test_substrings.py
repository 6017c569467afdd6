import hashlib
import random

import numpy as np
import pyarrow as pa
import zstandard
from palimpsest.llm import substrings
from pyspark.sql import functions as F


def brute(docs):
    least, out = {}, []
    for i, t in docs:
        w = (t or "").encode().split()
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            least[k] = min(least.get(k, i), i)
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if least[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((r._id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_against_all_windows(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert rows(substrings.repeats(df.repartition(9))) == brute(corpus)
    for r in substrings.repeats(df).collect():
        assert sum(s.words for s in r.spans) == r.n_removed and all(a.start + a.words < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_tasks_settle_what_they_can(spark, corpus, monkeypatch):
    one = spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1)
    assert rows(substrings.repeats(one)) == brute(corpus)


def test_periodic_texts(spark):
    docs = [(1, "a b " * 40), (2, "x " * 30 + "a b " * 12), (3, "a b " * 7), (4, "x " * 13), (5, "b a " * 6 + "b")]
    assert rows(substrings.repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_odd_and_empty(odd, empty, odd_rows):
    got = [r for r in substrings.repeats(odd).collect()]
    assert len(got) == len(odd_rows)
    known = [(r[0], r[1]) for r in odd_rows if r[0] is not None]
    assert sorted((r._id, r.n_words, r.n_removed, r.kept_sha256) for r in got if r._id is not None) == brute(known)
    assert all(r.n_removed == 0 for r in got if r._id is None)
    assert substrings.repeats(empty).count() == 0


def test_rows_sharing_an_id_are_judged_by_their_own_text(spark):
    rng = random.Random(3)
    a, b, c, x, y, z = (" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(6))
    docs = [(1, a), (2, a), (2, b), (3, c + " " + x), (4, y + " " + c), (4, z), (4, z), (5, z)]
    assert rows(substrings.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == brute(docs)


def test_words_that_weak_hashes_confuse(spark):
    """Thue-Morse words, which polynomials modulo 2**64 can't tell apart."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, " ".join([word] * 13)), (2, " ".join([other] * 13)), (3, "x y " * 10 + word), (4, "x y " * 10 + other)]
    assert rows(substrings.repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_sources_confirm_what_was_found(spark):
    words = [f"a{k}".encode() for k in range(30)]
    good, bad = (np.array([(7 << 32 | 4, 14, substrings._digest(x))], substrings.CHECK).tobytes() for x in (words[4:18], words[5:19]))
    rows = [(1, 7, good), (2, 7, good + bad), (3, 8, bad)]
    text = zstandard.compress(b" ".join(words))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([text] * 3), pa.array([r[2] for r in rows])], ["_id", "_tag", "_packed", "check"])
    assert [b.column(0).to_pylist() for b in substrings._unlike(iter([batch]))] == [[2]]


def test_another_key_is_taken_when_a_source_differs(spark, corpus, monkeypatch):
    tried, run = [], substrings._attempt

    def attempt(known, window, anchor, key):
        tried.append(key)
        out = run(known, window, anchor, key)
        return out if len(tried) > 1 else out.withColumn("n_words", F.lit(None).cast("long")).select(out.columns)

    monkeypatch.setattr(substrings, "_attempt", attempt)
    assert rows(substrings.repeats(spark.createDataFrame(corpus, "doc_id long, text string"))) == brute(corpus)
    assert len(set(tried)) == 2


def test_the_key_does_not_show(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(7)
    assert rows(substrings.repeats(df, key=1)) == rows(substrings.repeats(df, key=2))
