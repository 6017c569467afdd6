import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from palimpsest.llm import langid
from pyspark.sql import functions as F


def test_grams():
    g = langid.grams(langid.folded("Ab, b".encode()))
    text = lambda x: "".join(chr(c) for c in (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF) if c)
    assert sorted(text(int(x)) for x in g) == sorted(["a", "b", "b", " a", "ab", "b ", " b", "b ", " ab", "ab ", " b "])
    assert not len(langid.grams(langid.folded("12 ?!".encode())))


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = langid.op5_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.95


def test_odd_and_empty(odd, empty, spark):
    profiles = langid.fit(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise(F.col("lang"))))
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, profiles, ["doc_id"]).where("doc_id is not null").collect()}
    assert out[4] == out[5] == out[6] == out[12] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in out.values()) and out[10][0] == "de"
    kept = langid.filter_languages(odd, profiles)
    assert kept.columns == odd.columns and not {4, 5, 6, 12} & {r.doc_id for r in kept.collect()}
    assert langid.fit(empty) == {}
    assert langid.filter_languages(odd, {}).count() == odd.count()
    assert {r.lang_pred for r in langid.predict(odd, {}, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty, profiles, ["doc_id"]).count() == 0


def test_ties_go_to_the_first(spark):
    same = np.array([97, 98], np.int64)
    assert langid.score_texts(pa.array(["ab", "ba ab"]), {"de": same, "en": same})[0] == ["de", "de"]


def brute(texts, learn):
    """(language, score) of each text by the definition, on strings; learn: (lang, text) rows."""

    def ranked(counts, most):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [ord(c) for c in x[0].rjust(3, "\0")]))][:most]

    def grams(text):
        words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
        out = Counter(c for w in words for c in w)
        for w in words:
            w = f" {w} "
            out.update(w[i : i + 2] for i in range(len(w) - 1))
            out.update(w[i : i + 3] for i in range(len(w) - 2))
        return out

    total = {}
    for lang, text in learn:
        total.setdefault(lang, Counter()).update(grams(text))
    profiles = {k: {g: r for r, g in enumerate(ranked(c, langid.PROFILE))} for k, c in sorted(total.items())}
    out = []
    for t in texts:
        mine, most = ranked(grams(t), langid.MINE), max(map(len, profiles.values()))
        if not mine:
            out.append(("und", 0.0))
            continue
        far = sorted((sum(abs(p[g] - i) if g in p else most for i, g in enumerate(mine)), k) for k, p in profiles.items())
        score = (1 - far[0][0] / (most * len(mine))) * (1 - far[0][0] / far[1][0]) ** 0.25
        out.append((far[0][1], score))
    return out


def test_against_the_definition(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    learn = [(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    want = brute([r.text for r in rows], learn)
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in langid.op5_language_id(spark, small).collect()}
    for r, (lang, score) in zip(rows, want, strict=True):
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-9 and got[r.doc_id][2] == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_profiles_shorter_than_the_text():
    """A rank far beyond a short profile costs no more than an unknown n-gram: scores stay from 0 to 1."""
    profile = lambda text: langid.top(langid.grams(langid.folded(text.encode())), langid.PROFILE)
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("bcdefghijklmnop") for _ in range(6)) for _ in range(300)) + " a ab"
    for profiles in ({"en": profile("ab")}, {"en": profile("ab"), "fr": profile("abz")}):
        langs, scores = langid.score_texts(pa.array([long, "ab", None]), profiles)
        assert langs == ["en", "en", "und"] and 0 <= scores[0] < scores[1] == 1 and scores[2] == 0
