import random

import pytest

WORDS = ["the", "of", "and", "river", "stone", "Ärger", "ñandú", "blue", "green", "walk", "talk", "sleep", "dream", "cloud", "rain", "sun", "moon", "star", "tree", "leaf", "root", "seed", "fish", "bird"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, size long, rate double, copies int, _gone int, h long, key string, label string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))


def row(i, text, lang="en", source="a"):
    """A document with extra columns whose names operators use inside."""
    return (i, text, lang, source, None if text is None else len(text), "x", "y", 7, 0.5, 3, 1, 2, "k", "l")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, copies, near copies, repeated rows, and one very long text."""
    rng = random.Random(11)
    base = sentence(rng, 60)
    words = base.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    long = "\n".join(sentence(rng, 40) for _ in range(4000))
    rows = [
        row(1, base), row(2, base, source="b"), row(3, near), row(4, ""), row(5, None), row(6, " \t\n "), row(7, "one"), row(8, sentence(rng, 200)),
        row(9, base + "\n" + sentence(rng, 20) + "\n" + base), row(10, long), row(11, "Only Five Words Are Here", None, None), row(11, "Only Five Words Are Here", None, None),
        row(None, base), row(None, None, None, None), row(12, "!!! 123 ???"), row(13, "only five words are here"), row(14, words[0] + "\x00" + " é́ " + "w" * 100_000),
        (None,) * 14,
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies and shared passages, as (id, text)."""
    rng = random.Random(7)
    out, passage = [], sentence(rng, 70)
    for i in range(120):
        kind = i % 6
        if kind < 3 or not out:
            text = "\n".join(sentence(rng, rng.randrange(3, 40)) for _ in range(rng.randrange(1, 6)))
        elif kind == 3:
            text = rng.choice(out)[1]
        elif kind == 4:
            w = rng.choice(out)[1].split(" ")
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            text = " ".join(w)
        else:
            text = sentence(rng, 10) + "\n" + passage + "\n" + sentence(rng, 15)
        out.append((i, text))
    return out
