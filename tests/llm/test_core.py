import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from palimpsest.llm import core

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x85 ñ日", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    seen = {}
    at = 0
    for a, b, buf, off in core.chunks(pa.array(texts, pa.string()), limit):
        assert a == at
        at = b
        w = core.Words(buf, off)
        h = w.hashes()
        for i in range(b - a):
            want = (texts[a + i] or "").encode().split()
            lo, hi = w.first[i], w.first[i + 1]
            assert [w.word(k) for k in range(lo, hi)] == want
            for word, x in zip(want, h[lo:hi].tolist(), strict=True):
                assert seen.setdefault(word, x) == x
    assert at == len(texts) and len(set(seen.values())) == len(seen)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=40), st.integers(1, 6))
def test_shingles_depend_on_their_words_alone(values, k):
    h = core.mix(np.array(values, np.uint64) + np.uint64(1))
    s = core.shingles(h, k)
    assert len(s) == max(0, len(values) - k + 1)
    by = {}
    for i, x in enumerate(s.tolist()):
        assert by.setdefault(tuple(values[i : i + k]), x) == x
    assert len(set(by.values())) == len(by)


@given(st.lists(st.integers(0, 6), min_size=1, max_size=10), st.integers(1, 5))
def test_within(sizes, k):
    first = np.r_[0, np.cumsum(sizes)]
    want = [i for lo, hi in zip(first, first[1:], strict=False) for i in range(lo, hi - k + 1)]
    assert core.within(first, k).tolist() == want


def test_fold_and_slices():
    w = core.Words(*core.text_buffer(pa.array(["x", "Ab aB AB é É"]).slice(1)), fold=True)
    h = w.hashes().tolist()
    assert h[0] == h[1] == h[2] and h[3] != h[4]
