import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import textcore


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1cabé日", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_of_steps(texts, limit):
    got = []
    for first, after, data, offsets in textcore.steps(pa.array(texts, pa.string()), limit):
        starts, ends, at = textcore.words(data, offsets)
        raw = data.tobytes()
        for k in range(after - first):
            got.append([raw[s:e] for s, e in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]])])
    assert got == [(t or "").encode().split() for t in texts]


def test_range_hash_is_the_same_wherever_bytes_stand():
    rng = np.random.default_rng(0)
    word = rng.integers(0, 256, 50).astype(np.uint8)
    data = rng.integers(0, 256, 2_500_000).astype(np.uint8)
    places = np.array([0, 4070, 8192, 1_048_550, 2_097_152, 2_499_950])
    for p in places:
        data[p : p + 50] = word
    assert len(set(textcore.RangeHash(data)(places, places + 50).tolist())) == 1
    others = textcore.RangeHash(data)(np.arange(5000), np.arange(5000) + 50)
    assert len(set(others.tolist())) == 5000 - 1  # two of the places are the same bytes


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=40), st.integers(1, 15))
def test_sliding_min(values, width):
    got = textcore.sliding_min(np.array(values, np.uint64), width).tolist()
    assert got == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
