import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerloom.llm import simple8b


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=900))
def test_round_trip(values):
    a = np.array(values, np.uint64)
    words, offsets = simple8b.encode(a)
    assert (simple8b.decode(words, offsets, len(a)) == a).all()
    if len(a):
        assert len(offsets) == -(-len(a) // simple8b.BLOCK)


@pytest.mark.parametrize("values, words", [([0] * 240, 1), ([1] * 60, 1), ([60000] * 3, 1), ([2**63], 2)])
def test_size(values, words):
    assert len(simple8b.encode(np.array(values, np.uint64))[0]) == words
