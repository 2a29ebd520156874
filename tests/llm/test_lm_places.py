import numpy as np
import pandas as pd
import pytest

from vecloom.llm import interpolated_lm as lm
from vecloom.llm.packed import narrow


def test_places_are_those_in_the_sorted_distinct_keys():
    keys = np.random.default_rng(5).integers(0, 2**64, 300, np.uint64)[np.random.default_rng(6).integers(0, 300, 5000)]
    distinct, place = lm._places(keys)
    want, at = np.unique(keys, return_inverse=True)
    assert distinct == len(want) and (place == at).all()
    assert lm._places(np.array([7], np.uint64))[1].tolist() == [0]


def test_missing_answers_are_an_error():
    """Tokens were given the counts of other tokens, if any."""
    group = pd.DataFrame({"text": [b"a b c a", b"b d"]})
    few = pd.DataFrame([(1, 0, 3, narrow(np.ones(3, np.int64)), narrow(np.zeros(3, np.int64)))],
                       columns=["gram_order", "bucket", "n", "kept", "held"])
    with pytest.raises(ValueError, match="3 answers to 5 questions"):
        list(lm.Counts.of_group(group, few, 1, True, 2, 1000))
