"""Masked tokens: the tables give what the search over single states gives, in time that follows the length."""

import itertools
import time

import numpy as np
import pytest

from webmine.llm import toxicity


@pytest.fixture(scope="module")
def costs():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 40, toxicity._BASE**3) * (rng.random(toxicity._BASE**3) < 0.3)
    return toxicity.trigram_costs(counts)


def by_states(token, costs, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(toxicity, "MASKS", frozenset())
        return toxicity.restore_token(token, costs)


@pytest.mark.parametrize("token", ["f*ck", "*diot", "id*ot", "st#pid", "a**", "**a", "aa*aa", "l**e1", "i*i*i", "*", "ж*ab", "sss*sss", "1*1", "aaaa*"])
def test_tables_equal_single_states(costs, token, monkeypatch):
    assert toxicity.restore_token(token, costs) == by_states(token, costs, monkeypatch)


@pytest.mark.parametrize("token", ["idi0t", "sstt00pid", "m0r0n", "aaab", "1d10t", "$$$", "l11lll"])
def test_tables_equal_single_states_without_masks(costs, token):
    runs = [n for _, run in itertools.groupby(token) for n in [len(list(run))] for _ in range(n)]
    assert toxicity._restore_masked(list(token), runs, costs) == toxicity.restore_token(token, costs)


@pytest.mark.parametrize("token", ["j********@gmail.com", "a" + "*" * 40, "****1234", "#" * 200])
def test_long_masks_are_quick(costs, token):
    toxicity.restore_token("f*ck", costs)
    t = time.time()
    toxicity.restore_token(token, costs)
    assert time.time() - t < 0.01 * max(10, len(token))
