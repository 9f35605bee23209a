"""Similarities of many pairs at a time equal those of one pair."""

import random

import numpy as np
import pytest

from tessera.functions import similarity as S


def pairs():
    r = random.Random(8)
    text = lambda: "".join(r.choice("ab cdé\0 ") for _ in range(r.choice([0, 1, 2, 3, 7, 12, 20, 31, 32, 33, 63, 64, 65, 90])))
    made = [(text(), text()) for _ in range(1500)]
    words = "alpha beta gamma inc llc www.x.com é 12".split()
    made += [(" ".join(r.choices(words, k=r.randint(1, 6))), " ".join(r.choices(words, k=r.randint(1, 6)))) for _ in range(1500)]
    return made + [(a, a) for a, _ in made[:200]] + [(a, a[1:] + a[:1]) for a, _ in made[-200:]]


@pytest.mark.parametrize("name", ["ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "jaro_winkler"])
def test_many_pairs_equal_one(name):
    a, b = map(list, zip(*pairs(), strict=True))
    one = getattr(S, name)
    assert np.array_equal(S._many(one, getattr(S, f"_{name}s"), a, b), [one(x, y) for x, y in zip(a, b, strict=True)])
