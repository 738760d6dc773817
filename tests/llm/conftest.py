import random

import pytest


@pytest.fixture
def words():
    """A seeded source of pseudo-prose."""

    def make(n: int, seed: int, vocabulary: int = 400) -> str:
        r = random.Random(seed)
        return " ".join("w" + format(r.randrange(vocabulary) * 7919 % 65536, "x") for _ in range(n))

    return make
