import random

import pytest

WORDS = [a + b for a in "bcdfgmnprst" for b in ("a", "e", "o", "al", "in")]


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n seeded words."""

    def make(n, seed=0):
        rng = random.Random(seed)
        return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]

    return make
