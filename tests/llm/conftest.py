import random

import pytest


@pytest.fixture
def prose():
    """Texts of words from a vocabulary that goes with a seed."""

    def make(seed: int, vocabulary: int = 400):
        rnd = random.Random(seed)
        letters = "abcdefghijklmnopqrstuvwxyzäéß"
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(vocabulary)]
        return rnd, lambda n: " ".join(rnd.choice(words) for _ in range(n))

    return make
