"""Brute-force versions and small documents that every operator is held against."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null, empty, blank and very long texts, ties, repeated rows."""
    base = prose(120, 1)
    return [
        (0, base), (1, base), (1, base), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "A b C"), (7, "a B c"),
        (8, prose(30_000, 2)), (9, base + " tail"), (10, "x " * 100), (None, base), (None, None), (11, prose(80, 3) + "\n" + base),
    ]


SCHEMA = "doc_id long, text string"


def words(text) -> list[bytes]:
    return (text or "").encode().split()
