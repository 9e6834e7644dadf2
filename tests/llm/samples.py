"""Texts for the tests."""

import random


def prose(seed, words=80, lines=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    out = [rng.choice(vocabulary) for _ in range(words)]
    cuts = sorted(rng.sample(range(1, words), lines - 1))
    return "".join(w + (".\n" if i + 1 in cuts else " ") for i, w in enumerate(out)).strip() + "."


EDGES = [
    (1, None, None), (2, "", None), (3, " \t\n ", "en"), (4, "word", "en"), (5, "word", "en"), (6, "Ünïcödé ñandú \U0001f600 x", "es"),
    (7, prose(1), "en"), (7, prose(1), "en"), (8, prose(1) + " more words at the end", "en"), (9, "la " * 40000, "fr"),
    (10, prose(2, 30000, 200), "de"), (11, "x" * 50000, "en"), (None, prose(3), "en"), (12, "1234 5678 !!! ###", None),
    (13, "password = hunter2xyz", "en"), (-5, prose(4), "fr"),
]
