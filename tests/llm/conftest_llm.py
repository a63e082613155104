"""Texts that the tests of several operators share."""

import random


def prose(seed: int, n: int, words=("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "lambda")) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(words) + str(draw.randint(0, 30)) for _ in range(n))


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", "en", "a"), (5, "one two", None, "b"),
    (6, "One TWO three", "en", "a"), (6, "One TWO three", "en", "a"), (7, "one two  three\n", "de", "b"), (None, "no id", "de", "b"),
    (8, prose(1, 300), "en", "a"), (9, prose(1, 300) + " tail", "en", "a"), (10, prose(2, 5000), "de", "c"),
    (11, "é ß 日本 😀 <|endoftext|> x", "de", "c"), (12, "!!! ### 123", "en", "c"), (13, "x" * 3000, "en", "c"), (14, "a\x00b\x1c c", None, "a"),
]
