"""Texts and rows with everything that can go wrong."""

import random

WORDS = "the of and to a in is that dog cat tree house river stone light small long green".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(w + "x" if rng.random() < share else w for w in text.split(" "))


ODD_DOCS = [
    (1, prose(1, 120), "en", "a", 0), (2, None, "en", "a", 0), (3, "", None, None, 0), (4, " \t\n ", "en", None, 0),
    (5, prose(1, 120), "en", "b", 0), (5, prose(1, 120), "en", "b", 0), (None, prose(1, 120), "en", "b", 0), (6, prose(2, 30_000), "en", "c", 0),
    (7, edited(prose(1, 120), 3, 0.01), "de", "c", 0), (8, "one", "xx", "é", 0), (9, "é€😀 x@y.co 1.1.1.1 " * 20, "fr", "😀", 0),
    (10, "word " * 400, "en", "a", 0), (11, "x" * 50_000, "en", "a", 0), (12, "A|B### 4111 1111 1111 1111\n+1 (555) 123-4567\n", "en", "a", 0),
]
