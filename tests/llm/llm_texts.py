"""Texts for the tests of this folder."""

import random


def prose(rng, n, words=("alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu")):
    return " ".join(f"{rng.choice(words)}{rng.randrange(40)}" for _ in range(n))


def messy_texts():
    """Texts with copies, near copies, empties, nulls, odd white space and one very long word."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(5, 120)) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split()
        for _ in range(3):
            x = list(w)
            for _ in range(max(1, len(x) // 60)):
                x[rng.randrange(len(x))] = "changed"
            near.append(" ".join(x))
    return base + near + base[:5] + [t.upper() for t in base[5:8]] + ["", None, " \t\n ", "one", "one", "ONE two", "x" * 30000, "\x0b a\x0cb\rc  d é ü 漢字 🙂", base[0] + "\n" + base[1]]
