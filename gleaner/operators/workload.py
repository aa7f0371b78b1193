"""Random query workloads over a sample of documents, the same for the same seed."""

from __future__ import annotations

import random
from collections.abc import Sequence

from gleaner.functions.text import tokenize

SEED = 42


def phrase(rng: random.Random, words: Sequence[str], most: int) -> str:
    """Two to ``most`` words as they follow each other."""
    n = rng.randint(2, min(most, len(words)))
    at = rng.randrange(len(words) - n + 1)
    return '"' + " ".join(words[at : at + n]) + '"'


def _patterns(rng: random.Random, words: Sequence[str]):
    distinct = sorted(set(words))

    def terms(n: int) -> list[str]:
        return rng.sample(distinct, n)

    def quoted(most: int) -> str:
        return phrase(rng, words, most)

    return [
        lambda: terms(1)[0],
        lambda: " and ".join(terms(2)),
        lambda: " or ".join(terms(rng.choice([2, 3]))),
        lambda: "({} and not {})".format(*terms(2)),
        lambda: "({} and not {}) or {}".format(*terms(3)),
        lambda: quoted(4),
        lambda: "{} and {} and {}".format(*(lambda t: (t[0], quoted(5), t[1]))(terms(2))) if rng.random() < 0.5 else f"{quoted(5)} and {terms(1)[0]}",
        lambda: "{0} and {2} or {1}".format(*terms(2), quoted(5)),
        lambda: "{0} and ({1} or {2})".format(*terms(2), quoted(5)),
        lambda: "{0} and {1} or ({2} and not {3}) and {4}".format(*terms(4), quoted(6)),
    ]


def generate(documents: Sequence[str], count: int, seed: int = SEED) -> list[str]:
    """``count`` queries in ten patterns; documents with fewer than four different tokens are passed over."""
    if count <= 0:
        raise ValueError("count must be positive")
    usable = [w for w in map(tokenize, documents) if len(set(w)) >= 4]
    if not usable:
        raise ValueError("no documents to draw queries from")
    rng = random.Random(seed)
    return [rng.choice(_patterns(rng, rng.choice(usable)))() for _ in range(count)]
