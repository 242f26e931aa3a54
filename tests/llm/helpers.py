"""Plain Python versions of the operators, and rows with the awkward cases."""

from __future__ import annotations

import random
from itertools import combinations

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ta", "ve", "xi", "zo", "b", "d", "f")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=1, n=40):
    """Random texts, exact and near copies, shared lines, odd cases (nulls, empty, long)."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 90)) for _ in range(n)]
    texts = list(base)
    for t in base[:8]:
        w = t.split()
        texts.append(t)
        for _ in range(5):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            texts.append(" ".join(v))
    texts += ["", "  \n", "one two", "ONE  two", "one two three four five", "naïve café 東京 🙂", "x" * 5000, sentence(rng, 4000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(len(rows), None), (3, texts[3]), (None, texts[2])]


def shingles(text):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(sets, links)
