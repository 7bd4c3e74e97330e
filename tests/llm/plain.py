"""Plain Python versions of the operators, for small tables."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def roots(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def jaccard_components(texts):
    """Component of each id of a dictionary of texts."""
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), r) for i, r in roots(sets, links).items()}


def edit_distance(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéü"
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return [rng.choice(stock) for _ in range(words)]


def edited(words, count, seed):
    rng, out = random.Random(seed), list(words)
    for _ in range(count):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out
