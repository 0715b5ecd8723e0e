"""Plain versions of the operators, over lists of rows."""

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrase(seed, n=120):
    """n made-up words."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_duplicates(rows, threshold=0.8):
    """rows of (key, id, text): {key: (class id, links)}."""
    sets = {k: shingles(t) for k, _, t in rows}
    ids = {k: i for k, i, _ in rows}
    at, shared = defaultdict(list), defaultdict(int)
    for k, s in sets.items():
        for g in s:
            at[g].append(k)
    for keys in at.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                shared[b, a] += 1
    root, links = {k: k for k in sets}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k in sets:
        r = find(k)
        least[r] = min(least.get(r, ids[k]), ids[k])
    return {k: (least[find(k)], links[k]) for k in sets}


def contamination(texts, items, size=10):
    """texts: {key: text}; items: [(id, text)]: {key: (words, words hit, sorted item ids)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    lengths, out = {len(w) for w in windows}, {}
    for key, text in texts.items():
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[key] = (len(w), len(hit), sorted(found))
    return out
