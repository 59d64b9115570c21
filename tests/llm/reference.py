"""Plain forms of the operators, for small inputs."""

import collections
import hashlib
import re


def kept_words(rows, length=13):
    """(n_words, n_removed, digest) of each document by comparing all windows."""
    texts = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d in sorted(texts):
        w = texts[d]
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def similar_components(rows, n=4, num=85, den=100):
    """(n_shingles, component) of each document by comparing all pairs of distinct sets."""
    sets = {d: shingle_set(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    same = collections.defaultdict(list)
    for d in sorted(sets):
        if sets[d]:
            same[sets[d]].append(d)
    for group in same.values():
        for d in group[1:]:
            parent[d] = group[0]
    distinct = [g[0] for g in same.values()]
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            x, y = sets[a], sets[b]
            if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                continue
            shared = len(x & y)
            if den * shared >= num * (len(x) + len(y) - shared):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in sets}


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrase_places(text, phrases):
    words = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), sorted({label for _, label in found})


def edit_distance_within(item, text):
    """Least edit distance of item to any part of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best
