"""Brute-force results that several tests compare with."""

import re
from itertools import combinations

NULL = -(2**63)


def key(i):
    return NULL if i is None else i


def words(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = data.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return re.findall(rb"[^\x20\x09-\x0D]+", data)


def jaccard_brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        grams = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(key(i), []).append(frozenset(grams))
    label = {i: i for i in sets}
    pairs = []
    for (i, a), (j, b) in combinations([(i, s) for i, group in sets.items() for s in group], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            pairs.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return {(None if i == NULL else i, len(s), None if label[i] == NULL else label[i]) for i, group in sets.items() for s in group}
