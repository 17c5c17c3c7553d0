"""Brute-force versions of the operators on whole texts."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_repeats(rows, length):
    """(doc_id, kept words) of each row."""
    lowest = {}
    for doc, text, *_ in rows:
        own = words(text)
        for i in range(len(own) - length + 1):
            if doc is not None:
                key = tuple(own[i : i + length])
                lowest[key] = min(lowest.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        own = words(text)
        gone = {j for i in range(len(own) - length + 1) if doc is not None and lowest[tuple(own[i : i + length])] < doc for j in range(i, i + length)}
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return Counter(out)


def brute_components(rows, shingle, percent):
    sets = []
    for doc, text, *_ in rows:
        own = words(low(text))
        sets.append((doc, {tuple(own[i : i + shingle]) for i in range(len(own) - shingle + 1)} or ({tuple(own)} if own else set())))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        (d, a), (e, b) = sets[i], sets[j]
        if a and b and d is not None and e is not None and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    reach = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        reach[find(i)].append(d)
    return Counter((d, len(s), min((x for x in reach[find(i)] if x is not None), default=None)) for i, (d, s) in enumerate(sets))
