"""Plain Python forms of the operators, for comparison."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def near_duplicates(rows, size=4, num=80, den=100):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = [(k, shingle_set(t, size)) for k, t in rows]
    links = []
    for (a, x), (b, y) in combinations([(k, s) for k, s in sets if k is not None and s], 2):
        if den * len(x & y) >= num * len(x | y):
            links.append((a, b))
    group = components({k for k, s in sets if k is not None}, links)
    out = []
    for k, s in sets:
        c = None if k is None else group[k] if s else k
        out.append((k, len(s), c, True if k is None else k == c))
    return out
