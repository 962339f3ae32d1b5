"""Plain versions of the operators, for small tables."""

import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def cut_words(rows):
    """{(doc_id, text): (n_words, n_removed, kept words)}"""
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            if d is not None:
                z = tuple(w[k : k + 13])
                first[z] = min(first.get(z, d), d)
    out = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if d is not None and first[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        out[d, t] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def linked(rows):
    """{doc_id: smallest linked doc_id} over rows with an id."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for z in s:
            by_shingle[z].append(k)
    shared = defaultdict(int)
    for ks in by_shingle.values():
        for i in ks:
            for j in ks:
                if i < j:
                    shared[i, j] += 1
    for (i, j), n in shared.items():
        if 100 * n >= 75 * (len(sets[i][1]) + len(sets[j][1]) - n):
            a, b = root(sets[i][0]), root(sets[j][0])
            parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in parent}
