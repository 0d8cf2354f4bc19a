"""Plain versions of the operators for small tables."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_documents(docs, k, percent):
    """docs: [(doc_id, text)], ids distinct -> {doc_id: (n, component)}."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    ids = sorted(sets)
    edges = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    edges.append((a, b))
    roots = closure(ids, edges)
    return {i: (len(sets[i]), roots[i]) for i in ids}


def near_vectors(rows, cosine):
    """rows: [(vec_id, list)], ids distinct -> {vec_id: (links, component)}."""
    good = {}
    for i, v in rows:
        if v and not any(x is None for x in v):
            v = np.array(v, float)
            if np.isfinite(v).all() and v.any():
                good[i] = v
    ids = sorted(good)
    edges = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if len(good[a]) == len(good[b]) and good[a] @ good[b] / (np.sqrt(good[a] @ good[a]) * np.sqrt(good[b] @ good[b])) >= cosine
    ]
    roots = closure([i for i, _ in rows], edges)
    links = {i: 0 for i, _ in rows}
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    return {i: (links[i], roots[i]) for i, _ in rows}


def overlaps(docs, items, span, stride, spare, least):
    """{doc_id: set of item_ids} with a window that agrees in all but `spare` (a fifth) words."""
    out = {}
    cut = []
    for i, t in items:
        w = words(t)
        if len(w) < least:
            continue
        s = min(span, len(w))
        cut += [(i, tuple(w[p : p + s])) for p in sorted({*range(0, len(w) - s + 1, stride), len(w) - s})]
    owner = {}
    for i, w in cut:
        owner[w] = min(i, owner.get(w, i))
    for d, t in docs:
        w = words(t)
        for window, i in owner.items():
            s = len(window)
            need = s - min(spare, s // 5)
            for p in range(len(w) - s + 1):
                if sum(x == y for x, y in zip(window, w[p : p + s])) >= need:
                    out.setdefault(d, set()).add(i)
                    break
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def sha(data):
    return hashlib.sha256(data).hexdigest()
