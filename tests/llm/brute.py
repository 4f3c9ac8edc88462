"""Plain versions of the operators, for small tables."""

from __future__ import annotations


def jaccard_components(rows, n, percent):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        k = min(n, len(words))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
    parent = {doc: doc for doc in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), root(doc)) for doc in docs}
