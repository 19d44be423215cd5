"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_duplicates(docs, width, percent):
    """``{doc_id: (set size, component)}`` of ``{doc_id: text}``; pairs are found by the exact prefix rule."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    counts = {}
    for s in sets.values():
        for x in s:
            counts[x] = counts.get(x, 0) + 1
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index, classes = {}, {}
    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        own = sets[i]
        if not own:
            continue
        if frozenset(own) in classes:
            parent[find(i)] = find(classes[frozenset(own)])
            continue
        classes[frozenset(own)] = i
        rarest = sorted(own, key=lambda x: (counts[x], x))[: len(own) - -(-percent * len(own) // 100) + 1]
        seen = {j for x in rarest for j in index.get(x, ())}
        for j in seen:
            if find(i) != find(j):
                common = len(own & sets[j])
                if 100 * common >= percent * (len(own) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
        for x in rarest:
            index.setdefault(x, []).append(i)
    low = {}
    for i in docs:
        low[find(i)] = min(i, low.get(find(i), i))
    return {i: (len(sets[i]), low[find(i)]) for i in docs}
