"""Plain forms of the pipeline's decisions."""

from collections import Counter, defaultdict


def near_classes(texts):
    """Groups of ids whose five-word shingle sets are linked at similarity 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    common = Counter((a, b) for m in inverted.values() for n, b in enumerate(m) for a in m[:n])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for (a, b), c in common.items():
        if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
            parent[find(a)] = find(b)
    out = defaultdict(set)
    for i in sets:
        out[find(i)].add(i)
    return list(out.values())
