"""The Jaccard join by comparing every pair."""


def shingles(text, width):
    w = (text or "").translate({k: k + 32 for k in range(65, 91)}).split()
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def component_of(texts, percent, width):
    sets = {k: shingles(t, width) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}, {k: len(s) for k, s in sets.items()}
