"""The snapping as a literal graph in plain Python: vertices, edges, components, paths."""

from collections import defaultdict


def components(n, edges):
    part = list(range(n))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        part[max(root(a), root(b))] = min(root(a), root(b))
    roots = sorted({root(i) for i in range(n)})
    return [roots.index(root(i)) for i in range(n)]


def snap(points, min_gap, sata_gap, merge, bias):
    """points: {(strand, pos): abund} of one sequence -> {(strand, pos): adj}."""
    out = {}
    for strand in "+-":
        own = sorted((p, a) for (s, p), a in points.items() if s == strand)
        pos, ab = [p for p, _ in own], [a for _, a in own]
        up = (lambda i, j: pos[i] < pos[j]) if strand == "+" else (lambda i, j: pos[i] > pos[j])
        edges = set()
        for i in range(len(pos)):
            for j in range(len(pos)):
                if i != j and abs(pos[i] - pos[j]) <= min_gap:
                    first = up(i, j) if bias == "upstream" else up(j, i)
                    if ab[i] > ab[j] or (ab[i] == ab[j] and first):
                        edges.add((i, j))
        for gap in range(2, sata_gap + 1):
            clus = components(len(pos), edges)
            members = defaultdict(list)
            for i, c in enumerate(clus):
                members[c].append(i)
            new = set()
            for a in members:
                for b in members:
                    if abs(a - b) != 1:
                        continue
                    lo, hi = (a, b) if a < b else (b, a)
                    if pos[min(members[hi])] - pos[max(members[lo])] > gap:
                        continue
                    x, y = members[a], members[b]
                    if min(ab[i] for i in x) >= min(ab[i] for i in y) and sum(ab[i] for i in x) > sum(ab[i] for i in y):
                        new.add((max(x), min(y)) if a < b else (min(x), max(y)))
            edges |= new
        into, outof = defaultdict(set), defaultdict(set)
        for a, b in edges:
            into[b].add(a)
            outof[a].add(b)
        gone = set()
        for i in range(len(pos)):
            if outof[i] or len(into[i]) < 2:
                continue
            far = max(abs(pos[i] - pos[j]) for j in into[i])
            left = [j for j in into[i] if abs(pos[i] - pos[j]) == far]
            light = min(ab[j] for j in left)
            left = [j for j in left if ab[j] == light]
            if len(left) > 1:
                left = [j for j in left if (up(j, i) if bias == "upstream" else up(i, j))]
            gone.add((left[0], i))
        edges -= gone
        targets = {b for _, b in edges}
        sources = [i for i in range(len(pos)) if i not in targets]
        extra = {(i, j) for i in sources for j in sources if i < j and pos[j] - pos[i] <= sata_gap} if merge else set()
        clus = components(len(pos), edges | extra)
        for i in range(len(pos)):
            own_sources = [s for s in sources if clus[s] == clus[i]]
            if merge:
                best = max(own_sources, key=lambda s: (ab[s], -pos[s] if strand == "+" else pos[s]))
            else:
                (best,) = own_sources
            out[strand, pos[i]] = pos[best]
    return out
