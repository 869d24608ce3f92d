"""Small in-memory counterparts, written independently of the library, to compare results with."""

from __future__ import annotations

import numpy as np


def mutual_reachability(x, min_samples, metric="euclidean"):
    if metric == "cosine":
        d = 1 - x @ x.T
        d = np.maximum(d, 0)
    else:
        d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min_samples - 1]
    return np.maximum(d, np.maximum(core[:, None], core[None, :]))


def kruskal(w):
    n = len(w)
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    out = []
    for d, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = find(i), find(j)
        if a != b:
            parent[b] = a
            out.append((d, i, j))
    return out


def hdbscan(x, min_samples=2, metric="euclidean", mcs=2):
    """Textbook recursion: single linkage, condensed tree, excess of mass, root never selected."""
    n = len(x)
    edges = kruskal(mutual_reachability(x, min_samples, metric))
    node_of = {i: i for i in range(n)}
    members = {i: [i] for i in range(n)}
    kids, dist, root_of = {}, {}, list(range(n))
    for k, (d, i, j) in enumerate(edges):
        a, b, new = root_of[i], root_of[j], n + k
        kids[new], dist[new] = (a, b), d
        members[new] = members[a] + members[b]
        for m in members[new]:
            root_of[m] = new
    lam = lambda d: np.inf if d <= 0 else 1 / d
    clusters = []  # (birth, rows leaving [(lambda, [points])], children)

    def grow(node, birth):
        me = len(clusters)
        clusters.append({"birth": birth, "leave": [], "kids": [], "points": members[node]})
        while True:
            a, b = kids[node]
            at = lam(dist[node])
            big = [c for c in (a, b) if len(members[c]) >= mcs]
            if len(big) == 2:
                clusters[me]["leave"].append((at, len(members[node])))
                clusters[me]["kids"] = [grow(a, at), grow(b, at)]
                return me
            for c in (a, b):
                if c not in big:
                    clusters[me]["leave"].append((at, len(members[c])))
            if not big:
                return me
            node = big[0]

    import sys

    sys.setrecursionlimit(100000)
    root = n + len(edges) - 1
    grow(root, 0.0)
    with np.errstate(invalid="ignore"):
        for c in clusters:
            c["s"] = sum((at - c["birth"]) * k for at, k in c["leave"])
    chosen = [True] * len(clusters)
    value = [0.0] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):
        c = clusters[i]
        below = sum(value[k] for k in c["kids"])
        if below > c["s"] and not np.isclose(below, c["s"], rtol=1e-12):
            chosen[i], value[i] = False, below
        else:
            value[i] = c["s"]
    chosen[0] = False
    labels = np.full(n, -1)

    def paint(i):
        if chosen[i]:
            labels[clusters[i]["points"]] = i
            return
        for k in clusters[i]["kids"]:
            paint(k)

    paint(0)
    return labels


def canonical(labels):
    """Labels renamed by first appearance, noise kept."""
    seen, out = {}, []
    for v in labels:
        out.append(-1 if v == -1 else seen.setdefault(v, len(seen)))
    return out
