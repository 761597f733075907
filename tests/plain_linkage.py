"""Hierarchical clustering of a whole matrix, merge by merge, and its cut."""

import numpy as np


def linkage(distance: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size); a merge gets the next free number, like the leaves before it."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        k = int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf)))
        i, j = sorted(divmod(k, n))
        out.append((*sorted((ids[i], ids[j])), float(d[i, j]), size[i] + size[j]))
        if method == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            row = (np.minimum if method == "single" else np.maximum)(d[i], d[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        alive[j] = False
        ids[i], size[i] = n + step, size[i] + size[j]
    return out


def cut(merges: list[tuple[int, int, float, int]], n: int, limit: float) -> list[int]:
    """1-based groups of the leaves after all merges up to ``limit``, numbered by their first leaf."""
    parent = list(range(n + len(merges)))
    for step, (a, b, d, _) in enumerate(merges):
        if d <= limit:
            parent[a] = parent[b] = n + step

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    seen: dict[int, int] = {}
    return [seen.setdefault(root(k), len(seen) + 1) for k in range(n)]
