"""Numerical kernels for one group of entities at a time, on NumPy arrays. All are deterministic for a given seed."""

from __future__ import annotations

import heapq

import numpy as np

#: Up to as many nodes eigenvectors come from the dense matrix, beyond from sparse products.
DENSE_NODES = 1024


def kmeans(x: np.ndarray, k: int, seed: int = 42, n_init: int = 10, n_iter: int = 300) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of ``n_init`` runs of Lloyd's algorithm from distance-weighted starts."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    square = (x * x).sum(axis=1)
    best, cost = np.zeros(len(x), int), np.inf
    for _ in range(n_init):
        centre = x[[rng.integers(len(x))]]
        near = ((x - centre[0]) ** 2).sum(axis=1)
        for _ in range(1, k):
            total = near.sum()
            pick = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
            centre = np.vstack((centre, x[pick]))
            near = np.minimum(near, ((x - x[pick]) ** 2).sum(axis=1))
        own = np.full(len(x), -1)
        for _ in range(n_iter):
            d = square[:, None] - 2 * x @ centre.T + (centre * centre).sum(axis=1)
            new = d.argmin(axis=1)
            if (new == own).all():
                break
            own = new
            for c in range(k):
                inside = own == c
                centre[c] = x[inside].mean(axis=0) if inside.any() else x[d.min(axis=1).argmax()]
        inertia = float(((x - centre[own]) ** 2).sum())
        if inertia < cost - 1e-12:
            best, cost = own, inertia
    return best, cost


def adjacency(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    a = np.zeros((n, n))
    a[i, j] = w
    a[j, i] = w
    return a


def spectral_embedding(a: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors of the symmetrically normalised adjacency over the square roots of the degrees; signs by their largest entry."""
    degree = a.sum(axis=1)
    root = np.sqrt(np.where(degree > 0, degree, 1))
    m = a / root[:, None] / root
    m[np.diag_indices(len(m))] += degree == 0
    _, vectors = np.linalg.eigh(m)
    top = vectors[:, ::-1][:, :k] / root[:, None]
    sign = np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    return top * np.where(sign == 0, 1, sign)


def assign_rotation(embedding: np.ndarray, seed: int, n_iter: int = 60) -> np.ndarray:
    """Labels by the rotation that brings the rows closest to indicator vectors (Yu and Shi 2003), alternating assignment and rotation."""
    v = embedding * np.sqrt(len(embedding))
    v = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    k = v.shape[1]
    rng = np.random.default_rng(seed)
    r = np.zeros((k, k))
    r[:, 0] = v[rng.integers(len(v))]
    far = np.zeros(len(v))
    for c in range(1, k):
        far += np.abs(v @ r[:, c - 1])
        r[:, c] = v[far.argmin()]
    last, own = 0.0, np.zeros(len(v), int)
    for _ in range(n_iter):
        own = (v @ r).argmax(axis=1)
        left, sing, right = np.linalg.svd(v.T @ np.eye(k)[own])
        if abs(sing.sum() - last) < 1e-12:
            break
        last = sing.sum()
        r = left @ right
    return own


def assign_pivots(embedding: np.ndarray) -> np.ndarray:
    """Labels by the rows that a column-pivoted QR of the transpose picks and the polar factor of their rows (Damle, Minden and Ying 2019)."""
    rest, picks = embedding.T.copy(), []
    for _ in range(embedding.shape[1]):
        size = (rest * rest).sum(axis=0)
        p = int(size.argmax())
        picks.append(p)
        if size[p] <= 0:
            break
        q = rest[:, p] / np.sqrt(size[p])
        rest -= np.outer(q, q @ rest)
    left, _, right = np.linalg.svd(embedding[picks].T, full_matrices=False)
    return np.abs(embedding @ (left @ right)).argmax(axis=1)


def _labels(embedding: np.ndarray, seed: int, assign: str) -> np.ndarray:
    if assign not in ("kmeans", "discretize", "cluster_qr"):
        raise ValueError(f"unknown assignment {assign}")
    return kmeans(embedding, embedding.shape[1], seed)[0] if assign == "kmeans" else assign_rotation(embedding, seed) if assign == "discretize" else assign_pivots(embedding)


def spectral(a: np.ndarray, k: int, seed: int = 42, assign: str = "kmeans") -> np.ndarray:
    return np.arange(len(a)) if len(a) <= k else _labels(spectral_embedding(a, k), seed, assign)


def _times(i: np.ndarray, j: np.ndarray, w: np.ndarray, x: np.ndarray, part: int = 1 << 18) -> np.ndarray:
    """The product of the symmetric matrix that has each edge once with a dense one, ``part`` edges at a time; no other copy of the edges is made."""
    n, columns = len(x), np.ascontiguousarray(x.T)
    out = np.zeros(columns.shape)
    for lo in range(0, len(i), part):
        a, b, there = (z[lo : lo + part] for z in (i, j, w))
        a, b, back = a.astype(np.intp), b.astype(np.intp), np.where(a == b, 0, there)
        for c, column in enumerate(columns):
            out[c] += np.bincount(a, there * column[b], n)
            out[c] += np.bincount(b, back * column[a], n)
    return out.T


def leading_vectors(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, k: int, seed: int = 42, tol: float = 1e-6, most: int = 500) -> np.ndarray:
    """spectral_embedding() of a graph given by its edges, each once, without an n x n array or a second copy of the edges.

    Restarted block Krylov spaces with Rayleigh-Ritz, until every leading vector's residual is below ``tol``. The block is wider than k, so
    that eigenvalues of higher multiplicity, as of a graph in many parts, are found; what does not settle is an error, never an unsettled result.
    """
    degree = _times(i, j, w, np.ones((n, 1)))[:, 0]
    alone = (degree == 0)[:, None]
    root = np.sqrt(np.where(degree > 0, degree, 1))[:, None]
    times = lambda x: _times(i, j, w, x / root) / root + alone * x
    wide, steps = min(n, k + 8), 12
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, wide)))[0]
    basis = np.empty((n, min(n, wide * (steps + 1))), order="F")
    inner = np.zeros((basis.shape[1],) * 2)  # its upper triangle: what a block's image has in later blocks is what those have in the block
    for _ in range(most):
        lo, hi = 0, wide
        basis[:, :hi] = block
        for step in range(steps + 1):
            new = times(basis[:, lo:hi])
            inner[:hi, lo:hi] = basis[:, :hi].T @ new
            if step == steps:
                break
            size = np.linalg.norm(new, axis=0).max()
            for _ in range(2):
                new = new - basis[:, :hi] @ (basis[:, :hi].T @ new)
            left, sing, _ = np.linalg.svd(new, full_matrices=False)
            left = left[:, sing > 1e-9 * max(size, 1e-300)]
            left = left - basis[:, :hi] @ (basis[:, :hi].T @ left)
            if not left.shape[1] or hi + left.shape[1] > n:
                break
            lo, hi = hi, hi + left.shape[1]
            basis[:, lo:hi] = np.linalg.qr(left)[0]
        value, vector = np.linalg.eigh(inner[:hi, :hi], UPLO="U")
        value, vector = value[::-1][:wide], vector[:, ::-1][:, :wide]
        block = basis[:, :hi] @ vector
        worst = np.linalg.norm(times(block[:, :k]) - block[:, :k] * value[:k], axis=0).max()
        if worst < tol:
            top = block[:, :k] / root
            sign = np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
            return top * np.where(sign == 0, 1, sign)
        block = np.linalg.qr(block)[0]
    raise RuntimeError(f"the {k} leading eigenvectors of {n} nodes did not settle: residual {worst:.1e} after {most} restarts")


def spectral_of_edges(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, ks: list[int], seed: int = 42, assign: str = "kmeans") -> list[np.ndarray]:
    """Labels for each of several numbers of clusters, from one embedding; beyond DENSE_NODES by sparse products, so memory is that of the edges."""
    most = min(max(ks), n)
    e = spectral_embedding(adjacency(n, i, j, w), most) if n <= DENSE_NODES else leading_vectors(n, i, j, w, most, seed)
    return [np.arange(n) if n <= k else _labels(e[:, :k], seed, assign) for k in ks]


def louvain(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 42) -> np.ndarray:
    """Communities by repeated local moves and aggregation while modularity grows; isolated nodes stay alone."""
    rng = np.random.default_rng(seed)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(i.tolist(), j.tolist(), w.tolist(), strict=True):
        links[a][b] = links[a].get(b, 0.0) + x
        links[b][a] = links[b].get(a, 0.0) + x
    loops, member, total = [0.0] * n, np.arange(n), 2 * float(w.sum())
    while total > 0:
        size = len(links)
        degree = [sum(x.values()) + 2 * s for x, s in zip(links, loops, strict=True)]
        com, mass, moved_any, moved = list(range(size)), list(degree), False, True
        while moved:
            moved = False
            for u in rng.permutation(size).tolist():
                own, around = com[u], {}
                for v, x in links[u].items():
                    around[com[v]] = around.get(com[v], 0.0) + x
                mass[own] -= degree[u]
                stay = around.get(own, 0.0) - resolution * mass[own] * degree[u] / total
                best, gain = own, stay
                for c in sorted(around):
                    g = around[c] - resolution * mass[c] * degree[u] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += degree[u]
                if best != own:
                    com[u], moved, moved_any = best, True, True
        if not moved_any:
            break
        _, code = np.unique(com, return_inverse=True)
        member = code[member]
        merged: list[dict[int, float]] = [{} for _ in range(code.max() + 1)]
        inner = [0.0] * len(merged)
        for u in range(size):
            cu = int(code[u])
            inner[cu] += loops[u]
            for v, x in links[u].items():
                cv = int(code[v])
                if cu == cv:
                    inner[cu] += x / 2
                else:
                    merged[cu][cv] = merged[cu].get(cv, 0.0) + x
        links, loops = merged, inner
    return np.unique(member, return_inverse=True)[1]


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of x and y by one product; those that cancellation would blur are taken from the differences."""
    centre = y.mean(axis=0)
    x, y = x - centre, y - centre
    p, q = (x * x).sum(axis=1, keepdims=True), (y * y).sum(axis=1, keepdims=True)
    d = np.hstack((-2 * x, p, np.ones_like(p))) @ np.hstack((y, np.ones_like(q), q)).T
    near = np.flatnonzero(d <= 1e-4 * (p.max(initial=0) + q.max(initial=0)))
    for lo in range(0, len(near), 1 << 16):
        a, b = np.divmod(near[lo : lo + (1 << 16)], len(y))
        d[a, b] = ((x[a] - y[b]) ** 2).sum(axis=1)
    return d


def nearest_pair(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
    """The nearest rows of x, one in left and one in right; the first in these orders at a tie. Blocks of distances only."""
    best = (np.inf, 0, 0)
    for lo in range(0, len(left), 256):
        for at in range(0, len(right), 8192):
            a, b = left[lo : lo + 256], right[at : at + 8192]
            d = squared_distances(x[a], x[b])
            p, q = np.nonzero(d <= d.min() * (1 + 1e-9))
            exact = ((x[a[p]] - x[b[q]]) ** 2).sum(axis=1)
            first = int(np.lexsort((q, p, exact))[0])
            best = min(best, (float(exact[first]), lo + int(p[first]), at + int(q[first])))
    return int(left[best[1]]), int(right[best[2]])


def ward_connected(x: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """Ward agglomeration that merges only neighbours; parts that no edge joins are bridged at their nearest pair of points."""
    n = len(x)
    around: dict[int, set[int]] = {u: set() for u in range(n)}
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if a != b:
            around[a].add(b)
            around[b].add(a)
    part = np.full(n, -1)
    for u in range(n):
        if part[u] < 0:
            stack = [u]
            part[u] = u
            while stack:
                for v in around[stack.pop()]:
                    if part[v] < 0:
                        part[v] = u
                        stack.append(v)
    by = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[by], prepend=-1))
    for lo, hi in list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True))[1:]:
        p, q = nearest_pair(x, by[lo:hi], np.sort(by[:lo]))
        around[p].add(q)
        around[q].add(p)
    size = {u: 1 for u in range(n)}
    mean = {u: x[u] for u in range(n)}
    up = {}
    cost = lambda a, b: size[a] * size[b] / (size[a] + size[b]) * float(((mean[a] - mean[b]) ** 2).sum())
    heap = [(cost(a, b), a, b) for a in around for b in around[a] if a < b]
    heapq.heapify(heap)
    alive, new = n, n
    while alive > k and heap:
        _, a, b = heapq.heappop(heap)
        if a in up or b in up:
            continue
        up[a] = up[b] = new
        size[new] = size[a] + size[b]
        mean[new] = (size[a] * mean[a] + size[b] * mean[b]) / size[new]
        around[new] = {c for c in around.pop(a) | around.pop(b) if c not in up}
        for c in around[new]:
            around[c] -= {a, b}
            around[c].add(new)
            heapq.heappush(heap, (cost(c, new), c, new))
        alive, new = alive - 1, new + 1
    over = list(range(new))
    for u in range(new - 1, -1, -1):  # a merged node's number is above those of its parts
        if u in up:
            over[u] = over[up[u]]
    top = over[:n]
    return np.unique(top, return_inverse=True)[1]


def assignment(gain: np.ndarray) -> np.ndarray:
    """For each column of a square matrix the row it goes to, so that the sum is largest (shortest augmenting paths)."""
    n = len(gain)
    cost = gain.max() - gain.T.astype(float)  # columns take rows
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for c in range(n):
        match[n] = c
        at, least, prev, used = n, np.full(n + 1, np.inf), np.full(n + 1, n), np.zeros(n + 1, bool)
        while match[at] >= 0:
            used[at] = True
            free = np.flatnonzero(~used[:n])
            now = cost[match[at], free] - u[match[at]] - v[free]
            better = now < least[free]
            least[free[better]], prev[free[better]] = now[better], at
            step = free[least[free].argmin()]
            delta = least[step]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            at = step
        while at != n:
            match[at] = match[prev[at]]
            at = prev[at]
    out = np.empty(n, int)
    out[match[:n]] = np.arange(n)
    return out


def align_chain(tables: list[np.ndarray]) -> list[np.ndarray]:
    """From contingency tables of raw labels of neighbouring periods, the type of each raw label in each period: names are handed on by the largest overlap."""
    names = [np.arange(len(tables[0]) if tables else 0)]
    for table in tables:
        known = np.zeros_like(table)
        np.add.at(known, names[-1], table)
        names.append(assignment(known))
    return names
