"""A robust-pruned directed graph over the unit vectors of one shard (numpy only)."""

from __future__ import annotations

import numpy as np

DEGREE = 32
BEAM = 64
RELAX = 1.2
BATCH = 256

#: Numbers in the distance matrices of a pruning step.
PRUNE_CELLS = 1 << 22
NONE = -1


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries in step: (ids, squared distances) of the ``beam`` nearest seen, nearest first.

    Each step expands the ``wide`` nearest nodes of a query's beam that are not yet expanded. Places that
    nothing fills hold NONE at infinite distance.
    """
    n, q = points.shape[0], queries.shape[0]
    beam = min(beam, n)
    ids = np.full((q, beam), NONE)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    seen[:, entry] = seen[:, n] = True
    live = np.arange(q)
    while live.size:
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argsort(open_, axis=1, kind="stable")[:, :wide]
        real = np.isfinite(np.take_along_axis(open_, pick, axis=1))
        node = np.where(real, np.take_along_axis(ids[live], pick, axis=1), n)
        done[live[:, None], pick] = True
        near = np.where(node[:, :, None] < n, graph[np.minimum(node, n - 1)], n).reshape(live.size, -1)
        near[near < 0] = n
        near.sort(axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        far = 2 - 2 * np.einsum("qd,qrd->qr", queries[live], points[np.minimum(near, n - 1)])
        far = np.where(fresh, np.maximum(far, 0), np.inf)
        all_ids, all_dist = np.concatenate((ids[live], near), axis=1), np.concatenate((dist[live], far), axis=1)
        all_done = np.concatenate((done[live], np.zeros_like(fresh)), axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_dist, best, axis=1)
        done[live] = np.take_along_axis(all_done, best, axis=1) | ~np.isfinite(dist[live])
        live = live[~done[live].all(axis=1)]
    return np.where(np.isfinite(dist), ids, NONE), dist


def robust_prune(points: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Out-neighbours of each node among its candidates: the nearest stays, and candidates that are closer to
    it, relaxed, than to the node go; and so on up to ``degree``."""
    near = np.where(near == own[:, None], NONE, near)
    order = np.sort(near, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = NONE
    vectors = points[np.maximum(order, 0)]
    to_own = np.maximum(2 - 2 * np.einsum("bd,bmd->bm", points[own], vectors), 0)
    to_own[order < 0] = np.inf
    between = np.maximum(2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)), 0) * np.float32(relax**2)
    out = np.full((own.size, degree), NONE)
    left, rows = to_own.copy(), np.arange(own.size)
    for k in range(degree):
        pick = left.argmin(axis=1)
        real = np.isfinite(left[rows, pick])
        if not real.any():
            break
        out[real, k] = order[rows, pick][real]
        left[between[rows, pick] <= to_own] = np.inf
        left[rows, pick] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """The graph as rows of out-neighbours, and the entry node (nearest to the mean).

    Nodes go in in blocks: a greedy search from the entry proposes neighbours, pruning keeps diverse ones,
    and each new edge also proposes its reverse. A node takes reverse edges until its row is full, half as
    many again as ``degree``, and is then pruned. The second pass prunes with the full relaxation.
    """
    n, width = points.shape[0], degree + degree // 2
    rng = np.random.default_rng(1)
    entry = int((points @ points.mean(axis=0)).argmax())
    graph = np.full((n, width), NONE)
    size = np.full(n, min(degree, max(1, n - 1)))
    graph[:, : size[0]] = rng.integers(0, n, (n, size[0]))

    def keep(own: np.ndarray, near: np.ndarray, factor: float) -> None:
        rows = max(1, PRUNE_CELLS // near.shape[1] ** 2)
        for at in range(0, own.size, rows):
            part = own[at : at + rows]
            graph[part, :degree] = robust_prune(points, part, near[at : at + rows], degree, factor)
            graph[part, degree:] = NONE
            size[part] = (graph[part] >= 0).sum(axis=1)

    for factor in (1.0, relax):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            found, _ = beam_search(points, graph, entry, points[own], beam)
            keep(own, np.concatenate((found, graph[own]), axis=1), factor)
            source, target = np.repeat(own, degree), graph[own, :degree].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            head = np.flatnonzero(np.diff(target, prepend=-1))
            many = np.diff(np.append(head, target.size))
            place, nodes = np.arange(target.size) - np.repeat(head, many), target[head]
            fits = np.repeat(size[nodes] + many <= width, many)
            graph[target[fits], size[target[fits]] + place[fits]] = source[fits]
            full = size[nodes] + many > width
            size[nodes[~full]] += many[~full]
            for few in (many <= degree, many > degree):  # rows of like width together
                some = full & few
                if some.any():
                    extra = np.full((int(some.sum()), int(many[some].max())), NONE)
                    edges = np.repeat(some, many)
                    extra[np.repeat(np.arange(extra.shape[0]), many[some]), place[edges]] = source[edges]
                    keep(nodes[some], np.concatenate((graph[nodes[some]], extra), axis=1), factor)
    left = np.flatnonzero(size > degree)
    keep(left, graph[left], relax)
    return graph[:, :degree].astype(np.int32), entry
