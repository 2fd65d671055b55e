"""A hierarchical navigable small-world graph in flat arrays, built and searched many points at a time.

Points are renumbered by falling level, so each level holds a prefix of them and its
neighbours are one array of point numbers, -1 where there is none. Points enter in
growing batches; those of a batch find their neighbours in the graph so far and among
themselves. Inner products become those of vectors of equal length by one more
coordinate, which turns the largest inner product into the nearest point.
"""

from __future__ import annotations

import numpy as np

M, BUILD_WIDTH, EXPANDED = 16, 64, 4


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors of equal length: one more coordinate takes up what is missing to the longest. Scaled against overflow."""
    scaled = vectors / max(float(np.abs(vectors).max()), 1e-300)
    squares = np.einsum("nd,nd->n", scaled, scaled)
    return np.hstack([scaled, np.sqrt(np.maximum(0, squares.max() - squares))[:, None]]).astype(np.float32)


def _beam(points: np.ndarray, near: np.ndarray, targets: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each target the best points met, best first, and their inner products; all targets step together."""
    n_targets = len(targets)
    seen = np.zeros((n_targets, len(near) + 1), bool)  # the last column stands for no point
    seen[:, -1] = True
    rows = np.arange(n_targets)[:, None]
    ids = np.full((n_targets, width), -1, np.int32)
    score = np.full((n_targets, width), -np.inf, np.float32)
    start = entries[:, :width]
    ids[:, : start.shape[1]] = start
    score[:, : start.shape[1]] = np.where(start < 0, -np.inf, np.einsum("bkd,bd->bk", points[start], targets))
    seen[rows, start] = True
    todo = ids >= 0
    live = np.arange(n_targets)
    while len(live):
        open_score = np.where(todo[live], score[live], -np.inf)
        k = min(EXPANDED, width)
        best = np.argpartition(-open_score, k - 1, axis=1)[:, :k]
        usable = np.take_along_axis(open_score, best, 1) > -np.inf
        going = usable.any(axis=1)
        live, best, usable = live[going], best[going], usable[going]
        if not len(live):
            break
        chosen = np.where(usable, np.take_along_axis(ids[live], best, 1), -1)
        todo[live[:, None], best] = False
        found = np.where(chosen[:, :, None] < 0, -1, near[chosen]).reshape(len(live), -1)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[live[:, None], found]] = -1
        seen[live[:, None], found] = True
        value = np.einsum("bkd,bd->bk", points[found], targets[live])
        value[found < 0] = -np.inf
        all_ids, all_score = np.hstack([ids[live], found]), np.hstack([score[live], value])
        all_todo = np.hstack([todo[live], found >= 0])
        keep = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        ids[live], score[live], todo[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_score, all_todo))
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def _select(points: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, those that are nearer to the row's point than to one already taken; then the next best."""
    n, width = ids.shape
    taken, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
    own = points[ids]
    between = np.matmul(own, own.transpose(0, 2, 1))
    for j in range(width):
        shadowed = (taken & (between[:, j] > score[:, j, None])).any(axis=1)
        taken[:, j] = (ids[:, j] >= 0) & ~shadowed & (count < most)
        count += taken[:, j]
    rank = np.where(ids < 0, 2 * width, np.where(taken, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(points: np.ndarray, near: np.ndarray, sources: np.ndarray, most: int) -> None:
    """Each neighbour learns of the point that chose it; full lists are selected anew."""
    to = near[sources].reshape(-1)
    back = np.repeat(sources, near.shape[1])
    valid = to >= 0
    order = np.argsort(to[valid], kind="stable")
    to, back = to[valid][order], back[valid][order]
    targets, begin, counts = np.unique(to, return_index=True, return_counts=True)
    for i in range(0, len(targets), 512):
        own, first, n = targets[i : i + 512], begin[i : i + 512], counts[i : i + 512]
        extra = np.full((len(own), n.max()), -1, np.int32)
        slot = np.arange(n.max()) < n[:, None]
        extra[slot] = back[first[0] : first[0] + n.sum()]
        ids = np.hstack([near[own], extra])
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        score = np.einsum("bkd,bd->bk", points[ids], points[own])
        score[ids < 0] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")[:, : 2 * most]
        near[own] = _select(points, np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1), most)


class Graph:
    """order: the original number of each point; near: neighbours by level, from level 0 up."""

    def __init__(self, points: np.ndarray, order: np.ndarray, near: list[np.ndarray]):
        self.points, self.order, self.near = points, order, near

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        order = np.argsort(-level, kind="stable")
        points = np.vstack([lifted(vectors)[order], np.zeros((1, vectors.shape[1] + 1), np.float32)])  # -1 names the last, a dummy
        graph = cls(points, order, [])
        sizes = [int((level >= i).sum()) for i in range(int(level.max()) + 1)]
        for i in range(len(sizes) - 1, -1, -1):
            graph._add_level(sizes[i], M if i else 2 * M)
        return graph

    def _add_level(self, n: int, most: int) -> None:
        near = np.full((n, most), -1, np.int32)
        upper, done = self.near, 0
        while done < n:
            batch = np.arange(done, min(n, done + max(48, min(256, done // 2))))
            points = self.points[batch]
            inside = points @ points.T
            np.fill_diagonal(inside, -np.inf)
            k = min(len(batch) - 1, BUILD_WIDTH)
            close = np.argsort(-inside, axis=1, kind="stable")[:, :k]
            ids, score = (batch[close].astype(np.int32), np.take_along_axis(inside, close, 1)) if k else (np.full((len(batch), 1), -1, np.int32), np.full((len(batch), 1), -np.inf, np.float32))
            if done:
                entries = np.minimum(self._descend(points, upper), done - 1) if upper else np.zeros((len(batch), 1), np.int32)
                more, value = _beam(self.points, near[:done], points, entries, BUILD_WIDTH)
                ids, score = np.hstack([ids, more]), np.hstack([score, value])
                best = np.argsort(-score, axis=1, kind="stable")[:, :BUILD_WIDTH]
                ids, score = np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1)
            near[batch] = _select(self.points, ids, score, most)
            _link_back(self.points, near, batch, most)
            done += len(batch)
        self.near = [near, *self.near]

    def _descend(self, targets: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Each target's best points in the level above, found from the top down."""
        at = np.zeros((len(targets), 1), np.int32)
        for i in range(len(levels) - 1, -1, -1):
            at = _beam(self.points, levels[i], targets, at, 8)[0]
        return at

    def search(self, targets: np.ndarray, k: int, width: int) -> np.ndarray:
        """Original numbers of the k nearest found for each target, best first; -1 where there are fewer."""
        targets = np.hstack([targets / np.maximum(np.abs(targets).max(axis=1, keepdims=True), 1e-300), np.zeros((len(targets), 1))]).astype(np.float32)
        out = []
        for i in range(0, len(targets), 256):
            own = targets[i : i + 256]
            ids = _beam(self.points, self.near[0], own, self._descend(own, self.near[1:]), max(k, width))[0][:, :k]
            out.append(np.where(ids < 0, -1, np.append(self.order, -1)[ids]))
        return np.vstack(out)
