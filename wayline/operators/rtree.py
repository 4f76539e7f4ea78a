"""A packed R-tree over numpy arrays: bulk loaded by sort-tile-recursive, probed for many boxes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 16


class RTree:
    """Boxes (x0, y0, x1, y1), closed on all sides. Points have x0 == x1 and y0 == y1."""

    def __init__(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray):
        n = len(x0)
        slab = max(1, int(np.ceil(np.sqrt(np.ceil(n / FAN)))) * FAN)
        by_x = np.argsort(x0 + x1, kind="stable")
        order = by_x[np.lexsort(((y0 + y1)[by_x], np.arange(n) // slab))]
        self.order, self.levels = order, [(x0[order], y0[order], x1[order], y1[order])]
        while len(self.levels[-1][0]) > FAN:
            a, b, c, d = self.levels[-1]
            at = np.arange(0, len(a), FAN)
            self.levels.append(
                (np.minimum.reduceat(a, at), np.minimum.reduceat(b, at), np.maximum.reduceat(c, at), np.maximum.reduceat(d, at))
            )

    def probe(self, x0, y0, x1, y1, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (query, box) numbers that meet. At most about `most` candidates are held at a time."""
        todo = [np.arange(len(x0))] if len(self.order) else []
        while todo:
            own = todo.pop()
            if not len(own):
                continue
            if len(own) > 16384:
                todo += [part for part in np.array_split(own, len(own) // 8192)]
                continue
            top = len(self.levels[-1][0])
            q, node = np.repeat(own, top), np.tile(np.arange(top), len(own))
            for k in range(len(self.levels) - 1, -1, -1):
                a, b, c, d = self.levels[k]
                hit = (a[node] <= x1[q]) & (c[node] >= x0[q]) & (b[node] <= y1[q]) & (d[node] >= y0[q])
                q, node = q[hit], node[hit]
                if k == 0:
                    if len(q):
                        yield q, self.order[node]
                    break
                if len(q) * FAN > most and len(own) > 1:
                    todo += [own[: len(own) // 2], own[len(own) // 2 :]]
                    break
                below = len(self.levels[k - 1][0])
                q = np.repeat(q, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                keep = node < below
                q, node = q[keep], node[keep]
