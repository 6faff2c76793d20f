"""Radius joins inside one partition with a vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from strataframe.functions.metrics import METRICS

#: Data rows of a leaf, and cells of the largest distance matrix.
LEAF, BLOCK = 48, 1 << 21


def radius_pairs(qx, qy, radius, dx, dy, metric: str = "plane") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, data) at most ``radius`` (one number per query) apart, in chunks.

    The tree is split while the queries descend: at each vantage point the data part at the median distance, and a query
    goes to a side unless the triangle inequality rules that side out. Metrics must obey the triangle inequality.
    """
    far = METRICS[metric]
    qx, qy, dx, dy = (np.asarray(v, dtype="float64") for v in (qx, qy, dx, dy))
    radius = np.broadcast_to(np.asarray(radius, dtype="float64"), qx.shape)
    slack = 1e-9 * (1.0 + float(max(np.abs(dx).max(initial=0), np.abs(dy).max(initial=0), radius.max(initial=0))))
    if metric == "great_circle":
        slack = 1e-3
    todo = [(np.arange(len(qx)), np.arange(len(dx)))]
    while todo:
        q, d = todo.pop()
        if not len(q) or not len(d):
            continue
        inner = None
        if len(d) > LEAF:
            ref = d[len(d) // 2]
            v = d[int(np.argmax(far(dx[d], dy[d], dx[ref], dy[ref])))]
            dist = far(dx[d], dy[d], dx[v], dy[v])
            mu = float(np.median(dist))
            inner = dist <= mu
            if inner.all():  # all at one distance: nothing to split
                inner = dist < mu
                inner = inner if inner.any() else None
        if inner is None:
            step = max(1, BLOCK // len(d))
            for k in range(0, len(q), step):
                part = q[k : k + step]
                hit = far(qx[part, None], qy[part, None], dx[None, d], dy[None, d]) <= radius[part, None]
                a, b = np.nonzero(hit)
                if len(a):
                    yield part[a], d[b]
            continue
        to = far(qx[q], qy[q], dx[v], dy[v])
        edge = dist[inner].max(), dist[~inner].min()
        todo.append((q[to <= edge[0] + radius[q] + slack], d[inner]))
        todo.append((q[to >= edge[1] - radius[q] - slack], d[~inner]))
