"""Points near other points, and the regions that contain them.

Space is cut into the Voronoi cells of pivots drawn from the points. A point lives in the cell of its nearest pivot and
is also sent to each cell whose pivot is less than twice the radius farther away: by the triangle inequality no pair is
lost. A region is a ball around its box, sent to cells by the same rule with the ball's radius in the place of the join's.
Inside a cell a vantage-point tree answers all radius queries at once. Cells that hold too many points even after their
pivots were refined (many points in one place) are cut into blocks of queries times blocks of data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions.metrics import METRICS
from strataframe.functions.shapes import decode_rings, encode_rings, points_inside
from strataframe.functions.vptree import radius_pairs
from strataframe.plans.workspace import store

QUERY, DATA, REGION, HOME = 1, 2, 4, 8
#: Points that a cell may hold before its size makes blocks of it (some 60 bytes of memory each).
MOST_IN_CELL = 1 << 20
PLACED = "cell int, block int, role int, id bigint, x double, y double, reach double, rings binary"
PAIRS = "relation string, id_a bigint, id_b bigint"


@dataclass(frozen=True)
class Pivots:
    """Cells of a partition: pivot coordinates, and into how many blocks each cell is cut."""

    x: np.ndarray
    y: np.ndarray
    blocks: np.ndarray
    metric: str

    def place(self, x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is home) of every cell that each row must be sent to."""
        far = METRICS[self.metric]
        rows, cells, home = [], [], []
        todo = [(np.arange(len(x)), np.arange(len(self.x)))]
        while todo:
            q, near = todo.pop()
            if not len(q):
                continue
            if len(q) > 32 and len(near) > 8:  # part the rows, and keep the pivots that the triangle inequality allows
                ref = q[len(q) // 2]
                a = q[int(np.argmax(far(x[q], y[q], x[ref], y[ref])))]
                to_a = far(x[q], y[q], x[a], y[a])
                b = q[int(np.argmax(to_a))]
                left = to_a <= far(x[q], y[q], x[b], y[b])
                if not left.all():
                    for half in (q[left], q[~left]):
                        mid = half[len(half) // 2]
                        width = far(x[half], y[half], x[mid], y[mid]).max()
                        to = far(self.x[near], self.y[near], x[mid], y[mid])
                        reached = to <= (to.min() + 2 * (width + max(0.0, reach[half].max()))) * (1 + 1e-9) + 1e-6
                        todo.append((half, near[reached]))
                    continue
            step = max(1, (1 << 21) // len(near))
            for k in range(0, len(q), step):
                s = q[k : k + step]
                d = far(x[s, None], y[s, None], self.x[None, near], self.y[None, near])
                least = d.min(axis=1)
                r, c = np.nonzero(d <= (least + 2 * reach[s] + 1e-6 + 1e-9 * least)[:, None])
                rows.append(s[r])
                cells.append(near[c])
                home.append(c == d.argmin(axis=1)[r])
        return tuple(np.concatenate(v) if v else np.empty(0, "int64") for v in (rows, cells, home))


def choose_pivots(x: np.ndarray, y: np.ndarray, total: int, per_cell: int, most: int, metric: str, seed: int = 0) -> Pivots:
    """Pivots from a sample of the points: first at random, then more in cells that are still too full."""
    rng = np.random.default_rng(seed)
    spots = np.unique(np.stack([x, y], axis=1), axis=0) if len(x) else np.zeros((1, 2))
    want = int(np.clip(-(-total // per_cell), 1, min(most, len(spots))))
    chosen = spots[rng.permutation(len(spots))[:want]]
    share = np.ones(1)
    for _ in range(4):
        cells = Pivots(chosen[:, 0], chosen[:, 1], np.ones(len(chosen), "int64"), metric).place(x, y, np.zeros(len(x)))
        home = np.zeros(len(x), "int64")
        home[cells[0][cells[2]]] = cells[1][cells[2]]
        share = np.bincount(home, minlength=len(chosen)) / max(1, len(x))
        crowded = np.flatnonzero(share * total > 2 * per_cell)
        more = []
        for c in crowded:
            inside = np.unique(np.stack([x[home == c], y[home == c]], axis=1), axis=0)
            if len(inside) > 1:
                more.append(inside[rng.permutation(len(inside))[: int(share[c] * total / per_cell)]])
        if not more or len(chosen) >= most:
            break
        extra = np.concatenate(more)
        chosen = np.unique(np.concatenate([chosen, extra[rng.permutation(len(extra))[: most - len(chosen)]]]), axis=0)
    if len(share) != len(chosen):
        cells = Pivots(chosen[:, 0], chosen[:, 1], np.ones(len(chosen), "int64"), metric).place(x, y, np.zeros(len(x)))
        share = np.bincount(cells[1][cells[2]], minlength=len(chosen)) / max(1, len(x))
    blocks = np.maximum(1, np.ceil(share * total / (4 * per_cell))).astype("int64")
    return Pivots(chosen[:, 0], chosen[:, 1], blocks, metric)


def _send_points(pivots: Pivots, radius: float):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            row, cell, home = pivots.place(x, y, np.full(len(x), radius))
            n = pivots.blocks[cell]
            mine = ids[row] % n
            out = []
            whole = n == 1
            out.append((row[whole], cell[whole], np.zeros(int(whole.sum()), "int64"), np.where(home[whole], QUERY | DATA | HOME, DATA)))
            cut = np.flatnonzero(~whole)
            if len(cut):  # data go to their block column, homes also as queries to their block row
                for as_query in (False, True):
                    pick = cut[home[cut]] if as_query else cut
                    times = np.repeat(pick, n[pick])
                    other = np.concatenate([np.arange(k) for k in n[pick]]) if len(pick) else np.empty(0, "int64")
                    block = mine[times] * n[times] + other if as_query else other * n[times] + mine[times]
                    out.append((row[times], cell[times], block, np.where(other == mine[times], QUERY | HOME, QUERY) if as_query else np.full(len(times), DATA)))
            row, cell, block, role = (np.concatenate([o[k] for o in out]) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(role, pa.int32()), pa.array(ids[row]), pa.array(x[row]), pa.array(y[row]), pa.array(np.zeros(len(row))), pa.nulls(len(row), pa.binary())],
                names=["cell", "block", "role", "id", "x", "y", "reach", "rings"],
            )

    return send


def _vertices(ring: list[dict]) -> np.ndarray:
    xy = np.array([(v["x"], v["y"]) for v in ring if v and v["x"] is not None and v["y"] is not None], dtype="float64").reshape(-1, 2)
    return xy[np.isfinite(xy).all(axis=1)]


def _send_regions(pivots: Pivots):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for fid, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rings = [[_vertices(ring) for ring in part or [] if ring] for part in parts]
                vertices = [r for part in rings for r in part if len(r)]
                if not vertices:
                    continue
                xy = np.concatenate(vertices)
                cx, cy = (xy.min(axis=0) + xy.max(axis=0)) / 2
                reach = METRICS[pivots.metric](xy[:, 0], xy[:, 1], cx, cy).max()
                cells.append((int(fid), cx, cy, reach, encode_rings(rings)))
            if not cells:
                continue
            ids, cx, cy, reach = (np.array([c[k] for c in cells], dtype=t) for k, t in enumerate(("int64", "float64", "float64", "float64")))
            row, cell, _ = pivots.place(cx, cy, reach)
            n = pivots.blocks[cell]
            times = np.repeat(np.arange(len(row)), n)  # the home points of a cut cell lie in its diagonal blocks
            block = np.concatenate([np.arange(k) * (k + 1) for k in n]) if len(n) else np.empty(0, "int64")
            row, cell = row[times], cell[times]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(np.full(len(row), REGION), pa.int32()), pa.array(ids[row], pa.int64()), pa.array(cx[row]), pa.array(cy[row]), pa.array(reach[row]), pa.array([cells[k][4] for k in row], pa.binary())],
                names=["cell", "block", "role", "id", "x", "y", "reach", "rings"],
            )

    return send


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block of one cell after the other; batches come sorted by both."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(cell)], strict=True):
            mine = (int(cell[a]), int(block[a]))
            if held and mine != key:
                yield pa.Table.from_batches(held)
                held = []
            key = mine
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _join_cells(radius: float, metric: str):
    def pairs(relation: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([relation] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["relation", "id_a", "id_b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            role, ids, x, y, reach = (cell.column(k).to_numpy() for k in (2, 3, 4, 5, 6))
            query, data = np.flatnonzero(role & QUERY), np.flatnonzero(role & DATA)
            for q, d in radius_pairs(x[query], y[query], radius, x[data], y[data], metric):
                a, b = ids[query[q]], ids[data[d]]
                first = a < b  # the pair is also found from the other point
                if first.any():
                    yield pairs("near", a[first], b[first])
            region, seen = np.flatnonzero(role & REGION), np.flatnonzero(role & HOME)
            if len(region) and len(seen):
                shapes = cell.column("rings")
                hits: dict[int, list[np.ndarray]] = {}
                for q, d in radius_pairs(x[region], y[region], reach[region] * (1 + 1e-9) + 1e-9, x[seen], y[seen], metric):
                    order = np.argsort(q, kind="stable")
                    q, d = q[order], d[order]
                    for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                        hits.setdefault(int(q[part[0]]), []).append(d[part])
                for q, found in hits.items():
                    spot = seen[np.concatenate(found)]
                    inside = spot[points_inside(x[spot], y[spot], decode_rings(shapes[int(region[q])].as_py()))]
                    if len(inside):
                        yield pairs("inside", np.full(len(inside), ids[region[q]]), ids[inside])

    return join


def near_pairs(
    points: DataFrame, radius: float, regions: DataFrame | None = None, *, metric: str = "plane", per_cell: int = 8192,
    most_pivots: int = 1 << 17, seed: int = 0,
) -> DataFrame:
    """All pairs of points at most ``radius`` apart and, with ``regions``, all (region, point) pairs where it holds the point.

    ``points`` has ``id, x, y``; ``regions`` has ``id`` and ``parts`` (polygons, each an array of rings, the outer ring
    first, each an array of x, y). Other columns are ignored. The result is ``relation, id_a, id_b``: 'near' with
    ``id_a < id_b`` once per pair, 'inside' with the region as ``id_a``. Rows without an id or with a null or non-finite
    coordinate have no place and take no part; ids must be unique (repeated ids pair up like different points of the
    same id would: never with each other). Rings may be open or closed and turn either way; null, empty or degenerate
    parts hold nothing. Empty tables give no rows. ``metric`` is 'plane' or 'great_circle' (x, y in degrees, metres).

    There is a pivot for every ``per_cell`` points. Beyond ``most_pivots`` of them, which are sent to all tasks, cells grow
    instead, as their trees take any number of points, up to ``MOST_IN_CELL``; only then are cells cut into blocks for
    their size. Pivots come from a sample of eight points for each, at least 50,000. Points and pairs are streamed by cell.
    """
    spark = points.sparkSession
    placed = points.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    placed = placed.where("id IS NOT NULL AND abs(x) < double('Infinity') AND abs(y) < double('Infinity')")
    placed = store(placed, "points")
    total = placed.count()
    per_cell = max(per_cell, min(MOST_IN_CELL, -(-total // most_pivots)))
    rows = max(50_000, 8 * min(most_pivots, total // per_cell))
    drawn = placed.select("x", "y").sample(min(1.0, rows / max(1, total)), seed=seed).limit(2 * rows).toPandas()
    pivots = choose_pivots(drawn.x.to_numpy(), drawn.y.to_numpy(), total, per_cell, most_pivots, metric, seed)
    sent = placed.mapInArrow(_send_points(pivots, float(radius)), PLACED)
    if regions is not None:
        shapes = regions.select(F.col("id").cast("bigint").alias("id"), "parts").where("id IS NOT NULL AND parts IS NOT NULL")
        sent = sent.unionAll(shapes.mapInArrow(_send_regions(pivots), PLACED))
    tasks = int(np.clip(pivots.blocks.dot(pivots.blocks), 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 100_000)))
    spread = sent.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block")
    return spread.mapInArrow(_join_cells(float(radius), metric), PAIRS)
