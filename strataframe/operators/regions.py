"""Connected regions of equal value: labels, and polygons of their outlines.

Cells are labelled inside tiles first; what meets across the seams of tiles is a graph of far fewer nodes, whose
components come from repeated joins of each label with the least label it is linked to, and doubling of these links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.raster import Raster
from strataframe.plans.workspace import discard, store

TILE = 256


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, component`` (the least id reached) of an undirected graph with columns ``a, b``, nodes ``id``.

    In each round every node takes the least component of its neighbours, then the component of its component.
    """
    both = store(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = store(nodes.select("id", F.col("id").alias("component")), "components")
    while True:
        near = both.join(state, both.b == state.id).groupBy("a").agg(F.min("component").alias("least"))
        lower = state.join(near, state.id == near.a, "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = lower.select(F.col("id").alias("j"), F.col("component").alias("far"))
        after = store(lower.join(jump, lower.component == F.col("j")).select("id", "was", F.least("component", "far").alias("component")), "components")
        moved = not after.where("component < was").isEmpty()
        discard(state)
        state = after
        if not moved:
            return state.select("id", "component")


def _label(height: int, width: int, size: int, connectivity: int):
    steps = [(-1, 0), (0, -1)] + ([(-1, -1), (-1, 1)] if connectivity == 8 else [])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, v = pdf.row.to_numpy(), pdf.col.to_numpy(), pdf.value.to_numpy()
        r0, c0 = r.min(), c.min()
        grid = np.full((r.max() - r0 + 3, c.max() - c0 + 3), -1, "int64")
        grid[r - r0 + 1, c - c0 + 1] = np.arange(len(r))
        links = []
        for dr, dc in steps:
            other = grid[r - r0 + 1 + dr, c - c0 + 1 + dc]
            hit = np.flatnonzero((other >= 0) & (v[other] == v))
            links.append(np.stack([hit, other[hit]]))
        roots = linked(len(r), *np.concatenate(links, axis=1))
        gid = r.astype("int64") * width + c
        least = np.full(len(r), np.iinfo("int64").max)
        np.minimum.at(least, roots, gid)
        return pd.DataFrame({"band": pdf.band, "row": r, "col": c, "value": v, "label": least[roots]})

    return label


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A root of each of ``n`` things that links (a, b) connect: the higher of two roots takes the lower one, then all look at their root's root."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while ((up := parent[parent]) != parent).any():
            parent = up
    return parent


def label_regions(raster: Raster, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """``band, row, col, value, component``: the least row-major cell number of each region of valid, equal, linked cells."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    height, width = raster.grid.shape
    tiled = raster.df.where("value IS NOT NULL").select("band", "row", "col", F.col("value").cast("double").alias("value"), F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    labels = store(tiled.groupBy("band", "tr", "tc").applyInPandas(_label(height, width, tile, connectivity), "band int, row int, col int, value double, label bigint"), "labels")
    key = F.col("band").cast("bigint") * (height * width) + F.col("label")
    keyed = labels.withColumn("id", key)
    rim = keyed.where((F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    sent = rim.select("band", "value", F.col("id").alias("a"), F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in steps])).alias("n")).select("band", "value", "a", "n.row", "n.col")
    edges = sent.join(rim.select("band", "row", "col", "value", F.col("id").alias("b")), ["band", "row", "col", "value"]).where("a <> b").select("a", "b").distinct()
    found = components(edges, keyed.select("id").distinct())
    return keyed.join(found, "id").select("band", "row", "col", "value", F.pmod("component", F.lit(height * width)).alias("component"))


def select_targets(raster: Raster, target: str | float | tuple[float, float] | list[float] = "all") -> Raster:
    """Only cells that equal the target, one of a list, or lie in a range (ends included)."""
    v = F.col("value")
    keep = F.lit(True) if target == "all" else (v >= target[0]) & (v <= target[1]) if isinstance(target, tuple) else v.isin(target) if isinstance(target, list) else v == target
    return raster.with_value(F.when(keep, v))


def snapped(raster: Raster, tolerance: float = 0.1) -> Raster:
    """Values at the nearest multiple of the tolerance, so that nearly equal ones belong together."""
    return raster.with_value(F.rint(F.col("value") / tolerance) * tolerance)


def rings_of(edges: dict[tuple[int, int], list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Closed rings of directed edges between corners, corners on straight lines left out."""
    rings = []
    while edges:
        start = min(edges)
        ring, at, came = [start], start, None
        while True:
            options = edges[at]
            step = options[0]
            if len(options) > 1 and came is not None:  # at a corner where two cells touch, stay with the own cell
                right = (came[1], -came[0])
                step = next((o for o in options if (o[0] - at[0], o[1] - at[1]) == right), options[0])
            options.remove(step)
            if not options:
                del edges[at]
            way = (step[0] > at[0]) - (step[0] < at[0]), (step[1] > at[1]) - (step[1] < at[1])
            if came == way:
                ring[-1] = step
            else:
                ring.append(step)
            came, at = way, step
            if at == start:
                break
        rings.append(ring)
    return rings


def _outline(transform: tuple[float, ...]):
    a, b, c, d, e, f = transform

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r0, c0, r1, c1 in zip(*(pdf[k].tolist() for k in ("r0", "c0", "r1", "c1")), strict=True):
            after.setdefault((r0, c0), []).append((r1, c1))
        rings = rings_of(after)
        size = [sum(p[1] * q[0] - q[1] * p[0] for p, q in zip(r, r[1:], strict=False)) for r in rings]
        order = sorted(range(len(rings)), key=lambda k: -abs(size[k]))
        part = [[{"x": a * k + b * r + c, "y": d * k + e * r + f} for r, k in rings[n]] for n in order]
        return pd.DataFrame([{"component": int(pdf.component.iloc[0]), "raster_value": float(pdf.value.iloc[0]), "geom": {"type": "Polygon", "parts": [part]}}])

    return outline


def boundary_edges(labels: DataFrame) -> DataFrame:
    """``component, value, r0, c0, r1, c1``: the sides of cells beyond which another region lies, the cell on their right."""
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    same = lambda move, axis, step, w: F.coalesce((move("component").over(w) == F.col("component")) & (move(axis).over(w) == F.col(axis) + step), F.lit(False))
    sides = labels.select("component", "value", "row", "col", same(F.lag, "col", -1, across).alias("_l"), same(F.lead, "col", 1, across).alias("_r"))
    sides = sides.select("*", same(F.lag, "row", -1, down).alias("_u"), same(F.lead, "row", 1, down).alias("_d")).where("NOT (_l AND _r AND _u AND _d)")
    corner = lambda flag, *ends: F.when(~F.col(flag), F.struct(*[(F.col("row" if k % 2 == 0 else "col") + v).alias(n) for k, (n, v) in enumerate(zip(("r0", "c0", "r1", "c1"), ends, strict=True))]))
    edges = F.array_compact(F.array(corner("_u", 0, 0, 0, 1), corner("_r", 0, 1, 1, 1), corner("_d", 1, 1, 1, 0), corner("_l", 1, 0, 0, 0)))
    return sides.select("component", "value", F.explode(edges).alias("e")).select("component", "value", "e.*")


def polygonize(raster: Raster, target: str | float | tuple | list = "all", connectivity: int = 4, band: int = 1) -> DataFrame:
    """One polygon per region: ``component, raster_value, n_cells, geom``, the outer ring first, then holes.

    Only the sides of cells on a region's rim are gathered, all of one region in one task.
    """
    one = Raster(raster.df.where(F.col("band") == band), raster.grid)
    labels = store(label_regions(select_targets(one, target), connectivity), "regions")
    schema = "component bigint, raster_value double, geom struct<type: string, parts: array<array<array<struct<x: double, y: double>>>>>"
    shapes = boundary_edges(labels).groupBy("component").applyInPandas(_outline(raster.grid.transform), schema)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_cells"))
    return shapes.join(sizes, "component").select("component", "raster_value", "n_cells", "geom")
