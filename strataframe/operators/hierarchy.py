"""Parent-child links to full hierarchies by pointer doubling.

Nodes without children only need what their parent gets, so the doubling runs over the inner nodes alone. Each points to
its parent. In each round, a node that has not met its root takes over its pointer's pointer, so that after r rounds it
has looked 2**r steps up: trees of depth d take log2(d) rounds. A round is one join of the unresolved nodes with the
pointers of the nodes they point to. What is pointed to only ever gets less, so the pointers are cut down to it whenever
the unresolved have halved. Childless nodes join their parents once, at the end.

Nodes that are unresolved after r rounds number U. One whose chain ends has a chain of unresolved nodes above its
2**r-th ancestor, all different, so its depth is below U + 2**r. Once a jump is longer than that, what is left is on a
cycle or leads into one. Then every remaining pointer stands on a cycle, and each node of a cycle is pointed to.

Joins are sort-merge joins, whatever the sizes of files suggest: paths are far larger in memory than on disk. Only
tables of counted rows without paths are broadcast. Where many nodes share a parent, adaptive execution splits the
join's large partitions; the number of children is counted before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.plans.running import running_sum
from strataframe.plans.workspace import discard, store

ON_CYCLE, INTO_CYCLE, TREE = "cycle", "into-cycle", "tree"
#: Pointers are broadcast up to twice this many (each holds two keys and a number, about 100 bytes in memory).
BROADCAST_ROWS = 40_000


def _join(left: DataFrame, right: DataFrame, on: Column | str, how: str = "inner", small: bool = False) -> DataFrame:
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _inner_nodes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with children, ``id, up, jump, met``, and the other nodes, ``id, up``."""
    counted = pairs.where("up IS NOT NULL").groupBy(F.col("up").alias("at")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = store(_join(pairs, counted, F.col("id") == F.col("at"), "full").select("id", "up", "at"), "nodes")
    gone = nodes.where("id IS NULL").select(F.col("at").alias("gone"))
    inner = nodes.where("id IS NOT NULL AND at IS NOT NULL").select("id", "up")
    met = F.col("up").isNull() | F.col("gone").isNotNull()
    flagged = _join(inner, gone, F.col("up") == F.col("gone"), "left", small=gone.count() <= BROADCAST_ROWS)
    pointers = flagged.select("id", F.when(met, F.col("id")).otherwise(F.col("up")).alias("up"), F.when(met, 0).otherwise(1).cast("bigint").alias("jump"), met.alias("met"))
    return store(pointers, "inner"), nodes.where("id IS NOT NULL AND at IS NULL").select("id", "up")


def _climb(step: DataFrame, paths: bool) -> tuple[list[DataFrame], DataFrame, int]:
    """The nodes that met their root, in parts, those on or above cycles, and how many these are.

    With ``paths``, segments travel along: ``seg`` holds a node's ancestors up to ``up``, the farthest first.
    """
    done, active, far = [step.where("met")], step.where("NOT met"), [step]
    pointers, waiting, reach = step.count(), active.count(), 1
    bound = waiting + 1
    while waiting and reach <= bound:
        if waiting <= pointers // 2:
            goals = active.select(F.col("up").alias("id")).distinct()
            far, pointers = [store(_join(_union(far), goals, "id", "left_semi", small=waiting <= BROADCAST_ROWS), "goals")], waiting
        small = not paths and waiting <= pointers <= BROADCAST_ROWS
        seen = _union(far).select(F.col("id").alias("at"), F.col("up").alias("far_up"), F.col("jump").alias("far_jump"), "met", *[F.col("seg").alias("far_seg")] * paths)
        joined = _join(active.drop("met"), seen, F.col("up") == F.col("at"), small=small)
        seg = [F.concat("far_seg", "seg").alias("seg")] * paths
        step = store(joined.select("id", F.col("far_up").alias("up"), (F.col("jump") + F.col("far_jump")).alias("jump"), "met", *seg), "step")
        done.append(step.where("met"))
        active, far, reach = step.where("NOT met"), [*[f.where("met") for f in far], step], reach * 2
        waiting = active.count()
        bound = min(bound, waiting + reach)
    return done, active, waiting


def hierarchy(links: DataFrame, node: str = "id", parent: str = "parent", paths: bool = False) -> DataFrame:
    """One row per node: ``node, root, depth, kind`` and, with ``paths``, ``path`` (array from the root to the node).

    ``links`` has one row per node; other columns are ignored, whatever their names. Rows with a null node are dropped;
    of repeated nodes the row with the greatest parent counts. A null parent, or one that is no node, makes a root of
    depth 0. ``kind`` is 'tree', 'cycle' for nodes on a cycle (a node that is its own parent, too) and 'into-cycle' for
    nodes whose chain ends in one; those have a null root, depth -1 and a null path. An empty table gives no rows.
    """
    pairs = links.select(F.col(node).alias("id"), F.col(parent).alias("up")).dropna(subset=["id"]).groupBy("id").agg(F.max("up").alias("up"))
    pairs = store(pairs, "links")
    inner, leaves = _inner_nodes(pairs)
    discard(pairs)
    done, active, waiting = _climb(inner, False)
    if paths:  # segments of cycles would double for ever: only trees carry them
        trees = _join(inner, active.select("id"), "id", "left_anti", small=waiting <= BROADCAST_ROWS) if waiting else inner
        none = F.array().cast(f"array<{inner.schema['up'].dataType.simpleString()}>")
        done, _, _ = _climb(store(trees.withColumn("seg", F.when(F.col("met"), none).otherwise(F.array("up"))), "trees"), True)

    path = [F.concat("seg", F.array("id")).alias("path")] * paths
    known = _union(done).select("id", F.col("up").alias("root"), F.col("jump").cast("int").alias("depth"), F.lit(TREE).alias("kind"), *path)
    types = {f.name: f.dataType for f in known.schema.fields}
    none = [F.lit(None).cast(types[c]).alias(c) for c in ("path",) if paths]
    if waiting:
        ends = active.select(F.col("up").alias("id")).distinct().withColumn("on", F.lit(True))
        kind = F.when(F.col("on"), ON_CYCLE).otherwise(INTO_CYCLE).alias("kind")
        known = known.unionAll(_join(active.select("id"), ends, "id", "left").select("id", F.lit(None).cast(types["root"]).alias("root"), F.lit(-1).alias("depth"), kind, *none))
    above = known.select(F.col("id").alias("at"), F.col("root").alias("far_root"), F.col("depth").alias("far_depth"), F.col("kind").alias("far_kind"), *[F.col("path").alias("far_path")] * paths)
    root = F.col("far_kind").isNull()
    tree = F.col("far_kind") == TREE
    own = [F.when(root, F.array("id")).when(tree, F.concat("far_path", F.array("id"))).alias("path")] * paths
    below = _join(leaves, above, F.col("up") == F.col("at"), "left").select(
        "id", F.when(root, F.col("id")).when(tree, F.col("far_root")).alias("root"), F.when(root, 0).when(tree, F.col("far_depth") + 1).otherwise(-1).alias("depth"),
        F.when(root | tree, TREE).otherwise(INTO_CYCLE).alias("kind"), *own,
    )
    return known.unionAll(below).withColumnRenamed("id", node)


def descendants(tree: DataFrame, node: str = "id") -> DataFrame:
    """All pairs ``ancestor, descendant, distance`` (distance >= 1) from the paths of :func:`hierarchy`.

    The pairs are the descendants of every node without gathering them in one row; nodes on or above cycles have none.
    """
    steps = tree.where("path IS NOT NULL").select(F.col(node).alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor"))
    return steps.where("level < depth").select("ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))


def intervals(tree: DataFrame, node: str = "id") -> DataFrame:
    """Places ``node, first, last`` in an order in which a node's descendants follow it without a gap.

    ``b`` is below ``a`` exactly if ``a.first < b.first AND b.first <= a.last``, so all descendants of all nodes need one row per
    node instead of one per pair. From the paths of :func:`hierarchy`; nodes on or above cycles have no place.
    """
    paths = tree.where("path IS NOT NULL").select(F.col(node).alias("id"), "path")
    placed = running_sum(paths.withColumn("one", F.lit(1)), [], ["path"], "one", "first")
    under = paths.select(F.explode("path").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    return _join(placed.select("id", "first"), under, "id").select(F.col("id").alias(node), "first", (F.col("first") + F.col("size") - 1).alias("last"))
