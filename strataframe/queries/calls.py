"""Problem 3: parent-child links of profiled calls to full hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.hierarchy import INTO_CYCLE, ON_CYCLE, TREE, descendants, hierarchy
from strataframe.operators.records import latest
from strataframe.sources.tables import table


def uuid_bytes(text: str) -> Column:
    """The 16 bytes of a UUID in any spelling (case, braces, hyphens or none, ``urn:uuid:``), else null."""
    low = F.lower(F.trim(text))
    bare = F.translate(F.when(low.startswith("urn:uuid:"), F.substring(low, 10, 1000)).otherwise(low), "{}-", "")
    return F.when(F.length(bare) == 32, F.unhex(bare))


def uuid_text(data: str | Column) -> Column:
    """Lower case with hyphens."""
    return F.regexp_replace(F.lower(F.hex(data)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def current_links(calls: DataFrame) -> DataFrame:
    """``id, parent`` of each call as of its latest delivery; rows whose own id is no UUID cannot be named and are left out."""
    read = calls.select(uuid_bytes("uuid_function").alias("id"), uuid_bytes("uuid_parent").alias("parent"), "loaded_at")
    return latest(read, ["id"], "loaded_at").select("id", "parent")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy(current_links(table(spark, folder, "profiling_info")))
    state = F.when(F.col("kind") == ON_CYCLE, "cycle").when(F.col("kind") == INTO_CYCLE, "into-cycle")
    return tree.select(uuid_text("id").alias("uuid_function"), F.coalesce(state, uuid_text("root")).alias("root_uuid"), "depth")


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path from the root to each call, as ids; calls on or below cycles have none."""
    tree = hierarchy(current_links(table(spark, folder, "profiling_info")), paths=True)
    return tree.select(uuid_text("id").alias("uuid_function"), F.array_join(F.transform("path", uuid_text), "/").alias("path"), "depth")


def p3_below(spark: SparkSession, folder: str) -> DataFrame:
    """All calls below each call, with the number of steps between."""
    pairs = descendants(hierarchy(current_links(table(spark, folder, "profiling_info")), paths=True))
    return pairs.select(uuid_text("ancestor").alias("uuid_function"), uuid_text("descendant").alias("uuid_below"), F.col("distance").cast("int").alias("distance"))


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_below": p3_below}

_BARE = "regexp_replace(lower(trim({0})), '^urn:uuid:|^\\{{|\\}}$|-', '', 'g')"


def _hyphens(column: str) -> str:
    return f"concat_ws('-', {column}[1:8], {column}[9:12], {column}[13:16], {column}[17:20], {column}[21:32])"


_WALK = f"""
spelled AS (SELECT {_BARE.format("uuid_function")} AS id, {_BARE.format("uuid_parent")} AS up, loaded_at FROM profiling_info),
calls AS (SELECT id, CASE WHEN regexp_full_match(up, '[0-9a-f]{{32}}') THEN up END AS up, loaded_at FROM spelled WHERE regexp_full_match(id, '[0-9a-f]{{32}}')),
links AS (SELECT id, up FROM calls QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, up DESC NULLS LAST) = 1),
edges AS (SELECT l.id, p.id AS up FROM links l LEFT JOIN links p ON l.up = p.id),
down AS (SELECT id, id AS root, 0 AS depth, {_hyphens("id")} AS path FROM edges WHERE up IS NULL
  UNION ALL SELECT e.id, d.root, d.depth + 1, d.path || '/' || {_hyphens("e.id")} FROM edges e JOIN down d ON e.up = d.id)
"""
_LOST = "lost AS (SELECT id, up FROM edges WHERE id NOT IN (SELECT id FROM down)), climb AS (SELECT id AS start, up AS here FROM lost UNION SELECT c.start, l.up FROM climb c JOIN lost l ON c.here = l.id), ring AS (SELECT DISTINCT start AS id FROM climb WHERE start = here)"

ORACLES = {
    "p3_found": f"""WITH RECURSIVE {_WALK}, {_LOST}
SELECT {_hyphens("id")} AS uuid_function, {_hyphens("root")} AS root_uuid, depth FROM down
UNION ALL SELECT {_hyphens("id")}, CASE WHEN id IN (SELECT id FROM ring) THEN 'cycle' ELSE 'into-cycle' END, -1 FROM lost""",
    "p3_paths": f"""WITH RECURSIVE {_WALK} SELECT {_hyphens("e.id")} AS uuid_function, d.path, coalesce(d.depth, -1) AS depth FROM edges e LEFT JOIN down d USING (id)""",
    "p3_below": f"""WITH RECURSIVE {_WALK}, kept AS (SELECT e.id, e.up FROM edges e JOIN down USING (id)),
below AS (SELECT up AS id, id AS under, 1 AS distance FROM kept WHERE up IS NOT NULL UNION ALL SELECT k.up, b.under, b.distance + 1 FROM below b JOIN kept k ON b.id = k.id WHERE k.up IS NOT NULL)
SELECT {_hyphens("id")} AS uuid_function, {_hyphens("under")} AS uuid_below, distance FROM below""",
}
