"""Current cells of rasters: each counted once, as of its latest delivery, with the grid it lies on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.records import latest, latest_value
from strataframe.plans.workspace import store

#: Up to this many grids (one row of some 100 bytes per raster) are sent to all tasks; more are joined by shuffling.
BROADCAST_GRIDS = 100_000


def current_grids(grids: DataFrame) -> DataFrame:
    """The latest row of each raster, numbered by ``grid``."""
    return store(latest(grids, ["raster_id"], "updated_at").withColumn("grid", F.monotonically_increasing_id()), "grids")


def with_grid(df: DataFrame, grids: DataFrame, on: str, columns: tuple[str, ...]) -> DataFrame:
    """Joins columns of the grids; rows without a grid get nulls."""
    slim = grids.select(on, *columns)
    return df.join(F.broadcast(slim) if grids.count() <= BROADCAST_GRIDS else slim, on, "left")


def current_cells(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """``grid, stray, band, row, col, value, _at, valid`` of each delivered cell.

    ``grid`` numbers the raster's row in ``grids``; ``stray`` is null, but the raster's id where it has no grid. A cell is
    valid if its latest value is delivered, not null, finite and not the grid's nodata (a null or NaN nodata equals no
    value). Rows with a null in the key (raster, band, row, column) are dropped.
    """
    known = pixels.dropna(subset=["raster_id"]).select("raster_id", "band", "row", "col", "value", "loaded_at")
    known = with_grid(known, grids, "raster_id", ("grid", "nodata"))
    finite = "value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')"
    good = F.expr(f"CASE WHEN {finite} AND coalesce(value <> nodata, true) THEN value END")
    coded = known.dropna(subset=["band", "row", "col"]).select(
        F.coalesce("grid", F.lit(-1)).alias("grid"), F.when(F.col("grid").isNull(), F.col("raster_id")).alias("stray"), "row",
        F.shiftleft(F.col("band").cast("bigint"), 32).bitwiseOR(F.col("col").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("cell"),
        good.alias("value"), "loaded_at",
    )
    cells = latest_value(coded, ["grid", "stray", "row", "cell"], "value", "loaded_at", cluster=["grid", "stray", "row"])
    low = F.col("cell").bitwiseAND(0xFFFFFFFF)
    col = F.when(low > 0x7FFFFFFF, low - 0x100000000).otherwise(low).cast("int").alias("col")
    return cells.select("grid", "stray", F.shiftright("cell", 32).cast("int").alias("band"), "row", col, "value", "_at", F.col("value").isNotNull().alias("valid"))


def named(df: DataFrame, grids: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Puts ``raster_id`` (and more columns of the grid) in the place of ``grid`` and ``stray``."""
    joined = with_grid(df, grids, "grid", ("raster_id", *columns))
    rest = [c for c in df.columns if c not in ("grid", "stray")]
    return joined.select(F.coalesce("raster_id", "stray").alias("raster_id"), *rest, *columns)
