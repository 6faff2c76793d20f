"""Queries of the problems on training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.cells import current_cells, current_grids, named, with_grid
from strataframe.llm.leak import leaks, removal_spans
from strataframe.llm.mix import mix, source_name, token_counts
from strataframe.llm.percentiles import percentiles, value_counts
from strataframe.llm.readability import reading_stats, with_bands
from strataframe.llm.reservoir import reservoir_sample
from strataframe.llm.split import split_bands
from strataframe.operators.records import latest
from strataframe.plans.workspace import store
from strataframe.sources.tables import table

#: z values that stand for no data.
NO_Z = -9999.0


def _day(micros: Column) -> Column:
    day = F.lit(86_400_000_000)
    return F.date_from_unix_date(((micros - F.pmod(micros, day)) / day).cast("int"))


def raster_states(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """Counts of rounded values per raster and day: the state from which all scopes of problem 1 are made."""
    cells = current_cells(pixels, grids).where("valid")
    return value_counts(cells.select("grid", "stray", _day(F.col("_at")).alias("day"), "value"), ["grid", "stray", "day"], "value")


def point_states(points: DataFrame) -> DataFrame:
    """Counts of rounded z per site, cloud and day."""
    now = latest(points.select("point_id", "site_id", "cloud_id", "z", "loaded_at"), ["point_id"], "loaded_at").where(F.col("z") != NO_Z)
    return value_counts(now.select("site_id", "cloud_id", _day(F.unix_micros("loaded_at")).alias("day"), "z"), ["site_id", "cloud_id", "day"], "z")


#: Measure and scope of each numbered kind of group.
SCOPES = tuple((measure, scope) for measure, piece in (("value", "raster"), ("z", "cloud")) for scope in (piece, "site", "day", "all"))
#: Stands for a null day among numbered ones.
NO_DAY = -(2**40)


def _groups(scope: Column, number: Column, text: Column, states: DataFrame) -> DataFrame:
    """States under keys without nulls: the kind of group, a number and a text."""
    return states.select(scope.cast("int").alias("scope"), F.coalesce(number.cast("bigint"), F.lit(NO_DAY)).alias("number"), F.coalesce(text, F.lit("")).alias("text"), "value", "n")


def _named_groups(states: DataFrame, column: str, scope: int) -> DataFrame:
    return _groups(F.lit(scope), F.col(column).isNull(), F.col(column), states)


def _wide(states: DataFrame, first: int) -> DataFrame:
    """States of sites, of days and of all (kinds ``first``, ``first + 1`` and ``first + 2``), from those of pieces."""
    sets = [[F.col("site_id"), F.col("value")], [F.col("day"), F.col("value")], [F.col("value")]]
    summed = states.groupingSets(sets, "site_id", "day", "value").agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("set"))
    site, day = F.col("set") == 2, F.col("set") == 4
    number = F.when(site, F.col("site_id").isNull().cast("bigint")).when(day, F.unix_date("day").cast("bigint")).otherwise(F.lit(0))
    return store(_groups(first + F.when(site, 0).when(day, 1).otherwise(2), number, F.when(site, F.col("site_id")), summed), "wide")


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of cell values by site, raster, day of loading and over all; of z by site, cloud, day and over all."""
    grids = current_grids(table(spark, folder, "raster_grids"))
    cells = store(raster_states(table(spark, folder, "raster_pixels"), grids), "states")
    z = store(point_states(table(spark, folder, "pointcloud_points")), "states")
    parts = [_groups(F.lit(0), F.col("grid"), F.col("stray"), cells), _wide(with_grid(cells, grids, "grid", ("site_id",)), 1), _named_groups(z, "cloud_id", 4), _wide(z, 5)]
    coded = [_groups(F.col("scope"), F.col("number"), F.col("text"), p) for p in parts]
    found = percentiles(reduce(DataFrame.unionAll, coded), ["scope", "number", "text"]).withColumn("grid", F.when(F.col("scope") == 0, F.col("number")))
    names = [F.element_at(F.array(*[F.lit(s[k]) for s in SCOPES]), F.col("scope") + 1).alias(c) for k, c in enumerate(("measure", "scope"))]
    of_day = F.when(F.col("number") != NO_DAY, F.date_from_unix_date(F.col("number").cast("int")).cast("string"))
    key = F.when(F.col("scope") == 0, F.coalesce("raster_id", "text")).when(F.col("scope").isin(1, 4, 5), F.when(F.col("number") == 0, F.col("text"))).when(F.col("scope").isin(2, 6), of_day)
    return with_grid(found, grids, "grid", ("raster_id",)).select(*names, key.alias("key"), "n", *[c for c in found.columns if c[0] == "p" and c[1:].isdigit()])


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """1,000 valid cells of all and 100 of each site."""
    grids = current_grids(table(spark, folder, "raster_grids"))
    cells = named(current_cells(table(spark, folder, "raster_pixels"), grids).where("valid"), grids, ("site_id",))
    rows = cells.select("site_id", "raster_id", "band", "row", "col", "value")
    return reservoir_sample(rows, {"all": (None, 1000), "site": ("site_id", 100)}, seed=4)


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What the samples must keep, by scope and key: the population, the rows drawn, and how many different valid cells these are."""
    cells = ["raster_id", "band", "row", "col"]
    drawn = store(p4_sample(spark, folder), "drawn")
    grids = current_grids(table(spark, folder, "raster_grids"))
    valid = named(current_cells(table(spark, folder, "raster_pixels"), grids).where("valid"), grids).select(*cells, F.lit(True).alias("known"))
    marked = drawn.join(F.broadcast(drawn.select(*cells).distinct()).join(valid, cells, "left"), cells, "left")
    return marked.groupBy("scope", "key").agg(F.max("population").alias("population"), F.count(F.lit(1)).alias("drawn"), F.count_distinct(F.when(F.col("known"), F.struct(*cells))).alias("different"))


def _site_limits(spark: SparkSession, folder: str) -> DataFrame:
    sites = table(spark, folder, "survey_sites").select("site_id", "max_cells", "overlap_cells").dropna(subset=["site_id"])
    return sites.groupBy("site_id").agg(F.max("max_cells").alias("max_cells"), F.max("overlap_cells").alias("overlap_cells"))


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    grids = current_grids(table(spark, folder, "raster_grids"))
    limits = grids.join(_site_limits(spark, folder), "site_id").select("grid", "max_cells", "overlap_cells")
    cells = current_cells(table(spark, folder, "raster_pixels"), grids)
    return split_bands(cells.where("stray IS NULL"), limits, raster=["grid"]), grids


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    bands, grids = _split(spark, folder)
    bands = named(bands.withColumn("stray", F.lit(None).cast("string")), grids)
    none = F.array(F.struct(F.lit("none").alias("axis"), F.lit(-1).alias("seam_at")))
    return bands.select("raster_id", "band", F.explode(F.when(F.size("seams") > 0, F.col("seams")).otherwise(none)).alias("s")).select("raster_id", "band", "s.axis", "s.seam_at")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of each band that is too large, with their own transforms (a, b, d and e stay)."""
    bands, grids = _split(spark, folder)
    each = named(bands.withColumn("stray", F.lit(None).cast("string")), grids).select("raster_id", "band", F.posexplode("pieces").alias("piece", "p")).select("raster_id", "band", "piece", "p.*")
    grid = grids.select("raster_id", "a", "b", "c", "d", "e", "f")
    moved = each.join(grid, "raster_id")
    c = F.col("c") + F.col("a") * F.col("col_from") + F.col("b") * F.col("row_from")
    f = F.col("f") + F.col("d") * F.col("col_from") + F.col("e") * F.col("row_from")
    return moved.select("raster_id", "band", "piece", "axis", "row_from", "row_to", "col_from", "col_to", "overlap", "a", "b", c.alias("c"), "d", "e", f.alias("f"))


def p5_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What pieces must keep, by band: cells in no piece, pieces above the site's size, and those that share less with the piece before them than they say."""
    grids = current_grids(table(spark, folder, "raster_grids"))
    sites = _site_limits(spark, folder)
    cells = store(current_cells(table(spark, folder, "raster_pixels"), grids).where("stray IS NULL").select("grid", "band", "row", "col", "valid"), "cells")
    bands = split_bands(cells, grids.join(sites, "site_id").select("grid", "max_cells", "overlap_cells"), raster=["grid"])
    pieces = store(bands.select("grid", "band", F.posexplode("pieces").alias("piece", "p")).select("grid", "band", "piece", "p.*"), "pieces")
    met = cells.join(pieces.groupBy("grid", "band").agg(F.collect_list(F.struct("piece", "row_from", "row_to", "col_from", "col_to")).alias("all")), ["grid", "band"])
    holders = F.filter("all", lambda p: (F.col("row") >= p["row_from"]) & (F.col("row") < p["row_to"]) & (F.col("col") >= p["col_from"]) & (F.col("col") < p["col_to"]))
    held = met.select("grid", "band", F.transform(holders, lambda p: p["piece"]).alias("held"))
    lost = held.groupBy("grid", "band").agg(F.count_if(F.size("held") == 0).alias("uncovered"))
    sizes = held.select("grid", "band", F.explode("held").alias("piece")).groupBy("grid", "band", "piece").agg(F.count(F.lit(1)).alias("cells"))
    limit = grids.join(sites, "site_id").select("grid", "max_cells")
    large = sizes.join(limit, "grid").groupBy("grid", "band").agg(F.count_if(F.col("cells") > F.col("max_cells")).alias("oversized"))
    cut = [F.when(F.col("axis") == "col", F.col(f"col_{end}")).otherwise(F.col(f"row_{end}")).alias(end) for end in ("from", "to")]
    strip = F.when(F.col("axis") == "grid", F.col("col_from")).alias("strip")
    line = Window.partitionBy("grid", "band", "strip")
    behind = (F.lag("to").over(line.orderBy("piece")) - F.col("from") < F.col("overlap")) & (F.col("from") > F.min("from").over(line))
    shared = pieces.select("grid", "band", "piece", "overlap", strip, *cut).withColumn("behind", behind).groupBy("grid", "band").agg(F.count_if("behind").alias("short"))
    joined = lost.join(large, ["grid", "band"]).join(shared, ["grid", "band"])
    return named(joined.withColumn("stray", F.lit(None).cast("string")), grids).select("raster_id", "band", "uncovered", "oversized", "short")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    items = latest(table(spark, folder, "eval_items").select("item_id", "item_text", "added_at"), ["item_id"], "added_at")
    return leaks(table(spark, folder, "documents").select("doc_id", "text"), items)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p6_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of words to remove from each document."""
    return removal_spans(_leaks(spark, folder))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select("text", "doc_id", source_name("source").alias("source"), "preprint_id")
    sized = store(token_counts(documents), "tokens")
    versions = sized.where("preprint_id IS NOT NULL").groupBy("preprint_id").agg(F.count(F.lit(1)).alias("versions"))
    weighed = sized.join(versions, "preprint_id", "left").select(F.col("doc_id").alias("id"), "source", F.col("tokens").alias("size"), (1 / F.coalesce("versions", F.lit(1))).alias("weight"))
    targets = table(spark, folder, "source_targets").withColumn("source", source_name("source"))
    return mix(weighed, latest(targets, ["source"], "updated_at"), seed=7)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents chosen with their copies; the versions of a preprint share its chances."""
    chosen, _ = _mix(spark, folder)
    return chosen.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("tokens"), "copies")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Targets and what was reached, by source."""
    return _mix(spark, folder)[1]


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What the mixture must keep, by source: no record above its cap, and a size within one record of the target or of all copies allowed."""
    chosen, report = _mix(spark, folder)
    most = chosen.groupBy("source").agg(F.max("copies").alias("most_copies"), F.max("size").alias("largest"))
    joined = report.join(most, "source", "left")
    limit = F.least(F.col("target_size"), F.coalesce(F.col("available") * F.col("max_repeats"), F.lit(0)))
    near = F.abs(F.col("reached_size") - limit) <= F.coalesce("largest", F.lit(0))
    return joined.select("source", "target_share", "max_repeats", "records", (F.coalesce("most_copies", F.lit(0)) <= F.coalesce("max_repeats", F.lit(0))).alias("cap_kept"), near.alias("target_met"))


def _reading(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    stats = store(reading_stats(table(spark, folder, "documents").select("doc_id", "text")), "reading")
    grades = latest(table(spark, folder, "doc_grades").select("doc_id", "rater", "grade", "rated_at"), ["doc_id", "rater"], "rated_at")
    return stats, with_bands(stats, grades.select("doc_id", "grade"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _reading(spark, folder)[1].select("doc_id", "band")


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Grade estimates of each document, and its band where it has enough English prose."""
    stats, bands = _reading(spark, folder)
    return stats.drop("histogram").join(bands, "doc_id", "left")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Profile of each source: documents with a band, mean band and mean grade."""
    stats, bands = _reading(spark, folder)
    sources = table(spark, folder, "documents").select("doc_id", source_name("source").alias("source"))
    joined = bands.join(stats.select("doc_id", "grade"), "doc_id").join(sources, "doc_id")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("band"), 6).alias("mean_band"), F.round(F.avg("grade"), 6).alias("mean_grade"))


QUERIES = {
    "p1_percentiles": p1_percentiles, "p4_sample": p4_sample, "p4_counts": p4_counts, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_coverage": p5_coverage, "p6_found": p6_found, "p6_spans": p6_spans,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_kept": p7_kept, "p8_found": p8_found, "p8_documents": p8_documents, "p8_sources": p8_sources,
}

_CELLS = """
grid AS (SELECT * FROM raster_grids QUALIFY row_number() OVER (PARTITION BY raster_id ORDER BY updated_at DESC) = 1),
cell AS (SELECT raster_id, band, "row" AS r, col AS k, value, loaded_at FROM raster_pixels QUALIFY row_number() OVER (PARTITION BY raster_id, band, "row", col ORDER BY loaded_at DESC, value DESC NULLS LAST) = 1),
current AS (SELECT c.*, g.site_id, g.nodata, value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AND coalesce(value <> g.nodata, true) AS valid FROM cell c LEFT JOIN grid g USING (raster_id))
"""
_STEP = "(CASE WHEN abs({0} / 0.125::DOUBLE) < 4503599627370496::DOUBLE THEN floor({0} / 0.125::DOUBLE + 0.5::DOUBLE) ELSE {0} / 0.125::DOUBLE END * 0.125::DOUBLE + 0.0::DOUBLE)"
_PERMILLE = (50, 250, 500, 750, 950)

_LARGE = "size AS (SELECT raster_id, band FROM current JOIN survey_sites USING (site_id) GROUP BY raster_id, band HAVING count(*) > max(max_cells))"

ORACLES = {
    "p4_counts": f"""WITH {_CELLS}, v AS (SELECT 'all' AS scope, NULL AS key, 1000 AS asked FROM current WHERE valid UNION ALL SELECT 'site', site_id, 100 FROM current WHERE valid)
SELECT scope, key, count(*) AS population, least(count(*), max(asked)) AS drawn, least(count(*), max(asked)) AS different FROM v GROUP BY scope, key""",
    "p5_coverage": f"WITH {_CELLS}, {_LARGE} SELECT raster_id, band, 0::BIGINT AS uncovered, 0::BIGINT AS oversized, 0::BIGINT AS short FROM size",
    "p7_kept": """WITH named AS (SELECT nullif(regexp_replace(lower(trim(source)), '[_\\s]+', '-', 'g'), '') AS source, text FROM documents),
have AS (SELECT source, count(*) AS records FROM named WHERE source IS NOT NULL AND length(text) > 0 GROUP BY source),
spelled AS (SELECT nullif(regexp_replace(lower(trim(source)), '[_\\s]+', '-', 'g'), '') AS source, target_share, max_repeats, updated_at FROM source_targets),
asked AS (SELECT * FROM spelled WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, target_share DESC NULLS LAST, max_repeats DESC NULLS LAST) = 1)
SELECT source, target_share, max_repeats, coalesce(records, 0) AS records, true AS cap_kept, true AS target_met FROM have FULL JOIN asked USING (source)""",
    "p1_percentiles": f"""WITH {_CELLS},
z_now AS (SELECT point_id, site_id, cloud_id, z, loaded_at FROM pointcloud_points QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC, site_id DESC NULLS LAST, cloud_id DESC NULLS LAST, z DESC NULLS LAST) = 1),
v AS (SELECT 'value' AS measure, 'raster' AS piece, site_id, raster_id AS part, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, {_STEP.format("value")} AS value FROM current WHERE valid
  UNION ALL SELECT 'z', 'cloud', site_id, cloud_id, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m-%d'), {_STEP.format("z")} FROM z_now WHERE z IS NOT NULL AND NOT isnan(z) AND NOT isinf(z) AND z <> -9999),
s AS (SELECT measure, 'site' AS scope, site_id AS key, value FROM v UNION ALL SELECT measure, piece, part, value FROM v UNION ALL SELECT measure, 'day', day, value FROM v UNION ALL SELECT measure, 'all', NULL, value FROM v)
SELECT measure, scope, key, count(*) AS n, {", ".join(f"list_sort(list(value))[greatest(1, (count(*) * {p} + 999) // 1000)] AS p{p:03d}" for p in _PERMILLE)} FROM s GROUP BY measure, scope, key""",
    "p5_found": f"""WITH {_CELLS},
size AS (SELECT raster_id, band FROM current JOIN survey_sites USING (site_id) GROUP BY raster_id, band HAVING count(*) > max(max_cells)),
line AS (SELECT raster_id, band, 'row' AS axis, r AS at_ FROM current JOIN size USING (raster_id, band) WHERE valid GROUP BY ALL UNION ALL SELECT raster_id, band, 'col', k FROM current JOIN size USING (raster_id, band) WHERE valid GROUP BY ALL),
gap AS (SELECT raster_id, band, axis, lag(at_) OVER (PARTITION BY raster_id, band, axis ORDER BY at_) + 1 AS seam_at, at_ FROM line QUALIFY at_ > seam_at),
seam AS (SELECT raster_id, band, axis, seam_at FROM gap)
SELECT * FROM seam UNION ALL SELECT raster_id, band, 'none', -1 FROM size WHERE NOT EXISTS (SELECT 1 FROM seam WHERE seam.raster_id = size.raster_id AND seam.band = size.band)""",
}
