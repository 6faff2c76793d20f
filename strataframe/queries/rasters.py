"""Queries of the raster operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions.crs import transform_xy, utm_zone
from strataframe.functions.values import COMPARISON
from strataframe.operators import focal, points, resample, sample
from strataframe.operators.proximity import proximity
from strataframe.operators.raster import Raster, merge, stack, subdivide
from strataframe.operators.regions import label_regions, polygonize
from strataframe.operators.stats import get_stats, linear_error, nmad
from strataframe.operators.tiles import collect_tiles, map_tiles
from strataframe.plans.grid import Grid, tiling
from strataframe.queries.fixtures import F2_GRID, SQL_F1, SQL_F2, SQL_F3, SQL_F5, SQL_F6, SQL_F7, f1, f2, f3, f5, f6, f7

QUERIES, ORACLES = {}, {}
DIGITS = 6


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns or ["value"]})


def query(name: str, sql: str | None = None, *fixtures: str):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(fixtures)} " if fixtures else "") + sql
        return run

    return add


def r6(expression: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0::DOUBLE"


def r8(expression: str) -> str:
    """For means of the discounts, which have six digits themselves."""
    return f"round({expression}, 8) + 0.0::DOUBLE"


def r11(expression: str) -> str:
    """For means of up to 25 discounts, so that no result lies halfway."""
    return f"round({expression}, 11) + 0.0::DOUBLE"


_STATS = {
    "mean": "avg({x})", "median": "median({x})", "max": "max({x})", "min": "min({x})", "sum": "sum({x})", "sum_of_squares": "sum({x} * {x})", "p90": "quantile_cont({x}, 0.9)",
    "le90": "quantile_cont({x}, 0.95) - quantile_cont({x}, 0.05)", "iqr": "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)", "rmse": "sqrt(avg({x} * {x}))", "std": "stddev_pop({x})",
}


def _stats_sql(x: str, source: str, inlier: str = "") -> str:
    filt = f" FILTER (WHERE {inlier})" if inlier else ""
    one = ", ".join(f"{r6('(' + e.format(x='v_') + ')')} AS {n}" for n, e in _STATS.items())
    base = f"SELECT *, CASE WHEN {inlier} THEN {x} END AS v_ FROM {source}" if inlier else f"SELECT *, {x} AS v_ FROM {source}"
    more = f", count(v_) AS valid_inlier_count, count(*) FILTER (WHERE {inlier}) AS total_inlier_count, {r6('100.0 * count(v_) / count(' + x + ')')} AS percent_inlier, {r6('100.0 * count(v_) / count(*)' + filt)} AS percent_valid_inlier" if inlier else ""
    return f"SELECT {one}, (SELECT {r6('1.4826::DOUBLE * median(abs(v_ - m))')} FROM ({base}), (SELECT median(v_) AS m FROM ({base}))) AS nmad, count({x}) AS valid_count, count(*) AS total_count, {r6(f'100.0 * count({x}) / count(*)')} AS percent_valid{more} FROM ({base})"


_FLOATS = [*_STATS, "nmad", "percent_valid"]


@query("raster_stats", _stats_sql("value", "f1"), SQL_F1)
def raster_stats(spark, d):
    return rounded(get_stats(f1(spark, d).df), *_FLOATS)


@query("raster_stats_inlier", _stats_sql("value", "f1", "col < 32"), SQL_F1)
def raster_stats_inlier(spark, d):
    return rounded(get_stats(f1(spark, d).df, inlier=F.col("col") < 32), *_FLOATS, "percent_inlier", "percent_valid_inlier")


@query("pc_stats", _stats_sql("z", "f3"), SQL_F3)
def pc_stats(spark, d):
    return rounded(get_stats(f3(spark, d), "z"), *_FLOATS)


@query("raster_nmad", f"SELECT {r6('1.4826::DOUBLE * median(abs(value - m))')} AS nmad FROM f1, (SELECT median(value) AS m FROM f1)", SQL_F1)
def raster_nmad(spark, d):
    return rounded(nmad(f1(spark, d).df), "nmad")


@query("raster_linear_error", f"SELECT {r6('quantile_cont(value, 0.84) - quantile_cont(value, 0.16)')} AS le FROM f1", SQL_F1)
def raster_linear_error(spark, d):
    return rounded(f1(spark, d).df.agg(linear_error(F.col("value"), 68).alias("le")), "le")


for _array, _mask in ((True, True), (True, False), (False, True), (False, False)):

    def _set_nodata(spark, d, array=_array, mask=_mask):
        r = f5(spark, d)
        r = Raster(r.df, Grid(**{**r.grid.__dict__, "nodata": -1.0}))
        return r.set_nodata(0.05, array, mask).df.select("row", "col", "value")

    _raw = "CASE WHEN coalesce(value, -1.0::DOUBLE) = -1 THEN 0.05::DOUBLE ELSE value END" if _array else "coalesce(value, -1.0::DOUBLE)"
    _null = "value IS NULL" if _array else "false"
    _more = f" OR {_raw} = 0.05::DOUBLE" if _mask else ""
    query(f"set_nodata_{'array' if _array else 'keep'}_{'mask' if _mask else 'nomask'}", f"SELECT row, col, CASE WHEN {_null}{_more} THEN NULL ELSE {_raw} END AS value FROM f5", SQL_F5)(_set_nodata)


@query("mask_select", "SELECT f2.row, f2.col, f2.value FROM f2 JOIN f6 USING (row, col) WHERE f6.value = 2", SQL_F2, SQL_F6)
def mask_select(spark, d):
    return f2(spark, d).select(f6(spark, d).compare("eq", 2.0)).select("row", "col", "value")


@query("mask_assign", "SELECT f2.row, f2.col, CASE WHEN f6.value = 2 THEN -5.0::DOUBLE ELSE f2.value END AS value FROM f2 JOIN f6 USING (row, col)", SQL_F2, SQL_F6)
def mask_assign(spark, d):
    return f2(spark, d).assign(f6(spark, d).compare("eq", 2.0), -5.0).df.select("row", "col", "value")


@query("set_mask", "SELECT f5.row, f5.col, CASE WHEN f6.value > 0 THEN NULL ELSE f5.value END AS value FROM f5 JOIN f6 USING (row, col)", SQL_F5, SQL_F6)
def set_mask(spark, d):
    return f5(spark, d).set_mask(f6(spark, d)).df.select("row", "col", "value")


@query("valid_extent", "SELECT min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max FROM f5 WHERE value IS NOT NULL", SQL_F5)
def valid_extent(spark, d):
    return f5(spark, d).valid_extent()


_ALGEBRA = {
    "add": (lambda a, b: a + b, "a + b"), "sub": (lambda a, b: a - b, "a - b"), "rsub": (lambda a, b: 3.5 - b, "3.5 - b"), "mul": (lambda a, b: a * b, "a * b"),
    "div": (lambda a, b: a / b, "a / nullif(b, 0)"), "rdiv": (lambda a, b: 2.0 / b, "2.0 / nullif(b, 0)"), "floordiv": (lambda a, b: a // (b - 0.05), "floor(a / nullif(b - 0.05::DOUBLE, 0))"),
    "mod": (lambda a, b: (a - 30000.0) % 7.0, "(a - 30000) - 7.0::DOUBLE * floor((a - 30000) / 7.0::DOUBLE)"), "pow": (lambda a, b: b**2, "pow(b, 2)"), "neg": (lambda a, b: -a, "-a"),
    "maximum": (lambda a, b: (a / 1e6).apply("maximum", b), "CASE WHEN b IS NOT NULL THEN greatest(a / 1e6::DOUBLE, b) END"), "hypot": (lambda a, b: a.apply("hypot", b), "sqrt(a * a + b * b)"),
}
_BOTH = "FROM (SELECT f2.row, f2.col, f2.value AS a, f5.value AS b FROM f2 JOIN f5 USING (row, col))"
for _n, (_rule, _sql) in _ALGEBRA.items():
    query(f"algebra_{_n}", f"SELECT row, col, round({_sql}, {8 if _n == 'maximum' else 6}) + 0.0::DOUBLE AS value {_BOTH}", SQL_F2, SQL_F5)(
        lambda spark, d, rule=_rule, n=_n: rounded(rule(f2(spark, d), f5(spark, d)).df.select("row", "col", "value"), digits=8 if n == "maximum" else 6)
    )
_SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
for _n in COMPARISON:
    query(f"compare_{_n}", f"SELECT row, col, b {_SIGNS[_n]} 0.05::DOUBLE AS value {_BOTH}", SQL_F2, SQL_F5)(lambda spark, d, n=_n: f5(spark, d).compare(n, 0.05).df.select("row", "col", "value"))
_LOGICAL = {"and": (lambda p, q: p & q, "p AND q"), "or": (lambda p, q: p | q, "p OR q"), "xor": (lambda p, q: p ^ q, "p <> q"), "not": (lambda p, q: ~q, "NOT q")}
for _n, (_rule, _sql) in _LOGICAL.items():
    query(f"logical_{_n}", f"SELECT row, col, CASE WHEN {'p IS NOT NULL AND ' if _n != 'not' else ''}q IS NOT NULL THEN {_sql} END AS value FROM (SELECT row, col, a > 30000 AS p, b > 0.05::DOUBLE AS q {_BOTH})", SQL_F2, SQL_F5)(
        lambda spark, d, rule=_rule: rule(f2(spark, d) > 30000.0, f5(spark, d) > 0.05).df.select("row", "col", "value")
    )
_UFUNCS = {"sqrt": "CASE WHEN v >= 0 THEN sqrt(v) END", "log": "CASE WHEN v > 0 THEN ln(v) END", "exp": "exp(v)", "abs": "abs(v)", "sin": "sin(v)", "arcsin": "CASE WHEN abs(v) <= 1 THEN asin(v) END", "rint": "round_even(v, 0)", "sign": "sign(v)", "log1p": "CASE WHEN v > -1 THEN ln(1 + v) END", "tanh": "tanh(v)", "floor": "floor(v)", "degrees": "degrees(v)"}
for _n, _sql in _UFUNCS.items():
    query(f"ufunc_{_n}", f"SELECT row, col, {r6(_sql)} AS value FROM (SELECT row, col, value AS v FROM f1)", SQL_F1)(lambda spark, d, n=_n: rounded(f1(spark, d).apply(n).df.select("row", "col", "value")))


@query("cumsum", f"SELECT row, col, {r6('coalesce(sum(value) OVER (ORDER BY row, col), 0)')} AS value FROM f5", SQL_F5)
def cumsum(spark, d):
    return rounded(f5(spark, d).cumsum().select("row", "col", "value"))


def _gradient_sql(axis: str, other: str) -> str:
    w = f"(PARTITION BY {other} ORDER BY {axis})"
    return r8(f"CASE WHEN lag({axis}) OVER {w} IS NULL THEN lead(value) OVER {w} - value WHEN lead({axis}) OVER {w} IS NULL THEN value - lag(value) OVER {w} ELSE (lead(value) OVER {w} - lag(value) OVER {w}) / 2 END")


@query("gradient", f"SELECT row, col, {_gradient_sql('row', 'col')} AS d_row, {_gradient_sql('col', 'row')} AS d_col FROM f5", SQL_F5)
def gradient(spark, d):
    return rounded(f5(spark, d).gradient().select("row", "col", "d_row", "d_col"), "d_row", "d_col", digits=8)


@query("argmax", "SELECT (SELECT row * 50 + col FROM f5 WHERE value IS NOT NULL ORDER BY value DESC, row, col LIMIT 1) AS argmax, (SELECT row * 50 + col FROM f5 WHERE value IS NOT NULL ORDER BY value, row, col LIMIT 1) AS argmin", SQL_F5)
def argmax(spark, d):
    return f5(spark, d).extreme_cells().select("argmax", "argmin")


@query("unique", "SELECT value, count(*) AS n FROM f6 GROUP BY value", SQL_F6)
def unique(spark, d):
    return f6(spark, d).unique().select("value", "n")


@query("crop_bbox", "SELECT row - 10 AS row, col - 5 AS col, value FROM f1 WHERE row BETWEEN 10 AND 109 AND col BETWEEN 5 AND 44", SQL_F1)
def crop_bbox(spark, d):
    r = f1(spark, d)
    return r.crop((478000 + 150.0, 3108140 - 3300.0, 478000 + 1350.0, 3108140 - 300.0)).df.select("row", "col", "value")


@query("icrop", "SELECT row - 3 AS row, col - 7 AS col, value FROM f1 WHERE row >= 3 AND row < 200 AND col >= 7 AND col < 20", SQL_F1)
def icrop(spark, d):
    return f1(spark, d).icrop(3, 200, 7, 20).df.select("row", "col", "value")


@query("translate", "SELECT row, col, 478000.0::DOUBLE + 15 + col * 30.0::DOUBLE AS x, 3108140.0::DOUBLE - 60 - row * 30.0::DOUBLE AS y FROM f1", SQL_F1)
def translate(spark, d):
    return f1(spark, d).translate(0.5, 2.0, "pixel").coordinates().select("row", "col", "x", "y")


@query("set_area_or_point", "SELECT row, col, 478000.0::DOUBLE + col * 30.0::DOUBLE AS x, 3108140.0::DOUBLE - row * 30.0::DOUBLE AS y FROM f1", SQL_F1)
def set_area_or_point(spark, d):
    r = f1(spark, d)
    grid = Grid(**{**r.grid.__dict__, "area_or_point": "Area"}).set_area_or_point("Point")
    return Raster(r.df, grid).coordinates().select("row", "col", "x", "y")


@query("downsample", "SELECT CAST(row / 4 AS INT) AS row, CAST(col / 4 AS INT) AS col, value FROM f1 WHERE row % 4 = 0 AND col % 4 = 0", SQL_F1)
def downsample(spark, d):
    return f1(spark, d).downsample(4).df.select("row", "col", "value")


@query("split_bands", "SELECT row, col, value FROM f5", SQL_F2, SQL_F5)
def split_bands(spark, d):
    return stack([f2(spark, d), f5(spark, d)]).split_bands([2])[0].df.select("row", "col", "value")


@query("stack_diff", f"SELECT 1 AS band, row, col, 0.0::DOUBLE AS value FROM f2 UNION ALL SELECT 2, row, col, {r6('a - b')} {_BOTH}", SQL_F2, SQL_F5)
def stack_diff(spark, d):
    return rounded(stack([f2(spark, d), f5(spark, d)], diff=0).df)


@query("merge_rasters", f"SELECT 1 AS band, row, col, {r8('coalesce((a + b) / 2, a)')} AS value {_BOTH} UNION ALL SELECT 2, row, col, {r8('greatest(a, b)')} {_BOTH} UNION ALL SELECT 3, row, col, 1.0::DOUBLE + (b IS NOT NULL)::INT {_BOTH}", SQL_F2, SQL_F5)
def merge_rasters(spark, d):
    return rounded(merge([f2(spark, d), f5(spark, d)], ["mean", "max", "count"]).df, digits=8)


@query("xy2ij", f"SELECT point_id, {r6('7 - y')} AS i, {r6('x')} AS j, (7 - y < 0 OR 7 - y >= 7 OR x < 0 OR x >= 50) AS out FROM f7", SQL_F7)
def xy2ij(spark, d):
    i, j = points.ij(F2_GRID)
    return rounded(f7(spark, d).select("point_id", i.alias("i"), j.alias("j"), points.outside(F2_GRID, i, j).alias("out")), "i", "j")


@query("ij2xy", "SELECT row, col, 478000.0::DOUBLE + (col + 0.5::DOUBLE) * 30.0::DOUBLE AS x, 3108140.0::DOUBLE - (row + 0.5::DOUBLE) * 30.0::DOUBLE AS y, value FROM f1", SQL_F1)
def ij2xy(spark, d):
    return f1(spark, d).coordinates("center").select("row", "col", "x", "y", "value")


@query("to_pointcloud", "SELECT row, col, 0.0::DOUBLE + col AS x, 7.0::DOUBLE - row AS y, a AS b1, b AS b2 FROM (SELECT f2.row, f2.col, f2.value AS a, f5.value AS b FROM f2 JOIN f5 USING (row, col)) WHERE b IS NOT NULL", SQL_F2, SQL_F5)
def to_pointcloud(spark, d):
    return points.to_points(stack([f2(spark, d), f5(spark, d)]), 2, {1: "b1", 2: "b2"})


@query("from_pointcloud_regular", "SELECT f2.row, f2.col, CASE WHEN f5.value IS NOT NULL THEN f2.value END AS value FROM f2 JOIN f5 USING (row, col)", SQL_F2, SQL_F5)
def from_pointcloud_regular(spark, d):
    cloud = points.to_points(stack([f2(spark, d), f5(spark, d)]), 2, {1: "b1", 2: "b2"}).withColumn("point_id", F.col("row") * 50 + F.col("col")).drop("row", "col")
    return points.from_points(cloud, F2_GRID, "b1").df.select("row", "col", "value")


_AT = "at_ AS (SELECT point_id, 7 - y AS i, x AS j FROM f7), in_ AS (SELECT *, CAST(floor(i + 0.5) AS INT) AS ni, CAST(floor(j + 0.5) AS INT) AS nj FROM at_ WHERE i >= 0 AND j >= 0 AND i <= 6 AND j <= 49)"


@query("interp_nearest", "SELECT f7.point_id, f5.value FROM f7 LEFT JOIN in_ USING (point_id) LEFT JOIN f5 ON f5.row = ni AND f5.col = nj", SQL_F5, SQL_F7, _AT)
def interp_nearest(spark, d):
    return points.interp(f5(spark, d), f7(spark, d), "nearest")


@query(
    "interp_linear",
    f"""SELECT f7.point_id, {r6("v")} AS value FROM f7 LEFT JOIN (
 SELECT point_id, CASE WHEN bool_and(value IS NOT NULL) THEN sum(w * value) END AS v FROM (
  SELECT point_id, w, f5.value FROM (
   SELECT point_id, CAST(floor(i) AS INT) + a AS r, CAST(floor(j) AS INT) + b AS c, (CASE WHEN a = 0 THEN 1 - (i - floor(i)) ELSE i - floor(i) END) * (CASE WHEN b = 0 THEN 1 - (j - floor(j)) ELSE j - floor(j) END) AS w FROM in_, range(2) p(a), range(2) q(b)
  ) k LEFT JOIN f5 ON f5.row = r AND f5.col = c WHERE w > 0
  UNION ALL SELECT point_id, 0.0, f5.value FROM (SELECT point_id, ni + a AS r, nj + b AS c FROM in_, range(-1, 2) p(a), range(-1, 2) q(b) WHERE abs(a) + abs(b) <= 1) k LEFT JOIN f5 ON f5.row = r AND f5.col = c WHERE r BETWEEN 0 AND 6 AND c BETWEEN 0 AND 49
 ) GROUP BY point_id) USING (point_id)""",
    SQL_F5, SQL_F7, _AT,
)
def interp_linear(spark, d):
    return rounded(points.interp(f5(spark, d), f7(spark, d), "linear"))


@query(
    "reduce_points_3x3",
    f"SELECT f7.point_id, {r11('v')} AS value FROM f7 LEFT JOIN (SELECT point_id, avg(value) AS v FROM (SELECT point_id, CAST(floor(7 - y) AS INT) AS r, CAST(floor(x) AS INT) AS c FROM f7) p JOIN f5 ON abs(f5.row - r) <= 1 AND abs(f5.col - c) <= 1 WHERE r BETWEEN 0 AND 6 AND c BETWEEN 0 AND 49 GROUP BY point_id) USING (point_id)",
    SQL_F5, SQL_F7,
)
def reduce_points_3x3(spark, d):
    return rounded(points.reduce_points(f5(spark, d), f7(spark, d), F.avg("value"), 3), digits=11)


_WINDOW = "SELECT a.row, a.col, {e} AS value FROM {t} a JOIN {t} b ON abs(a.row - b.row) <= {r} AND abs(a.col - b.col) <= {r} GROUP BY a.row, a.col"
for _n, _e in (("mean", "avg(b.value)"), ("min", "min(b.value)"), ("max", "max(b.value)"), ("median", "median(b.value)")):
    query(f"focal_{_n}", _WINDOW.format(e=r11(_e), t="f5", r=2), SQL_F5)(lambda spark, d, n=_n: rounded(focal.apply_filter(f5(spark, d), n, 5).df.select("row", "col", "value"), digits=11))
query("focal_mean_large", f"SELECT row, col, {r6('sum(s) OVER w / sum(n) OVER w')} AS value FROM (SELECT row, col, sum(value) OVER v AS s, count(value) OVER v AS n FROM f1 WINDOW v AS (PARTITION BY row ORDER BY col RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WINDOW w AS (PARTITION BY col ORDER BY row RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)", SQL_F1)(
    lambda spark, d: rounded(focal.mean_filter(f1(spark, d), 7).df.select("row", "col", "value"))
)
_GAUSS = "SELECT a.row, a.col, a.value AS v, sum(exp(-((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) / {d}::DOUBLE) * b.value) / sum(exp(-((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) / {d}::DOUBLE)) FILTER (WHERE b.value IS NOT NULL) AS m FROM f5 a LEFT JOIN f5 b ON abs(a.row - b.row) <= {r} AND abs(a.col - b.col) <= {r} AND b.value IS NOT NULL GROUP BY a.row, a.col, a.value"
query("focal_gaussian", f"SELECT row, col, {r6('m')} AS value FROM ({_GAUSS.format(d=2.0, r=4)})", SQL_F5)(lambda spark, d: rounded(focal.gaussian_filter(f5(spark, d), 1.0).df.select("row", "col", "value")))
query("focal_distance", f"SELECT row, col, CASE WHEN abs(v - m) <= 0.0005::DOUBLE THEN v END AS value FROM ({_GAUSS.format(d=8.0, r=8)})", SQL_F5)(lambda spark, d: focal.distance_filter(f5(spark, d), 2.0, 0.0005).df.select("row", "col", "value"))

_COARSE = {"average": "avg(value)", "sum": "sum(value)", "rms": "sqrt(avg(value * value))", "min": "min(value)", "max": "max(value)", "med": "median(value)", "q1": "quantile_cont(value, 0.25)", "q3": "quantile_cont(value, 0.75)"}


def _coarse(grid: Grid, k: int) -> Grid:
    return Grid(grid.a * k, 0.0, grid.c, 0.0, grid.e * k, grid.f, -(-grid.height // k), -(-grid.width // k), grid.crs)


for _n, _e in _COARSE.items():

    def _resample(spark, d, n=_n):
        r = f1(spark, d)
        return rounded(resample.resample(r, _coarse(r.grid, 4), n).df.select("row", "col", "value"))

    query(f"resample_{_n}", f"SELECT CAST(floor(row / 4) AS INT) AS row, CAST(floor(col / 4) AS INT) AS col, {r6(_e)} AS value FROM f1 GROUP BY 1, 2", SQL_F1)(_resample)


@query("resample_mode", "SELECT row, col, value FROM (SELECT CAST(floor(row / 4) AS INT) AS row, CAST(floor(col / 4) AS INT) AS col, value, count(*) AS n FROM f6 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) = 1", SQL_F6)
def resample_mode(spark, d):
    return resample.resample(f6(spark, d), _coarse(F2_GRID, 4), "mode").df.select("row", "col", "value")


_FINE = Grid(0.5, 0.0, 0.3, 0.0, -0.5, 6.9, 13, 98)


@query("resample_nearest", "SELECT r AS row, c AS col, f5.value FROM range(13) p(r), range(98) q(c) LEFT JOIN f5 ON f5.row = CAST(floor(0.1::DOUBLE + (r + 0.5::DOUBLE) * 0.5::DOUBLE) AS INT) AND f5.col = CAST(floor(0.3::DOUBLE + (c + 0.5::DOUBLE) * 0.5::DOUBLE) AS INT)", SQL_F5)
def resample_nearest(spark, d):
    return resample.resample(f5(spark, d), _FINE, "nearest").df.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), "value")


@query(
    "resample_bilinear",
    f"""SELECT r AS row, c AS col, {r6("v")} AS value FROM (
 SELECT r, c, CASE WHEN bool_and(f2.value IS NOT NULL) THEN sum(w * f2.value) END AS v FROM (
  SELECT r, c, CAST(floor(i) AS INT) + a AS y, CAST(floor(j) AS INT) + b AS x, (CASE WHEN a = 0 THEN 1 - (i - floor(i)) ELSE i - floor(i) END) * (CASE WHEN b = 0 THEN 1 - (j - floor(j)) ELSE j - floor(j) END) AS w
  FROM (SELECT r, c, 0.1::DOUBLE + (r + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE AS i, 0.3::DOUBLE + (c + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE AS j FROM range(13) p(r), range(98) q(c)), range(2) s(a), range(2) t(b)
 ) k LEFT JOIN f2 ON f2.row = y AND f2.col = x WHERE w > 1e-12 GROUP BY r, c)""",
    SQL_F2,
)
def resample_bilinear(spark, d):
    return rounded(resample.resample(f2(spark, d), _FINE, "bilinear").df.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), "value"))


@query("proximity_raster", f"SELECT a.row, a.col, {r6('min(sqrt((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)))')} AS value FROM f6 a, f6 b WHERE b.value = 2 GROUP BY a.row, a.col", SQL_F6)
def proximity_raster(spark, d):
    return rounded(proximity(f6(spark, d), [2.0]).df.select("row", "col", "value"))


def _components_sql(near: str) -> str:
    return f"WITH RECURSIVE {SQL_F6}, grow AS (SELECT row, col, value, row * 50 + col AS c FROM f6 UNION SELECT b.row, b.col, b.value, a.c FROM grow a JOIN f6 b ON a.value = b.value AND {near} AND a.c < b.row * 50 + b.col) SELECT row, col, min(c) AS component FROM grow GROUP BY row, col"


ORACLES["components_4"] = _components_sql("abs(a.row - b.row) + abs(a.col - b.col) = 1")
ORACLES["components_8"] = _components_sql("greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1")
QUERIES["components_4"] = lambda spark, d: label_regions(f6(spark, d), 4, 5).select("row", "col", F.col("component").cast("int").alias("component"))
QUERIES["components_8"] = lambda spark, d: label_regions(f6(spark, d), 8, 5).select("row", "col", F.col("component").cast("int").alias("component"))
ORACLES["polygonize"] = f"SELECT component, count(*) AS n_cells, count(*)::DOUBLE AS area FROM ({ORACLES['components_4']}) GROUP BY component"


def _polygonize(spark, d):
    from strataframe.functions.geometry import area

    return polygonize(f6(spark, d)).select(F.col("component").cast("int").alias("component"), "n_cells", area("geom").alias("area"))


QUERIES["polygonize"] = _polygonize

@query(
    "subsample_topk",
    "SELECT gid, row, col, value FROM (SELECT *, xor(z2, z2 >> 31) AS key FROM (SELECT *, ((xor(z1, z1 >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z2 FROM (SELECT *, ((xor(z0, z0 >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z1 FROM (SELECT CAST(row AS BIGINT) * 64 + col AS gid, row, col, value, ((xor((CAST(row AS BIGINT) * 64 + col)::UBIGINT, 42::UBIGINT)::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z0 FROM f1 WHERE value IS NOT NULL)))) ORDER BY key, gid LIMIT 500",
    SQL_F1,
)
def subsample_topk(spark, d):
    return sample.topk_sample(f1(spark, d), 500, 42)


@query("subdivide_array", "SELECT row, col, CAST(greatest(0, floor(row * (2 / 6.0::DOUBLE) + 0.5::DOUBLE) * 3 + floor(col * (2 / 49.0::DOUBLE) + 0.5::DOUBLE) - 2) AS INT) AS block FROM f6", SQL_F6)
def subdivide_array(spark, d):
    return f6(spark, d).df.select("row", "col", subdivide(F2_GRID, 7).alias("block"))


@query("compute_tiling", "SELECT greatest(0, r * 3 - 1) AS row_from, least(7, r * 3 + 4) AS row_to, greatest(0, c * 16 - 1) AS col_from, least(50, c * 16 + 17) AS col_to FROM range(2) p(r), range(4) q(c)")
def compute_tiling(spark, d):
    return spark.createDataFrame(tiling((7, 50), (3, 16), 1), "row_from bigint, row_to bigint, col_from bigint, col_to bigint")


@query("tile_udf_sum", f"SELECT CAST(floor(row / 16) AS INT) AS tile_row, CAST(floor(col / 16) AS INT) AS tile_col, {r6('sum(value)')} AS total, count(value) AS n FROM f1 GROUP BY 1, 2", SQL_F1)
def tile_udf_sum(spark, d):
    import numpy as np

    out = collect_tiles(f1(spark, d), lambda a: {"total": float(np.nansum(a)), "n": int(np.isfinite(a).sum())}, "total double, n bigint", 16)
    return rounded(out.select("tile_row", "tile_col", "total", "n"), "total")


@query("tile_map_overlap", f"SELECT a.row, a.col, {r6('max(b.value)')} AS value FROM f5 a JOIN f5 b ON a.row = b.row AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col", SQL_F5)
def tile_map_overlap(spark, d):
    def widest(a):
        import numpy as np

        padded = np.pad(np.where(np.isnan(a), -np.inf, a), ((0, 0), (1, 1)), constant_values=-np.inf)
        out = np.maximum(np.maximum(padded[:, :-2], padded[:, 1:-1]), padded[:, 2:])
        return np.where(np.isinf(out), np.nan, out)

    return rounded(map_tiles(f5(spark, d), widest, 8, 1).df.select("row", "col", "value"))


@query("crs_round_trip", "SELECT point_id, CAST(ceil((lon + 180) / 6) AS INT)::VARCHAR || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS zone, true AS same FROM (SELECT point_id, 84.5::DOUBLE + x / 100 AS lon, 20.0::DOUBLE + y / 10 AS lat FROM f7)", SQL_F7)
def crs_round_trip(spark, d):
    p = f7(spark, d).select("point_id", (84.5 + F.col("x") / 100).alias("lon"), (20.0 + F.col("y") / 10).alias("lat"))
    x, y = transform_xy(F.col("lon"), F.col("lat"), 4326, 32645)
    moved = p.select("*", x.alias("e"), y.alias("n"))
    lon, lat = transform_xy(F.col("e"), F.col("n"), 32645, 4326)
    return moved.select("point_id", utm_zone(F.col("lat"), F.col("lon")).alias("zone"), ((F.abs(lon - F.col("lon")) < 1e-8) & (F.abs(lat - F.col("lat")) < 1e-8)).alias("same"))
