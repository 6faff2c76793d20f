from __future__ import annotations

import pytest

from strataframe.llm import queries as q
from tests.conftest import assert_same


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, data, name):
    df = q.QUERIES[name](spark, data)
    if name in q.ORACLES:
        assert_same(df, duck.sql(q.ORACLES[name]))
    else:
        assert df.count() > 0


def test_percentiles_with_null_stamps(spark, duck, data, tmp_path):
    for name, stamp in (("raster_pixels", "CASE WHEN col % 3 > 0 THEN loaded_at END"), ("raster_grids", "updated_at"), ("pointcloud_points", "CASE WHEN point_id % 3 > 0 THEN loaded_at END")):
        column = stamp.split()[-2] if " " in stamp else stamp
        few = "WHERE point_id % 20 < 4" if name == "pointcloud_points" else "WHERE raster_id IN (SELECT DISTINCT raster_id FROM raster_grids ORDER BY 1 LIMIT 4)"
        duck.sql(f"COPY (SELECT * REPLACE ({stamp} AS {column}) FROM {name} {few}) TO '{tmp_path}/{name}.parquet'")
    con = duck.cursor()
    con.sql("SET timezone = 'UTC'")
    for f in tmp_path.iterdir():
        con.sql(f"CREATE TEMP VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(q.ORACLES["p1_percentiles"])
    assert con.sql("SELECT count(*) FROM raster_pixels WHERE loaded_at IS NULL").fetchall()[0][0] > 0
    assert_same(q.p1_percentiles(spark, str(tmp_path)), want)


def test_pieces_cover_and_fit(spark, duck, data):
    pieces = q.p5_pieces(spark, data).toPandas()
    cells = duck.sql("SELECT DISTINCT raster_id, band, \"row\" AS r, col AS c FROM raster_pixels").df()
    limits = duck.sql("SELECT raster_id, max_cells, overlap_cells FROM (SELECT * FROM raster_grids QUALIFY row_number() OVER (PARTITION BY raster_id ORDER BY updated_at DESC) = 1) JOIN survey_sites USING (site_id)").df().set_index("raster_id")
    for (raster, band), mine in pieces.groupby(["raster_id", "band"]):
        own = cells[(cells.raster_id == raster) & (cells.band == band)]
        seen = set()
        for p in mine.itertuples():
            held = own[(own.r >= p.row_from) & (own.r < p.row_to) & (own.c >= p.col_from) & (own.c < p.col_to)]
            assert len(held) <= limits.loc[raster].max_cells
            seen |= set(held.index)
        assert len(seen) == len(own)
