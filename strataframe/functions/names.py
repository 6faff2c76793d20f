"""Metadata in the names of tiles and scenes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_corner(name: Column) -> Column:
    """struct<lat, lon> of the south-west corner in names like N45E006 or W123S10; null for others."""
    low = F.upper(name)

    def part(letters: str, negative: str) -> Column:
        found = F.regexp_extract(low, rf"([{letters}])(\d+)", 2).try_cast("double")
        return F.when(F.regexp_extract(low, rf"([{letters}])\d+", 1) == negative, -found).otherwise(found)

    return F.struct(part("NS", "S").alias("lat"), part("EW", "W").alias("lon"))


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the one-degree tile that holds a place, like N45E006; longitudes wrap, and the north pole's name is the south pole's."""
    y, x = F.floor(F.pmod(lat + 90, F.lit(180.0)) - 90), F.floor(F.pmod(lon + 180, F.lit(360.0)) - 180)
    return F.concat(F.when(y < 0, "S").otherwise("N"), F.lpad(F.abs(y).cast("string"), 2, "0"), F.when(x < 0, "W").otherwise("E"), F.lpad(F.abs(x).cast("string"), 3, "0"))


#: What the first part of a product's name stands for: platform, sensor, product, version.
FAMILIES = {
    "SPOT": ("HFS", "SPOT5", None, None),
    "IODEM3": ("IceBridge", "DMS", "IODEM3", None),
    "ILAKS1B": ("IceBridge", "UAF-LS", "ILAKS1B", None),
    "AST": ("Terra", "ASTER", "L1A", None),
    "ASTGTM2": ("Terra", "ASTER", "ASTGTM2", "2"),
    "NASADEM": ("SRTM", "SRTM", None, "1"),
    "TDM1": ("TanDEM-X", "TanDEM-X", "TDM1", "1"),
    "srtm": ("SRTM", "SRTM", "SRTMv4.1", None),
    "SETSM": ("WorldView", None, "ArcticDEM/REMA/EarthDEM", None),
}
#: Landsat sensors by their letter.
LANDSAT = {"C": "OLI/TIRS", "E": "ETM+", "T": "TM", "M": "MSS", "O": "OLI"}


def scene(name: Column) -> Column:
    """struct<platform, sensor, product, version, tile, datetime, date> of a scene's or elevation tile's file name.

    Landsat (both forms), Sentinel-2, and the products of :data:`FAMILIES`; one-degree tiles have a tile, with the ending
    .hgt also the rest. What a name does not tell is null.
    """
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")
    part = lambda k: F.try_element_at(F.split(base, "_"), F.lit(k + 1))
    first, family = part(0), F.create_map(*[F.lit(v) for k in FAMILIES for v in (k, k)])[part(0)]
    field = lambda k: F.create_map(*[x for f, v in FAMILIES.items() for x in (F.lit(f), F.lit(v[k]).cast("string"))])[family]
    old = r"^L([COTEM])([4-9])(\d{3})(\d{3})(\d{4})(\d{3})"
    new = r"^L([COTEM])0?([4-9])_[A-Z0-9]{4}_(\d{3})(\d{3})_(\d{8})"
    is_old, is_new = base.rlike(old), base.rlike(new)
    is_s2 = base.rlike(r"^S2[AB]_") | base.rlike(r"^T\d{2}[A-Z]{3}_\d{8}")
    is_tile, is_hgt = base.rlike(r"^(?i)[NS]\d{2}[EW]\d{3}"), name.rlike(r"(?i)\.hgt$")
    landsat = is_old | is_new
    pick = lambda k: F.when(is_old, F.regexp_extract(base, old, k)).otherwise(F.regexp_extract(base, new, k))
    stamp = lambda text, form: F.try_to_timestamp(text, F.lit(form))
    day_of_year = F.date_add(F.make_date(F.regexp_extract(base, old, 5).try_cast("int"), F.lit(1), F.lit(1)), F.regexp_extract(base, old, 6).try_cast("int") - 1).cast("timestamp")
    newer = F.substring(part(1), 1, 1) == "s"  # the version first, then the rest
    is_setsm, is_aster = family == "SETSM", (family == "AST") & (part(1) == "L1A")
    s2_tile = F.coalesce(F.nullif(F.regexp_extract(base, r"_T(\d{2}[A-Z]{3})_", 1), F.lit("")), F.nullif(F.regexp_extract(base, r"^T(\d{2}[A-Z]{3})_", 1), F.lit("")))
    s2_time = F.coalesce(stamp(F.regexp_extract(base, r"(\d{8}T\d{6})", 1), "yyyyMMdd'T'HHmmss"), stamp(F.regexp_extract(base, r"(\d{8})", 1), "yyyyMMdd"))
    shuttle = F.lit("2000-02-15").cast("timestamp")
    when = (
        F.when(is_old, day_of_year).when(is_new, stamp(F.regexp_extract(base, new, 5), "yyyyMMdd")).when(is_s2, s2_time)
        .when(is_setsm, F.when(newer, stamp(part(3), "yyyyMMdd")).otherwise(stamp(part(2), "yyyyMMdd")))
        .when(family.isin("SPOT"), stamp(part(2), "yyyyMMdd")).when(family == "IODEM3", stamp(F.concat(part(1), part(2)), "yyyyMMddHHmmss")).when(family == "ILAKS1B", stamp(part(1), "yyyyMMdd"))
        .when(is_aster, stamp(F.substring(part(2), 4, 14), "MMddyyyyHHmmss")).when(family.isin("NASADEM", "srtm"), shuttle).when(is_tile & is_hgt, shuttle)
    )
    tile = (
        F.when(landsat, F.concat(pick(3), pick(4))).when(is_s2, s2_tile).when(family == "ASTGTM2", part(1)).when(family == "NASADEM", part(2)).when(family == "TDM1", part(4))
        .when(family == "srtm", F.array_join(F.slice(F.split(base, "_"), 2, 9), "_")).when(is_tile, F.upper(F.substring(base, 1, 7)))
    )
    hgt = is_tile & is_hgt
    return F.struct(
        F.when(landsat, F.concat(F.lit("Landsat "), pick(2))).when(is_s2, "Sentinel-2").when(hgt, "SRTM").otherwise(field(0)).alias("platform"),
        F.when(landsat, F.create_map(*[F.lit(x) for pair in LANDSAT.items() for x in pair])[pick(1)]).when(is_s2, "MSI").when(hgt, "SRTM").when(is_setsm, F.when(newer, part(2)).otherwise(part(1))).otherwise(field(1)).alias("sensor"),
        F.when(hgt, "SRTMGL1").when(family == "NASADEM", F.concat(F.lit("NASADEM-"), part(1))).otherwise(field(2)).alias("product"),
        F.when(hgt, "3").when(is_aster, F.substring(part(2), 3, 1)).when(is_setsm, F.when(newer, part(1)).otherwise(part(7))).otherwise(field(3)).alias("version"),
        tile.alias("tile"), when.alias("datetime"), when.cast("date").alias("date"),
    )


def decode_tags(tags: Column) -> Column:
    """Tags of a scene as text, typed: struct<platform, sensor, product, version, tile, datetime>; 'None' and empty become null."""
    text = lambda k: F.nullif(F.nullif(F.trim(tags[k]), F.lit("None")), F.lit(""))
    return F.struct(*[text(k).alias(k) for k in ("platform", "sensor", "product", "version")], text("tile_name").alias("tile"), text("datetime").try_cast("timestamp").alias("datetime"))
