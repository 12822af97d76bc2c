"""Points near points, and regions that contain points, by space-filling-curve cells.

``within_distance``: points lie on a sphere; their space coordinates are cut into cubes, named by the Morton
code of the cube (63 bits, 21 an axis). A disc is covered by the cubes its bounding box touches, one to eight
of an edge of at least twice the radius: ranges of codes that share a prefix. The range join is thus an
equi-join on sorted prefixes; each candidate pair meets in exactly one cube and is then refined by its
great-circle distance. Space cubes need no special case at the poles or the date line.

Cubes with more than ``max_cell_rows`` points are salted on both sides: points and discs are each spread over parts,
and every part of the one meets every part of the other, so that a task compares about ``max_cell_rows`` with as many.

``containing_region``: boxes in degrees are covered by quadtree cells of the level where a box spans about
``2`` cells, points look up their cell of each level in use, then the box itself decides.

Defined results: points without id or with missing or impossible coordinates take no part; longitudes may run
from -180 or from 0; the same row given twice counts once; equal places are at distance 0 and a pair; a point
is no pair with itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0
MAX_CELL_ROWS = 5_000
_BITS = 21


def usable_degrees(c: Column, low: float, high: float) -> Column:
    """Degrees as double; NULL for missing codes, NaN and values outside [low, high]."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & d.between(low, high), d)


def _spread(c: Column, gap: int, group: int, groups: int) -> Column:
    """The bits of ``c`` with ``gap`` zero bits after each, by a table for every ``group`` bits."""
    spread = [sum((v >> b & 1) << b * (gap + 1) for b in range(group)) for v in range(1 << group)]
    table = F.array(*[F.lit(v).cast("bigint") for v in spread])
    out = None
    for i in range(groups):
        part = F.shiftright(c, i * group).bitwiseAND(F.lit((1 << group) - 1)).cast("int")
        part = F.shiftleft(F.get(table, part), i * group * (gap + 1))
        out = part if out is None else out.bitwiseOR(part)
    return out


def _spread3(c: Column) -> Column:
    """The low 21 bits with two zero bits after each."""
    return _spread(c.cast("bigint"), 2, 7, 3)


def _spread2(c: Column) -> Column:
    """The low 28 bits with a zero bit after each."""
    return _spread(c.cast("bigint"), 1, 7, 4)


def morton3(x: Column, y: Column, z: Column) -> Column:
    return _spread3(x).bitwiseOR(F.shiftleft(_spread3(y), 1)).bitwiseOR(F.shiftleft(_spread3(z), 2))


def morton2(x: Column, y: Column) -> Column:
    return _spread2(x).bitwiseOR(F.shiftleft(_spread2(y), 1))


def sphere(lat: Column, lon: Column, radius: float = RADIUS_M) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    return radius * F.cos(p) * F.cos(q), radius * F.cos(p) * F.sin(q), radius * F.sin(p)


def great_circle(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float = RADIUS_M) -> Column:
    a, b = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cube_edge(radius_m: float) -> float:
    """The smallest cube edge of the curve's levels that is at least twice the radius."""
    finest = 2 * RADIUS_M / 2**_BITS
    return finest * 2 ** max(0, math.ceil(math.log2(2 * radius_m / finest)))


def within_distance(df: DataFrame, point: str, lat: str, lon: str, radius_m: float, max_cell_rows: int = MAX_CELL_ROWS) -> DataFrame:
    """Each pair of points at most ``radius_m`` apart: <point>_a < <point>_b, distance_m."""
    edge = cube_edge(radius_m)
    at = df.select(F.col(point).alias("id"), usable_degrees(F.col(lat), -90, 90).alias("lat"), usable_degrees(F.col(lon), -180, 360).alias("lon"))
    at = at.dropna().distinct()
    axes = dict(zip("xyz", sphere(F.col("lat"), F.col("lon")), strict=True))
    at = at.select("id", "lat", "lon", *[(v + RADIUS_M).alias(k) for k, v in axes.items()])
    cell = lambda v: F.floor(v / edge).cast("bigint")
    home = at.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), morton3(*[cell(F.col(k)) for k in "xyz"]).alias("code_b"))
    # A chord is never longer than its arc; the half metre is room for rounding.
    touched = at.select("id", "lat", "lon", *[F.sequence(F.greatest(cell(F.col(k) - (radius_m + 0.5)), F.lit(0)), cell(F.col(k) + (radius_m + 0.5))).alias(f"s{k}") for k in "xyz"])
    for k in "xyz":
        touched = touched.withColumn(k, F.explode(f"s{k}")).drop(f"s{k}")
    disc = touched.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), morton3(F.col("x"), F.col("y"), F.col("z")).alias("code_a"))
    on = F.col("code_a") == F.col("code_b")
    full = home.groupBy(F.col("code_b").alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_cell_rows)
    if not full.isEmpty():
        full = full.select("hot", F.ceil(F.col("n") / max_cell_rows).cast("int").alias("parts"))
        n = F.coalesce("parts", F.lit(1))
        every = F.explode(F.sequence(F.lit(0), n - 1))
        own = lambda side: F.pmod(F.xxhash64(f"id_{side}", f"lat_{side}", f"lon_{side}"), n).cast("int")
        home = home.join(full, F.col("code_b") == F.col("hot"), "left").withColumn("point_b", own("b")).withColumn("disc_b", every).drop("hot", "parts")
        disc = disc.join(full, F.col("code_a") == F.col("hot"), "left").withColumn("disc_a", own("a")).withColumn("point_a", every).drop("hot", "parts")
        on = on & (F.col("point_a") == F.col("point_b")) & (F.col("disc_a") == F.col("disc_b"))
    pairs = disc.join(home, on & (F.col("id_a") < F.col("id_b")))
    far = great_circle(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return pairs.withColumn("distance_m", far).where(F.col("distance_m") <= radius_m).select(F.col("id_a").alias(f"{point}_a"), F.col("id_b").alias(f"{point}_b"), "distance_m")


_LEVELS = 24


def containing_region(points: DataFrame, point: str, lat: str, lon: str, boxes: DataFrame, region: str) -> DataFrame:
    """<point>, <region> for each box (lat_min, lat_max, lon_min, lon_max; low edges belong to it, high ones do
    not) that holds the point. A box with lon_min > lon_max crosses the date line."""
    wrapped = F.pmod(usable_degrees(F.col(lon), -180, 360) + 180.0, F.lit(360.0)) - 180.0
    at = points.select(F.col(point), usable_degrees(F.col(lat), -90, 90).alias("_lat"), wrapped.alias("_lon")).dropna().distinct()
    box = boxes.select(F.col(region), *[F.col(c).cast("double").alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")]).dropna()
    west = F.struct("lon_min", F.when(F.col("lon_min") > F.col("lon_max"), F.lit(180.0)).otherwise(F.col("lon_max")).alias("lon_max"))
    east = F.struct(F.lit(-180.0).alias("lon_min"), "lon_max")
    box = box.withColumn("_s", F.explode(F.when(F.col("lon_min") > F.col("lon_max"), F.array(west, east)).otherwise(F.array(west))))
    box = box.select(region, "lat_min", "lat_max", F.col("_s.lon_min").alias("lon_min"), F.col("_s.lon_max").alias("lon_max"))
    side = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min"), F.lit(1e-6))
    level = F.least(F.greatest(F.floor(F.log2(F.lit(360.0) / side)).cast("int"), F.lit(0)), F.lit(_LEVELS))
    step = lambda lv: F.lit(360.0) / F.pow(F.lit(2.0), lv)
    index = lambda v, low, lv: F.floor((v - low) / step(lv)).cast("bigint")
    box = box.withColumn("_level", level)
    box = box.withColumn("_x", F.explode(F.sequence(index(F.col("lon_min"), -180.0, F.col("_level")), index(F.col("lon_max"), -180.0, F.col("_level")))))
    box = box.withColumn("_y", F.explode(F.sequence(index(F.col("lat_min"), -90.0, F.col("_level")), index(F.col("lat_max"), -90.0, F.col("_level")))))
    box = box.withColumn("_code", morton2(F.col("_x"), F.col("_y")))
    levels = sorted(r[0] for r in box.select("_level").distinct().collect())  # at most 25
    codes = at.withColumn("_l", F.explode(F.array(*[F.lit(v) for v in levels]))) if levels else at.withColumn("_l", F.lit(0))
    codes = codes.withColumn("_c", morton2(index(F.col("_lon"), -180.0, F.col("_l")), index(F.col("_lat"), -90.0, F.col("_l"))))
    inside = (F.col("_lat") >= F.col("lat_min")) & (F.col("_lat") < F.col("lat_max")) & (F.col("_lon") >= F.col("lon_min")) & (F.col("_lon") < F.col("lon_max"))
    return codes.join(box, (F.col("_l") == F.col("_level")) & (F.col("_c") == F.col("_code")) & inside).select(point, region)
