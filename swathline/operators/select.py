"""Selections. Every time and place predicate is a plain comparison that reaches the scan.

Intervals differ by entry point of the domain's readers, so they are named: ``closed`` [a, b] for swaths,
``left`` [a, b) for cells, ``open`` (a, b) for periods and regions of interest. Missing values are selected by
none of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.operators.nearby import RADIUS_M, great_circle
from swathline.operators.sharding import last_before


class Bbox(NamedTuple):
    """Readers' order of a box."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


class Roi(NamedTuple):
    """Order of a region of interest."""

    lat_min: float
    lon_min: float
    lat_max: float
    lon_max: float


def between(c: Column, low, high, closed: str = "closed") -> Column:
    low, high = F.lit(low), F.lit(high)
    if closed == "closed":
        return (c >= low) & (c <= high)
    if closed == "left":
        return (c >= low) & (c < high)
    if closed == "open":
        return (c > low) & (c < high)
    raise ValueError(f"closed, left or open, not {closed!r}")


def in_period(df: DataFrame, start, end, time: str = "time", closed: str = "closed", margin_s: int = 0) -> DataFrame:
    """Rows of a period, widened by a margin on both sides (older swath lists take 900 seconds)."""
    kind = dict(df.dtypes)[time]
    margin = F.make_dt_interval(secs=F.lit(float(margin_s)))
    low, high = F.lit(str(start)).cast(kind), F.lit(str(end)).cast(kind)
    return df.where(between(F.col(time), low - margin if margin_s else low, high + margin if margin_s else high, closed))


def by_satellite(df: DataFrame, satellites: str, letter: str = "sat") -> DataFrame:
    """Rows of the satellites a file pattern names: ``A``, ``[AB]`` or ``*``; rows without a letter only for ``*``."""
    return df if satellites == "*" else df.where(F.col(letter).rlike(f"^{satellites}$"))


def contains_ids(df: DataFrame, group: str, ids: Sequence[int], key: str = "location_id") -> DataFrame:
    """Whether any of the ids occurs in each group (a file, say): group, found."""
    return df.groupBy(group).agg(F.coalesce(F.bool_or(F.col(key).isin(list(ids))), F.lit(False)).alias("found"))


def in_roi(df: DataFrame, roi: Roi, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(between(F.col(lat), roi.lat_min, roi.lat_max, "open") & between(F.col(lon), roi.lon_min, roi.lon_max, "open"))


def in_bbox(df: DataFrame, box: Bbox, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(between(F.col(lat), box.lat_min, box.lat_max) & between(F.col(lon), box.lon_min, box.lon_max))


def in_polygon(df: DataFrame, ring: Sequence[tuple[float, float]], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points inside a ring of (lon, lat); its box is tested first, so that the scan prunes. Even-odd rule."""
    pts = list(ring) if ring[0] == ring[-1] else [*ring, ring[0]]
    x, y = F.col(lon), F.col(lat)
    lons, lats = [p[0] for p in pts], [p[1] for p in pts]
    box = (x > min(lons)) & (x < max(lons)) & (y > min(lats)) & (y < max(lats))
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(pts, pts[1:], strict=False):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1)))
            crossings = crossings + crosses.cast("int")
    return df.where(box & (crossings % 2 == 1))


def by_ids(df: DataFrame, ids: DataFrame | Sequence[int], key: str = "location_id") -> DataFrame:
    """Rows of the given locations; ids that do not occur are no error."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias("_id")), F.col(key) == F.col("_id"), "left_semi")
    return df.where(F.col(key).isin(list(ids)))


def by_ids_in_order(df: DataFrame, ids: Sequence[int], key: str = "location_id", ignore_missing: bool = True) -> DataFrame:
    """Rows of the given locations with ``request_no``, the place of their id in the request."""
    asked = df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], "_id bigint, request_no int")
    if not ignore_missing and not missing_ids(df, ids, key).isEmpty():
        raise ValueError("some of the requested locations do not occur")
    return df.join(asked, F.col(key) == F.col("_id")).drop("_id")


def missing_ids(df: DataFrame, ids: Sequence[int], key: str = "location_id") -> DataFrame:
    asked = df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{key} bigint")
    have = df.select(F.col(key).alias("_have"))
    return asked.join(have, F.col(key) == F.col("_have"), "left_anti")


def by_cells(df: DataFrame, cells: Sequence[int], cell: str = "cell") -> DataFrame:
    """A partition filter on tables that are partitioned by cell."""
    return df.where(F.col(cell).isin(list(cells)))


def nearest(grid: DataFrame, coords: Sequence[tuple[float, float]], max_m: float = float("inf"), gpi: str = "gpi") -> DataFrame:
    """The nearest grid point of each (lon, lat) within ``max_m``: coord_no, gpi, distance_m; ties by the smaller id.

    The coordinates are literals of the request; each is one pre-aggregated minimum over the grid.
    """
    asked = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate(coords)])
    rows = grid.select(F.col(gpi).alias("gpi"), "lat", "lon", F.explode(asked).alias("c"))
    d = great_circle(F.col("lat"), F.col("lon"), F.col("c.y"), F.col("c.x"), RADIUS_M)
    best = rows.groupBy(F.col("c.no").alias("coord_no")).agg(F.min(F.struct(d.alias("distance_m"), F.col("gpi"))).alias("m"))
    out = best.select("coord_no", F.col("m.gpi").alias("gpi"), F.col("m.distance_m").alias("distance_m"))
    return out.where(F.col("distance_m") <= max_m) if max_m != float("inf") else out


def valid_range(c: Column, low: float, high: float) -> Column:
    """NULL outside [low, high]."""
    return F.when(between(c, low, high), c)


def any_beam(df: DataFrame, *beams: str) -> DataFrame:
    """Rows with at least one beam."""
    return df.where(F.coalesce(*beams).isNotNull())


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def drop_near_repeats(df: DataFrame, keys: Sequence[str], time_us: Column, window_s: float = 600.0, tie: str = "obs_id", span_s: int = 30 * 86400) -> DataFrame:
    """Rows less than ``window_s`` after the row before them (kept or not) in their group are dropped.

    Of rows of one time only the first by ``tie`` can stay, so times are made distinct first; the row before is
    then found by shards of ``span_s``, not by a window over the whole group. ``window_s`` must be positive.
    """
    one = first_by(df.withColumn("_t", time_us), [*keys, "_t"], [tie])
    rows = last_before(one, keys, "_t", {"_p": F.col("_t")}, span_s * 1_000_000)
    return rows.where(F.col("_p").isNull() | (F.col("_t") - F.col("_p") >= int(window_s * 1_000_000))).select(df.columns)
