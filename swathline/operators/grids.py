"""Grids as dimension tables, and values moved between grids."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swathline.functions.scalars import cell_number
from swathline.operators.nearby import cube_edge, morton3, sphere
from swathline.operators.sharding import last_before
from swathline.session import cut

#: Radius in metres of the sphere that neighbour searches use.
SEARCH_RADIUS_M = 6_370_997.0
#: Eccentricity squared of the WGS84 ellipsoid.
E2 = 6.69437999014e-3


def regular(spark: SparkSession, degrees: float) -> DataFrame:
    """Pixel centres of a regular grid: row, col, lat, lon, gpi."""
    rows, cols = round(180 / degrees), round(360 / degrees)
    g = spark.range(rows * cols).select(F.col("id").alias("gpi"), F.floor(F.col("id") / cols).cast("int").alias("row"), F.pmod("id", F.lit(cols)).cast("int").alias("col"))
    return g.select("gpi", "row", "col", (F.lit(90.0) - (F.col("row") + 0.5) * degrees).alias("lat"), (F.lit(-180.0) + (F.col("col") + 0.5) * degrees).alias("lon"))


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """A Fibonacci lattice of 2n + 1 points: gpi 0..n northwards of the equator, the rest southwards."""
    phi = (1 + math.sqrt(5)) / 2
    gpi = spark.range(2 * n + 1).select(F.col("id").alias("gpi"), F.when(F.col("id") > n, F.col("id") - (2 * n + 1)).otherwise(F.col("id")).alias("i"))
    turn = F.col("i") / phi
    lon = (turn - F.floor(turn)) * 360.0
    geocentric = F.asin(2 * F.col("i") / F.lit(float(2 * n + 1)))
    lat = F.degrees(F.atan(F.tan(geocentric) / (1 - E2)))
    g = gpi.select("gpi", F.when(lon >= 180, lon - 360).otherwise(lon).alias("lon"), lat.alias("lat"))
    return g.withColumn("cell", cell_number(F.col("lon"), F.col("lat")))


class GridRegistry:
    """Grids by name; a grid is made once and then kept."""

    def __init__(self) -> None:
        self._makers: dict[str, Callable[[SparkSession], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}

    def register(self, name: str, maker: Callable[[SparkSession], DataFrame]) -> None:
        self._makers[name] = maker
        self._made.pop(name, None)

    def get(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._made:
            if name in self._makers:
                self._made[name] = self._makers[name](spark)
            elif name.startswith("fibgrid_"):
                # 1,650,000 points north of the equator make 12.5 km; the spacing goes with the root.
                self._made[name] = fibonacci(spark, round(1_650_000 * (12.5 / float(name[8:])) ** 2))
            elif name.startswith("regular_"):
                self._made[name] = regular(spark, float(name[8:]))
            else:
                raise KeyError(name)
        return self._made[name]


def neighbours(targets: DataFrame, target: str, sources: DataFrame, source: str, k: int, radius_m: float) -> DataFrame:
    """The k nearest sources within the radius of each target: target, source, distance_m, rank (from 1).

    Both sides are points with ``lat`` and ``lon``. Candidates meet in space cubes of at least twice the radius;
    distances are chords; ties go to the smaller source id. Before the ranking, each target's candidates of a
    cube are cut to its k best where they meet.
    """
    if not 1 <= k <= 100:
        raise ValueError("neighbours from 1 to 100")
    edge = cube_edge(radius_m)
    off = SEARCH_RADIUS_M + edge
    xyz = lambda lat, lon: dict(zip("xyz", sphere(F.col(lat), F.col(lon), SEARCH_RADIUS_M), strict=True))
    t, s = xyz("lat", "lon"), xyz("lat", "lon")
    cell = lambda v: F.floor(v / edge).cast("bigint")
    left = targets.select(F.col(target).alias("_t"), *[t[a].alias(f"_t{a}") for a in "xyz"])
    for a in "xyz":
        left = left.withColumn(f"_c{a}", F.explode(F.sequence(cell(F.col(f"_t{a}") + off - radius_m), cell(F.col(f"_t{a}") + off + radius_m))))
    left = left.withColumn("_code", morton3(F.col("_cx"), F.col("_cy"), F.col("_cz")))
    right = sources.select(F.col(source).alias("_s"), *[s[a].alias(f"_s{a}") for a in "xyz"])
    right = right.withColumn("_home", morton3(*[cell(F.col(f"_s{a}") + off) for a in "xyz"]))
    d2 = F.pow(F.col("_tx") - F.col("_sx"), 2) + F.pow(F.col("_ty") - F.col("_sy"), 2) + F.pow(F.col("_tz") - F.col("_sz"), 2)
    near = left.join(right, F.col("_code") == F.col("_home")).withColumn("distance_m", F.sqrt(d2)).where(F.col("distance_m") <= radius_m)
    w = Window.partitionBy("_t").orderBy("distance_m", "_s")
    best = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("_t").alias(target), F.col("_s").alias(source), "distance_m", "rank")


def lookup_table(targets: DataFrame, target: str, sources: DataFrame, source: str) -> DataFrame:
    """The nearest source of every target at any distance: rings of growing radius until all are served."""
    left, out, radius = targets, None, 50_000.0
    while True:
        got = cut(neighbours(left, target, sources, source, 1, radius).select(target, source))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(F.col(target).alias("_done")), F.col(target) == F.col("_done"), "left_anti")
        if radius > 2 * SEARCH_RADIUS_M or left.isEmpty():
            return out
        radius *= 6


def stored_lookup_table(path: str, targets: DataFrame, target: str, sources: DataFrame, source: str) -> DataFrame:
    """The lookup table kept at ``path``; made and written there the first time (a writer that fails leaves no table:
    only a folder with Spark's mark of success is read)."""
    spark = targets.sparkSession
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        lookup_table(targets, target, sources, source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def regrid(lut: DataFrame, target: str, source: str, obs: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """The last observation of each target's source; targets without one are NULL."""
    last = obs.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return lut.join(last, F.col(source) == F.col("_k"), "left").select(target, source, *[F.col(f"_v.{v}").alias(v) for v in values])


def resample(targets: DataFrame, target: str, obs: DataFrame, obs_id: str, methods: Mapping[str, str], k: int = 6, radius_m: float = 10_000.0) -> DataFrame:
    """Values of the k nearest observations at the targets, by variable: ``nn`` nearest, ``idw`` inverse squared
    distance (an exact hit is its value), ``bitwise_or`` (0 without neighbours)."""
    if not 1000 <= radius_m <= 100_000:
        raise ValueError("radius from 1000 to 100000 m")
    near = neighbours(targets, target, obs, obs_id, k, radius_m)
    values = obs.select(F.col(obs_id).alias("_o"), *methods)
    rows = near.join(values, F.col(obs_id) == F.col("_o"))
    return resample_values(targets, target, rows, methods)


def resample_values(targets: DataFrame, target: str, rows: DataFrame, methods: Mapping[str, str]) -> DataFrame:
    d, aggs = F.col("distance_m"), []
    for v, how in methods.items():
        c = F.col(v)
        if how == "nn":
            aggs.append(F.min_by(F.struct(c), F.col("rank")).getField(v).alias(v))
        elif how == "idw":
            w = 1 / F.pow(d, 2)
            exact = F.min_by(c, F.when((d == 0) & c.isNotNull(), F.col("rank")))
            far = (d > 0) & c.isNotNull()
            aggs.append(F.coalesce(exact, F.sum(F.when(far, c * w)) / F.sum(F.when(far, w))).alias(v))
        elif how == "bitwise_or":
            aggs.append(F.bit_or(c).alias(v))
        else:
            raise ValueError(f"nn, idw or bitwise_or, not {how!r}")
    got = rows.groupBy(F.col(target).alias("_t")).agg(*aggs)
    out = targets.select(target).join(got, F.col(target) == F.col("_t"), "left").drop("_t")
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v, how in methods.items() if how == "bitwise_or"})


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, max_us: int | None = None, slot_us: int = 86_400_000_000) -> DataFrame:
    """Each left row with the right row of its key nearest in time (the earlier one on ties): ``matched_time``, ``value``.

    Right rows of one time are one (the smallest value). Both sides become one series per key, in which the last
    right row before and the first one after each left row come from sharded scans: no pairs are made, and no
    task holds a whole key. Left rows without key or time, or without a partner, have NULL.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    r = right.select(F.col(key).alias("_k"), us(right_time).alias("_t"), F.col(value).alias("_v")).dropna(subset=["_k", "_t"]).groupBy("_k", "_t").agg(F.min("_v").alias("_v"))
    lft = left.select(F.col(key).alias("_k"), us(left_time).alias("_t"), F.struct(*left.columns).alias("_row"))
    both = lft.unionByName(r.withColumn("_is", F.lit(0)), allowMissingColumns=True).withColumn("_is", F.coalesce("_is", F.lit(1)))
    mark = F.when(F.col("_is") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    both = last_before(both.withColumn("_o", F.col("_t") * 2 + F.col("_is")), ["_k"], "_o", {"_b": mark}, 2 * slot_us)
    both = last_before(both.withColumn("_o", F.col("_is") - F.col("_t") * 2), ["_k"], "_o", {"_a": mark}, 2 * slot_us)
    near = F.array_min(F.transform(F.array_compact(F.array("_b", "_a")), lambda p: F.struct(F.abs(p["t"] - F.col("_t")).alias("d"), p["t"].alias("t"), p["v"].alias("v"))))
    out = both.where("_is = 1").withColumn("_n", near)
    keep = F.lit(True) if max_us is None else F.col("_n.d") <= max_us
    name = value if value not in left.columns else f"matched_{value}"
    return out.select("_row.*", F.when(keep, F.timestamp_micros(F.col("_n.t")).cast("timestamp_ntz")).alias("matched_time"), F.when(keep, F.col("_n.v")).alias(name))


def with_static(df: DataFrame, static: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """Static layers by key expressions, e.g. grid point and day of year."""
    on = F.lit(True)
    for name, c in keys.items():
        on = on & (c == F.col(f"_s_{name}"))
    right = static.select(*[F.col(k).alias(f"_s_{k}") for k in keys], *[c for c in static.columns if c not in keys])
    return df.join(right, on, "left").drop(*[f"_s_{k}" for k in keys])
