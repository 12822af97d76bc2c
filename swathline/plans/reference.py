"""One query per operator over the shared tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions import flags, nulls, scalars
from swathline.operators import aggregate as agg
from swathline.operators import compact, convert, grids, records, select, stack
from swathline.plans.problems import table
from swathline.sources import catalog, formats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _value(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND abs({c}::DOUBLE) <= 1e37 AND {c}::DOUBLE <> -999999 THEN {c}::DOUBLE END"


BASE = f"""WITH o AS (
  SELECT obs_id, batch_id, collection_id, location_id, cell, "time", sat_id, as_des_pass::INT AS pass, proc_flag1, {_value('f_backscatter')} AS f,
    {_value('m_backscatter')} AS m, {_value('a_backscatter')} AS a, {_value('sig40_noise')} AS noise, {_value('surface_soil_moisture')} AS ssm
  FROM observations WHERE location_id IS NOT NULL AND "time" IS NOT NULL AND "time" <> TIMESTAMP '1970-01-01'),
g AS (SELECT location_id AS gpi, lat, CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS lon, cell FROM locations
  WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360 AND NOT isnan(lat) AND NOT isnan(lon)),
og AS (SELECT o.*, g.lat, g.lon FROM o JOIN g ON location_id = gpi)
"""


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Canonical observations: usable time and place, every missing code NULL."""
    r = lambda c: nulls.reading(F.col(c))
    df = table(spark, d, "observations").where(F.col("location_id").isNotNull() & (F.col("time") != nulls.EPOCH()))
    # Columns that are filtered on stay as stored, so that predicates reach the scan.
    return df.select(
        "obs_id", "batch_id", "collection_id", "location_id", "cell", "time", "sat_id", F.col("as_des_pass").cast("int").alias("pass"), "proc_flag1",
        r("f_backscatter").alias("f"), r("m_backscatter").alias("m"), r("a_backscatter").alias("a"), r("sig40_noise").alias("noise"), r("surface_soil_moisture").alias("ssm"))
def grid(spark: SparkSession, d: str) -> DataFrame:
    """The locations as a grid: gpi, lat, lon in [-180, 180), cell."""
    from swathline.operators.nearby import usable_degrees

    g = table(spark, d, "locations").select(F.col("location_id").alias("gpi"), usable_degrees(F.col("lat"), -90, 90).alias("lat"), usable_degrees(F.col("lon"), -180, 360).alias("_l"), "cell")
    return g.dropna(subset=["lat", "_l"]).select("gpi", "lat", scalars.wrap_longitude(F.col("_l")).alias("lon"), "cell")


def placed(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).join(grid(spark, d).drop("cell"), F.col("location_id") == F.col("gpi")).drop("gpi")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = BASE + sql
        return f

    return keep


def us(c: str = "time"):
    return nulls.micros(F.col(c))


# --- selection ----------------------------------------------------------------------------------------------

for _name, _closed, _a, _b in (("select_time_closed", "closed", ">=", "<="), ("select_time_half_open", "left", ">=", "<"), ("select_time_open_toi", "open", ">", "<")):
    query(_name, f"SELECT obs_id, \"time\" FROM o WHERE \"time\" {_a} TIMESTAMP '2007-01-10' AND \"time\" {_b} TIMESTAMP '2007-01-20 12:00:00'")(
        lambda s, d, c=_closed: select.in_period(obs(s, d), "2007-01-10 00:00:00", "2007-01-20 12:00:00", closed=c).select("obs_id", "time"))
query("select_roi_open", "SELECT obs_id FROM og WHERE lat > -40 AND lat < 55 AND lon > -100 AND lon < 100")(
    lambda s, d: select.in_roi(placed(s, d), select.Roi(-40, -100, 55, 100)).select("obs_id"))
query("select_bbox", "SELECT gpi, lat, lon FROM g WHERE lat BETWEEN -45 AND 60 AND lon BETWEEN -20 AND 140")(
    lambda s, d: select.in_bbox(grid(s, d), select.Bbox(-45, 60, -20, 140)).select("gpi", "lat", "lon"))
query("select_ids_semi", "SELECT obs_id FROM o WHERE location_id IN (SELECT location_id FROM locations WHERE row_size > 100)")(
    lambda s, d: select.by_ids(obs(s, d), table(s, d, "locations").where("row_size > 100").select("location_id")).select("obs_id"))
query("select_cells", "SELECT obs_id, cell FROM o WHERE cell IN (1395, 2386, 379)")(lambda s, d: select.by_cells(obs(s, d), [1395, 2386, 379]).select("obs_id", "cell"))
_RING = [(-120.0, -50.0), (20.0, -70.0), (150.0, 10.0), (60.0, 75.0), (-60.0, 40.0)]


def _ring_sql() -> str:
    pts = [*_RING, _RING[0]]
    parts = [f"(CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < {x1} + (lat - {y1}) * {(x2 - x1) / (y2 - y1)!r} THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in zip(pts, pts[1:], strict=False) if y1 != y2]
    return " + ".join(parts)


query("select_polygon", f"SELECT gpi FROM g WHERE ({_ring_sql()}) % 2 = 1")(lambda s, d: select.in_polygon(grid(s, d), _RING).select("gpi"))
_CHORD = "sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)+(z1-z2)*(z1-z2))"
query("select_nearest_coord", """, c(coord_no, y, x) AS (VALUES (0, 48.2, 16.4), (1, -33.9, 18.4), (2, 89.0, -170.0)),
r AS (SELECT coord_no, gpi, 2 * 6371000 * asin(sqrt(least(1.0, sin(radians(y - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(y)) * sin(radians(x - lon) / 2) ** 2))) AS dist FROM g, c)
SELECT coord_no, gpi, round(dist, 2) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY coord_no ORDER BY dist, gpi) AS n FROM r) WHERE n = 1""")(
    lambda s, d: select.nearest(grid(s, d), [(16.4, 48.2), (18.4, -33.9), (-170.0, 89.0)]).select("coord_no", "gpi", F.round("distance_m", 2).alias("distance_m")))
_IDS = [92594, 10761, 46230, 5, 10761]
query("select_ids_request_order", "SELECT obs_id, CASE location_id WHEN 92594 THEN 0 WHEN 10761 THEN 1 WHEN 46230 THEN 2 ELSE 3 END AS request_no FROM o WHERE location_id IN (92594, 10761, 46230, 5)")(
    lambda s, d: select.by_ids_in_order(obs(s, d), _IDS).select("obs_id", "request_no"))
query("select_ids_missing_report", "SELECT v.location_id FROM (VALUES (92594), (10761), (46230), (5)) v(location_id) WHERE v.location_id NOT IN (SELECT location_id FROM o)")(
    lambda s, d: select.missing_ids(obs(s, d), _IDS))
query("valid_range_mask", "SELECT obs_id, CASE WHEN f BETWEEN -25 AND -10 THEN f END AS f FROM o")(lambda s, d: obs(s, d).select("obs_id", select.valid_range(F.col("f"), -25, -10).alias("f")))
query("search_period_prune", r"""SELECT file_id, file_time FROM (SELECT file_id, try_strptime(nullif(regexp_extract(file_name, '([0-9]{14})', 1), ''), '%Y%m%d%H%M%S') AS file_time FROM swath_files)
WHERE file_time >= TIMESTAMP '2007-01-10' AND file_time < TIMESTAMP '2007-01-21'""")(
    lambda s, d: catalog.prune_period(table(s, d, "swath_files"), "file_name", "2007-01-10 00:00:00", "2007-01-20 00:00:00").select("file_id", "file_time"))
query("drop_all_beams_missing", "SELECT obs_id FROM o WHERE f IS NOT NULL OR m IS NOT NULL OR a IS NOT NULL")(lambda s, d: select.any_beam(obs(s, d), "f", "m", "a").select("obs_id"))


@query("dedupe_window", """, u AS (SELECT *, lag("time") OVER (PARTITION BY sat_id, location_id ORDER BY "time", obs_id) AS p FROM o)
SELECT obs_id FROM u WHERE p IS NULL OR epoch_us("time") - epoch_us(p) >= 600000000""")
def dedupe_window(s, d):
    return select.drop_near_repeats(obs(s, d), ["sat_id", "location_id"], us()).select("obs_id")


# --- representations ----------------------------------------------------------------------------------------


def _points(s, d):
    return obs(s, d).select("location_id", "cell", "time", "obs_id", "f")


_RANK = ", r AS (SELECT location_id, (row_number() OVER (ORDER BY location_id) - 1)::INT AS location_index FROM (SELECT DISTINCT location_id FROM o))"
query("point_to_indexed_obs", _RANK + " SELECT obs_id, location_index FROM o JOIN r USING (location_id)")(
    lambda s, d: convert.to_indexed(_points(s, d), "location_id", ["cell"], ["obs_id"])[0].select("obs_id", "location_index"))
query("point_to_indexed_locations", _RANK + " SELECT location_id, location_index, arg_min(cell, obs_id) AS cell FROM o JOIN r USING (location_id) GROUP BY ALL")(
    lambda s, d: convert.to_indexed(_points(s, d), "location_id", ["cell"], ["obs_id"])[1])


def _series(s, d):
    return convert.to_contiguous(_points(s, d), "location_id", ["time", "obs_id", "f"], ["time"])


query("point_to_contiguous_sizes", "SELECT location_id, count(*) AS row_size FROM o GROUP BY ALL")(lambda s, d: _series(s, d).select("location_id", "row_size"))
query("point_to_contiguous_order", 'SELECT obs_id, row_number() OVER (PARTITION BY location_id ORDER BY "time", obs_id) - 1 AS pos FROM o')(
    lambda s, d: _series(s, d).select(F.posexplode("series").alias("pos", "p")).select(F.col("p.obs_id").alias("obs_id"), F.col("pos").cast("bigint").alias("pos")))
query("contiguous_to_point", 'SELECT location_id, "time", obs_id, f FROM o')(lambda s, d: convert.contiguous_to_point(_series(s, d)))
query("contiguous_offsets", "SELECT location_id, n AS row_size, coalesce(sum(n) OVER (ORDER BY location_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_start FROM (SELECT location_id, count(*) AS n FROM o GROUP BY ALL)")(
    lambda s, d: convert.offsets(_series(s, d), "location_id"))


@query("contiguous_trim_time_sizes", "SELECT location_id, count(*) FILTER (\"time\" >= TIMESTAMP '2007-02-01' AND \"time\" < TIMESTAMP '2007-02-10') AS row_size FROM o GROUP BY ALL")
def contiguous_trim(s, d):
    a, b = F.lit("2007-02-01 00:00:00").cast("timestamp_ntz"), F.lit("2007-02-10 00:00:00").cast("timestamp_ntz")
    return convert.trim_series(_series(s, d), lambda p: (p["time"] >= a) & (p["time"] < b)).select("location_id", F.col("row_size").cast("bigint").alias("row_size"))


@query("indexed_to_contiguous_empty_instances", "SELECT g.gpi AS location_id, count(obs_id) AS row_size FROM g LEFT JOIN o ON gpi = location_id GROUP BY ALL")
def indexed_to_contiguous(s, d):
    g = grid(s, d).select(F.col("gpi").alias("location_id")).distinct()
    index = convert.ranked(g, "location_id")
    o = _points(s, d).join(index.withColumnRenamed("location_id", "_k"), F.col("location_id") == F.col("_k")).drop("_k", "location_id", "cell")
    return convert.indexed_to_contiguous(o, index, ["time", "obs_id", "f"], ["time"]).select("location_id", "row_size")


@query("indexed_to_point", "SELECT obs_id, location_id, arg_min(cell, obs_id) OVER (PARTITION BY location_id) AS cell FROM o")
def indexed_to_point(s, d):
    return convert.indexed_to_point(*convert.to_indexed(_points(s, d), "location_id", ["cell"], ["obs_id"])).select("obs_id", "location_id", "cell")


query("contiguous_to_indexed", _RANK + " SELECT obs_id, location_index FROM o JOIN r USING (location_id)")(
    lambda s, d: convert.contiguous_to_indexed(_series(s, d), "location_id")[0].select("obs_id", "location_index"))


def _padded(s, d):
    return convert.to_incomplete(_series(s, d), ["obs_id", "f"], {"obs_id": F.lit(-1).cast("bigint"), "f": F.lit(-999999.0)})


query("to_incomplete_long", """, n AS (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM o GROUP BY location_id)),
p AS (SELECT location_id, obs_id, f, row_number() OVER (PARTITION BY location_id ORDER BY "time", obs_id) - 1 AS pos FROM o),
x AS (SELECT DISTINCT location_id, unnest(range(n)) AS pos FROM o, n)
SELECT x.location_id, x.pos, CASE WHEN p.pos IS NULL THEN -1 ELSE obs_id END AS obs_id, CASE WHEN p.pos IS NULL THEN -999999.0 ELSE f END AS f FROM x LEFT JOIN p ON x.location_id = p.location_id AND x.pos = p.pos""")(
    lambda s, d: _padded(s, d).select("location_id", F.posexplode(F.arrays_zip("obs_id", "f")).alias("pos", "p")).select("location_id", F.col("pos").cast("bigint").alias("pos"), F.col("p.obs_id").alias("obs_id"), F.col("p.f").alias("f")))
query("incomplete_to_contiguous", "SELECT location_id, count(*) AS row_size FROM o GROUP BY ALL")(
    lambda s, d: convert.incomplete_to_contiguous(_padded(s, d), ["obs_id", "f"], lambda v: v == -1).select("location_id", "row_size"))


def _daily(s, d):
    return obs(s, d).select("location_id", F.to_date("time").alias("day"), "time", "obs_id", "f")


_DENSE = """, l AS (SELECT location_id, "time"::DATE AS day, max_by(f, ("time", obs_id)) AS v FROM o GROUP BY ALL),
e AS (SELECT location_id, day FROM (SELECT DISTINCT location_id FROM l), (SELECT DISTINCT day FROM l))"""
_DENSE = """, k AS (SELECT location_id, "time"::DATE AS day, f, row_number() OVER (PARTITION BY location_id, "time"::DATE ORDER BY "time" DESC, obs_id DESC) AS n FROM o),
l AS (SELECT location_id, day, f FROM k WHERE n = 1),
e AS (SELECT location_id, day FROM (SELECT DISTINCT location_id FROM l), (SELECT DISTINCT day FROM l))"""
query("to_orthogonal_long", _DENSE + " SELECT location_id, day, f FROM e LEFT JOIN l USING (location_id, day)")(
    lambda s, d: convert.to_orthogonal(_daily(s, d), "location_id", "day", ["f"], ["time", "obs_id"], strict=False))
query("orthogonal_to_contiguous", _DENSE + " SELECT location_id, count(*) AS row_size FROM e GROUP BY ALL")(
    lambda s, d: convert.to_contiguous(convert.to_orthogonal(_daily(s, d), "location_id", "day", ["f"], ["time", "obs_id"], strict=False), "location_id", ["day", "f"], ["day"]).select("location_id", "row_size"))
query("to_raster", "SELECT \"time\"::DATE AS day, max(f) FILTER (sat_id = 3) AS \"3\", max(f) FILTER (sat_id = 4) AS \"4\", max(f) FILTER (sat_id = 5) AS \"5\" FROM o WHERE sat_id IN (3, 4, 5) GROUP BY ALL")(
    lambda s, d: convert.to_raster(obs(s, d).where("sat_id IN (3, 4, 5)").withColumn("day", F.to_date("time")), "day", "sat_id", [3, 4, 5], "f"))
query("merge_union", """SELECT 'o' AS origin, obs_id AS id, location_id, f AS v, NULL::DOUBLE AS alt FROM o
UNION ALL SELECT 'e', ers_id, location_id, fore_backscatter::DOUBLE, CASE WHEN NOT isnan(alt) AND alt::DOUBLE < 999999 AND alt::DOUBLE > -2147483600 THEN alt::DOUBLE END FROM ers_cells""")(
    lambda s, d: stack.merge([
        obs(s, d).select(F.lit("o").alias("origin"), F.col("obs_id").alias("id"), "location_id", F.col("f").alias("v")),
        table(s, d, "ers_cells").select(F.lit("e").alias("origin"), F.col("ers_id").alias("id"), "location_id", F.col("fore_backscatter").cast("double").alias("v"), nulls.height(F.col("alt")).alias("alt"))]))
query("merge_locations_first_wins", ", x AS (SELECT location_id, cell, 0 AS src, obs_id AS n FROM o UNION ALL SELECT location_id, cell, 1, ers_id FROM ers_cells WHERE location_id IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY src, n) AS k FROM x) SELECT location_id, cell, src, n FROM y WHERE k = 1")(
    lambda s, d: select.first_by(stack.merge([obs(s, d).select("location_id", "cell", F.lit(0).alias("src"), F.col("obs_id").alias("n")), table(s, d, "ers_cells").dropna(subset=["location_id"]).select("location_id", "cell", F.lit(1).alias("src"), F.col("ers_id").alias("n"))]), ["location_id"], ["src", "n"]))


@query("append_reindex", ", x AS (SELECT obs_id AS id, location_id FROM o UNION ALL SELECT ers_id, location_id FROM ers_cells), r AS (SELECT location_id, (row_number() OVER (ORDER BY location_id) - 1)::INT AS location_index FROM (SELECT DISTINCT location_id FROM x)) SELECT id, location_index FROM x JOIN r USING (location_id)")
def append_reindex(s, d):
    one = convert.to_indexed(obs(s, d).select("location_id", "cell", F.col("obs_id").alias("id")), "location_id", ["cell"], ["id"])
    two = convert.to_indexed(table(s, d, "ers_cells").select("location_id", "cell", F.col("ers_id").alias("id")), "location_id", ["cell"], ["id"])
    return convert.append(*one, *two, "location_id")[0].select("id", "location_index")


# --- stacking -----------------------------------------------------------------------------------------------

query("stack_cell_counts", "SELECT g.cell, count(*) AS n_obs, count(DISTINCT location_id) AS n_locations FROM o JOIN g ON location_id = gpi GROUP BY ALL")(lambda s, d: stack.stacked_counts(stack.with_cell(obs(s, d), grid(s, d))))
query("retile_cell_lookup", "SELECT DISTINCT (least(floor((lon + 180) / 10), 35) * 18 + least(floor((lat + 90) / 10), 17))::INT AS new_cell, cell AS old_cell FROM g")(lambda s, d: stack.retile(grid(s, d), 10))
query("grid_cell_number", "SELECT gpi, (least(floor((lon + 180) / 5), 71) * 36 + least(floor((lat + 90) / 5), 35))::INT AS cell FROM g")(lambda s, d: grid(s, d).select("gpi", scalars.cell_number(F.col("lon"), F.col("lat")).alias("cell")))
query("lonlat_from_grid", "SELECT obs_id, lat, lon FROM og")(lambda s, d: placed(s, d).select("obs_id", "lat", "lon"))


@query("stack_write_read_cells", "SELECT g.cell, count(*) AS n_obs, count(DISTINCT location_id) AS n_locations FROM o JOIN g ON location_id = gpi GROUP BY ALL")
def stack_write_read(s, d):
    from swathline.session import scratch_path

    path = scratch_path(s, "cells")
    stack.write_cells(stack.with_cell(obs(s, d), grid(s, d)), path)
    return stack.stacked_counts(stack.read_cells(s, path))


# --- aggregation --------------------------------------------------------------------------------------------

_AGG = {"mean": "round(avg(ssm), 6)", "std": "round(stddev_pop(ssm), 6)", "min": "min(ssm)", "max": "max(ssm)", "median": "round(median(ssm), 6)", "quantile": "round(quantile_cont(ssm, 0.25), 6)", "count": "count(ssm)", "sum": "round(sum(ssm), 4)"}
for _how, _sql in _AGG.items():
    query(f"agg_{_how}", f"SELECT location_id, {_sql} AS ssm FROM o GROUP BY ALL")(
        lambda s, d, h=_how: agg.by_step(obs(s, d), ["location_id"], ["ssm"], h, F.struct("time", "obs_id"), **({"q": 0.25} if h == "quantile" else {})).withColumn("ssm", F.col("ssm") if h in ("min", "max", "count") else F.round("ssm", 4 if h == "sum" else 6)))
for _how, _sql in {"first": '"time", obs_id', "last": '"time" DESC, obs_id DESC'}.items():
    query(f"agg_{_how}", f", k AS (SELECT location_id, ssm, row_number() OVER (PARTITION BY location_id ORDER BY ssm IS NULL, {_sql}) AS n FROM o) SELECT location_id, ssm FROM k WHERE n = 1")(
        lambda s, d, h=_how: agg.by_step(obs(s, d), ["location_id"], ["ssm"], h, F.struct("time", "obs_id")))
for _how, _sql in {"argmin": "ssm", "argmax": "-ssm"}.items():
    query(f"agg_{_how}", f', k AS (SELECT location_id, CASE WHEN ssm IS NOT NULL THEN obs_id END AS ssm, row_number() OVER (PARTITION BY location_id ORDER BY ssm IS NULL, {_sql}, "time", obs_id) AS n FROM o) SELECT location_id, ssm FROM k WHERE n = 1')(
        lambda s, d, h=_how: agg.by_step(obs(s, d), ["location_id"], ["ssm"], h, F.struct("time", "obs_id"), position=F.col("obs_id")))
query("agg_mode", ", k AS (SELECT location_id, ssm, count(*) AS n FROM o WHERE ssm IS NOT NULL GROUP BY ALL), j AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY n DESC, ssm) AS k FROM k) SELECT location_id, ssm FROM j WHERE k = 1")(
    lambda s, d: agg.mode(obs(s, d), ["location_id"], "ssm"))

_QUALITY = """, q AS (SELECT *, (obs_id * 37) % 100 AS frozen, CASE WHEN obs_id % 10 = 0 THEN NULL ELSE (obs_id * 17) % 100 END AS snow, (obs_id * 7) % 20 AS subsurface, (obs_id % 13) / 4.0 AS sens, CASE WHEN obs_id % 11 = 0 THEN 1 WHEN obs_id % 29 = 0 THEN NULL ELSE 0 END AS flag FROM o),
v AS (SELECT *, CASE WHEN coalesce(frozen > 80, false) OR coalesce(snow > 80, false) OR subsurface > 5 OR sens < 1 THEN NULL ELSE ssm END AS good FROM q WHERE flag = 0)"""


def _quality(s, d):
    o = F.col("obs_id")
    df = obs(s, d).withColumns({
        "frozen": F.pmod(o * 37, F.lit(100)), "snow": F.when(o % 10 != 0, F.pmod(o * 17, F.lit(100))), "subsurface": F.pmod(o * 7, F.lit(20)),
        "sens": (o % 13) / 4.0, "flag": F.when(o % 11 == 0, 1).when(o % 29 != 0, 0)})
    return agg.masked(df, "ssm", agg.Masks(80, 80, 5, 1), "frozen", "snow", "subsurface", "sens", "flag")


_START, _END, _DAY = 1167782400000000, 1170374400000000, 86400000000  # 2007-01-03 and 2007-02-02


@query("agg_masked_by_step", _QUALITY + f"SELECT location_id, floor((epoch_us(\"time\") - {_START}) / {_DAY})::BIGINT AS step_no, round(avg(good), 6) AS ssm, round(avg(f), 6) AS f FROM v WHERE epoch_us(\"time\") >= {_START} AND epoch_us(\"time\") < {_END} GROUP BY ALL")
def agg_masked_by_step(s, d):
    steps = agg.time_steps(_quality(s, d), us(), _START, _DAY, _END)
    return agg.by_step(steps, ["location_id", "step_no"], ["ssm", "f"], "mean", F.struct("time", "obs_id")).withColumns({"ssm": F.round("ssm", 6), "f": F.round("f", 6)})


@query("agg_masked_by_step_compat", _QUALITY + f", n AS (SELECT unnest(range(0, {(_END - _START) // _DAY + 1})) AS step_no) SELECT location_id, step_no, count(*) AS n FROM v JOIN n ON epoch_us(\"time\") >= {_START} + step_no * {_DAY} AND epoch_us(\"time\") <= {_START} + (step_no + 1) * {_DAY} GROUP BY ALL")
def agg_masked_compat(s, d):
    return agg.time_steps(_quality(s, d), us(), _START, _DAY, _END, compat=True).groupBy("location_id", "step_no").agg(F.count(F.lit(1)).alias("n"))


query("agg_location_hour", 'SELECT location_id, hour("time") AS hour, round(avg(ssm), 6) AS ssm FROM o GROUP BY ALL')(
    lambda s, d: obs(s, d).groupBy("location_id", F.hour("time").alias("hour")).agg(F.round(F.avg("ssm"), 6).alias("ssm")))
query("agg_by_date", 'SELECT "time"::DATE AS day, round(avg(ssm), 6) AS ssm, count(*) AS n FROM o GROUP BY ALL')(
    lambda s, d: obs(s, d).groupBy(F.to_date("time").alias("day")).agg(F.round(F.avg("ssm"), 6).alias("ssm"), F.count(F.lit(1)).alias("n")))
query("climatology_doy", 'SELECT location_id, dayofyear("time") AS doy, round(avg(ssm), 6) AS ssm FROM o GROUP BY ALL')(
    lambda s, d: obs(s, d).groupBy("location_id", F.dayofyear("time").alias("doy")).agg(F.round(F.avg("ssm"), 6).alias("ssm")))
query("daily_then_hourly_mean", ', h AS (SELECT "time"::DATE AS day, hour("time") AS hour, avg(ssm) AS v FROM o GROUP BY ALL) SELECT hour, round(avg(v), 6) AS ssm FROM h GROUP BY ALL')(
    lambda s, d: agg.nested_mean(obs(s, d).withColumns({"day": F.to_date("time"), "hour": F.hour("time")}), ["day", "hour"], ["hour"], "ssm").withColumn("ssm", F.round("ssm", 6)))
query("resample_month_end", 'SELECT location_id, last_day("time"::DATE) AS period_end, round(avg(ssm), 6) AS ssm FROM o GROUP BY ALL')(
    lambda s, d: agg.by_calendar(obs(s, d), ["location_id"], "time", "month", "ssm").withColumn("ssm", F.round("ssm", 6)))


@query("agg_mean_with_grid", "SELECT location_id, any_value(lat) AS lat, any_value(lon) AS lon, round(avg(ssm), 6) AS ssm FROM og GROUP BY location_id")
def agg_mean_with_grid(s, d):
    m = agg.by_step(obs(s, d), ["location_id"], ["ssm"], "mean", F.struct("time", "obs_id"))
    return m.join(grid(s, d), F.col("location_id") == F.col("gpi")).select("location_id", "lat", "lon", F.round("ssm", 6).alias("ssm"))


# --- grids --------------------------------------------------------------------------------------------------

_R = grids.SEARCH_RADIUS_M
_XYZ = lambda lat, lon, n: f"{_R} * cos(radians({lat})) * cos(radians({lon})) AS x{n}, {_R} * cos(radians({lat})) * sin(radians({lon})) AS y{n}, {_R} * sin(radians({lat})) AS z{n}"
_TARGETS = f""", t AS (SELECT gpi AS target, {_XYZ('CASE WHEN lat < 89 THEN lat + 0.1 ELSE lat END', 'lon', 1)} FROM g),
w AS (SELECT location_id, avg(ssm) AS ssm, avg(f) AS f, bit_or(proc_flag1)::BIGINT AS flags FROM o GROUP BY ALL),
u AS (SELECT w.*, {_XYZ('lat', 'lon', 2)} FROM w JOIN g ON location_id = gpi),
n AS (SELECT target, location_id, ssm, f, flags, {_CHORD} AS dist FROM t, u WHERE abs(z1 - z2) <= 100000),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY dist, location_id) AS rank FROM n WHERE dist <= 100000),
b AS (SELECT * FROM k WHERE rank <= 4)
"""


def _targets(s, d):
    return grid(s, d).select(F.col("gpi").alias("target"), F.when(F.col("lat") < 89, F.col("lat") + 0.1).otherwise(F.col("lat")).alias("lat"), "lon")


def _sources(s, d):
    m = obs(s, d).groupBy("location_id").agg(F.avg("ssm").alias("ssm"), F.avg("f").alias("f"), F.bit_or("proc_flag1").cast("bigint").alias("flags"))
    return m.join(grid(s, d), F.col("location_id") == F.col("gpi")).drop("gpi", "cell")


query("resample_neighbours", _TARGETS + "SELECT target, location_id, rank::INT AS rank, round(dist, 3) AS distance_m FROM b")(
    lambda s, d: grids.neighbours(_targets(s, d), "target", _sources(s, d), "location_id", 4, 100_000).withColumn("distance_m", F.round("distance_m", 3)))
query("resample_nn", _TARGETS + "SELECT t.target, round(b.ssm, 6) AS ssm FROM t LEFT JOIN b ON t.target = b.target AND rank = 1")(
    lambda s, d: grids.resample(_targets(s, d), "target", _sources(s, d), "location_id", {"ssm": "nn"}, 4, 100_000).withColumn("ssm", F.round("ssm", 6)))
query("resample_idw", _TARGETS + "SELECT t.target, round(sum(b.f / (dist * dist)) / sum(CASE WHEN b.f IS NOT NULL THEN 1 / (dist * dist) END), 5) AS f FROM t LEFT JOIN b ON t.target = b.target GROUP BY t.target")(
    lambda s, d: grids.resample(_targets(s, d), "target", _sources(s, d), "location_id", {"f": "idw"}, 4, 100_000).withColumn("f", F.round("f", 5)))
query("resample_bit_or", _TARGETS + "SELECT t.target, coalesce(bit_or(b.flags), 0) AS flags FROM t LEFT JOIN b ON t.target = b.target GROUP BY t.target")(
    lambda s, d: grids.resample(_targets(s, d), "target", _sources(s, d), "location_id", {"flags": "bitwise_or"}, 4, 100_000))


@query("regrid_nn_lut", f""", p AS (SELECT i AS pixel, 90.0 - (i // 36 + 0.5) * 10 AS lat, -180.0 + (i % 36 + 0.5) * 10 AS lon FROM range(648) r(i)),
p2 AS (SELECT pixel, {_XYZ('lat', 'lon', 1)} FROM p), g2 AS (SELECT gpi, {_XYZ('lat', 'lon', 2)} FROM g),
lut AS (SELECT pixel, gpi FROM (SELECT pixel, gpi, row_number() OVER (PARTITION BY pixel ORDER BY {_CHORD}, gpi) AS n FROM p2, g2) WHERE n = 1),
l AS (SELECT location_id, ssm, "time", row_number() OVER (PARTITION BY location_id ORDER BY "time" DESC, obs_id DESC) AS n FROM o)
SELECT pixel, gpi, ssm, "time" FROM lut LEFT JOIN l ON gpi = location_id AND n = 1""")
def regrid_nn_lut(s, d):
    pixels = grids.regular(s, 10).select(F.col("gpi").alias("pixel"), "lat", "lon")
    lut = grids.lookup_table(pixels, "pixel", grid(s, d), "gpi")
    return grids.regrid(lut, "pixel", "gpi", obs(s, d), "location_id", ["ssm", "time"], ["time", "obs_id"])


query("asof_nearest_join", """, l AS (SELECT obs_id, location_id, "time" FROM o WHERE sat_id = 3), r AS (SELECT location_id, "time" AS mt, f FROM o WHERE sat_id = 4 AND f IS NOT NULL),
x AS (SELECT obs_id, mt, f, row_number() OVER (PARTITION BY obs_id ORDER BY abs(epoch_us(mt) - epoch_us("time")), mt, f) AS n FROM l LEFT JOIN r USING (location_id))
SELECT obs_id, mt AS matched_time, f FROM x WHERE n = 1""")(
    lambda s, d: grids.nearest_in_time(obs(s, d).where("sat_id = 3").select("obs_id", "location_id", "time"), obs(s, d).where("sat_id = 4 AND f IS NOT NULL").select("location_id", "time", "f"), "location_id", "time", "time", "f").select("obs_id", "matched_time", "f"))
query("regular_grid", "SELECT i AS gpi, (i // 72)::INT AS \"row\", (i % 72)::INT AS col, 90.0 - (i // 72 + 0.5) * 5 AS lat, -180.0 + (i % 72 + 0.5) * 5 AS lon FROM range(2592) r(i)")(lambda s, d: grids.regular(s, 5))
query("fibonacci_grid", """, f AS (SELECT i AS gpi, CASE WHEN i > 5000 THEN i - 10001 ELSE i END AS i FROM range(10001) r(i)), h AS (SELECT gpi, i, i / ((1 + sqrt(5)) / 2) AS t FROM f)
SELECT gpi, round(CASE WHEN (t - floor(t)) * 360 >= 180 THEN (t - floor(t)) * 360 - 360 ELSE (t - floor(t)) * 360 END, 6) AS lon, round(degrees(atan(tan(asin(2.0 * i / 10001)) / (1 - 6.69437999014e-3))), 6) AS lat FROM h""")(
    lambda s, d: grids.fibonacci(s, 5000).select("gpi", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")))

# --- scalar functions ---------------------------------------------------------------------------------------

_BYTES = {"rf1": 31, "rf2": 7, "pl": 31, "gen1": 127, "gen2": 15}


def _bytes():
    return {n: F.pmod(F.col("obs_id") * (3 + 2 * i), F.lit(m + 1)) for i, (n, m) in enumerate(_BYTES.items())}


_BYTE_SQL = {n: f"((obs_id * {3 + 2 * i}) % {m + 1})" for i, (n, m) in enumerate(_BYTES.items())}
# Fixed values, written out here so that the SQL does not take them from what it tests: severities by bit, places of bits, radius.
_SEVERITY = {'rf1': [1, 1, 2, 1, 2], 'rf2': [2, 2], 'pl': [2, 2, 2, 2], 'gen1': [0, 2], 'gen2': [1, 0, 2]}
_SEVERITY_13 = [1, 1, 2, 1, 2, 2, 2, 1, 2, 2, 2, 0, 1, 2, 0, 1, 0, 2, 0, 0]
_PLACES_13 = {'rf1': {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}, 'rf2': {0: 5, 1: 6, 2: 7}, 'pl': {1: 8, 2: 9, 3: 10, 4: 11}, 'gen1': {0: 12, 1: 13, 6: 14}, 'gen2': {0: 15, 1: 16, 2: 17, 3: 18}}
_HAM = 23.68706744208165
_bit = lambda c, b: f"(({c} >> {b}) & 1)"
query("flags_severity", "SELECT obs_id, greatest(0, " + ", ".join(f"{_bit(_BYTE_SQL[n], b)} * {v}" for n, vs in _SEVERITY.items() for b, v in enumerate(vs)) + ")::INT AS severity FROM o")(
    lambda s, d: obs(s, d).select("obs_id", flags.severity(_bytes()).alias("severity")))
query("flags_severity_ignore_noise", "SELECT obs_id, greatest(0, " + ", ".join(f"{_bit(_BYTE_SQL[n], b)} * {v}" for n, vs in _SEVERITY.items() for b, v in enumerate(vs) if (n, b) != ("rf2", 1)) + ")::INT AS severity FROM o")(
    lambda s, d: obs(s, d).select("obs_id", flags.severity(_bytes(), True).alias("severity")))
query("flags_severity_13", "SELECT obs_id, greatest(0, " + ", ".join(f"{_bit('((obs_id * 7919) % 1048576)', b)} * {v}" for b, v in enumerate(_SEVERITY_13)) + ")::INT AS severity FROM o")(
    lambda s, d: obs(s, d).select("obs_id", flags.severity_13(F.pmod(F.col("obs_id") * 7919, F.lit(1048576))).alias("severity")))
query("flags_remap", "SELECT obs_id, (" + " + ".join(f"{_bit(_BYTE_SQL[n], a)} * {1 << b}" for n, t in _PLACES_13.items() for a, b in t.items()) + ")::BIGINT AS field FROM o")(
    lambda s, d: obs(s, d).select("obs_id", flags.flag_field(_bytes()).alias("field")))
query("bit_get_set", "SELECT obs_id, ((proc_flag1 >> 2) & 1)::INT AS bit3, (proc_flag1::BIGINT | 16) AS set5, (proc_flag1::BIGINT & ~1) AS clear1 FROM o WHERE proc_flag1 IS NOT NULL")(
    lambda s, d: obs(s, d).dropna(subset=["proc_flag1"]).select("obs_id", scalars.get_bit(F.col("proc_flag1"), 3).alias("bit3"), scalars.set_bit(F.col("proc_flag1"), 5).alias("set5"), scalars.set_bit(F.col("proc_flag1"), 1, 0).alias("clear1")))
query("db_lin_roundtrip", "SELECT obs_id, round(pow(10.0, f / 10), 9) AS lin, CASE WHEN noise > 0 THEN round(10 * log10(noise), 6) END AS noise_db FROM o WHERE abs(f) < 50")(
    lambda s, d: obs(s, d).where("abs(f) < 50").select("obs_id", F.round(scalars.db2lin(F.col("f")), 9).alias("lin"), F.round(scalars.lin2db(F.col("noise")), 6).alias("noise_db")))
query("window_weights_hamming", f"SELECT gpi, round(w / sum(w) OVER (PARTITION BY cell), 8) AS weight FROM (SELECT gpi, cell, 0.54 + 0.46 * cos({3.141592653589793 / _HAM!r} * (gpi % 25)) AS w FROM g)")(
    lambda s, d: grid(s, d).withColumn("w", scalars.window_weight("hamming", scalars.window_radius("hamming", 12.5), F.col("gpi") % 25)).select("gpi", F.round(scalars.normalised(F.col("w"), "cell"), 8).alias("weight")))
query("window_weights_boxcar", "SELECT gpi, CASE WHEN gpi % 25 <= 12.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM g")(
    lambda s, d: grid(s, d).select("gpi", scalars.window_weight("boxcar", 12.5, F.col("gpi") % 25).alias("weight")))
query("cds_time", "SELECT obs_id, TIMESTAMP '2000-01-01' + to_days((obs_id % 3000)::INT) + to_milliseconds((obs_id * 977) % 86400000) AS t, round(2451544.5 + obs_id % 3000 + ((obs_id * 977) % 86400000) / 86400000.0, 6) AS jd FROM o")(
    lambda s, d: obs(s, d).select("obs_id", scalars.cds_time(F.col("obs_id") % 3000, (F.col("obs_id") * 977) % 86400000).alias("t"), F.round(scalars.julian_day(F.col("obs_id") % 3000, (F.col("obs_id") * 977) % 86400000), 6).alias("jd")))
query("seconds_2000", "SELECT obs_id, TIMESTAMP '2000-01-01' + to_seconds(obs_id * 60) AS t FROM o")(lambda s, d: obs(s, d).select("obs_id", scalars.seconds_2000(F.col("obs_id") * 60).alias("t")))
query("parts_time", 'SELECT obs_id, make_timestamp(year("time"), month("time"), day("time"), hour("time"), minute("time"), 0.0) AS t FROM o')(
    lambda s, d: obs(s, d).select("obs_id", scalars.parts_time(F.year("time"), F.month("time"), F.dayofmonth("time"), F.hour("time"), F.minute("time"), F.lit(0)).alias("t")))
query("wrap_longitude", "SELECT location_id, CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS lon, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS azimuth FROM locations")(
    lambda s, d: table(s, d, "locations").select("location_id", scalars.wrap_longitude(F.col("lon")).alias("lon"), scalars.wrap_azimuth(F.col("lon")).alias("azimuth")))
query("sat_id_lookup", "SELECT collection_id, coalesce(CASE sat WHEN 'A' THEN 3 WHEN 'B' THEN 4 WHEN 'C' THEN 5 END, -1) AS sat_id, coalesce(CASE WHEN sat_id BETWEEN 0 AND 5 THEN list_extract([0, 0, 0, 4, 3, 5], sat_id + 1) END, -1) AS by_message FROM cell_collections")(
    lambda s, d: table(s, d, "cell_collections").select("collection_id", F.coalesce(scalars.lookup(F.col("sat"), scalars.SAT_BY_LETTER), F.lit(-1)).alias("sat_id"), F.coalesce(scalars.lookup(F.col("sat_id"), scalars.SAT_BY_MESSAGE), F.lit(-1)).alias("by_message")))
query("swath_indicator", "SELECT obs_id, floor(obs_id / 82)::INT AS line, (obs_id % 82 + 1)::INT AS node, (obs_id % 82 + 1 > 41)::INT AS swath_indicator, ((obs_id * 13) % 360 < 270)::INT AS pass FROM o")(
    lambda s, d: obs(s, d).select("obs_id", scalars.line_number(F.col("obs_id"), 82).alias("line"), scalars.node_number(F.col("obs_id"), 82).alias("node")).withColumns(
        {"swath_indicator": scalars.swath_indicator(F.col("node"), 82), "pass": scalars.descending_pass((F.col("obs_id") * 13) % 360)}))
query("beam_stack_unstack", "SELECT obs_id, f AS sig_for, m AS sig_mid, a AS sig_aft FROM o")(
    lambda s, d: formats.split_beams(obs(s, d).select("obs_id", scalars.stacked(F.col("f"), F.col("m"), F.col("a")).alias("sig")), "sig"))
query("beam_union", "SELECT obs_id, 'for' AS beam, f AS sig FROM o UNION ALL SELECT obs_id, 'mid', m FROM o UNION ALL SELECT obs_id, 'aft', a FROM o")(
    lambda s, d: formats.by_beam({b: obs(s, d).select("obs_id", F.col(c).alias("sig")) for b, c in (("for", "f"), ("mid", "m"), ("aft", "a"))}))
query("beam_rename", "SELECT ers_id, fore_backscatter AS backscatter_for, mid_backscatter AS backscatter_mid, aft_backscatter AS backscatter_aft FROM ers_cells")(
    lambda s, d: formats.suffix_beams(table(s, d, "ers_cells").select("ers_id", "fore_backscatter", "mid_backscatter", "aft_backscatter")))
query("generic_fields", "SELECT obs_id, CASE WHEN f_backscatter <> -999999 AND NOT isnan(f_backscatter) THEN f_backscatter::DOUBLE END AS sig40, coalesce(CASE WHEN proc_flag1 <> 255 THEN proc_flag1 END, -1) AS corr_flag, round(CASE WHEN surface_soil_moisture <> -999999 AND NOT isnan(surface_soil_moisture) THEN surface_soil_moisture * 0.01::DOUBLE END, 6) AS sm FROM observations")(
    lambda s, d: formats.generic(table(s, d, "observations"), {"obs_id": ("obs_id", "bigint", None, 1), "sig40": ("f_backscatter", "double", -999999.0, 1), "corr_flag": ("proc_flag1", "int", 255, 1), "sm": ("surface_soil_moisture", "double", -999999.0, 0.01)}).withColumns({"sm": F.round("sm", 6), "corr_flag": F.coalesce("corr_flag", F.lit(-1))}))
query("encode_fill", "SELECT obs_id, coalesce(f, -999999.0::DOUBLE) AS f, coalesce(proc_flag1, -2147483648) AS flag, coalesce(round(ssm / 0.01)::INT, -1) AS ssm FROM o")(
    lambda s, d: obs(s, d).select("obs_id", nulls.encode_fill(F.col("f"), "double").alias("f"), nulls.encode_fill(F.col("proc_flag1"), "int").alias("flag"), formats.scaled(F.col("ssm"), 0.01, -1).alias("ssm")))
query("orbit_number", f"SELECT obs_id, 100 + (epoch_us(\"time\") > {_START} + 6082000000)::INT AS orbit FROM o")(
    lambda s, d: obs(s, d).select("obs_id", scalars.orbit_number(us(), F.lit(100), F.lit(_START)).alias("orbit")))
query("absolute_soil_moisture", "SELECT obs_id, round(ssm / 100 * por, 8) AS abs_sm, round(sqrt(noise * noise * (por / 100) * (por / 100)), 8) AS abs_sm_noise FROM (SELECT *, (location_id % 60) / 100.0 + 0.2 AS por FROM o)")(
    lambda s, d: records.with_absolute(obs(s, d).withColumn("por", (F.col("location_id") % 60) / 100.0 + 0.2), "ssm", "noise", "por").select("obs_id", F.round("abs_sm", 8).alias("abs_sm"), F.round("abs_sm_noise", 8).alias("abs_sm_noise")))
query("swi_frozen_mask", "SELECT obs_id, CASE WHEN ssm <= 60 THEN ssm END AS ssm FROM o WHERE proc_flag1 <= 1")(
    lambda s, d: records.index_series(obs(s, d), ["ssm"], "proc_flag1", 60).select("obs_id", "ssm"))
query("cdr_masks", "SELECT obs_id FROM o WHERE proc_flag1 < 2 AND (obs_id * 37) % 100 < 50 AND (obs_id * 17) % 100 < 40")(
    lambda s, d: records.record_masks(obs(s, d).withColumns({"fz": F.pmod(F.col("obs_id") * 37, F.lit(100)), "sn": F.pmod(F.col("obs_id") * 17, F.lit(100))}), "proc_flag1", ("fz", 50), ("sn", 40)).select("obs_id"))
query("threshold_warnings", "SELECT gpi, gpi % 100 >= 50 AS topo_warning, gpi % 70 >= 50 AS wetland_warning FROM g")(
    lambda s, d: grid(s, d).withColumns(records.warnings(F.col("gpi") % 100, F.col("gpi") % 70)).select("gpi", "topo_warning", "wetland_warning"))


@query("static_layer_join", ', s AS (SELECT location_id, dayofyear("time") AS doy, round(avg(noise), 6) AS layer FROM o GROUP BY ALL) SELECT obs_id, layer FROM o LEFT JOIN s ON o.location_id = s.location_id AND dayofyear(o."time") = s.doy')
def static_layer_join(s, d):
    layer = obs(s, d).groupBy("location_id", F.dayofyear("time").alias("doy")).agg(F.round(F.avg("noise"), 6).alias("layer"))
    return grids.with_static(obs(s, d), layer, {"location_id": F.col("location_id"), "doy": F.dayofyear("time")}).select("obs_id", "layer")


@query("product_of_file", r", c AS (SELECT product, min(collection_id) AS k, '^' || regexp_replace(regexp_replace(replace(any_value(fn_pattern), '.', '[.]'), '\{date\}', '[0-9]{14}', 'g'), '\{[a-z]+[0-9]*\}', '[^_]+', 'g') || '$' AS rx FROM cell_collections GROUP BY product) SELECT file_id, (SELECT arg_min(product, k) FROM c WHERE regexp_matches(file_name, rx)) AS product FROM swath_files")
def product_of_file(s, d):
    cat = catalog.Catalog()
    for r in table(s, d, "cell_collections").groupBy("product").agg(F.min_by("fn_pattern", "collection_id").alias("p"), F.min("grid_name").alias("g"), F.min("collection_id").alias("k")).orderBy("k").collect():  # a row per product
        cat.register(catalog.Product(r["product"], r["p"], r["g"]))
    return table(s, d, "swath_files").select("file_id", cat.product_column(F.col("file_name")).alias("product"))


# --- the wider tables ---------------------------------------------------------------------------------------


@query("events_masked_daily_mean", """, e AS (SELECT user_id AS location_id, ts, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag, CAST(json_extract_string(props, '$.k') AS INT) AS prob FROM events)
SELECT location_id, ts::DATE AS day, round(avg(CASE WHEN prob > 80 THEN NULL ELSE value END), 6) AS value, count(*) AS n FROM e WHERE flag = 0 GROUP BY ALL""")
def events_masked_daily_mean(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("location_id"), "ts", "value", (F.col("event_type") == "error").cast("int").alias("flag"), F.get_json_object("props", "$.k").cast("int").alias("prob"))
    good = agg.masked(e, "value", agg.Masks(frozen=80), frozen="prob", surface_flag="flag")
    return good.groupBy("location_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n"))


@query("lineitem_mean_by_supplier", "SELECT l_suppkey AS location_id, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, count(*) AS n FROM lineitem GROUP BY ALL")
def lineitem_mean(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("location_id")).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("std"), F.count(F.lit(1)).alias("n"))


@query("reprocess_groups", "SELECT cell, count(*) AS n, round(max(ssm) - min(ssm), 5) AS span FROM o GROUP BY ALL")
def reprocess_groups(s, d):
    """A caller's function per cell (reduced to small groups first, as any such function should be)."""
    def span(pdf):
        import pandas as pd

        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "n": [int(pdf["n"].sum())], "span": [round(float(pdf["hi"].max() - pdf["lo"].min()), 5)]})

    small = obs(s, d).groupBy("cell", "location_id").agg(F.count(F.lit(1)).alias("n"), F.max("ssm").alias("hi"), F.min("ssm").alias("lo"))
    return stack.reprocess(small, span, "cell int, n bigint, span double")


@query("csv_roundtrip", 'SELECT obs_id, "time", round(f, 4) AS f FROM o')
def csv_roundtrip(s, d):
    from swathline.session import scratch_path

    path = scratch_path(s, "csv")
    formats.write_csv(obs(s, d).select("obs_id", "time", F.round("f", 4).alias("f")), path)
    return formats.read_csv(s, [path], "obs_id bigint, time timestamp_ntz, f double")


query("file_pattern_match", r", c AS (SELECT collection_id, '^' || regexp_replace(regexp_replace(replace(replace(fn_pattern, '.', '[.]'), '{sat}', sat), '\{date\}', '[0-9]{14}', 'g'), '\{[a-z]+[0-9]*\}', '[^_]+', 'g') || '$' AS rx FROM cell_collections) SELECT file_id, collection_id FROM swath_files, c WHERE regexp_matches(file_name, rx)")(
    lambda s, d: table(s, d, "swath_files").select("file_id", F.explode(F.array_compact(F.array(*[F.when(F.col("file_name").rlike(compact.pattern_regex(r["fn_pattern"], {"sat": r["sat"]})), F.lit(r["collection_id"])) for r in table(s, d, "cell_collections").collect()]))).alias("collection_id")))
