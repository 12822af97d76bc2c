"""Queries of file sets, forms and step outputs, with the SQL that must give the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.operators import aggregate as agg
from swathline.operators import convert, grids, records, select
from swathline.operators.series import Series
from swathline.plans import reference
from swathline.plans.problems import table
from swathline.plans.reference import BASE, grid, obs, placed
from swathline.session import scratch_path
from swathline.sources import filesets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = BASE + sql
        return f

    return keep


def _lettered(s, d) -> DataFrame:
    letters = table(s, d, "cell_collections").select(F.col("collection_id").alias("_c"), "sat")
    return obs(s, d).join(letters, F.col("collection_id") == F.col("_c")).drop("_c")


query("select_satellite", "SELECT obs_id, sat FROM o JOIN cell_collections c USING (collection_id) WHERE regexp_full_match(sat, '[AB]')")(
    lambda s, d: select.by_satellite(_lettered(s, d), "[AB]").select("obs_id", "sat"))
query("select_period_margin", "SELECT obs_id FROM o WHERE \"time\" BETWEEN TIMESTAMP '2007-01-10' - INTERVAL 15 MINUTE AND TIMESTAMP '2007-01-12' + INTERVAL 15 MINUTE")(
    lambda s, d: select.in_period(obs(s, d), "2007-01-10 00:00:00", "2007-01-12 00:00:00", margin_s=900).select("obs_id"))
_IDS = [92594, 10761, 46230]
query("files_with_ids", f"SELECT batch_id, bool_or(location_id IN ({', '.join(map(str, _IDS))})) AS found FROM o GROUP BY batch_id")(
    lambda s, d: select.contains_ids(obs(s, d), "batch_id", _IDS))
query("files_near_places", """, t AS (SELECT lat, lon FROM g WHERE cell IN (SELECT min(cell) FROM g)),
q AS (SELECT DISTINCT batch_id, lat, lon FROM og)
SELECT DISTINCT batch_id FROM q WHERE EXISTS (SELECT 1 FROM t WHERE abs(t.lat - q.lat) < 0.2
  AND 2 * 6371000 * asin(sqrt(least(1.0, sin(radians(t.lat - q.lat) / 2) ** 2 + cos(radians(q.lat)) * cos(radians(t.lat)) * sin(radians(t.lon - q.lon) / 2) ** 2))) <= 15000)""")(
    lambda s, d: filesets.files_near(placed(s, d), "batch_id", _first_cell(s, d)))


def _first_cell(s, d) -> DataFrame:
    g = grid(s, d)
    first = g.agg(F.min("cell").alias("_c"))
    return g.join(first, F.col("cell") == F.col("_c"), "left_semi").select("lat", "lon")


query("files_by_name", r"""SELECT file_id, strptime(nullif(regexp_extract(file_name, '_([0-9]{14})_', 1), ''), '%Y%m%d%H%M%S') AS file_start, nullif(regexp_extract(file_name, '-([A-Z])[,_]', 1), '') AS file_satellite
FROM swath_files""")(lambda s, d: filesets.by_file(table(s, d, "swath_files").select("file_id", "file_name"), "file_name").select("file_id", "file_start", "file_satellite"))
query("daily_steps", "SELECT day::DATE AS day, count(obs_id) AS n FROM generate_series(TIMESTAMP '2007-01-05', TIMESTAMP '2007-01-14', INTERVAL 1 DAY) t(day) LEFT JOIN o ON \"time\"::DATE = day::DATE GROUP BY 1")(
    lambda s, d: s.createDataFrame([(x,) for x in filesets.days(date(2007, 1, 5), date(2007, 1, 15))], "day date").join(
        obs(s, d).select("obs_id", F.to_date("time").alias("_d")), F.col("day") == F.col("_d"), "left").groupBy("day").agg(F.count("obs_id").alias("n")))
query("cell_names", "SELECT obs_id, lat, lon, NULL::FLOAT AS alt FROM og")(
    lambda s, d: filesets.to_cell_names(placed(s, d).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})).select("obs_id", "lat", "lon", "alt"))
query("micro_degrees", "SELECT gpi, round(lat * 1000000)::INT AS lat, round(lon * 1000000)::INT AS lon FROM g")(
    lambda s, d: filesets.micro_degrees(grid(s, d)).select("gpi", "lat", "lon"))
query("step_file_counts", """SELECT 'sm_' || 'fib_' || 'mean_' || '5d_' || strftime(TIMESTAMP '2007-01-01' + INTERVAL 1 DAY * (step * 5), '%Y%m%d%H%M%S') AS file, count(DISTINCT location_id) AS n
FROM (SELECT location_id, floor(epoch_us("time" - TIMESTAMP '2007-01-01' + TIMESTAMP '1970-01-01') / 432000000000)::INT AS step FROM o WHERE "time" >= TIMESTAMP '2007-01-01' AND "time" < TIMESTAMP '2007-03-02') GROUP BY step""")(
    lambda s, d: _steps(s, d))


def _steps(s, d) -> DataFrame:
    start, step = 1_167_609_600_000_000, 5 * 86_400_000_000
    rows = agg.time_steps(obs(s, d), reference.us(), start, step, start + 12 * step)
    at = F.timestamp_micros(F.lit(start) + F.col("step_no") * step).cast("timestamp_ntz")
    return rows.groupBy(filesets.step_name("sm", "fib", "mean", "5d", at).alias("file")).agg(F.count_distinct("location_id").alias("n"))


query("agg_none", "SELECT location_id, ssm FROM o WHERE ssm > 50")(
    lambda s, d: agg.by_step(obs(s, d).where("ssm > 50"), ["location_id"], ["ssm"], None, reference.us()))
query("agg_callable", "SELECT location_id, round(max(ssm) - min(ssm), 6) AS ssm FROM o GROUP BY location_id")(
    lambda s, d: agg.by_step(obs(s, d), ["location_id"], ["ssm"], lambda v, o: F.round(F.max(v) - F.min(v), 6), reference.us()))
query("resample_dense_months", """, c AS (SELECT location_id, date_trunc('month', "time") AS m, round(avg(ssm), 6) AS ssm FROM o GROUP BY ALL),
x AS (SELECT location_id, max(cell) AS cell FROM o GROUP BY ALL),
a AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM c)
SELECT x.location_id, x.cell, last_day(a.m::DATE) AS period_end, c.ssm FROM x CROSS JOIN a LEFT JOIN c ON c.location_id = x.location_id AND c.m = a.m""")(
    lambda s, d: agg.dense_months(obs(s, d), ["location_id"], "time", "ssm", lambda v, o: F.round(F.avg(v), 6), ["cell"]))
query("orthogonal_merge", """, a AS (SELECT location_id, "time"::DATE AS day, min(ssm) AS ssm FROM o WHERE collection_id = 11 GROUP BY ALL),
b AS (SELECT location_id, "time"::DATE AS day, min(ssm) AS ssm FROM o WHERE collection_id = 12 GROUP BY ALL)
SELECT coalesce(a.location_id, b.location_id) AS location_id, coalesce(a.day, b.day) AS day, coalesce(a.ssm, b.ssm) AS ssm FROM a FULL JOIN b ON a.location_id = b.location_id AND a.day = b.day""")(
    lambda s, d: convert.merge_orthogonal(_daily(s, d, 11), _daily(s, d, 12), "location_id", "day", ["ssm"]))


def _daily(s, d, collection: int) -> DataFrame:
    return obs(s, d).where(F.col("collection_id") == collection).groupBy("location_id", F.to_date("time").alias("day")).agg(F.min("ssm").alias("ssm"))


query("only_locations", "SELECT location_id, min(cell) AS cell FROM o GROUP BY location_id")(lambda s, d: convert.only_locations(obs(s, d), "location_id", ["cell"]))
query("only_observations", "SELECT obs_id, location_id, ssm FROM o")(lambda s, d: convert.only_observations(obs(s, d).select("obs_id", "location_id", "ssm", "cell"), ["cell"]))
query("index_scaled", "SELECT obs_id, proc_flag1 * 0.5::DOUBLE AS QFLAG_001, round(ssm * 0.5, 6) AS SWI_001, pass * 1.0::DOUBLE AS SSF FROM o")(
    lambda s, d: records.scaled_index(obs(s, d).select("obs_id", F.col("proc_flag1").alias("QFLAG_001"), F.col("ssm").alias("SWI_001"), F.col("pass").alias("SSF")), ["QFLAG_001", "SWI_001", "SSF"]).withColumn("SWI_001", F.round("SWI_001", 6)))
query("regrid_stored_lut", """, s AS (SELECT gpi AS source, lat, lon FROM g WHERE gpi % 2 = 0), t AS (SELECT gpi AS target, lat, lon FROM g WHERE gpi % 2 = 1),
r AS (SELECT target, source, 2 * 6370997 * asin(sqrt(least(1.0, sin(radians(t.lat - s.lat) / 2) ** 2 + cos(radians(s.lat)) * cos(radians(t.lat)) * sin(radians(t.lon - s.lon) / 2) ** 2))) AS dist FROM s, t)
SELECT target, round(min(dist)) AS distance_m FROM r GROUP BY target""")(lambda s, d: _stored(s, d))


def _stored(s, d) -> DataFrame:
    g = grid(s, d)
    side = lambda odd, name: g.where(F.pmod("gpi", F.lit(2)) == odd).select(F.col("gpi").alias(name), "lat", "lon")
    path = scratch_path(s, "lut")
    for _ in range(2):  # made, then read again
        lut = grids.stored_lookup_table(path, side(1, "target"), "target", side(0, "source"), "source")
    far = lut.join(side(1, "target"), "target").join(side(0, "source").withColumnsRenamed({"lat": "lat_s", "lon": "lon_s"}), "source")
    from swathline.operators.nearby import great_circle

    return far.select("target", F.round(great_circle(F.col("lat"), F.col("lon"), F.col("lat_s"), F.col("lon_s"), grids.SEARCH_RADIUS_M)).alias("distance_m"))


query("series_save_load", "SELECT obs_id, location_id, ssm FROM o WHERE cell < 1000")(lambda s, d: _saved(s, d))


def _saved(s, d) -> DataFrame:
    rows = obs(s, d).where("cell < 1000").select("obs_id", "location_id", "time", "ssm", "cell")
    path = scratch_path(s, "set") + ".parquet"
    Series(rows, "point", "location_id", ("obs_id", "ssm"), ("time",), ("cell",)).save(path)
    return Series.from_file(s, path).to_point().data.select("obs_id", "location_id", "ssm")
