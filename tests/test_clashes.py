"""Other columns of an input, whatever their names, change nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from swathline.functions import nulls
from swathline.operators import compact, drift, flatten, gapfill, nearby, spikes

EXTRA = ["_t", "_k0", "_id", "_v0", "_n", "_h_k", "_chunk", "_w", "_v", "_step", "_shard", "_s", "id_a", "lat_a", "x", "code_a", "hot", "name", "kind", "value", "field", "dewey", "parent", "_p", "_o", "_file", "_line", "_text", "_order", "_st", "_sq", "seq", "prev"]


def _with_extras(df):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(EXTRA) if n not in df.columns])


def _same(make, df):
    a, b = make(df), make(_with_extras(df))
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_extra_columns(spark):
    t = datetime(2007, 1, 1)
    obs = spark.createDataFrame([(1, t + timedelta(hours=i), i, 60.0 if i == 9 else float(i % 3)) for i in range(20)], "src int, t timestamp_ntz, i bigint, v double")
    _same(lambda d: spikes.implausible_readings(d, ["src"], nulls.micros(F.col("t")), "i", [spikes.Field("v", F.col("v"), -50, 50)]), obs)
    _same(lambda d: spikes.implausible_readings(d, ["src"], nulls.micros(F.col("t")), "i", [spikes.Field("v", F.col("v"), -50, 50)], 5, 4), obs)
    _same(lambda d: gapfill.regular_series(d, ["src"], F.col("i") * 7, F.lit(3), F.col("v")), obs)
    places = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.001, 1.0)], "p bigint, lat double, lon double")
    _same(lambda d: nearby.within_distance(d, "p", "lat", "lon", 1000.0), places)
    names = spark.createDataFrame([("a", "b")], "field_name string, canonical string")
    files = spark.createDataFrame([(1, "s", 1, '{"a": 1}'), (2, "s", 2, '{"c": 1}')], "f bigint, stream string, n int, payload string")
    _same(lambda d: drift.schema_changes(d, "stream", "n", "f", "payload", names), files)
    nested = spark.createDataFrame([(1, '{"L": [{"x": 1}, null]}')], "r bigint, raw string")
    _same(lambda d: flatten.flatten(d, "r", flatten.body(F.col("raw")), [flatten.Level("lines", "L", {"x": ("$.x", "int")})])["lines"], nested)
    tiny = spark.createDataFrame([(1, "A", "5,20070101000000,1,2\n")], "i bigint, n string, c string")
    _same(lambda d: compact.parse_files(d, "n", "c", "i", [(1, "^A$")], "part"), tiny)
