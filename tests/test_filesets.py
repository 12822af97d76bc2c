"""File sets and what goes with them on small cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from swathline.operators import aggregate, convert, select
from swathline.operators.series import Series
from swathline.session import scratch_path
from swathline.sources import filesets


def test_days_and_lists():
    assert list(filesets.days(date(2020, 2, 28), date(2020, 3, 1))) == [date(2020, 2, 28), date(2020, 2, 29)]
    assert list(filesets.days(date(2020, 1, 2), date(2020, 1, 2))) == []
    assert filesets.parse_day("20200131") == datetime(2020, 1, 31)
    for bad in ("2020-01-31", "2020131", "20201331", ""):
        with pytest.raises(ValueError):
            filesets.parse_day(bad)
    assert filesets.common_files([["b", "a", "b"], ["a", "b"], ["b"]]) == ["b"] and filesets.common_files([]) == []
    search = filesets.search_function(lambda names, folders: [names["date"], folders["y"]["year"]], lambda t: ({"date": f"{t:%Y%m%d}"}, {"y": {"year": str(t.year)}}))
    assert search(datetime(2021, 5, 6)) == ["20210506", "2021"]


def test_attributes():
    a, b = {"featureType": "point", "grid_mapping_name": "g", "title": "x", "n": 1}, {"featureType": "point", "grid_mapping_name": "h", "n": 1}
    assert filesets.combined_attributes([a]) == a
    assert filesets.combined_attributes([a, b]) == {"featureType": "point"}
    assert filesets.combined_attributes([]) == {}


def test_file_set(spark):
    root = scratch_path(spark, "files")
    names = [f"{root}/{n}" for n in ("a", "b")]
    files = filesets.FileSet(names, spark.read.parquet, lambda df, n: df.write.parquet(n), keep=1)
    with pytest.raises(ValueError):
        files.write([spark.range(1)])
    files.write([spark.range(2), spark.range(3).withColumn("x", F.lit(1))])
    assert files.read().count() == 5 and [d.count() for d in files.iter_read()] == [2, 3]
    assert files.newest_first() == names[::-1] and filesets.FileSet([], spark.read.parquet).read() is None


def test_near_files_nulls_and_edges(spark):
    points = spark.createDataFrame([("pole", 89.95, 10.0), ("line", 0.0, 359.95), ("far", 20.0, 20.0), ("none", None, 1.0), ("nan", float("nan"), 0.0), (None, 0.0, 0.0)], "file string, lat double, lon double")
    targets = spark.createDataFrame([(89.95, -170.0), (0.0, -0.05), (None, None)], "lat double, lon double")
    assert {r[0] for r in filesets.files_near(points, "file", targets).collect()} == {"pole", "line", None}
    assert filesets.files_near(points, "file", targets.where("lat > 90")).count() == 0


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "A", datetime(2020, 1, 5), 1.0), (1, None, datetime(2020, 3, 5), None), (2, "B", datetime(2020, 2, 5), 3.0)], "k int, sat string, time timestamp_ntz, v double")
    assert select.by_satellite(df, "[AC]").count() == 1 and select.by_satellite(df, "*").count() == 3
    assert {tuple(r) for r in select.contains_ids(df, "sat", [1], "k").collect()} == {("A", True), (None, True), ("B", False)}
    assert {tuple(r) for r in aggregate.dense_months(df, ["k"], "time", "v").collect()} == {
        (1, date(2020, 1, 31), 1.0), (1, date(2020, 2, 29), None), (1, date(2020, 3, 31), None), (2, date(2020, 1, 31), None), (2, date(2020, 2, 29), 3.0), (2, date(2020, 3, 31), None)}
    assert aggregate.dense_months(df.where("k > 5"), ["k"], "time", "v").count() == 0
    a, b = df.where("k = 1").select("k", "time", "v"), df.select("k", "time", F.lit(9.0).alias("v"))
    assert sorted(r["v"] for r in convert.merge_orthogonal(a, b, "k", "time", ["v"]).collect()) == [1.0, 9.0, 9.0]
    assert convert.only_locations(df, "k", []).count() == 2 and convert.only_observations(df, ["sat"]).columns == ["k", "time", "v"]


def test_series_files(spark):
    df = spark.createDataFrame([(7, 2, 1.0), (7, 1, None), (3, 1, 2.0)], "k int, time int, v double")
    s = Series(df, "point", "k", ("v",))
    with pytest.raises(ValueError):
        s.save("/nowhere/x.csv")
    path = scratch_path(spark, "s") + ".parquet"
    s.save(path)
    back = Series.from_file(spark, path)
    assert {tuple(r) for r in back.to_point().data.select("k", "time", "v").collect()} == {(7, 2, 1.0), (7, 1, None), (3, 1, 2.0)}
    assert Series.detect(back.data, "k") == "indexed" and Series.detect(df, "k") == "point" and Series.detect(s.to_contiguous().data, "k") == "contiguous"
    with pytest.raises(RuntimeError):
        Series.detect(df.drop("k"), "k")
