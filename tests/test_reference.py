"""Every query with SQL against DuckDB on the smallest tables, and unit tests of what SQL does not reach."""

import glob
import math
import os
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swathline.functions import scalars
from swathline.operators import convert, grids, select, stack
from swathline.plans import problems, reference
from swathline.session import scratch_path
from swathline.sources import catalog, formats
from swathline.streaming import streams

SF = "/root/testdata/sf0.001"
CASES = {**problems.SQL, **reference.SQL}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def _rows(df: pd.DataFrame) -> Counter:
    def norm(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, (float, np.floating)):
            return round(float(v), 5) + 0.0
        return v.item() if hasattr(v, "item") else v

    return Counter(tuple(norm(v) for v in t) for t in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(CASES))
def test_against_sql(spark, con, name):
    query = {**problems.QUERIES, **reference.QUERIES}[name]
    got, exp = query(spark, SF).toPandas(), con.execute(CASES[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    a, b = _rows(got), _rows(exp)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def _series(spark):
    rows = [(10, 1.0, 0, 5.0), (10, 1.0, 1, 6.0), (20, 2.0, 0, 7.0), (30, 3.0, 2, 8.0), (30, 3.0, 0, 9.0), (30, 3.0, 1, None)]
    return spark.createDataFrame(rows, "id int, lon double, t int, v double")


def test_round_trips(spark):
    df = _series(spark)
    want = sorted(map(tuple, df.collect()), key=str)
    back = convert.contiguous_to_point(convert.to_contiguous(df, "id", ["t", "v"], ["t"], ["lon"])).select("id", "lon", "t", "v")
    assert sorted(map(tuple, back.collect()), key=str) == want
    point = convert.indexed_to_point(*convert.to_indexed(df, "id", ["lon"], ["t"])).select("id", "lon", "t", "v")
    assert sorted(map(tuple, point.collect()), key=str) == want


def test_orthogonal_strict(spark):
    with pytest.raises(ValueError):
        convert.to_orthogonal(_series(spark), "id", "t", ["v"])
    full = spark.createDataFrame([(i, t, 1.0) for i in (1, 2) for t in (0, 1)], "id int, t int, v double")
    assert convert.to_orthogonal(full, "id", "t", ["v"]).count() == 4
    with pytest.raises(ValueError):
        convert.to_orthogonal(full, "id", "t", ["v"], max_cells=3)


def test_empty_representations(spark):
    none = _series(spark).where("false")
    assert convert.to_contiguous(none, "id", ["t", "v"], ["t"]).count() == 0
    obs, loc = convert.to_indexed(none, "id", ["lon"], ["t"])
    assert obs.count() == 0 and loc.count() == 0
    assert convert.to_incomplete(convert.to_contiguous(none, "id", ["t", "v"], ["t"]), ["v"], {"v": F.lit(0.0)}).count() == 0


def test_fibonacci_against_known_points(spark):
    g = {r["gpi"]: r for r in grids.fibonacci(spark, 1_650_000).where("gpi IN (1549346, 1493629)").collect()}
    assert g[1549346]["cell"] == 2588 and g[1493629]["cell"] == 2587


def test_retile(spark):
    g = grids.regular(spark, 5).withColumn("cell", scalars.cell_number(F.col("lon"), F.col("lat")))
    pairs = {tuple(r) for r in stack.retile(g, 10).collect()}
    assert {o for n, o in pairs if n == 0} == {0, 1, 36, 37}
    assert {n for n, o in pairs if o in (0, 1, 9)} == {0, 4}


def test_resample_limits_and_exact_hit(spark):
    t = spark.createDataFrame([(1, 10.0, 10.0), (2, -80.0, 0.0)], "t int, lat double, lon double")
    o = spark.createDataFrame([(1, 10.0, 10.0, 5.0, 3), (2, 10.01, 10.0, 9.0, 4)], "o int, lat double, lon double, v double, b int")
    got = {r["t"]: (r["v"], r["b"]) for r in grids.resample(t, "t", o, "o", {"v": "idw", "b": "bitwise_or"}).collect()}
    assert got == {1: (5.0, 7), 2: (None, 0)}
    for kw in ({"k": 0}, {"k": 101}, {"radius_m": 10.0}):
        with pytest.raises(ValueError):
            grids.resample(t, "t", o, "o", {"v": "idw"}, **kw)


def test_request_order_strict(spark):
    df = spark.createDataFrame([(1,), (2,)], "location_id bigint")
    with pytest.raises(ValueError):
        select.by_ids_in_order(df, [2, 3], ignore_missing=False)
    assert [r["location_id"] for r in select.by_ids_in_order(df, [2, 1]).orderBy("request_no").collect()] == [2, 1]


def test_small_functions():
    assert scalars.parse_size("4GB") == 4 * 10**9 and scalars.parse_size("12") == 12
    assert scalars.window_radius("boxcar", 3) == 3
    with pytest.raises(ValueError):
        scalars.window_radius("gauss", 3)
    with pytest.raises(RuntimeError):
        scalars.spacecraft("X")
    assert list(catalog.batches_by_bytes([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10)) == [["a", "b"], ["c"], ["d"]]


def test_grid_registry(spark):
    r = grids.GridRegistry()
    r.register("mine", lambda s: grids.regular(s, 30))
    assert r.get(spark, "mine").count() == 72 and r.get(spark, "mine") is r.get(spark, "mine")
    with pytest.raises(KeyError):
        r.get(spark, "unknown")


def test_files_by_period(spark, tmp_path):
    for day in (1, 2, 3):
        folder = tmp_path / "EN01"
        folder.mkdir(exist_ok=True)
        (folder / f"2022010{day}_x.csv").write_text("date,v\n2022-01-0%d 06:00:00,1\n" % day)
    t = catalog.FilenameTemplate(str(tmp_path), "{date}_x.csv", {"tile": "{tile}"})
    f = catalog.ChronFiles(t, "%Y%m%d", lambda d: {"date": d.strftime("%Y%m%d")}, lambda d: {"tile": {"tile": "EN01"}})
    a, b = datetime(2022, 1, 1), datetime(2022, 1, 3)
    assert len(f.search_period(spark, a, b)) == 3 and len(f.search_period(spark, a, b, end_inclusive=False)) == 2
    got = f.read_period(spark, datetime(2022, 1, 1, 12), datetime(2022, 1, 2, 12), lambda p: formats.read_csv(spark, p, "date timestamp_ntz, v int"), "date")
    assert got.count() == 1


def test_catalog():
    c = catalog.Catalog()
    c.register(catalog.Product("P1", "A_{sat}_{date}.nc", "g"))
    assert c.get("p1").grid == "g" and c.product_of("A_X_20070101000000.nc") == "P1"
    for bad in (lambda: c.get("q"), lambda: c.product_of("B")):
        with pytest.raises(ValueError):
            bad()


def test_binary_records(spark, tmp_path):
    kind = np.dtype([("n", ">i4"), ("x", ">f4"), ("b", ">i2", (3,))])
    np.array([(1, 1.5, [1, 2, 3]), (2, -2.5, [4, 5, 6])], kind).tofile(tmp_path / "r.bin")
    got = formats.read_fixed(spark, str(tmp_path / "r.bin"), kind).orderBy("row").collect()
    assert [(r["n"], r["x"], list(r["b"])) for r in got] == [(1, 1.5, [1, 2, 3]), (2, -2.5, [4, 5, 6])]
    head = np.zeros(1, formats.GRH)
    body = b"PRODUCT_TYPE                  = SMR\n"
    head["record_class"], head["record_size"] = 1, formats.GRH.itemsize + len(body)
    (tmp_path / "p.nat").write_bytes(head.tobytes() + body)
    rec = formats.read_any(spark, str(tmp_path / "p.nat"))
    assert rec.select(formats.product_header(F.col("body"), "PRODUCT_TYPE").alias("t")).first()["t"] == "SMR"
    with pytest.raises(ValueError):
        formats.read_any(spark, "x.doc")
    with pytest.raises(ImportError):
        formats.read_any(spark, "x.bufr")


def test_streams(spark):
    path, cells = scratch_path(spark, "in"), scratch_path(spark, "cells")
    t0 = datetime(2007, 1, 1)
    rows = [(1, t0 + timedelta(minutes=m), float(m), 7) for m in (0, 5, 11, 30, 35)] + [(2, t0, 1.0, 8)]
    df = spark.createDataFrame(rows, "location_id bigint, time timestamp, v double, cell int")
    df.write.parquet(path)
    q = streams.append_cells(streams.files_stream(spark, path, df.schema, max_files=1), cells, scratch_path(spark, "cp"))
    q.awaitTermination()
    assert spark.read.parquet(cells).count() == 6
    kept = streams.run_to_memory(streams.drop_near_repeats(streams.files_stream(spark, path, df.schema), ["location_id"], "time", 600), "kept")
    assert {(r["location_id"], r["v"]) for r in kept.collect()} == {(1, 0.0), (1, 30.0), (2, 1.0)}
    means = streams.run_to_memory(streams.windowed_mean(streams.files_stream(spark, path, df.schema), "time", "location_id", "v", "1 hour"), "means", "complete")
    assert {(r["location_id"], r["n"]) for r in means.collect()} == {(1, 5), (2, 1)}
