"""The job mains end to end on a small folder."""

from datetime import datetime, timedelta

import pytest

from swathline import cli
from swathline.session import scratch_path


@pytest.fixture(scope="module")
def folders(spark):
    t = datetime(2007, 1, 1)
    rows = [(1 + i % 2, t + timedelta(hours=6 * i), 10.0 * (i % 2), 5.0, float(i), 0, 95 if i == 3 else 0) for i in range(8)]
    obs, grid, targets = (scratch_path(spark, n) for n in ("obs", "grid", "targets"))
    spark.createDataFrame(rows, "location_id bigint, time timestamp_ntz, lat double, lon double, surface_soil_moisture double, surface_flag int, frozen_soil_probability int").write.parquet(obs)
    spark.createDataFrame([(1, 0.0, 5.0, 1351), (2, 10.0, 5.0, 1352)], "gpi bigint, lat double, lon double, cell int").write.parquet(grid)
    spark.createDataFrame([(7, 0.01, 5.0)], "target bigint, lat double, lon double").write.parquet(targets)
    return obs, grid, targets


def test_jobs(spark, folders):
    obs, grid, targets = folders
    out = {n: scratch_path(spark, n) for n in ("agg", "month", "regrid", "resample", "stack", "contiguous", "indexed", "point")}
    cli.main(["aggregate", obs, out["agg"], "2007-01-01 00:00:00", "2007-01-03 00:00:00", "1D", "mean", "--grid", grid], spark)
    got = {(str(r["step_start"])[:10], r["location_id"]): r["surface_soil_moisture"] for r in spark.read.parquet(out["agg"]).collect()}
    assert got == {("2007-01-01", 1): 1.0, ("2007-01-01", 2): 1.0, ("2007-01-02", 1): 5.0, ("2007-01-02", 2): 6.0}
    cli.main(["aggregate", obs, out["month"], "2007-01-01 00:00:00", "2007-02-01 00:00:00", "1M", "max", "--no-mask"], spark)
    assert spark.read.parquet(out["month"]).count() == 2
    cli.main(["regrid", obs, out["regrid"], grid, "30"], spark)
    assert spark.read.parquet(out["regrid"]).count() == 72
    cli.main(["resample", obs, out["resample"], targets, "--radius", "5000"], spark)
    assert spark.read.parquet(out["resample"]).first()["surface_soil_moisture"] is not None
    cli.main(["stack", obs, out["stack"], grid], spark)
    assert {r["cell"] for r in spark.read.parquet(out["stack"]).select("cell").distinct().collect()} == {1351, 1352}
    cli.main(["convert", out["stack"], out["contiguous"], "contiguous"], spark)
    cli.main(["convert", out["contiguous"], out["point"], "point"], spark)
    assert spark.read.parquet(out["point"]).count() == 8
    cli.main(["convert", out["stack"], out["indexed"], "indexed"], spark)
    assert spark.read.parquet(out["indexed"] + "/observations").count() == 8


def test_bad_arguments(spark, folders):
    with pytest.raises(ValueError):
        cli.step_seconds("1X")
    with pytest.raises(SystemExit):
        cli.main(["convert", folders[0], "/tmp/x", "other"], spark)
