"""Reading by period and place."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from swathline.functions.scalars import cell_number
from swathline.operators import grids, select, stack
from swathline.session import scratch_path
from swathline.sources import readers

T0 = datetime(2007, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    grid = grids.regular(spark, 5).select("gpi", "lat", "lon").withColumn("cell", cell_number(F.col("lon"), F.col("lat")))
    rows = [(g, T0 + timedelta(hours=i), float(i)) for g in (0, 1, 700, 1300, 2591) for i in range(5)]
    obs = spark.createDataFrame(rows, "location_id bigint, time timestamp_ntz, v double")
    swaths, cells = scratch_path(spark, "swaths"), scratch_path(spark, "cells")
    obs.withColumn("file_date", F.to_date("time")).write.partitionBy("file_date").parquet(swaths)
    stack.write_cells(stack.with_cell(obs, grid), cells)
    return grid, readers.SwathTable(spark, swaths, grid), readers.CellTable(spark, cells, grid)


def _ids(df):
    return {r["location_id"] for r in df.select("location_id").distinct().collect()}


def test_places_agree(tables):
    grid, swaths, cells = tables
    at = {r["gpi"]: r for r in grid.where("gpi IN (0, 1, 700, 1300, 2591)").collect()}
    p = at[700]
    ring = [(p["lon"] - 1, p["lat"] - 1), (p["lon"] + 1, p["lat"] - 1), (p["lon"] + 1, p["lat"] + 1), (p["lon"] - 1, p["lat"] + 1)]
    places = [
        ({"cells": [p["cell"]]}, {700}), ({"location_ids": [700, 1300, 99]}, {700, 1300}), ({"coords": [(p["lon"] + 0.1, p["lat"])]}, {700}),
        ({"coords": [(p["lon"] + 0.1, p["lat"])], "max_m": 10.0}, set()), ({"bbox": select.Bbox(p["lat"] - 1, p["lat"] + 1, -180, 180)}, {700}), ({"ring": ring}, {700}), ({}, set(at)),
    ]
    for place, want in places:
        assert _ids(swaths.read(**place)) == want == _ids(cells.read(**place)), place


def test_periods(tables):
    _, swaths, cells = tables
    period = (T0, T0 + timedelta(hours=2))
    assert swaths.read(period).count() == 15 and cells.read(period).count() == 10
    with pytest.raises(ValueError):
        cells.read(cells=[1], location_ids=[1])


def test_cells_prune_folders(tables):
    _, _, cells = tables
    plan = cells.read(location_ids=[700])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]
