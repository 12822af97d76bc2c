"""Readers of swath and cell tables by time and place.

A place is given as one of: cells, location ids, coordinates (nearest grid point within a distance), a box, or a
ring. It is turned into grid points, these into cells (at most a few thousand, whatever the data) that prune
partitions, and then into a semi-join. Periods are closed for swaths and half-open for cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.operators import select


def grid_points(grid: DataFrame, cells: Sequence[int] | None = None, location_ids: Sequence[int] | None = None, coords: Sequence[tuple[float, float]] | None = None, max_m: float = float("inf"), bbox: select.Bbox | None = None, ring: Sequence[tuple[float, float]] | None = None) -> DataFrame | None:
    """The grid points (gpi, cell) of one place; None if no place is given."""
    given = [p for p in (cells, location_ids, coords, bbox, ring) if p is not None]
    if not given:
        return None
    if len(given) > 1:
        raise ValueError("give one of cells, location_ids, coords, bbox, ring")
    if cells is not None:
        out = select.by_cells(grid, cells)
    elif location_ids is not None:
        out = select.by_ids(grid, location_ids, "gpi")
    elif coords is not None:
        near = select.nearest(grid, coords, max_m).select(F.col("gpi").alias("_g")).distinct()
        out = grid.join(near, F.col("gpi") == F.col("_g"), "left_semi")
    elif bbox is not None:
        out = select.in_bbox(grid, bbox)
    else:
        out = select.in_polygon(grid, ring)
    return out.select("gpi", "cell")


class GridTable:
    """A folder of observations on a grid (gpi, lat, lon, cell)."""

    closed = "closed"

    def __init__(self, spark: SparkSession, path: str, grid: DataFrame, key: str = "location_id", time: str = "time", preprocess: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark, self.path, self.grid, self.key, self.time, self.preprocess = spark, path, grid, key, time, preprocess

    def _scan(self) -> DataFrame:
        return self.preprocess(self.spark.read.parquet(self.path))

    def _prune(self, df: DataFrame, points: DataFrame) -> DataFrame:
        return df

    def read(self, period: tuple | None = None, **place) -> DataFrame:
        """Rows of a period and place; an empty table if there are none."""
        df = self._scan()
        if period:
            df = select.in_period(df, *period, time=self.time, closed=self.closed)
        points = grid_points(self.grid, **place)
        if points is None:
            return df
        return select.by_ids(self._prune(df, points), points.select("gpi"), self.key)


class SwathTable(GridTable):
    """Swaths: closed periods; ``file_time`` partitions, if there are, are pruned with a day's margin."""

    def read(self, period: tuple | None = None, **place) -> DataFrame:
        df = super().read(period, **place)
        if period and "file_date" in df.columns:
            day = lambda t, n: F.date_add(F.to_date(F.lit(str(t))), n)
            df = df.where(F.col("file_date").between(day(period[0], -1), day(period[1], 1)))
        return df


class CellTable(GridTable):
    """Cell folders: half-open periods; only the folders of the place's cells are read."""

    closed = "left"

    def cells(self, points: DataFrame) -> list[int]:
        return sorted(r[0] for r in points.select("cell").distinct().collect())  # at most 2592 cells of 5 degrees

    def _prune(self, df: DataFrame, points: DataFrame) -> DataFrame:
        return select.by_cells(df, self.cells(points))

    def read_series(self, location_id: int, variables: Sequence[str] | None = None) -> DataFrame:
        """One location's series in order of time, of the given variables; only its cell's folder is read."""
        df = self.read(location_ids=[location_id]).orderBy(self.time)
        return df.select(self.key, self.time, *variables) if variables else df


class DenseTable(CellTable):
    """Cell folders of dense sets (every location has every time): periods are closed."""

    closed = "closed"
