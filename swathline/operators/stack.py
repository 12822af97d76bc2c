"""Swaths stacked into storage by spatial cell, merged, re-tiled and reprocessed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions.scalars import cell_number
from swathline.operators.select import drop_near_repeats


def with_cell(obs: DataFrame, grid: DataFrame, key: str = "location_id", gpi: str = "gpi") -> DataFrame:
    """Add the grid's cell; Spark broadcasts the grid only while it is small."""
    g = grid.select(F.col(gpi).alias("_g"), F.col("cell").alias("cell"))
    return obs.drop("cell").join(g, F.col(key) == F.col("_g")).drop("_g")


def write_cells(df: DataFrame, path: str, mode: str = "append", rows_per_file: int = 5_000_000, sort: Sequence[str] = ("location_id", "time")) -> None:
    """One folder per cell. A cell of many rows is spread over several tasks by location and time, so that one
    crowded cell is neither one task nor one file."""
    n = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files")).withColumnRenamed("cell", "_c")
    out = df.join(n, F.col("cell").eqNullSafe(F.col("_c"))).drop("_c").withColumn("_file", F.pmod(F.xxhash64(*sort), F.col("_files")))
    out = out.repartition("cell", "_file").sortWithinPartitions("cell", *sort).drop("_file", "_files")
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(path)


def read_cells(spark: SparkSession, path: str, cells: Sequence[int] | None = None) -> DataFrame:
    """A scan of the given cells' folders only."""
    df = spark.read.parquet(path)
    return df.where(F.col("cell").isin(list(cells))) if cells is not None else df


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows by name; columns that a part lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def retile(grid: DataFrame, size: float) -> DataFrame:
    """Distinct (new cell, old cell) pairs of a new cell size."""
    return grid.select(cell_number(F.col("lon"), F.col("lat"), size).alias("new_cell"), F.col("cell").alias("old_cell")).distinct()


def merge_and_write(parts: Sequence[DataFrame], grid: DataFrame, path: str, size: float, window_s: float, time_us: Column, keys: Sequence[str] = ("sat_id", "location_id"), tie: str = "obs_id") -> None:
    """Union of collections, without near repeats, in cells of a new size."""
    new = grid.withColumn("cell", cell_number(F.col("lon"), F.col("lat"), size))
    write_cells(with_cell(drop_near_repeats(merge(parts), keys, time_us, window_s, tie), new), path)


def reprocess(df: DataFrame, func: Callable, schema: str, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """A caller's function of pandas frames per group. A group meets in one task: choose keys fine enough."""
    return df.groupBy(*keys).applyInPandas(func, schema)


def stacked_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("cell").agg(F.count(F.lit(1)).alias("n_obs"), F.count_distinct("location_id").alias("n_locations"))
