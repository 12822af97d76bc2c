"""Irregular readings onto a regular grid: one row per source and step, gaps marked and filled.

Readings are first combined per source and step (map-side, so a hot source shrinks to its steps). The steps of
a source are cut into time shards of ``SHARD_STEPS`` steps. Every shard fills the gaps between its own steps without
looking at any other. It is summarised by its first and last step that has a reading; a prefix scan over these
summaries alone (two steps a shard) carries the last state over to the next shard and gives the gaps that lie across
borders. No task holds more of a source than a shard. A gap of many shards is handed out piece by piece, so that no
task makes more than a shard of rows for one input row.

Filling: ``last`` carries the last value forward, ``linear`` interpolates between the readings on both sides.

Defined results: rows without key, time or value count as no reading; a step between the first and last one
with a reading is ``missing`` if it has none; equal times and repeated rows are averaged in their step; a
source without any usable reading has no rows; steps before 1970 have negative numbers; a step width of NULL
or below 1 gives no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_STEPS = 4096


def step_readings(df: DataFrame, keys: Sequence[str], time_s: Column, step_s: Column, value: Column) -> DataFrame:
    """Source, step width and step number with the count and mean of its usable readings."""
    at = [F.col(k) for k in keys]
    rows = df.select(*at, time_s.alias("_t"), step_s.cast("bigint").alias("_w"), value.cast("double").alias("_v"))
    rows = rows.dropna().where("_w >= 1").withColumn("_step", F.floor(F.col("_t") / F.col("_w")).cast("bigint"))
    return rows.groupBy(*keys, "_w", "_step").agg(F.count(F.lit(1)).alias("n_readings"), F.avg("_v").alias("value"))


def _gaps(steps: DataFrame, keys: Sequence[str], shard_steps: int, *state: str) -> DataFrame:
    """Keys, step width and ``_g`` (first and last missing step, ``state`` columns of the readings before and after)."""
    group = [*keys, "_w"]
    inside = steps.withColumn("_shard", F.floor(F.col("_step") / shard_steps).cast("bigint")).select(*group, "_shard", F.struct("_step", *state).alias("_p"))
    own = inside.withColumn("_q", F.lag("_p").over(Window.partitionBy(*group, "_shard").orderBy("_p._step")))
    ends = inside.groupBy(*group, "_shard").agg(F.min("_p").alias("_p"), F.max("_p").alias("_last"))
    ends = ends.withColumn("_q", F.lag("_last").over(Window.partitionBy(*group).orderBy("_shard")))
    both = own.select(*group, "_p", "_q").unionByName(ends.select(*group, "_p", "_q")).where(F.col("_p._step") > F.col("_q._step") + 1)
    gap = [(F.col("_q._step") + 1).alias("a"), (F.col("_p._step") - 1).alias("b")]
    return both.select(*group, F.struct(*gap, *[F.col(f"_q.{c}").alias(f"{c}_a") for c in state], *[F.col(f"_p.{c}").alias(f"{c}_b") for c in state]).alias("_g"))


def missing_steps(df: DataFrame, keys: Sequence[str], time_s: Column, step_s: Column, value: Column, shard_steps: int = SHARD_STEPS) -> DataFrame:
    """Keys, step width and number of every step without a usable reading between a source's first and last."""
    return _unroll(_gaps(step_readings(df, keys, time_s, step_s, value), keys, shard_steps), keys, shard_steps)


def _unroll(rows: DataFrame, keys: Sequence[str], shard_steps: int, *extra: str) -> DataFrame:
    """Every step of the gaps ``_g``, by way of pieces of at most ``shard_steps`` steps."""
    piece = F.explode(F.sequence(F.col("_g")["a"], F.col("_g")["b"], F.lit(shard_steps).cast("bigint")))
    cut = rows.select(*keys, "_w", "_g", *extra, piece.alias("_a"))
    end = F.least(F.col("_a") + (shard_steps - 1), F.col("_g")["b"])
    return cut.select(*keys, "_w", *extra, F.explode(F.sequence(F.col("_a"), end)).alias("_step"))


def regular_series(df: DataFrame, keys: Sequence[str], time_s: Column, step_s: Column, value: Column, fill: str = "last", shard_steps: int = SHARD_STEPS) -> DataFrame:
    """The whole regular series: keys, step_start_s, n_readings (0 where missing), value, filled, missing."""
    if fill not in ("last", "linear"):
        raise ValueError(f"fill must be last or linear, not {fill!r}")
    steps = step_readings(df, keys, time_s, step_s, value)
    full = steps.select(*keys, "_w", "_step", "n_readings", "value", F.col("value").alias("filled"), F.lit(False).alias("missing"))
    rows = _unroll(_gaps(steps, keys, shard_steps, "value").withColumn("_e", F.col("_g")), keys, shard_steps, "_e")
    share = (F.col("_step") - F.col("_e.a") + 1) / (F.col("_e.b") - F.col("_e.a") + 2)
    filled = F.col("_e.value_a") if fill == "last" else F.col("_e.value_a") + (F.col("_e.value_b") - F.col("_e.value_a")) * share
    empty = rows.select(*keys, "_w", "_step", F.lit(0).cast("bigint").alias("n_readings"), F.lit(None).cast("double").alias("value"), filled.alias("filled"), F.lit(True).alias("missing"))
    return full.unionByName(empty).select(*keys, (F.col("_step") * F.col("_w")).alias("step_start_s"), "n_readings", "value", "filled", "missing")
