"""Masking and aggregation by location and time step, in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name -> builder of (value, order): all skip NULL; order decides first, last and ties.
AGGREGATES = {
    "mean": lambda v, o: F.avg(v),
    "std": lambda v, o: F.stddev_pop(v),
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "median": lambda v, o: F.median(v),
    "sum": lambda v, o: F.sum(v),
    "count": lambda v, o: F.count(v),
    "first": lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)),
    "last": lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)),
}


def aggregate_column(name: str | Callable[[Column, Column], Column], value: Column, order: Column, q: float = 0.5, position: Column | None = None) -> Column:
    """An aggregate by name, or a caller's function of (value, order); ``argmin`` and ``argmax`` give ``position`` of the extreme (earliest on ties)."""
    if callable(name):
        return name(value, order)
    if name == "quantile":
        return F.percentile(value, q)
    if name in ("argmin", "argmax"):
        at = position if position is not None else order
        signed = value if name == "argmin" else -value
        return F.min_by(at, F.when(value.isNotNull(), F.struct(signed.alias("v"), order.alias("o"))))
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    return AGGREGATES[name](value, order)


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties; counted before any group meets."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("_n", (-F.col(value)).alias("_v"))).alias(value))


@dataclass(frozen=True)
class Masks:
    """Quality limits: a set surface flag drops the row, the others void the soil moisture only. An unknown
    probability voids nothing, an unknown surface flag drops."""

    frozen: float = 90
    snow: float = 90
    subsurface: float = 10
    sensitivity: float = 1.0


def masked(df: DataFrame, value: str, masks: Masks, frozen: str | None = None, snow: str | None = None, subsurface: str | None = None, sensitivity: str | None = None, surface_flag: str | None = None) -> DataFrame:
    out = df.where(F.col(surface_flag) == 0) if surface_flag else df
    bad = F.lit(False)
    for name, limit in ((frozen, masks.frozen), (snow, masks.snow), (subsurface, masks.subsurface)):
        if name:
            bad = bad | F.coalesce(F.col(name) > limit, F.lit(False))
    if sensitivity:
        bad = bad | F.coalesce(F.col(sensitivity) < masks.sensitivity, F.lit(False))
    return out.withColumn(value, F.when(~bad, F.col(value)))


def time_steps(df: DataFrame, time_us: Column, start_us: int, step_us: int, end_us: int, compat: bool = False) -> DataFrame:
    """Add ``step_no``: tumbling half-open steps from the start, by arithmetic rather than a range join.

    ``compat`` also counts a row that lies on a boundary in the step that ends there (steps closed on both
    sides), and has a last step that begins at the end.
    """
    t = time_us - start_us
    rows = df.withColumn("_t", t).where((F.col("_t") >= 0) & (F.col("_t") <= end_us - start_us + (step_us if compat else -1)))
    no = F.floor(F.col("_t") / step_us).cast("bigint")
    if not compat:
        return rows.withColumn("step_no", no).drop("_t")
    on_edge = (F.pmod("_t", F.lit(step_us)) == 0) & (no > 0)
    steps = F.when(on_edge, F.array(no - 1, no)).otherwise(F.array(no))
    last = (end_us - start_us) // step_us
    return rows.withColumn("step_no", F.explode(steps)).where(F.col("step_no") <= last).drop("_t")


def by_step(df: DataFrame, keys: Sequence[str], values: Sequence[str], how: str | Callable | None, order: Column, **options) -> DataFrame:
    """Aggregate values per key; groups whose values are all NULL stay. ``how`` None passes the rows through."""
    if how is None:
        return df.select(*keys, *values)
    return df.groupBy(*keys).agg(*[aggregate_column(how, F.col(v), order, **options).alias(v) for v in values])


def nested_mean(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str) -> DataFrame:
    """The mean over ``outer`` of the means over ``inner``."""
    return df.groupBy(*inner).agg(F.avg(value).alias(value)).groupBy(*outer).agg(F.avg(value).alias(value))


def by_calendar(df: DataFrame, keys: Sequence[str], time: str, period: str, value: str, how: str | Callable = "mean") -> DataFrame:
    """Aggregate by calendar period (month, year, ...), named by its last day."""
    start = F.date_trunc(period, F.col(time))
    end = F.last_day(F.col(time)) if period == "month" else F.to_date(start)
    return df.withColumn("period_end", end).groupBy(*keys, "period_end").agg(aggregate_column(how, F.col(value), F.col(time)).alias(value))


def dense_months(df: DataFrame, keys: Sequence[str], time: str, value: str, how: str | Callable = "mean", coords: Sequence[str] = ()) -> DataFrame:
    """``by_calendar`` by month with a row for every group and every month between the first and the last of all rows.

    ``coords``: columns of the group that are no keys; of several values the largest. Months are at most a few
    thousand, so each group is given the axis and explodes it by itself.
    """
    at = F.trunc(F.col(time), "month")
    cell = df.groupBy(*keys, at.alias("_m")).agg(aggregate_column(how, F.col(value), F.col(time)).alias(value), *[F.max(c).alias(c) for c in coords])
    span = df.agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    groups = cell.groupBy(*keys).agg(*[F.max(c).alias(c) for c in coords], F.count(F.lit(1)).alias("_n")).drop("_n")
    grid = groups.join(F.broadcast(span), F.lit(True)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *coords, F.explode(F.sequence("_a", "_z", F.expr("INTERVAL 1 MONTH"))).alias("_g"))
    same = F.col("_g") == F.col("_m")
    for i, k in enumerate(keys):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(k))
    out = grid.join(cell.drop(*coords), same, "left")
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *coords, F.last_day("_g").alias("period_end"), value)
