"""Representations of point observations: point, indexed, contiguous, padded, orthogonal, raster.

The point form (a row per observation) is the canonical one. The other forms are tables or arrays derived from
it; ranks are made on the table of distinct instances only, never on the observations. A group's series is an
array of structs, so that further dimensions (beams) ride along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.session import cut


def locations(df: DataFrame, key: str, instance_vars: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per instance, its variables from its first observation by ``order``."""
    firsts = F.min_by(F.struct(*instance_vars), F.struct(*order)).alias("_i")
    return df.groupBy(key).agg(firsts).select(key, *[F.col(f"_i.{v}").alias(v) for v in instance_vars])


def ranked(ids: DataFrame, key: str, name: str = "location_index") -> DataFrame:
    """Rank from 0 of each distinct id. Range partitions are numbered side by side: each counts its ids, and the
    counts before it are added; no task orders all of them."""
    parts = cut(ids.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()))
    n = parts.groupBy("_p").count().collect()  # a row per partition
    before, total = {}, 0
    for r in sorted(n, key=lambda r: r["_p"]):
        before[r["_p"]], total = total, total + r["count"]
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_p")] if before else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return parts.select(key, (base + inside).cast("int").alias(name))


def to_indexed(df: DataFrame, key: str, instance_vars: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(observations with ``location_index``, locations with it)."""
    loc = locations(df, key, instance_vars, order)
    index = ranked(loc, key)
    i = index.select(F.col(key).alias("_k"), "location_index")
    obs = df.drop(*instance_vars).join(i, F.col(key) == F.col("_k")).drop("_k", key)
    return obs, loc.join(i, F.col(key) == F.col("_k")).drop("_k")


def indexed_to_point(obs: DataFrame, loc: DataFrame) -> DataFrame:
    right = loc.withColumnRenamed("location_index", "_i")
    return obs.join(right, F.col("location_index") == F.col("_i")).drop("_i", "location_index")


def to_contiguous(df: DataFrame, key: str, fields: Sequence[str], sort: Sequence[str], instance_vars: Sequence[str] = (), part: Column | None = None) -> DataFrame:
    """One row per instance: ``series`` (structs in order of ``sort``, then of all fields) and ``row_size``.

    The form has an instance's series in one array. Where instances can outgrow a row, ``part`` (an expression
    that rises with ``sort``, such as the month) cuts them: a row per instance and part, in column ``part``.
    """
    head = [*sort, *[f for f in fields if f not in sort]]
    aggs = [F.array_sort(F.collect_list(F.struct(*head))).alias("series"), F.count(F.lit(1)).alias("row_size")]
    if instance_vars:
        aggs.append(F.min_by(F.struct(*instance_vars), F.struct(*head)).alias("_i"))
    parts = [part.alias("part")] if part is not None else []
    out = df.groupBy(key, *parts).agg(*aggs)
    return out.select(key, *(["part"] if parts else []), *[F.col(f"_i.{v}").alias(v) for v in instance_vars], "series", "row_size")


def indexed_to_contiguous(obs: DataFrame, loc: DataFrame, fields: Sequence[str], sort: Sequence[str]) -> DataFrame:
    """Instances without observations keep a row of size 0."""
    series = to_contiguous(obs, "location_index", fields, sort).withColumnRenamed("location_index", "_i")
    out = loc.join(series, F.col("location_index") == F.col("_i"), "left").drop("_i")
    return out.withColumn("row_size", F.coalesce("row_size", F.lit(0)))


def contiguous_to_point(df: DataFrame) -> DataFrame:
    """Every element of ``series`` with its instance's variables."""
    keep = [c for c in df.columns if c not in ("series", "row_size")]
    return df.select(*keep, F.inline("series"))


def contiguous_to_indexed(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    keep = [c for c in df.columns if c not in ("series", "row_size")]
    index = ranked(df, key).withColumnRenamed(key, "_k")
    both = df.join(index, F.col(key) == F.col("_k")).drop("_k")
    return both.select("location_index", F.inline("series")), both.select("location_index", *keep)


def trim_series(df: DataFrame, keep) -> DataFrame:
    """Filter the elements of each series; emptied instances stay with size 0."""
    out = df.withColumn("series", F.filter("series", keep))
    return out.withColumn("row_size", F.size("series"))


def to_incomplete(df: DataFrame, fields: Sequence[str], fill: dict[str, Column]) -> DataFrame:
    """Each field as an array padded to the longest series (a maximum of one row, sent to all)."""
    longest = df.agg(F.max("row_size").alias("_n"))
    wide = df.join(F.broadcast(longest), F.lit(True))
    keep = [c for c in df.columns if c not in ("series",)]
    pad = lambda f: F.concat(F.transform("series", lambda s: s[f]), F.array_repeat(fill[f], (F.col("_n") - F.col("row_size")).cast("int")))
    return wide.select(*keep, *[pad(f).alias(f) for f in fields])


def incomplete_to_contiguous(df: DataFrame, fields: Sequence[str], missing) -> DataFrame:
    """Drop the elements whose first field is ``missing`` (a condition on its value)."""
    zipped = F.filter(F.arrays_zip(*fields), lambda s: ~missing(s[fields[0]]))
    keep = [c for c in df.columns if c not in (*fields, "row_size")]
    out = df.select(*keep, zipped.alias("series"))
    return out.withColumn("row_size", F.size("series").cast("bigint"))


def to_orthogonal(df: DataFrame, key: str, element: str, fields: Sequence[str], tie: Sequence[str] = (), strict: bool = True, max_cells: int = 10**10, max_elements: int = 10**6) -> DataFrame:
    """Every instance with every element (long form); several observations of one cell: the last by ``tie``.

    ``strict``: raises ValueError unless each cell has exactly one observation. The dense form has instances
    times elements rows; more than ``max_cells``, or an axis of more than ``max_elements`` (which is sent to all
    executors), are refused rather than attempted.
    """
    one = df.groupBy(key, element).agg(F.max_by(F.struct(*fields), F.struct(*(tie or fields))).alias("_v"), F.count(F.lit(1)).alias("_n"))
    ids, elements = one.select(key).distinct(), one.select(element).distinct()
    n_ids, n_elements = ids.count(), elements.count()
    if n_ids * n_elements > max_cells or n_elements > max_elements:
        raise ValueError(f"{n_ids} x {n_elements} cells are more than {max_cells}")
    if strict:
        n, least = one.agg(F.count(F.lit(1)), F.max("_n")).first()
        if n != n_ids * n_elements or (least or 0) > 1:
            raise ValueError("the observations are not orthogonal")
    # The elements are made an array once (its size is n_elements, checked above) and exploded per instance.
    axis = elements.agg(F.array_sort(F.collect_set(element)).alias("_axis"))
    cells = ids.join(F.broadcast(axis), F.lit(True)).select(F.col(key).alias("_k"), F.explode("_axis").alias("_e"))
    out = cells.join(one, (F.col("_k") == F.col(key)) & (F.col("_e") == F.col(element)), "left")
    return out.select(F.col("_k").alias(key), F.col("_e").alias(element), *[F.col(f"_v.{f}").alias(f) for f in fields])


def to_raster(df: DataFrame, y: str, x: str, xs: Sequence, value: str) -> DataFrame:
    """A row per ``y``, a column per given ``x``."""
    return df.groupBy(y).pivot(x, list(xs)).agg(F.max(value))


def offsets(df: DataFrame, key: str) -> DataFrame:
    """Start of each instance in the contiguous sample dimension: the sizes before it, in order of the key.

    Partial sums by range partition, then inside: no task sums all instances.
    """
    parts = cut(df.select(key, "row_size").repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.sum("row_size").alias("s")).collect()  # a row per partition
    before, total = {}, 0
    for r in sorted(sums, key=lambda r: r["_p"]):
        before[r["_p"]], total = total, total + r["s"]
    base = F.create_map(*[F.lit(v).cast("bigint") for kv in before.items() for v in kv])[F.col("_p").cast("bigint")] if before else F.lit(0).cast("bigint")
    w = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, "row_size", (base + F.coalesce(F.sum("row_size").over(w), F.lit(0))).alias("row_start"))


def append(obs: DataFrame, loc: DataFrame, more_obs: DataFrame, more_loc: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Two indexed sets as one; locations of both are merged (the first set's win) and ranked anew."""
    ids = lambda o, lo: o.join(lo.select(F.col("location_index").alias("_i"), F.col(key)), F.col("location_index") == F.col("_i")).drop("_i", "location_index")
    points = ids(obs, loc).unionByName(ids(more_obs, more_loc))
    both = loc.withColumn("_s", F.lit(0)).unionByName(more_loc.withColumn("_s", F.lit(1))).drop("location_index")
    rest = [c for c in both.columns if c not in (key, "_s")]
    merged = both.groupBy(key).agg(F.min_by(F.struct(*rest), "_s").alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    index = ranked(merged, key).withColumnRenamed(key, "_k")
    new_obs = points.join(index, F.col(key) == F.col("_k")).drop("_k", key)
    return new_obs, merged.join(index, F.col(key) == F.col("_k")).drop("_k")


def merge_orthogonal(a: DataFrame, b: DataFrame, key: str, element: str, fields: Sequence[str]) -> DataFrame:
    """Two dense sets as one over all instances and elements of either; where both have a cell the first one's value
    that is not NULL counts. Cells of neither are not made up: ``to_orthogonal`` fills them in."""
    both = a.select(key, element, F.lit(0).alias("_s"), *fields).unionByName(b.select(key, element, F.lit(1).alias("_s"), *fields))
    return both.groupBy(key, element).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_s"))).alias(f) for f in fields])


def only_locations(df: DataFrame, key: str, instance_vars: Sequence[str]) -> DataFrame:
    """The instances alone, without observations; the smallest value where an instance has several."""
    return df.groupBy(key).agg(*[F.min(v).alias(v) for v in instance_vars]) if instance_vars else df.select(key).distinct()


def only_observations(df: DataFrame, instance_vars: Sequence[str]) -> DataFrame:
    """The observations without what belongs to their instance."""
    return df.drop(*instance_vars)
