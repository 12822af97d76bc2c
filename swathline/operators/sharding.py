"""Work on ordered groups of any size.

Most groups (one source's readings) are small and are spread by a hash of their key. A group may hold a
third of all rows, though; such groups are cut into range-sorted chunks of bounded size instead, whose
boundary states are joined by a scan over the chunks' summaries. ``split_hot`` tells the two apart with one
map-side combined count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.session import cut, partitions_for

#: Rows above which one group is cut into chunks, and rows aimed at in a chunk.
MAX_GROUP_ROWS = 400_000
CHUNK_ROWS = 200_000
#: Rows aimed at in a partition of whole groups.
PARTITION_ROWS = 200_000


@dataclass
class Split:
    """``whole``: the rows of groups small enough for one task; ``hot``: the others, or None."""

    whole: DataFrame
    hot: DataFrame | None
    rows: int
    hot_rows: int


def split_hot(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_GROUP_ROWS) -> Split:
    """Split off the groups of more than ``max_rows`` rows.

    The counts are combined before the shuffle; at most rows / ``max_rows`` keys can be hot, and they stay a
    table (joined null-safely, broadcast only if Spark finds it small). Empty input: no hot part.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_n") > max_rows, F.col("_n"))).alias("h")).first()
    rows, hot_rows = int(total["n"] or 0), int(total["h"] or 0)
    if not hot_rows:
        return Split(df, None, rows, 0)
    hot = counts.where(F.col("_n") > max_rows).select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    return Split(df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi"), rows, hot_rows)


def by_group(split: Split, keys: Sequence[str], order: Sequence[str], per_partition: int = PARTITION_ROWS) -> DataFrame:
    """The whole groups, each in one partition, sorted by key and order."""
    n = partitions_for(split.whole.sparkSession, split.rows - split.hot_rows, per_partition)
    return split.whole.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def range_chunks(df: DataFrame, rows: int, keys: Sequence[str], order: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Hot groups as sorted chunks: one partition each, fixed by a checkpoint so that two passes see the same cuts.

    Ranges are over key and order together, so a group is cut even where all its times are equal (the order
    ends in the unique row id). Column ``_chunk`` numbers them in order.
    """
    n = max(2, -(-rows // chunk_rows))
    return cut(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_chunk", F.spark_partition_id()))


def last_before(df: DataFrame, keys: Sequence[str], order: str, values: dict, shard_span: int = 4096) -> DataFrame:
    """Add, for every name of ``values``, the last non-NULL value among the rows before this one in its group.

    ``order`` is a whole number, unique in a group. Groups are cut at multiples of ``shard_span`` of it, so that
    no task holds a whole group; the shards' last values are carried over by a scan of one row per shard.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_shard", F.floor(F.col(order) / shard_span).cast("bigint")).withColumns({f"_m_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*keys, "_shard").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in_{n}": F.last(f"_m_{n}", ignorenulls=True).over(inside) for n in values})
    ends = rows.groupBy(*keys, "_shard").agg(*[F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in values])
    over = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_shard").alias("_k_shard"), *[F.last(f"_e_{n}", ignorenulls=True).over(over).alias(f"_c_{n}") for n in values])
    same = F.col("_shard") == F.col("_k_shard")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(ends, same, "left").withColumns({n: F.coalesce(f"_in_{n}", f"_c_{n}") for n in values})
    return out.select(*df.columns, *values)
