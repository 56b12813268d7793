"""Ordered window operators that stay parallel.

A window with ``orderBy`` and no (or a hot) ``partitionBy`` runs in one task.
The two helpers here compute the same result as ``row_number()`` /
``sum() over (rows unbounded preceding)`` but split the ordered data into
range partitions first: each range is numbered / summed locally, and a small
table of per-range totals (one row per range and key) supplies the offsets.
Memory per task is bounded by the range size, whatever the key skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _ranges(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    """``df`` in sorted ranges of ``order`` with the range number ``_rng`` and the place in it ``_local``, both stored.

    Range bounds come from a sample, and two evaluations of one plan may sample
    (or be pruned) differently; the ranged rows are therefore written once to the
    checkpoint folder, and totals and rows are both read from there.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_rng", F.spark_partition_id())
    base = F.col("_rng").cast("long") * F.lit(1 << 33)
    return ranged.withColumn("_local", F.monotonically_increasing_id() - base + 1).checkpoint(eager=True)


def dense_sequence(df: DataFrame, order: list[str], name: str = "seq_no",
                   partitions: int | None = None) -> DataFrame:
    """Global ``row_number()`` (1-based) over ``order``; ``order`` must be a total order.

    One range shuffle: each range is sorted in place and numbered by its
    position, plus the size of the earlier ranges taken from a table of one row
    per range (broadcast: bounded by the range count)."""
    ranged = _ranges(df, order, partitions)
    sizes = ranged.groupBy("_rng").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select("_rng", (F.sum("_n").over(Window.orderBy("_rng")) - F.col("_n")).alias("_off"))
    return (ranged.join(F.broadcast(offs), "_rng")
            .withColumn(name, F.col("_local") + F.col("_off"))
            .drop("_rng", "_local", "_off"))


def running_sum(df: DataFrame, key: str, order: list[str], value: str, name: str = "running",
                partitions: int | None = None) -> DataFrame:
    """``sum(value) over (partition by key order by order rows unbounded preceding)``.

    The data is range-partitioned on (key, order...), so one hot key is spread
    over many ranges; each range sums locally and adds the totals of the
    earlier ranges of the same key.
    """
    ranged = _ranges(df, [key, *order], partitions).drop("_local")
    totals = ranged.groupBy("_rng", key).agg(F.sum(value).alias("_tot"))
    w_prev = Window.partitionBy(key).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_rng", key, F.coalesce(F.sum("_tot").over(w_prev), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_rng", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # offs has one row per (range, key): small when keys are few, and AQE turns
    # the join into a broadcast at run time only when it measures it small.
    return (ranged.withColumn("_local", F.sum(value).over(local))
            .join(offs, ["_rng", key])
            .withColumn(name, F.col("_local") + F.col("_off"))
            .drop("_rng", "_local", "_off"))


def previous_value(df: DataFrame, key: str, order: list[str], value: str, name: str = "prev",
                   partitions: int | None = None) -> DataFrame:
    """``lag(value) over (partition by key order by order)`` without a hot task.

    Ranges of (key, order) get their local ``lag``; the first row of a key in
    a range takes the last value of the same key in the closest earlier range
    (a table with one row per range and key)."""
    ranged = _ranges(df, [key, *order], partitions).drop("_local")
    local = Window.partitionBy("_rng", key).orderBy(*order)
    ends = ranged.groupBy("_rng", key).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    w_prev = Window.partitionBy(key).orderBy("_rng")
    carry = ends.select("_rng", key, F.lag("_last").over(w_prev).alias("_carry"))
    return (ranged.withColumn("_lag", F.lag(value).over(local))
            .withColumn("_first", F.row_number().over(local) == 1)
            .join(carry, ["_rng", key])
            .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
            .drop("_rng", "_lag", "_first", "_carry"))


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """``row_number() <= n`` per group; Spark plans a partial group limit before
    the shuffle, so a hot group sends at most n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
