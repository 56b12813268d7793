"""Exact, linearly interpolated quantiles without a single-task merge.

Spark's exact ``percentile`` merges one value->count map per group in a final
task, so a global quantile over a huge column holds every distinct value in
one task.  Here the distinct values (pre-aggregated with their multiplicity)
are range-partitioned; per-partition counts (one row per partition) locate the
partition that holds each wanted rank, and only that partition is ordered.
Memory per task stays at (distinct values / partitions).

The interpolation is numpy's / DuckDB ``quantile_cont``'s "linear" rule:
position ``p * (n - 1)`` between the two neighbouring order statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(df: DataFrame, column: str, probs: list[float],
                      partitions: int | None = None) -> list[float | None]:
    """Quantiles of a numeric column (nulls ignored); ``None`` when empty."""
    spark = df.sparkSession
    vals = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counts = vals.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (counts.repartitionByRange(max(1, partitions), "v")
              .withColumn("pid", F.spark_partition_id())
              .persist())
    try:
        parts = (ranged.groupBy("pid")
                 .agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                 .orderBy("lo").collect())
        total = sum(r["n"] for r in parts)
        if total == 0:
            return [None for _ in probs]
        # cumulative start rank (0-based) of each partition, in value order
        starts, acc = [], 0
        for r in parts:
            starts.append(acc)
            acc += r["n"]

        def locate(rank: int) -> tuple[int, int]:
            i = max(k for k in range(len(parts)) if starts[k] <= rank)
            return parts[i]["pid"], rank - starts[i]

        positions = [p * (total - 1) for p in probs]
        ranks = sorted({r for pos in positions for r in (math.floor(pos), math.ceil(pos))})
        wanted = {r: locate(r) for r in ranks}
        # one job: order only the partitions that hold a wanted rank (each
        # holds ~1/partitions of the distinct values) and keep the rows whose
        # rank interval covers one
        w = Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cond = F.lit(False)
        for pid, local in wanted.values():
            cond = cond | ((F.col("pid") == pid) & (F.col("before") <= local) & (F.col("before") + F.col("c") > local))
        hits = (ranged.filter(F.col("pid").isin(sorted({pid for pid, _ in wanted.values()})))
                .select("pid", "v", "c", (F.sum("c").over(w) - F.col("c")).alias("before"))
                .filter(cond).collect())
        value = {}
        for r, (pid, local) in wanted.items():
            value[r] = next(h["v"] for h in hits if h["pid"] == pid and h["before"] <= local < h["before"] + h["c"])
        out = []
        for pos in positions:
            lo_r, hi_r = math.floor(pos), math.ceil(pos)
            lo, hi = value[lo_r], value[hi_r]
            out.append(lo + (hi - lo) * (pos - lo_r))
        return out
    finally:
        ranged.unpersist()
