"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wren.session import ensure_checkpoint_dir, shuffles_dropped


def _stars(edges: DataFrame) -> DataFrame:
    """``(u, v, m)``: every edge with the least node next to ``u``, ``u`` itself included."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _stars(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small star: from u to its smaller neighbours and itself
    stars = _stars(large)
    small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(stars.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node on an edge ``(u, v)`` of 64-bit ids; the root is the least node of the component.

    Loops and repeated edges do no harm; an empty table gives an empty one.
    No neighbour list is ever gathered: a round takes minima and joins, and its
    result is written to the checkpoint folder.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    with shuffles_dropped(edges.sparkSession):
        now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint(eager=True)
    state = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state or not row["n"]:
            break
        state = row["n"], row["h"]
        with shuffles_dropped(edges.sparkSession):
            now = _round(now).checkpoint(eager=True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
