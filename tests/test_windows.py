"""Parallel ordered windows equal the single-partition window functions,
also with one key holding most rows and under re-partitioning."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from wren.operators.windows import dense_sequence, running_sum


def _skewed(spark, n=400):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", (i * 37) % 101, (i % 5) - 2) for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string, t long, v long")


def test_dense_sequence_equals_row_number(spark):
    df = _skewed(spark)
    exp = df.withColumn("seq_no", F.row_number().over(Window.orderBy("t", "id")))
    got = dense_sequence(df.repartition(5), ["t", "id"], partitions=6)
    assert sorted(got.collect()) == sorted(exp.collect())


def test_running_sum_equals_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("running", F.sum("v").over(w))
    for parts in (1, 3, 9):
        got = running_sum(df.repartition(4, "id"), "key", ["t", "id"], "v", partitions=parts)
        assert sorted(got.select(*exp.columns).collect()) == sorted(exp.collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 20), st.integers(-3, 3)), min_size=1, max_size=40))
def test_running_sum_property(spark, rows):
    data = [(i, k, t, v) for i, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, key string, t long, v long")
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = sorted(df.withColumn("running", F.sum("v").over(w)).collect())
    got = sorted(running_sum(df, "key", ["t", "id"], "v", partitions=3).select("id", "key", "t", "v", "running").collect())
    assert got == exp


def test_previous_value_equals_lag(spark):
    from wren.operators.windows import previous_value
    df = _skewed(spark)
    exp = df.withColumn("prev", F.lag("t").over(Window.partitionBy("key").orderBy("t", "id")))
    for parts in (1, 4, 11):
        got = previous_value(df.repartition(3), "key", ["t", "id"], "t", "prev", partitions=parts)
        assert sorted(got.select(*exp.columns).collect()) == sorted(exp.collect())


def test_helpers_with_payload_columns(spark):
    """More rows than a bounds sample sees, and columns that one branch doesn't need: equal to plain windows."""
    n = 60_000
    df = (spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("key"), F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("t"),
                                (F.col("id") % 7 - 3).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("payload")))
    w = Window.partitionBy("key").orderBy("t", "id")
    plain = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("want_sum"), F.lag("t").over(w).alias("want_prev"))
    from wren.operators.windows import previous_value
    got = running_sum(df.repartition(5), "key", ["t", "id"], "v", partitions=6).join(plain, "id")
    assert got.where("running <> want_sum OR payload IS NULL").count() == 0 and got.count() == n
    got = previous_value(df.repartition(5), "key", ["t", "id"], "t", "prev", partitions=6).join(plain, "id")
    assert got.where("NOT (prev <=> want_prev)").count() == 0 and got.count() == n
    seq = dense_sequence(df.repartition(5), ["t", "id"], partitions=6)
    want = df.select("id", F.row_number().over(Window.orderBy("t", "id")).alias("want"))
    assert seq.join(want, "id").where("seq_no <> want").count() == 0 and seq.select("seq_no").distinct().count() == n
