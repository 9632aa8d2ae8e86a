"""Checked broadcasts, salted joins and written tables."""

from pyspark.sql import functions as F

from larder import runtime as R


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else str(i % 7)) for i in range(300)] + [(999, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("0", 2), ("1", 3)], "k string, v int")
    for how in ("inner", "left"):
        assert sorted(map(tuple, R.salted_join(left, right, ["k"], 4, how).select("i", "k", "v").collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).select("i", "k", "v").collect()), key=str)


def test_broadcast_is_checked(spark):
    df = spark.range(50)
    assert R.bounded(df, 50) and not R.bounded(df, 49)
    assert "broadcast" in R.small_broadcast(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in R.small_broadcast(df, row_bytes=R.BROADCAST_BYTES)._jdf.queryExecution().logical().toString().lower()


def test_scratch_cuts_lineage(spark):
    scratch = R.Scratch(spark, "test")
    saved = scratch.save(spark.createDataFrame([(1, None)], "a int, b string").withColumn("c", F.array("a")), "t")
    assert saved.first()["c"] == [1] and "Scan parquet" in saved._jdf.queryExecution().toString().replace("FileScan", "Scan") and scratch.root.startswith(R.shared_dir(spark).rstrip("/"))
    assert scratch.save(spark.createDataFrame([], "a int"), "empty").count() == 0
    scratch.drop("t", "empty")


def test_blanks(spark):
    df = spark.createDataFrame([("  a　b​﻿",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(R.blank_trim(F.col("v"))).collect()] == ["a　b", None, ""]
