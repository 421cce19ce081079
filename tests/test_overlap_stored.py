"""J-12: pairs of many windows are handed on so that they are stored in little space."""

import os

from pyspark.sql import functions as F

from vitalgrid.operators import sessions as U

DAY = 86_400


def test_pairs_of_windows_of_one_time_are_stored_in_little_space(spark, tmp_path):
    at = (F.xxhash64("id") % 150 + 500) * DAY
    chunks = spark.range(9_000, numPartitions=2).select(F.col("id").alias("byteStart"), at.alias("firstStrapTs"), (at + F.col("id") % 4 * DAY).alias("lastStrapTs"))
    windows = chunks.select(F.col("byteStart").alias("windowId"), F.col("firstStrapTs").alias("fromTs"), (F.col("firstStrapTs") + 3_600).alias("toTs"))
    out = str(tmp_path / "pairs")
    U.interval_overlap_join(chunks, windows).select("windowId", "byteStart").write.parquet(out)
    got = spark.read.parquet(out)
    want = chunks.join(windows, (F.col("lastStrapTs") >= F.col("fromTs")) & (F.col("firstStrapTs") <= F.col("toTs"))).select("windowId", "byteStart")
    assert got.count() == want.count() == got.distinct().count() and not got.exceptAll(want).head(1)
    size = sum(os.path.getsize(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".parquet"))
    assert size < 1.2 * got.count(), size / got.count()


def test_many_windows_of_one_time_and_odd_ones(spark, monkeypatch):
    monkeypatch.setattr(U, "ALIKE", 3)
    chunks = spark.createDataFrame([(1, 0, 5 * DAY), (2, 2 * DAY, 2 * DAY), (3, None, 5), (4, 9 * DAY, 8 * DAY), (1, 0, 5 * DAY)], "byteStart long, firstStrapTs long, lastStrapTs long")
    windows = spark.createDataFrame([*[(i, 2 * DAY, 2 * DAY + 5, "x") for i in range(10)], (9, 2 * DAY, 2 * DAY + 5, "x"), (20, DAY, 3 * DAY, None), (21, None, DAY, "x"), (22, 3 * DAY, DAY, "x"), (23, 7 * DAY, 10 * DAY, "x"), (None, 2 * DAY, 2 * DAY + 5, "x")], "windowId long, fromTs long, toTs long, note string")
    got = U.interval_overlap_join(chunks, windows)
    assert got.columns == [*chunks.columns, *windows.columns]
    want = chunks.crossJoin(windows).where("lastStrapTs >= fromTs and firstStrapTs <= toTs")
    assert got.count() == want.count() and not got.exceptAll(want).head(1) and not want.exceptAll(got).head(1)
