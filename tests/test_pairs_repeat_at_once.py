"""J-12 and J-8: where many windows or samples share a time, pairs are handed on list by list, and stored in little space."""

import os

from pyspark.sql import functions as F

from vitalgrid.operators import sessions as U

HOUR, DAY = 3_600, 86_400


def stored(df, out):
    """Rows, different rows, and bytes a row."""
    df.write.parquet(out)
    got = df.sparkSession.read.parquet(out)
    size = sum(os.path.getsize(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".parquet"))
    n, distinct = got.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*got.columns), 0.01)).first()
    return n, distinct, size / n


def test_windows_of_one_time(spark, tmp_path):
    chunks = spark.range(800).select(F.xxhash64("id").alias("byteStart"), F.lit(500 * DAY).alias("firstStrapTs"), F.lit(501 * DAY).alias("lastStrapTs"))
    windows = spark.range(8_000).select(F.xxhash64("id").alias("windowId"), F.lit(500 * DAY).alias("fromTs"), F.lit(500 * DAY + HOUR).alias("toTs"))
    n, distinct, each = stored(U.interval_overlap_join(chunks, windows).select("windowId", "byteStart"), str(tmp_path / "pairs"))
    assert n == 800 * 8_000 and abs(distinct / n - 1) < 0.05
    assert each < 0.25, each


def test_samples_of_one_hour(spark, tmp_path):
    sessions = spark.range(600).select(F.concat(F.lit("s"), "id").alias("deviceId"), (500 * DAY - F.col("id")).alias("startTs"), (500 * DAY + 2 * HOUR + F.col("id")).alias("endTs"))
    samples = spark.range(8_000).select(F.concat(F.lit("x"), F.xxhash64("id") % 5_000).alias("deviceId"), (500 * DAY + F.pmod(F.xxhash64("id"), F.lit(HOUR))).alias("ts"), (F.col("id") % 97).cast("int").alias("bpm"))
    n, distinct, each = stored(U.session_sample_join(sessions, samples), str(tmp_path / "pairs"))
    assert n == 600 * 8_000 and abs(distinct / n - 1) < 0.05
    assert each < 0.5, each
