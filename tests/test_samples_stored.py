"""J-8: samples of any device are handed on so that pairs are stored in little space."""

import os

from pyspark.sql import functions as F

from vitalgrid.operators import sessions as U


def _plain(sessions, samples):
    s, x = sessions.where("startTs <= endTs").distinct(), samples.withColumnRenamed("deviceId", "sampleDevice")
    return s.join(x, F.col("ts").between(F.col("startTs"), F.col("endTs"))).select(*U.SPAN, *x.columns)


def test_samples_of_any_device_are_stored_in_little_space(spark, tmp_path):
    pick = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    sessions = spark.range(2_000, numPartitions=2).select(F.concat(F.lit("s"), F.col("id")).alias("deviceId"), pick(1, 200_000).alias("startTs")).withColumn("endTs", F.col("startTs") + 21_600)
    samples = spark.range(6_000, numPartitions=2).select(F.concat(F.lit("x"), pick(2, 900)).alias("deviceId"), pick(3, 220_000).alias("ts"), (pick(4, 1_000_000) / 7).alias("bpm"))
    out = str(tmp_path / "pairs")
    U.session_sample_join(sessions, samples).write.parquet(out)
    got, want = spark.read.parquet(out), _plain(sessions, samples)
    assert got.count() == want.count() and not got.exceptAll(want).head(1)
    size = sum(os.path.getsize(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".parquet"))
    assert size < 2.5 * got.count(), size / got.count()


def test_equal_samples_nulls_and_many_of_one_second(spark, monkeypatch):
    monkeypatch.setattr(U, "ALIKE", 3)
    sessions = spark.createDataFrame([("a", 10, 4_000), ("a", 10, 4_000), ("b", 3_600, 3_600), ("c", 50, 10), (None, 0, 7_200)], "deviceId string, startTs long, endTs long")
    samples = spark.createDataFrame([*[("x", 3_600, i % 4) for i in range(10)], ("y", 4_000, None), ("y", 4_001, 1), (None, 9, 1), ("x", None, 5)], "deviceId string, ts long, bpm int")
    got, want = U.session_sample_join(sessions, samples), _plain(sessions, samples)
    assert got.columns == want.columns
    assert got.count() == want.count() and not got.exceptAll(want).head(1) and not want.exceptAll(got).head(1)
