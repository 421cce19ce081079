import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import requests as Q
from vitalgrid.schemas import SERVER, STREAMS


@pytest.fixture(scope="module")
def tables(spark):
    rows = {
        "hrSample": [("d", t, 60) for t in range(0, 600, 10)],
        "ppgHrSample": [("d", 5, 70.4, 0.9), ("d", 10, 99.0, 0.9)],
        "sleepStateSample": [("d", t, 1) for t in (0, 100, 300)],
        "event": [("d", 1, "BATTERY_LEVEL(3)", "{}", 0), ("d", 2, "BOOT(1)", '{"a":1}', 0)],
        "imuActivity": [("d", t, 1.0, 1.0, 1.0, None, 0.0, 100) for t in (0, 1, 90)],
        "stepSample": [("d", 0, 5, 1), ("d", 10, 9, 1)], "gravitySample": [], "appleStepHour": [("apple-health", 0, 7)],
        "battery": [("d", 0, 50.0, 4000, 0, None)], "skinTempSample": [("d", 0, 3200)], "pairedDevice": [], "rrInterval": [("d", 1, 800, 0, 0)],
    }
    return {name: spark.createDataFrame(own, STREAMS[name]) for name, own in rows.items()}


@pytest.fixture(scope="module")
def journal(spark):
    return spark.createDataFrame([(1, "e", "delete_hr_range", '{"deviceId":"d","fromTs":0,"toTs":99}', None, None, 1, None)], SERVER["editJournal"])


def test_times():
    assert (Q.second_of("1970-01-02"), Q.second_of("1970-01-02", True), Q.second_of("1970-01-01T01:00:00+01:00"), Q.second_of("1970-01-01T00:00:09")) == (86_400, 172_799, 0, 9)
    with pytest.raises(ValueError, match="bad_range"):
        Q.second_of("soon")


def test_ranges_and_buckets_are_bounded(spark, tables, journal):
    day = ("1970-01-01", "1970-01-01")
    got = Q.heart_rate(tables, journal, *day)
    assert got.count() == 50 and got.agg(F.min("ts")).first()[0] == 100
    assert {r["bucketTs"] for r in Q.heart_rate(tables, journal, *day, bucket=1).collect()} == {60 * k for k in range(1, 10)}
    assert Q.heart_rate(tables, journal, *day, bucket=99_999).count() == 1
    with pytest.raises(ValueError, match="span_too_wide"):
        Q.heart_rate(tables, journal, "1970-01-01", "1970-01-08")
    assert [(r["startTs"], r["endTs"]) for r in Q.sleep_states(tables, *day).orderBy("startTs").collect()] == [(0, 100), (300, 300)]
    assert Q.sleep_states(tables, *day, gap=99_999).count() == 1
    assert Q.imu_coverage(tables).count() == 2 and Q.imu_coverage(tables, 90).count() == 1
    assert [tuple(r)[:6] for r in Q.device_events(tables, *day, kinds=["BOOT"]).collect()] == [("d", 2, "BOOT(1)", "BOOT", 1, '{"a":1}')]
    assert Q.motion(tables, *day).where("deviceId = 'apple-health'").count() == 0
    assert Q.motion(tables, *day, bucket=3600).agg(F.sum("steps")).first()[0] == 11
    with pytest.raises(ValueError, match="apple_hourly_min_bucket"):
        Q.motion(tables, *day, device="apple-health")
    assert Q.battery(tables, *day).first()["over"] is False and Q.skin_temperature(tables, *day).first()["tempC"] == 32.0
    assert Q.skin_temperature(tables, *day, bucket=60).count() == Q.variability(tables, *day).count() == Q.imu(tables, *day).where("bucketTs = 0").count() == 1
