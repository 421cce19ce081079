"""Stateful streams keep the state of many devices together, and give what a batch gives."""

import random

from tests.test_queries import rows
from vitalgrid.operators import sessions as U
from vitalgrid.operators.series import counter_delta
from vitalgrid.plans.stored import ROCKS
from vitalgrid.streaming import streams as T


def through(spark, root, batches, schema, stream):
    """All that a stream emits over files that come one by one, and how many timers a batch has set at most."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    spark.conf.set(name, ROCKS)
    try:
        out = stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
        q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        timers = [op["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for op in p["stateOperators"]]
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{root}/out").where("deviceId <> 'end'"), max(timers)


def parted(data, r, end):
    r.shuffle(data)
    return [data[::2], data[1::2], [("end", 10**6, *end)], [("end", 2 * 10**6, *end)]]


def test_sessions(spark, tmp_path):
    r = random.Random(1)
    schema = "deviceId string, ts long, cadenceHz double, accelEnergyG double"
    some = lambda: r.choice([None, r.randrange(9) / 4])
    data = [(f"d{d}", ts, some(), some()) for d in range(300) for ts in r.sample(range(1, 1000), 12)]
    want = U.imu_coverage(spark.createDataFrame(data, schema), 30)
    got, timers = through(spark, tmp_path, parted(data, r, (None, None)), schema, lambda s: T.session_stream(s, 30, "2000 seconds", 3))
    want = want.select(*got.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.collect())
    assert 0 < timers <= 12  # by shard, not by device


def test_counters(spark, tmp_path):
    r = random.Random(2)
    schema = "deviceId string, ts long, counter int"
    data = [(f"d{d}", ts, r.randrange(65_300, 65_900) % 65_536) for d in range(300) for ts in r.sample(range(1, 1000), 6)]
    want = counter_delta(spark.createDataFrame(data, schema)).where("delta is not null").select("deviceId", "ts", "delta")
    got, timers = through(spark, tmp_path, parted(data, r, (1,)), schema, lambda s: T.counter_delta_stream(s, "2000 seconds", 3))
    assert rows(got.columns, got.collect()) == rows(want.columns, want.collect())
    assert 0 < timers <= 12
