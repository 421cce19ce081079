import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources import deflate, write_chunks
from vitalgrid.operators import series as S
from vitalgrid.operators import sessions as U
from vitalgrid.schemas import SERVER, STREAMS
from vitalgrid.sources import catalog as C
from vitalgrid.sources import deepbuf as D
from vitalgrid.sources import versions as V
from vitalgrid.streaming import streams as T

HR = STREAMS["hrSample"]
FAR = 10**9


def run(df, spark, tmp_path, name):
    """All rows that the query has emitted so far, over all its runs."""
    out = str(tmp_path / f"out-{name}")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.schema(df.schema).parquet(out)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_buckets_equal_the_batch(spark, tmp_path):
    rows = [("d", t, 60 + t % 7) for t in range(0, 1000, 7)]
    put(spark, rows + [("z", FAR, 1)], HR, tmp_path / "in")  # the last row moves the watermark on
    out = run(T.bucket_stream(spark.readStream.schema(HR).parquet(str(tmp_path / "in")), 300, "1 seconds"), spark, tmp_path, "buckets")
    batch = S.hr_series(spark.createDataFrame(rows, HR), 300).drop("family")
    put(spark, [("z", FAR + 10, 1)], HR, tmp_path / "in")
    out = run(T.bucket_stream(spark.readStream.schema(HR).parquet(str(tmp_path / "in")), 300, "1 seconds"), spark, tmp_path, "buckets")
    assert sorted(map(tuple, out.where("deviceId = 'd'").select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_imu_and_temperature_buckets_equal_the_batch(spark, tmp_path):
    imu = [("d", t, 0.5 + t % 3, 1.0, 2.0, None if t % 2 else 1.5, 1.0 + t % 4, 100) for t in range(0, 700, 9)]
    skin, far = [("d", t, 3000 + t) for t in range(0, 700, 9)], [FAR, FAR + 10]
    devices = spark.createDataFrame([("d", "b", "4.0", "strap")], STREAMS["pairedDevice"])
    cases = {"imuActivity": (imu, [("z", t, *[1.0] * 5, 1) for t in far], lambda r: T.imu_bucket_stream(r, 300, "1 seconds"), lambda r: S.imu_series(r, 300)), "skinTempSample": (skin, [("z", t, 1) for t in far], lambda r: T.temp_bucket_stream(r, devices, 300, "1 seconds"), lambda r: S.temp_series(r, devices, 300))}
    for name, (rows, ends, stream, batch) in cases.items():
        for k in range(2):  # rows far ahead move the watermark on
            put(spark, [*rows, ends[0]] if not k else [ends[1]], STREAMS[name], tmp_path / name)
            out = run(stream(spark.readStream.schema(STREAMS[name]).parquet(str(tmp_path / name))), spark, tmp_path, name)
        want = batch(spark.createDataFrame(rows, STREAMS[name])).drop("family")
        assert sorted(map(tuple, out.where("deviceId = 'd'").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def in_batches(spark, tmp_path, name, rows, schema, stream, late, parts=4, seed=3):
    """The output of a stream over rows that come shuffled, in several batches, and then one far ahead."""
    rnd = random.Random(seed)
    own = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, late * 0.9))  # late, but never too late
    step = -(-len(own) // parts)
    for i in range(parts + 2):
        some = own[i * step : (i + 1) * step] if i < parts else [("z", FAR + i * 10**6, *rows[0][2:])]
        rnd.shuffle(some)
        put(spark, some, schema, tmp_path / name)
        out = run(stream(spark.readStream.schema(schema).parquet(str(tmp_path / name))), spark, tmp_path, name)
    return out.where("deviceId <> 'z'")


def test_sessions_with_holes_equal_the_batch(spark, tmp_path):
    schema = "deviceId string, ts long, cadenceHz double, accelEnergyG double"
    rnd = random.Random(1)
    rows = [(d, t, rnd.choice([None, 1.5]), rnd.choice([None, -1.0, 0.25, 0.5])) for d in "de" for t in sorted(rnd.sample(range(0, 4000), 220))]
    rows += [(d, 9000 + t, None, None) for d in "de" for t in range(5)]
    out = in_batches(spark, tmp_path, "sessions", rows, schema, lambda r: T.session_stream(r, 30, "500 seconds"), 500)
    want = U.imu_coverage(spark.createDataFrame(rows, schema), 30)
    assert sorted(map(tuple, out.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert want.where("gaps > 0").count() > 5 and want.where("coverage = 1").count() > 0


def test_shuffled_counters_equal_the_batch(spark, tmp_path):
    schema = "deviceId string, ts long, counter int"
    rnd = random.Random(2)
    rows = [(d, t, (k * 97 + rnd.randrange(300)) % 65536) for d in "de" for k, t in enumerate(sorted(rnd.sample(range(0, 6000), 300)))]
    out = in_batches(spark, tmp_path, "counters", rows, schema, lambda r: T.counter_delta_stream(r, "900 seconds"), 900)
    want = S.counter_delta(spark.createDataFrame(rows, schema)).where("delta is not null").select("deviceId", "ts", "delta")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 300


def test_late_rows_end_in_the_same_tables_as_a_batch_run(spark, tmp_path):
    root, late, seconds = str(tmp_path / "root"), 600, 300
    rnd = random.Random(4)
    rows = [(d, t, rnd.randrange(50, 90)) for d in "de" for t in sorted(rnd.sample(range(0, 200_000), 400))]
    early, behind = [r for r in rows if r[1] % 11], [r for r in rows if r[1] % 11 == 0]
    batches = [early[::2], early[1::2], behind[::2] + [("d", FAR, 1)], behind[1::2]]
    source = lambda: spark.readStream.schema(HR).parquet(str(tmp_path / "in"))
    for i, some in enumerate([*batches, [("d", FAR + 10**6, 1)]]):
        put(spark, some, HR, tmp_path / "in")
        one = T.bucket_stream(source(), seconds, f"{late} seconds").writeStream.foreachBatch(lambda b, _: T.put_buckets(spark, root, "hrBuckets", b)).option("checkpointLocation", str(tmp_path / "ck1"))
        two = T.repairing_stream(spark, source(), root, "hrSample", "hrBuckets", lambda r: S.hr_series(r, seconds).drop("family"), seconds, late, str(tmp_path / "ck2"), FAR + 10**7)
        for writer in (one, two) if i % 2 else (two, one):
            q = writer.trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    want = S.hr_series(spark.createDataFrame(rows, HR), seconds).drop("family")
    got = V.read_days(spark, root, "hrBuckets").where(f"bucketTs < {FAR - 1000}").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    seen = spark.read.parquet(f"{root}/late/hrSample/batch=2", f"{root}/late/hrSample/batch=3").count()
    assert 0 < seen < len(rows) and T.read_table(spark, root, "hrSample").count() == len(rows) + 2


def test_journal_tail(spark, tmp_path):
    put(spark, [(1, "a", "undo", "{}", None, None, 1, None)], SERVER["editJournal"], tmp_path / "editJournal")
    assert run(T.tail_journal(spark, str(tmp_path)), spark, tmp_path, "tail").count() == 1


def test_chunks_are_stored_once(spark, tmp_path):
    write_chunks(tmp_path)
    for k in range(2):  # a new checkpoint: every file comes again
        q = T.ingest_chunks_stream(spark, f"{tmp_path}/deepbuf/v1/*/*.deflate", str(tmp_path / "root"), str(tmp_path / f"ck{k}"), 5).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert C.read_stream_table(spark, str(tmp_path / "root"), "deepBufferChunk").count() == 1
    assert spark.read.parquet(f"{tmp_path}/root/deepLines").count() == 7
    assert spark.read.parquet(f"{tmp_path}/root/rejected").count() == 1


def chunk(lines, start, folder):
    """A chunk file of some lines; folders may hold a copy of the same chunk."""
    out = folder / "deepbuf" / "v1" / "170-7"
    out.mkdir(parents=True, exist_ok=True)
    (out / f"{start:016}.jsonl.deflate").write_bytes(deflate(lines))


def intake(spark, source, root, checkpoint):
    q = T.ingest_chunks_stream(spark, f"{source}/deepbuf/v1/*/*.deflate", str(root), str(checkpoint), 5).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def stored(spark, root):
    manifest = C.read_manifest(spark, str(root))
    lines = D.stored_lines(spark, str(root), manifest)
    return sorted((r["byteStart"], r["lineNo"], r["line"]) for r in lines.collect()), manifest.count()


def line(i):
    return json.dumps({"ts_ms": i * 1000, "strap_ts": i, "size": 1244})


def test_the_same_chunk_in_a_second_batch_is_stored_once(spark, tmp_path):
    three = [line(i) for i in range(3)]
    chunk(three, 0, tmp_path / "a")
    intake(spark, tmp_path / "a", tmp_path / "root", tmp_path / "ck")
    chunk(three, 0, tmp_path / "b")  # the device sends it again, from elsewhere
    for folder in ("a", "b"):
        intake(spark, tmp_path / folder, tmp_path / "root", tmp_path / f"ck-{folder}")
    rows, chunks = stored(spark, tmp_path / "root")
    assert len(rows) == 3 and chunks == 1


def test_another_chunk_with_a_new_checkpoint_keeps_the_first(spark, tmp_path):
    chunk([line(i) for i in range(3)], 0, tmp_path / "a")
    chunk([line(i) for i in range(10, 14)], 500, tmp_path / "b")
    intake(spark, tmp_path / "a", tmp_path / "root", tmp_path / "ck1")
    intake(spark, tmp_path / "b", tmp_path / "root", tmp_path / "ck2")  # its first batch has the number of the other's
    rows, chunks = stored(spark, tmp_path / "root")
    assert len(rows) == 7 and chunks == 2


def test_intake_after_a_crash_gives_the_same(spark, tmp_path, monkeypatch):
    for i in range(3):
        chunk([line(10 * i + j) for j in range(i + 1)], 100 * i, tmp_path / "a")
    files = D.read_chunk_files(spark, f"{tmp_path}/a/deepbuf/v1/*/*.deflate")
    assert T.store_chunks(files, str(tmp_path / "whole"), 5) == (3, 0)
    want = stored(spark, tmp_path / "whole")

    def fails(*_):
        raise RuntimeError("lost driver")

    monkeypatch.setattr(T, "write_chunk_manifest", fails)  # the payload is there, the manifest is not
    with pytest.raises(RuntimeError):
        T.store_chunks(files, str(tmp_path / "root"), 5)
    assert stored(spark, tmp_path / "root") == ([], 0)
    monkeypatch.undo()
    assert T.store_chunks(files, str(tmp_path / "root"), 6) == (3, 0)
    assert T.store_chunks(files, str(tmp_path / "root"), 7) == (0, 3)
    assert T.store_chunks(files.unionByName(files), str(tmp_path / "root"), 8) == (0, 6)
    assert T.store_chunks(files.unionByName(files), str(tmp_path / "twice"), 8) == (3, 3)
    assert stored(spark, tmp_path / "root") == stored(spark, tmp_path / "twice") == want


def test_a_reader_sees_one_version_and_a_lost_race_raises(spark, tmp_path):
    root, ddl = str(tmp_path), "deviceId string, ts long, bpm int, op string, version long"
    delta = lambda rows: spark.createDataFrame(rows, ddl)
    first = T.apply_delta(spark, root, "hrSample", delta([("d", 10, 1, "append", 0), ("d", 100_000, 2, "append", 0)]), 200_000)
    held = T.read_table(spark, root, "hrSample")
    T.apply_delta(spark, root, "hrSample", delta([("d", 10, 5, "append", 1), ("e", 11, 6, "append", 1)]), 200_000)
    assert sorted((r["ts"], r["bpm"]) for r in held.collect()) == [(10, 1), (100_000, 2)]
    assert sorted((r["ts"], r["bpm"]) for r in T.read_table(spark, root, "hrSample").collect()) == [(10, 5), (11, 6), (100_000, 2)]
    assert T.read_table(spark, root, "hrSample", first).count() == 2

    before = V.entry(spark, root)
    T.apply_delta(spark, root, "hrSample", delta([("d", 12, 7, "append", 2)]), 200_000)
    with pytest.raises(V.LostRace):  # a writer that has read the version before
        V.replace_days(spark, root, "hrSample", spark.createDataFrame([("d", 12, 9)], HR), [0], before)
    other = V.replace_days(spark, root, "battery", spark.createDataFrame([("d", 5, 1.0, 1, 1, True)], STREAMS["battery"]), [0], before)
    assert V.entry(spark, root)["number"] == other  # another table: tried again on top
    with pytest.raises(V.LostRace):
        V.take(spark, f"{root}/_log", other, {})
    assert T.read_table(spark, root, "hrSample").count() == 4
    assert V.expire(spark, root, keep=1) > 0
    assert T.read_table(spark, root, "hrSample").count() == 4 and V.read_days(spark, root, "battery").count() == 1


def test_statistics_follow_every_version(spark, tmp_path):
    root, ddl = str(tmp_path), "deviceId string, ts long, bpm int, op string, version long"
    T.apply_delta(spark, root, "hrSample", spark.createDataFrame([("d", t, 1, "append", 0) for t in range(0, 300_000, 1000)], ddl), 400_000)
    T.apply_delta(spark, root, "hrSample", spark.createDataFrame([("d", 86_400, 1, "replace", 1), ("e", 5, 1, "append", 1)], ddl), 400_000)
    got = sorted(map(tuple, V.read_statistics(spark, root, "hrSample").select("deviceId", "utcDay", "rows", "firstTs", "lastTs").collect()))
    want = V.statistics(T.read_table(spark, root, "hrSample")).select("deviceId", "utcDay", "rows", "firstTs", "lastTs")
    assert got == sorted(map(tuple, want.collect())) and ("d", 1, 1, 86_400, 86_400) in got


def test_deltas_in_any_order_and_twice(spark, tmp_path):
    base = spark.createDataFrame([("d", 10, 1), ("d", 20, 2), ("d", 100_000, 3)], HR)
    ddl = "deviceId string, ts long, bpm int, op string, version long"
    a = spark.createDataFrame([("d", 20, 5, "append", 1), ("d", 30, 6, "append", 1)], ddl)
    b = spark.createDataFrame([("d", 20, 7, "append", 2), ("d", 10**12, 9, "append", 2)], ddl)
    c = spark.createDataFrame([("d", 100_001, 8, "replace", 3)], ddl)
    for k, order in enumerate(itertools.permutations([a, b, c])):
        root = str(tmp_path / str(k))
        start = base.withColumn("op", F.lit("append")).withColumn("version", F.lit(0).cast("long"))
        for delta in (start, *order, order[0]):
            T.apply_delta(spark, root, "hrSample", delta, 200_000)
        got = sorted((r["ts"], r["bpm"]) for r in T.read_table(spark, root, "hrSample").collect())
        assert got == [(10, 1), (20, 7), (30, 6), (100_001, 8)]
        if k == 2:
            break
    T.repair_days(spark, root, "hrSample", spark.createDataFrame([("d", 11, 4)], HR), 300_000)
    assert sorted(r["ts"] for r in T.read_table(spark, root, "hrSample").collect()) == [11, 100_001]
