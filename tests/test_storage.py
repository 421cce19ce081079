"""Stored streams, pruned reads, statistics, and windows by stretches."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources import deflate, write_chunks
from vitalgrid.operators import annotations as N
from vitalgrid.operators import reconcile as R
from vitalgrid.operators import series as S
from vitalgrid.operators import sessions as U
from vitalgrid.schemas import STREAMS
from vitalgrid.sources import catalog as C
from vitalgrid.sources import deepbuf as D
from vitalgrid.sources import versions as V

DAY = 86_400
MARKER = [("v1",)]


def marker(spark):
    return spark.createDataFrame(MARKER, STREAMS["grdb_migrations"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the scans of a plan have opened, once it has run."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.executedPlan().collectLeaves().apply(0) if leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else leaf
        if leaf.metrics().contains("numFiles"):
            total += leaf.metrics().apply("numFiles").value()
    return total


def week(spark):
    rows = [(d, day * DAY + s, 60 + s % 5) for d in ("a", "b") for day in range(7) for s in range(0, DAY, 9000)]
    return spark.createDataFrame(rows, STREAMS["hrSample"])


def test_a_range_of_seconds_opens_the_files_of_its_days(spark, tmp_path):
    root, hr = str(tmp_path), week(spark)
    C.publish_snapshot({"hrSample": hr, "grdb_migrations": marker(spark)}, root, "s", 1)
    all_files = files_read(V.read_range(spark, root, "hrSample"))
    some = V.read_range(spark, root, "hrSample", 2 * DAY + 100, 3 * DAY + 100, "a")
    assert "PartitionFilters: [isnotnull(utcDay" in plan(some) and "PushedFilters: [IsNotNull(ts)" in plan(some)
    assert files_read(some) <= all_files * 2 // 7 + 1 < all_files
    want = S.range_scan(hr, 2 * DAY + 100, 3 * DAY + 100, "a")
    assert sorted(map(tuple, some.drop("utcDay").collect())) == sorted(map(tuple, want.collect()))
    assert C.read_snapshot_table(spark, root, "hrSample").count() == hr.count()
    assert "utcDay" in C.read_snapshot_table(spark, root, "hrSample", days=True).columns


def test_of_two_publishers_one_loses(spark, tmp_path, monkeypatch):
    root, hr = str(tmp_path), week(spark)
    write, done = V.write_days, []

    def meanwhile(df, where, table):
        if not done:
            done.append(True)
            C.publish_snapshot({"grdb_migrations": marker(spark), "hrSample": hr.limit(3)}, root, "faster", 2)
        return write(df, where, table)

    monkeypatch.setattr(V, "write_days", meanwhile)
    with pytest.raises(V.LostRace):
        C.publish_snapshot({"hrSample": hr, "grdb_migrations": marker(spark)}, root, "slower", 1)
    monkeypatch.undo()
    assert C.read_snapshot_table(spark, root, "hrSample").count() == 3
    assert [r["snapshot"] for r in C.ingest_log(spark, root).collect()] == ["faster"]
    with pytest.raises(ValueError):
        C.read_snapshot_table(spark, root, "hrSample", snapshot="slower")


@pytest.mark.parametrize("once", [V._link_once, V._rename_once])
def test_a_number_is_taken_once(spark, tmp_path, once):
    V.put(spark, f"file://{tmp_path}/log/a", {"n": 1})
    V.put(spark, f"file://{tmp_path}/log/b", {"n": 2})
    assert once(spark, f"file://{tmp_path}/log/a", f"file://{tmp_path}/log/1.json")
    assert not once(spark, f"file://{tmp_path}/log/b", f"file://{tmp_path}/log/1.json")
    assert V.get(spark, f"{tmp_path}/log/1.json") == {"n": 1}


def test_odd_rows_are_stored_and_read(spark, tmp_path):
    rows = [("a", None, 1), (None, 5, 2), ("a", 9 * 10**15, 3), ("a", -1, 4)]
    C.publish_snapshot({"hrSample": spark.createDataFrame(rows, STREAMS["hrSample"]), "grdb_migrations": marker(spark)}, str(tmp_path), "s", 1)
    assert sorted(map(tuple, C.read_snapshot_table(spark, str(tmp_path), "hrSample").collect()), key=repr) == sorted(rows, key=repr)
    assert V.read_range(spark, str(tmp_path), "hrSample", -5, 5).count() == 2


def test_statistics_answer_without_a_scan(spark, tmp_path):
    root, hr = str(tmp_path), week(spark)
    daily = spark.createDataFrame([("a", "1970-01-03", 5), ("oura-api", "1970-01-04", 6)], "deviceId string, day string, steps int")
    tables = {"hrSample": hr, "dailyMetric": daily, "grdb_migrations": marker(spark)}
    C.publish_snapshot(tables, root, "s", 1)
    devices = spark.createDataFrame([("a", "brand", "4.0", "strap")], STREAMS["pairedDevice"])
    stats = V.all_statistics(spark, root)
    own = R.sources_from_statistics(stats, devices)
    assert own.inputFiles() and all("/stats/" in f for f in own.inputFiles())
    same = lambda x, y: sorted(map(str, x.select(*sorted(x.columns)).collect())) == sorted(map(str, y.select(*sorted(x.columns)).collect()))
    assert same(own, R.sources({n: t for n, t in tables.items() if "deviceId" in t.columns}, devices))
    notes = spark.createDataFrame([("dailyMetric", "a note")], "table string, note string")
    assert same(R.inventory_from_statistics(stats, notes), R.stream_inventory({n: t for n, t in tables.items()}, notes))
    assert {(r["deviceId"], r["ageSeconds"]) for r in R.freshness_by_device(stats, 7 * DAY).collect()} == {("a", 5400), ("b", 5400), ("oura-api", None)}


def test_only_overlapping_chunks_are_opened(spark, tmp_path):
    folder = tmp_path / "deepbuf" / "v1" / "170-7"
    folder.mkdir(parents=True)
    line = lambda t: f'{{"ts_ms":{t}000,"strap_ts":{t},"size":1244,"hex":"x{t}"}}'
    for i in range(6):
        (folder / f"{1000 * i:016}.jsonl.deflate").write_bytes(deflate([line(100 * i + j) for j in range(10)]))
    files = D.read_chunk_files(spark, f"{tmp_path}/deepbuf/v1/*/*.deflate")
    C.write_chunk_manifest(spark, str(tmp_path / "root"), D.manifest_rows(files, D.inflate_chunks(files), 5).where("reject_reason is null"))
    manifest = C.read_manifest(spark, str(tmp_path / "root"))
    for i in (0, 4, 5):  # what lies outside the window cannot be read: nothing notices
        (folder / f"{1000 * i:016}.jsonl.deflate").unlink()
    buffers, objects, unreadable = D.read_window(spark, str(tmp_path), manifest, 105, 303, most_buffers=15, raw=2)
    rows = buffers.orderBy("strap_ts").collect()
    assert [r["strap_ts"] for r in rows] == [*range(105, 110), *range(200, 210)] and rows[0]["matched"] == 19
    assert [r["payload"] for r in rows[:3]] == ["x105", "x106", None] and rows[2]["ref"].endswith("#7")
    assert [r["opened"] for r in objects.orderBy("firstStrapTs").collect()] == [True] * 3 and unreadable.count() == 0
    _, objects, _ = D.read_window(spark, str(tmp_path), manifest, 105, 303, most_chunks=2)
    assert sorted(r["opened"] for r in objects.collect()) == [False, True, True]

    (folder / f"{1000:016}.jsonl.deflate").unlink()
    (folder / f"{2000:016}.jsonl.deflate").write_bytes(b"\xff broken")
    buffers, _, unreadable = D.read_window(spark, str(tmp_path), manifest, 105, 303)
    assert sorted((r["objectKey"][-20:], r["error"]) for r in unreadable.collect()) == [("1000.jsonl.deflate"[-20:].rjust(20, "0"), "missing"), ("2000.jsonl.deflate"[-20:].rjust(20, "0"), "unreadable")]
    assert [r["strap_ts"] for r in buffers.orderBy("strap_ts").collect()] == [300, 301, 302, 303]
    buffers, objects, unreadable = D.read_window(spark, str(tmp_path), manifest, 700, 800)
    assert buffers.count() == objects.count() == unreadable.count() == 0


def test_chunk_files_written_by_tasks(spark, tmp_path):
    write_chunks(tmp_path / "want")
    lines = spark.createDataFrame([("170-7", 5, i, f"line {i}") for i in range(2000)], "generation string, byteStart long, lineNo long, line string").repartition(5)
    files = D.pack_chunks(lines)
    for _ in range(2):
        assert D.put_chunk_files(files, str(tmp_path)) == 1
    back = D.inflate_chunks(D.read_chunk_files(spark, f"{tmp_path}/deepbuf/v1/170-7/*")).where("lineNo >= 0").orderBy("lineNo")
    assert [r["line"] for r in back.collect()] == [f"line {i}" for i in range(2000)]


def history(spark, n=900, seed=5):
    rnd = random.Random(seed)
    rows = [(d, t, rnd.randrange(65536), rnd.randrange(3)) for d in ("a", "b") for t in rnd.sample(range(0, 40_000), n // 2)]
    return spark.createDataFrame(rows + [("a", 5, 7, 1), ("a", 5, 9, 1)], "deviceId string, ts long, counter int, state int").repartition(4)


@pytest.mark.parametrize("stretch", [1, 300, 7000])
def test_stretches_change_nothing(spark, stretch):
    rows, whole = history(spark), 10**9
    same = lambda f: sorted(map(str, f(stretch).collect())) == sorted(map(str, f(whole).collect()))
    assert same(lambda s: S.counter_delta(rows, stretch=s))
    assert same(lambda s: U.rle_segments(rows, 120, s))
    assert same(lambda s: U.gap_sessions_points(rows.dropDuplicates(["deviceId", "ts"]), 60, s))


def test_windows_are_parted_by_stretch(spark):
    rows = history(spark)
    for df in (S.counter_delta(rows), U.rle_segments(rows), U.gap_sessions_points(rows)):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [part.split("\n")[0] for part in text.split("Window [")[1:]]
        inside = [w for w in windows if "stretch" in w.split("], [")[1]]
        others = [w for w in windows if w not in inside]  # over one row a stretch
        assert inside and all("last#" in w or "sum(n" in w for w in others)


def test_owners_are_kept_apart(spark):
    daily = spark.createDataFrame([(o, d, "2024-01-01", v) for o, d, v in (("x", "a", 1), ("x", "b", 3), ("y", "c", 10), ("y", "oura-api", 20))], "owner string, deviceId string, day string, steps int")
    series = spark.createDataFrame([], "owner string, deviceId string, day string, key string, value double")
    deleted = spark.createDataFrame([], "deviceId string, day string, key string")
    got = {r["owner"]: (dict(r["families"]), r["spreadPct"], r["perDevice"]) for r in R.compare_sources(daily, series, deleted, ["steps"]).collect()}
    assert got == {"x": ({"whoop": 2.0}, 0.0, {"a": 1.0, "b": 3.0}), "y": ({"whoop": 10.0, "oura": 20.0}, 66.7, None)}
    snap = {(r["owner"], r["family"]): (r["sources"], r["steps"]) for r in R.health_snapshot(daily, series, deleted).collect()}
    assert snap == {("x", "whoop"): (["a", "b"], 1.0), ("y", "whoop"): (["c"], 10.0), ("y", "oura"): (["oura-api"], 20.0)}
    full = daily.select("*", *[F.lit(None).cast("double").alias(n) for n in ("restingHr", "avgHrv", "totalSleepMin", "recovery", "strain")])
    assert {r["owner"]: r["text"].count("\n") for r in R.day_digest(full, deleted).collect()} == {"x": 2, "y": 2}
    assert N.owner_key(daily, deleted) == ()


def test_recent_annotations_in_reading_order(spark):
    rows = [(i, f"2024-01-{d:02}", None, ["t"], "u") for i, d in enumerate((5, 3, 9, 9, 1))]
    df = spark.createDataFrame(rows, "seq long, day string, endDay string, tags array<string>, source string")
    got = N.recent_annotations(df, "2024-01-02", limit=3).collect()
    assert [(r["day"], r["seq"], r["place"], r["matched"], r["total"]) for r in got] == [("2024-01-05", 0, 1, 4, 5), ("2024-01-09", 2, 2, 4, 5), ("2024-01-09", 3, 3, 4, 5)]


def test_statistics_are_put_together_by_several_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('d', id % 50) as deviceId", "id * 1000 as ts", "cast(1 as int) as bpm")
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        days = V.write_days(rows, str(tmp_path), "hrSample")
    finally:
        spark.conf.set(name, before)
    files = sorted(tmp_path.glob("hrSample/stats/v=*/utcDay=*/*.parquet"))
    assert len(files) == len(days) > 4  # one a day
    assert len({f.name.split("-")[1] for f in files}) > 1  # by several tasks
    assert spark.read.parquet(str(tmp_path / "hrSample/stats")).agg({"rows": "sum"}).first()[0] == 4000
