"""Cases computed by hand."""

import json

from pyspark.sql import functions as F

from vitalgrid.functions import exprs as X
from vitalgrid.operators import annotations as N
from vitalgrid.operators import edits as E
from vitalgrid.operators import overlay as O
from vitalgrid.operators import quality as Q
from vitalgrid.operators import reconcile as R
from vitalgrid.operators import series as S
from vitalgrid.operators import sessions as U
from vitalgrid.schemas import SERVER, STREAMS


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def beats(spark, values):
    return frame(spark, [("my-whoop", 1000 + i, v, i) for i, v in enumerate(values)], "deviceId string, ts long, rrMs int, seq int")


def test_hrv_of_alternating_beats(spark):
    row = S.hrv_series(beats(spark, [800, 850] * 20), 3600).first()
    assert (row["n"], row["rmssd"], row["meanHr"]) == (40, 50.0, 72.7)


def test_hrv_drops_an_artifact_but_not_its_bucket(spark):
    values = [800, 850] * 20
    row = S.hrv_series(beats(spark, values[:20] + [40] + values[20:]), 3600).first()
    assert (row["n"], row["rmssd"]) == (40, 50.0)
    row = S.hrv_series(beats(spark, [100] * 5), 3600).first()
    assert (row["n"], row["rmssd"], row["meanHr"]) == (0, None, None)
    row = S.hrv_series(beats(spark, [800, 850, 800, 850, 800]), 3600).first()
    assert (row["n"], row["rmssd"]) == (5, None)


def test_counter_wraps_and_skips_gaps(spark):
    rows = [("d", i, c, k) for i, (c, k) in enumerate([(65530, 1), (10, 1), (20000, 1), (20015, 2)])]
    df = S.counter_delta(frame(spark, rows, "deviceId string, ts long, counter int, activityClass int"))
    assert df.agg(F.sum("delta")).first()[0] == 31
    t = df.agg(*S.classify_ticks()).first()
    assert (t["steps"], t["walkTicks"], t["runTicks"], t["stillTicks"]) == (31, 16, 15, 0)


def test_measured_wins(spark):
    a = frame(spark, [("d", i, 60) for i in range(10)], "deviceId string, ts long, bpm int")
    b = frame(spark, [("d", i, 199.6) for i in range(5, 15)], "deviceId string, ts long, bpm double")
    out = S.measured_wins_union(a, b)
    assert out.count() == 15
    assert {r["bpm"] for r in out.where("ts >= 10").collect()} == {200}


def test_skin_temperature(spark):
    devices = frame(spark, [("a", "x", "5.0", "strap"), ("b", "x", "4.0", "strap")], "id string, brand string, model string, sourceKind string")
    rows = frame(spark, [("a", 0, 3200), ("a", 1, 3260), ("b", 0, 826)], "deviceId string, ts long, raw int")
    got = {r["deviceId"]: (r["avgC"], r["minC"], r["maxC"]) for r in S.temp_series(rows, devices, 300).collect()}
    assert got == {"a": (32.3, 32.0, 32.6), "b": (33.0, 33.0, 33.0)}


def test_imu(spark):
    rows = frame(spark, [("d", i, 0.5, 1.0, 1.0, 1.8, 0.9) for i in range(60)], "deviceId string, ts long, accelEnergyG double, gyroEnergyDps double, jerkRms double, cadenceHz double, cadenceStrength double")
    row = S.imu_series(rows, 300).first()
    assert (row["cadenceStepsPerMin"], row["rhythmicFraction"], row["seconds"]) == (108, 1.0, 60)


def test_imu_coverage_never_rounds_up(spark):
    ddl = "deviceId string, ts long, accelEnergyG double, cadenceHz double"
    holes = {10, 20, 21}
    row = U.imu_coverage(frame(spark, [("d", i, 1.0, None) for i in range(50) if i not in holes], ddl)).first()
    assert (row["coverage"], row["missingSeconds"], row["gaps"], row["largestGapSeconds"]) == (0.94, 3, 2, 2)
    row = U.imu_coverage(frame(spark, [("d", i, 1.0, None) for i in range(5000) if i != 9], ddl)).first()
    assert row["coverage"] == 0.999
    assert U.imu_coverage(frame(spark, [("d", i, 1.0, None) for i in range(9)], ddl)).first()["coverage"] == 1.0


def test_sessions_of_one_ordering_are_worked_on_by_stretches(spark):
    step = U.STRETCH // 7
    spans = [(i * step + (i * 7919) % 1000, i * step + (i * 7919) % 1000 + (5 * step if i % 11 == 0 else step // 2 + i % 3 * step // 4)) for i in range(200)]
    df = frame(spark, [(a, b) for a, b in spans], "firstTs long, lastTs long")
    want, reach, n = {}, None, 0
    for a, b in sorted(spans):
        n += reach is None or a - reach > step // 3
        reach = b if reach is None else max(reach, b)
        want[a, b] = n
    assert {(r["firstTs"], r["lastTs"]): r["session"] for r in U.gap_sessions_intervals(df, step // 3).collect()} == want and 5 < n < 150


def test_samples_of_the_own_device_come_first(spark):
    nights = frame(spark, [("a", 0, 100), ("b", 0, 90_000), ("c", 50, 60)], "deviceId string, startTs long, endTs long")
    samples = frame(spark, [("a", 10, 1), ("x", 20, 2), ("x", 55, 3), ("b", 89_000, 4), ("x", 95, 5)], "deviceId string, ts long, bpm int")
    got = sorted((r["deviceId"], r["sampleDevice"], r["bpm"]) for r in U.session_sample_join(nights, samples).collect())
    assert got == [("a", "a", 1), ("b", "b", 4), ("c", "x", 3)]


def test_zones_and_payloads_by_shape(spark):
    zones = frame(spark, [(z,) for z in ("Europe/Paris", "America/Argentina/Buenos_Aires", "UTC", "CET", " UTC", "UTC\n", "+02:00", "Etc/GMT+2", "")], "z string")
    assert [r[0] for r in zones.select(X.normalize_tz(F.col("z"))).collect()] == ["Europe/Paris", "America/Argentina/Buenos_Aires", "UTC", None, None, None, None, "Etc/GMT+2", None]
    texts = frame(spark, [(t,) for t in (None, "", "{}", "{ }", "  ", "x", "[]", '{"a":1}')], "t string")
    assert [tuple(r[0]) for r in texts.select(X.parse_payload(F.col("t"))).collect()] == [(None, None)] * 4 + [(None, "  "), (None, "x"), ("[]", None), ('{"a":1}', None)]


def test_segments_break_on_gap_and_state(spark):
    rows = [("d", 0, 2), ("d", 60, 2), ("d", 300, 2), ("d", 310, 7)]
    got = sorted((r["startTs"], r["endTs"], r["label"]) for r in U.rle_segments(frame(spark, rows, "deviceId string, ts long, state int"), 120).collect())
    assert got == [(0, 60, "asleep"), (300, 300, "asleep"), (310, 310, "state_7")]


def test_rounding_goes_up_on_ties(spark):
    got = spark.range(1).select(X.half_up(F.lit(-2.5)), X.half_up(F.lit(1.005), 2), X.half_up(F.lit(2.5))).first()
    assert tuple(got) == (-2, 1.0, 3)


def test_kinds_take_the_underscore_as_it_is(spark):
    df = frame(spark, [("BATTERY_LEVEL(3)",), ("BATTERYXLEVEL(3)",), ("A(b)(7)",), ("PLAIN",)], "kind string")
    assert [r[0] for r in df.where(X.kind_matches(F.col("kind"), ["BATTERY_LEVEL"])).collect()] == ["BATTERY_LEVEL(3)"]
    got = [tuple(r[0]) for r in df.select(X.split_kind(F.col("kind"))).collect()]
    assert got == [("BATTERY_LEVEL", 3), ("BATTERYXLEVEL", 3), ("A(b)", 7), ("PLAIN", None)]


def test_corrupt_second(spark):
    df = frame(spark, [("d", 10**15), ("d", 1_700_000_000)], "deviceId string, ts long")
    assert [r[0] for r in df.select(X.safe_day(F.col("ts"))).collect()] == [None, "2023-11-14"]


def test_battery_charging_has_three_states(spark):
    rows = [("a", 0, 50.0, 1, None), ("a", 1, None, None, False), ("b", 0, 1.0, 1, None), ("c", 0, 1.0, None, False), ("c", 1, 2.0, 9, True)]
    got = {r["deviceId"]: r for r in S.battery_series(frame(spark, rows, "deviceId string, ts long, soc double, mv int, charging boolean")).collect()}
    assert [got[k]["charging"] for k in "abc"] == [False, None, True]
    assert (got["a"]["socLast"], got["a"]["mvLast"], got["c"]["socFirst"], got["c"]["mvLast"]) == (50.0, 1, 1.0, 9)


def journal(spark, *edits):
    rows = [(i, f"e{i}", kind, json.dumps(payload), None, None, 100 + i, target) for i, (kind, payload, target) in enumerate(edits, 1)]
    return spark.createDataFrame(rows, SERVER["editJournal"])


def test_overlay_last_field_wins_and_null_is_a_value(spark):
    key = {"deviceId": "d", "startTs": 5, "sport": "run"}
    j = journal(spark, ("fix_workout", key | {"patch": {"energyKcal": 5, "sport": "walk"}}, None), ("fix_workout", key | {"patch": {"energyKcal": None}}, None), ("fix_workout", key | {"patch": {"sport": "row"}}, None), ("undo", {}, 3))
    p = O.workout_patches(O.active_edits(j)).first()
    assert (p["new_sport"]["value"], p["new_energyKcal"]["value"], p["new_endTs"], p["editId"]) == ("walk", None, None, "e2")
    w = spark.createDataFrame([("d", 5, "run", 605, "s", 600.0, 9.0, None), ("d", 9, "run", 60, "s", None, 1.0, None)], STREAMS["workout"])
    a = O.active_edits(j)
    got = O.overlay_workouts(w, O.deleted_workouts(a), O.workout_patches(a), O.added_workouts(a)).orderBy("startTs").collect()
    assert [(r["sport"], r["energyKcal"], r["durationMin"], r["edited"]) for r in got] == [("walk", None, 10, True), ("run", 1.0, None, False)]


def test_edit_validation(spark):
    night = {"deviceId": "d", "startTs": 1}
    stage = lambda a, b, s="deep": {"start": a, "end": b, "stage": s}
    cases = [
        ("edit_sleep_stages", night | {"stages": [stage(0, 10), stage(10, 20)]}, []),
        ("edit_sleep_stages", night | {"stages": [stage(0, 10), stage(11, 20)]}, ["stages_not_contiguous"]),
        ("edit_sleep_stages", night | {"stages": [stage(5, 5, "nap")]}, ["stage_invalid"]),
        ("edit_sleep_stages", night | {"stages": []}, ["stage_count"]),
        ("fix_workout", {"deviceId": "d", "startTs": 1, "sport": "x", "patch": {}}, ["patch_empty"]),
        ("fix_workout", {"deviceId": "d", "startTs": 1, "sport": "x", "patch": {"energyKcal": None}}, []),
        ("adjust_sleep_bounds", night, ["no_bound"]),
        ("delete_metric_point", {"deviceId": "d", "day": "2024-1-1", "key": "k"}, ["day_shape"]),
        ("add_annotation", {"day": "2024-01-01", "tags": ["ok_tag"], "detail": "x", "source": "user_reported"}, []),
        ("add_annotation", {"day": "2024-01-02", "endDay": "2024-01-01", "tags": ["Bad", "Bad"], "detail": "x", "source": "guess"}, ["end_day_before_day", "source_unknown", "tag_shape", "tags_not_unique"]),
        ("set_baseline_note", {"note": "n", "more": 1}, ["unknown_key"]),
        ("delete_hr_range", {"deviceId": "d", "fromTs": 0, "toTs": 30000}, ["range_too_long"]),
        ("nonsense", {}, ["unknown_kind"]),
    ]
    df = spark.createDataFrame([(str(i), k, json.dumps(p)) for i, (k, p, _) in enumerate(cases)], "id string, kind string, payloadJSON string")
    got = {r["id"]: r["violations"] for r in E.validate_edits(df).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [sorted(c[2]) for c in cases]


def test_propose_renders(spark):
    data = {
        "workout": spark.createDataFrame([("d", 0, "run", 600, "strap", 590.0, 9.0, None)], STREAMS["workout"]),
        "sleepSession": spark.createDataFrame([("d", 0, 36000, 0.9, 50.0, 60.0, json.dumps([{"start": 0, "end": 3600, "stage": "light"}, {"start": 3600, "end": 7200, "stage": "light"}]), 0, None)], STREAMS["sleepSession"]),
        "dailyMetric": spark.createDataFrame([("d", "2024-01-01", None, None, 55.0, None, None, None, None, None, None, 100, None)], STREAMS["dailyMetric"]),
        "metricSeries": spark.createDataFrame([("d", "2024-01-01", "vo2", 41.5)], STREAMS["metricSeries"]),
        "hrSample": spark.createDataFrame([("d", 10, 60), ("d", 20, 61)], STREAMS["hrSample"]),
    }
    cases = [
        ("delete_workout", {"deviceId": "d", "startTs": 0, "sport": "run"}, "DELETE workout run @ 1970-01-01 00:00Z (10 min, source strap, d)"),
        ("fix_workout", {"deviceId": "d", "startTs": 0, "sport": "run", "patch": {"sport": "walk", "distanceM": 5}}, 'FIX workout run @ 1970-01-01 00:00Z (d): sport: "run" ⇒ "walk", distanceM: null ⇒ 5'),
        ("add_workout", {"startTs": 0, "endTs": 60, "sport": "row", "energyKcal": 7}, "ADD workout row 1970-01-01 00:00Z → 1970-01-01 00:01Z (source cloud, 7 kcal)"),
        ("adjust_sleep_bounds", {"deviceId": "d", "startTs": 0, "newEndTs": 60}, "ADJUST sleep @ 1970-01-01 00:00Z (d): end 1970-01-01 10:00Z ⇒ 1970-01-01 00:01Z"),
        ("delete_metric_point", {"deviceId": "d", "day": "2024-01-01", "key": "restingHr"}, "DELETE dailyMetric column restingHr=55 on 2024-01-01 (d)"),
        ("delete_metric_point", {"deviceId": "d", "day": "2024-01-01", "key": "vo2"}, "DELETE metricSeries key vo2=41.5 on 2024-01-01 (d)"),
        ("edit_sleep_stages", {"deviceId": "d", "startTs": 0, "stages": [{"start": 0, "end": 60, "stage": "rem"}]}, "RESTAGE sleep @ 1970-01-01 00:00Z (d): light 120m ⇒ rem 1m"),
        ("delete_hr_range", {"deviceId": "d", "fromTs": 0, "toTs": 15}, "DELETE 1 HR samples 1970-01-01 00:00Z → 1970-01-01 00:00Z (d)"),
        ("add_annotation", {"day": "2024-01-01", "tags": ["alcohol"], "detail": "two beers", "source": "user_reported"}, "ANNOTATE 2024-01-01 [alcohol] (user_reported): two beers"),
        ("delete_workout", {"deviceId": "d", "startTs": 1, "sport": "run"}, "target_not_found"),
        ("set_baseline_note", {"note": "new", "deviceId": "d"}, "NOTE [d]: new\n  ⚠ hides the note of d from 1970-01-01: \"old\"\n    A device shows its last note only. What belongs to a day is better added by add_annotation."),
    ]
    batch = spark.createDataFrame([(f"{i:02}", k, json.dumps(p), "r", 0) for i, (k, p, _) in enumerate(cases)], "id string, kind string, payloadJSON string, rationale string, createdAt long")
    got = E.propose(batch, data, journal(spark, ("set_baseline_note", {"note": "old", "deviceId": "d"}, None))).orderBy("id").collect()
    assert [r["error"] or r["diffText"] for r in got] == [c[2] for c in cases]


def test_compensation_states_what_holds(spark):
    night = {"deviceId": "d", "startTs": 100}
    before = json.dumps({"startTs": 100, "endTs": 900, "stagesJSON": json.dumps([{"start": 100, "end": 900, "stage": "wake"}])})
    j = journal(spark, ("adjust_sleep_bounds", night | {"newStartTs": 50}, None), ("adjust_sleep_bounds", night | {"newEndTs": 800}, None), ("edit_sleep_stages", night | {"stages": []}, None), ("undo", {}, 2), ("undo", {}, 3)).withColumn("beforeJSON", F.lit(before))
    got = {r["seq"]: json.loads(r["payloadJSON"]) for r in E.compensate(spark.createDataFrame([(2,), (3,)], "seq long"), j).collect()}
    assert got[2] == night | {"newStartTs": 50, "newEndTs": 900}
    assert got[3]["stages"] == [{"start": 100, "end": 900, "stage": "awake"}]


def test_fallback_day_survives_a_deleted_point(spark):
    daily = spark.createDataFrame([("my-whoop", "2024-01-01", 100)], "deviceId string, day string, steps int")
    series = spark.createDataFrame([("apple-health", "2024-01-02", "steps", 7.0)], "deviceId string, day string, key string, value double")
    gone = spark.createDataFrame([("apple-health", "2024-01-02", "steps")], "deviceId string, day string, key string")
    got = R.compare_sources(daily, series, gone, ["steps"]).orderBy("day").collect()
    assert [(r["day"], r["families"], r["spreadPct"]) for r in got] == [("2024-01-01", {"whoop": 100.0}, 0.0), ("2024-01-02", None, 0.0)]


def test_night_gets_the_evening_before(spark):
    active = O.active_edits(journal(spark, ("add_annotation", {"day": "2024-01-01", "tags": ["alcohol"], "detail": "x", "source": "user_reported"}, None)))
    nights = spark.createDataFrame([("d", 1, "2024-01-01"), ("d", 2, "2024-01-02"), ("d", 3, "2024-01-03")], "deviceId string, startTs long, localDay string")
    got = {r["startTs"]: [a["matchedOn"] for a in r["annotations"] or []] for r in N.annotations_for_night(nights, O.annotations(active)).collect()}
    assert got == {1: ["sameDay"], 2: ["priorEvening"], 3: []}


def test_churn_without_and_with_another_schema(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    row = Q.snapshot_churn(None, new, ["k"]).first()
    assert (row["churnPct"], row["bootstrap"], row["added"]) == (100.0, True, 2)
    row = Q.snapshot_churn(new.withColumn("x", F.lit(1)), new, ["k"]).first()
    assert (row["churnPct"], row["schemaChanged"]) == (100.0, True)


def test_plans_stay_in_the_engine(spark):
    """No Python in the operators, and filters and columns reach the scan."""
    from tests.conftest import DATA
    from vitalgrid.plans.queries import QUERIES

    for name in ("a1_hr_series", "a3_motion_series", "a17_compare_sources", "e4_e5_propose"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    plan = S.range_scan(spark.read.parquet(f"{DATA}/lineitem.parquet").select(F.col("l_orderkey").alias("ts"), F.lit("d").alias("deviceId")), 5, 9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey,5)" in plan and "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_what_is_shown_of_a_night_is_worked_out_by_day(spark):
    notes = frame(spark, [("e1", 1, "2024-01-01", None), ("e2", 2, "2024-01-01", None)], "editId string, seq long, day string, endDay string")
    notes = notes.selectExpr("*", "array('a_tag') as tags", "'user_reported' as source", "'d' as detail", "cast(null as long) as startTs", "cast(null as long) as endTs", "cast(null as string) as tz", "cast(null as map<string, string>) as values")
    nights = frame(spark, [("d", i, f"2024-01-0{1 + i % 3}") for i in range(9)], "deviceId string, startTs long, localDay string")
    df = N.annotations_for_night(nights, notes, shown=F.array_join(F.transform("annotations", lambda a: F.concat(a["matchedOn"], F.lit(":"), a["editId"])), ","))
    assert {r["startTs"] % 3: r["annotations"] for r in df.collect()} == {0: "sameDay:e1,sameDay:e2", 1: "priorEvening:e1,priorEvening:e2", 2: None}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("array_join")  # below the join


def test_samples_of_owners_are_met_once_without_a_shuffle_of_pairs(spark):
    """Two owners share both devices; equal samples are two samples."""
    owners = frame(spark, [(d, 0, o) for d in ("a", "b") for o in (1, 2)] + [("c", 0, 2), ("d", 0, 3)], "deviceId string, utcDay long, owner int")
    sessions = frame(spark, [("a", 100, 200)], "deviceId string, startTs long, endTs long")
    samples = frame(spark, [("b", 150, 60), ("b", 150, 60), ("c", 150, 70), ("d", 150, 80), ("b", 300, 60)], "deviceId string, ts long, bpm int")
    df = U.session_sample_join(sessions, samples, owners)
    assert sorted((r["sampleDevice"], r["ts"], r["bpm"]) for r in df.collect()) == [("b", 150, 60), ("b", 150, 60), ("c", 150, 70)]
