"""A-25 where sessions have no samples of their own: the rows that pairs would give, without the pairs."""

import random

from tests.test_queries import rows
from vitalgrid.operators import sessions as U
from vitalgrid.operators.series import posture_changes

KEY = ["deviceId", "startTs"]


def made_by_joins(df) -> int:
    """The most rows that a join of the executed plan has made."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def frames(spark, seed: int, sessions: int, samples: int, days: int):
    r = random.Random(seed)
    at = lambda: r.randrange(days * 86_400)
    spans = []
    for i in range(sessions):
        start = at()
        spans.append((f"s{i}", start, start + r.choice([-5, 0, 1, 200, 400, 900, 20_000, 40_000])))
        if i % 9 == 0:
            spans.append((f"s{i}", start, start + 10_000))  # another of the same start
    worn = [f"w{i % 7}" for i in range(samples)] + [f"s{i}" for i in range(0, sessions, 10)]
    some = lambda: r.choice([None, *[q / 4 for q in range(-4, 5)]])
    gravity = [(d, at() // 7 * 7, some(), some(), some()) for d in worn]
    hr = [(d, at() // 50 * 50, r.randrange(40, 90), i) for i, d in enumerate(worn)]
    return (
        spark.createDataFrame(spans, "deviceId string, startTs long, endTs long"),
        spark.createDataFrame(gravity, "deviceId string, ts long, x double, y double, z double"),
        spark.createDataFrame(hr, "deviceId string, ts long, bpm int, seq long"),
    )


def detail(spark, s, gravity, hr, cap):
    none = lambda schema: spark.createDataFrame([], schema)
    sleeps = s.selectExpr("deviceId", "startTs", "endTs", "1.0D as efficiency", "'[]' as stagesJSON", "monotonically_increasing_id() as row")
    bounds = none("deviceId string, startTs long, newStartTs long, newEndTs long, editId string, row long")
    staged = none("deviceId string, startTs long, newStages array<struct<start:long,end:long,stage:string>>, stageEditId string, row long")
    steps = none("deviceId string, ts long, counter int, activityClass int")
    return U.sleep_detail(sleeps, hr, steps, gravity, none("deviceId string, fromTs long, toTs long"), bounds, staged, cap, also=("row",))


def test_as_with_pairs(spark):
    for seed, days in ((1, 1), (2, 70)):  # the second over stretches of thirty days, mostly empty
        s, gravity, hr = frames(spark, seed, 60, 400, days)
        out, thin = detail(spark, s, gravity, hr, 20)
        want = posture_changes(U.session_sample_join(s, gravity), tuple(KEY))
        want = s.select(*KEY, "endTs").join(want, KEY, "left").selectExpr(*KEY, "endTs", "coalesce(postureChanges, 0) as n")
        got = out.selectExpr(*KEY, "endTs", "postureChanges as n")
        assert rows(got.columns, got.collect()) == rows(want.columns, want.collect())
        want = U.decimate_evenly(U.session_sample_join(s, hr), 20, KEY, ["ts", "sampleDevice", "seq"]).select(*thin.columns)
        if days == 1:
            assert want.where("stride > 1").count() > 0
        keep = [c for c in thin.columns if c != "endTs"]  # of windows of one start, and samples in both, either may be counted first
        assert rows(keep, thin.select(keep).collect()) == rows(keep, want.select(keep).collect())


def test_joins_make_no_pairs(spark):
    s, gravity, hr = frames(spark, 3, 300, 6000, 1)
    s = s.where("endTs - startTs = 40000 and deviceId not like '%0'").dropDuplicates(KEY)
    hr, gravity = (df.where("deviceId like 'w%'") for df in (hr, gravity))
    pairs = U.session_sample_join(s, gravity).count()
    out, thin = detail(spark, s, gravity, hr, 10)
    for df in (out.select(*KEY, "postureChanges"), thin):
        df.collect()
        assert 0 < made_by_joins(df) <= 6_000 + 12 * s.count() < pairs
