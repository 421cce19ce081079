"""Runs, gaps and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket, half_up, iso, source_family, stages_of, state_label, utc_day
from .series import STRETCH, classify_ticks, counter_delta, drop_deleted_ranges, posture_changes, with_before

#: Seconds of a block in joins of sessions and samples of one device, and of any device.
DAY, HOUR = 86_400, 3_600
SPAN = ["deviceId", "startTs", "endTs"]
#: Windows of one time, or samples of one hour, that are joined as one, shares of a block that different tasks may take, and tasks for each partition of a shuffle.
ALIKE, SHARES, TASKS = 128, 8, 4


def _runs(df: DataFrame, starts, by: list[str], order: list[str], name: str) -> DataFrame:
    """Number rows by how many runs have started up to them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("starts", starts(w)).withColumn(name, F.sum(F.col("starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def _numbered(rows: DataFrame, starts, order: list[str], name: str, stretch: int) -> DataFrame:
    """Number a device's rows by how many runs have started up to them: within a stretch, and on from the stretches before, of which one row each passes through a window."""
    rows = rows.withColumn("starts", starts.cast("long")).withColumn("stretch", F.floor(F.col("ts") / stretch))
    earlier = F.sum("n").over(Window.partitionBy("deviceId").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    each = rows.groupBy("deviceId", "stretch").agg(F.sum("starts").alias("n")).select("deviceId", "stretch", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    inside = F.sum("starts").over(Window.partitionBy("deviceId", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(each, ["deviceId", "stretch"], "left").withColumn(name, F.col("earlier") + F.col("inside")).drop("earlier", "inside", "stretch")


def rle_segments(samples: DataFrame, gap: int = 120, stretch: int = STRETCH) -> DataFrame:
    """W-5: stretches of one state of a device, broken by other states and by gaps above ``gap`` seconds."""
    rows = with_before(samples, ["deviceId"], ["ts", "state"], ["ts", "state"], stretch)
    same = (F.col("before.state") == F.col("state")) & (F.col("ts") - F.col("before.ts") <= gap)
    runs = _numbered(rows.withColumn("same", F.coalesce(same, F.lit(False))), ~F.col("same"), ["ts", "state"], "run", stretch)
    seg = runs.groupBy("deviceId", "run").agg(F.first("state").alias("state"), F.min("ts").alias("startTs"), F.max("ts").alias("endTs"), F.count("*").alias("samples"))
    out = seg.withColumn("label", state_label(F.col("state"))).withColumn("durationS", F.col("endTs") - F.col("startTs"))
    return out.select("deviceId", source_family(F.col("deviceId")).alias("family"), "state", "label", "startTs", "endTs", iso(F.col("startTs")).alias("startIso"), iso(F.col("endTs")).alias("endIso"), "durationS", "samples")


def sleep_state_totals(segments: DataFrame) -> DataFrame:
    """A-24: seconds by label."""
    return segments.groupBy("label").agg(F.sum("durationS").alias("seconds"))


def gap_sessions_points(rows: DataFrame, gap: int = 60, stretch: int = STRETCH) -> DataFrame:
    """W-6: rows with the number of their device's session, and the hole before them in seconds (0 at a session's start)."""
    columns = rows.columns
    rows = with_before(rows, ["deviceId"], ["ts"], ["ts"], stretch)
    starts = F.coalesce(F.col("ts") - F.col("before.ts") > gap, F.lit(True))
    rows = _numbered(rows, starts, ["ts"], "session", stretch)
    hole = F.when(F.col("starts") == 1, F.lit(0)).otherwise(F.greatest(F.col("ts") - F.col("before.ts") - 1, F.lit(0)))
    return rows.select(*columns, "session", hole.alias("hole"))


def imu_coverage(rows: DataFrame, gap: int = 60) -> DataFrame:
    """A-23: seconds banked against seconds spanned of each capture session; coverage is 1 only without a hole."""
    s = gap_sessions_points(rows, gap).groupBy("deviceId", "session").agg(
        F.min("ts").alias("startTs"),
        F.max("ts").alias("endTs"),
        F.count("*").alias("seconds"),
        F.sum((F.col("hole") > 0).cast("long")).alias("gaps"),
        F.max("hole").alias("largestGapSeconds"),
        F.count("cadenceHz").alias("rhythmicSeconds"),
        F.max("accelEnergyG").alias("peak"),
    )
    return coverage_of(s.drop("session"))


def coverage_of(sessions: DataFrame) -> DataFrame:
    """What A-23 says of sessions (deviceId, startTs, endTs, seconds, gaps, largestGapSeconds, rhythmicSeconds, peak)."""
    s = sessions.withColumn("accelEnergyPeakG", half_up(F.greatest(F.col("peak"), F.lit(0.0)), 3)).drop("peak")
    s = s.withColumn("spanSeconds", F.col("endTs") - F.col("startTs") + 1).withColumn("missingSeconds", F.col("spanSeconds") - F.col("seconds"))
    part = F.least(half_up(F.col("seconds") / F.col("spanSeconds"), 3), F.lit(0.999))
    out = s.withColumn("coverage", F.when(F.col("seconds") == F.col("spanSeconds"), F.lit(1.0)).otherwise(part))
    return out.withColumn("family", source_family(F.col("deviceId"))).withColumn("start", iso(F.col("startTs"))).withColumn("end", iso(F.col("endTs")))


def imu_coverage_totals(rows: DataFrame, gap: int = 60) -> DataFrame:
    """Totals of A-23: sessions, seconds, extent and distinct days."""
    s = gap_sessions_points(rows, gap)
    return s.agg(F.count_distinct("deviceId", "session").alias("sessions"), F.count("*").alias("seconds"), F.min("ts").alias("firstTs"), F.max("ts").alias("lastTs"), F.count_distinct(utc_day(F.col("ts"))).alias("days"))


def gap_sessions_intervals(rows: DataFrame, gap: int = 60, by: list[str] | None = None, first: str = "firstTs", last: str = "lastTs") -> DataFrame:
    """W-7: intervals with the number of their session; a session ends when the next begins more than ``gap`` after all that went before.

    ``by`` parts the ordering (an archive, an owner). Without it all rows are one ordering, which is worked on by stretches
    of time: only one row a stretch, its reach and its number of sessions, passes through a window over all.
    """
    if by:

        def starts(w):
            reach = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
            return F.coalesce(F.col(first) - reach > gap, F.lit(True))

        return _runs(rows, starts, by, [first, last], "session")
    w, over = Window.partitionBy("stretch").orderBy(first, last), Window.partitionBy().orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("stretch", F.floor(F.col(first) / STRETCH))
    reach = rows.groupBy("stretch").agg(F.max(last).alias("reach")).select("stretch", F.max("reach").over(over).alias("before"))
    inside = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", inside).join(reach, "stretch")
    rows = rows.withColumn("starts", F.coalesce(F.col(first) - F.greatest("inside", "before") > gap, F.lit(True)).cast("long"))
    number = rows.groupBy("stretch").agg(F.sum("starts").alias("n")).select("stretch", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("earlier"))
    rows = rows.withColumn("n", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(number, "stretch")
    return rows.withColumn("session", F.col("earlier") + F.col("n")).drop("stretch", "inside", "before", "starts", "n", "earlier")


def deep_buffer_coverage(chunks: DataFrame, gap: int = 60, by: list[str] | None = None) -> DataFrame:
    """A-22: capture sessions of the chunk manifest."""
    by = by or []
    rows = gap_sessions_intervals(chunks.where("firstStrapTs is not null"), gap, by, "firstStrapTs", "lastStrapTs")
    total = lambda c: F.sum(c).alias(c)
    s = rows.groupBy(*by, "session").agg(
        F.min("firstStrapTs").alias("startTs"),
        F.max("lastStrapTs").alias("endTs"),
        F.count("*").alias("chunks"),
        F.sum("lines").alias("buffers"),
        F.sum("n1244").alias("imuBuffers"),
        F.sum("n2140").alias("opticalBuffers"),
        F.sum("nOther").alias("otherBuffers"),
        F.sum("nImu").alias("decodedImuBuffers"),
        total("badLines"),
        total("storedBytes"),
        total("rawBytes"),
        F.sort_array(F.collect_set("generation")).alias("generations"),
    )
    span = F.col("endTs") - F.col("startTs") + 1
    return s.withColumn("spanSeconds", span).withColumn("expectedPerKind", span).withColumn("compressionRatio", half_up(F.try_divide(F.col("rawBytes"), F.col("storedBytes")), 3))


def deep_buffer_totals(coverage: DataFrame) -> DataFrame:
    """Totals of A-22 over its sessions."""
    t = coverage.agg(F.count("*").alias("sessions"), F.sum("chunks").alias("chunks"), F.sum("buffers").alias("buffers"), F.sum("storedBytes").alias("storedBytes"), F.sum("rawBytes").alias("rawBytes"))
    mb = lambda c: half_up(F.col(c) / F.lit(1_048_576), 3)
    return t.withColumn("storedMB", mb("storedBytes")).withColumn("rawMB", mb("rawBytes")).withColumn("compressionRatio", half_up(F.try_divide(F.col("rawBytes"), F.col("storedBytes")), 3))


def interval_overlap(chunks: DataFrame, start: int, end: int, first: str = "firstStrapTs", last: str = "lastStrapTs") -> DataFrame:
    """J-12: intervals that share a second with the window."""
    return chunks.where((F.col(last) >= start) & (F.col(first) <= end))


def interval_overlap_join(chunks: DataFrame, windows: DataFrame, block: int = DAY, first: str = "firstStrapTs", last: str = "lastStrapTs") -> DataFrame:
    """J-12 for many windows (windowId, fromTs, toTs): an equi-join on blocks; each pair once, in the first block they share.

    Windows of one time are joined as one list, ``ALIKE`` of them at most, and unpacked behind the join. A task takes block
    after block, each with a share of its chunks, and list after list, each with chunk after chunk, so that what it hands on
    repeats itself at once and is stored in little space. Tasks are small, so that each has few different values.
    """
    parts = TASKS * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda start, end: F.explode(F.sequence(F.floor(F.col(start) / block), F.floor(F.col(end) / block)))
    rest = [c for c in windows.columns if c not in ("fromTs", "toTs")]
    at = F.floor((F.row_number().over(Window.partitionBy("fromTs", "toTs").orderBy("windowId")) - 1) / ALIKE)
    alike = windows.withColumn("at", at).groupBy("fromTs", "toTs", "at").agg(F.collect_list(F.struct(*rest)).alias("alike")).drop("at")
    alike = alike.withColumn("b", blocks("fromTs", "toTs")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    a = chunks.withColumn("b", blocks(first, last)).withColumn("share", F.pmod(F.xxhash64(*chunks.columns), F.lit(SHARES)).cast("int"))
    pairs = alike.repartition(parts, "b", "share").hint("merge").join(a.repartition(parts, "b", "share"), ["b", "share"])  # the left side leads
    pairs = pairs.where((F.col(last) >= F.col("fromTs")) & (F.col(first) <= F.col("toTs"))).where(F.col("b") == F.floor(F.greatest(first, "fromTs") / block))
    return pairs.select(*chunks.columns, "fromTs", "toTs", F.inline("alike")).select(*chunks.columns, *windows.columns)


def decimate_evenly(rows: DataFrame, cap: int, by: list[str], order: list[str]) -> DataFrame:
    """W-8: every stride-th row of each series of more than ``cap`` rows, with stride and total."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("total", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy(*order)) - 1)
    rows = rows.withColumn("stride", F.when(F.col("total") > cap, F.ceil(F.col("total") / F.lit(cap))).otherwise(F.lit(1)).cast("long"))
    return rows.where(F.pmod("at", "stride") == 0).drop("at")


def latest_reading(rows: DataFrame, by: list[str] | None = None, order: tuple[Column | str, ...] = ("ts",)) -> DataFrame:
    """W-9: the last row in ``order``, whole, over all or of each of ``by``; an order that leaves no ties makes it the same in every run."""
    by = by or []
    fields = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("r")).where("r is not null").select(*by, "r.*")


def first_k_payloads(rows: DataFrame, k: int = 5, by: list[str] | None = None, order: tuple[str, ...] = ("ts",), payload: str = "hex", handle: str = "handle") -> DataFrame:
    """W-10: the payload of the first k rows, a handle on the others."""
    at = F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order))
    rows = rows.withColumn("at", at)
    return rows.withColumn("payload", F.when(F.col("at") <= k, F.col(payload))).withColumn("ref", F.when(F.col("at") > k, F.col(handle))).drop("at")


def session_sample_join(sessions: DataFrame, samples: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """J-8: samples in each session's time: those of its own device, or of any device of its owner where it has none.

    ``owners`` (deviceId, utcDay, owner) tells who wore which device on which day; a session belongs to who wore its device
    on the day it starts, a sample to who wore its device then; of several owners that both have, the pair is made for one. Without ``owners`` there is one owner, and every device is
    theirs. An equi-join on device and day; only sessions that it leaves without a sample are joined to other devices, by
    owner and hour. Columns of samples other than ts keep their names, their device is sampleDevice.
    """
    s = sessions.select(*SPAN).where("startTs <= endTs").distinct()
    x = samples.withColumnRenamed("deviceId", "sampleDevice")
    own = _meet(s, x, x.columns, DAY, [("deviceId", "sampleDevice")])
    rest = s.join(own.select(*SPAN).distinct(), SPAN, "left_anti")
    if owners is None:
        return own.unionByName(_meet(rest, x, x.columns, HOUR, []))
    wearers = owners.groupBy("deviceId", "utcDay").agg(F.array_sort(F.collect_set("owner")).alias("all"))  # of one device and day
    worn = lambda df, device, ts, name: df.withColumn("utcDay", F.floor(F.col(ts) / DAY)).join(
        wearers.select(F.col("deviceId").alias(device), "utcDay", F.col("all").alias(f"{name}s")), [device, "utcDay"]
    ).drop("utcDay").withColumn(name, F.explode(f"{name}s"))
    least = F.array_min(F.array_intersect("wearers", "sampleOwners")) == F.col("wearer")
    return own.unionByName(_meet(worn(rest, "deviceId", "startTs", "wearer"), worn(x, "sampleDevice", "ts", "sampleOwner"), x.columns, HOUR, [("wearer", "sampleOwner")], least))


def _meet(some: DataFrame, of: DataFrame, columns: list[str], block: int, on: list[tuple[str, str]], fits: Column | None = None) -> DataFrame:
    """Sessions and the samples in their time, of which ``columns`` stay, by an equi-join on blocks of time and ``on``."""
    a = some.withColumn("b", F.explode(F.sequence(F.floor(F.col("startTs") / block), F.floor(F.col("endTs") / block))))
    b = of.withColumn("b", F.floor(F.col("ts") / block))
    if not on and fits is None:
        return _meet_all(a, b, columns)
    here = [a[p] == b[q] for p, q in on] + [a["b"] == b["b"]]
    pairs = a.join(b, here).where(F.col("ts").between(F.col("startTs"), F.col("endTs")))
    return (pairs if fits is None else pairs.where(fits)).select(*SPAN, *columns)


def _meet_all(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """``_meet`` of samples of any device: those of a block are joined as lists of ``ALIKE`` at most and unpacked behind the join.

    A task takes block after block, each with a share of its sessions, and list after list, each with session after session,
    so that what it hands on repeats itself at once and is stored in little space. Tasks are small, so that each has few
    different values.
    """
    parts = TASKS * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor((F.row_number().over(Window.partitionBy("b").orderBy("ts")) - 1) / ALIKE)
    lists = b.where("ts is not null").withColumn("at", at).groupBy("b", "at").agg(F.collect_list(F.struct(*columns)).alias("alike")).drop("at")
    lists = lists.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    a = a.withColumn("share", F.pmod(F.xxhash64(*SPAN), F.lit(SHARES)).cast("int"))
    pairs = lists.repartition(parts, "b", "share").hint("merge").join(a.repartition(parts, "b", "share"), ["b", "share"])  # the left side leads
    return pairs.select(*SPAN, F.inline("alike")).where(F.col("ts").between(F.col("startTs"), F.col("endTs")))


def _shared(sessions: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-8 for one owner in two parts: pairs, and the sessions left over, whose samples are all that there are in their time.

    Left over are sessions without a sample of their own that are the only one of their device and start, so that what is
    said of a device and start needs no pairs of theirs.
    """
    s = sessions.select(*SPAN).where("startTs <= endTs").distinct()
    x = samples.withColumnRenamed("deviceId", "sampleDevice")
    own = _meet(s, x, x.columns, DAY, [("deviceId", "sampleDevice")])
    alone = s.groupBy("deviceId", "startTs").agg(F.max("endTs").alias("endTs"), (F.count("*") == 1).alias("alone"))
    rest = s.join(own.select(*SPAN).distinct(), SPAN, "left_anti").join(alone.select("deviceId", "startTs", "alone"), ["deviceId", "startTs"])
    pairs = own.unionByName(_meet(rest.where("not alone").select(*SPAN), x, x.columns, HOUR, []))
    return pairs, rest.where("alone").select(*SPAN)


def _ends(sessions: DataFrame) -> DataFrame:
    """The seconds at which sessions start or end."""
    return sessions.select(F.explode(F.array("startTs", "endTs")).alias("ts")).distinct()


def posture_changes_of_all(sessions: DataFrame, gravity: DataFrame) -> DataFrame:
    """W-4 over the samples of all devices in each session's time (deviceId, startTs, endTs; one of a device and start), without a pair of session and sample.

    Samples are summed up by second first. Five-minute means that lie wholly in a session are those of all sessions, and
    are counted on along the buckets; those at its ends are means over the rest or the beginning of a bucket.
    """
    axes = ("x", "y", "z")
    mean = lambda: F.struct("bucketTs", *[F.try_divide(c, f"n{c}").alias(c) for c in axes])
    moved = lambda a, b: F.coalesce(F.greatest(*[F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in axes]) > 0.5, F.lit(False)).cast("long")
    sums = lambda f: [f(c).alias(c) for c in ("n", *axes, *[f"n{c}" for c in axes])]
    rows = gravity.select("ts", *axes, F.lit(1).alias("n")).unionByName(_ends(sessions).select("ts", *[F.lit(None).cast("double").alias(c) for c in axes], F.lit(0).alias("n")))
    seconds = rows.groupBy("ts").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in axes], *[F.count(c).alias(f"n{c}") for c in axes]).withColumn("bucketTs", bucket(F.col("ts"), 300))

    # buckets, with the ones before and after that have samples, and how many changes there are up to each
    own = F.when(F.col("n") > 0, mean())
    b = seconds.groupBy("bucketTs").agg(*sums(F.sum)).select("bucketTs", own.alias("own")).withColumn("stretch", F.floor(F.col("bucketTs") / STRETCH))
    by, over = Window.partitionBy("stretch"), Window.partitionBy()
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w: F.last(c, ignorenulls=True).over(ahead(w))
    edge = b.groupBy("stretch").agg(F.min("own").alias("first"), F.max("own").alias("last"))  # one row a stretch
    edge = edge.select("stretch", last("last", over.orderBy("stretch")).alias("left"), last("first", over.orderBy(F.desc("stretch"))).alias("right"))
    b = b.withColumn("before", last("own", by.orderBy("bucketTs"))).withColumn("after", last("own", by.orderBy(F.desc("bucketTs")))).join(edge, "stretch")
    b = b.withColumn("before", F.coalesce("before", "left")).withColumn("after", F.coalesce("after", "right")).withColumn("here", F.coalesce("own", "before"))
    b = b.withColumn("change", moved("before", "own")).withColumn("inside", F.sum("change").over(by.orderBy("bucketTs").rowsBetween(Window.unboundedPreceding, 0)))
    each = b.groupBy("stretch").agg(F.sum("change").alias("n")).select("stretch", F.coalesce(F.sum("n").over(ahead(over.orderBy("stretch"))), F.lit(0)).alias("earlier"))
    upto = F.col("earlier") + F.col("inside")
    b = b.join(each, "stretch").select("bucketTs", "before", "after", (upto - F.col("change")).alias("upToBefore"), (upto + moved("here", "after")).alias("upToAfter"))

    # what a bucket has from a second on, and up to it
    def part(w, name: str) -> DataFrame:
        some = seconds.select("ts", "bucketTs", *sums(lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))))
        return some.select("ts", "bucketTs", own.alias(name)).join(b, "bucketTs")

    w = Window.partitionBy("bucketTs")
    heads = part(w.orderBy(F.desc("ts")), "head").select(F.col("ts").alias("startTs"), "head", F.col("bucketTs").alias("firstTs"), F.col("after.bucketTs").alias("nextTs"), (moved("head", "after") - F.col("upToAfter")).alias("opening"))
    tails = part(w.orderBy("ts"), "tail").select(F.col("ts").alias("endTs"), "tail", F.col("bucketTs").alias("lastTs"), (moved("before", "tail") + F.col("upToBefore")).alias("closing"))
    n = F.when(F.col("firstTs") == F.col("lastTs"), F.lit(0)).when(F.col("nextTs") < F.col("lastTs"), F.col("opening") + F.col("closing")).otherwise(moved("head", "tail"))
    return sessions.join(heads, "startTs").join(tails, "endTs").select("deviceId", "startTs", n.alias("postureChanges"))


def decimate_of_all(sessions: DataFrame, samples: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """W-8 over the samples of all devices in each session's time, without a pair that is not kept.

    Samples are numbered once by ts and ``order``; a session's are those between two numbers, of which it takes every
    stride-th.
    """
    rows = samples.select("ts", F.lit(1).alias("n")).unionByName(_ends(sessions).withColumn("n", F.lit(0)))
    seconds = rows.groupBy("ts").agg(F.sum("n").alias("n")).withColumn("day", F.floor(F.col("ts") / DAY))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    days = seconds.groupBy("day").agg(F.sum("n").alias("all")).select("day", F.coalesce(F.sum("all").over(ahead(Window.partitionBy().orderBy("day"))), F.lit(0)).alias("earlier"))  # one row a day
    inside = F.coalesce(F.sum("n").over(ahead(Window.partitionBy("day").orderBy("ts"))), F.lit(0))
    seconds = seconds.withColumn("inside", inside).join(days, "day").select("ts", (F.col("earlier") + F.col("inside")).alias("ahead"), "n")
    at = F.row_number().over(Window.partitionBy("ts").orderBy(*order))
    numbered = samples.withColumn("at", at).join(seconds.select("ts", "ahead"), "ts").withColumn("at", F.col("ahead") + F.col("at") - 1).drop("ahead")
    s = sessions.join(seconds.select(F.col("ts").alias("startTs"), F.col("ahead").alias("low")), "startTs").join(seconds.select(F.col("ts").alias("endTs"), (F.col("ahead") + F.col("n")).alias("high")), "endTs")
    s = s.withColumn("total", F.col("high") - F.col("low")).where("total > 0")
    s = s.withColumn("stride", F.when(F.col("total") > cap, F.ceil(F.col("total") / F.lit(cap))).otherwise(F.lit(1)).cast("long"))
    s = s.select(*SPAN, "total", "stride", F.explode(F.sequence("low", F.col("high") - 1, "stride")).alias("at"))
    return s.join(numbered, "at").select(*SPAN, *samples.columns, "total", "stride")


def sleep_detail(
    sessions: DataFrame, hr: DataFrame, steps: DataFrame, gravity: DataFrame, deleted_hr: DataFrame, bounds: DataFrame, stage_edits: DataFrame, cap: int = 5000, owners: DataFrame | None = None, also: tuple[str, ...] = (),
    store: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """A-25: (sessions with bounds, stages, steps and posture changes; thinned heart rate), for all sessions at once.

    Samples are those of the session's device, or of its owner's (see ``session_sample_join``). ``also`` names columns that
    tell sessions of one device and second apart (see ``overlay``); a column ``seq`` of heart rates orders those of one.
    ``store`` may write the sessions, which are read many times, and return what reads them.
    """
    from .overlay import overlay_sleep, overlay_stages

    key = ["deviceId", "startTs"]
    s = store(overlay_stages(overlay_sleep(sessions, bounds, also).withColumn("originalTs", F.col("originalStartTs")), stage_edits, also))
    window = s.select("deviceId", "startTs", "endTs")
    order = ["sampleDevice", *(["seq"] if "seq" in hr.columns else [])]
    kept = drop_deleted_ranges(hr, deleted_hr)
    if owners is None:  # sessions without samples of their own have all of their time, and need no pairs
        taken, rest = _shared(window, kept)
        thin = decimate_evenly(taken, cap, key, ["ts", *order]).unionByName(decimate_of_all(rest, kept.withColumnRenamed("deviceId", "sampleDevice"), cap, order))
        held, rest = _shared(window, gravity)
        moved = posture_changes(held, tuple(key)).unionByName(posture_changes_of_all(rest, gravity))
    else:
        thin = decimate_evenly(session_sample_join(window, kept, owners), cap, key, ["ts", *order])
        moved = posture_changes(session_sample_join(window, gravity, owners), tuple(key))
    walked = session_sample_join(window, steps, owners)
    deltas = counter_delta(walked, ("deviceId", "startTs", "sampleDevice"), None).groupBy(*key).agg(*classify_ticks())
    out = s.drop("originalTs").join(deltas, key, "left").join(moved, key, "left")
    return out.withColumn("postureChanges", F.coalesce("postureChanges", F.lit(0))).withColumn("family", source_family(F.col("deviceId"))), thin


def stages_from_json(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("stages", stages_of(F.col("stagesJSON")))


def capped(rows: DataFrame, cap: int, order: tuple[str, ...] = ("ts", "deviceId")) -> DataFrame:
    """L-1: the first ``cap`` rows and one more, with ``over`` true on that one: whether rows were left out. For lists only; aggregates never run on it."""
    top = rows.orderBy(*order).limit(cap + 1)
    return top.withColumn("over", F.row_number().over(Window.orderBy(*order)) > cap)
