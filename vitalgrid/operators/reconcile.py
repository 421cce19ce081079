"""Several sources of one day, brought together; inventories and freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import date_in, half_up, safe_day, safe_ts, shift_day, source_family, utc_day
from .annotations import annotation_summary, annotations_on_day, latest_baseline_notes, owner_key
from .overlay import drop_deleted_points
from .series import join_device_registry

#: Fields of a snapshot, metrics compared by default, and fields of a day's digest with their wording.
SNAPSHOT_FIELDS = ("restingHr", "avgHrv", "totalSleepMin", "efficiency", "recovery", "strain", "steps")
DIGEST = (("restingHr", "resting HR {}"), ("avgHrv", "HRV {}"), ("totalSleepMin", "sleep {} min"), ("recovery", "recovery {}"), ("strain", "strain {}"), ("steps", "steps {}"))
#: Tables without streams, and what reads each stream.
NON_STREAM = ("grdb_migrations", "cursors", "phoneTimezone", "pairedDevice", "device", "dayOwnership", "cloudTombstone")
READERS = {
    "hrSample": "hr_series", "ppgHrSample": "hr_series", "rrInterval": "hrv_series", "skinTempSample": "temp_series", "sleepStateSample": "rle_segments", "gravitySample": "motion_series", "stepSample": "motion_series",
    "appleStepHour": "motion_series", "appleDaily": "health_snapshot", "imuActivity": "imu_series", "battery": "battery_series", "event": "event_kind_counts", "sleepSession": "sleep_detail", "workout": "overlay_workouts",
    "dailyMetric": "health_snapshot", "metricSeries": "metric_series",
}
SOURCE_TABLES = ("hrSample", "rrInterval", "dailyMetric", "metricSeries", "sleepSession", "workout")
TIME_COLUMNS = ("ts", "startTs", "day")


def day_scan(df: DataFrame, start: str | None = None, end: str | None = None, device: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """SRC-3 and SRC-5: rows of a range of days, of a device and of some metric keys, in one pass."""
    if start is not None:
        df = df.where(F.col("day") >= start)
    if end is not None:
        df = df.where(F.col("day") <= end)
    if device is not None:
        df = df.where(F.col("deviceId") == device)
    return df if keys is None else df.where(F.col("key").isin(keys))


def start_scan(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """SRC-4: sessions or workouts that start on the days of a range (UTC)."""
    at = lambda text: F.unix_timestamp(F.lit(text), "yyyy-MM-dd HH:mm:ss")
    if start is not None:
        df = df.where(F.col("startTs") >= at(f"{start} 00:00:00"))
    return df if end is None else df.where(F.col("startTs") <= at(f"{end} 23:59:59"))


def unpivot_daily(daily: DataFrame, metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """P-9: (deviceId, day, metric, value) of the metrics that exist, with the columns ``by``; nulls and unknown metrics give no rows."""
    there = [m for m in metrics if m in daily.columns]
    key = [*by, "deviceId", "day"]
    if not there:
        return daily.select(*key, F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value")).where(F.lit(False))
    return daily.select(*key, *[F.col(m).cast("double").alias(m) for m in there]).unpivot(key, there, "metric", "value").where("value is not null")


def day_universe(daily: DataFrame, series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """J-13: days that either side has a row of, deleted or not."""
    return daily.select(*by, "day").union(series.select(*by, "day")).distinct()


def _points(daily: DataFrame, series: DataFrame, deleted: DataFrame, metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(deviceId, day, metric, value, priority, family): daily values first, series values second, deleted ones gone."""
    a = unpivot_daily(daily, metrics, by).withColumn("priority", F.lit(0))
    b = series.where(F.col("key").isin(metrics)).select(*by, "deviceId", "day", F.col("key").alias("metric"), F.col("value").cast("double").alias("value")).withColumn("priority", F.lit(1))
    return drop_deleted_points(a.unionByName(b), deleted, "metric").withColumn("family", source_family(F.col("deviceId")))


def fallback_fill(points: DataFrame, by: list[str]) -> DataFrame:
    """J-14: of each group of ``by`` only the rows of the best priority that it has a value of."""
    best = F.min("priority").over(Window.partitionBy(*by))
    return points.where("value is not null").withColumn("best", best).where("priority = best").drop("best")


def compare_sources(daily: DataFrame, series: DataFrame, deleted: DataFrame, metrics: list[str], annotations: DataFrame | None = None) -> DataFrame:
    """A-17: by day and metric the mean of each family (map), their spread in per cent, and all devices where a family has several; with the day's annotations, if given.

    Where both sides have an ``owner``, each owner's days are compared on their own, so that a row holds one person's devices.
    """
    by = owner_key(daily, series)
    days = day_universe(daily, series.where(F.col("key").isin(metrics)), by)
    points = fallback_fill(_points(daily, series, deleted, metrics, by), [*by, "day", "metric", "family"])
    fam = points.groupBy(*by, "day", "metric", "family").agg(half_up(F.avg("value"), 1).alias("mean"), F.count("*").alias("devices"), F.collect_list(F.struct("deviceId", "value")).alias("own"))
    cell = fam.groupBy(*by, "day", "metric").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "mean")))).alias("families"),
        F.count("*").alias("n"), F.max("mean").alias("hi"), F.min("mean").alias("lo"), F.sum("mean").alias("total"), F.max("devices").alias("most"), F.flatten(F.collect_list("own")).alias("all"),
    )
    spread = F.when(F.col("n") >= 2, half_up(F.try_divide(F.col("hi") - F.col("lo"), F.col("total") / F.col("n")) * 100, 1)).otherwise(F.lit(0.0))
    per_device = F.when(F.col("most") > 1, F.map_from_entries(F.array_sort("all")))
    cell = cell.select(*by, "day", "metric", "families", spread.alias("spreadPct"), per_device.alias("perDevice"))
    grid = days.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    out = grid.join(cell, [*by, "day", "metric"], "left").withColumn("spreadPct", F.when(F.col("families").isNull(), F.lit(0.0)).otherwise(F.col("spreadPct")))
    return out if annotations is None else annotations_on_day(out, annotations)


def trailing_days(latest: DataFrame, n: int) -> DataFrame:
    """P-13: (fromDay, toDay), the last n days up to the one row of ``latest`` (day)."""
    return latest.select(shift_day(F.col("day"), -(n - 1)).alias("fromDay"), F.col("day").alias("toDay"))


def health_snapshot(daily: DataFrame, series: DataFrame, deleted: DataFrame, days: int | None = 3, annotations: DataFrame | None = None) -> DataFrame:
    """A-16: by day and family the first value of each field in order of devices, daily values before series values, and all devices with a row; with the day's annotations, if given. By owner, where both sides have one."""
    fields, by = list(SNAPSHOT_FIELDS), owner_key(daily, series)
    series = series.where(F.col("key").isin(fields))
    if days is not None:
        window = trailing_days(daily.select(F.max("day").alias("day")), max(1, min(days, 31)))
        keep = lambda df: df.join(F.broadcast(window), F.col("day").between(F.col("fromDay"), F.col("toDay"))).drop("fromDay", "toDay")  # noqa: E731  one row
        daily, series = keep(daily), keep(series)
    first = F.struct("priority", "deviceId")
    cell = [*by, "day", "family"]
    values = _points(daily, series, deleted, fields, by).groupBy(*cell).agg(*[F.min_by(F.when(F.col("metric") == f, F.col("value")), F.when(F.col("metric") == f, first)).alias(f) for f in fields])
    seen = daily.select(*by, "deviceId", "day").union(series.select(*by, "deviceId", "day")).withColumn("family", source_family(F.col("deviceId")))
    seen = seen.groupBy(*cell).agg(F.sort_array(F.collect_set("deviceId")).alias("sources"))
    out = seen.join(values, cell, "left")
    return out if annotations is None else annotations_on_day(out, annotations)


def metric_series(series: DataFrame, deleted: DataFrame, key: str, start: str | None = None, end: str | None = None, device: str | None = None) -> DataFrame:
    """One metric over days, without deleted points."""
    return drop_deleted_points(day_scan(series, start, end, device, [key]), deleted)


def table_extent(df: DataFrame, device: str | None = None) -> DataFrame:
    """A-11: first and last second and number of rows; no row for an empty stream."""
    if device is not None:
        df = df.where(F.col("deviceId") == device)
    return df.agg(F.min("ts").alias("firstTs"), F.max("ts").alias("lastTs"), F.count("*").alias("n")).where("n > 0")


def hr_coverage_days(hr: DataFrame) -> DataFrame:
    """A-12: distinct days with samples of each device."""
    return hr.groupBy("deviceId").agg(F.count_distinct(safe_day(F.col("ts"))).alias("days"))


def sources(tables: dict[str, DataFrame], devices: DataFrame) -> DataFrame:
    """A-13: by device the tables it appears in, its latest day and second, family and brand."""
    parts = []
    for name, df in tables.items():
        if "deviceId" not in df.columns:
            continue
        ts = next((F.col(c) for c in ("ts", "startTs") if c in df.columns), None)
        top = safe_ts(F.max(ts)) if ts is not None else F.lit(None).cast("long")
        day = F.max("day") if "day" in df.columns else F.lit(None).cast("string")
        own = df.groupBy("deviceId").agg(top.alias("latestTs"), day.alias("d"))
        parts.append(own.select("deviceId", F.lit(name).alias("name"), "latestTs", F.coalesce("d", utc_day(F.col("latestTs"))).alias("d")))
    union = reduce(DataFrame.unionByName, parts)
    out = union.groupBy("deviceId").agg(F.sort_array(F.collect_set("name")).alias("tables"), F.max("d").alias("latestDay"), F.max("latestTs").alias("latestTs"))
    return join_device_registry(out.withColumn("family", source_family(F.col("deviceId"))), devices).drop("model")


def metric_key_counts(series: DataFrame, limit: int = 100) -> DataFrame:
    """A-14: the first keys by name with rows by family."""
    keys = series.select("key").distinct().orderBy("key").limit(limit)
    own = series.join(keys, "key", "left_semi").withColumn("family", source_family(F.col("deviceId")))
    return own.groupBy("key").agg(*[F.count(F.when(F.col("family") == f, 1)).alias(f) for f in ("whoop", "oura", "apple")], F.count("*").alias("n"))


def stream_inventory(tables: dict[str, DataFrame], notes: DataFrame | None = None) -> DataFrame:
    """A-15: by table rows, time column, extent, number of devices, reader, note, and whether it is a gap: filled, unread and no bookkeeping.

    ``notes`` (table, note) is what the caller knows of tables. Tables in versions are better asked by ``inventory_from_statistics``.
    """
    parts = []
    for name, df in tables.items():
        time = next((c for c in TIME_COLUMNS if c in df.columns), None)
        show = (lambda x: x.cast("string")) if time == "day" else (lambda x: safe_ts(x).cast("string"))
        first, last = (show(F.min(time)), show(F.max(time))) if time else (F.lit(None).cast("string"),) * 2
        devices = F.count_distinct("deviceId") if "deviceId" in df.columns else F.lit(0).cast("long")
        row = df.agg(F.count("*").alias("rows"), first.alias("first"), last.alias("last"), devices.alias("devices"))
        parts.append(row.select(F.lit(name).alias("table"), "rows", F.lit(time).cast("string").alias("timeCol"), "first", "last", "devices"))
    return _inventory(reduce(DataFrame.unionByName, parts), notes)


def _inventory(rows: DataFrame, notes: DataFrame | None) -> DataFrame:
    reader = F.lit(None).cast("string")
    for name, by in READERS.items():
        reader = F.when(F.col("table") == name, by).otherwise(reader)
    plain = F.col("table").isin(*NON_STREAM) | F.col("table").startswith("_litestream")
    rows = rows.withColumn("readBy", reader).withColumn("gap", (F.col("rows") > 0) & F.col("readBy").isNull() & ~plain)
    none = F.lit(None).cast("string").alias("note")
    return rows.withColumn("note", none) if notes is None else rows.join(notes.select("table", "note"), "table", "left")


# the same questions, asked of the statistics that writers keep (see sources.versions): no stream is scanned


def sources_from_statistics(statistics: DataFrame, devices: DataFrame) -> DataFrame:
    """A-13 from (table, deviceId, lastTs, lastDay, ...)."""
    own = statistics.where("deviceId is not null").groupBy("deviceId", "table").agg(safe_ts(F.max("lastTs")).alias("latestTs"), F.max("lastDay").alias("d"))
    own = own.withColumn("d", F.coalesce("d", utc_day(F.col("latestTs"))))
    out = own.groupBy("deviceId").agg(F.sort_array(F.collect_set("table")).alias("tables"), F.max("d").alias("latestDay"), F.max("latestTs").alias("latestTs"))
    return join_device_registry(out.withColumn("family", source_family(F.col("deviceId"))), devices).drop("model")


def inventory_from_statistics(statistics: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """A-15 from statistics; ``sources_from_statistics`` names the devices."""
    day = F.max("timeCol") == "day"
    show = lambda own, ts: F.when(day, own).otherwise(safe_ts(ts).cast("string"))
    rows = statistics.groupBy("table").agg(
        F.sum("rows").alias("rows"), F.max("timeCol").alias("timeCol"), show(F.min("firstDay"), F.min("firstTs")).alias("first"), show(F.max("lastDay"), F.max("lastTs")).alias("last"), F.count_distinct("deviceId").alias("devices")
    )
    return _inventory(rows, notes)


def freshness_by_device(statistics: DataFrame, now: int) -> DataFrame:
    """A-26 for many owners: by device the newest sample, its age, the newest day and the rows of all tables."""
    own = statistics.where("deviceId is not null").groupBy("deviceId").agg(F.max(safe_ts(F.col("lastTs"))).alias("latestTs"), F.max("lastDay").alias("latestDay"), F.sum("rows").alias("rows"), F.count_distinct("table").alias("tables"))
    age = F.when(F.col("latestTs").isNotNull(), F.greatest(F.lit(now) - F.col("latestTs"), F.lit(0)).cast("long"))
    return own.withColumn("ageSeconds", age).withColumn("family", source_family(F.col("deviceId")))


def freshness_summary(statistics: DataFrame, pending: DataFrame, journal: DataFrame, annotations: DataFrame, ingest_log: DataFrame, now: int) -> DataFrame:
    """A-26 in one row of single values: newest sample and its age, newest data day, devices, waiting edits, last seq, annotations and the last upload.

    What is a list there comes as rows: ``freshness_by_device``, A-13, A-14 and A-18.
    """
    row = statistics.agg(F.max(safe_ts(F.col("lastTs"))).alias("latestTs"), F.max("lastDay").alias("latestDay"), F.count_distinct("deviceId").alias("devices"))
    own = annotations.agg(F.count("*").alias("annotations"), F.min("day").alias("firstAnnotation"), F.max(F.coalesce("endDay", "day")).alias("lastAnnotation"))
    upload = ingest_log.agg(F.max_by(F.struct("receivedAt", "phoneTz"), "id").alias("u")).select(F.col("u.receivedAt").alias("lastIngestAt"), F.col("u.phoneTz").alias("phoneTz"))
    for part in (pending.agg(F.count("*").alias("pendingEdits")), journal.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("journalSeq")), own, upload):
        row = row.crossJoin(F.broadcast(part))  # one row of single values
    return row.withColumn("ageSeconds", F.greatest(F.lit(now) - F.col("latestTs"), F.lit(0)).cast("long"))


def search_days(daily: DataFrame, query: str = "", k: int = 20, window: int = 31) -> DataFrame:
    """L-3: the newest days with data among the last ``window``, or the one that the query names."""
    span = trailing_days(daily.select(F.max("day").alias("day")), window)
    days = daily.select("day").distinct().join(F.broadcast(span), F.col("day").between(F.col("fromDay"), F.col("toDay"))).select("day")  # one row
    wanted = date_in(F.lit(query))
    return days.where(wanted.isNull() | (F.col("day") == wanted)).orderBy(F.desc("day")).limit(k)


def day_digest(daily: DataFrame, deleted: DataFrame) -> DataFrame:
    """A-28: by day, and owner if there is one, a text with a line for each device; a dash for null and deleted values."""
    by = owner_key(daily)
    fields = [name for name, _ in DIGEST]
    gone = deleted.where(F.col("key").isin(fields)).groupBy("deviceId", "day").agg(F.collect_set("key").alias("gone"))
    daily = daily.join(gone, ["deviceId", "day"], "left")
    for name in fields:
        daily = daily.withColumn(name, F.when(~F.coalesce(F.array_contains("gone", name), F.lit(False)), F.col(name)))

    def shown(name: str):
        number = F.col(name).cast("double")
        whole = number == F.floor(number)
        return F.coalesce(F.when(whole, F.floor(number).cast("string")).otherwise(number.cast("string")), F.lit("—"))

    parts = []
    for name, text in DIGEST:
        before, after = text.split("{}")
        parts.append(F.concat(F.lit(before), shown(name), F.lit(after)))
    line = F.concat(source_family(F.col("deviceId")), F.lit(": "), F.concat_ws(", ", *parts))
    lines = daily.groupBy(*by, "day").agg(F.array_sort(F.collect_list(F.struct("deviceId", line.alias("line")))).alias("l"))
    return lines.select(*by, "day", F.concat(F.lit("Biometrics for "), F.col("day"), F.lit("\n"), F.array_join("l.line", "\n")).alias("text"))


def data_freshness(
    tables: dict[str, DataFrame], devices: DataFrame, daily: DataFrame, series: DataFrame, pending: DataFrame, journal: DataFrame, notes: DataFrame, annotations: DataFrame, ingest_log: DataFrame, now: int
) -> DataFrame:
    """A-26 of one owner, in one row: newest sample and its age, newest data day, sources (A-13), daily columns, metric keys (A-14), waiting
    edits, last seq, the notes that hold (A-18), summary of annotations (A-19), last upload, and the phone's zone at it."""
    own = sources(tables, devices)
    listed = own.agg(F.max("latestTs").alias("latestTs"), F.array_sort(F.collect_list(F.struct("deviceId", "family", "latestDay", "tables"))).alias("sources"))
    keys = metric_key_counts(series).agg(F.array_sort(F.collect_list(F.struct("key", "whoop", "oura", "apple", "n"))).alias("metricSeriesKeys"))
    held = latest_baseline_notes(notes).agg(F.array_sort(F.collect_list(F.struct("deviceId", "note", "at", "supersededCount"))).alias("baselineNotes"))
    summary = annotation_summary(annotations).select(F.struct("count", "firstDay", "lastDay", "tags").alias("annotations"))
    upload = ingest_log.agg(F.max_by(F.struct("receivedAt", "phoneTz"), "id").alias("u")).select(F.col("u.receivedAt").alias("lastIngestAt"), F.col("u.phoneTz").alias("phoneTz"))
    parts = [daily.agg(F.max("day").alias("latestDay")), keys, pending.agg(F.count("*").alias("pendingEdits")), journal.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("journalSeq")), held, summary, upload]
    row = listed
    for part in parts:  # frames of one row each
        row = row.crossJoin(F.broadcast(part))
    columns = [c for c in daily.columns if c not in ("deviceId", "day")]
    row = row.withColumn("dailyMetricColumns", F.array(*map(F.lit, columns)).cast("array<string>"))
    return row.withColumn("ageSeconds", F.greatest(F.lit(now) - F.col("latestTs"), F.lit(0)).cast("long"))
