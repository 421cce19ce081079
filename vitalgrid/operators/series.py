"""Bucketed series of all devices at once. Frames in, lazy frames out; ordering is the caller's last step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import U16, bucket, half_up, skin_temp_celsius, source_family

#: Counter steps kept, beats kept in ms, deviation that marks a beat as an artifact, beats that make a value.
MOST_STEP, RR_LOW, RR_HIGH, RR_DEVIATION, RR_BEATS = 511, 250, 3000, 0.20, 20
#: Seconds of a block: the longest range that can be deleted. Seconds of a stretch, within which the rows of a device are ordered.
BLOCK, STRETCH = 21_600, 30 * 86_400


def range_scan(df: DataFrame, start: int | None = None, end: int | None = None, device: str | None = None) -> DataFrame:
    """SRC-2: rows whose ts lies in the range, ends included; of tables stored by utcDay only the days of the range are opened."""
    stored = "utcDay" in df.columns
    if start is not None:
        df = df.where(F.col("ts") >= start).where(F.col("utcDay") >= start // 86_400 if stored else F.lit(True))
    if end is not None:
        df = df.where(F.col("ts") <= end).where(F.col("utcDay") <= end // 86_400 if stored else F.lit(True))
    return df if device is None else df.where(F.col("deviceId") == device)


def measured_wins_union(measured: DataFrame, estimate: DataFrame, on: tuple[str, ...] = ("deviceId", "ts")) -> DataFrame:
    """J-1: measured rows, and estimates where no measured row has the same key."""
    rest = estimate.join(measured.select(*on).distinct(), list(on), "left_anti")
    value = F.col("bpm")
    away = F.when(value < 0, F.ceil(value - 0.5)).otherwise(F.floor(value + 0.5)).cast("int")
    columns = measured.columns
    return measured.select(*columns).unionByName(rest.withColumn("bpm", away).select(*columns))


def drop_deleted_ranges(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """J-2: samples outside all (deviceId, fromTs, toTs) of their device, by an equi-join on device and block."""
    blocks = ranges.select(F.col("deviceId").alias("d"), "fromTs", "toTs", F.explode(F.sequence(F.floor(F.col("fromTs") / BLOCK), F.floor(F.col("toTs") / BLOCK))).alias("b")).where("fromTs <= toTs")
    here = (F.col("deviceId") == F.col("d")) & (F.floor(F.col("ts") / BLOCK) == F.col("b")) & F.col("ts").between(F.col("fromTs"), F.col("toTs"))
    return samples.join(blocks, here, "left_anti")


def hr_series(samples: DataFrame, seconds: int = 300) -> DataFrame:
    """A-1: average (one decimal), least, most and number by device and bucket."""
    grouped = samples.groupBy("deviceId", bucket(F.col("ts"), seconds).alias("bucketTs"))
    return grouped.agg(*hr_cell()).withColumn("family", source_family(F.col("deviceId")))


def clean_rr(beats: DataFrame, seconds: int = 300) -> DataFrame:
    """W-2: beats with bucketTs and kept; rejected beats stay, marked, so that buckets survive."""
    beats = beats.withColumn("bucketTs", bucket(F.col("ts"), seconds))
    beats = beats.withColumn("ranged", F.expr(f"if(rrMs between {RR_LOW} and {RR_HIGH}, rrMs, null)"))
    over = "over (partition by deviceId, bucketTs order by ts, seq)"
    beats = beats.withColumn("before", F.expr(f"lag(ranged) ignore nulls {over}")).withColumn("after", F.expr(f"lead(ranged) ignore nulls {over}"))
    far = lambda other: F.abs(F.col("ranged") - other) / other > RR_DEVIATION
    spike = F.coalesce(far(F.col("before")) & far(F.col("after")), F.lit(False))
    return beats.withColumn("kept", F.col("ranged").isNotNull() & ~spike).drop("ranged", "before", "after")


def hrv_series(beats: DataFrame, seconds: int = 300, least: int = RR_BEATS) -> DataFrame:
    """A-2 and W-3: number of clean beats, RMSSD and mean heart rate by device and bucket; null values below ``least`` beats."""
    beats = clean_rr(beats, seconds).withColumn("good", F.expr("if(kept, rrMs, null)"))
    beats = beats.withColumn("last", F.expr("lag(good) ignore nulls over (partition by deviceId, bucketTs order by ts, seq)"))
    step = F.col("good") - F.col("last")
    cell = beats.groupBy("deviceId", "bucketTs").agg(F.count("good").alias("n"), F.sum((step * step).cast("long")).alias("squares"), F.sum("good").alias("total"))
    enough = F.col("n") >= least
    rmssd = half_up(F.sqrt(F.try_divide(F.col("squares"), F.col("n") - 1)), 1)
    mean = half_up(F.lit(60000.0) / F.try_divide(F.col("total"), F.col("n")), 1)
    return cell.select("deviceId", "bucketTs", source_family(F.col("deviceId")).alias("family"), F.when(enough, rmssd).alias("rmssd"), F.when(enough, mean).alias("meanHr"), "n")


def with_before(rows: DataFrame, by: list[str], order: list[str], fields: list[str], stretch: int | None = STRETCH) -> DataFrame:
    """Rows with ``before``, the fields of the row ahead of each in the order of its ``by``; null for the first.

    Rows are ordered within stretches of time, so that a device's whole history is never one window; the first row of a
    stretch gets the last row of the one before, and only that row of each stretch passes through a window over all.
    """
    item = F.struct(*fields)
    if stretch is None:
        return rows.withColumn("before", F.lag(item).over(Window.partitionBy(*by).orderBy(*order)))
    rows = rows.withColumn("stretch", F.floor(F.col("ts") / stretch))
    last = rows.groupBy(*by, "stretch").agg(F.max_by(item, F.struct(*order)).alias("last"))
    edge = last.select(*by, "stretch", F.lag("last").over(Window.partitionBy(*by).orderBy("stretch")).alias("edge"))
    inside = F.lag(item).over(Window.partitionBy(*by, "stretch").orderBy(*order))
    return rows.withColumn("before", inside).join(edge, [*by, "stretch"], "left").withColumn("before", F.coalesce("before", "edge")).drop("edge", "stretch")


def counter_delta(steps: DataFrame, by: tuple[str, ...] = ("deviceId",), stretch: int | None = STRETCH) -> DataFrame:
    """W-1: steps of a wrapping 16-bit counter between neighbours; null for the first row and where the step is no motion.

    Cut to a range before calling: the first row of a range has no step. Where ``by`` parts rows into short spans, such as
    sessions, they need no stretches.
    """
    columns = steps.columns
    rows = with_before(steps, [*by], ["ts", "counter"], ["counter"], stretch)
    delta = F.pmod(F.col("counter") - F.col("before.counter"), F.lit(U16))
    return rows.select(*columns, F.when(delta.between(1, MOST_STEP), delta).cast("int").alias("delta"))


def _ticks(wanted: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(wanted, F.col("delta"))), F.lit(0)).cast("long").alias(name)


def classify_ticks() -> list[Column]:
    """A-10: sums of steps by the class of the row that ends them; the four add up to all steps."""
    c = F.col("activityClass")
    other = c.isNull() | ~c.isin(0, 1, 2)
    return [_ticks(F.lit(True), "steps"), _ticks(c == 1, "walkTicks"), _ticks(c == 2, "runTicks"), _ticks(c == 0, "stillTicks"), _ticks(other, "unclassifiedTicks")]


def motion_series(steps: DataFrame, gravity: DataFrame, seconds: int = 300) -> DataFrame:
    """A-3: steps by class and posture by device and bucket, from one pass over the union of both streams."""
    none = lambda *names: [F.lit(None).cast("double").alias(n) for n in names]
    a = counter_delta(steps).select("deviceId", "ts", "delta", "activityClass", *none("x", "y", "z"))
    b = gravity.select("deviceId", "ts", F.lit(None).cast("int").alias("delta"), F.lit(None).cast("int").alias("activityClass"), "x", "y", "z")
    spread = sum((F.max(c) - F.min(c) for c in ("y", "z")), F.max("x") - F.min("x"))
    cell = a.unionByName(b).groupBy("deviceId", bucket(F.col("ts"), seconds).alias("bucketTs")).agg(
        *classify_ticks(), *[half_up(F.avg(c), 3).alias(f"posture{c.upper()}") for c in ("x", "y", "z")], half_up(spread / 3, 3).alias("postureVar"), F.count("*").alias("n")
    )
    return cell.withColumn("family", source_family(F.col("deviceId")))


def phone_hourly_steps(hours: DataFrame, seconds: int = 3600) -> DataFrame:
    """A-4: the phone's hourly steps by their own ts, for hour buckets; none for finer ones."""
    if seconds < 3600:
        hours = hours.where(F.lit(False))
    out = hours.groupBy("deviceId", F.col("ts").alias("bucketTs")).agg(F.sum("steps").alias("steps"), F.count("*").alias("n"))
    return out.withColumn("family", source_family(F.col("deviceId")))


def motion_with_phone(steps: DataFrame, gravity: DataFrame, hours: DataFrame, seconds: int = 3600, device: str | None = None) -> DataFrame:
    """A-3 and A-4 together. A filter on the phone needs hour buckets."""
    if device == "apple-health" and seconds < 3600:
        raise ValueError("apple_hourly_min_bucket")
    return motion_series(steps, gravity, seconds).unionByName(phone_hourly_steps(hours, seconds), allowMissingColumns=True)


def imu_series(rows: DataFrame, seconds: int = 300) -> DataFrame:
    """A-5: movement energy, and cadence as a mean weighted by strength over the rows that have one."""
    cell = rows.groupBy("deviceId", bucket(F.col("ts"), seconds).alias("bucketTs")).agg(*imu_cell())
    return cell.withColumn("family", source_family(F.col("deviceId")))


def hr_cell(value: str = "bpm") -> list[Column]:
    """What A-1 says of a bucket."""
    return [half_up(F.avg(value), 1).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n")]


def imu_cell() -> list[Column]:
    """What A-5 says of a bucket."""
    has = F.col("cadenceHz").isNotNull()
    cadence = F.try_divide(F.sum(F.when(has, F.col("cadenceHz") * F.col("cadenceStrength"))), F.sum(F.when(has, F.col("cadenceStrength"))))
    return [
        F.count("*").alias("seconds"),
        half_up(F.avg("accelEnergyG"), 3).alias("accelEnergyG"),
        half_up(F.max("accelEnergyG"), 3).alias("accelEnergyPeakG"),
        half_up(F.avg("gyroEnergyDps"), 3).alias("gyroEnergyDps"),
        half_up(F.avg("jerkRms"), 3).alias("jerkRms"),
        half_up(F.avg(has.cast("double")), 3).alias("rhythmicFraction"),
        half_up(cadence, 3).alias("cadenceHz"),
        half_up(cadence * 60).alias("cadenceStepsPerMin"),
    ]


def temp_cell() -> list[Column]:
    """What A-6 says of a bucket of samples with tempC."""
    two = lambda f, name: half_up(f("tempC"), 2).alias(name)
    return [two(F.avg, "avgC"), two(F.min, "minC"), two(F.max, "maxC"), half_up(F.avg("raw"), 1).alias("avgRaw"), F.count("*").alias("n")]


def join_device_registry(df: DataFrame, devices: DataFrame, on: str = "deviceId") -> DataFrame:
    """J-4: brand and model of the device, null where it is not registered."""
    return df.join(devices.select(F.col("id").alias(on), "brand", "model").dropDuplicates([on]), on, "left")


def temp_samples(rows: DataFrame, devices: DataFrame) -> DataFrame:
    own = join_device_registry(rows, devices)
    return own.withColumn("tempC", skin_temp_celsius(F.col("raw"), F.col("model"))).drop("brand", "model")


def temp_series(rows: DataFrame, devices: DataFrame, seconds: int = 300) -> DataFrame:
    """A-6: skin temperature by device and bucket; degrees have two decimals, the raw average one."""
    cell = temp_samples(rows, devices).groupBy("deviceId", bucket(F.col("ts"), seconds).alias("bucketTs")).agg(*temp_cell())
    return cell.withColumn("family", source_family(F.col("deviceId")))


def battery_series(rows: DataFrame, seconds: int = 300) -> DataFrame:
    """A-7: charge at both ends of a bucket, its range, last voltage, and charging as true, false or unknown.

    Of rows of one second the first counts at both ends: the one of least ``seq``, if rows have that column.
    """
    first = [F.col(c) for c in ("seq",) if c in rows.columns]
    at = lambda f, c: f(F.col(c), F.when(F.col(c).isNotNull(), F.struct("ts", *[s if f is F.min_by else -s for s in first], c)))
    cell = rows.groupBy("deviceId", bucket(F.col("ts"), seconds).alias("bucketTs")).agg(
        at(F.min_by, "soc").alias("socFirst"), at(F.max_by, "soc").alias("socLast"), F.min("soc").alias("socMin"), F.max("soc").alias("socMax"), at(F.max_by, "mv").alias("mvLast"), F.max("charging").alias("charging"), F.count("*").alias("n")
    )
    return cell.withColumn("family", source_family(F.col("deviceId")))


def event_kind_counts(events: DataFrame) -> DataFrame:
    """A-8: number, first and last second of each kind, over all rows."""
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.min("ts").alias("firstTs"), F.max("ts").alias("lastTs"))


def gravity_buckets(gravity: DataFrame, seconds: int = 300, by: tuple[str, ...] = ()) -> DataFrame:
    """A-9: mean posture by bucket, all devices together."""
    return gravity.groupBy(*by, bucket(F.col("ts"), seconds).alias("bucketTs")).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")])


def posture_changes(gravity: DataFrame, by: tuple[str, ...] = ("deviceId",)) -> DataFrame:
    """W-4: neighbouring five-minute means between which an axis moves by more than 0.5, counted by ``by``."""
    w = Window.partitionBy(*by).orderBy("bucketTs")
    moved = F.greatest(*[F.abs(F.col(c) - F.lag(c).over(w)) for c in ("x", "y", "z")]) > 0.5
    marked = gravity_buckets(gravity, 300, by).withColumn("moved", F.coalesce(moved, F.lit(False)))
    return marked.groupBy(*by).agg(F.sum(F.col("moved").cast("long")).alias("postureChanges"))
