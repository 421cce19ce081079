"""Continuous forms: journal feed, chunk intake, deltas onto a snapshot, buckets, sessions and counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ..functions.exprs import U16
from ..operators.series import MOST_STEP, hr_cell, imu_cell, temp_cell, temp_samples
from ..operators.sessions import coverage_of
from ..schemas import ALL, key_of
from ..sources import versions
from ..sources.catalog import read_manifest, write_chunk_manifest
from ..sources.deepbuf import inflate_chunks, manifest_rows, read_chunk_files

#: Fixed value: rows more than this many seconds after now are refused.
FUTURE = DAY = 86_400
#: Shards of devices whose state is kept together.
SHARDS = 4096


def tail_journal(spark: SparkSession, root: str) -> DataFrame:
    """ST-1: journal rows as they are appended; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(ALL["editJournal"]).parquet(f"{root}/editJournal")


def store_chunks(batch: DataFrame, root: str, now: int) -> tuple[int, int]:
    """ST-2: chunk files (path, content) into the payload table, and then into the manifest; returns how many were new and how many not.

    The manifest is the log of what is stored. Only chunks that it lacks are written, each into the folder of its own
    (generation, byteStart), which is replaced as a whole: a batch that comes again after a crash between both steps writes
    the same folders again, and one that comes after the second step writes nothing. Two of one chunk in a batch are one.
    """
    spark = batch.sparkSession
    key = ["generation", "byteStart"]
    many = batch.count()
    batch = batch.dropDuplicates(["path"]).persist()
    inflated = inflate_chunks(batch).persist()
    rows = manifest_rows(batch, inflated, now).persist()
    order = F.row_number().over(Window.partitionBy(*key).orderBy("byteEnd", "path"))
    fine = rows.where("reject_reason is null").withColumn("n", order).where("n = 1").drop("n")
    fresh = fine.join(read_manifest(spark, root).select(*key), key, "left_anti").persist()
    dynamic = lambda df, by, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/{name}")
    try:
        refused = rows.where("reject_reason is not null").select("path", "reject_reason", F.xxhash64("path").alias("id"))
        dynamic(refused, ["id"], "rejected")
        dynamic(inflated.where("lineNo >= 0").join(fresh.select("path", *key), "path").select("lineNo", "line", *key), key, "deepLines")
        stored, _ = write_chunk_manifest(spark, root, fresh)
        return stored, many - stored - refused.count()
    finally:
        for df in (fresh, rows, inflated, batch):
            df.unpersist()


def ingest_chunks_stream(spark: SparkSession, source: str, root: str, checkpoint: str, now: int) -> DataStreamWriter:
    """ST-2: chunk files as they arrive, each stored once, however often and in whatever batches it comes."""
    files = read_chunk_files(spark, source, stream=True)

    def store(batch: DataFrame, _: int) -> None:
        store_chunks(batch, root, now)

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def merge_delta(base: DataFrame, delta: DataFrame, keys: list[str], now: int) -> DataFrame:
    """ST-3: the rows of touched partitions after a delta, with version and since.

    delta has the columns of the table, op and version. ``append`` brings rows of which the newest version of a key wins;
    ``replace`` brings the whole content of its partition, by device and UTC day, as of its version, so that older rows
    of that partition go. since keeps the last replacement of a row's partition: batches may come in any order and more
    than once. Rows later than a day after ``now`` are refused.
    """
    long = lambda c: c.cast("long")
    names = [c for c in delta.columns if c not in ("op", "version")]
    old = base.select(*names, *[long(F.col(c) if c in base.columns else F.lit(d)).alias(c) for c, d in (("version", -1), ("since", None))])
    fine = delta.where(F.col("ts") <= now + FUTURE)
    new = fine.select(*names, long(F.col("version")).alias("version"), long(F.when(F.col("op") == "replace", F.col("version"))).alias("since"))
    part = Window.partitionBy("deviceId", F.floor(F.col("ts") / 86_400))
    rows = old.unionByName(new).withColumn("since", F.max("since").over(part)).where("since is null or version >= since")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("version"), F.xxhash64(*names)))
    return rows.withColumn("newest", newest).where("newest = 1").select(*names, "version", "since")


def _stored(table: str, also: tuple[str, ...]) -> list[T.StructField]:
    """Fields of a table that deltas are merged into."""
    return [*ALL[table].fields, *[T.StructField(n, T.LongType()) for n in (*also, "version", "since")]]


def apply_delta(spark: SparkSession, root: str, table: str, delta: DataFrame, now: int, also: tuple[str, ...] = ()) -> int:
    """ST-3: merge a batch into a table of ``root``; only the days that it touches are written anew, beside the old ones.

    Readers see the table before the batch or after it. Returns the number of the new version, or that of the last one where
    the batch holds nothing; ``versions.LostRace`` where another writer has changed the table meanwhile. ``also`` names whole
    numbers that are stored with the rows and are a part of their key, where a device has several rows of one second.
    """
    before = versions.entry(spark, root)
    fields = _stored(table, also)
    delta = delta.select(*[f.name for f in ALL[table].fields], *also, "op", "version")
    days = [r[0] for r in delta.where(F.col("ts") <= now + FUTURE).select(F.floor(F.col("ts") / DAY).cast("long")).distinct().collect()]  # days of one batch
    if not days:
        return before["number"]
    wanted = set(days)
    base = versions.read_days(spark, root, table, T.StructType(fields), before, lambda d: d in wanted).drop("utcDay")
    return versions.replace_days(spark, root, table, merge_delta(base, delta, [*key_of(table), *also], now), days, before)


def read_table(spark: SparkSession, root: str, table: str, version: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """A table that deltas are merged into, with utcDay, version and since: as it is now, or as it was at a version."""
    return versions.read_days(spark, root, table, T.StructType(_stored(table, also)), versions.entry(spark, root, version))


def delta_stream(spark: SparkSession, source: DataFrame, root: str, table: str, checkpoint: str, now: int, also: tuple[str, ...] = ()) -> DataStreamWriter:
    """ST-3: a stream of deltas, batch by batch; a batch that is replayed changes nothing."""
    return source.writeStream.foreachBatch(lambda batch, _: apply_delta(batch.sparkSession, root, table, batch, now, also)).option("checkpointLocation", checkpoint)


def _buckets(rows: DataFrame, seconds: int, late: str, cells: list[Column]) -> DataFrame:
    timed = rows.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    out = timed.groupBy("deviceId", F.window("at", f"{seconds} seconds")).agg(*cells)
    start = F.unix_timestamp(F.col("window.start").cast("timestamp")).alias("bucketTs")
    return out.select("deviceId", start, *[c for c in out.columns if c not in ("deviceId", "window")])


def bucket_stream(rows: DataFrame, seconds: int, late: str, value: str = "bpm") -> DataFrame:
    """ST-4: A-1 as a stream: each bucket is emitted once, when it is older than ``late`` (ST-7: later rows are dropped)."""
    return _buckets(rows, seconds, late, hr_cell(value))


def imu_bucket_stream(rows: DataFrame, seconds: int, late: str) -> DataFrame:
    """ST-4: A-5 as a stream."""
    return _buckets(rows, seconds, late, imu_cell())


def temp_bucket_stream(rows: DataFrame, devices: DataFrame, seconds: int, late: str) -> DataFrame:
    """ST-4: A-6 as a stream, against the registry of devices as it stands."""
    return _buckets(temp_samples(rows, devices), seconds, late, temp_cell())


class InOrder(StatefulProcessor):
    """Holds the rows of devices back until the watermark has passed them, and hands them on by device, in order of time.

    What is held is what came within the lateness that the watermark allows. A timer fires when the watermark passes the
    first row that is held. The state of many devices, of one shard, is kept together: each call to the state store takes
    as long for one device as for hundreds.
    """

    #: Columns of rows and of what is carried from row to row, after the device.
    ROWS, CARRIED = "ts long, counter int", "ts long, counter int"

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"deviceId string, {self.ROWS}")
        self.carried = handle.getListState("carried", f"deviceId string, {self.CARRIED}")
        self.names = ["deviceId", *[c.split()[0] for c in self.ROWS.split(", ")]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            held = list(zip(*[pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in self.names]))
            if held:
                self.rows.appendList(held)
                low = min(r[1] for r in held)
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first * 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        due, rest = [r for r in held if r[1] * 1000 < mark], [r for r in held if r[1] * 1000 >= mark]
        if due:
            if rest:
                self.rows.put(rest)
                self.handle.registerTimer(min(r[1] for r in rest) * 1000 + 1)
            else:
                self.rows.clear()
        carried = {r[0]: tuple(r)[1:] for r in self.carried.get()} if self.carried.exists() else {}
        of: dict[str, list[tuple]] = {}
        for r in due:
            of.setdefault(r[0], []).append(r[1:])
        new, out = dict(carried), []
        for device in {**carried, **of}:
            last, found = self.released(carried.get(device), sorted(of.get(device, ()), key=self.order), mark)
            out += [(device, *r) for r in found]
            if last is None:
                new.pop(device, None)
            else:
                new[device] = last
        if new != carried:
            self.carried.put([(d, *r) for d, r in new.items()]) if new else self.carried.clear()
        wake = self.wake(new)
        if wake is not None and wake > mark:
            self.handle.registerTimer(wake)
        if out:
            yield pd.DataFrame(out, columns=["deviceId", *self.names_out()])

    @staticmethod
    def order(row: tuple) -> tuple:
        return tuple((v is not None, v) for v in row)

    def released(self, last: tuple | None, rows: list[tuple], mark: int) -> tuple[tuple | None, list[tuple]]:
        """What a device carries on after ``rows``, and what it emits."""
        raise NotImplementedError

    def wake(self, carried: dict[str, tuple]) -> int | None:
        """When to look again if no row comes."""
        return None

    def names_out(self) -> list[str]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class CounterProcessor(InOrder):
    """W-1 over rows in order: the last counter is carried."""

    def released(self, last: tuple | None, rows: list[tuple], mark: int) -> tuple[tuple | None, list[tuple]]:
        out = []
        for ts, counter in rows:
            if last is not None and 1 <= (counter - last[1]) % U16 <= MOST_STEP:
                out.append((ts, (counter - last[1]) % U16))
            last = (ts, counter)
        return last, out

    def names_out(self) -> list[str]:
        return ["ts", "delta"]


class SessionProcessor(InOrder):
    """W-6 and A-23 over rows in order: the session that is open is carried, with its holes, and is emitted once it is over."""

    ROWS = "ts long, cadenceHz double, accelEnergyG double"
    CARRIED = "startTs long, endTs long, seconds long, gaps long, largestGapSeconds long, rhythmicSeconds long, peak double"

    def __init__(self, gap: int):
        self.gap = gap

    def released(self, last: tuple | None, rows: list[tuple], mark: int) -> tuple[tuple | None, list[tuple]]:
        own, over = last, []
        for ts, cadence, energy in rows:
            if own is not None and ts - own[1] > self.gap:
                over.append(own)
                own = None
            hole = 0 if own is None else max(0, ts - own[1] - 1)
            start, _, seconds, gaps, largest, rhythmic, peak = own or (ts, ts, 0, 0, 0, 0, None)
            peak = energy if peak is None else peak if energy is None else max(peak, energy)
            own = (start, ts, seconds + 1, gaps + (hole > 0), max(largest, hole), rhythmic + (cadence is not None), peak)
        if own is not None and (own[1] + self.gap) * 1000 < mark:  # what is still to come is later
            over.append(own)
            own = None
        return own, over

    def wake(self, carried: dict[str, tuple]) -> int | None:
        return min(((own[1] + self.gap) * 1000 + 1 for own in carried.values()), default=None)

    def names_out(self) -> list[str]:
        return [c.split()[0] for c in self.CARRIED.split(", ")]


def _in_order(rows: DataFrame, processor: InOrder, schema: str, late: str, shards: int) -> DataFrame:
    timed = rows.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late).withColumn("shard", F.pmod(F.xxhash64("deviceId"), F.lit(shards)))
    return timed.groupBy("shard").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def session_stream(rows: DataFrame, gap: int, late: str, shards: int = SHARDS) -> DataFrame:
    """ST-5: capture sessions by device with their holes and coverage, as A-23 gives them; neighbours as far apart as ``gap`` still belong together.

    ``rows`` (deviceId, ts, and cadenceHz and accelEnergyG, if there are such) may come in any order within ``late``; needs the
    RocksDB state store. Devices are dealt to ``shards``; a checkpoint belongs to one number of them.
    """
    for name in ("cadenceHz", "accelEnergyG"):
        rows = rows.withColumn(name, (F.col(name) if name in rows.columns else F.lit(None)).cast("double"))
    rows = rows.select("deviceId", F.col("ts").cast("long").alias("ts"), "cadenceHz", "accelEnergyG")
    return coverage_of(_in_order(rows, SessionProcessor(gap), f"deviceId string, {SessionProcessor.CARRIED}", late, shards))


def counter_delta_stream(rows: DataFrame, late: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """ST-6: counter steps by device, in order of time, for rows (deviceId, ts, counter) that come in any order within ``late``; needs the RocksDB state store."""
    rows = rows.select("deviceId", F.col("ts").cast("long").alias("ts"), F.col("counter").cast("int").alias("counter"))
    return _in_order(rows, CounterProcessor(), "deviceId string, ts long, delta int", late, shards)


# late rows


def put_buckets(spark: SparkSession, root: str, table: str, buckets: DataFrame) -> int:
    """ST-7: merge buckets (deviceId, bucketTs, n, ...) into a table stored by day; of two of one key the one of more rows stays.

    Late rows only ever add to a bucket, so a stream and a repair may write the same bucket in any order, and again.
    """
    buckets = buckets.persist()
    try:
        for _ in range(versions.TRIES):
            before = versions.entry(spark, root)
            days = [r[0] for r in buckets.select(versions.day_number(buckets)).distinct().collect()]  # days of one batch
            if not days:
                return before["number"]
            wanted = set(days)
            old = versions.read_days(spark, root, table, buckets.schema, before, lambda d: d in wanted).select(*buckets.columns)
            rows = old.unionByName(buckets)
            most = F.row_number().over(Window.partitionBy("deviceId", "bucketTs").orderBy(F.desc("n"), F.xxhash64(*rows.columns)))
            try:
                return versions.replace_days(spark, root, table, rows.withColumn("best", most).where("best = 1").drop("best"), days, before)
            except versions.LostRace:  # what both merge is the same in either order
                continue
        raise versions.LostRace(f"{versions.TRIES} others were faster")
    finally:
        buckets.unpersist()


def late_rows(batch: DataFrame, limit: int | None, seconds: int = 1) -> DataFrame:
    """Rows of a batch whose bucket a stream has closed: it ends at the watermark ``limit`` or before."""
    closed = F.floor(F.col("ts") / seconds) * seconds + seconds <= (limit if limit is not None else -(2**62))
    return batch.where(closed)


def repairing_stream(spark: SparkSession, source: DataFrame, root: str, table: str, out: str, rebuild: Callable[[DataFrame], DataFrame], seconds: int, late: int, checkpoint: str, now: int) -> DataStreamWriter:
    """ST-7: find rows that come too late for a stream of buckets, and repair the buckets of their device days.

    Each batch is merged into the stream table; rows behind the watermark (the latest second of the batches before, less
    ``late``) go to ``root/late/<table>`` as well, so that one can see which they were, and the device days that they touch are
    built again from the stream table by ``rebuild`` and merged into ``out``. Rows in time are left to ST-4. A batch that is
    replayed after a crash does the same again.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        log = f"{root}/late/log/{table}"
        before = versions.get(spark, f"{log}/{number - 1}.json")["top"] if number and f"{number - 1}.json" in versions.names(spark, log) else None
        top = batch.where(F.col("ts") <= now + FUTURE).agg(F.max("ts")).first()[0]
        versions.put(spark, f"{log}/{number}.json", {"top": max((t for t in (before, top) if t is not None), default=None)})
        apply_delta(spark, root, table, batch.withColumn("op", F.lit("append")).withColumn("version", F.lit(number).cast("long")), now)
        behind = late_rows(batch.where(F.col("ts") <= now + FUTURE), None if before is None else before - late, seconds)
        behind.write.mode("overwrite").parquet(f"{root}/late/{table}/batch={number}")
        day = F.floor(F.col("ts") / DAY).cast("long")
        touched = behind.select("deviceId", day.alias("utcDay")).distinct().persist()
        days = {r[0] for r in touched.select("utcDay").distinct().collect()}  # days of one batch
        if days:
            at = versions.entry(spark, root)
            own = versions.read_days(spark, root, table, ALL[table], at, lambda d: d in days).join(touched, ["deviceId", "utcDay"], "left_semi")
            put_buckets(spark, root, out, rebuild(own.drop("utcDay")))
        touched.unpersist(), batch.unpersist()

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def repair_days(spark: SparkSession, root: str, table: str, corrected: DataFrame, now: int) -> None:
    """ST-7: exact repair of late data: the full rows of touched device days replace what is stored, and batch operators run on them again."""
    rows = corrected.withColumn("op", F.lit("replace")).withColumn("version", F.lit(now).cast("long"))
    apply_delta(spark, root, table, rows, now)
