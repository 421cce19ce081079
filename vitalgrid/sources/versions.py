"""Tables as versions: folders of days that are never changed once written, and a log that says which of them count.

``root/_log/<number>.json`` names, for each table, a file of pointers: which folder holds which UTC day.  A writer puts new
days into a folder of its own, writes a new file of pointers, and takes the next number of the log; only one writer can
take a number, the other one gets ``LostRace``.  A reader opens one number of the log and keeps seeing what that says, as no
folder is overwritten.  Days are stored sorted by (deviceId, ts), each with the number of rows and the extent of each device
beside it, so that a range of seconds becomes a filter on partitions and questions about extents need no scan of a stream.

The folders ``root/<table>/data/v=<id>/utcDay=<day>`` are ordinary Parquet.  Files that a lost race or a lost driver left
behind are named by nothing and go with ``expire``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ALL

#: Seconds of a day, and the day of rows without a time.
DAY, NO_DAY = 86_400, -(2**31)
#: How often a writer tries again where others, who did not touch its table, were faster.
TRIES = 20
#: Statistics of a table: by device and day.
STATS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("deviceId", "timeCol", "firstDay", "lastDay")] + [T.StructField(n, T.LongType()) for n in ("rows", "firstTs", "lastTs", "utcDay")]
)


class LostRace(RuntimeError):
    """Another writer has changed the table since it was read."""


# small files of the driver


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put(spark: SparkSession, path: str, value: Any) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(json.dumps(value).encode())
    out.close()


def get(spark: SparkSession, path: str) -> Any:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def take(spark: SparkSession, folder: str, number: int, entry: Any) -> None:
    """Write entry ``number`` of a log, whole or not at all; ``LostRace`` where it is taken."""
    own, name = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{number:020d}.json"
    put(spark, own, entry)
    once = _link_once if urlparse(folder).scheme in ("", "file") else _rename_once
    try:
        taken = once(spark, own, name)
    finally:
        delete(spark, own)
    if not taken:
        raise LostRace(f"entry {number} of {folder} is taken")


def _link_once(_: SparkSession, own: str, name: str) -> bool:
    """On the driver's own file system a link is made by one only."""
    try:
        os.link(urlparse(own).path, urlparse(name).path)
    except FileExistsError:
        return False
    return True


def _rename_once(spark: SparkSession, own: str, name: str) -> bool:
    """A rename that never goes over another file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    (source, _), (target, _) = _path(spark, own), _path(spark, name)
    try:
        hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


# the log


def numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:20]) for n in names(spark, f"{root}/_log") if n.endswith(".json") and not n.startswith(".")]


def entry(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """An entry of the log, the last by default: its number, the tables with their files of pointers, and the upload that made it."""
    there = numbers(spark, root)
    if number is None:
        number = there[-1] if there else 0
    return {"number": 0, "tables": {}, "upload": None, "uploaded": 0} if not number else get(spark, f"{root}/_log/{number:020d}.json")


def pointers(spark: SparkSession, root: str, table: str, at: dict) -> dict[str, str]:
    """Folder of each day of a table."""
    own = at["tables"].get(table)
    return get(spark, f"{root}/{table}/pointers/{own}.json") if own else {}


def commit(spark: SparkSession, root: str, before: dict, changes: dict[str, dict[str, str]], upload: dict | None = None, alone: bool = False) -> int:
    """Make new pointers of tables count, as read in the entry ``before``; returns the new number.

    Where others were faster, it is tried again on top of them, unless they changed one of the tables, or ``alone``.
    """
    named = {}
    for table, own in changes.items():
        named[table] = uuid.uuid4().hex
        put(spark, f"{root}/{table}/pointers/{named[table]}.json", own)
    last = before
    for _ in range(TRIES):
        number = last["number"] + 1
        try:
            take(spark, f"{root}/_log", number, {"number": number, "tables": last["tables"] | named, "upload": upload, "uploaded": number if upload else last["uploaded"]})
            return number
        except LostRace:
            last = entry(spark, root)
            if alone or any(last["tables"].get(t) != before["tables"].get(t) for t in changes):
                raise
    raise LostRace(f"{TRIES} others were faster")


# days


def time_column(df: DataFrame) -> str | None:
    return next((c for c in ("ts", "startTs", "bucketTs", "day") if c in df.columns), None)


def day_number(df: DataFrame) -> Column:
    """UTC day of a row, counted from 1970, by its ts, startTs, bucketTs or day."""
    name = time_column(df)
    day = F.lit(None).cast("long") if name is None else F.unix_date(F.try_to_date("day")).cast("long") if name == "day" else F.floor(F.col(name) / DAY).cast("long")
    return F.coalesce(day, F.lit(NO_DAY).cast("long"))


def write_days(df: DataFrame, root: str, table: str) -> dict[str, str]:
    """Write all rows into a new folder, by day and sorted by device and time, with their statistics; returns its days and their folder.

    Rows are parted by ranges of (day, device, time), so that a day with many rows is shared by several tasks. Statistics are
    one file a day, put together by as many tasks as there are.
    """
    spark, v = df.sparkSession, uuid.uuid4().hex
    order = ["utcDay", *[c for c in ("deviceId", "ts", "startTs", "bucketTs") if c in df.columns]]
    rows = df.withColumn("utcDay", day_number(df))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("utcDay").parquet(f"{root}/{table}/data/v={v}")
    days = {n.split("=")[1]: v for n in names(spark, f"{root}/{table}/data/v={v}") if n.startswith("utcDay=")}
    if days:
        written = spark.read.schema(rows.schema).parquet(f"{root}/{table}/data/v={v}")
        statistics(written).repartition("utcDay").write.partitionBy("utcDay").parquet(f"{root}/{table}/stats/v={v}")
    return days


def statistics(rows: DataFrame) -> DataFrame:
    """Rows and extent by day and device of rows with utcDay."""
    name = time_column(rows)
    ts = F.col(name) if name not in (None, "day") else F.lit(None).cast("long")
    device = F.col("deviceId") if "deviceId" in rows.columns else F.lit(None).cast("string")
    day = F.col("day") if "day" in rows.columns else F.lit(None).cast("string")
    return rows.groupBy(device.alias("deviceId"), "utcDay").agg(
        F.count("*").alias("rows"), F.min(ts).alias("firstTs"), F.max(ts).alias("lastTs"), F.min(day).alias("firstDay"), F.max(day).alias("lastDay"), F.lit(name).cast("string").alias("timeCol")
    )


def _read(spark: SparkSession, root: str, table: str, part: str, own: dict[str, str], schema: T.StructType) -> DataFrame:
    base = f"{root}/{table}/{part}"
    if not own:
        return spark.createDataFrame([], schema)
    wide = T.StructType([*[f for f in schema.fields if f.name != "utcDay"], T.StructField("v", T.StringType()), T.StructField("utcDay", T.LongType())])
    return spark.read.schema(wide).option("basePath", base).parquet(*[f"{base}/v={v}/utcDay={day}" for day, v in sorted(own.items())]).drop("v")


def read_days(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None, at: dict | None = None, days: Callable[[int], bool] | None = None) -> DataFrame:
    """The rows of a table with utcDay, as the entry ``at`` of the log (the last) says; of some days only, if asked for."""
    at = entry(spark, root) if at is None else at
    own = pointers(spark, root, table, at)
    if days is not None:
        own = {d: v for d, v in own.items() if days(int(d))}
    schema = schema or ALL.get(table)
    if schema is None:
        some = next(iter(own.items()), None)
        if some is None:
            raise ValueError(f"no table {table}")
        schema = spark.read.parquet(f"{root}/{table}/data/v={some[1]}/utcDay={some[0]}").schema
    return _read(spark, root, table, "data", own, T.StructType([*[f for f in schema.fields if f.name != "utcDay"], T.StructField("utcDay", T.LongType())]))


def read_range(spark: SparkSession, root: str, table: str, start: int | None = None, end: int | None = None, device: str | None = None, at: dict | None = None) -> DataFrame:
    """SRC-2 on stored days: rows of a range of seconds, ends included; only the files of its days are opened, and in them only the row groups that can hold the device."""
    from ..operators.series import range_scan

    return range_scan(read_days(spark, root, table, at=at), start, end, device)


def read_statistics(spark: SparkSession, root: str, table: str, at: dict | None = None) -> DataFrame:
    """Statistics of a table by device and utcDay, as kept by its writers."""
    at = entry(spark, root) if at is None else at
    return _read(spark, root, table, "stats", pointers(spark, root, table, at), STATS)


def all_statistics(spark: SparkSession, root: str, tables: list[str] | None = None) -> DataFrame:
    """The statistics of all tables of one entry of the log, with the table's name."""
    at = entry(spark, root)
    names = sorted(at["tables"]) if tables is None else tables
    parts = [read_statistics(spark, root, n, at).withColumn("table", F.lit(n)) for n in names]
    none = spark.createDataFrame([], T.StructType([*STATS.fields, T.StructField("table", T.StringType())]))
    return reduce(DataFrame.unionByName, parts, none)


def replace_days(spark: SparkSession, root: str, table: str, rows: DataFrame, touched: list[int], before: dict) -> int:
    """Put ``rows``, the whole new content of the touched days, in their place."""
    own = {d: v for d, v in pointers(spark, root, table, before).items() if int(d) not in set(touched)}
    return commit(spark, root, before, {table: own | write_days(rows, root, table)})


def expire(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Delete entries of the log before the last ``keep``, and all folders and pointers that no entry left names; returns how many folders went.

    To be run while nobody writes, as folders that are not committed yet are named by nothing.
    """
    there = numbers(spark, root)
    kept = [get(spark, f"{root}/_log/{n:020d}.json") for n in there[-keep:]]
    for n in there[:-keep]:
        delete(spark, f"{root}/_log/{n:020d}.json")
    gone = 0
    for table in {t for e in kept for t in e["tables"]}:
        named = {e["tables"][table] for e in kept if table in e["tables"]}
        live = {v for n in named for v in get(spark, f"{root}/{table}/pointers/{n}.json").values()}
        for n in names(spark, f"{root}/{table}/pointers"):
            if n.removesuffix(".json") not in named:
                delete(spark, f"{root}/{table}/pointers/{n}")
        for part in ("data", "stats"):
            for n in names(spark, f"{root}/{table}/{part}"):
                if n.startswith("v=") and n[2:] not in live:
                    delete(spark, f"{root}/{table}/{part}/{n}")
                    gone += part == "data"
    return gone
