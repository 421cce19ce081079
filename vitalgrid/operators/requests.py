"""Series as interactive callers ask for them: a range of time in text, a device, a bucket or gap within bounds.

Tables are frames by stream name; ``journal`` brings corrections. Each function gives a lazy frame: buckets where a bucket
is asked for (or usual), else samples in order of time, the first MOST and one more that is marked ``over``. The operators
below this layer take ranges and buckets of any size.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp_bucket, clamp_gap, kind_matches, parse_payload, source_family, split_kind
from . import series as S
from . import sessions as U
from .overlay import active_edits, deleted_hr_ranges

#: The longest range in seconds, and the most samples of a list.
LONGEST, MOST = 7 * 86_400, 5_000

Tables = dict[str, DataFrame]


def second_of(text: str, end: bool = False) -> int:
    """A day (its first second, or its last for an ``end``) or an ISO time in epoch seconds; a time without a zone is UTC."""
    day = len(text) == 10
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError("bad_range") from None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return int(at.timestamp() // 1) + (86_399 if day and end else 0)


def _rows(tables: Tables, name: str, start: str, end: str, device: str | None) -> DataFrame:
    a, b = second_of(start), second_of(end, True)
    if b - a > LONGEST:
        raise ValueError("span_too_wide")
    return S.range_scan(tables[name], a, b, device)


def _list(rows: DataFrame) -> DataFrame:
    return U.capped(rows.withColumn("family", source_family(F.col("deviceId"))), MOST)


def heart_rate(tables: Tables, journal: DataFrame, start: str, end: str, device: str | None = None, bucket: int | None = None) -> DataFrame:
    """Measured heart rate, estimates where none was measured, without deleted ranges."""
    both = S.measured_wins_union(_rows(tables, "hrSample", start, end, device), _rows(tables, "ppgHrSample", start, end, device))
    rows = S.drop_deleted_ranges(both, deleted_hr_ranges(active_edits(journal)))
    return _list(rows) if bucket is None else S.hr_series(rows, clamp_bucket(bucket))


def variability(tables: Tables, start: str, end: str, device: str | None = None, bucket: int | None = None) -> DataFrame:
    return S.hrv_series(_rows(tables, "rrInterval", start, end, device), clamp_bucket(bucket))


def motion(tables: Tables, start: str, end: str, device: str | None = None, bucket: int | None = None) -> DataFrame:
    """Steps and posture; the phone's steps only in hour buckets."""
    parts = (_rows(tables, name, start, end, device) for name in ("stepSample", "gravitySample", "appleStepHour"))
    return S.motion_with_phone(*parts, clamp_bucket(bucket), device)


def imu(tables: Tables, start: str, end: str, device: str | None = None, bucket: int | None = None) -> DataFrame:
    return S.imu_series(_rows(tables, "imuActivity", start, end, device), clamp_bucket(bucket))


def skin_temperature(tables: Tables, start: str, end: str, device: str | None = None, bucket: int | None = None) -> DataFrame:
    rows = _rows(tables, "skinTempSample", start, end, device)
    return _list(S.temp_samples(rows, tables["pairedDevice"])) if bucket is None else S.temp_series(rows, tables["pairedDevice"], clamp_bucket(bucket))


def battery(tables: Tables, start: str, end: str, device: str | None = None, bucket: int | None = None) -> DataFrame:
    rows = _rows(tables, "battery", start, end, device)
    return _list(rows) if bucket is None else S.battery_series(rows, clamp_bucket(bucket))


def sleep_states(tables: Tables, start: str, end: str, device: str | None = None, gap: int | None = None) -> DataFrame:
    return U.rle_segments(_rows(tables, "sleepStateSample", start, end, device), clamp_gap(gap, 120, 3_600))


def device_events(tables: Tables, start: str, end: str, device: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    rows = _rows(tables, "event", start, end, device)
    rows = rows if kinds is None else rows.where(kind_matches(F.col("kind"), kinds))
    rows = rows.select("deviceId", "ts", "kind", split_kind(F.col("kind")).alias("k"), parse_payload(F.col("payloadJSON")).alias("p"))
    return _list(rows.select("deviceId", "ts", "kind", "k.*", "p.*"))


def imu_coverage(tables: Tables, gap: int | None = None, device: str | None = None) -> DataFrame:
    return U.imu_coverage(S.range_scan(tables["imuActivity"], device=device), clamp_gap(gap, 60, 86_400))


def deep_buffer_coverage(chunks: DataFrame, gap: int | None = None, by: list[str] | None = None) -> DataFrame:
    return U.deep_buffer_coverage(chunks, clamp_gap(gap, 60, 86_400), by)
