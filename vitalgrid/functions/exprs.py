"""Scalar expressions: all of them built-in, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device models whose skin sensor is read with the affine rule, and the last second a date can show.
AFFINE_MODELS = ("4.0", "WHOOP 4.0")
LAST_SECOND = 8_640_000_000_000
U16 = 65_536
#: Names of activity classes, sleep states and buffer sizes.
SLEEP_STATES = {0: "wake", 1: "still", 2: "asleep", 3: "up"}
BUFFER_KINDS = {1244: "imu-6axis-100hz", 2140: "optical-ppg-undecoded"}
#: Shapes of tags, days, zones, event kinds and chunk paths.
TAG = "^[a-z][a-z0-9_]{1,31}$"
DAY = r"^\d{4}-\d{2}-\d{2}$"
ZONE = r"^(?:[A-Za-z_]+/[A-Za-z0-9_+\-/]+|UTC)\z"
KIND = r"^(.*)\((\d+)\)$"
CHUNK = r"deepbuf/v1/([0-9-]+)/(\d{16})\.jsonl\.deflate$"


def half_up(x: Column, digits: int = 0) -> Column:
    """Round to ``digits`` with ties towards plus infinity (F-1)."""
    k = 10.0**digits
    out = F.floor(x * F.lit(k) + F.lit(0.5))
    return out if digits == 0 else out / F.lit(k)


def source_family(device: Column) -> Column:
    """Family of a device id (P-1)."""
    return F.when(device == "oura-api", "oura").when(device == "apple-health", "apple").otherwise("whoop")


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(ts / F.lit(seconds)).cast("long") * F.lit(seconds)


def clamp_bucket(seconds: int | None, default: int | None = 300) -> int | None:
    """Bucket sizes callers may ask for: 60 to 3600 seconds."""
    return default if seconds is None else min(3600, max(60, seconds))


def clamp_gap(seconds: int | None, default: int, most: int) -> int:
    return default if seconds is None else min(most, max(1, seconds))


def iso(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def minute_iso(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm'Z'")


def utc_day(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def safe_ts(ts: Column) -> Column:
    """Null where a second cannot be shown as a date (P-7), so that one corrupt row fails no query."""
    return F.when(F.abs(ts) <= LAST_SECOND, ts)


def safe_day(ts: Column) -> Column:
    return utc_day(safe_ts(ts))


def local_day(ts: Column, zone: Column) -> Column:
    """The calendar day of a second in a zone; zones must be valid (see ``known_zone``)."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(ts), zone), "yyyy-MM-dd")


def shift_day(day: Column, days: int | Column) -> Column:
    return F.date_format(F.date_add(F.to_date(day), days), "yyyy-MM-dd")


def normalize_tz(zone: Column) -> Column:
    """A zone name of the shape Area/Location, or UTC, as it is; else null (P-12)."""
    return F.when(zone.rlike(ZONE), zone)


def kind_matches(kind: Column, wanted: list[str]) -> Column:
    """An event kind that is one of ``wanted``, or whose label before the first parenthesis is (P-3)."""
    return kind.isin(wanted) | ((F.instr(kind, "(") > 0) & F.substring_index(kind, "(", 1).isin(wanted))


def split_kind(kind: Column) -> Column:
    """Label and opcode of ``LABEL(op)``, split at the last parenthesis (P-4)."""
    fits = kind.rlike(KIND)
    label = F.when(fits, F.regexp_extract(kind, KIND, 1)).otherwise(kind)
    return F.struct(label.alias("label"), F.when(fits, F.regexp_extract(kind, KIND, 2).cast("int")).alias("opcode"))


def parse_payload(text: Column) -> Column:
    """(payload, payloadRaw): parsed JSON, or the raw text where it is none, blank text included; both null for nothing and an object without keys (P-5)."""
    parsed = F.try_parse_json(text)
    shown = F.to_json(parsed)
    return F.struct(F.when(shown != "{}", shown).alias("payload"), F.when((text != "") & parsed.isNull(), text).alias("payloadRaw"))


def skin_temp_celsius(raw: Column, model: Column) -> Column:
    """Degrees of a raw skin reading by the device's model (P-6)."""
    affine = F.coalesce(model.isin(*AFFINE_MODELS), F.lit(False))
    return F.when(affine, F.lit(33.0) + (raw - 826) * F.lit(0.05)).otherwise(raw / F.lit(100.0))


def buffer_kind(size: Column) -> Column:
    """What a buffer of a size holds (P-11)."""
    out = F.lit("other")
    for n, name in BUFFER_KINDS.items():
        out = F.when(size == n, name).otherwise(out)
    return out


def state_label(state: Column) -> Column:
    out = F.concat(F.lit("state_"), state.cast("string"))
    for n, name in SLEEP_STATES.items():
        out = F.when(state == n, name).otherwise(out)
    return out


def duration_min(start: Column, end: Column) -> Column:
    """Whole minutes (P-10)."""
    return half_up((end - start) / F.lit(60))


def truncate(text: Column, n: int) -> Column:
    """The text, or its first n-1 characters and an ellipsis (F-4)."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def date_in(text: Column) -> Column:
    """The first YYYY-MM-DD in a text, or null (F-4)."""
    found = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    return F.when(found != "", found)


def chunk_path(generation: Column, byte_start: Column) -> Column:
    """Where a chunk lies: zero-padded, so that name order is byte order (F-7)."""
    return F.concat(F.lit("deepbuf/v1/"), generation, F.lit("/"), F.lpad(byte_start.cast("string"), 16, "0"), F.lit(".jsonl.deflate"))


def chunk_identity(path: Column) -> Column:
    """(generation, byteStart) of a chunk's path (F-7)."""
    fits = path.rlike(CHUNK)
    return F.struct(F.when(fits, F.regexp_extract(path, CHUNK, 1)).alias("generation"), F.when(fits, F.regexp_extract(path, CHUNK, 2).cast("long")).alias("byteStart"))


def stages_of(text: Column) -> Column:
    """Sleep stages of a JSON text; null where it is none (F-5)."""
    from ..schemas import STAGES

    return F.from_json(text, STAGES)
