"""Schemas of the sensor streams, rollups, registries and server-side datasets.

All ``ts``, ``startTs`` and ``endTs`` are epoch seconds (UTC); ``day`` is text, YYYY-MM-DD.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _s(columns: str) -> T.StructType:
    """A schema of plain columns; unlike DDL, it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


STREAMS: dict[str, T.StructType] = {
    "hrSample": _s("deviceId string, ts long, bpm int"),
    "ppgHrSample": _s("deviceId string, ts long, bpm double, conf double"),
    "rrInterval": _s("deviceId string, ts long, rrMs int, seq int, synced int"),
    "dailyMetric": _s("deviceId string, day string, totalSleepMin int, efficiency double, restingHr double, avgHrv double, recovery double, strain double, spo2Pct double, skinTempDevC double, respRateBpm double, steps int, activeKcalEst double"),
    "sleepSession": _s("deviceId string, startTs long, endTs long, efficiency double, restingHr double, avgHrv double, stagesJSON string, userEdited int, startTsAdjusted long"),
    "workout": _s("deviceId string, startTs long, sport string, endTs long, source string, durationS double, energyKcal double, distanceM double"),
    "metricSeries": _s("deviceId string, day string, key string, value double"),
    "appleDaily": _s("deviceId string, day string, steps int, restingHr double"),
    "pairedDevice": _s("id string, brand string, model string, sourceKind string"),
    "stepSample": _s("deviceId string, ts long, counter int, activityClass int"),
    "gravitySample": _s("deviceId string, ts long, x double, y double, z double, synced int"),
    "appleStepHour": _s("deviceId string, ts long, steps int"),
    "imuActivity": _s("deviceId string, ts long, accelEnergyG double, gyroEnergyDps double, jerkRms double, cadenceHz double, cadenceStrength double, sampleCount int"),
    "skinTempSample": _s("deviceId string, ts long, raw int"),
    "sleepStateSample": _s("deviceId string, ts long, state int"),
    "battery": _s("deviceId string, ts long, soc double, mv int, synced int, charging boolean"),
    "event": _s("deviceId string, ts long, kind string, payloadJSON string, synced int"),
    "phoneTimezone": _s("day string, tzId string"),
    "grdb_migrations": _s("identifier string"),
}

SERVER: dict[str, T.StructType] = {
    "ingestLog": _s("id long, receivedAt long, bytes long, latestDay string, phoneTz string, snapshot string"),
    "proposal": _s("id string, kind string, payloadJSON string, rationale string, beforeJSON string, diffText string, createdAt long"),
    "resolution": _s("id string, status string, resolvedAt long, ord long"),
    "editJournal": _s("seq long, editId string, kind string, payloadJSON string, beforeJSON string, rationale string, appliedAt long, targetSeq long"),
    "ack": _s("seq long, ackedAt long"),
    "deepBufferChunk": _s(
        "generation string, byteStart long, byteEnd long, objectKey string, deviceId string, storedBytes long, rawBytes long, lines long, firstTsMs long, lastTsMs long, "
        "firstStrapTs long, lastStrapTs long, n1244 long, n2140 long, nOther long, nImu long, nOffload long, badLines long, receivedAt long, phoneTz string"
    ),
    "churnLog": _s("measuredAt long, tableName string, newRows long, differing long, added long, removed long, delta long, churnPct double, bootstrap boolean, schemaChanged boolean"),
}

ALL = STREAMS | SERVER

#: Key of each stream, for delta application and churn.
KEYS: dict[str, list[str]] = {
    "rrInterval": ["deviceId", "ts", "rrMs", "seq"],
    "dailyMetric": ["deviceId", "day"],
    "metricSeries": ["deviceId", "day", "key"],
    "sleepSession": ["deviceId", "startTs"],
    "workout": ["deviceId", "startTs", "sport"],
    "appleDaily": ["deviceId", "day"],
    "pairedDevice": ["id"],
    "event": ["deviceId", "ts", "kind"],
    "phoneTimezone": ["day"],
}


def key_of(table: str) -> list[str]:
    return KEYS.get(table, ["deviceId", "ts"])


#: A sleep stage, and a line of a deep-buffer chunk.
STAGES = "array<struct<start:long,end:long,stage:string>>"
DEEP_LINE = "ts_ms long, strap_ts long, size int, offload boolean, char string, hex string, imu struct<sampleCount:int,accelEnergyG:double,cadenceHz:double>"
