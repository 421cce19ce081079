"""Corrections from the append-only journal, as frames that are joined at read time; the data itself never changes.

The journal has one row per edit (seq, editId, kind, payloadJSON, beforeJSON, rationale, appliedAt, targetSeq); a row of
kind ``undo`` names in targetSeq the edit that it takes back.

Targets are named by their key. Where a source breaks the key and has two rows of one, ``also`` names whole numbers that tell
them apart: fields of the payload, and columns of the rows; each edit then meets its own row only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import duration_min, half_up, iso, source_family
from ..schemas import STAGES

#: Fields of a workout that a patch can set, with their types.
PATCHED = {"sport": "string", "startTs": "long", "endTs": "long", "energyKcal": "double", "distanceM": "double"}
#: Device and source of workouts that the journal adds; a deployment that shares its journal with other systems names its own.
ADDED = "cloud"
ANNOTATION = "day string, endDay string, startTs long, endTs long, tags array<string>, detail string, source string, tz string, values map<string,string>"


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("p", f"$.{path}", kind)


def active_edits(journal: DataFrame) -> DataFrame:
    """E-1: edits that no undo takes back."""
    undone = journal.where("kind = 'undo' and targetSeq is not null").select(F.col("targetSeq").alias("seq")).distinct()
    return journal.where("kind <> 'undo'").join(undone, "seq", "left_anti")


def _more(also: tuple[str, ...]) -> list[Column]:
    return [_get(n, "long").alias(n) for n in also]


def _of(active: DataFrame, kind: str) -> DataFrame:
    return active.where(F.col("kind") == kind).withColumn("p", F.try_parse_json("payloadJSON"))


def deleted_workouts(active: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """E-2a: keys of deleted workouts."""
    return _of(active, "delete_workout").select(_get("deviceId").alias("deviceId"), _get("startTs", "long").alias("startTs"), _get("sport").alias("sport"), *_more(also)).distinct()


def workout_patches(active: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """E-2b: by workout, each field's last patched value as a struct (null: not patched; a null inside: patched to null), and the last editId."""
    rows = _of(active, "fix_workout").select("seq", "editId", "p", *[c.alias(n) for n, c in (("deviceId", _get("deviceId")), ("startTs", _get("startTs", "long")), ("sport", _get("sport")))], *_more(also))
    last = []
    for name, kind in PATCHED.items():
        given = F.try_variant_get("p", f"$.patch.{name}", "variant").isNotNull()
        value = F.struct(F.try_variant_get("p", f"$.patch.{name}", kind).alias("value"))
        last.append(F.max_by(value, F.when(given, F.col("seq"))).alias(f"new_{name}"))
    return rows.groupBy("deviceId", "startTs", "sport", *also).agg(*last, F.max_by("editId", "seq").alias("editId"))


def added_workouts(active: DataFrame, device: str = ADDED) -> DataFrame:
    """E-2c: workouts that the journal adds, under a device id of their own."""
    w = _of(active, "add_workout")
    return w.select("editId", F.lit(device).alias("deviceId"), *[_get(n, k).alias(n) for n, k in PATCHED.items()], _get("notes").alias("notes"))


def sleep_bounds(active: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """E-2d: by session, the last new start and the last new end, each on its own, and the last editId."""
    rows = _of(active, "adjust_sleep_bounds").select("seq", "editId", _get("deviceId").alias("deviceId"), _get("startTs", "long").alias("startTs"), _get("newStartTs", "long").alias("a"), _get("newEndTs", "long").alias("b"), *_more(also))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy("deviceId", "startTs", *also).agg(last("a").alias("newStartTs"), last("b").alias("newEndTs"), F.max_by("editId", "seq").alias("editId"))


def deleted_points(active: DataFrame) -> DataFrame:
    """E-2e: keys of deleted daily or series values."""
    return _of(active, "delete_metric_point").select(_get("deviceId").alias("deviceId"), _get("day").alias("day"), _get("key").alias("key")).distinct()


def baseline_notes(active: DataFrame) -> DataFrame:
    """E-2f: standing notes in order of seq."""
    return _of(active, "set_baseline_note").select("seq", _get("note").alias("note"), _get("deviceId").alias("deviceId"), F.col("appliedAt").alias("at"))


def stage_edits(active: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """E-2g: by session, the last set of stages."""
    rows = _of(active, "edit_sleep_stages").select("seq", "editId", _get("deviceId").alias("deviceId"), _get("startTs", "long").alias("startTs"), F.from_json(F.to_json(F.try_variant_get("p", "$.stages", "variant")), STAGES).alias("stages"), *_more(also))
    return rows.groupBy("deviceId", "startTs", *also).agg(F.max_by("stages", "seq").alias("newStages"), F.max_by("editId", "seq").alias("stageEditId"))


def deleted_hr_ranges(active: DataFrame) -> DataFrame:
    """E-2h: deleted heart-rate ranges."""
    return _of(active, "delete_hr_range").select("editId", _get("deviceId").alias("deviceId"), _get("fromTs", "long").alias("fromTs"), _get("toTs", "long").alias("toTs"))


def annotations(active: DataFrame) -> DataFrame:
    """E-2i: dated events, all kept."""
    rows = active.where("kind = 'add_annotation'").withColumn("a", F.from_json("payloadJSON", ANNOTATION))
    return rows.select("editId", "seq", F.col("appliedAt").alias("at"), "a.*", "rationale")


def overlay(journal: DataFrame) -> dict[str, DataFrame]:
    """All families of E-2, over one set of active edits."""
    active = active_edits(journal)
    families = (deleted_workouts, workout_patches, added_workouts, sleep_bounds, deleted_points, baseline_notes, stage_edits, deleted_hr_ranges, annotations)
    return {f.__name__: f(active) for f in families}


def drop_deleted_points(points: DataFrame, deleted: DataFrame, key: str = "key") -> DataFrame:
    """J-3: long daily or series rows without deleted ones; ``key`` names the metric column."""
    gone = deleted.select("deviceId", "day", F.col("key").alias(key))
    return points.join(gone, ["deviceId", "day", key], "left_anti")


def overlay_sleep(sessions: DataFrame, bounds: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """J-9: sessions with corrected bounds; originalStartTs keeps the key."""
    b = bounds.select("deviceId", "startTs", *also, "newStartTs", "newEndTs", "editId")
    out = sessions.join(b, ["deviceId", "startTs", *also], "left").withColumn("originalStartTs", F.col("startTs"))
    out = out.withColumn("startTs", F.coalesce("newStartTs", "startTs")).withColumn("endTs", F.coalesce("newEndTs", "endTs"))
    out = out.withColumn("edited", F.col("editId").isNotNull()).withColumn("startIso", iso(F.col("startTs")))
    return out.withColumn("durationMin", duration_min(F.col("startTs"), F.col("endTs"))).drop("newStartTs", "newEndTs")


def overlay_stages(sessions: DataFrame, edits: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """J-11: stages of the edit where there is one, else of the session."""
    e = edits.withColumnRenamed("startTs", "originalStartTs")
    key = "originalStartTs" if "originalStartTs" in sessions.columns else "startTs"
    e = e if key == "originalStartTs" else e.withColumnRenamed("originalStartTs", "startTs")
    out = sessions.join(e, ["deviceId", key, *also], "left")
    return out.withColumn("stages", F.coalesce("newStages", F.from_json("stagesJSON", STAGES))).withColumn("stagesEdited", F.col("stageEditId").isNotNull()).drop("newStages")


def overlay_workouts(workouts: DataFrame, deleted: DataFrame, patches: DataFrame, added: DataFrame, start: int | None = None, end: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """J-10: workouts without deleted ones, with patches, and with those added within the range; edits go by the original key."""
    key = ["deviceId", "startTs", "sport", *also]
    out = workouts.join(deleted, key, "left_anti").join(patches, key, "left")
    new = {n: F.col(f"new_{n}") for n in PATCHED}
    moved = new["startTs"].isNotNull() | new["endTs"].isNotNull()
    for n in PATCHED:
        out = out.withColumn(n, F.when(new[n].isNotNull(), new[n]["value"]).otherwise(F.col(n)))
    out = out.withColumn("durationS", F.when(moved, (F.col("endTs") - F.col("startTs")).cast("double")).otherwise(F.col("durationS")))
    out = out.withColumn("family", source_family(F.col("deviceId"))).withColumn("edited", F.col("editId").isNotNull()).withColumn("added", F.lit(False))
    more = added.withColumn("durationS", (F.col("endTs") - F.col("startTs")).cast("double")).withColumn("source", F.col("deviceId")).withColumn("family", F.lit("cloud")).withColumn("edited", F.lit(False)).withColumn("added", F.lit(True))
    if start is not None:
        more = more.where(F.col("startTs") >= start)
    if end is not None:
        more = more.where(F.col("startTs") <= end)
    columns = ["deviceId", "family", "startTs", "endTs", "sport", "source", "durationS", "energyKcal", "distanceM", "edited", "added", "editId"]
    both = out.select(*columns).unionByName(more.select(*columns))
    return both.withColumn("startIso", iso(F.col("startTs"))).withColumn("durationMin", half_up(F.col("durationS") / 60))


def journal_with_state(journal: DataFrame, acks: DataFrame) -> DataFrame:
    """E-11: the journal with the seq that undid each row and the time it was first acknowledged."""
    undone = journal.where("kind = 'undo' and targetSeq is not null").select("targetSeq", F.col("seq").alias("by")).groupBy(F.col("targetSeq").alias("seq")).agg(F.min("by").alias("undoneBySeq"))
    first = acks.groupBy("seq").agg(F.min("ackedAt").alias("ackedAt"))
    return journal.join(undone, "seq", "left").join(first, "seq", "left")
