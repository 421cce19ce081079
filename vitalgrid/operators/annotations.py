"""Dated events on days and nights, and the zones that nights were lived in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import local_day, normalize_tz, shift_day, utc_day

#: Fixed order of reasons for which an annotation is shown.
RANKS = {"sameDay": 0, "span": 1, "priorEvening": 2}


def known_zones(zones: DataFrame) -> DataFrame:
    """P-12: (day, tzId) with a zone of IANA shape; one that the session does not know is dropped by trial."""
    ids = zones.withColumn("tzId", normalize_tz(F.col("tzId"))).where("tzId is not null")
    import zoneinfo

    valid = sorted(zoneinfo.available_timezones())
    return ids.where(F.col("tzId").isin(valid)).groupBy("day").agg(F.max("tzId").alias("tzId"))


def resolve_local_tz(sessions: DataFrame, zones: DataFrame) -> DataFrame:
    """J-5: sessions with tzId and localDay. Of the UTC day and its neighbours, the first whose zone shows the start on that same day; else the zone of the UTC day; the day falls back to UTC."""
    z = known_zones(zones)
    key = ["deviceId", "startTs"]
    base = sessions.select(*key).distinct().withColumn("utc", utc_day(F.col("startTs")))
    tries = base.withColumn("c", F.explode(F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(off).alias("off")) for rank, off in enumerate((0, -1, 1))])))
    tries = tries.withColumn("day", F.date_format(F.date_add(F.to_date("utc"), F.col("c.off")), "yyyy-MM-dd")).join(z, "day")
    fits = local_day(F.col("startTs"), F.col("tzId")) == F.col("day")
    order = F.when(fits, F.col("c.rank")).when(F.col("c.rank") == 0, F.lit(3))
    best = tries.withColumn("order", order).where("order is not null").groupBy(*key).agg(F.min_by("tzId", "order").alias("tzId"))
    out = sessions.join(best, key, "left")
    return out.withColumn("localDay", F.when(F.col("tzId").isNotNull(), local_day(F.col("startTs"), F.coalesce("tzId", F.lit("UTC")))).otherwise(utc_day(F.col("startTs"))))


def _matches(annotations: DataFrame, prior: bool, by: list[str]) -> DataFrame:
    """Annotations by each day they bear on, with matchedOn and its rank."""
    last = F.greatest(F.coalesce("endDay", "day"), F.col("day"))
    days = F.transform(F.sequence(F.to_date("day"), F.to_date(last)), lambda d: F.date_format(d, "yyyy-MM-dd"))
    own = F.transform(days, lambda d: F.struct(d.alias("onDay"), F.when(d == F.col("day"), F.lit(0)).otherwise(F.lit(1)).alias("rank")))
    if prior:
        own = F.concat(own, F.array(F.struct(shift_day(F.col("day"), 1).alias("onDay"), F.lit(2).alias("rank"))))
    rows = annotations.withColumn("m", F.explode(own)).select("*", "m.onDay", "m.rank").drop("m")
    first = F.min("rank").over(Window.partitionBy(*by, "onDay", "seq"))
    rows = rows.withColumn("best", first).where("rank = best").drop("best")
    name = F.element_at(F.array(*map(F.lit, RANKS)), F.col("rank") + 1)
    return rows.withColumn("matchedOn", name).drop("rank")


def _listed(rows: DataFrame, by: list[str]) -> DataFrame:
    item = F.struct("day", "seq", "editId", "tags", "source", "detail", "matchedOn", "endDay", "startTs", "endTs", "tz", F.map_entries("values").alias("values"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("annotations"))


def owner_key(*frames: DataFrame) -> tuple[str, ...]:
    """The column that tells owners apart, if all frames have it; data without it are those of one owner."""
    return ("owner",) if all("owner" in df.columns for df in frames) else ()


def annotations_on_day(days: DataFrame, annotations: DataFrame, by: tuple[str, ...] | None = None) -> DataFrame:
    """J-6: days with the annotations of that day and of spans over it; an equi-join on the day and owner.

    ``by`` names columns of both sides that tell owners apart: ``owner``, if both have it.
    """
    by = owner_key(days, annotations) if by is None else by
    wanted = days.select(*by, F.col("day").alias("onDay")).distinct()
    own = _listed(_matches(annotations, False, [*by]).join(wanted, [*by, "onDay"], "left_semi"), [*by, "onDay"])
    return days.join(own.withColumnRenamed("onDay", "day"), [*by, "day"], "left")


def annotations_for_night(sessions: DataFrame, annotations: DataFrame, by: tuple[str, ...] | None = None, shown: Column | None = None) -> DataFrame:
    """J-7: sessions (with localDay) with the annotations of the day, of spans, and of the evening before, of their owner (see J-6).

    ``shown`` is what stands in the place of the list, made of the column ``annotations``: it is worked out once for each day,
    before the join, and not for each session.
    """
    by = owner_key(sessions, annotations) if by is None else by
    wanted = sessions.select(*by, F.col("localDay").alias("onDay")).distinct()
    own = _listed(_matches(annotations, True, [*by]).join(wanted, [*by, "onDay"], "left_semi"), [*by, "onDay"])
    own = own if shown is None else own.withColumn("annotations", shown)
    return sessions.join(own.withColumnRenamed("onDay", "localDay"), [*by, "localDay"], "left")


def recent_annotations(annotations: DataFrame, start: str | None = None, end: str | None = None, tags: list[str] | None = None, source: str | None = None, limit: int = 200) -> DataFrame:
    """L-2: the newest ``limit`` annotations that overlap the days, with any of the tags, in reading order.

    ``place`` numbers them from the oldest on; ``matched`` is how many fit what was asked, ``total`` how many there are.
    """
    fits = F.lit(True)
    if start is not None:
        fits &= F.coalesce("endDay", "day") >= start
    if end is not None:
        fits &= F.col("day") <= end
    if tags:
        fits &= F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if source is not None:
        fits &= F.col("source") == source
    rows = annotations.withColumn("fits", F.coalesce(fits, F.lit(False)))
    count = rows.agg(F.count_if("fits").alias("matched"), F.count("*").alias("total"))
    kept = rows.where("fits").drop("fits").orderBy(F.desc("day"), F.desc("seq")).limit(limit)
    kept = kept.withColumn("place", F.row_number().over(Window.orderBy("day", "seq")))  # at most limit rows
    return kept.crossJoin(F.broadcast(count)).orderBy("place")  # one row of counts


def latest_baseline_notes(notes: DataFrame) -> DataFrame:
    """A-18: the last note of each device (none is a device of its own) and how many it hides."""
    return notes.groupBy("deviceId").agg(F.max_by("note", "seq").alias("note"), F.max_by("at", "seq").alias("at"), (F.count("*") - 1).alias("supersededCount"))


def tags_in_use(annotations: DataFrame) -> DataFrame:
    """A-20: distinct tags."""
    return annotations.select(F.explode("tags").alias("tag")).distinct()


def annotation_summary(annotations: DataFrame) -> DataFrame:
    """A-19: number, first and last day, and tags in use."""
    return annotations.agg(F.count("*").alias("count"), F.min("day").alias("firstDay"), F.max(F.coalesce("endDay", "day")).alias("lastDay"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
