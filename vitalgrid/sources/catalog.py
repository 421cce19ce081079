"""Reading and writing the datasets: streams by name, snapshots, journal, acknowledgements, chunk manifest.

A root holds tables in versions (see ``versions``) and the append-only server datasets beside them. A table that is absent
reads as empty, a column that is absent as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions.exprs import normalize_tz, safe_day
from ..schemas import ALL
from . import versions

#: Fixed value: the table without which an upload is no snapshot.
MARKER = "grdb_migrations"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, null where the frame lacks one."""
    there = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{there[f.name.lower()]}`") if f.name.lower() in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_stream_table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-1: a table of a root by name; without files it is an empty frame of its schema."""
    schema = schema or ALL.get(name)
    if name == "ingestLog":
        return ingest_log(spark, root)
    try:
        df = spark.read.parquet(f"{root}/{name}")
    except AnalysisException as e:
        if schema is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return df if schema is None else conform(df, schema)


def ingest_log(spark: SparkSession, root: str) -> DataFrame:
    """Uploads, from the log of the root's versions."""
    if not versions.numbers(spark, root):
        return spark.createDataFrame([], ALL["ingestLog"])
    entries = spark.read.schema(T.StructType([T.StructField("upload", ALL["ingestLog"])])).json(f"{root}/_log/*.json")
    return entries.where("upload is not null").select("upload.*")


def read_snapshot_table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None, snapshot: str | None = None, days: bool = False) -> DataFrame:
    """A table of the latest published snapshot, or of the one that is named; with utcDay, by which it is stored, if asked for."""
    at = _upload(spark, root, snapshot)
    if at is None and snapshot is not None:
        raise ValueError(f"no snapshot {snapshot}")
    df = versions.read_days(spark, root, name, schema or ALL.get(name), at or {"tables": {}})
    return df if days else df.drop("utcDay")


def _upload(spark: SparkSession, root: str, snapshot: str | None = None) -> dict | None:
    """The entry of the log that the last upload made, or the one of a name."""
    if snapshot is None:
        last = versions.entry(spark, root)["uploaded"]
        return versions.entry(spark, root, last) if last else None
    return next((e for e in (versions.entry(spark, root, n) for n in reversed(versions.numbers(spark, root))) if e["upload"] and e["upload"]["snapshot"] == snapshot), None)


def latest_upload(log: DataFrame) -> DataFrame:
    """SRC-8: the last row of the ingest log; no row for an empty log."""
    return log.agg(F.max_by(F.struct(*log.columns), "id").alias("r")).where("r is not null").select("r.*")


def read_journal(journal: DataFrame, since: int = 0) -> DataFrame:
    """SRC-6: rows after ``since``, in order of seq."""
    return journal.where(F.col("seq") > since).orderBy("seq")


def latest_seq(journal: DataFrame, since: int = 0) -> DataFrame:
    """SRC-6: the last seq after ``since``, or ``since``."""
    return journal.where(F.col("seq") > since).agg(F.coalesce(F.max("seq"), F.lit(since)).cast("long").alias("latestSeq"))


def publish_snapshot(tables: dict[str, DataFrame], root: str, snapshot_id: str, received_at: int, bytes_: int = 0, phone_tz: str | None = None) -> bool:
    """SNK-1: write a whole upload as new versions of all tables, stored by day, and make it the latest.

    False, and nothing changed for readers, where the marker table is absent or empty. A published id is not written again.
    Tables that the upload lacks are gone. Of two publishers at the same time the slower one gets ``versions.LostRace``.
    """
    if MARKER not in tables or tables[MARKER].isEmpty():
        return False
    spark = tables[MARKER].sparkSession
    before = versions.entry(spark, root)
    log = ingest_log(spark, root)
    if not log.where(F.col("snapshot") == snapshot_id).isEmpty():
        raise ValueError(f"snapshot {snapshot_id} is published")
    day = tables["dailyMetric"].agg(F.max("day").alias("d")) if "dailyMetric" in tables else tables["hrSample"].agg(safe_day(F.max("ts")).alias("d")) if "hrSample" in tables else None
    latest = day.first()["d"] if day is not None else None
    zone = spark.range(1).select(normalize_tz(F.lit(phone_tz).cast("string"))).first()[0]
    changes = {name: versions.write_days(conform(df, ALL[name]) if name in ALL else df, root, name) for name, df in tables.items()}
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]
    upload = {"id": last + 1, "receivedAt": received_at, "bytes": bytes_, "latestDay": latest, "phoneTz": zone, "snapshot": snapshot_id}
    versions.commit(spark, root, before | {"tables": {}}, changes, upload, alone=True)
    return True


def number_rows(batch: DataFrame, last: DataFrame, order: list[str | Column], name: str = "seq", stretch: Column | None = None) -> DataFrame:
    """Rows numbered on from the one number in ``last``.

    ``stretch`` grows with the order: rows are numbered within a stretch, and only one row a stretch, its number of rows,
    passes through a window over all.
    """
    rows = batch.withColumn("stretch", F.lit(0) if stretch is None else stretch)
    sizes = rows.groupBy("stretch").agg(F.count("*").alias("size"))
    over = Window.partitionBy().orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("stretch", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("before"))
    top = last.select(F.col(last.columns[0]).alias("top"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("stretch").orderBy(*order))).join(sizes, "stretch")
    rows = rows.crossJoin(F.broadcast(top))  # last has one row
    return rows.withColumn(name, (F.col("top") + F.col("before") + F.col("n")).cast("long")).drop("stretch", "n", "before", "top")


def append_journal(spark: SparkSession, root: str, batch: DataFrame) -> None:
    """SNK-2: append edits with growing seq, in order of (appliedAt, editId); edits whose editId is there already are left out."""
    journal = read_stream_table(spark, root, "editJournal")
    new = batch.dropDuplicates(["editId"]).join(journal.select("editId"), "editId", "left_anti")
    rows = number_rows(new, latest_seq(journal), ["appliedAt", "editId"], stretch=F.coalesce(F.floor(F.col("appliedAt") / 3600), F.lit(-(2**62))))
    conform(rows, ALL["editJournal"]).write.mode("append").parquet(f"{root}/editJournal")


def new_acks(seqs: DataFrame, acks: DataFrame) -> DataFrame:
    """SNK-3: acknowledgements (seq, ackedAt) that are the first of their seq."""
    return seqs.groupBy("seq").agg(F.min("ackedAt").alias("ackedAt")).join(acks.select("seq").distinct(), "seq", "left_anti")


def ack_edits(spark: SparkSession, root: str, seqs: DataFrame) -> int:
    """SNK-3: append first acknowledgements of edits that exist; returns how many."""
    known = seqs.join(read_stream_table(spark, root, "editJournal").select("seq"), "seq", "left_semi")
    rows = new_acks(known, read_stream_table(spark, root, "ack")).persist()
    n = rows.count()
    conform(rows, ALL["ack"]).write.mode("append").parquet(f"{root}/ack")
    rows.unpersist()
    return n


def new_chunks(chunks: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-4: (chunks to store, duplicates): by (generation, byteStart) the first, and only if the manifest has none."""
    key = ["generation", "byteStart"]
    order = F.row_number().over(Window.partitionBy(*key).orderBy("receivedAt", "byteEnd"))
    there = manifest.select(*key).distinct().withColumn("stored", F.lit(True))
    marked = chunks.withColumn("n", order).join(there, key, "left")
    fresh = (F.col("n") == 1) & F.col("stored").isNull()
    return marked.where(fresh).drop("n", "stored"), marked.where(~fresh).drop("n", "stored")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The chunk manifest, one row a chunk: the first that was received, should two writers have stored one at the same time."""
    rows = read_stream_table(spark, root, "deepBufferChunk")
    order = Window.partitionBy("generation", "byteStart").orderBy("receivedAt", "byteEnd", "objectKey")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def write_chunk_manifest(spark: SparkSession, root: str, chunks: DataFrame) -> tuple[int, int]:
    """SNK-4: append new chunks; returns how many were stored and how many were duplicates."""
    chunks = conform(chunks, ALL["deepBufferChunk"]).persist()
    fresh, _ = new_chunks(chunks, read_stream_table(spark, root, "deepBufferChunk"))
    fresh = fresh.persist()
    n, total = fresh.count(), chunks.count()
    if n:
        fresh.select(*[f.name for f in ALL["deepBufferChunk"].fields]).coalesce(1).write.mode("append").parquet(f"{root}/deepBufferChunk")
    fresh.unpersist(), chunks.unpersist()
    return n, total - n
