"""How much a snapshot changed, and what a partition holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_up


def snapshot_churn(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Q-1: rows that differ, came and went between two snapshots of a table, and their share of the new one.

    Without an old snapshot everything is new (bootstrap); with another schema nothing is compared (schemaChanged). A row
    is compared by a hash of its columns; rows of one key are counted together.
    """

    def whole(bootstrap: bool, changed: bool) -> DataFrame:
        n = F.count("*")
        zero = F.lit(0).cast("long")
        share = F.when(n > 0, 100.0).otherwise(0.0) if bootstrap else F.lit(100.0)
        return new.agg(n.alias("newRows"), zero.alias("differing"), n.alias("added"), zero.alias("removed"), n.alias("delta"), share.alias("churnPct")).withColumn("bootstrap", F.lit(bootstrap)).withColumn("schemaChanged", F.lit(changed))

    if old is None:
        return whole(True, False)
    if [(f.name, f.dataType) for f in old.schema] != [(f.name, f.dataType) for f in new.schema]:
        return whole(False, True)
    columns = new.columns
    side = lambda df, name: df.groupBy(*keys).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias(f"{name}Hash"), F.count("*").alias(f"{name}Rows"))
    a, b = side(old, "old").alias("a"), side(new, "new").alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, same, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    gone, came = F.col("newRows").isNull(), F.col("oldRows").isNull()
    differs = ~gone & ~came & ((F.col("oldHash") != F.col("newHash")) | (F.col("oldRows") != F.col("newRows")))
    t = both.agg(F.coalesce(F.sum("newRows"), F.lit(0)).alias("newRows"), count(differs).alias("differing"), count(came).alias("added"), count(gone).alias("removed"))
    t = t.withColumn("delta", F.col("differing") + F.col("added"))
    pct = F.when(F.col("newRows") == 0, 0.0).otherwise(half_up(F.col("delta") / F.col("newRows") * 100, 1))
    return t.withColumn("churnPct", pct).withColumn("bootstrap", F.lit(False)).withColumn("schemaChanged", F.lit(False))


def churn_history(log: DataFrame, limit: int = 20) -> DataFrame:
    """Q-2: the last measurements, newest first."""
    return log.orderBy(F.desc("measuredAt"), F.desc("tableName")).limit(limit)


def partition_digest(df: DataFrame, table: str) -> DataFrame:
    """Q-3: rows by device and UTC day."""
    return df.groupBy("deviceId", F.floor(F.col("ts") / 86400).alias("utcDay")).agg(F.count("*").alias("rows")).withColumn("table", F.lit(table))


def stale_partitions(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Partitions whose numbers of rows differ: what a delta has to replace."""
    key = ["table", "deviceId", "utcDay"]
    both = mine.withColumnRenamed("rows", "mine").join(theirs.withColumnRenamed("rows", "theirs"), key, "full_outer")
    return both.where(~F.col("mine").eqNullSafe(F.col("theirs"))).select(*key, "mine", "theirs")
