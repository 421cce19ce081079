"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Sizes are summed by source and leading hash digits; a running sum over those few buckets finds where a source's budget
falls, and only the bucket at the boundary is looked into again with further digits, until one hash value is left.
Documents are then taken by comparing their hash with the threshold, without a sort of documents.

Edge cases: null text has size 0; a null source is a source of its own, last in order; a null document id is hashed as
the empty text; repeated rows share a hash and are treated alike (at the threshold they share what is left); an empty
table gives an empty result; a source without words gets the target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Weights of sources in order of their code points, repeating.
WEIGHTS = (5, 2, 1)
#: Words wanted in total, as a share of all words, and the most of a source or document, in times its size.
SHARE, MOST = 1.5, 2
#: Hash bits of the two upper histograms; what is left of 60 bits is told apart in the last one.
DIGITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 digest of the id in decimals."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with target: shares by weight, held to ``most`` times the size, the excess spread again.

    One row per source passes through the unpartitioned windows, never a document.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    df = sources.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_room = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    df = df.withColumn("total", share * F.sum("source_size").over(everything))
    df = df.withColumn("left", F.col("total") - (F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")))
    df = df.withColumn("rest_weight", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("rest_weight"))
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    share_of = F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("weight") / free_weight)
    return df.select("source", "source_size", share_of.alias("target"))


def _boundary(hist: DataFrame, keys: list[str], digit: str) -> DataFrame:
    """``hist`` (keys, digit, words, rest) with what lies before each bucket."""
    w = Window.partitionBy(*keys).orderBy(digit)
    before = F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    return hist.withColumn("before", before)


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``id_col``, source, size, source_size, target and taken (words taken, repeats counted) of every row of ``docs``."""
    h = F.col("hash")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("hash"))
    # a text for joins in which a null source equals itself
    sized = sized.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sized = sized.withColumn("d1", F.shiftright(h, 60 - DIGITS)).withColumn("d2", F.shiftright(h, 60 - 2 * DIGITS))
    base = materialize(sized, "mixing")

    hist = base.groupBy("src", "source", "d1").agg(F.sum("size").alias("words"))
    goal = targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = goal.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    size = F.col("source_size")
    goal = goal.withColumn("copies", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.round(F.col("target") - F.col("copies") * size).cast("long")).drop("source")
    first = materialize(_boundary(hist.join(goal, "src"), ["src"], "d1"), "mixing-hist")

    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    # below a cut bucket the budget may also end with a bucket's last word: that bucket is then the edge, taken in whole
    ends = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    left = (F.col("rest") - F.col("before")).alias("rest")
    for digit, keys in (("d2", ["src", "d1"]), ("hash", ["src", "d2"])):
        edge = (first.where(cut) if digit == "d2" else at.where(ends)).select(*keys, left)
        own = base.join(edge, keys).groupBy(*keys, digit, "rest").agg(F.sum("size").alias("words"))
        at = _boundary(own, keys, digit)
    edge = at.where(ends).select("src", F.col("hash").alias("edge"), (F.col("rest") - F.col("before")).alias("edge_rest"), F.col("words").alias("edge_words"))
    # Buckets wholly inside the budget are taken, the boundary bucket by the threshold; keyed by bucket, so that no source is hot.
    verdict = first.join(edge, "src", "left").withColumn("inside", F.col("before") + F.col("words") <= F.col("rest")).withColumn("cut", cut)
    verdict = verdict.select("src", "d1", "source_size", "target", "copies", "inside", "cut", "edge", "edge_rest", "edge_words")
    extra = F.when(F.col("inside"), F.col("size")).when(F.col("cut") & (h < F.col("edge")), F.col("size"))
    extra = extra.when(F.col("cut") & (h == F.col("edge")), F.expr("edge_rest * size div edge_words")).otherwise(F.lit(0))
    taken = F.col("copies") * F.col("size") + extra
    return base.join(verdict, ["src", "d1"]).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"))
