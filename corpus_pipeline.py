"""Corpus preparation in stages, each over all that its predecessor kept.

A stage is a function of (spark, docs, sf_dir) that returns documents (the last one: token ids); between stages the
documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import mixing, ngram_join, quality, sentencepiece_codec, suffix_dedup
from vitalgrid.llm.common import WORD, discard, materialize, small, table
from vitalgrid.llm.registry import piece_model

#: Words of a shingle, and the similarity in per cent that makes two documents near copies; the op6 query has its own.
SHINGLE, PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject, themselves or by their host.

    Each row is judged by its own text: null and empty texts go; rows without an id or with the id of another row are
    rows like others; repeated rows stay or go together; an empty table gives an empty one.
    """
    return quality.keep_good(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group that shingle similarity links.

    Of repeated rows (one id and text) one stays; rows without an id take no part in links and stay; texts without words
    are linked with nothing and stay; an empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    linked = ngram_join.link_classes(docs, k=SHINGLE, percent=PERCENT).where("component_id <> doc_id").select("doc_id").distinct()
    out = docs.join(small(materialize(linked, "linked")), "doc_id", "left_anti").select(*COLUMNS)
    twice = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return out
    again = out.join(small(twice), "doc_id", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return out.join(small(twice), "doc_id", "left_anti").select(*COLUMNS).unionByName(again)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what repeats 100 bytes that start earlier.

    Null texts stay null; rows without an id lose nothing; repeated rows lose the same; a text may become empty.
    """
    return suffix_dedup.cut_text(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their targets; a document that is taken in part counts as whole from half its words on.

    Texts without words are dropped; a null source is a source of its own; rows of one source and id, or without an id,
    are repeated alike; an empty table gives an empty one.
    """
    taken = mixing.mix(docs.select(*COLUMNS)).where("size > 0").groupBy(F.col("doc_id").alias("own"), F.col("source").alias("of")).agg(F.max(F.round(F.col("taken") / F.col("size")).cast("int")).alias("copies"))
    here = F.col("doc_id").eqNullSafe(F.col("own")) & F.col("source").eqNullSafe(F.col("of"))
    out = docs.select(*COLUMNS).where(F.regexp_like("text", F.lit(WORD))).join(taken.where("copies > 0"), here)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text again; null text has no ids."""
    ids = sentencepiece_codec.encode(docs, piece_model(), keep=["doc_id", "lang", "source", "n_chars"], lossless_col="lossless")
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", piece_ids),
]

#: SQL can express neither suffix arrays nor the encoding; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:  # its successor is written
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
