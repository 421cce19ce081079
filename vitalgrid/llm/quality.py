"""Quality rules with host-level verdicts.

Every document is measured once; failures of the document rules are summed by host (the ``source`` of a document),
each host's failure rate is shrunk towards the mean of all hosts by a beta prior fitted to their spread, and hosts whose
shrunk rate is too high are joined back to reject what else they hold.

Edge cases: null or empty text has no words and fails; a null host is a host of its own; very long texts are measured in
whole; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, frees, materialize, small, text_parts

#: A document fails with fewer words, or with a larger percentage of its words in repeated windows, or of symbols to words.
MIN_WORDS, MAX_REPEAT_PCT, MAX_SYMBOL_PCT = 20, 30, 30
WINDOW = 8
#: A host is rejected if its shrunk failure rate reaches this.
HOST_LIMIT = 0.5
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(WORD)


def repeated_words(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Of each document, the words in windows of WINDOW words that stand there twice or more. codes: word codes, doc: which document, ascending."""
    if len(codes) < WINDOW:
        return np.zeros(n_docs, np.int64)
    h = codes.astype(np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    span = 1
    while span < WINDOW:  # polynomial hash of 1, 2, 4, 8 words
        h = h[:-span] * factor + h[span:]
        factor = factor * factor
        span *= 2
    inside = np.flatnonzero(doc[: len(h)] == doc[WINDOW - 1 :])
    h = h[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h, kind="stable")
    s = h[order]
    equal = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    at = inside[order[twice]]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts of the rules for some texts."""
    texts = [x if isinstance(x, str) else "" for x in texts]
    words = [_WORD.findall(x) for x in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    code: dict[str, int] = {}
    flat = np.fromiter((code.setdefault(w, len(code) + 1) for own in words for w in own), np.int64, int(n.sum()))
    repeat = repeated_words(flat, np.repeat(np.arange(len(texts)), n), len(texts))
    dup = []
    for x in texts:
        lines = [y for y in x.split("\n") if y.strip(" \t\n\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": n,
        "word_chars": np.array([sum(map(len, own)) for own in words], np.int64),
        "n_symbols": np.array([sum(map(x.count, SYMBOLS)) for x in texts], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeat,
    }


@frees
def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_parts(batch):
            counts = measure(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([part["id"], part["host"], *map(pa.array, counts.values())], ["id", "host", *counts])


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """id, host and the counts of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return src.mapInArrow(_run, "id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, in whole. Every row is judged by its own text, also without an id or with one that another row has."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_failed(measure(part[text_col].to_pylist())))], [*part.schema.names, "_failed"])

    marked = docs.mapInArrow(run, T.StructType(list(docs.schema.fields)).add("_failed", T.BooleanType()))
    marked = materialize(marked, "marked")
    hosts = shrunk_rates(marked.select(F.col(host_col).cast("string").alias("host"), F.col("_failed").alias("failed")))
    bad = hosts.where(F.col("rate") >= host_limit).select(F.col("host").alias("_host"))
    out = marked.where(~F.col("_failed")).join(small(bad), F.col(host_col).cast("string").eqNullSafe(F.col("_host")), "left_anti")
    return out.select(*docs.columns)


def _failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PCT * n) | (100 * counts["n_symbols"] > MAX_SYMBOL_PCT * n)


def shrunk_rates(marked: DataFrame) -> DataFrame:
    """host, n, failed and rate: the mean of the posterior under a beta prior fitted by moments to all hosts' rates.

    ``marked`` has host and failed (boolean). Only one row of sums comes to the driver.
    """
    hosts = marked.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("n") * rate * rate).alias("square"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not row["k"]:
        return hosts.withColumn("rate", F.lit(None).cast("double"))
    mean = row["failed"] / row["n"]
    within = mean * (1 - mean)
    spread = max(0.0, row["square"] / row["n"] - mean * mean)
    # what sampling alone would spread the hosts' rates by; the rest is between hosts, and gives the prior its strength
    noise = within * row["k"] / row["n"]
    between = max(0.0, spread - noise)
    strength = within / between - 1 if between > 0 and within > between else 100.0
    strength = min(max(strength, 1.0), 1000.0)
    a, b = mean * strength, (1 - mean) * strength
    return hosts.withColumn("rate", (F.col("failed") + a) / (F.col("n") + (a + b)))


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """``id_col``, counts, base_failed, host_rate and kept of every document."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("n_words")
    found = materialize(features(docs, text_col, id_col, host_col).withColumn("base_failed", base).withColumn("failed", base | symbols), "quality")
    hosts = shrunk_rates(found).select(F.col("host").alias("own"), F.col("rate").alias("host_rate"))
    out = found.join(small(hosts), found["host"].eqNullSafe(hosts["own"]), "left")
    kept = ~F.col("failed") & ~F.coalesce(F.col("host_rate") >= host_limit, F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")
