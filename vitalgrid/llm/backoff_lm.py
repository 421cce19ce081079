"""Stupid-backoff language model scores, computed relationally.

Counts of 1- to n-grams of a training corpus are grouped by hash.  With S the backoff score of a word after its history,
log S is a sum that telescopes: a floor for every position, plus, for every order whose n-gram is known, the step from
the score of the shorter n-gram.  So the model is one table (n-gram hash, step), a document is its distinct n-grams with
their numbers, and scoring is one join on the hash and one sum per document, in whatever order rows come.

``cross_score`` scores a corpus by itself without letting a text vouch for itself: texts fall into two halves by hash, and
each half is scored by the counts of the other, so that what only one half says is backed off.  The fold is part of an
n-gram's hash; both models are one table, built and joined once.

``score_corpus`` leaves no text out.  Then every n-gram is known, and the score of a text is a sum of logs of counts with
whole coefficients.  Its n-grams cross one exchange: a batch of texts sends one row of arrays to each bucket of hashes,
which is unpacked where it arrives; there a window by hash gives the counts, and what n-grams add to their texts is summed
by text.  N-grams that occur once add nothing and go no further.

Before the join (or that exchange), steps (or counts) of the most frequent n-grams (HEAD at most, a fixed number) are looked
up in a broadcast table, which also takes the hot keys out of it; before the join, n-grams that a Bloom filter of fixed size
shows to be unknown are left out, as they add nothing.

Edge cases: null or empty text has no words, n_words 0 and a null score; n-grams never cross texts; very long texts are
taken whole; with an empty training corpus every word gets the floor; an empty table gives an empty result; extra columns
are ignored.  There is one row for each row, also for repeated rows, rows of one id and those without an id, all of which
are counted; rows are told apart by their place in a partition, so the input should come from files.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frees, materialize, raw_texts, small, text_parts
from .ngram_join import _mix, _word_codes

#: Order of the model, factor of a backoff, least count of an n-gram that is kept.
ORDER, BACKOFF, MIN_COUNT = 2, 0.4, 1
#: Entries of the broadcast table and bits of the Bloom filter (2 MB and 8 MB), whatever the size of the corpus.
HEAD, BLOOM_BITS = 1 << 17, 1 << 26
#: Texts in which n-grams of several words are looked for that may be among the most frequent; results do not depend on them.
LOOKED_AT = 10_000
#: n-grams of an order that a task brings together before it sends their counts.
GRAMS = 1_000_000
#: Steps are whole numbers of this fraction, so that sums do not depend on the order of rows.
UNIT = 1e-6
#: Words, the most frequent ones, whose counts are broadcast (12 MB); those of others are joined.
WORDS = 1 << 19
#: n-grams of a bucket of hashes, on average.
BUCKET = 1_000_000
#: The bit of a hash that tells the fold.
FOLD = np.uint64(8)
#: Characters, and texts, worked on at once.
CHARS, PART_TEXTS = 1_000_000, 30_000


def folds_of(texts: list[bytes | None]) -> np.ndarray:
    """0 or 1 for each text, by what it says: equal texts lie in one fold."""
    return np.fromiter((zlib.crc32(x) & 1 if x else 0 for x in texts), np.uint64, len(texts))


def text_ngrams(texts: list[str | bytes | None], order: int, folds: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each n from 1 to ``order``: hashes of all n-grams and the text they stand in; and the words of each text.

    The last three bits of a hash tell n, the fourth the fold (0, or that given for the text): n-grams of one fold are other
    n-grams than those of the other.
    """
    words = [x.split() if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass").split() if isinstance(x, str) else [] for x in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    codes = _word_codes([w for own in words for w in own])
    doc = np.repeat(np.arange(len(words)), n_words)
    factor = np.uint64(0xFF51AFD7ED558CCD)
    hashes, docs = [], []
    for n in range(1, order + 1):
        h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for i in range(n):
            h = h * factor + codes[i : len(codes) - n + 1 + i]
        inside = doc[: len(h)] == doc[n - 1 :][: len(h)]
        docs.append(doc[: len(h)][inside])
        own = np.uint64(0) if folds is None else folds[docs[-1]] << np.uint64(3)
        hashes.append((_mix(h[inside]) & ~np.uint64(15)) | own | np.uint64(n))
    return hashes, docs, n_words


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each h stands in the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _count(order: int, chosen=None, folded: bool = False):
    """(h, count): the distinct n-grams of as many texts as GRAMS allows; of those of several words only the chosen ones, if given."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]

        def flush() -> Iterator[pa.RecordBatch]:
            for own in held:
                if own:
                    uniq, count = np.unique(np.concatenate(own), return_counts=True)
                    own.clear()
                    for k in range(0, len(uniq), 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(uniq[k : k + 200_000].view(np.int64)), pa.array(count[k : k + 200_000], pa.int32())], ["h", "count"])

        for part in (part for batch in batches for part in text_parts(batch, size=CHARS, rows=PART_TEXTS)):
            texts = raw_texts(part)
            for n, h in enumerate(text_ngrams(texts, order, folds_of(texts) if folded else None)[0]):
                held[n].append(h if chosen is None or not n else h[_find(chosen.value, (h & ~FOLD).view(np.int64))[1]])
            if sum(map(len, held[0])) > GRAMS:
                yield from flush()
        yield from flush()

    return run


def _grams(order: int, folded: bool):
    """(h, before, after, count): the distinct n-grams of as many texts as GRAMS allows, each with itself less its last and
    less its first word (0 for a single word)."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(order)]

        def flush() -> Iterator[pa.RecordBatch]:
            for own in held:
                if own:
                    h, before, after = map(np.concatenate, zip(*own))
                    own.clear()
                    uniq, at, count = np.unique(h, return_index=True, return_counts=True)
                    for k in range(0, len(uniq), 200_000):
                        cut = slice(k, k + 200_000)
                        columns = [pa.array(x.view(np.int64)) for x in (uniq[cut], before[at[cut]], after[at[cut]])]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(count[cut], pa.int32())], ["h", "before", "after", "count"])

        for part in (part for batch in batches for part in text_parts(batch, size=CHARS, rows=PART_TEXTS)):
            texts = raw_texts(part)
            hashes, docs, _ = text_ngrams(texts, order, folds_of(texts) if folded else None)
            some = np.arange(len(texts))
            for n, h in enumerate(hashes):
                if n:  # a text has one n-gram less with each order, which shifts those of the texts after it
                    shift = np.searchsorted(docs[n - 1], some) - np.searchsorted(docs[n], some)
                    place = np.arange(len(h)) + shift[docs[n]]
                    held[n].append((h, hashes[n - 1][place], hashes[n - 1][place + 1]))
                else:
                    held[n].append((h, np.zeros_like(h), np.zeros_like(h)))
            if sum(len(x[0]) for x in held[0]) > GRAMS:
                yield from flush()
        yield from flush()

    return run


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> tuple[DataFrame, int]:
    """The table (h, step, count) of the corpus, and the floor of a word in UNITs."""
    table, floors = _train(docs, text_col, order, backoff, min_count, False)
    return table, floors[0]


def _train(docs: DataFrame, text_col: str, order: int, backoff: float, min_count: int, folded: bool) -> tuple[DataFrame, list[int]]:
    """One model, or one of each fold: an n-gram's hash tells its fold, so that both are one table. And the floors of both."""
    src = docs.select(F.col(text_col).alias("text")).where("text is not null")
    # dealt out first: tasks send each n-gram about once, so that adding up before would only take memory
    grams = src.mapInArrow(_grams(order, folded), "h long, before long, after long, count int").repartition("h")
    counts = grams.groupBy("h").agg(F.min("before").alias("before"), F.min("after").alias("after"), F.sum("count").alias("count"))
    counts = materialize(counts.where(F.col("count") >= min_count).withColumn("n", F.pmod("h", F.lit(8)).cast("int")), "ngrams")
    fold = F.pmod(F.shiftright("h", 3), F.lit(2)).cast("int")
    words = {r["fold"]: r["words"] for r in counts.where("n = 1").groupBy(fold.alias("fold")).agg(F.sum("count").alias("words")).collect()}  # two rows at most
    total = [max(1, words.get(f, 0)) for f in (0, 1)]
    # an unknown word scores as one half as frequent as the rarest known one
    unknown = [math.log(min_count / (2 * x)) for x in total]
    of_fold = lambda x: F.when(fold == 0, F.lit(float(x[0]))).otherwise(F.lit(float(x[1])))
    known = counts.where("n = 1").select("h", "count", F.log(F.col("count") / of_fold(total)).alias("score"))
    table = known.withColumn("lower", of_fold(unknown))
    levels = []
    for n in range(2, order + 1):
        own = counts.where(F.col("n") == n).join(small(known.select(F.col("h").alias("before"), F.col("count").alias("base"))), "before")
        own = own.join(small(known.select(F.col("h").alias("after"), F.col("score").alias("shorter"))), "after")
        own = own.select("h", "count", F.log(F.col("count") / F.col("base")).alias("score"), (F.col("shorter") + math.log(backoff)).alias("lower"))
        if n < order:
            own = materialize(own, "level")
            levels.append(own)
        table, known = table.unionByName(own), own.select("h", "count", "score")
    table = materialize(table.select("h", F.round((F.col("score") - F.col("lower")) / UNIT).cast("long").alias("step"), "count"), "model")
    discard(counts, *levels)
    return table, [round(x / UNIT) for x in unknown]


def _bloom_cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return ((u >> np.uint64(4)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64), ((u >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _bloom_cells(h)
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _bloom(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits, found = np.zeros(BLOOM_BITS, bool), False
    for pdf in frames:
        found |= len(pdf) > 0
        for cell in _bloom_cells(pdf["h"].to_numpy(np.int64)):
            bits[cell] = True
    if found:
        yield pd.DataFrame({"bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _either(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for pdf in frames:
        for x in pdf["bits"]:
            bits |= np.frombuffer(x, np.uint8)
    yield pd.DataFrame({"bits": [bits.tobytes()]})


def _filter_of(grams: DataFrame):
    """A Bloom filter of the n-grams, broadcast; of fixed size, it lets more through as the corpus grows and never loses one."""
    found = grams.select("h").coalesce(16).mapInPandas(_bloom, "bits binary").coalesce(1).mapInPandas(_either, "bits binary").first()
    return grams.sparkSession.sparkContext.broadcast(bytes(found["bits"]) if found else bytes(BLOOM_BITS // 8))


def _explode(order: int, back: int, floors: list[int], folded: bool, head, bloom):
    """(row, h, times, value): n-grams of a text (one row of the table) to be looked up, each with its times.

    Three more entries of each text, under any h, hold its id (times -2), its words (-1) and what needs no looking up (0).
    With folds a text asks for n-grams of the other fold.
    """

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, steps = head.value
        bits = np.frombuffer(bloom.value, np.uint8)
        row = TaskContext.get().partitionId() << 40
        for part in (part for batch in batches for part in text_parts(batch, size=CHARS, rows=PART_TEXTS)):
            texts = raw_texts(part)
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            other = folds_of(texts) ^ np.uint64(1) if folded else np.zeros(len(texts), np.uint64)
            hashes, docs, n_words = text_ngrams(texts, order, other)
            known = n_words * np.array(floors)[other.astype(np.int64)]
            # every place that has a history of n-1 words backs off from order n, unless that n-gram's step takes it back
            for d in docs[1:]:
                known += np.bincount(d, minlength=len(texts)) * back
            for h, d in zip(hashes, docs):
                h = h.view(np.int64)
                at, hit = _find(keys, h)
                np.add.at(known, d[hit], steps[at[hit]])
                keep = ~hit
                keep[keep] = _passes(bits, h[keep])
                h, d = h[keep], d[keep]
                by = np.lexsort((h, d))
                h, d = h[by], d[by]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.empty(0, np.int64)
                times = np.diff(np.r_[first, len(h)])
                yield pa.RecordBatch.from_arrays([pa.array(rows[d[first]]), pa.array(h[first]), pa.array(times, pa.int32()), pa.nulls(len(first), pa.int64())], _ASKED)
            anywhere = pa.array(_mix(rows.view(np.uint64)).view(np.int64))
            for times, value in ((-2, part["id"]), (-1, pa.array(n_words)), (0, pa.array(known))):
                yield pa.RecordBatch.from_arrays([pa.array(rows), anywhere, pa.array(np.full(len(rows), times), pa.int32()), value], _ASKED)

    return run


_ASKED = ["row", "h", "times", "value"]


def _most_frequent(counts: DataFrame, value: str, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """h, in order, and ``value`` of the n-grams of largest count: whole levels of counts, ``limit`` entries at most (HEAD if not given)."""
    level = F.floor(F.log2(F.col("count").cast("double")) * 16)
    least, held = None, 0
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # a thousand levels at most
        held += row["n"]
        if held > (HEAD if limit is None else limit):
            break
        least = row["level"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    top = counts.where(level >= least).select("h", F.col(value).alias("value")).toPandas().sort_values("h")
    return top["h"].to_numpy(np.int64), top["value"].to_numpy(np.int64)


def score(docs: DataFrame, model: DataFrame, floor: int, text_col: str = "text", id_col: str = "doc_id", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """``id_col``, n_words and log_score (mean natural logarithm of the stupid-backoff score of a word): one row for each row of ``docs``."""
    return _score(docs, model, [floor, floor], text_col, id_col, order, backoff, False)


def _score(docs: DataFrame, model: DataFrame, floors: list[int], text_col: str, id_col: str, order: int, backoff: float, folded: bool) -> DataFrame:
    head = docs.sparkSession.sparkContext.broadcast(_most_frequent(model, "step"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = src.mapInArrow(_explode(order, round(math.log(backoff) / UNIT), floors, folded, head, _filter_of(model)), "row long, h long, times int, value long")
    found = asked.join(model.select("h", "step"), "h", "left")
    steps = F.when(F.col("times") > 0, F.col("step") * F.col("times")).when(F.col("times") == 0, F.col("value"))
    of = lambda times: F.max(F.when(F.col("times") == times, F.col("value")))
    out = found.where("times <= 0 or step is not null").groupBy("row").agg(of(-2).alias("id"), of(-1).alias("n_words"), F.sum(steps).alias("steps"))
    return out.select(F.col("id").alias(id_col), "n_words", F.when(F.col("n_words") > 0, F.col("steps") / F.col("n_words") * UNIT).alias("log_score"))


def cross_score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """As ``score``, each text under the model of the other half of ``docs``: halves go by hash of the text, so that neither a text nor an exact copy is scored by itself."""
    if order == 2 and min_count == 1:
        return _cross_pairs(docs, text_col, id_col, backoff)
    model, floors = _train(docs, text_col, order, backoff, min_count, True)
    return _score(docs, model, floors, text_col, id_col, order, backoff, True)


class _Words:
    """Logs in UNITs of the counts of the most frequent words in both folds; a pair of words has a step where it is known."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, backoff: float) -> None:
        self.keys = keys
        self.history, self.total = _log(counts), _log(np.maximum(1, totals))
        # an unknown word scores as one half as frequent as the rarest known one
        self.unknown = _log(0.5 / np.maximum(1, totals))
        self.single = np.where(counts > 0, self.history - self.total[:, None], self.unknown[:, None])
        self.back = round(math.log(backoff) / UNIT)

    def steps(self, fold: np.ndarray, before: np.ndarray, after: np.ndarray, count: np.ndarray) -> np.ndarray:
        step = _log(count) - self.history[fold, before] - self.back - self.single[fold, after]
        return np.where(count > 0, step, 0)


def _log(x: np.ndarray) -> np.ndarray:
    """Natural logarithm in UNITs, of zero 0."""
    return np.rint(np.log(np.where(x > 0, x, 1)) / UNIT).astype(np.int64)


def _deal_pairs(words, head, buckets: int):
    """One row per batch of texts and bucket: what of each text has to be counted, the text's place in the batch and its times,
    below zero in fold 1. Pairs of the head table are settled here.

    Pairs with a rarer word come to the bucket of that word, and of their first word if both are.
    A pair of frequent words is their two numbers. Other pairs, and other single words, are hashes below zero; ``parts`` holds
    for each such pair both words: eight times the number of a frequent one, the hash of another.
    Buckets below zero hold three entries of each text: what needs no other count (times 0), its words (1) and its id (2).
    """
    shift, below = np.uint64(64 - buckets.bit_length() + 1), np.uint64(1 << 63)
    low = np.int64(-1 << 63)

    def row(bucket: np.ndarray, batch: int, ends: np.ndarray, h: pa.Array, place: np.ndarray, times: np.ndarray, part_ends: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), batch), pa.int64())]
        columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (h, pa.array(place, pa.int16()), pa.array(times, pa.int32()))]
        columns += [pa.ListArray.from_arrays(pa.array(part_ends, pa.int32()), pa.array(parts, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "batch", "h", "place", "times", "parts"])

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, (keys, counts) = words.value, head.value
        batch = TaskContext.get().partitionId() << 24  # a key of batch and place leaves as many bits for the partition
        for own in (own for frame in batches for own in text_parts(frame, size=CHARS, rows=PART_TEXTS)):
            batch += 1
            texts = raw_texts(own)
            fold = folds_of(texts).astype(np.int64)
            (one, two), (in_one, in_two), n_words = text_ngrams(texts, 2)
            at, found = _find(known.keys, one.view(np.int64))
            sums = np.bincount(in_two, minlength=len(texts)) * known.back
            np.add.at(sums, in_one[found], known.single[1 - fold[in_one[found]], at[found]])
            np.add.at(sums, in_one[~found], known.unknown[1 - fold[in_one[~found]]])
            # a text has one pair less than words, which shifts those of the texts after it
            place = np.arange(len(two)) + in_two - np.searchsorted(np.flatnonzero(n_words == 0), in_two)
            i, hit = _find(keys, two.view(np.int64))
            frequent = found[place] & found[place + 1]
            hit &= frequent
            of, other = in_two[hit], 1 - fold[in_two[hit]]
            if len(of):
                np.add.at(sums, of, known.steps(other, at[place[hit]], at[place[hit] + 1], counts[other, i[hit]]))
            word = np.where(found, at << 3, one.view(np.int64))
            place, frequent, two, in_two = place[~hit], frequent[~hit], two[~hit], in_two[~hit]
            pairs = np.where(frequent, (at[place] << 32) | at[place + 1] if len(at) else 0, (two | below).view(np.int64))
            h, d = np.concatenate([pairs, (one[~found] | below).view(np.int64)]), np.concatenate([in_two, in_one[~found]])
            parts = np.zeros((len(h), 2), np.int64)
            parts[: len(place)] = np.stack([word[place], word[place + 1]], axis=1)
            # a pair with a rarer word comes to the bucket of that word, the first of two, where the word itself is counted
            at_word = h.copy()
            at_word[: len(place)] = np.where(found[place], pairs, word[place] | low)
            second = np.flatnonzero(found[place] & ~found[place + 1])
            at_word[second] = word[place[second] + 1] | low
            bucket = (_mix(at_word.view(np.uint64)) >> shift).astype(np.int32)
            by = np.lexsort((h, d, bucket))
            h, d, bucket, parts = h[by], d[by], bucket[by], parts[by]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.empty(0, np.int64)
            times = np.diff(np.r_[first, len(h)])
            h, d, bucket, parts = h[first], d[first], bucket[first], parts[first]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else np.empty(0, np.int64)
            ends, rare = np.r_[cut, len(h)], _rare_pairs(h)
            yield row(bucket[cut], batch, ends, pa.array(h), d, np.where(fold[d] > 0, -times, times), 2 * np.r_[0, np.cumsum(rare)][ends], parts[rare].ravel())
            facts = pa.concat_arrays([pa.array(sums), pa.array(n_words), own["id"]])
            yield row(np.array([-1 - batch % buckets]), batch, np.array([0, len(facts)]), facts, np.tile(np.arange(len(texts)), 3), np.repeat([0, 1, 2], len(texts)), np.array([0, 0]), np.empty(0))

    return run


def _rare_pairs(h: np.ndarray) -> np.ndarray:
    return (h < 0) & ((h & 7) == 2)


_ADDED = {"batch": pa.int64(), "place": pa.int16(), "kind": pa.int32(), "value": pa.int64(), "word": pa.int64()}


def _settle_pairs(words):
    """(batch, place, kind, value, word) from the rows of a bucket: what is added to a text (kind 0), each pair by its count in
    the other fold; and for pairs of two rarer words how often the log of a word's count that another bucket has is added, in fold 0
    (kind 3) or 1 (kind 4)."""

    def run(rows: pa.Table) -> pa.Table:
        known = words.value
        h, place, times, parts = (rows[c].combine_chunks().flatten() for c in ("h", "place", "times", "parts"))
        batch = np.repeat(rows["batch"].to_numpy(), pc.list_value_length(rows["h"]).to_numpy())
        if rows["bucket"][0].as_py() < 0:
            return pa.table([pa.array(batch), place, times, h, pa.nulls(len(h), pa.int64())], schema=pa.schema(_ADDED))
        h, place, times = h.to_numpy(), place.to_numpy(), times.to_numpy().astype(np.int64)
        part = np.cumsum(_rare_pairs(h)) - 1  # where the words of a rare pair stand
        parts = parts.to_numpy().reshape(-1, 2)
        by = np.argsort(h, kind="stable")
        h, key, times, part = h[by], (batch[by] << 15) | place[by], times[by], part[by]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        counts = np.stack([np.add.reduceat(np.maximum(times, 0), first), np.add.reduceat(np.maximum(-times, 0), first)])
        uniq = h[first]
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
        other = (times > 0).astype(np.int64)
        count, times = counts[other, of], np.abs(times)
        some = count > 0
        h, key, times, part, other, count = h[some], key[some], times[some], part[some], other[some], count[some]
        value = np.zeros(len(h), np.int64)
        pair, rare = h >= 0, _rare_pairs(h)
        single = ~pair & ~rare
        value[pair] = known.steps(other[pair], h[pair] >> 32, h[pair] & 0xFFFFFFFF, count[pair])
        value[single] = _log(count[single]) - known.total[other[single]] - known.unknown[other[single]]
        value[rare] = _log(count[rare]) - known.back + known.total[other[rare]]
        asked = []
        for place_in_pair in (0, 1):
            at = np.flatnonzero(rare)
            word = parts[part[at], place_in_pair]
            frequent = (word & 7) == 0
            value[at[frequent]] -= known.history[other[at[frequent]], word[frequent] >> 3]
            at, word = at[~frequent], word[~frequent]
            i, here = _find(uniq, word | np.int64(-1 << 63))  # all of a word are in its bucket
            value[at[here]] -= _log(counts[other[at[here]], i[here]])
            asked.append((at[~here], word[~here]))
        # what comes to one bucket of one text is handed on as one
        keys, at = np.unique(key, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, value * times)
        at, word = (np.concatenate(x) for x in zip(*asked))
        keys, kind = np.r_[keys, key[at]], np.r_[np.zeros(len(keys), np.int64), 3 + other[at]]
        word = pa.concat_arrays([pa.nulls(len(sums), pa.int64()), pa.array(word)])
        return pa.table([pa.array(keys >> 15), pa.array((keys & 0x7FFF).astype(np.int16)), pa.array(kind, pa.int32()), pa.array(np.r_[sums, -times[at]]), word], schema=pa.schema(_ADDED))

    return run


def _cross_pairs(docs: DataFrame, text_col: str, id_col: str, backoff: float) -> DataFrame:
    """``cross_score`` for pairs of words.

    Every pair of a text goes to the bucket of its hash once, where the pairs of both folds are counted and each is joined to
    its count in the other one: the corpus is model and query at once. A pair that is known takes back the backoff of its
    place, for which the counts of its words are needed: those of frequent words are broadcast, that of one rarer word is there
    in the bucket, and only where both are rarer that of the second may have to be joined.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = src.select("text").where("text is not null")
    order = F.pmod("h", F.lit(8))
    some = texts.sample(min(1.0, LOOKED_AT / max(1, docs.count())), 1).mapInArrow(_count(2), "h long, count int").where(order > 1)
    some = materialize(some.groupBy("h").agg(F.sum("count").alias("count")).where("count > 1"), "tried")
    chosen = spark.sparkContext.broadcast(_most_frequent(some, "count")[0])
    counts = texts.mapInArrow(_count(2, chosen, True), "h long, count int")
    even = F.when(F.col("h").bitwiseAND(8) == 0, F.col("count")).otherwise(0)
    counts = materialize(counts.groupBy(F.col("h").bitwiseAND(~8).alias("h")).agg(F.sum("count").alias("count"), F.sum(even).alias("even")), "ngrams")
    singles, pairs = counts.where(order == 1), counts.where(order == 2)
    total, in_even = singles.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("even"), F.lit(0))).first()

    def top(rows: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
        (keys, count), (_, even) = _most_frequent(rows, "count", limit), _most_frequent(rows, "even", limit)
        return keys, np.stack([even, count - even])

    words = spark.sparkContext.broadcast(_Words(*top(singles, WORDS), np.array([in_even, total - in_even]), backoff))
    head = spark.sparkContext.broadcast(top(pairs, HEAD))
    discard(some)
    buckets = 1 << max(255, total // BUCKET).bit_length()
    dealt = src.mapInArrow(_deal_pairs(words, head, buckets), "bucket int, batch long, h array<long>, place array<short>, times array<int>, parts array<long>")
    added = materialize(dealt.groupBy("bucket").applyInArrow(_settle_pairs(words), "batch long, place short, kind int, value long, word long"), "added")
    in_fold = F.when(F.col("kind") == 3, F.col("even")).otherwise(F.col("count") - F.col("even"))
    rare = added.where("kind >= 3").join(singles.withColumnRenamed("h", "word"), "word")
    rare = rare.select("batch", "place", F.lit(0).alias("kind"), (F.col("value") * F.round(F.log(in_fold.cast("double")) / UNIT).cast("long")).alias("value"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    out = added.where("kind < 3").drop("word").unionByName(rare).groupBy("batch", "place").agg(F.max(of(2)).alias("id"), F.max(of(1)).alias("n_words"), F.sum(of(0)).alias("steps"))
    return out.select(F.col("id").alias(id_col), "n_words", F.when(F.col("n_words") > 0, F.col("steps") / F.col("n_words") * UNIT).alias("log_score"))


def _coefficients(docs: list[np.ndarray], n_words: np.ndarray) -> list[np.ndarray]:
    """How often the log of an n-gram's count is added to the score of its text, all n-grams being known, for each order and place."""
    order, some = len(docs), np.arange(len(n_words))
    out = [np.zeros(len(d), np.int64) for d in docs]
    out[-1][:] = 1
    for n in range(1, order):  # texts too short for the full order end on their only n-gram
        out[n - 1][np.searchsorted(docs[n - 1], some[n_words == n])] = 1
    if order > 1:  # a history is taken off for each word after it; the words that lead a text come to their last n-gram
        longer = some[n_words >= order]
        own = np.where((n_words >= order)[docs[-2]], -1, out[-2])
        own[np.searchsorted(docs[-2], longer, "right") - 1] += 1
        own[np.searchsorted(docs[-2], longer)] += 1
        out[-2] = own
    return out


def _deal(order: int, log_total: int, head, buckets: int):
    """One row per batch of texts and bucket of hashes, with arrays: of each n-gram of a text that the head table does not
    hold its hash, the text's place in the batch, its times and its coefficient.

    Buckets below zero hold two entries of each text: its id (times 0) with what the head table gives, and (times -1) its words.
    """
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def lists(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    @frees
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, logs = head.value
        batch = TaskContext.get().partitionId() << 32
        for frame in frames:
            for own in text_parts(frame, size=CHARS, rows=PART_TEXTS):
                batch += 1
                n_texts = own.num_rows
                hashes, docs, n_words = text_ngrams(raw_texts(own), order)
                coef = np.concatenate(_coefficients(docs, n_words))
                h, d = np.concatenate(hashes).view(np.int64), np.concatenate(docs)
                at, hit = _find(keys, h)
                known = -log_total * (n_words if order == 1 else np.minimum(n_words, 1))
                if len(keys):
                    np.add.at(known, d[hit], coef[hit] * logs[at[hit]])
                h, d, coef = h[~hit].view(np.uint64), d[~hit], coef[~hit]
                by = np.argsort(h, kind="stable")  # texts are in order already
                h, d, coef = h[by], d[by], coef[by]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.empty(0, np.int64)
                times = np.diff(np.r_[first, len(h)])
                coef = np.add.reduceat(coef, first) if len(h) else coef
                h, d = h[first], d[first]
                bucket = (h >> shift).astype(np.int32)
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else np.empty(0, np.int64)
                ends = np.r_[cut, len(h)].astype(np.int32)
                grams = [pa.array(bucket[cut], pa.int32()), pa.array(np.full(len(cut), batch), pa.int64())]
                grams += [lists(pa.array(x, t), ends) for x, t in zip((h.view(np.int64), d, times, coef), _TYPES)]
                yield pa.RecordBatch.from_arrays(grams, _NAMES)
                ids = pa.concat_arrays([own["id"], own["id"]])
                place = np.tile(np.arange(n_texts), 2)
                texts = [pa.array([-1 - batch % buckets], pa.int32()), pa.array([batch], pa.int64())]
                texts += [lists(x, np.array([0, 2 * n_texts])) for x in (ids, pa.array(place, _TYPES[1]), pa.array(np.repeat([0, -1], n_texts), _TYPES[2]), pa.array(np.r_[known, n_words], _TYPES[3]))]
                yield pa.RecordBatch.from_arrays(texts, _NAMES)

    return run


_NAMES, _TYPES = ["bucket", "batch", "h", "place", "times", "coef"], [pa.int64(), pa.int16(), pa.int32(), pa.int64()]


def score_corpus(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", order: int = ORDER) -> DataFrame:
    """What ``score`` gives with a model of all n-grams of ``docs`` themselves: one row for each row of ``docs``."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = src.select("text").where("text is not null")
    some = texts.sample(min(1.0, LOOKED_AT / max(1, docs.count())), 1).mapInArrow(_count(order), "h long, count int").where(F.pmod("h", F.lit(8)) > 1)
    some = materialize(some.groupBy("h").agg(F.sum("count").alias("count")).where("count > 1"), "tried")
    chosen = spark.sparkContext.broadcast(_most_frequent(some, "count")[0])
    discard(some)
    counts = texts.mapInArrow(_count(order, chosen), "h long, count int").groupBy("h").agg(F.sum("count").alias("count"))
    counts = materialize(counts, "ngrams")
    total = max(1, counts.where(F.pmod("h", F.lit(8)) == 1).agg(F.sum("count")).first()[0] or 0)
    log = F.round(F.log(F.col("count").cast("double")) / UNIT).cast("long")
    head = spark.sparkContext.broadcast(_most_frequent(counts.withColumn("log", log), "log"))
    discard(counts)
    # enough buckets for an even deal; a bucket's rows are unpacked and counted where they arrive, with no other exchange
    buckets = 1 << max(10, (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    dealt = src.mapInArrow(_deal(order, round(math.log(total) / UNIT), head, buckets), "bucket int, batch long, h array<long>, place array<short>, times array<int>, coef array<long>")
    grams = dealt.repartition("bucket").select("bucket", "batch", "place", "times", "coef", F.posexplode("h").alias("at", "h"))
    grams = grams.select("bucket", "h", "batch", F.get("place", "at").alias("place"), F.get("times", "at").alias("times"), F.get("coef", "at").alias("coef"))
    grams = grams.withColumn("count", F.expr("sum(times) over (partition by h, bucket)"))
    # the log of one adds nothing
    own, steps = F.col("bucket") < 0, F.when(F.col("times") == 0, F.col("coef")).when(F.col("times") > 0, F.col("coef") * log)
    out = grams.where(own | (F.col("count") > 1)).groupBy("batch", "place").agg(F.max(F.when(own, F.col("h"))).alias("id"), F.sum(F.when(F.col("times") == -1, F.col("coef"))).alias("n_words"), F.sum(steps).alias("steps"))
    mean = F.when(F.col("n_words") > 0, F.col("steps") / F.col("n_words") * UNIT)
    return out.select(F.col("id").alias(id_col), "n_words", mean.alias("log_score"))
