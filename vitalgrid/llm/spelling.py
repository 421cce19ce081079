"""Grouping of spelling variants by Bloom-guided neighbourhoods.

The vocabulary is counted in one shuffle.  Its words go into blocked Bloom filters, one for each length of word; a word
looks up the words that one edit makes of it in the filter of their length.  What no filter holds is forgotten at once;
only positives are shuffled, to an exact join with the vocabulary that removes the false ones.

Being near is symmetric, so each pair is generated once: a deletion from its longer word, or a replacement of a letter by a
later one.  A word is hashed as a polynomial in an odd number modulo 2**64, so the hash of each edit follows from sums over
the parts before and after it, for all positions of many words and all letters at once.

Filters have ``BITS`` bits a word and are built in segments, each in one task from the words that fall into it.  At most
``FILTER_BYTES`` of them are broadcast at once; a larger vocabulary takes several rounds, in each of which all words are
looked up in the segments of the round.  Results do not depend on the number of rounds.

Edge cases: texts that are null, empty or without words add nothing; repeated rows count as often as they occur; a null id
is written as nothing in what is hashed; texts and words of any length are taken whole; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, frees, materialize, text_parts

#: Letters of a word, besides a-z and A-Z.
ACCENTED = "À-ÿ"
#: Fixed values of the method: bits a word, lookups of a word, bytes of filters that are broadcast at once, blocks of a segment.
BITS, PROBES, FILTER_BYTES, SEGMENT = 16, 5, 32 * 1024 * 1024, 2048
#: Bits of a block, and bytes.
BLOCK_BITS, BLOCK_BYTES = 512, 64
#: Edits that are hashed at once, and words counted before they are handed on.
EDITS, WORDS_HELD = 400_000, 300_000
#: Characters of a text that are searched at once.
PIECE = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


# words


def _pieces(text: str, letter: re.Pattern) -> Iterator[str]:
    """A text in pieces that end with a word's end."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and letter.match(text, end):
            end += 1
        yield text[at:end]
        at = end


def _counted(least: int, cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, letter = re.compile(f"[a-zA-Z{ACCENTED}]{{{least},}}"), re.compile(f"[a-zA-Z{ACCENTED}]")
        counts: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in text_parts(batch):
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    if text is None:
                        continue
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    own: Counter = Counter()
                    for piece in _pieces(text, letter):
                        own.update(word.findall(piece))
                    for found, n in own.items():
                        raw = found.encode().lower()  # only A-Z are changed
                        found, h = raw.decode(), zlib.crc32(raw, start)
                        if h % cut == 0:
                            at = h % len(found)
                            found = found[:at] + found[at + 1 :]
                            if len(found) < least:
                                continue
                        counts[found] += n
                    if len(counts) >= WORDS_HELD:
                        yield given()
        yield given()

    return run


def word_counts(documents: DataFrame, least: int = 7, cut: int = 31) -> DataFrame:
    """(word, n): runs of letters in lower case, a letter of which is deleted where ``cut`` divides the hash of id and run; words of ``least`` letters and more."""
    rows = documents.select("doc_id", "text").mapInArrow(frees(_counted(least, cut)), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


# hashes


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Flat:
    """Words as one array of letters, with the sums of a polynomial hash up to each letter."""

    def __init__(self, words: pa.Array):
        self.size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        text = "".join(words.to_pylist())
        self.letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.start = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.at = np.arange(len(self.letters)) - self.start[self.word]
        power = np.full(int(self.size.max(initial=0)) + 1, _ODD, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power)
        part = (self.letters.astype(np.uint64) + np.uint64(1)) * self.power[self.at]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        self.before = running[:-1] - running[self.start][self.word]  # of the letters ahead of each
        self.hash = running[self.start + self.size] - running[self.start]
        self.part = part


class Filters:
    """Where the words of each length lie: blocks of all lengths are numbered on from one another."""

    def __init__(self, counts: dict[int, int], bits: int = BITS):
        self.lengths = np.array(sorted(counts), np.int64)
        self.blocks = np.array([max(1, -(-counts[int(n)] * bits // BLOCK_BITS)) for n in self.lengths], np.uint64)
        self.first = (np.cumsum(self.blocks) - self.blocks).astype(np.int64)
        self.total = int(self.blocks.sum())

    def block(self, length: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Number of the block of each hash of a word of this length; -1 where no word has it."""
        if not len(self.lengths):
            return np.full(len(mixed), -1, np.int64)
        i = np.minimum(np.searchsorted(self.lengths, length), len(self.lengths) - 1)
        own = (((mixed >> np.uint64(32)) * self.blocks[i]) >> np.uint64(32)).astype(np.int64)
        return np.where(self.lengths[i] == length, self.first[i] + own, -1)


def _bits(mixed: np.ndarray) -> list[np.ndarray]:
    """Bits of a block that a word sets."""
    more = _mixed(mixed ^ _ODD)
    return [(mixed & np.uint64(BLOCK_BITS - 1)).astype(np.int64)] + [((more >> np.uint64(9 * k)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for k in range(PROBES - 1)]


def _placed(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = Flat(batch["word"])
            mixed = _mixed(flat.hash)
            block = filters.block(flat.size, mixed)
            segment, inside = block // SEGMENT, (block % SEGMENT) * BLOCK_BITS
            spots = np.stack([inside + b for b in _bits(mixed)], axis=1).astype(np.uint32)
            order = np.argsort(segment, kind="stable")
            ids, ends = np.unique(segment[order], return_index=True)
            groups = [g.tobytes() for g in np.split(spots[order], ends[1:])] if len(ids) else []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(groups, pa.binary())], names=["segment", "spots"])

    return run


def _built(total: int):
    def run(rows: pa.Table) -> pa.Table:
        segment = rows["segment"][0].as_py()
        bits = np.zeros(min(SEGMENT, total - segment * SEGMENT) * BLOCK_BITS, bool)
        for spots in rows["spots"]:
            bits[np.frombuffer(spots.as_buffer(), np.uint32)] = True
        return pa.table({"segment": pa.array([segment], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


def _holds(bits: np.ndarray, first: int, block: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Which hashes the filters hold: each lookup is made only for those that the one before has left."""
    left = np.flatnonzero((block >= first) & (block < first + len(bits) // BLOCK_BYTES))
    byte, spots = (block[left] - first) * BLOCK_BYTES, mixed[left]
    for k in range(PROBES):
        spot = ((spots >> np.uint64(9 * max(0, k - 1))) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
        there = (bits[byte + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 == 1
        left, byte, spots = left[there], byte[there], spots[there]
        if k == 0:
            spots = _mixed(spots ^ _ODD)
    return left


def _probed(filters: Filters, letters: np.ndarray, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, raw = shared.value
        bits = np.frombuffer(raw, np.uint8)
        for batch in batches:
            flat = Flat(batch["word"])
            words, n = batch["word"], batch["n"]
            kinds = [_deleted(flat, filters), _replaced(flat, filters, letters)]
            for word, at, new in (hit for kind in kinds for hit in kind(bits, first)):
                near = []
                for w, i, c in zip(words.take(pa.array(word)).to_pylist(), at.tolist(), new.tolist()):
                    near.append(w[:i] + (chr(c) if c else "") + w[i + 1 :])
                take = pa.array(word)
                yield pa.RecordBatch.from_arrays([words.take(take), n.take(take), pa.array(near, pa.string())], names=["word", "n", "near"])

    return run


def _deleted(flat: Flat, filters: Filters):
    """Words that a deletion makes: of equal letters in a row only the first is deleted."""
    same = np.zeros(len(flat.letters), bool)
    same[1:] = (flat.letters[1:] == flat.letters[:-1]) & (flat.word[1:] == flat.word[:-1])
    every = np.flatnonzero(~same)

    def run(bits: np.ndarray, first: int):
        for lo in range(0, len(every), EDITS):
            i = every[lo : lo + EDITS]
            after = flat.hash[flat.word[i]] - flat.before[i] - flat.part[i]
            mixed = _mixed(flat.before[i] + after * _BACK)
            hit = _holds(bits, first, filters.block(flat.size[flat.word[i]] - 1, mixed), mixed)
            yield flat.word[i[hit]], flat.at[i[hit]], np.zeros(len(hit), np.int64)

    return run


def _replaced(flat: Flat, filters: Filters, letters: np.ndarray):
    """Words that a later letter in place of one makes."""

    def run(bits: np.ndarray, first: int):
        step = max(1, EDITS // max(1, len(letters)))
        for lo in range(0, len(flat.letters), step):
            i = np.arange(lo, min(lo + step, len(flat.letters)))
            own = flat.letters[i]
            p, c = np.nonzero(letters[None, :] > own[:, None])
            if not len(p):
                continue
            i, new = i[p], letters[c]
            mixed = _mixed(flat.hash[flat.word[i]] + (new.astype(np.uint64) - flat.letters[i].astype(np.uint64)) * flat.power[flat.at[i]])
            hit = _holds(bits, first, filters.block(flat.size[flat.word[i]], mixed), mixed)
            yield flat.word[i[hit]], flat.at[i[hit]], new[hit].astype(np.int64)

    return run


# neighbours and groups


def _pair_tables(vocabulary: DataFrame, filter_bytes: int, bits: int) -> list[DataFrame]:
    """Each pair of near words once, a table a round."""
    spark = vocabulary.sparkSession
    counts = {r["size"]: r["count"] for r in vocabulary.groupBy(F.char_length("word").alias("size")).count().collect()}  # one row a length
    filters = Filters(counts, bits)
    letter = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct()
    letters = np.array(sorted(ord(r["c"]) for r in letter.collect() if r["c"]), np.uint32)  # an alphabet
    placed = vocabulary.select("word").mapInArrow(_placed(filters), "segment long, spots binary")
    segments = materialize(placed.groupBy("segment").applyInArrow(_built(filters.total), "segment long, bits binary"), "segments")
    of_round, n_segments = max(1, filter_bytes // (SEGMENT * BLOCK_BYTES)), -(-filters.total // SEGMENT)
    out = []
    for lo in range(0, n_segments, of_round):
        hi = min(lo + of_round, n_segments)
        own = {r["segment"]: r["bits"] for r in segments.where(F.col("segment").between(lo, hi - 1)).collect()}  # at most filter_bytes
        size = lambda s: min(SEGMENT, filters.total - s * SEGMENT) * BLOCK_BYTES
        shared = spark.sparkContext.broadcast((lo * SEGMENT, b"".join(own.get(s) or bytes(size(s)) for s in range(lo, hi))))
        hits = vocabulary.select("word", "n").mapInArrow(frees(_probed(filters, letters, shared)), "word string, n long, near string")
        exact = hits.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        out.append(materialize(exact.select("word", "n", "near", "near_n"), "pairs"))
        shared.destroy()
    discard(segments)
    return out


def _both_ways(tables: list[DataFrame], spark: SparkSession) -> DataFrame:
    pairs = reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], "word string, n long, near string, near_n long")
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.inline(F.array(F.struct("word", "n", "near", "near_n"), back)))


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES, bits: int = BITS) -> DataFrame:
    """(word, n, near, near_n): every pair of words of ``vocabulary`` (word, n) that differ by one edit, in both directions.

    ``vocabulary`` is read several times; write it first.
    """
    return _both_ways(_pair_tables(vocabulary, filter_bytes, bits), vocabulary.sparkSession)


def roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root) of (word, form): where the forms of each word end.

    A form is at least ``times`` as frequent as its word, so no path is longer than the logarithm of ``most``, the largest
    number; each step doubles the part of it that is known.
    """
    longest, reach, at = 0, times, 1
    while reach <= most:
        longest, reach = longest + 1, reach * times
    known, written = forms.select("word", F.col("form").alias("root")), None
    while at < longest:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = materialize(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        if written is not None:
            discard(written)
        written, at = known, at * 2
    return known


def group_variants(counts: DataFrame, n_least: int = 2, times: int = 10, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``counts`` (word, n) that occurs ``n_least`` times or more.

    form is the near word of largest n (of these the smallest by code points), if that n is ``times`` (2 or more) the word's
    or more.
    """
    vocabulary = materialize(counts.where(F.col("n") >= n_least).select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    tables = _pair_tables(vocabulary, filter_bytes, BITS)
    none = F.lit(None).cast("struct<less:bigint,near:string>")
    rows = vocabulary.select("word", "n", none.alias("best"), F.lit(0).alias("one"))
    pairs = _both_ways(tables, vocabulary.sparkSession).select("word", "n", F.struct((-F.col("near_n")).alias("less"), "near").alias("best"), F.lit(1).alias("one"))
    own = rows.unionByName(pairs).groupBy("word").agg(F.first("n").alias("n"), F.sum("one").cast("long").alias("n_near"), F.min("best").alias("best"))
    above = -F.col("best.less") >= times * F.col("n")
    own = materialize(own.select("word", F.when(above, F.col("best.near")).alias("form"), "n", "n_near", F.when(above, -F.col("best.less")).alias("form_n")), "near")
    discard(*tables, vocabulary)
    most = own.agg(F.max("n")).first()[0] or 0
    ends = roots(own.where("form is not null"), most, times)
    return own.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(documents: DataFrame, least: int = 7, n_least: int = 2, times: int = 10, cut: int = 31) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return group_variants(word_counts(documents, least, cut), n_least, times)
