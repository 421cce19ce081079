"""Exact similarity join of documents on word shingles, by T-occurrence search.

1. Documents of equal shingle sets form a class; one representative of each goes on.
2. Most documents are told apart from all others by counting.  All shingles whose code lies in the lowest part of the
   range are dealt out (a part that every possible partner deals out too); a document whose partner lacks at most d of
   its shingles shares all but d of them, so documents with fewer shared ones go, and shared with those that are left is
   counted again.  Shingles that a fixed-size counting sketch of all data shows to be frequent are taken as shared.
3. Two linked sets share a shingle among the first few of each in a common order (prefix filter; frequent ones come
   last), so what is left is dealt out by those shingles.  In a group, a document searches the inverted lists of the
   others with DivideSkip: short lists are merged with a heap, long ones are probed by bisection, and documents reaching
   the required overlap are links.
4. A first round over two groups of each document joins most copies; the second goes over all groups that still hold
   documents of different components, and is what makes the result exact.  Groups are also split by size, since linked
   sets are of similar size.  Groups that hang together are searched as one; what is more than a task should hold is
   dealt out in blocks, and every two blocks meet in a task, so that no task's memory grows with a group.

Edge cases: null text and text without words have the empty set, which links with nothing; repeated rows and equal
texts share a component; very long texts are taken whole; an empty table gives an empty result; extra columns are
ignored; rows without an id take no part in links, and have a null component; ids are taken to name one text: rows of one
id with different texts have the links of either.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frees, materialize, raw_texts, small, text_parts
from .components import components

#: Words of a shingle, and the similarity that links two documents, in per cent.
SHINGLE, PERCENT = 4, 85
#: Counters in each of the two rows of the sketch: a fixed 1 MB whatever the size of the corpus.
COUNTERS = 1 << 16
#: Shingles of a group of the first round; larger groups are split, and what that parts is found in the second round.
GROUP_SHINGLES = 300_000
#: Shingles of a block of documents that a task of the second round searches, against itself or another block.
BLOCK_SHINGLES = 1_500_000
#: Copies that a task remembers, so that it sends them once.
REMEMBERED = 200_000
#: Share of long lists in DivideSkip.
MU = 0.01
#: Instead of a number of shingles: the row by which a document stays that cannot be ruled out by counting.
MARK = -1
#: Times that documents without enough shared shingles are looked for.
PRUNINGS = 2


class _Codes(dict):
    """64-bit codes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def _word_codes(words: list[bytes]) -> np.ndarray:
    if len(_CODES) > 200_000:
        _CODES.clear()
    return np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | bytes | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Of each text, the sorted 64-bit codes of its distinct k-word shingles, A-Z in lower case."""
    words = [(x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x).lower().split() if x else [] for x in texts]
    c = _word_codes([w for own in words for w in own])
    factor = np.uint64(0x9E3779B97F4A7C15)
    h = np.full(max(0, len(c) - k + 1), k, np.uint64)
    for i in range(k):
        h = h * factor + c[i : len(c) - k + 1 + i]
    h = _mix(h)
    out, at = [], 0
    for own in words:
        n = len(own)
        if n >= k:
            out.append(np.unique(h[at : at + n - k + 1]))
        elif n:  # the whole sequence is one shingle
            short = np.full(1, n, np.uint64)
            for i in range(n):
                short = short * factor + c[at + i : at + i + 1]
            out.append(_mix(short))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (codes & np.uint64(COUNTERS - 1)).astype(np.int64), ((codes >> np.uint64(20)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def frequent(counts: np.ndarray) -> np.ndarray:
    """Which counters of a sketch stand out from the noise of their row."""
    mid = np.median(counts, axis=1, keepdims=True)
    return counts > mid + 6 * np.sqrt(mid) + 50


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def ordered(codes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The set with frequent shingles last, else by code."""
    a, b = _cells(codes)
    late = often[0][a] & often[1][b]
    return np.concatenate([codes[~late], codes[late]])


def _key(codes: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(codes.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def size_class(n: int, percent: int = PERCENT) -> int:
    """Sets that can be linked are of equal or neighbouring classes."""
    return int(math.log(n) / -math.log(percent / 100) + 1e-9)


def dealt_part(c: int, percent: int = PERCENT) -> float:
    """Part of the range of codes that documents of size class c deal out; smaller for larger ones."""
    return min(1.0, (1 - percent / 100) + 0.03 + 2 * (percent / 100) ** (c / 2))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _long(x) -> pa.Array:
    return pa.array(x, pa.int64())


def _base(k: int):
    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, COUNTERS), np.int64)
        any_rows = False
        for batch in batches:
            for part in text_parts(batch):
                any_rows = True
                sets = shingle_sets(raw_texts(part), k)
                for row, cell in enumerate(_cells(np.concatenate(sets))):
                    counts[row] += np.bincount(cell, minlength=COUNTERS)
                hi, lo = zip(*map(_key, sets))
                yield _batch(id=part["id"], n=_long(list(map(len, sets))), hi=_long(hi), lo=_long(lo), sketch=pa.nulls(len(sets), pa.binary()))
        if any_rows:
            yield _batch(id=pa.nulls(1, pa.int64()), n=_long([-1]), hi=_long([0]), lo=_long([0]), sketch=pa.array([counts.tobytes()], pa.binary()))

    return run


def _sum_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * COUNTERS, np.int64)
    for batch in batches:
        for x in batch["sketch"]:
            total += np.frombuffer(x.as_py(), np.int64)
    yield _batch(sketch=pa.array([total.tobytes()], pa.binary()))


def _flags(often: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(often, np.uint8)).reshape(2, COUNTERS).astype(bool)


def _dealt(often: bytes, k: int, percent: int):
    """(token, hi, need): shingles of the dealt part, and how many of them must be shared. A document that cannot be ruled out so needs 0, and has a row MARK of its own besides."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _flags(often)
        seen: set[int] = set()  # copies in a task are sent once
        for part in (part for batch in batches for part in text_parts(batch)):
            token, key, need = [], [], []
            for codes in shingle_sets(raw_texts(part), k):
                n = len(codes)
                if not n or (own := _key(codes)[0]) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(own)
                c = size_class(n, percent)
                top = np.array([dealt_part(c, percent), dealt_part(c + 1, percent)])
                sent, counted = np.searchsorted(codes, (np.minimum(top, 1 - 2**-53) * 2.0**64).astype(np.uint64))
                head = codes[:sent]
                a, b = _cells(head)
                late = flags[0][a] & flags[1][b]
                # a partner lacks at most n - ceil(percent * n / 100) of the set
                wanted = int(counted) - (n - -(-percent * n // 100)) - int(late[:counted].sum())
                head = head[~late].view(np.int64)
                token.append(head), key.append(np.full(len(head), own)), need.append(np.full(len(head), max(0, wanted), np.int32))
                if wanted <= 0:  # its partners still have to meet its shingles
                    token.append(np.array([own])), key.append(np.array([own])), need.append(np.array([MARK], np.int32))
            if token:
                yield _batch(token=np.concatenate(token), hi=np.concatenate(key), need=np.concatenate(need))

    return run


def _prefixes(often: bytes, k: int, percent: int):
    """(id, n, token): the shingles that lead each set in the common order."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _flags(often)
        for part in (part for batch in batches for part in text_parts(batch)):
            sets = shingle_sets(raw_texts(part), k)
            heads = [ordered(codes, flags)[: prefix_length(len(codes), percent)].view(np.int64) for codes in sets]
            n = list(map(len, heads))
            yield _batch(id=np.repeat(part["id"].to_numpy(), n), n=np.repeat(np.array(list(map(len, sets)), np.int64), n), token=np.concatenate(heads))

    return run


class Lists:
    """Inverted lists of some documents' shingles, searched with DivideSkip."""

    def __init__(self, percent: int):
        self.percent, self.lists, self.sizes = percent, {}, []

    def add(self, codes: list[int], n: int | None = None) -> int:
        """Add a document of n shingles; codes may leave out those that no other document has."""
        i = len(self.sizes)
        self.sizes.append(len(codes) if n is None else n)
        for c in codes:
            self.lists.setdefault(c, []).append(i)
        return i

    def search(self, codes: list[int], skip=lambda i: False, n: int | None = None) -> Iterator[int]:
        """Documents whose overlap with a document of n shingles reaches what the percentage asks for, but for those that ``skip`` names."""
        n, p = len(codes) if n is None else n, self.percent
        need = -(-p * n // 100)
        lists = sorted((x for c in codes if (x := self.lists.get(c))), key=len)
        if len(lists) < need:
            return
        n_long = min(need - 1, int(need / (MU * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        least, last, count = need - n_long, -1, 0
        for i in heapq.merge(*short, [len(self.sizes)]):
            if i == last:
                count += 1
                continue
            if count >= least and not skip(last):
                m = self.sizes[last]
                if 100 * min(m, n) >= p * max(m, n):
                    both, left = count, len(long)
                    goal = -(-p * (n + m) // (100 + p))
                    for x in long:
                        if both + left < goal:
                            break
                        left -= 1
                        at = bisect_left(x, last)
                        both += at < len(x) and x[at] == last
                    if 100 * both >= p * (n + m - both):
                        yield last
            last, count = i, 1


def _grouped(batches: Iterator[pa.RecordBatch], k: int, *columns: str) -> Iterator[tuple[list[np.ndarray], dict[str, list]]]:
    """Shingle sets and columns of whole groups, from rows that are sorted by ``bucket``."""
    sets: list[np.ndarray] = []
    held: dict[str, list] = {c: [] for c in columns}
    last = None
    for batch in batches:
        for part in text_parts(batch):
            key = part["bucket"].to_numpy()
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            own, values = shingle_sets(raw_texts(part), k), {c: part[c].to_pylist() for c in columns}
            for a, b in zip(cut, cut[1:]):
                if sets and last != key[a]:
                    yield sets, held
                    sets, held = [], {c: [] for c in columns}
                last = key[a]
                sets += own[a:b]
                for c in columns:
                    held[c] += values[c][a:b]
    if sets:
        yield sets, held


def _common(sets: list[np.ndarray]) -> list[list[int]]:
    """The sets as small numbers, without the shingles that only one of them has: those cannot overlap."""
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both, cut = times[place] > 1, np.cumsum(list(map(len, sets)))[:-1]
    return [x[m].tolist() for x, m in zip(np.split(place, cut), np.split(both, cut))]


def _lead(k: int, percent: int):
    """First round: each document is linked to the first found of those that were linked to none."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for sets, own in _grouped(batches, k, "id"):
            if len(sets) < 2:
                continue
            index, ids, sizes = Lists(percent), [], list(map(len, sets))
            for i, codes, n in zip(own["id"], _common(sets), sizes):
                found = next(index.search(codes, n=n), None)
                if found is None:
                    index.add(codes, n)
                    ids.append(i)
                elif ids[found] != i:
                    a.append(i), b.append(ids[found])
        yield _batch(a=_long(a), b=_long(b))

    return run


def _across(k: int, percent: int):
    """Second round: all links between documents of different components, within a block or between two blocks of a group. Within a block, the largest component is only searched in."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for sets, own in _grouped(batches, k, "id", "comp", "side"):
            ids, comp, side = own["id"], own["comp"], own["side"]
            most = Counter(comp).most_common(1)[0][0] if 0 not in side else None
            root = {c: c for c in comp}

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            index, at = Lists(percent), []
            sizes, sets = list(map(len, sets)), _common(sets)
            for i, (codes, n) in enumerate(zip(sets, sizes)):
                if side[i]:
                    index.add(codes, n)
                    at.append(i)
            for i, codes in enumerate(sets):
                if side[i] != 1 and comp[i] != most:
                    for j in index.search(codes, lambda j, i=i: find(comp[at[j]]) == find(comp[i]), sizes[i]):
                        j = at[j]
                        if find(comp[j]) != find(comp[i]):
                            root[find(comp[i])] = find(comp[j])
                            a.append(ids[i]), b.append(ids[j])
        yield _batch(a=_long(a), b=_long(b))

    return run


def _blocks(groups: DataFrame) -> DataFrame:
    """(bucket, id, comp, side): documents of groups (group, shingles, id, comp) where they are searched.

    A group of as many shingles as a block holds is searched whole (side 2); else its documents are dealt to blocks, and
    every two blocks meet: side 0 asks, side 1 is searched in.
    """
    n = F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES)).cast("int")
    own = groups.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("id"), "n").cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return own.select(F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "id", "comp", side.alias("side"))


def link_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``id_col``, n_shingles and component_id (the smallest id reachable by links, itself included) of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = materialize(src.mapInArrow(_base(k), "id long, n long, hi long, lo long, sketch binary"), "sets")
    parts = base.where("sketch is not null").select("sketch").repartition(16).mapInArrow(_sum_sketches, "sketch binary")
    found = parts.coalesce(1).mapInArrow(_sum_sketches, "sketch binary").first()
    counts = np.frombuffer(found["sketch"], np.int64).reshape(2, COUNTERS) if found else np.zeros((2, COUNTERS), np.int64)
    often = np.packbits(frequent(counts)).tobytes()
    base = base.where("sketch is null").drop("sketch")
    classes = materialize(base.where("n > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "classes")

    # those that can have a partner at all, by what they share
    shared = src.where("text is not null and id is not null").mapInArrow(_dealt(often, k, percent), "token long, hi long, need int")
    shared = shared.repartition("token").dropDuplicates(["token", "hi", "need"])
    kept: list[DataFrame] = []
    for _ in range(PRUNINGS):
        several = f"min(hi) over (partition by token) < max(hi) over (partition by token) or need = {MARK}"
        shared = shared.withColumn("several", F.expr(several)).where("several").drop("several")
        shared = materialize(shared, "shared")
        kept.append(shared)
        left = shared.groupBy("hi").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("hi")
        left = materialize(left, "left")
        discard(*kept[:-1])
        kept = kept[-1:]
        shared = shared.join(small(left), "hi", "left_semi")

    reps = classes.join(small(left), "hi", "left_semi").select(F.col("rep").alias("id"), "n", "hi")
    texts = materialize(src.join(small(materialize(reps, "reps")), "id"), "texts")
    tokens = materialize(texts.select("id", "text").mapInArrow(_prefixes(often, k, percent), "id long, n long, token long"), "prefixes")

    own = tokens.groupBy("id", "n").agg(F.min("token").alias("t0"), F.min(F.xxhash64("token")).alias("t1"))
    dealt = own.select("id", "n", F.explode(F.array(F.xxhash64(F.lit(0), "t0"), F.xxhash64(F.lit(1), "t1"))).alias("group"))
    dealt_table = dealt = materialize(dealt, "leads")
    heavy = materialize(dealt.groupBy("group").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).where("docs > 1"), "weights")
    salt = F.pmod(F.xxhash64("id", "group"), F.ceil(F.col("shingles") / F.lit(GROUP_SHINGLES)))
    dealt = dealt.join(small(heavy), "group").select("id", F.xxhash64("group", salt).alias("bucket"))
    first = texts.select("id", "text", "n").join(dealt, "id").repartition("bucket").sortWithinPartitions("bucket", "n", "id").select("id", "text", "bucket").mapInArrow(_lead(k, percent), "a long, b long")
    first = materialize(first.distinct(), "links")
    comps = materialize(components(first), "components")

    def slots(df: DataFrame) -> DataFrame:
        """Each document in its size class and the next one: any two that can be linked meet in one."""
        level = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100) + 1e-9).cast("int")
        return df.withColumn("slot", F.explode(F.array(level, level + 1))).withColumn("bucket", F.xxhash64("token", "slot"))

    # documents that share enough with those of their size in other components
    known = materialize(texts.select("id", "hi", "n").join(small(comps), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "known")
    open_ = slots(shared.join(small(known), "hi")).select("id", "slot", "bucket", "comp", "need")
    several = f"min(comp) over (partition by bucket) < max(comp) over (partition by bucket) or need = {MARK}"  # no shingle here is frequent
    open_ = open_.withColumn("mixed", F.expr(several)).where("mixed")
    able = open_.groupBy("id", "slot").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("id", "slot")
    able = materialize(able, "open")
    rows = slots(tokens.join(small(known.select("id", "comp")), "id")).join(small(able), ["id", "slot"], "left_semi")
    rows = materialize(rows.select("id", "n", "comp", "bucket", F.xxhash64("id", "slot").alias("node")), "groups")
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("node").alias("low"), F.sum("n").alias("shingles")).where("least < most").drop("least", "most")
    mixed = materialize(mixed, "mixed")
    all_rows, rows = rows, materialize(rows.join(small(mixed), "bucket"), "groups")
    # groups that hang together are searched as one, block by block, unless that takes more copies of documents than group by group
    star = rows.select(F.col("node").alias("a"), F.col("low").alias("b"))
    docs_of = rows.groupBy("id", "node", "n", "comp").agg(F.count("*").alias("places")).join(small(materialize(components(star).withColumnRenamed("id", "node"), "components")), "node")
    docs_of = materialize(docs_of, "clusters")
    size = docs_of.groupBy("component").agg(F.sum("n").alias("shingles"), F.sum("places").alias("places"), F.count("*").alias("docs"))
    size = materialize(size.withColumn("fits", F.col("docs") * F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES)) <= F.col("places")).drop("places", "docs"), "sizes")
    docs_of = docs_of.join(small(size), "component")
    fits = F.col("fits")
    whole = docs_of.where(fits).select(F.xxhash64("component").alias("group"), "shingles", "id", "comp")
    # of the rest, groups that hold the same documents are searched once
    rest = rows.join(small(materialize(docs_of.where(~fits).select("node"), "large")), "node", "left_semi")
    group = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    group = materialize(group.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "once")
    rest = rest.join(small(group), "bucket", "left_semi").select(F.col("bucket").alias("group"), "shingles", "id", "comp")
    searched = materialize(_blocks(whole.unionByName(rest)), "searched")
    second = texts.select("id", "text").join(searched, "id").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_across(k, percent), "a long, b long")
    second = materialize(second.distinct(), "links")
    comps = materialize(components(first.unionByName(second)), "components") if not second.isEmpty() else comps
    discard(*kept, texts, tokens, dealt_table, all_rows, rows, searched)

    ranked = classes.join(small(comps.withColumnRenamed("id", "rep")), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    out = base.join(ranked, ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
