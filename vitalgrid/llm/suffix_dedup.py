"""Exact removal of repeated byte strings with suffix arrays built by linear grouping.

1. Every string of 100 bytes has an anchor: its 32-byte piece of least hash, the leftmost of equals.  Strings that are
   equal have equal anchors, so a document is cut into contexts, the runs of strings with one anchor, and contexts are
   dealt out by their anchors.  Contexts whose anchor stands nowhere else are done with.
2. A context that occurs again as a whole is removed wherever it is not first.  Tasks tell most of these among their own
   texts, and deal out only the first of equal ones, so that a passage of many documents sends few rows to one place.
3. What is left are first occurrences of different contexts of one anchor: their texts are joined to a block, and blocks
   are sorted with the grouping construction (``suffix_arrays``), many blocks in step.  In a suffix array equal strings
   are neighbours; all but the first of them are removed.
4. Groups of more contexts than BLOCK_CONTEXTS would make long blocks; their strings are compared one by one in a
   shuffle by hash instead (the first of equal ones of a task), which needs no group in one task.

Edge cases: null text counts as empty; texts below 100 bytes lose nothing; repeated rows (same id and text) count as
one document and keep what it keeps; ids are taken to name one text: of rows of one id with different texts, what is
removed of any is removed of all; rows without an id lose nothing; very long texts are read in overlapping pieces; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frees, materialize, raw_texts, text_parts

#: Bytes of the strings whose repeats go, and of the pieces that serve as anchors.
LENGTH, ANCHOR = 100, 32
#: Contexts of an anchor that are sorted as one block.
BLOCK_CONTEXTS = 48
#: Bytes hashed, and bytes of blocks sorted, at once, and contexts or strings compared within a task: what bounds a task's memory.
PIECE_BYTES, SORT_BYTES, COMPARED = 250_000, 1_000_000, 400_000

_RANDOM = np.random.RandomState(20240229)
_OF_BYTE = _RANDOM.randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR, _FACTOR2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _pieces_hash(values: np.ndarray, length: int, factor: np.uint64 = _FACTOR) -> np.ndarray:
    """Hash of each run of ``length`` values (any length, by doubling)."""
    whole, whole_len, at = None, 0, values
    step, span = factor, 1
    while True:
        if length & span:
            if whole is None:
                whole, whole_len = at, span
            else:
                n = len(values) - whole_len - span + 1
                with np.errstate(over="ignore"):
                    whole = whole[:n] * step + at[whole_len : whole_len + n]
                whole_len += span
        if span * 2 > length:
            return whole
        with np.errstate(over="ignore"):
            at = at[:-span] * step + at[span:]
            step = step * step
        span *= 2


def anchors(data: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of some bytes (at most 2**24): first string of each, how many strings, the anchor's hash, the context's hash."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = _mix(_pieces_hash(_OF_BYTE[data], k))
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    anchor = h[at[first]]
    # hash of a context: a polynomial over its bytes, from running sums of bytes times powers
    power = np.full(len(data) + 1, _FACTOR2, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.r_[np.uint64(0), np.cumsum(_OF_BYTE[data] * power[:-1])]
    end = first + count - 1 + length
    own = (sums[end] - sums[first]) * power[len(data) - first]  # the same power of the factor for all contexts of these bytes
    inverse = np.uint64(pow(int(power[len(data)]), -1, 1 << 64))
    own = _mix(own * inverse) ^ _mix((count.astype(np.uint64) << np.uint64(20)) + (at[first] - first).astype(np.uint64))
    return first, count, anchor.view(np.int64), own.view(np.int64)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def suffix_arrays(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Suffix array of each block (arrays of small non-negative integers), all blocks worked on in step.

    Phase 1 takes a block's groups of suffixes in descending order. Each suffix of the group points to the last suffix
    before it that is in a lower group; those pointed at are moved, by the number of pointers, behind the rest of
    their groups, so that in the end a group holds the suffixes of one Lyndon prefix. Phase 2 goes through the final
    order from its start, puts the suffix before each one in front of its group, and follows that suffix's pointers.
    """
    size = np.array([len(b) + 1 for b in blocks])
    order = np.argsort(-size, kind="stable")  # the longest first, so that blocks still worked on lead
    size = size[order]
    nb = len(blocks)
    guard = np.cumsum(size + 1) - (size + 1)  # a place before each block that is lower than all
    slot0 = np.cumsum(size) - size
    total = int((size + 1).sum())
    sym = np.zeros(total, np.int64)
    for b, at in zip(order.tolist(), guard.tolist()):
        sym[at + 1 : at + 1 + len(blocks[b])] = blocks[b]
    real = np.ones(total, bool)
    real[guard] = False
    end_mark = guard + size
    sym[real] += 1
    sym[end_mark] = 0
    pos = np.flatnonzero(real)
    block = np.repeat(np.arange(nb), size)
    key = block * (int(sym.max()) + 1) + sym[pos]
    by = np.argsort(key, kind="stable")
    sa, key = pos[by], key[by]
    slot = np.zeros(total, np.int64)
    slot[sa] = np.arange(len(sa))
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    width = np.diff(np.r_[start, len(sa)])
    group = np.full(total, -1, np.int64)
    group[sa] = np.repeat(start, width)
    group_end = np.zeros(len(sa) + 1, np.int64)
    group_end[start] = start + width
    prev = np.full(total, -1, np.int64)
    hit = np.zeros(total, bool)

    live = np.arange(nb)
    ends = slot0 + size
    live = live[ends > slot0 + 1]
    while len(live):
        e = ends[live]
        s = group[sa[e - 1]]
        own = sa[_ranges(s, e - s)]
        now = np.repeat(s, e - s)
        p = own - 1
        todo = np.flatnonzero(group[p] >= now)
        while len(todo):
            q = p[todo]
            further = prev[q]
            q = np.where(further >= 0, further, q - 1)
            p[todo] = q
            todo = todo[group[q] >= now[todo]]
        prev[own] = p
        p = p[group[p] >= 0]
        if len(p):
            p.sort()
            head = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            times = np.diff(np.r_[head, len(p)])
            p = p[head]
            g = group[p]
            o = np.lexsort((times, g))
            p, g, times = p[o], g[o], times[o]
            new_g = np.r_[True, g[1:] != g[:-1]]
            first = np.flatnonzero(new_g)
            k = np.diff(np.r_[first, len(g)])
            tail = np.repeat(group_end[g[first]] - k, k)  # where the moved ones of the group begin
            to = tail + np.arange(len(p)) - np.repeat(first, k)
            hit[p] = True
            there = sa[to]
            there = there[~hit[there]]
            was = slot[p]
            free = was[was < tail]
            sa[free], slot[there] = there, free
            sa[to], slot[p] = p, to
            hit[p] = False
            cut = np.flatnonzero(new_g | np.r_[True, times[1:] != times[:-1]])
            n = np.diff(np.r_[cut, len(p)])
            group_end[g[first]] = tail[first]
            group_end[to[cut]] = to[cut] + n
            group[p] = np.repeat(to[cut], n)
        ends[live] = s
        live = live[s > slot0[live] + 1]

    out = np.zeros(len(sa), np.int64)
    front = np.arange(len(sa) + 1)
    done = np.zeros(total, bool)
    out[slot0] = end_mark
    done[end_mark] = True
    done[guard] = True
    n_live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if nb else []
    for k, n in enumerate(n_live):
        s = out[slot0[:n] + k] - 1
        s = s[~done[s]]
        while len(s):
            g = group[s]
            f = front[g]
            out[f] = s
            front[g] = f + 1
            done[s] = True
            s = prev[s]
            s = s[~done[s]]
    result: list[np.ndarray] = [np.empty(0, np.int64)] * nb
    for b, at, n, g in zip(order.tolist(), slot0.tolist(), size.tolist(), guard.tolist()):
        result[b] = out[at + 1 : at + n] - (g + 1)
    return result


def repeats(groups: list[list[bytes]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """Of each context of each group, which of its strings of ``length`` bytes equal one that starts earlier in the group (contexts in order)."""
    blocks, bounds = [], []
    for group in groups:
        parts, at, own = [], 0, []
        for c in group:
            parts += [np.frombuffer(c, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
            own.append((at, len(c)))
            at += len(c) + 1
        blocks.append(np.concatenate(parts)), bounds.append(own)
    out = []
    for block, own, sa in zip(blocks, bounds, suffix_arrays(blocks)):
        starts = np.zeros(len(block), bool)
        for at, n in own:
            starts[at : at + n - length + 1] = True
        rows = sa[starts[sa]]
        # neighbours with 100 equal bytes, compared eight at a time
        wide = np.lib.stride_tricks.sliding_window_view(np.r_[(block - 1).astype(np.uint8), np.zeros(8, np.uint8)], 8)
        wide = np.ascontiguousarray(wide).view(np.uint64).ravel()
        same = np.ones(max(0, len(rows) - 1), bool)
        for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            at = np.flatnonzero(same)
            same[at] = wide[rows[at] + k] == wide[rows[at + 1] + k]
        gone = np.zeros(len(block), bool)
        if len(rows):
            head = np.flatnonzero(np.r_[True, ~same])
            earliest = np.minimum.reduceat(rows, head)
            gone[rows] = rows != np.repeat(earliest, np.diff(np.r_[head, len(rows)]))
        out.append([np.flatnonzero(gone[at : at + n - length + 1]) for at, n in own])
    return out


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _among(ids: np.ndarray, at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal keys: which are the least by (id, at), each once, and which are not the least."""
    first, again = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    if not len(ids):
        return first, again
    order = np.argsort(keys[0] ^ _mix(keys[1].view(np.uint64)).view(np.int64), kind="stable")
    new = np.r_[True, np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    first[order[~several]] = True
    rows, group = order[several], group[several]
    by = np.lexsort((at[rows], ids[rows], group))
    rows, group = rows[by], group[by]
    new = np.r_[len(group) > 0, group[1:] != group[:-1]][: len(group)]
    first[rows[new]] = True
    head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))] if len(rows) else rows
    again[rows] = (ids[rows] != ids[head]) | (at[rows] != at[head])
    return first, again


def _batches(names: list[str], columns: list[np.ndarray], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + rows]) for c in columns], names)


_CONTEXT = ["key", "own", "id", "at", "n", "again"]


def _contexts(length: int):
    """(key, own, id, at, n, again): the first of equal contexts of some texts, by anchor; and, at any key, runs of those that are not first."""

    def told(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, at, n, anchor, own = (np.concatenate(x) for x in zip(*held))
        first, again = _among(ids, at, anchor, own)
        yield from _batches(_CONTEXT, [anchor[first], own[first], ids[first], at[first], n[first].astype(np.int32), np.zeros(int(first.sum()), bool)])
        ids, at, n = ids[again], at[again], n[again]
        if len(ids):  # neighbours in a text join to one run
            new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + n[:-1])])
            n = np.add.reduceat(n, new)
            ids, at = ids[new], at[new]
            spread = _mix(ids.astype(np.uint64) * _FACTOR + at.astype(np.uint64)).view(np.int64)
            yield from _batches(_CONTEXT, [spread, spread, ids, at, n.astype(np.int32), np.ones(len(ids), bool)])

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in text_parts(batch):
                for i, raw in zip(part["id"].to_pylist(), raw_texts(part)):
                    for base in range(0, max(1, len(raw) - length + 1), PIECE_BYTES):
                        first, count, anchor, own = anchors(np.frombuffer(raw[base : base + PIECE_BYTES + length - 1], np.uint8), length)
                        held.append((np.full(len(first), i, np.int64), first + base, count, anchor, own))
                        size += len(first)
                if size > COMPARED:
                    yield from told(held)
                    held, size = [], 0
        if held:
            yield from told(held)

    return run


def _fetch(length: int):
    """(anchor, contexts, id, at, text) of the contexts that are wanted of each text."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "contexts", "id", "at", "text"]
        for batch in batches:
            for part in text_parts(batch):
                anchor, contexts, at, n = (part[c] for c in ("anchor", "contexts", "ats", "ns"))
                each = np.diff(at.offsets.to_numpy())
                of = np.repeat(np.arange(part.num_rows), each)
                raws = raw_texts(part)
                start, more = at.flatten().to_numpy(), n.flatten().to_numpy()
                texts = [raws[t][a : a + m - 1 + length] for t, a, m in zip(of.tolist(), start.tolist(), more.tolist())]
                ids = part["id"].to_numpy()[of]
                yield pa.RecordBatch.from_arrays([anchor.flatten(), contexts.flatten(), pa.array(ids), pa.array(start), pa.array(texts, pa.binary())], names)

    return run


_SPAN = "id long, start long, end long"


def _spans(ids: list[int], at: list[int], gone: list[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of removed strings as (id, start, end) of bytes."""
    i, a, b = [], [], []
    for own, base, t in zip(ids, at, gone):
        if len(t):
            cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1] + 1])
            last = np.r_[cut[1:], len(t)] - 1
            i.append(np.full(len(cut), own, np.int64)), a.append(t[cut] + base), b.append(t[last] + base + length)
    if i:
        yield from _batches(["id", "start", "end"], [np.concatenate(x) for x in (i, a, b)])


def _sort_blocks(length: int):
    """Removed strings of blocks; rows come sorted by anchor, id and place."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, groups, size, last = [], [], [], 0, None

        def done() -> Iterator[pa.RecordBatch]:
            yield from _spans(ids, at, [g for group in repeats(groups, length) for g in group], length)

        for batch in batches:
            for part in text_parts(batch):
                for anchor, i, start, text in zip(*(part[c].to_pylist() for c in ("anchor", "id", "at", "text"))):
                    if anchor != last:
                        if size > SORT_BYTES:
                            yield from done()
                            ids, at, groups, size = [], [], [], 0
                        groups.append([])
                        last = anchor
                    elif (ids[-1], at[-1]) == (i, start):  # a repeated row
                        continue
                    groups[-1].append(text), ids.append(i), at.append(start)
                    size += len(text)
        if groups:
            yield from done()

    return run


def _strings(length: int):
    """(a, b, id, start, again): strings of the contexts of large groups as two hashes, the first of equal ones; and, at any hash, those that are not first."""

    def cut(ids: np.ndarray, at: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        sizes = np.array(list(map(len, texts)))
        ends = np.cumsum(sizes)
        values = _OF_BYTE[np.frombuffer(b"".join(texts), np.uint8)]
        of = np.repeat(np.arange(len(texts)), sizes)
        inside = np.flatnonzero(of[: len(of) - length + 1] == of[length - 1 :])  # strings that lie in one context
        a, b = (_mix(_pieces_hash(values, length, f)[inside]).view(np.int64) for f in (_FACTOR, _FACTOR2))
        of = of[inside]
        return ids[of], at[of] + inside - (ends - sizes)[of], a, b

    def told(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, at, a, b = (np.concatenate(x) for x in zip(*held))
        first, again = _among(ids, at, a, b)
        names = ["a", "b", "id", "start", "again"]
        yield from _batches(names, [a[first], b[first], ids[first], at[first], np.zeros(int(first.sum()), bool)])
        ids, at = ids[again], at[again]
        spread = _mix(ids.astype(np.uint64) * _FACTOR + at.astype(np.uint64)).view(np.int64)
        yield from _batches(names, [spread, spread, ids, at, np.ones(len(ids), bool)])

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in text_parts(batch, size=PIECE_BYTES):
                held.append(cut(part["id"].to_numpy(), part["at"].to_numpy(), part["text"].to_pylist()))
                size += len(held[-1][0])
                if size > COMPARED:
                    yield from told(held)
                    held, size = [], 0
        if held:
            yield from told(held)

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(id, start, end): byte ranges, overlapping ones included, of the strings of ``length`` bytes that start earlier elsewhere."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").where(F.octet_length("text") >= length)
    found = src.mapInArrow(_contexts(length), "key long, own long, id long, at long, n int, again boolean").repartition("key")
    # all windows use the one shuffle by key; the first occurrences are those of tasks, so that no key has many rows of one context
    found = found.withColumn("docs", F.expr("count(*) over (partition by key)")).where("docs > 1 or again")
    found = found.withColumn("lead", F.expr("min(struct(id, at)) over (partition by key, own)")).withColumn("first", F.expr("not again and lead = struct(id, at)"))
    found = found.withColumn("docs", F.expr("count(if(first, 1, null)) over (partition by key)"))
    found = materialize(found.where("not first or docs > 1").select("id", "at", "n", "key", "first", "docs"), "contexts")
    again = found.where("not first").select("id", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + length).alias("end"))

    wanted = found.where("first").dropDuplicates(["id", "at"]).groupBy("id").agg(F.collect_list(F.struct("key", "docs", "at", "n")).alias("wanted"))
    wanted = wanted.select("id", F.col("wanted.key").alias("anchor"), F.col("wanted.docs").alias("contexts"), F.col("wanted.at").alias("ats"), F.col("wanted.n").alias("ns"))
    cut = src.join(wanted, "id").mapInArrow(_fetch(length), "anchor long, contexts long, id long, at long, text binary")
    cut = materialize(cut, "blocks")
    some = cut.where(F.col("contexts") <= BLOCK_CONTEXTS).repartition("anchor").sortWithinPartitions("anchor", "id", "at").mapInArrow(_sort_blocks(length), _SPAN)
    many = cut.where(F.col("contexts") > BLOCK_CONTEXTS).mapInArrow(_strings(length), "a long, b long, id long, start long, again boolean")
    many = many.withColumn("lead", F.expr("min(struct(id, start)) over (partition by a, b)")).where("again or lead < struct(id, start)")
    many = many.select("id", "start", (F.col("start") + length).alias("end"))
    spans = materialize(again.unionByName(some).unionByName(many), "spans")
    discard(found, cut)
    return spans


def _merged(packed: np.ndarray | None) -> list[tuple[int, int]]:
    """Ranges from their packed form: the start in the upper, the length in the lower 32 bits."""
    return merge_spans([(x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in packed]) if packed is not None else []


@frees
def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_parts(batch):
            sizes, removed, runs, digests = [], [], [], []
            for raw, spans in zip(raw_texts(part), part["spans"].to_pylist()):
                raw, merged = raw or b"", _merged(spans)
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                sizes.append(len(raw)), removed.append(sum(b - a for a, b in merged)), runs.append(len(merged)), digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([part["id"], *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _by_document(docs: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with spans, the packed ranges of its id."""
    packed = F.shiftleft(F.col("start"), 32) + (F.col("end") - F.col("start"))
    own = spans.groupBy("id").agg(F.collect_set(packed).alias("spans")).withColumnRenamed("id", "_own")
    return docs.join(own, docs[id_col].cast("long") == own["_own"], "left").drop("_own")


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = _by_document(src, removed_spans(docs, text_col, id_col, length), "id").select("id", "text", "spans")
    return out.mapInArrow(_finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def cut_text(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text_col``; bytes of a character cut in two go too."""
    place = docs.columns.index(text_col)

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, text_col):
                texts = []
                for raw, spans in zip(raw_texts(part, text_col), part["spans"].to_pylist()):
                    if raw is not None and spans is not None:
                        at, parts = 0, []
                        for a, b in _merged(spans):
                            parts.append(raw[at:a])
                            at = b
                        parts.append(raw[at:])
                        raw = "".join(p.decode("utf-8", "ignore") for p in parts).encode()
                    texts.append(raw)
                columns = part.columns[:-1]
                columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    joined = _by_document(docs, removed_spans(docs, text_col, id_col, length), id_col)
    return joined.select(*[joined[c] for c in docs.columns], "spans").mapInArrow(run, docs.schema)
