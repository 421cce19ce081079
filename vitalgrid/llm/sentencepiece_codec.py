"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The model file is read as data (pieces, scores, types).  A batch of texts is cut into segments that no merge can
cross, distinct segments are laid out as one flat numpy array of symbols, and every round looks up the rank of each
neighbouring pair, takes the minimum of each segment, merges its leftmost occurrences in all segments at once and
compacts the array, until no pair is left.

Edge cases: null text counts as empty and gives no ids; characters outside the vocabulary become byte pieces; extra
columns pass through ``encode`` and ``decode`` untouched; an empty table gives an empty result; repeated rows are
encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frees, text_parts

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Segments kept between batches by a worker; the cache is emptied beyond it.
CACHE_SEGMENTS = 200_000
#: Segments handled at once, which bounds a task's memory whatever the length of a text.
CHUNK_SEGMENTS = 100_000
#: Segments of more symbols are merged one by one with a heap: rounds over them would take quadratic time.
LONG_SEGMENT = 3_000


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices pool[start:start+length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Codec:
    """Tables of one model, and a cache of encoded segments."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type == 4 for p in model.pieces):
            raise ValueError("only BPE models with identity normalisation and no user-defined pieces are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]  # 1 normal, 2 unknown, 3 control, 5 unused, 6 byte
        self.size, self.unk = len(pieces), kinds.index(2)
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k in (1, 5)}
        if 5 in kinds:
            raise ValueError("unused pieces are not supported")
        scores = {p: model.pieces[i].score for p, i in self.ids.items()}
        levels = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.full(self.size + 1, NONE, np.int32)
        for p, i in self.ids.items():
            self.rank[i] = levels[scores[p]]
        self.byte_ids = np.array([self.ids_of_byte(pieces, kinds, b) for b in range(256)], np.int32)
        self._pairs()
        self._alphabet(pieces, kinds)
        # what an id stands for when decoded, and its digits with a comma
        text = [p.replace(SPACE, " ").encode() if k == 1 else bytes([int(p[3:5], 16)]) if k == 6 else b" \xe2\x81\x87 " if k == 2 else b"" for p, k in zip(pieces, kinds)]
        self.text, self.text_len = np.frombuffer(b"".join(text), np.uint8), np.array(list(map(len, text)))
        self.text_at = np.cumsum(self.text_len) - self.text_len
        digits = [b"%d," % i for i in range(self.size)]
        self.digits, self.digits_len = np.frombuffer(b"".join(digits), np.uint8), np.array(list(map(len, digits)))
        self.digits_at = np.cumsum(self.digits_len) - self.digits_len
        self.is_byte = np.array([k == 6 for k in kinds])
        self.opens = np.array([k == 1 and p.startswith(SPACE) for p, k in zip(pieces, kinds)])
        self.control = np.array([k == 3 for k in kinds])
        self._forget()

    @staticmethod
    def ids_of_byte(pieces: list[str], kinds: list[int], b: int) -> int:
        name = f"<0x{b:02X}>"
        return next((i for i, (p, k) in enumerate(zip(pieces[:1000], kinds)) if k == 6 and p == name), kinds.index(2))

    def _pairs(self) -> None:
        """Hash table of (left id, right id) -> merged id, and which merged pieces can be made at all places at once."""
        left, right, made = [], [], []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        left, right, made = np.array(left), np.array(right), np.array(made)
        key = left.astype(np.int64) * self.size + right
        self.bits = 64 - max(10, int(np.ceil(np.log2(len(key) * 8 + 1))))
        slots = 1 << (64 - self.bits)
        self.pair_key, self.pair_id, self.probes = np.full(slots + 64, -1, np.int64), np.full(slots + 64, self.size, np.int32), 1
        for k, i, at in zip(key.tolist(), made.tolist(), self._slot(key).tolist()):
            n = at
            while self.pair_key[n] != -1:
                n += 1
            self.pair_key[n], self.pair_id[n], self.probes = k, i, max(self.probes, n - at + 1)
        # Making P everywhere in a segment equals making it from left to right unless P itself can join at once in a pair of the same or a better rank.
        rank = self.rank
        _, count = np.unique(rank[: self.size], return_counts=True)
        shared = np.isin(rank, np.unique(rank[: self.size])[count > 1])
        self.at_once = ~shared
        for side in (left, right):
            early = rank[made] <= rank[side]
            self.at_once[side[early]] = False

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.bits)).astype(np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, or ``size`` where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = self._slot(key)
        out = np.where(self.pair_key[at] == key, self.pair_id[at], np.int32(self.size))
        for k in range(1, self.probes):
            hit = self.pair_key[at + k] == key
            if hit.any():
                out[hit] = self.pair_id[at[hit] + k]
        out[(left < 0) | (right < 0)] = self.size
        return out

    def _alphabet(self, pieces: list[str], kinds: list[int]) -> None:
        top = 0x110000
        self.char_id = np.full(top, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        inner = "".join(self.ids)
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "\n" if "\n" not in inner else ""
        # no merge crosses the place before a run of spaces, nor touches a character that no piece holds
        self.cut = None if crossing else re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}+" if alone else ""))

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.pool, self.pool_at, self.pool_len = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def segments(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        return self.cut.findall(text) if self.cut else [text]

    def merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other, and the number of ids of each."""
        n_chars = np.fromiter(map(len, segments), np.int64, len(segments))
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.char_id[code]
        sym = np.where(sym < 0, -1 - code, sym)
        seg = np.repeat(np.arange(len(segments)), n_chars)
        done_sym, done_seg = [], []
        if len(n_chars) and n_chars.max() > LONG_SEGMENT:
            for s in np.flatnonzero(n_chars > LONG_SEGMENT):
                ids = self._merge_long(sym[seg == s])
                done_sym.append(ids), done_seg.append(np.full(len(ids), s))
            short = n_chars[seg] <= LONG_SEGMENT
            sym, seg = sym[short], seg[short]
        while len(sym):
            made = np.full(len(sym), self.size, np.int64)
            made[:-1] = np.where(seg[1:] == seg[:-1], self._join(sym[:-1], sym[1:]), self.size)
            rank = self.rank[made]
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            lengths = np.diff(np.r_[first, len(seg)])
            best = np.repeat(np.minimum.reduceat(rank, first), lengths)
            over = best == NONE
            if over.any():
                done_sym.append(sym[over]), done_seg.append(seg[over])
                live = ~over
                sym, seg, made, rank, best = sym[live], seg[live], made[live], rank[live], best[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            follows = np.r_[False, (at[1:] == at[:-1] + 1)]
            head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            take = (np.arange(len(at)) - head) % 2 == 0  # in a run of overlapping pairs every other one, from the left
            lone = np.r_[True, seg[at[1:]] != seg[at[:-1]]]
            at = at[take & (self.at_once[made[at]] | lone)]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seg = sym[keep], seg[keep]
        sym = np.concatenate(done_sym) if done_sym else np.empty(0, np.int64)
        seg = np.concatenate(done_seg) if done_seg else np.empty(0, np.int64)
        order = np.argsort(seg, kind="stable")
        sym, seg = sym[order], seg[order]
        if (sym < 0).any():
            sym, seg = self._to_bytes(sym, seg)
        return sym.astype(np.int32), np.bincount(seg, minlength=len(segments))

    def _to_bytes(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = np.where(sym < 0, -1 - sym, 0)
        n = np.where(sym < 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        out, code, sym, width = np.repeat(sym, n), np.repeat(code, n), np.repeat(sym, n), np.repeat(n, n)
        k = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        six = (code >> (6 * (width - 1 - k))) & 0x3F
        lead = np.where(width == 1, code, np.array([0, 0, 0xC0, 0xE0, 0xF0])[width] | (code >> (6 * (width - 1))))
        byte = np.where(k == 0, lead, 0x80 | six)
        return np.where(sym < 0, self.byte_ids[byte & 0xFF], out), np.repeat(seg, n)

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """One very long segment: best pair first from a heap, over a linked list."""
        s, n = sym.tolist(), len(sym)
        nxt, prv, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(left: np.ndarray, right: np.ndarray) -> None:
            made = self._join(np.array([s[i] for i in left]), np.array([s[i] for i in right]))
            for i, j, m in zip(left, right, made.tolist()):
                if m != self.size:
                    heapq.heappush(heap, (int(self.rank[m]), i, j, s[i], s[j], m))

        offer(range(n - 1), range(1, n))
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if s[i] != a or s[j] != b or nxt[i] != j:
                continue
            s[i], s[j], nxt[i] = m, None, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            near = [(x, y) for x, y in ((prv[i], i), (i, nxt[i])) if x >= 0 and y < n]
            if near:
                offer(*map(list, zip(*near)))
        return np.array([x for x in s if x is not None])

    def look_up(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, one after the other, and the number of ids of each; distinct segments are merged once."""
        if len(self.cache) > CACHE_SEGMENTS:
            self._forget()
        if new := [s for s in dict.fromkeys(segments) if s not in self.cache]:
            ids, n = self.merge(new)
            base, at = len(self.cache), len(self.pool)
            self.cache.update(zip(new, range(base, base + len(new))))
            self.pool = np.concatenate([self.pool, ids])
            self.pool_at = np.concatenate([self.pool_at, at + np.cumsum(n) - n])
            self.pool_len = np.concatenate([self.pool_len, n])
        k = np.fromiter(map(self.cache.__getitem__, segments), np.int64, len(segments))
        return _gather(self.pool, self.pool_at[k], self.pool_len[k]), self.pool_len[k]

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, bool]]]]:
        """Flat ids of some segments, with (text, from, to, is its last) of the texts in them."""
        held, marks = [], []
        for t, text in enumerate(texts):
            own = self.segments(text)
            for at in range(0, len(own), CHUNK_SEGMENTS):
                part = own[at : at + CHUNK_SEGMENTS]
                marks.append((t, len(held), len(held) + len(part), at + CHUNK_SEGMENTS >= len(own)))
                held += part
                if len(held) >= CHUNK_SEGMENTS:
                    yield self._chunk(held, marks)
                    held, marks = [], []
        if held:
            yield self._chunk(held, marks)

    def _chunk(self, held: list[str], marks: list) -> tuple[np.ndarray, list]:
        ids, n = self.look_up(held)
        at = np.r_[0, np.cumsum(n)].tolist()
        return ids, [(t, at[a], at[b], last) for t, a, b, last in marks]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for ids, marks in self.chunks(texts):
            for t, a, b, _ in marks:
                out[t].append(ids[a:b])
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.empty(0, np.int32) for x in out]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """What the ids stand for, as bytes, the mark of the text's start included."""
        return _gather(self.text, self.text_at[ids], self.text_len[ids])

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids. Bytes that are no UTF-8 become U+FFFD each, control ids nothing, and ids outside the vocabulary raise IndexError."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise IndexError("id outside the vocabulary")
        if (at := np.flatnonzero(self.control[ids])).size:  # control ids part runs of bytes
            parts = [x[~self.control[x]] for x in np.split(ids, at)]
            parts = [x for x in parts if len(x)]
            return "".join([self.decode(x) if k == 0 else self._plain(x) for k, x in enumerate(parts)])
        seen = ids
        skip = bool(self.dummy_prefix and len(seen) and self.opens[seen[0]])
        return self._plain(ids, skip)

    def _plain(self, ids: np.ndarray, skip: bool = False) -> str:
        raw = self.decode_bytes(ids).tobytes()[skip:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", raw.decode("utf-8", "surrogateescape"))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, digest of the ids in decimals, digest of the text decoded from them."""
        count, a, b = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for ids, marks in self.chunks(texts):
            digits, raw = _gather(self.digits, self.digits_at[ids], self.digits_len[ids]), self.decode_bytes(ids)
            to_digit, to_raw = np.r_[0, np.cumsum(self.digits_len[ids])], np.r_[0, np.cumsum(self.text_len[ids])]
            digits, raw = digits.tobytes(), raw.tobytes()
            for t, i, j, last in marks:
                skip = not count[t] and self.dummy_prefix and bool(self.opens[ids[i]])
                a[t].update(digits[to_digit[i] : to_digit[j] - last])
                b[t].update(raw[to_raw[i] + skip : to_raw[j]])
                count[t] += j - i
        return [(n, x.hexdigest(), y.hexdigest()) for n, x, y in zip(count, a, b)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None, lossless_col: str | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (all, if not given) and ``out_col``, the ids of the whole of ``text_col`` without begin or end ids; null text gives an empty array.

    ``lossless_col``, if given, tells whether decoding the ids gives the text again.
    """
    keep = df.columns if keep is None else keep
    checked = lossless_col is not None

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part in text_parts(batch, "_text"):
                texts = part["_text"].to_pylist()
                flat, ends, same = [], np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool)
                for t, ids in enumerate(own.encode(texts)):
                    flat.append(ids)
                    ends[t + 1] = ends[t] + len(ids)
                    if checked:
                        same[t] = own.decode(ids) == (texts[t] or "")
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
                columns = [part[c] for c in keep] + [lists] + [pa.array(same)] * checked
                yield pa.RecordBatch.from_arrays(columns, [*keep, out_col, *[lossless_col] * checked])

    schema = T.StructType([df.schema[c] for c in keep]).add(out_col, T.ArrayType(T.IntegerType()))
    schema = schema.add(lossless_col, T.BooleanType()) if checked else schema
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the text of ``ids_col``; null ids give an empty text."""

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([codec(model_path).decode([] if x is None else x) for x in column])

    return df.withColumn(out_col, F.pandas_udf(run, T.StringType())(F.col(ids_col)))


def encode_digests(df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256 and decoded_sha256 of every row, without holding all ids of a text at once."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part in text_parts(batch):
                n, ids, decoded = zip(*own.digests(part["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
