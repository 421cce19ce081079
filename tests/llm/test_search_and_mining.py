"""op11 to op13 against plain versions and SQL."""

import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_queries import rows as comparable
from vitalgrid.llm import collocations, maxscore, oracle, registry, spelling

DOCUMENT = "doc_id long, text string, lang string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_maxscore", "op13_collocations"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = registry.QUERIES[name](spark, DATA)
    cur = con.execute(oracle.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    assert comparable(got.columns, got.collect()) == comparable(columns, cur.fetchall())


# op11


def plain_variants(rows, least=7, n_least=2, times=10):
    c = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                c[w] += 1
    v = {w: n for w, n in c.items() if n >= n_least}
    letters = sorted(set("".join(v)))
    form, near = {}, {}
    for w in v:
        e = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + k :] for a in letters for k in (0, 1) for i in range(len(w) + 1 - k)}
        e = [x for x in e if x in v and x != w]
        near[w] = len(e)
        best = min(e, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= times * v[w] else None
    out = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, v[w], near[w], v[form[w]] if form[w] else None))
    return sorted(out)


def chained(seed=1):
    """Words that lead to one another over several steps, with ties, doubled and accented letters."""
    rnd, words = random.Random(seed), []
    for base in ("abcdefgh", "àéîõüÿçñ", "aaaaaaaa", "committee"):
        w, n = base, 1200
        while n >= 1:
            words += [w] * n
            words += [w + "z"] * max(1, n // 11) + [w[:3] + "q" + w[3:]] * max(1, n // 11)
            i = rnd.randrange(len(w))
            w, n = w[:i] + rnd.choice("bxéÿ") + w[i:], n // 11
    rnd.shuffle(words)
    return words


def test_variants_equal_a_plain_version(spark):
    words = chained()
    texts = [" ".join(words[i::40]) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "Nothing nothing NOTHING"), (7, None), (8, ""), (9, "12 34 ab"), (5, texts[5]), (50, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    want = plain_variants(rows)
    got = sorted(map(tuple, spelling.variants(df).collect()), key=lambda r: r[0])
    assert got == want
    assert max(Counter(r[2] for r in want if r[1]).values()) > 3 and any(r[2] != r[1] for r in want if r[1])


def test_rounds_of_filters_give_the_same(spark, monkeypatch):
    words = [f"{a}{b}wordlike{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "abcdefghijklmnopqrstuvwxyz"]
    counts = spark.createDataFrame([(w, 2 + i % 60) for i, w in enumerate(words)], "word string, n long")
    one = sorted(map(tuple, spelling.group_variants(counts).collect()), key=repr)
    assert spelling.Filters({11: 2600}).total == 82
    monkeypatch.setattr(spelling, "SEGMENT", 16)
    assert sorted(map(tuple, spelling.group_variants(counts, filter_bytes=2 * 16 * spelling.BLOCK_BYTES).collect()), key=repr) == one  # three rounds


def test_filters_never_miss_a_word_and_hold_little_else():
    words = [f"w{i * 7919 % 99991:06d}xyz" for i in range(5000)]
    flat, filters = spelling.Flat(pa.array(words)), spelling.Filters({10: 5000})
    mixed = spelling._mixed(flat.hash)
    block = filters.block(flat.size, mixed)
    bits = np.zeros(filters.total * spelling.BLOCK_BITS, bool)
    for b in spelling._bits(mixed):
        bits[block * spelling.BLOCK_BITS + b] = True
    packed = np.packbits(bits, bitorder="little")
    assert len(spelling._holds(packed, 0, block, mixed)) == 5000
    other = spelling.Flat(pa.array([f"v{i:06d}abc" for i in range(20000)]))
    mixed = spelling._mixed(other.hash)
    assert len(spelling._holds(packed, 0, filters.block(other.size, mixed), mixed)) < 200


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "short words")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


# op12


def plain_top(rows, k=10):
    import math

    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * x) for x in v]
            own[i] = max(own.get(i, w), w)
    out = []
    for q in own:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(own[q], own[c])), c) for c in own if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


def vectors(n, dims, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([0.0, rnd.gauss(0, 1), -abs(rnd.gauss(0, 1))]) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(5, [1.0] * dims), (5, [0.5] * dims), (2000, None), (2100, [None] + [1.0] * (dims - 1)), (2200, [float("nan")] * dims), (2300, [float("inf")] * dims), (2400, [0.0] * dims), (2500, []), (2600, [1.0]), (None, [1.0] * dims), (2700, [9.0e4] * dims), (2700, [9.0e4] * dims)]
    return rows


@pytest.mark.parametrize("dims,weights", [(6, 10**6), (6, 900), (40, 3000)])
def test_top_k_equals_a_plain_version(spark, dims, weights):
    rows = vectors(700, dims, dims)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(3)
    got = maxscore.top_k(df, F.col("vec_id") % 100 == 0, shard_weights=weights)
    assert sorted(map(tuple, got.collect())) == plain_top(rows)


def test_search_leaves_out_what_cannot_win():
    """Windows after the first only look at rows that are competitive; the result is that of all products."""
    rnd = np.random.RandomState(3)
    m = np.where(rnd.rand(4000, 24) < np.linspace(0.02, 0.5, 24), rnd.randint(-500, 500, (4000, 24)), 0)
    index = maxscore.Postings(np.arange(4000), np.arange(0, 4001 * 24, 24), m.reshape(-1).astype(np.int64), window=256)
    asked = [0, 7, 3999]
    for q, (ids, scores) in zip(asked, index.search(np.array(asked), [m[q].astype(np.int64) for q in asked], 10)):
        s = m @ m[q]
        order = [i for i in np.lexsort((np.arange(4000), -s)) if i != q][:10]
        assert ids.tolist() == order and scores.tolist() == s[order].tolist()


def test_numbers_beyond_64_bits(spark):
    rows = [(i * 100, [1e15 * (i + 1), -3.0]) for i in range(3)] + [(1, [1e300, 0.0])]
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=2)
    assert {r["score"] for r in got.collect()} == {2**63 - 1} and got.count() == 6


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert maxscore.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert maxscore.top_k(spark.createDataFrame([(100, [1.0])], schema), F.col("vec_id") % 100 == 0).count() == 0
    two = spark.createDataFrame([(100, [-1.0]), (101, [1.0])], schema)
    assert [tuple(r) for r in maxscore.top_k(two, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 101, -(1024**2))]


# op13


def plain_collocations(rows, least=30, top=2000):
    n, f = Counter(), {}
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        c = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in c.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * c[p[i:j]]}
        found = []
        for p in set(c) - gone:
            score, k = min((2000000 * c[p] // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -c[p], " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def mixed_texts():
    rnd = random.Random(5)
    words = ["the", "of", "New", "york", "city", "a", "é", "日本", "x\x00y", "b-c", " "]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(n))
    rows = [("en", text(400)) for _ in range(12)] + [(None, text(500)), ("und", text(500)), ("de", text(3000)), ("fr", None), ("fr", ""), ("fr", ".,;"), ("es", "one two " * 10)]
    return rows + [rows[0]] * 3


@pytest.mark.parametrize("at_once,top", [(10**6, 2000), (7, 5)])
def test_collocations_equal_a_plain_version(spark, at_once, top):
    rows = mixed_texts()
    df = spark.createDataFrame([(i, t, lang, "p", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, a int").repartition(4)
    got = collocations.collocations(df, top=top, at_once=at_once)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, top=top)


def test_several_dictionaries_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PIECE", 50)
    text = mixed_texts()[0][1].encode()
    pieces = list(collocations._tokens(text))
    monkeypatch.undo()
    assert len(pieces) > 5 and [w for p in pieces for w in p if w] == [w for p in collocations._tokens(text) for w in p if w]
    monkeypatch.setattr(collocations, "WORDS_AT_ONCE", 4)
    rows = mixed_texts()
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], DOCUMENT)
    assert sorted(map(tuple, collocations.collocations(df).collect())) == plain_collocations(rows)


def test_nothing_is_frequent(spark):
    for rows in ([], [(1, None, None), (2, "a b c", "en"), (3, "word. " * 40, "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, DOCUMENT)).count() == 0


def test_walks_hand_on_the_next_level_alone():
    rnd = np.random.RandomState(3)
    ids = np.append(rnd.randint(0, 6, 4000), 0).astype(np.int32)
    pairs = np.array([(i, j) for i in range(1, 6) for j in range(1, 6) if i + j != 5], np.int32)
    trie = collocations.DoubleArray(pairs, 6)
    shared = SimpleNamespace(value=(trie.base, trie.check, trie.accept, trie.radix, trie.phrases))
    batch = pa.RecordBatch.from_arrays([pa.array([ids[:1000].tobytes() + bytes(4), ids[1000:].tobytes()], pa.binary())], names=["ids"])
    texts = [*ids[:1000].tolist(), 0, *ids[1000:].tolist()]
    known = set(map(tuple, pairs.tolist()))
    want = Counter(t for t in zip(texts, texts[1:], texts[2:]) if t[:2] in known and t[1:] in known)
    got = [r for out in collocations._walked(shared, 2, 0, 1)(iter([batch])) for r in out.to_pylist()]
    assert len(got) == len(want) > 50  # each candidate once, and no row for a pair, which is counted already
    assert {(r["a"] >> 32, r["a"] & 0xFFFFFFFF, r["b"] >> 32): r["f"] for r in got} == want


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**15
    phrases = spark.createDataFrame([(2, (1 << 32) | 2, 0, big - 1)], "k int, a long, b long, f long")
    words = spark.createDataFrame([(1, big), (2, big + 1)], "id int, f long")
    r = collocations.scored(phrases, words).first()
    assert (r["score"], r["l"], r["r"]) == (2000000 * (big - 1) // (2 * big + 1), big, big + 1)


@pytest.mark.parametrize("m,top,k", [(1, 1, 2), (300, 40, 2), (4000, 3000, 3), (6000, 90, 4)])
def test_double_array_holds_its_phrases_and_no_others(m, top, k):
    rnd = np.random.RandomState(m)
    phrases = np.unique((1 + top * rnd.rand(m, k) ** 3).astype(np.int32), axis=0)
    trie = collocations.DoubleArray(phrases, top + 1)
    ids = np.append(rnd.randint(0, top + 1, 5000), phrases[rnd.randint(0, len(phrases), 500)].reshape(-1)).astype(np.int32)
    got = collocations.walk(ids, (trie.base, trie.check, trie.accept, trie.radix), k)
    known = {tuple(p): i for i, p in enumerate(trie.phrases.tolist())}
    want = [known.get(tuple(ids[i : i + k].tolist()), -1) for i in range(len(ids))]
    assert got.tolist() == want and max(want) >= 0
    assert len(trie.base) < 60 * len(phrases) + 70_000
