"""Operators on documents against plain versions, on rows with every odd case."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.conftest import prose, some_documents
from vitalgrid.llm import backoff_lm, licenses, mixing, ngram_join, quality, sentencepiece_codec, suffix_dedup
from vitalgrid.llm.registry import piece_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts():
    return {i: t or "" for i, t, _ in some_documents()}


def test_encoding_equals_the_library(spark, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    out = sentencepiece_codec.encode_digests(documents, piece_model())
    assert out.count() == documents.count()
    for i, r in by_id(out).items():
        ids = sp.encode(texts()[i])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(documents, piece_model()), piece_model())
    for r in both.collect():
        assert r["ids"] == sp.encode(r["text"] or "") and r["decoded"] == sp.decode(r["ids"])


def test_decoding_of_broken_bytes(spark):
    own = sentencepiece_codec.codec(piece_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for ids in ([], [1, 2], [0], [203], [203, 155], [230, 153, 168], [203, 1, 155], [29871, 29871], [1, 29871, 200]):
        assert own.decode(ids) == sp.decode(ids)
    with pytest.raises(IndexError):
        own.decode([32000])


def test_quality_counts_and_verdicts(spark, documents):
    out = quality.judge(documents)
    assert out.count() == documents.count()
    for i, r in by_id(out).items():
        t = texts()[i]
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base)
        assert not (base and r["kept"])


def test_a_bad_host_takes_its_clean_documents_along(spark):
    bad = [(i, "x y", "bad") for i in range(40)] + [(40, prose(1, 50), "bad")]
    good = [(100 + i, prose(i, 50), "good") for i in range(40)] + [(200, "x", "good")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(bad + good, "doc_id long, text string, source string")).collect()}
    assert not kept[40] and kept[100] and not kept[200]


def components(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


@pytest.mark.parametrize("limits", [None, (500, 700), (1, 40)])
def test_similarity_join(spark, documents, monkeypatch, limits):
    if limits:  # the ways for large groups
        monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", limits[0])
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", limits[1])
    extra = spark.createDataFrame([(1000 + i, " ".join(f"w{k + (k in range(i, i + 9)) * 1000 * (i % 5)}" for k in range(150 + i % 7)), "s") for i in range(30)], "doc_id long, text string, source string")
    docs = documents.select("doc_id", "text", "source").unionByName(extra)
    all_texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sets = {i: shingles(t) for i, t in all_texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(links, sets)
    out = ngram_join.link_classes(docs)
    assert out.count() == docs.count()
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(out).items()} == {i: (len(sets[i]), want[i]) for i in sets}

@pytest.mark.parametrize("group_docs", [None, 1])
def test_links_of_documents_that_counting_cannot_rule_out(spark, monkeypatch, group_docs):
    passage = [f"p{k}" for k in range(400)]
    often = np.zeros((2, ngram_join.COUNTERS), bool)
    for row, cells in zip(often, ngram_join._cells(ngram_join.shingle_sets([" ".join(passage)])[0])):
        row[cells] = True
    monkeypatch.setattr(ngram_join, "frequent", lambda counts: often)
    if group_docs:  # few pairs meet in the first round
        monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", group_docs)
    rows = []
    for i in range(16):
        a = [f"a{i}_{k}" for k in range(603)] + passage
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a + [f"b{i}_{k}" for k in range(140)]))]
    batch = pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["id", "text"]))
    dealt = pd.concat(x.to_pandas() for x in ngram_join._dealt(np.packbits(often).tobytes(), ngram_join.SHINGLE, ngram_join.PERCENT)(iter([batch])))
    need = dealt.groupby("hi")["need"].max()
    needs = [need[ngram_join._key(ngram_join.shingle_sets([t])[0])[0]] for _, t in rows]
    assert sum((a > 0) != (b > 0) for a, b in zip(needs[::2], needs[1::2])) >= 5  # one of both kinds
    out = by_id(ngram_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in out.items()} == {i: i // 2 * 2 for i, _ in rows}


@pytest.mark.parametrize("contexts", [48, 1])
def test_repeats_are_cut(spark, documents, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 5000)
    out = by_id(suffix_dedup.digests(documents))
    cut = by_id(suffix_dedup.cut_text(documents))
    seen = set()
    for i, t in sorted(texts().items()):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), runs, sha(kept))
        if kept.decode("utf-8", "ignore").encode() == kept:
            assert (cut[i]["text"] or "").encode() == kept


def test_rows_of_one_id_with_different_texts(spark):
    a, b, p = prose(1, 60), prose(2, 60), prose(3, 60)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, p), (4, b[:50] + p)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.link_classes(docs.where("doc_id < 4")).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    cut = suffix_dedup.digests(docs).collect()
    assert len(cut) == 6 and all(r["n_removed"] == 0 for r in cut if r["doc_id"] == 1) and all(r["n_removed"] >= 100 for r in cut if r["doc_id"] in (2, 3))


def test_suffix_arrays_of_small_alphabets():
    import itertools

    import numpy as np

    blocks = [np.array(x) for n in range(7) for x in itertools.product(range(2), repeat=n)] + [np.array([0, 1] * 40), np.array([3] * 50)]
    for b, sa in zip(blocks, suffix_dedup.suffix_arrays(blocks)):
        x = b.tolist()
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_mixing(spark, documents):
    out = mixing.mix(documents)
    assert out.count() == documents.count()
    size = [(i, s, len(WORD.findall(t or ""))) for i, t, s in some_documents()]
    total = collections.Counter()
    for _, s, n in size:
        total[s] += n
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]:
        for s in over:
            target[s] = 2.0 * total[s]
            free.discard(s)
        left = 1.5 * sum(total.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = collections.Counter()
    for r in out.collect():
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == total[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan

def test_a_budget_that_ends_with_a_document(spark):
    digest = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    groups = {}
    for shift, n in ((48, 6), (36, 2)):  # ids that share the bucket of the first, and of the second histogram
        found = collections.defaultdict(list)
        for i in range(1, 60_000):
            own = found[digest(i) >> shift]
            own.append(i)
            if len(own) == n:
                groups[shift] = own
                break
    assert set(groups) == {48, 36}
    for ids in groups.values():
        out = by_id(mixing.mix(spark.createDataFrame([(i, "five words in each text", "s") for i in ids], "doc_id long, text string, source string")))
        first = sorted(ids, key=digest)[: len(ids) // 2]
        assert {i: out[i]["taken"] for i in ids} == {i: 10 if i in first else 5 for i in ids}


def test_backoff_scores(spark, documents):
    model, floor = backoff_lm.train(documents)
    out = by_id(backoff_lm.score(documents.dropDuplicates(["doc_id"]), model, floor))
    one, two = collections.Counter(), collections.Counter()
    for _, t, _ in some_documents():
        w = WORD.findall(t or "")
        one.update(w), two.update(zip(w, w[1:]))
    one, two = ({k: c for k, c in x.items() if c >= backoff_lm.MIN_COUNT} for x in (one, two))
    total = sum(one.values())
    unknown = math.log(backoff_lm.MIN_COUNT / (2 * total))
    for i, t in texts().items():
        w, s = WORD.findall(t), 0.0
        for k, x in enumerate(w):
            single = math.log(one[x] / total) if x in one else unknown
            pair = (w[k - 1], x) if k else None
            s += math.log(two[pair] / one[w[k - 1]]) if pair in two else single + (math.log(0.4) if k else 0)
        assert out[i]["n_words"] == len(w)
        assert out[i]["log_score"] is None if not w else math.isclose(out[i]["log_score"], s / len(w), abs_tol=1e-4)

@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("head", [None, 5])
def test_backoff_keeps_every_count(spark, documents, monkeypatch, order, head):
    if head:  # nearly all n-grams take the way of rare ones
        monkeypatch.setattr(backoff_lm, "HEAD", head)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "one two three"), (90, "seen once"), (91, "seen once more"), (92, "a")], "doc_id long, text string"))
    words = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in docs.collect()]
    counts = collections.Counter(tuple(w[k : k + n]) for _, w in words for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def plain(w):
        s = 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                if c := counts[tuple(w[k - n + 1 : k + 1])]:
                    s += math.log(c / (counts[tuple(w[k - n + 1 : k])] if n > 1 else total))
                    break
                s += math.log(0.4) if n > 1 else math.log(1 / (2 * total))
        return s / len(w)

    rows = backoff_lm.score_corpus(docs, order=order).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    want = sorted(((i, len(w), plain(w) if w else None) for i, w in words), key=key)  # repeated rows and those without an id too
    assert len(rows) == len(want)
    for r, (i, n, score) in zip(sorted(map(tuple, rows), key=key), want):
        assert r[:2] == (i, n) and (r[2] is None if score is None else math.isclose(r[2], score, abs_tol=1e-4))
    if not head and order == 2:  # a model of one corpus for texts of another
        others = {1: "one two", 2: "seen once", 3: "seen never", 4: "once seen once more", 5: "a b"}
        model, floor = backoff_lm.train(docs)
        for i, r in by_id(backoff_lm.score(spark.createDataFrame(list(others.items()), "doc_id long, text string"), model, floor)).items():
            assert math.isclose(r["log_score"], plain(others[i].split()), abs_tol=1e-4)


def cross_scores(rows, order):
    """(id, words, score) of each row under the stupid-backoff model of the texts whose crc32 is odd, or even, where its own is not."""
    half = lambda t: zlib.crc32(t.encode("utf-8")) & 1
    counts = [collections.Counter(), collections.Counter()]
    for _, t in rows:
        w = WORD.findall(t or "")
        counts[half(t or "")].update(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    totals = [max(1, sum(c for g, c in x.items() if len(g) == 1)) for x in counts]
    out, backed = [], 0
    for i, t in rows:
        w, s = WORD.findall(t or ""), 0.0
        known, total = (x[1 - half(t or "")] for x in (counts, totals))
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                if c := known[tuple(w[k - n + 1 : k + 1])]:
                    s += math.log(c / (known[tuple(w[k - n + 1 : k])] if n > 1 else total))
                    break
                backed += n > 1
                s += math.log(0.4) if n > 1 else math.log(1 / (2 * total))
        out.append((i, len(w), s / len(w) if w else None))
    return out, backed


def same_scores(got, want):
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and (g[2] is None if w[2] is None else math.isclose(g[2], w[2], abs_tol=1e-4))


@pytest.mark.parametrize("order, words", [(1, None), (2, None), (2, 0), (2, 300), (3, None)])  # with few words broadcast the counts of the others are joined
@pytest.mark.parametrize("head", [None, 5])
def test_each_half_is_scored_by_the_other(spark, documents, monkeypatch, order, words, head):
    if head:  # nearly all n-grams are looked up by the join
        monkeypatch.setattr(backoff_lm, "HEAD", head)
    if words is not None:
        monkeypatch.setattr(backoff_lm, "WORDS", words)
    odd = [(None, "one two three"), (90, "seen once"), (90, "another text of one id"), (91, "seen once more"), (92, "a"), (93, prose(3, 3_000)), (94, prose(4, 3_000)), (94, prose(4, 3_000))]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want, backed = cross_scores([tuple(r) for r in docs.collect()], order)
    assert order == 1 or backed > 1_000
    same_scores(backoff_lm.cross_score(docs, order=order).collect(), want)
    assert backoff_lm.cross_score(docs.limit(0), order=order).count() == 0


def test_pairs_with_one_rarer_word_are_settled_without_a_join(spark, monkeypatch):
    """All of a rarer word are in the bucket that its pairs come to."""
    monkeypatch.setattr(backoff_lm, "WORDS", 1)
    monkeypatch.setattr(backoff_lm, "HEAD", 0)
    written, write = [], backoff_lm.materialize

    def kept(df, label="step"):
        out = write(df, label)
        if label == "added":
            written.append(out.where("kind >= 3").count())
        return out

    monkeypatch.setattr(backoff_lm, "materialize", kept)
    for texts, asked in (["the " + " the ".join(f"w{i * k % 7}" for i in range(12)) for k in range(1, 13)], False), ([f"x{k} w1 w2 w3" + " the" * 9 for k in range(1, 13)], True):
        rows = list(enumerate(texts))
        got = backoff_lm.cross_score(spark.createDataFrame(rows, "doc_id long, text string"), order=2).collect()
        same_scores(got, cross_scores(rows, 2)[0])
        assert (written[-1] > 0) == asked


def test_the_backoff_query_holds_each_half_against_the_other(spark, tmp_path):
    from vitalgrid.llm.registry import queries

    rows = [(i, f"rare word {i % 4} and another one {i}" + " rare word" * (i % 3)) for i in range(40)] + [(None, None), (50, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("row", F.lit("x"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    same_scores(queries()["op7_backoff_lm"](spark, str(tmp_path)).collect(), cross_scores(rows, backoff_lm.ORDER)[0])


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT", "grant"]
    words = mit.split()
    edited = " ".join(words[:30] + ["indeed"] + words[31:])
    rows = [(1, None), (2, ""), (3, "x\nReleased under the MIT License.\ny Licensed under CC BY-NC 4.0. Released under the MIT License!"), (4, "é " * 200 + edited + " tail"), (5, "licensed under the sky"), (6, prose(1, 30_000) + "\n" + mit)]
    rows += [(7, "This work is really licensed under the GNU Public License, version 3."), (8, "Licensed under the Apache License, Version 1.0."), (9, "Licensed under CC BY-NC-ND 4.0."), (10, licenses.TEMPLATES["Apache-2.0", "header"]), (11, licenses.TEMPLATES["BSD-3-Clause", "text"])]
    rows += [(None, "Licensed under the MIT License."), (3, rows[2][1])]
    docs = spark.createDataFrame([(i, t, "a", 1, 2.0) for i, t in rows], "doc_id long, text string, license string, start int, coverage double")
    got = collections.defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]].append((r["license"], r["form"], r["start"], dict(rows)[r["doc_id"]][r["start"] : r["end"]], r["coverage"]))
    assert set(got) == {None, 3, 4, 6, 7, 10, 11}
    assert sorted(x[:2] for x in got[3]) == [("CC-BY-NC-4.0", "notice")] * 2 + [("MIT", "notice")] * 4  # a repeated row
    assert [x[3] for x in got[4]] == [edited.rstrip(".")] and got[4][0][2] == 400 and 0.98 < got[4][0][4] < 1
    assert got[6][0][3] == mit.rstrip(".")
    assert [x[:2] for x in got[7]] == [("GPL-3.0", "notice")] and got[7][0][4] < 1
    assert [x[:2] for x in got[10]] == [("Apache-2.0", "header")] and [x[:2] for x in got[11]] == [("BSD-3-Clause", "text")]


@pytest.mark.parametrize("before", [0, 70, 100, 130, 160, 200, 300, 420])
def test_a_license_at_the_end_of_a_part_is_reported_once(before):
    index = licenses.Index({("A", "text"): prose(8, 60), ("B", "notice"): "Licensed under the MIT License."})
    text = prose(1, before) + " " + prose(8, 60) + " " + prose(2, 500)
    got = licenses.find(text, index, at_once=8)
    assert [(h[0], h[2], text[h[4] : h[5]]) for h in got] == [("A", 1.0, prose(8, 60))]


def test_alignments_against_brute_force():
    """Every template against a whole text, without fingerprints and bands."""
    rng = np.random.RandomState(1)
    templates = {("A", "t"): prose(8, 40), ("B", "t"): prose(9, 25), ("C", "n"): "Released under the MIT License.", ("D", "n"): "Licensed under CC BY-NC 4.0.", ("E", "n"): "public domain"}
    index = licenses.Index(templates)
    for _ in range(40):
        words, want = prose(int(rng.randint(1000)) + 50, 30).split(), []
        for name, t in templates.items():
            own = t.split()
            for _ in range(int(rng.randint(3)) if len(own) > 20 else 0):  # change, drop or add words far from each other
                at = int(rng.randint(5, len(own) - 5))
                own[at : at + int(rng.randint(2))] = ["odd"] * int(rng.randint(2))
            if rng.randint(2):
                words += own + prose(int(rng.randint(1000)) + 50, int(rng.randint(25, 40))).split()
                want.append(name)
        text = " ".join(words)
        codes = licenses._word_codes(licenses.plain(text).split()).tolist()
        plain = set()
        for t, name in enumerate(index.names):
            same, telling, first, last = licenses.align(index.words[t].tolist(), codes, 0, 0, len(codes), index.apart)
            if index.holds(t, codes, same, telling, first, last, 0.8):
                plain.add((name, same, first, last))
        offsets = [m.span() for m in re.finditer(rb"\S+", licenses.plain(text))]
        assert {((h[0], h[1]), h[3], h[4], h[5]) for h in licenses.find(text, index)} == {(name, same, offsets[a][0], offsets[b][1]) for name, same, a, b in plain}
        assert {name for name, *_ in plain} == set(want)


@pytest.mark.parametrize("run", [lambda d: sentencepiece_codec.encode_digests(d, piece_model()), quality.judge, ngram_join.link_classes, suffix_dedup.digests, suffix_dedup.cut_text, mixing.mix, licenses.scan, lambda d: backoff_lm.score(d, *backoff_lm.train(d))])
def test_empty_table(documents, run):
    assert run(documents.limit(0)).collect() == []
