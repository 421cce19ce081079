"""The pipeline against a plain version of it on a small corpus."""

import collections
import hashlib
import math
import re

import sentencepiece

import corpus_pipeline
from tests.llm.conftest import prose, some_documents
from tests.llm.test_documents import WORD, components
from vitalgrid.llm import quality
from vitalgrid.llm.registry import piece_model


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(rows):
    """rows: (doc_id, text, source); ids are unique or null, but for repeated rows."""
    marked = []
    for i, t, s in rows:
        w = WORD.findall(t or "")
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        marked.append((i, t, s, len(w) < 20 or 100 * len(covered) > 30 * len(w) or 100 * symbols > 30 * len(w)))
    hosts = collections.defaultdict(list)
    for _, _, s, bad in marked:
        hosts[s].append(bad)
    n, k = len(marked), len(hosts)
    mean = sum(m[3] for m in marked) / n
    within = mean * (1 - mean)
    between = max(0, max(0, sum(len(v) * (sum(v) / len(v)) ** 2 for v in hosts.values()) / n - mean * mean) - within * k / n)
    strength = min(max(within / between - 1 if between > 0 and within > between else 100, 1), 1000)
    rate = {s: (sum(v) + mean * strength) / (len(v) + strength) for s, v in hosts.items()}
    docs = [(i, t, s) for i, t, s, bad in marked if not bad and rate[s] < quality.HOST_LIMIT]

    sets = {i: shingles(t) for i, t, _ in docs if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = components(links, sets)
    docs = [d for d in docs if d[0] is None] + list(dict.fromkeys(d for d in docs if d[0] is not None and first[d[0]] == d[0]))

    seen, cut = set(), []
    for i, t, s in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        b = t.encode()
        if i is None:  # loses nothing, and nothing is lost to it
            cut.append((i, t, s))
            continue
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        parts, run = [], bytearray()
        for x, g in zip(b, gone):
            if g:
                parts.append(bytes(run))
                run = bytearray()
            else:
                run.append(x)
        cut.append((i, "".join(p.decode("utf-8", "ignore") for p in [*parts, bytes(run)]), s))

    size = {d: len(WORD.findall(d[1])) for d in cut}
    total = collections.Counter()
    for d in cut:
        total[d[2]] += size[d]
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, target, free = 1.5 * sum(total.values()), {}, set(names)
    while over := [s for s in free if (want - sum(target.values())) * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]:
        target |= {s: 2.0 * total[s] for s in over}
        free -= set(over)
    left = want - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out = []
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for s in names:
        copies = math.floor(target[s] / total[s]) if total[s] else 0
        rest = math.floor(target[s] - copies * total[s] + 0.5)
        own = sorted((d for d in cut if d[2] == s), key=lambda d: hashlib.md5(("" if d[0] is None else str(d[0])).encode()).hexdigest()[:15])
        for d in own:
            extra = max(0, min(size[d], rest))
            rest -= size[d]
            if size[d]:
                times = math.floor((copies * size[d] + extra) / size[d] + 0.5)
                out += [(d[0], s, tuple(sp.encode(d[1])))] * times
    return sorted(out, key=repr)


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = some_documents() + [(None, prose(90, 50), "src1"), (None, "x", "src1")]  # repeated rows, and rows without an id of which one is rejected
    rows += [(300 + i, prose(400 + i, 60) + "\n" + prose(3, 60), f"src{i % 3}") for i in range(6)] + [(320 + i, "bad " * 3, "junk") for i in range(30)] + [(351, prose(77, 80), "junk")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted(((r["doc_id"], r["source"], tuple(r["ids"])) for r in out.collect()), key=repr)
    assert got == plain(rows) and all(r["lossless"] for r in out.collect())
    ids = {g[0] for g in got}
    assert 351 not in ids and not ids & {1, 2, 3, 5, 7} and 4 in ids


def test_stages_keep_columns_and_take_empty_tables(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, documents.limit(0), "")
        assert out.collect() == [] and (k == 4 or out.columns == corpus_pipeline.COLUMNS)


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, prose(1, 40)), (1, prose(1, 40)), (2, prose(1, 40)), (None, prose(1, 40)), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=str) == [1, 3, 4, None]


def test_near_copies_share_80_per_cent_of_five_word_shingles(spark):
    def words(name, n):
        return [f"{name}{k}" for k in range(n)]

    def changed(own, places):
        return [f"new{k}" if k in places else w for k, w in enumerate(own)]

    rows = []
    for i, name in enumerate("abcd"):
        own = words(name, 200)
        other = [own + words("longer", 40), own + words("far", 52), changed(own, (20, 60, 100, 140)), changed(own, (20, 50, 80, 110, 140))][i]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]

    def linked(a, b):
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
        return 100 * len(a & b) >= 80 * len(a | b)

    want = {i for i, t in rows if not i % 2 or not linked(rows[i - 1][1], t)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want == {0, 2, 3, 4, 6, 7}
