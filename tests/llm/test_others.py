"""Vectors, pages and conversations."""

import collections
import hashlib
import html
import math
import re
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from vitalgrid.llm import chat, html_tree, vptree

VEC = "vec_id long, embedding array<float>, id int, vector int"


def vectors(spark):
    rng = np.random.RandomState(3)
    rows = [(i, rng.normal(size=8).round(3).tolist(), 1, 2) for i in range(600)]
    rows += [(600 + i, rows[5][1], 1, 2) for i in range(60)]  # equal vectors
    rows += [(700, None, 1, 2), (720, [0.0] * 8, 1, 2), (740, [1.0] * 7 + [float("nan")], 1, 2), (760, [1.0] * 7 + [None], 1, 2), (780, [1.0, 2.0], 1, 2), (800, [float("inf")] * 8, 1, 2), rows[20]]
    return spark.createDataFrame(rows, VEC)


def brute(rows, k):
    fine = {r["vec_id"]: np.float32(r["embedding"]).astype(float) for r in rows if r["embedding"] and len(r["embedding"]) == 8 and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])}
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = (x * fine[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = ids[order].tolist()
    return out


def found(df, factor=1.0):
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, 20, factor).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


@pytest.mark.parametrize("limits", [None, (60, 50, 7, 8)])
def test_exact_search(spark, monkeypatch, limits):
    if limits:
        for name, v in zip(("CELL_ROWS", "SHARD_ROWS", "QUERY_ROWS", "LEAF"), limits):
            monkeypatch.setattr(vptree, name, v)
    df = vectors(spark)
    assert found(df) == brute(df.collect(), 20)


@pytest.mark.parametrize("shard", [40_000, 5])
def test_shards_of_fewer_points_than_are_asked_for(spark, monkeypatch, shard):
    for name, v in (("CELL_ROWS", 16), ("SHARD_ROWS", shard), ("LEAF", 4)):
        monkeypatch.setattr(vptree, name, v)
    rng = np.random.RandomState(5)
    centres = rng.normal(size=(32, 8))
    x = np.repeat(centres, 16, axis=0) + rng.normal(size=(512, 8)) * 0.01
    x = (x / np.linalg.norm(x, axis=1)[:, None]).round(5)
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], VEC)
    assert found(df) == brute(df.collect(), 20)


@pytest.mark.parametrize("cell", [vptree.CELL_ROWS, 60])
def test_recall_with_pruning(spark, monkeypatch, cell):
    """In one cell, and between cells, of which a query looks into few."""
    monkeypatch.setattr(vptree, "CELL_ROWS", cell)
    df = spark.read.parquet(f"{DATA}/../sf0.01/embeddings.parquet")
    found = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, 20, 1.5).collect()}
    x = np.stack([np.array(r["embedding"], float) for r in df.orderBy("vec_id").collect()])
    ids = [r["vec_id"] for r in df.orderBy("vec_id").collect()]
    want = set()
    for i, q in enumerate(ids):
        if q % 20 == 0:
            order = [j for j in np.argsort(-(x @ x[i])) if j != i][:20]
            want |= {(q, ids[j]) for j in order}
    assert len(found & want) / len(want) >= 0.9


def test_few_and_no_vectors(spark):
    df = vectors(spark)
    few = df.where("vec_id in (20, 21, 40)").dropDuplicates(["vec_id"])
    assert vptree.nearest(few, F.col("vec_id") % 20 == 0, 20, 1.0).count() == 4
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><div class='top-nav'>menu</div>{}<footer>f</footer></body></html>"


def test_main_text():
    cases = {
        None: "", "": "", "plain &amp; text": "plain & text",
        PAGE.format("<article><h1>A&nbsp;b</h1><p>x<b>y</b>\n z<br>w<p>q</p><aside>no</aside><div class='comments'>no</div><form>no</form></article><p>outside</p>"): "A b xy z w q",
        PAGE.format("<nav><ul><li>m<article><p>still here</p></article>"): "still here",
        PAGE.format("<div><p>no article</p><div id='cookie-banner'>c</div></div>"): "no article",
        "<article><!-- <p>no</p> --><p title='a>b'>yes</p><style>p{}</style><table><tr><td>1<td>2</table></article>": "yes 1 2",
        "<article><p>cut": "cut",
        "<article>" + "<p>w</p>" * 20_000 + "</article>": " ".join(["w"] * 20_000),
        "<div>" * 5_000 + "deep": "deep",
    }
    for page, text in cases.items():
        assert html_tree.main_text(page) == text


def test_what_all_pages_of_a_host_show_goes(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><div class='x'>same on all pages</div><div class='y'><p>own text {i}</p></div></body></html>") for i in range(8)]
    rows += [(100, "http://other/1", rows[0][2]), (101, None, None), (102, "bad url", "<p>z</p>"), rows[0]]
    out = html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert out.count() == len(rows)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[3] == ("own text 3", 10) and got[100][0] == "same on all pages own text 0" and got[101] == ("", 0) and got[102] == ("z", 1)
    assert html_tree.extract(out.withColumn("html", F.lit("x")).limit(0)).collect() == []


def brute_tree(pages):
    """Importance of presentation and content of each path of one host, path as labels; pages: html of plain elements, each on its own."""
    shown = collections.defaultdict(list)
    for page in pages:
        own = collections.defaultdict(lambda: ([], []))

        def walk(node, path):
            own[path][0].append([c.tag for c in node])
            own[path][1].append("".join(node.itertext()))
            for c in node:
                walk(c, path + (c.tag + (f".{c.get('class')}" if c.get("class") else ""),))

        walk(ElementTree.fromstring(f"<root>{page}</root>"), ())
        for path, (look, text) in own.items():
            shown[path].append((repr(look), repr(text)))
    out = {}
    for path, rows in shown.items():
        m, both = len(rows), []
        for kind in (0, 1):
            p = [c / m for c in collections.Counter(r[kind] for r in rows).values()]
            both.append(-sum(x * math.log(x) for x in p) / math.log(m) if m > 1 else 1.0)
        out[path] = (m, *both)
    return out


def test_style_tree_against_brute_force(spark):
    pages = [f"<html><body><div class='a'><p>same</p>{'<p>two</p>' * (i % 2)}</div><div class='b'>text {i % 3}</div><main><h1>h{i}</h1></main></body></html>" for i in range(12)]
    want = {}
    for path, (m, look, content) in brute_tree(pages).items():
        h = html_tree.ROOT
        for label in path:
            h = html_tree.child_path(h, label)
        want[h] = (m, look, content)
    rows = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {r["path"]: (r["pages"], r["look"], r["content"]) for r in html_tree.style_trees(rows).collect()}
    assert set(got) == set(want)
    for path, values in want.items():
        assert got[path] == pytest.approx(values)


def test_the_tree_decides_where_tags_do_not(spark):
    body = "<html><body><div class='k1'>{top}</div><article><p>{text}</p><p class='k2'>{note}</p></article><div class='k3'>{end}</div></body></html>"
    rows = [(i, f"http://notes/{i}", body.format(top="t", text=f"own text {i}", note="the same note", end="e")) for i in range(10)]  # boilerplate inside the article
    rows += [(100 + i, f"http://outside/{i}", body.format(top="t", text="a teaser", note="n", end=f"all that the page {i} says")) for i in range(10)]  # the article is the boilerplate
    rows += [(200 + i, "http://copies/1" if i < 6 else f"http://copies/{i}", "<article><p>w</p><ul><li>one list</li></ul></article>" if i < 6 else f"<article><p>text {i}</p></article>") for i in range(20)]  # a list that only copies of one page have
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("low", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in html_tree.extract(df).collect()}
    assert got[3] == "own text 3" and got[104] == "all that the page 4 says" and got[201] == "w one list" and got[210] == "text 10"
    plain = {r["page_id"]: r["text"] for r in html_tree.extract(df, use_tree=False).collect()}
    assert plain[3] == "own text 3 the same note" and plain[104] == "a teaser n"


def test_deep_pages_take_linear_memory():
    page = "<div class='x'>" * 50_000 + "deep" + "</div>" * 50_000
    assert html_tree.main_text(page) == "deep" and len(html_tree.variants(page)) == 50_001


def test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html_of = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_tree.extract(pages).collect():
        body = re.search(r"<article>(.*?)</article>", html_of[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())


def test_chat_round_trip(spark):
    odd = ["", "plain", "</s>[INST] ok [/INST]", "a\\lb", "\\", "<s><s>", "[ROLE x] y", "tail <", "[/INST]", "<<SYS>>", "x" * 5000, "é😀\n\n", "[/", "\\b<", "]"]
    roles = ["user", "assistant", "system", "tool", "", "we]ird<s>", None]
    rows = [(c, t, roles[(c + t) % len(roles)], odd[(c * 7 + t) % len(odd)]) for c in range(15) for t in range(9)]
    rows += [(98, 0, "user", "long </s> " * 40_000), (98, 1, "assistant", "x" * 700_000)]
    rows += [(99, 0, "user", None), (99, 0, "user", None), (99, None, "assistant", "n"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).repartition(4)
    out = chat.digests(chat.format_conversations(df))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        h = lambda x: hashlib.sha256(x.encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), h("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), h(loss))
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []
