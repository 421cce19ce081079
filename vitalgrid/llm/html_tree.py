"""Main text of web pages by a site style tree.

The pages of a host are merged to one tree: elements of equal tag, class and id (longer numbers apart) below equal parents are one
node.  Of each node the tree counts the variants its pages show: presentations (the tags below it) and contents (the text
below it).  A node's importance is the entropy of its variants, as a share of what as many different pages would give; a
branch that looks and reads alike on most pages of a host that else differ is boilerplate, wherever it stands.

Tags decide only where entropy cannot: what a tag or class calls a menu, form or comment is no main text however it varies;
and where a host has articles, text outside them goes with the menus, unless the tree finds that what varies from page to
page stands mostly outside: then articles are elements like others.  Pages are read again without what is left out.

Edge cases: null or empty html gives an empty text; a page without a host shares a tree with others of that kind; text
of hosts of few pages is judged by tags and classes alone; unclosed and nested elements are closed as browsers do, and
an article ends any unclosed menu; very long and very deep pages are read in whole, in time that grows with their length;
a quote that nothing closes is no quote; repeated rows give equal rows; rows
without an id are rows like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frees, materialize, small, text_parts

#: Pages of a host from which its tree counts, importance below which a branch goes, and that for branches inside an article.
MIN_PAGES, LOW, LOW_INSIDE = 5, 0.5, 0.2
#: Elements without main text, words of class and id that say so, elements whose text is not markup, void
#: elements, and elements that do not end a block.
NOISE_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu title".split())
NOISE_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header login menu nav navbar navigation newsletter notice notices popup promo related reply replies share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
MAIN_TAGS = frozenset(("article", "main"))
#: An opening tag ends an open element of these, if that stands between it and the nearest of the barriers.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIERS = frozenset("table ul ol dl article main section div body".split())

#: Words that, beside noise words, may stand in a class name inside an article that says the element holds no main text.
HOLDER_WORDS = frozenset("area bar block box button buttons container content form group icon icons inner item items link links list module outer panel post posts row section widget wrap wrapper".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")


#: Path of the root of every tree.
ROOT = 0
_DIGITS = re.compile(r"\d{2,}")


class _Node:
    __slots__ = ("path", "tag", "noise", "main", "parts", "below")

    def __init__(self, path: int, tag: str, noise: bool, main: bool):
        self.path, self.tag, self.noise, self.main = path, tag, noise, main
        self.parts: list = []  # strings and nodes
        self.below = xxhash.xxh3_64()


def child_path(path: int, label: str) -> int:
    """Hash of the labels from the root down: of one size at any depth."""
    h = xxhash.xxh3_64_intdigest(f"{path}/{label}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _says_noise(names: str, main: bool) -> bool:
    """Whether a class or id says that an element holds no main text: by any word of it, inside an article only by a whole name made of such words."""
    if not main:
        return not NOISE_WORDS.isdisjoint(_NAME.findall(names))
    for name in names.split():
        words = set(_NAME.findall(name))
        if words & NOISE_WORDS and words <= NOISE_WORDS | HOLDER_WORDS:
            return True
    return False


def _attributes(text: str, main: bool) -> tuple[str, bool]:
    """A label of class and id, and whether they say that the element holds no main text."""
    if not text or text == "/":
        return "", False
    label, noise = "", False
    for name, a, b, c in _ATTR.findall(text):
        name, value = name.lower(), (a or b or c)
        if name in ("class", "id"):
            label += ("." if name == "class" else "#") + _DIGITS.sub("0", " ".join(value.split()))
            noise |= _says_noise(value.lower(), main)
        elif name == "role":
            noise |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        else:
            noise |= name == "hidden" or value.lower() == "true"
    return label, noise


class _Pages:
    """The markup of a page, read once from its start to its end."""

    def __init__(self, page: str):
        self.page, self.quotes, self.next = page, "\"'", {}

    def tokens(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        """(start, end, tag or None, whether it closes, attributes) of what is markup; a reader may set ``at`` forward."""
        self.at = 0
        while True:
            m = _MARKUP.search(self.page, self.at)
            if m is None:
                return
            if m[2] is None:
                self.at = m.end()
                yield m.start(), m.end(), None, False, ""
                continue
            end = self._end(m.end())
            if end < 0:  # no tag ends any more
                return
            self.at = end
            yield m.start(), end, m[2].lower(), bool(m[1]), self.page[m.end() : end - 1]

    def _end(self, start: int) -> int:
        """Where a tag ends: behind the next > outside quotes. A quote that nothing closes counts no more on this page, and none if no tag can end."""
        at = start
        while self.quotes:
            at = _PLAIN.match(self.page, at).end()
            if at == len(self.page):
                self.quotes = ""
            elif self.page[at] == ">":
                return at + 1
            elif self.page[at] not in self.quotes:
                at += 1
            else:
                close = self.page.find(self.page[at], at + 1)
                if close < 0:
                    self.quotes = self.quotes.replace(self.page[at], "")
                at = close + 1 or start
        return self.page.find(">", start) + 1 or -1

    def ahead(self, what: re.Pattern) -> re.Match | None:
        """The first match from here on; each part of the page is searched once for each pattern."""
        known = self.next.get(what)
        if known is None or (known is not False and known.start() < self.at):
            known = self.next[what] = what.search(self.page, self.at) or False
        return known or None


_BLOCK = re.compile(r"<(?:p|div|article|main)[\s>]")
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TAGS | INLINE_TAGS}


def parse(page: str) -> _Node:
    """The tree of a page, in which inline elements are dissolved and character references are decoded."""
    root = _Node(ROOT, "", False, False)
    stack, done, open_ = [root], 0, Counter()
    markup = _Pages(page)

    def cut(k: int) -> None:
        open_.subtract(n.tag for n in stack[k:])
        del stack[k:]

    for start, end, tag, closes, attributes in markup.tokens():
        if start > done:
            stack[-1].parts.append(page[done:start])
        done = end
        if tag is None:
            continue
        if closes:
            if tag in INLINE_TAGS:
                continue
            if tag == "br" or tag == "p" and open_["p"] <= 0:
                stack[-1].parts.append(" ")
            elif open_[tag] > 0:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in INLINE_TAGS and tag not in VOID_TAGS:
            if _attributes(attributes, stack[-1].main)[1]:  # an inline element that holds no main text
                close, block = markup.ahead(_CLOSE[tag]), markup.ahead(_BLOCK)
                if close and not (block and block.start() < close.start()):
                    markup.at = done = close.end()
            continue
        if tag in VOID_TAGS:
            if tag not in INLINE_TAGS:
                stack[-1].parts.append(" ")
            continue
        if tag in MAIN_TAGS and stack[-1].noise and not stack[-1].main:
            k = len(stack)
            while k > 1 and stack[k - 1].noise:
                k -= 1
            cut(k)
        ends = ("p",) if tag in ENDS_P else CLOSES.get(tag, ())
        if any(open_[e] > 0 for e in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    cut(k)
                    break
                if stack[k].tag in BARRIERS:
                    break
        top = stack[-1]
        label, noise = _attributes(attributes, top.main)
        main = top.main or tag in MAIN_TAGS
        noise = top.noise or tag in NOISE_TAGS or (noise and tag not in ("html", "body") and tag not in MAIN_TAGS) or (tag == "header" and not top.main)
        node = _Node(child_path(top.path, tag + label), tag, noise, main)
        top.parts.append(node)
        top.below.update(f"{tag}{label} ".encode("utf-8", "surrogatepass"))
        if tag in RAW_TAGS:
            close = markup.ahead(_CLOSE[tag])
            markup.at = done = close.end() if close else len(page)
        else:
            stack.append(node)
            open_[tag] += 1
    if done < len(page):
        stack[-1].parts.append(page[done:])
    return root


def _collect(node: _Node, out: list[str], low: frozenset, low_inside: frozenset) -> None:
    """Text of the tree in page order, without noise and low branches."""
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.noise and x.path not in (low_inside if x.main else low):
            out.append(" ")
            todo.append(" ")
            todo.extend(reversed(x.parts))


def main_text(page: str | None, low: frozenset = frozenset(), low_inside: frozenset = frozenset(), open_: bool = False) -> str:
    """The text of a page without the low paths of its host, and without what stands outside its articles unless the host's tree is ``open_``."""
    if not isinstance(page, str) or not page:
        return ""
    root = parse(page)
    has_main, todo = False, [] if open_ else [root]
    while todo and not has_main:
        x = todo.pop()
        has_main = x.main and not x.noise
        todo.extend(p for p in x.parts if not isinstance(p, str))
    out: list[str] = []
    if has_main:  # what stands outside the article is no part of it
        todo = [root]
        while todo:
            x = todo.pop()
            if x.noise:
                continue
            if x.main:
                _collect(x, out, low, low_inside)
                out.append(" ")
            else:
                todo.extend(reversed([p for p in x.parts if not isinstance(p, str)]))
    else:
        _collect(root, out, low, low_inside)
    return " ".join(_html.unescape("".join(out)).split())


def variants(page: str | None) -> dict[int, tuple[int, int, bool, bool, int]]:
    """Of each node of the page's tree: hash of its presentation, hash of its content, whether it is inside an article, whether tags call it noise, and characters of its own text."""
    if not isinstance(page, str) or not page:
        return {}
    root = parse(page)
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(p for p in x.parts if not isinstance(p, str))
    content: dict[int, int] = {}
    merged: dict[int, list] = {}
    for x in reversed(order):  # children before parents
        h, chars = xxhash.xxh3_64(), 0
        for p in x.parts:
            if isinstance(p, str):
                p = p.strip()
                chars += len(p)
                h.update(p.encode("utf-8", "surrogatepass"))
            else:
                h.update(content.pop(id(p)).to_bytes(8, "little"))
        content[id(x)] = h.intdigest()
        own = merged.setdefault(x.path, [xxhash.xxh3_64(), xxhash.xxh3_64(), x.main, x.noise, 0])
        own[0].update(x.below.digest()), own[1].update(h.digest())
        own[4] += chars
    return {path: (a.intdigest(), b.intdigest(), main, noise, chars) for path, (a, b, main, noise, chars) in merged.items()}


_COUNTED = "host string, path long, inside boolean, noise boolean, kind int, variant long, pages long, chars long"


@frees
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each variant of each node of some pages: kind 0 its presentation, 1 its content."""
    names = [x.split()[0] for x in _COUNTED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for part in (part for batch in batches for part in text_parts(batch, "html")):
        count: dict[tuple, list[int]] = {}
        for host, page in zip(part["host"].to_pylist(), part["html"].to_pylist()):
            for path, (look, text, main, noise, chars) in variants(page).items():
                for kind, v in ((0, look), (1, text)):
                    own = count.setdefault((host, path, main, noise, kind, v - (1 << 64) if v >> 63 else v), [0, 0])
                    own[0] += 1
                    own[1] += chars * kind
        columns = [*zip(*count)] + [*zip(*count.values())] if count else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def style_trees(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """host, path, inside, noise, pages, look, content and chars: of each node of each host's tree the importance, 0 to 1, of its presentation and content, and all characters of its own text."""
    src = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    seen = src.mapInArrow(_counted, _COUNTED)
    node = ["host", "path", "inside", "noise"]
    seen = seen.groupBy(*node, "kind", "variant").agg(F.sum("pages").alias("c"), F.sum("chars").alias("chars"))
    c = F.col("c").cast("double")
    kinds = seen.groupBy(*node, "kind").agg(F.sum("c").alias("m"), F.sum(c * F.log(c)).alias("clogc"), F.sum("chars").alias("chars"))
    m = F.col("m").cast("double")
    entropy = F.when(F.col("m") > 1, (F.log(m) - F.col("clogc") / m) / F.log(m)).otherwise(F.lit(1.0))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("importance")))
    return kinds.withColumn("importance", entropy).groupBy(*node).agg(F.max("m").alias("pages"), of(0).alias("look"), of(1).alias("content"), F.sum("chars").alias("chars"))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def verdicts(trees: DataFrame) -> DataFrame:
    """host, low and low_inside (paths to leave out, outside and inside articles) and open (what varies stands mostly outside articles), of hosts whose pages differ."""
    counts = F.col("pages") >= MIN_PAGES
    both = F.greatest("look", "content")
    low = (F.col("path") != ROOT) & (both < F.when(F.col("inside"), LOW_INSIDE).otherwise(LOW))
    marked = trees.where(counts).withColumn("low", low)
    mass = lambda cond: F.coalesce(F.sum(F.when(cond & ~F.col("noise") & ~F.col("low"), F.col("chars") * F.col("content"))), F.lit(0.0))
    of = lambda cond: F.collect_list(F.when(cond & F.col("low"), F.struct("pages", "path")))
    root = lambda name: F.max(F.when(F.col("path") == ROOT, F.col(name)))
    out = marked.groupBy("host").agg(of(~F.col("inside")).alias("low"), of(F.col("inside")).alias("low_inside"), (mass(~F.col("inside")) > mass(F.col("inside"))).alias("open"), root("content").alias("varied"), root("pages").alias("all"))
    # a branch of few pages, which may be copies of one, is no boilerplate of the host
    common = lambda name: F.transform(F.filter(name, lambda x: 2 * x["pages"] >= F.col("all")), lambda x: x["path"]).alias(name)
    return out.where(F.col("varied") >= LOW).select("host", common("low"), common("low_inside"), "open")


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id", use_tree: bool = True) -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars of every page; without the tree, by tags and classes alone."""
    found = materialize(verdicts(style_trees(pages, html_col, url_col) if use_tree else style_trees(pages, html_col, url_col).limit(0)), "trees").withColumnRenamed("host", "own")
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    width = 8 * (F.size("low") + F.size("low_inside"))
    src = src.join(small(found, width), host_of(F.col("url")) == F.col("own"), "left").select("id", "url", "html", "low", "low_inside", "open")

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset] = {}

        def as_set(x: list | None) -> frozenset:
            key = tuple(x or ())
            return sets.setdefault(key, frozenset(key))

        for part in (part for batch in batches for part in text_parts(batch, "html")):
            if len(sets) > 1000:
                sets.clear()
            texts = [main_text(p, as_set(a), as_set(b), bool(o)) for p, a, b, o in zip(*(part[c].to_pylist() for c in ("html", "low", "low_inside", "open")))]
            yield pa.RecordBatch.from_arrays([part["id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    schema = T.StructType([src.schema["id"], src.schema["url"]]).add("text", "string").add("n_chars", "long")
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
