"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree of style nodes (element paths of tag and class) with all
their text, menus and footers too. The importance of a node's own text mixes the entropy of its
presentation (child sequences over the host's pages) with that of its contents: text found on many
pages spreads its probability and counts little, text of one page counts fully. First, text of low
importance is removed from each page: the importances of a host's nodes are sorted, and those below
their largest gap are low, if that gap is wide enough for the number of pages. A branch falls when all text below it is low; a node above that
also holds important text does not take that with it.

Second, fixed rules remove what an element or class already calls menu, header, footer, sidebar,
notice, advert, form, comment, script or style, however important: such text can be new on each page.
A page with article or main elements gives what is inside them, and of the rest only text whose node
has the importance MIN_OUTSIDE in its host's tree.

Pages with equal contents count once in a host's tree. Null and empty pages, and pages without main
text, give ''. Pages of any size are read whole. A null url is a host of its own. Repeated rows stay
(one result each). Empty tables give empty results; extra columns are not read. Where a
host has no such gap, only elements and classes decide. A class, id or form around all of a page's text rules out
nothing. Of equal gaps the lowest counts.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .tables import load, stage_texts

MIN_GAP = 0.02       # least gap in a host's importances that parts low nodes from others
GAP_PAGES = 0.3      # or this divided by the host's pages, whose entropies are then rough
MAIN_GAP = 0.05      # least gap for text inside article and main elements to be low
MIN_OUTSIDE = 0.8    # of text beside article and main elements: nearly every page has its own
LOW_NODES = 100_000  # nodes the tree decides on that may be broadcast: a few MB
PRESENTATION = 0.1   # share of presentation in the importance of a node with text

# fixed values: elements and class words
SKIPPED = {"head", "script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "audio", "video",
           "nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
         "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
         "tr", "ul", "head", "title", "template", "noscript"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
          "body": {"head"}}
BOILERPLATE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "cookie",
               "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
               "subscription", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer",
               "masthead", "comment", "comments", "disqus", "replies", "reply", "respond", "share", "sharing", "social", "related",
               "recommended", "recommendations", "widget", "widgets", "toolbar", "pagination", "pager", "login", "signup", "search",
               "skip", "copyright", "disclaimer"}
HEADER_WORDS = {"header", "topbar", "top"}
CONTENT_WORDS = {"content", "article", "main", "post", "entry", "body", "story", "text"}
MAIN = {"article", "main"}
WHOLE = {"html", "body"}  # their classes name a layout, not a part
PROSE = {"p", "h1", "h2", "blockquote", "pre"}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?][^>]*>)""", re.S)
_LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _named_boilerplate(labels, in_main):
    """Whether class, id or role words name something that is not the main text."""
    for label in labels:
        words = set(_PART.findall(label.lower()))
        if words & BOILERPLATE and not words & CONTENT_WORDS or not in_main and words & HEADER_WORDS and not words & CONTENT_WORDS:
            return True
        if words & {"comment", "comments", "sidebar", "cookie", "advert", "advertisement"} and not words & {"content", "main", "with", "no", "has"}:
            return True
    return False


class Page:
    """Blocks of a page: text, style path, whether elements or classes rule it out, and child
    sequences of its style nodes."""

    def __init__(self, source: str):
        self.texts, self.paths, self.out, self.main, self.inner, self.hard = [], [], [], [], [], []
        self.children: dict = {}
        self._stack = []  # (tag, path, ruled out, in main, ruled out inside the main element, by an element other than form)
        self._text = []
        self._at = 0
        at, pos = 0, source.find("<")
        while pos >= 0:
            m = _TAG.match(source, pos)
            if not m:
                pos = source.find("<", pos + 1)
                continue
            if pos > at:
                self._text.append(source[at:pos])
            at = m.end()
            tag = m[2].lower() if m[2] else None
            if tag and m[1]:
                self._close(tag)
            elif tag:
                self._open(tag, m[3])
                if tag in RAW and not m[3].endswith("/"):
                    end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._text.clear()
                    self._close(tag)
            pos = source.find("<", at)
        if at < len(source):
            self._text.append(source[at:])
        self._flush()

    def _flush(self):
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                _, path, *flags = self._stack[-1] if self._stack else ("", ("",), False, False, False, False)
                self.texts.append(text)
                self.paths.append(path)
                for kept, flag in zip((self.out, self.main, self.inner, self.hard), flags):
                    kept.append(flag)

    def _open(self, tag, attributes):
        if tag == "br":
            self._text.append(" ")
        if tag in BLOCK or tag in SKIPPED or tag in RAW:
            self._flush()
            if tag in BLOCK:
                self._end_paragraph()
            if tag in CLOSES:
                self._pop_while(CLOSES[tag])
        elif not attributes:
            return  # an inline element without class changes nothing
        if tag in VOID:
            return
        labels = [a or b or c for _, a, b, c in _LABEL.findall(attributes)] if attributes else []
        if tag not in BLOCK and tag not in SKIPPED and tag not in RAW and not labels:
            return
        _, path, out, main, inner, hard = self._stack[-1] if self._stack else ("", (), False, False, False, False)
        begins = tag in MAIN or "main" in labels
        main = main or begins
        ruled = tag in SKIPPED or tag == "header" and not main or (
            bool(labels) and tag not in WHOLE and _named_boilerplate(labels, main))
        out, inner = out or ruled, not begins and (inner or ruled) or begins and ruled
        hard = hard or tag in SKIPPED and tag != "form"
        if out and not (self._stack and self._stack[-1][2]) and tag not in BLOCK:
            self._flush()
        if tag in BLOCK or out:
            name = tag + "".join(f".{_DIGITS.sub('#', x)}" for x in labels)
            if path:
                self.children.setdefault(path, []).append(name)
            path = (*path, name)
        self._stack.append((tag, path, out, main, inner, hard))

    def _end_paragraph(self):
        if self._stack and self._stack[-1][0] == "p":
            self._stack.pop()

    def _pop_while(self, tags):
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in tags:
                del self._stack[i:]
                return
            if self._stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                return

    def _close(self, tag):
        if tag in BLOCK or tag in SKIPPED or tag in RAW:
            self._flush()
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                if self._stack[i][2] and not (i and self._stack[i - 1][2]):
                    self._flush()
                del self._stack[i:]
                return

    def blocks(self):
        """(text, path, not ruled out, beside the page's article or main elements, kept inside them) of every block in page order."""
        out = self.out
        if self.texts and all(out):  # a class, id or form around everything: rules inside the main element, else elements, decide
            out = [i or h or not m for i, h, m in zip(self.inner, self.hard, self.main)]
            if all(out):
                running = [not h and any(e.split(".")[0] in PROSE for e in p) for h, p in zip(self.hard, self.paths)]
                out = [not r for r in running] if sum(running) > 1 else self.out
        inside = any(m and not o for m, o in zip(self.main, out))
        return [(t, p, not o, inside and not m, m and not o) for t, p, o, m in zip(self.texts, self.paths, out, self.main)]


_PARSED = ("row long, page_id long, url string, host string, page_hash long, kept_texts array<string>, kept_paths array<int>, "
           "beside array<boolean>, paths array<long>, blocks array<struct<hash:long,path:int,beside:boolean,main:boolean>>, "
           "styles array<struct<node:long,style:long>>")


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the blocks no rule removes, and what its host's tree counts."""
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
                        host.alias("host"), F.col(html_col).cast("string").alias("html"))

    def make(batches):
        for block in blocks.text_blocks(batches, "html"):
            out = []
            for source in block.column(4).to_pylist():
                page = Page(source or "")
                found = page.blocks()
                place = {p: i for i, p in enumerate(dict.fromkeys(p for _, p, *_ in found))}
                kept = [(t, place[p], beside) for t, p, k, beside, _ in found if k]
                styles = [{"node": _hash("/".join(p)), "style": _hash(" ".join(dict.fromkeys(c)))} for p, c in page.children.items() if p in place]
                out.append((_hash("\n".join(t for t, _, beside in kept if not beside)), [t for t, *_ in kept], [p for _, p, _ in kept],
                            [beside for *_, beside in kept], [_hash("/".join(p)) for p in place],
                            [{"hash": _hash(t), "path": place[p], "beside": k and beside, "main": main} for t, p, k, beside, main in found], styles))
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()),
                     pa.list_(pa.struct([("hash", pa.int64()), ("path", pa.int32()), ("beside", pa.bool_()), ("main", pa.bool_())])),
                     pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())]))]
            names = ["page_hash", "kept_texts", "kept_paths", "beside", "paths", "blocks", "styles"]
            yield pa.RecordBatch.from_arrays([*block.columns[:4], *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))],
                                             [*block.schema.names[:4], *names])

    return rows.mapInArrow(make, _PARSED)


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, node, pages, importance, beside, main) of every style node with text of its own; beside: on
    some page that text lies beside article or main elements; main: on some page inside."""
    # pages with equal contents have one page_hash and count once
    leaf = (parsed.select("host", "page_hash", "paths", F.explode("blocks").alias("x"))
            .select("host", "page_hash", "x.hash", F.col("paths")[F.col("x.path")].alias("node"), "x.beside", "x.main")
            .groupBy("host", "page_hash", "hash", "node").agg(F.max("beside").alias("beside"), F.max("main").alias("main")))
    spread = leaf.groupBy("host", "node", "hash").agg(F.count("*").alias("c"), F.max("beside").alias("beside"), F.max("main").alias("main"))
    contents = spread.groupBy("host", "node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"),
                                                  F.max("beside").alias("beside"), F.max("main").alias("main"))
    pages = leaf.select("host", "page_hash", "node").distinct().groupBy("host", "node").agg(F.count("*").alias("pages"))
    style = (parsed.select("host", "page_hash", F.explode("styles").alias("s")).select("host", "page_hash", "s.node", "s.style").distinct()
             .groupBy("host", "node", "style").agg(F.count("*").alias("c"))
             .groupBy("host", "node").agg(F.sum("c").alias("s_n"), F.sum(F.col("c") * F.log("c")).alias("s_clogc")))
    node = contents.join(pages, ["host", "node"]).join(style, ["host", "node"], "left")
    many = F.log(F.greatest("pages", F.lit(2)))
    content = 1 - F.col("clogc") / F.col("n") / many
    shown = F.coalesce((F.log("s_n") - F.col("s_clogc") / F.col("s_n")) / F.log(F.greatest("s_n", F.lit(2))), F.lit(0.0))
    return node.select("host", "node", "pages", ((1 - PRESENTATION) * content + PRESENTATION * shown).alias("importance"), "beside", "main")


def low_nodes(tree: DataFrame) -> DataFrame:
    """The tree with ``is_low``: the node lies below its host's largest gap, if that is wide enough."""
    host = Window.partitionBy("host").orderBy("importance", "node")
    gaps = tree.withColumn("gap", F.lead("importance").over(host) - F.col("importance"))
    cut = gaps.groupBy("host").agg(F.max("gap").alias("gap"), F.max_by("importance", F.struct("gap", -F.col("importance"))).alias("below"),
                                   F.max("pages").alias("most"))
    wide = F.col("gap") >= F.greatest(F.lit(MIN_GAP), F.lit(GAP_PAGES) / F.col("most"))
    cut = cut.where(wide & (F.col("most") > 1))
    low = F.col("below").isNotNull() & (F.col("importance") <= F.col("below")) & (~F.col("main") | (F.col("gap") >= MAIN_GAP))
    return tree.join(cut.select("host", "gap", "below"), "host", "left").withColumn("is_low", F.coalesce(low, F.lit(False))).drop("gap", "below")


def extract(pages: DataFrame, **columns) -> DataFrame:
    """(page_id, url, text) of every page."""
    parsed = stage_texts(parse(pages, **columns).withColumn("host", F.coalesce("host", F.lit(""))), "html-blocks")
    own = F.col("beside") & (F.col("importance") >= MIN_OUTSIDE)
    nodes = stage_texts(low_nodes(style_tree(parsed)).where(F.col("is_low") | own).select("host", "node", "is_low"), "html-nodes")
    sets = [F.collect_set(F.when(is_low, F.col("x"))).alias(n) for n, is_low in (("low", F.col("is_low")), ("own", ~F.col("is_low")))]
    if nodes.limit(LOW_NODES + 1).count() <= LOW_NODES:
        marked = parsed.join(F.broadcast(nodes.withColumnRenamed("node", "x").groupBy("host").agg(*sets)), "host", "left")
        place = F.col("paths")
    else:
        hit = (parsed.select("row", "host", F.posexplode("paths").alias("x", "node")).join(nodes, ["host", "node"])
               .groupBy("row").agg(*sets))
        marked = parsed.join(hit, "row", "left")
        place = F.transform("paths", lambda p, i: i)
    of = lambda name: F.transform(place, lambda x: F.coalesce(F.array_contains(name, x), F.lit(False)))
    marked = marked.withColumn("is_low", of("low")).withColumn("is_own", of("own"))
    at = lambda name, i: F.col(name)[F.col("kept_paths")[i]]
    left = F.filter("kept_texts", lambda t, i: ~at("is_low", i) & (~F.col("beside")[i] | at("is_own", i)))
    return marked.select("page_id", "url", F.array_join(left, "\n\n").alias("text"))


def query(spark, sf_dir):
    return extract(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
