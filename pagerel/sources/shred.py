"""Shred raw HTML pages into a relational element table.

This is the only Python stage of the engine: every page is parsed inside
``mapInArrow`` (Arrow batches in and out, one page at a time, no driver
round trip). Everything downstream is DataFrame expressions, joins,
aggregations and windows over the ``nodes`` table.

Tree building follows the HTML parsing rules that matter for real pages:
void elements, raw-text elements, implied end tags (p, li, dt/dd, tr, td/th,
option, thead/tbody/tfoot, headings, nested a), a closing tag closes up to
its nearest open match or is ignored, and missing html/head/body/tbody are
added. Formatting elements are not re-opened after an implied close (stated
deviation from browsers).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- fixed values (HTML / engine rules) ---------------------------------------
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "meta",
        "param", "source", "track", "wbr", "basefont", "bgsound", "frame"}
# Elements whose subtree is never scanned for values (engine rule).
SKIP_TAGS = {"script", "style", "noscript", "template", "iframe", "object", "embed", "canvas",
             "head", "meta", "link", "svg"}
HEAD_TAGS = {"meta", "link", "title", "style", "script", "base", "noscript", "template"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir",
            "div", "dl", "fieldset", "figcaption", "figure", "footer", "header", "hgroup", "main",
            "menu", "nav", "ol", "p", "search", "section", "summary", "ul", "h1", "h2", "h3",
            "h4", "h5", "h6", "pre", "listing", "form", "table", "hr", "xmp", "li", "dd", "dt",
            "plaintext"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPE_STOP = {"applet", "caption", "html", "table", "td", "th", "marquee", "object", "template",
              "foreignobject"}
LIST_STOP = {"address", "applet", "caption", "html", "table", "td", "th", "marquee", "object",
             "template", "ul", "ol", "body", "button", "dl"}
TABLE_SECTIONS = {"thead", "tbody", "tfoot"}
NO_TEXT_TAGS = {"script", "style"}
INLINE_FORMAT = {"b", "i", "em", "strong", "small", "sup", "sub", "br", "mark", "u", "s", "del",
                 "ins", "code", "abbr", "cite", "q", "wbr", "span", "font", "bdi", "bdo", "dfn",
                 "kbd", "samp", "var"}
STOP_TAGS = {"img", "input", "select", "textarea"}
# JS String.prototype.trim() whitespace.
JS_WS = ("\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
         "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")
# P01 class: JS \s plus zero-width space/joiners and BOM.
_CLEAN_RE = re.compile("[" + JS_WS + "\u200b\u200c\u200d]+")
_HIDDEN_STYLE_RE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
BLOCK = 4096  # characters of a page's text stream that make a row
NODES_AT_ONCE = 20_000  # rows held before they leave as a batch
_ASCII_WS_RE = re.compile(r"[ \t\n\f\r]+")

NODES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType(), False),
    T.StructField("node_id", T.IntegerType(), False),
    T.StructField("end_id", T.IntegerType(), False),
    T.StructField("parent_id", T.IntegerType(), True),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("anc", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("tag", T.StringType(), False),
    T.StructField("is_svg", T.BooleanType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("classes", T.ArrayType(T.StringType(), False), False),
    T.StructField("attr_names", T.ArrayType(T.StringType(), False), False),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType(), False), False),
    T.StructField("sib_ord", T.IntegerType(), False),
    T.StructField("n_children", T.IntegerType(), False),
    T.StructField("child_tags", T.ArrayType(T.StringType(), False), False),
    T.StructField("own_text", T.StringType(), False),
    T.StructField("has_text", T.BooleanType(), False),
    T.StructField("skipped", T.BooleanType(), False),
    T.StructField("skip_depth", T.IntegerType(), False),
    T.StructField("hidden", T.BooleanType(), False),
    T.StructField("fmt", T.BooleanType(), False),
    T.StructField("text_container", T.BooleanType(), False),
    T.StructField("stop_depth", T.IntegerType(), False),
    T.StructField("t_start", T.IntegerType(), False),
    T.StructField("t_end", T.IntegerType(), False),
    T.StructField("o_start", T.IntegerType(), False),
    T.StructField("i_start", T.IntegerType(), False),
    T.StructField("i_end", T.IntegerType(), False),
    T.StructField("o_end", T.IntegerType(), False),
    T.StructField("nth", T.IntegerType(), False),
    T.StructField("nth_count", T.IntegerType(), False),
    # only on the root row (node_id 0): the page's text stream and <base href>
    T.StructField("text_blocks", T.ArrayType(T.StringType(), False), True),
    T.StructField("base_href", T.StringType(), True),
])


def clean_py(s: str) -> str:
    """Python twin of P01, used only inside the shredder for own text."""
    return _CLEAN_RE.sub(" ", s).strip(" ")


class _Node:
    __slots__ = ("nid", "tag", "parent", "depth", "anc", "svg", "attrs", "names", "id", "classes",
                 "sib_ord", "n_children", "child_tags", "texts", "has_text", "skipped",
                 "skip_depth", "hidden", "t_start", "t_end", "o_start", "i_start", "i_end",
                 "o_end", "end_id", "kids_fmt", "fmt", "tc", "stop_depth", "of_kind", "nth")


class _TreeBuilder(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.line_starts = [0] + [m.end() for m in re.finditer("\n", html)]
        self.nodes: list[_Node] = []
        self.stack: list[_Node] = []
        self.text: list[str] = []
        self.text_len = 0
        self.head: _Node | None = None
        self.body: _Node | None = None
        self.head_closed = False
        self.last_text_owner: _Node | None = None
        self.base_href: str | None = None

    # -- positions --------------------------------------------------------
    def _abs(self) -> int:
        line, col = self.getpos()
        return self.line_starts[line - 1] + col

    # -- tree ops ---------------------------------------------------------
    def _new(self, tag: str, attrs, start: int, inner: int) -> _Node:
        parent = self.stack[-1] if self.stack else None
        n = _Node()
        n.nid = len(self.nodes)
        n.tag = tag
        n.parent = parent
        n.depth = parent.depth + 1 if parent else 0
        n.anc = (parent.anc + [n.nid]) if parent else [n.nid]
        n.svg = tag == "svg" or bool(parent and parent.svg and parent.tag != "foreignobject")
        names, amap = [], {}
        for k, v in attrs:
            if k in amap:
                continue
            amap[k] = "" if v is None else v
            names.append(k)
        n.attrs, n.names = amap, names
        n.id = amap.get("id", "")
        seen = []
        for c in _ASCII_WS_RE.split(amap.get("class", "")):
            if c and c not in seen:
                seen.append(c)
        n.classes = seen
        n.n_children = 0
        n.child_tags = []
        n.of_kind = {}  # children by tag and namespace
        n.nth = 1
        if parent is not None:
            parent.n_children += 1
            n.sib_ord = parent.n_children
            n.nth = parent.of_kind[tag, n.svg] = parent.of_kind.get((tag, n.svg), 0) + 1
            if tag not in parent.child_tags:
                parent.child_tags.append(tag)
        else:
            n.sib_ord = 1
        n.texts = []
        n.has_text = False
        n.skipped = tag in SKIP_TAGS
        if n.skipped:
            n.skip_depth = n.depth
        else:
            n.skip_depth = parent.skip_depth if parent else -1
        style = amap.get("style", "")
        n.hidden = bool(parent and parent.hidden) or "hidden" in amap or bool(
            style and _HIDDEN_STYLE_RE.search(style))
        n.t_start = self.text_len
        n.o_start, n.i_start = start, inner
        n.end_id = n.nid
        n.kids_fmt = True
        self.nodes.append(n)
        self.last_text_owner = None
        if tag == "base" and self.base_href is None and "href" in amap:
            self.base_href = amap["href"]
        return n

    def _pop(self, at: int) -> _Node:
        n = self.stack.pop()
        n.t_end = self.text_len
        n.i_end = at
        n.o_end = at
        n.end_id = len(self.nodes) - 1
        return n

    def _pop_until(self, tag: str, at: int) -> None:
        while self.stack:
            if self._pop(at).tag == tag:
                return

    def _has_open(self, tag: str, stops) -> bool:
        for n in reversed(self.stack):
            if n.tag == tag:
                return True
            if n.tag in stops:
                return False
        return False

    def _ensure_root(self, at: int) -> None:
        if not self.nodes:
            self.stack.append(self._new("html", [], at, at))

    def _ensure_body(self, at: int) -> None:
        self._ensure_root(at)
        if self.body is None:
            if self.head is not None and not self.head_closed:
                while self.stack and self.stack[-1] is not self.nodes[0]:
                    self._pop(at)
                self.head_closed = True
            if self.head is None:
                self.head = self._new("head", [], at, at)
                self.head.t_end, self.head.i_end, self.head.o_end = self.text_len, at, at
                self.head_closed = True
            self.body = self._new("body", [], at, at)
            self.stack.append(self.body)

    # -- parser callbacks -------------------------------------------------
    def handle_starttag(self, tag, attrs):
        start = self._abs()
        raw = self.get_starttag_text() or ""
        inner = start + len(raw)
        if tag == "html":
            self._ensure_root(start)
            return
        self._ensure_root(start)
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = self._new("head", attrs, start, inner)
                self.stack.append(self.head)
            return
        if tag == "body":
            if self.body is None:
                if self.head is not None and not self.head_closed:
                    self._pop_until("head", start)
                    self.head_closed = True
                if self.head is None:
                    self.head = self._new("head", [], start, start)
                    self.head.t_end, self.head.i_end, self.head.o_end = self.text_len, start, start
                    self.head_closed = True
                self.body = self._new("body", attrs, start, inner)
                self.stack.append(self.body)
            return
        if self.body is None:
            if tag in HEAD_TAGS and not self.head_closed:
                if self.head is None:
                    self.head = self._new("head", [], start, start)
                    self.stack.append(self.head)
            else:
                self._ensure_body(start)
        self._implied_closes(tag, start)
        if tag in ("td", "th") and self.stack and self.stack[-1].tag in TABLE_SECTIONS | {"table"}:
            self._implicit_tr(start)
        if tag == "tr" and self.stack and self.stack[-1].tag == "table":
            self.stack.append(self._new("tbody", [], start, start))
        n = self._new(tag, attrs, start, inner)
        if tag not in VOID and not (n.svg and raw.rstrip().endswith("/>")):
            self.stack.append(n)
        else:
            n.t_end, n.i_end, n.o_end = self.text_len, inner, inner

    def _implicit_tr(self, at):
        if self.stack[-1].tag == "table":
            self.stack.append(self._new("tbody", [], at, at))
        self.stack.append(self._new("tr", [], at, at))

    def _implied_closes(self, tag, at):
        if tag in CLOSES_P and self._has_open("p", SCOPE_STOP | {"button"}):
            self._pop_until("p", at)
        if tag == "li" and self._has_open("li", LIST_STOP - {"body"} | {"ul", "ol"}):
            self._pop_until("li", at)
        elif tag in ("dd", "dt"):
            for n in reversed(self.stack):
                if n.tag in ("dd", "dt"):
                    self._pop_until(n.tag, at)
                    break
                if n.tag in LIST_STOP:
                    break
        elif tag in HEADINGS and self.stack and self.stack[-1].tag in HEADINGS:
            self._pop(at)
        elif tag in ("td", "th"):
            for n in reversed(self.stack):
                if n.tag in ("td", "th"):
                    self._pop_until(n.tag, at)
                    break
                if n.tag in ("tr", "table"):
                    break
        elif tag == "tr":
            for n in reversed(self.stack):
                if n.tag == "tr":
                    self._pop_until("tr", at)
                    break
                if n.tag == "table":
                    break
        elif tag in TABLE_SECTIONS:
            for n in reversed(self.stack):
                if n.tag in TABLE_SECTIONS:
                    self._pop_until(n.tag, at)
                    break
                if n.tag == "table":
                    break
        elif tag == "option" and self.stack and self.stack[-1].tag == "option":
            self._pop(at)
        elif tag == "optgroup":
            while self.stack and self.stack[-1].tag in ("option", "optgroup"):
                self._pop(at)
        elif tag == "a" and self._has_open("a", SCOPE_STOP):
            self._pop_until("a", at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # XML-style self-closing is only honoured for void and svg elements,
        # both handled in handle_starttag.

    def handle_endtag(self, tag):
        at = self._abs()
        close = self.html.find(">", at)
        end = close + 1 if close >= 0 else len(self.html)
        self.last_text_owner = None
        if tag in ("html", "body", "br"):
            return
        if tag == "head":
            if self.head is not None and not self.head_closed and any(n is self.head for n in self.stack):
                while self.stack and self.stack[-1] is not self.head:
                    self._pop(at)
                h = self._pop(at)
                h.o_end = end
                self.head_closed = True
            return
        for i in range(len(self.stack) - 1, 0, -1):
            n = self.stack[i]
            if n.tag == tag:
                while len(self.stack) > i + 1:
                    self._pop(at)
                m = self._pop(at)
                m.o_end = end
                return
            if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") and n.tag == "table":
                return

    def handle_data(self, data):
        if not data:
            return
        if self.body is None and not self.stack:
            if not data.strip(JS_WS):
                return
        at = self._abs()
        if self.body is None and (not self.stack or self.stack[-1].tag in ("html", "head")):
            if not data.strip(JS_WS):
                return
            self._ensure_body(at)
        owner = self.stack[-1]
        if owner.tag not in NO_TEXT_TAGS:
            self.text.append(data)
            self.text_len += len(data)
        if self.last_text_owner is owner and owner.texts:
            owner.texts[-1] += data
        else:
            owner.texts.append(data)
        if data.strip(JS_WS):
            owner.has_text = True
        self.last_text_owner = owner

    def handle_comment(self, data):
        self.last_text_owner = None

    def finish(self):
        self.close()
        end = len(self.html)
        while self.stack:
            self._pop(end)
        if not self.nodes:
            self._ensure_root(0)
            self._pop(0) if self.stack else None
        self._derive()

    def _derive(self):
        """Bottom-up formatting / text-container flags (F06, F07), then the
        depth of the nearest strict ancestor that stops the value scan (L11).
        Element boundaries fall between text chunks, so "has non-blank text
        in the subtree" is a prefix count over chunks, not characters."""
        import bisect

        ends, cum = [], [0]
        pos = 0
        for chunk in self.text:
            pos += len(chunk)
            ends.append(pos)
            cum.append(cum[-1] + (1 if chunk.strip(JS_WS) else 0))

        def nonblank(a, b):
            i = bisect.bisect_right(ends, a)      # chunks ending at or before a
            j = bisect.bisect_right(ends, b)      # chunks ending at or before b
            return cum[j] - cum[i] > 0

        nodes = self.nodes
        for n in reversed(nodes):  # children before parents
            n.fmt = (n.tag in INLINE_FORMAT and not n.classes and n.id == "" and n.kids_fmt)
            if n.parent is not None and not n.fmt:
                n.parent.kids_fmt = False
        for n in nodes:
            n.tc = n.kids_fmt and n.t_end > n.t_start and nonblank(n.t_start, n.t_end)
            p = n.parent
            if p is None:
                n.stop_depth = -1
            elif p.tag in STOP_TAGS or p.tc:
                n.stop_depth = p.depth
            else:
                n.stop_depth = p.stop_depth


def shred_one(page_id: int, html: str):
    b = _TreeBuilder(html or "")
    b.feed(html or "")
    b.finish()
    return b


def _shred_batches(batches):
    names = [f.name for f in NODES_SCHEMA.fields]
    arrow_schema = pa.schema([
        ("page_id", pa.int64()), ("node_id", pa.int32()), ("end_id", pa.int32()),
        ("parent_id", pa.int32()), ("depth", pa.int32()), ("anc", pa.list_(pa.int32())),
        ("tag", pa.string()), ("is_svg", pa.bool_()), ("id", pa.string()),
        ("classes", pa.list_(pa.string())), ("attr_names", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())), ("sib_ord", pa.int32()),
        ("n_children", pa.int32()), ("child_tags", pa.list_(pa.string())),
        ("own_text", pa.string()), ("has_text", pa.bool_()), ("skipped", pa.bool_()),
        ("skip_depth", pa.int32()), ("hidden", pa.bool_()), ("fmt", pa.bool_()),
        ("text_container", pa.bool_()), ("stop_depth", pa.int32()), ("t_start", pa.int32()),
        ("t_end", pa.int32()), ("o_start", pa.int32()), ("i_start", pa.int32()),
        ("i_end", pa.int32()), ("o_end", pa.int32()), ("nth", pa.int32()), ("nth_count", pa.int32()),
        ("text_blocks", pa.list_(pa.string())), ("base_href", pa.string()),
    ])
    assert [f.name for f in arrow_schema] == names
    def made(rows):
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(cols[i]), type=arrow_schema.field(nm).type) for i, nm in enumerate(names)], schema=arrow_schema)

    rows = []
    for batch in batches:
        for pid, html in zip(batch.column("page_id"), batch.column("html")):  # one page's html at a time
            pid, b = pid.as_py(), shred_one(None, html.as_py())
            text = "".join(b.text)
            blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
            for n in b.nodes:
                root = n.nid == 0
                count = n.parent.of_kind[n.tag, n.svg] if n.parent else 1
                rows.append((pid, n.nid, n.end_id, n.parent.nid if n.parent else None, n.depth, n.anc, n.tag, n.svg, n.id,
                             n.classes, n.names, list(n.attrs.items()), n.sib_ord, n.n_children, n.child_tags,
                             clean_py(" ".join(n.texts)) if n.texts else "", n.has_text, n.skipped, n.skip_depth, n.hidden,
                             n.fmt, n.tc, n.stop_depth, n.t_start, n.t_end, n.o_start, n.i_start, n.i_end, n.o_end, n.nth, count,
                             blocks if root else None, b.base_href if root else None))
                if len(rows) >= NODES_AT_ONCE:
                    yield made(rows)
                    rows = []
    yield made(rows)


def _ship_by_value(module_name: str) -> None:
    """Executors may not have this package on their path: pickle the
    worker-side functions of ``module_name`` by value so they travel with
    the task (no install step on the cluster)."""
    import sys

    from pyspark import cloudpickle

    try:
        cloudpickle.register_pickle_by_value(sys.modules[module_name])
    except (KeyError, ValueError):
        pass


def shred(pages: DataFrame) -> DataFrame:
    """pages(page_id, html, ...) -> nodes (one row per element, preorder).

    Runs per page inside ``mapInArrow``; only ``page_id`` and ``html`` cross
    into Python. The page's text stream, in blocks, and ``<base href>`` ride on
    the root row (node_id 0), so no second parse is needed for texts."""
    _ship_by_value(__name__)
    src = pages.select("page_id", "html")
    # Parsing is CPU-bound Python: make sure every core gets pages. Large
    # inputs already scan into many splits and keep them (no shuffle of html).
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if src.rdd.getNumPartitions() < cores:
        src = src.repartition(cores, "page_id")
    return src.mapInArrow(_shred_batches, NODES_SCHEMA)


def page_texts(nodes: DataFrame) -> DataFrame:
    """(page_id, block, text): the text stream of each page, cut every BLOCK
    characters, so that a very long page is many rows."""
    return nodes.filter("node_id = 0").select("page_id", F.posexplode("text_blocks").alias("block", "text"))


def page_sources(pages: DataFrame) -> DataFrame:
    """(page_id, block, text): the source of each page, cut likewise."""
    cut = F.regexp_extract_all(F.col("html"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return pages.select("page_id", F.posexplode(cut).alias("block", "text"))


def drop_page_cols(nodes: DataFrame) -> DataFrame:
    return nodes.drop("text_blocks", "base_href")
