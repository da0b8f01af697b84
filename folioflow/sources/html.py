"""HTML pages to Markdown: a small tree builder for pages as they are found, and a walk over the body."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PY_WS
from ..operators.batches import map_batches

# Element classes of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_FORMAT = frozenset("a b big code em font i s small strike strong tt u".split())
_SCOPE = frozenset("applet caption html table td th marquee object template button body".split())
_RAW = frozenset(("script", "style", "noscript"))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Builder(HTMLParser):
    """Builds the body: implied ends of p, li, td and tr, void elements, and formatting that goes on in the next block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body = Node("body")
        self.stack = [self.body]
        self.active: list[tuple[str, dict[str, str]]] = []
        self.head = 0

    def _open(self, tag: str, within: frozenset = _SCOPE) -> bool:
        for n in reversed(self.stack):
            if n.tag == tag:
                return True
            if n.tag in within:
                return False
        return False

    def _pop(self, tag: str) -> None:
        while len(self.stack) > 1:
            if self.stack.pop().tag == tag:
                return

    def _restore(self) -> None:
        """Opens again the formatting that a block's end has closed."""
        open_tags = [n.tag for n in self.stack]
        for tag, attrs in self.active:
            if tag in open_tags:
                open_tags.remove(tag)
            else:
                node = Node(tag, attrs)
                self.stack[-1].children.append(node)
                self.stack.append(node)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag == "head":
            self.head += 1
            return
        if tag == "title" or tag in ("meta", "link", "base"):
            self.head += tag == "title"
            return
        if tag in _CLOSES_P and self._open("p", _SCOPE | {"button"}):
            self._pop("p")
        if tag == "li" and self._open("li", _SCOPE | {"ul", "ol"}):
            self._pop("li")
        for same in (("td", "th"), ("tr",)):
            if tag in same:
                for t in same:
                    if self._open(t, frozenset(("table",)) | ({"tr"} if "td" in same else frozenset())):
                        self._pop(t)
        if tag == "tr":
            for t in ("td", "th"):
                if self._open(t, frozenset(("table", "tr"))):
                    self._pop(t)
            if self._open("tr", frozenset(("table",))):
                self._pop("tr")
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.stack[-1].tag):
            self.stack.pop()
        if tag not in _CLOSES_P and tag not in _RAW and tag not in ("li", "tr", "td", "th", "tbody", "thead", "tfoot"):
            self._restore()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag in _VOID:
            return
        self.stack.append(node)
        if tag in _FORMAT:
            self.active.append((tag, node.attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("head", "title"):
            self.head = max(0, self.head - 1)
            return
        if tag in ("html", "body") or tag in _VOID:
            return
        if tag == "p" and not self._open("p"):
            self.stack[-1].children.append(Node("p"))
            return
        if tag in _FORMAT:
            for i in range(len(self.active) - 1, -1, -1):
                if self.active[i][0] == tag:
                    del self.active[i]
                    break
        if any(n.tag == tag for n in self.stack[1:]):
            self._pop(tag)

    def handle_data(self, data):
        if self.head or not data:
            return
        if data.strip():
            self._restore()
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.body


#: How inline elements are written around their content.
_WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}


def _inline(node) -> str:
    if isinstance(node, str):
        return node
    inner = "".join(map(_inline, node.children))
    if node.tag in _WRAP:
        return _WRAP[node.tag] + inner + _WRAP[node.tag]
    if node.tag == "code":
        return "`" + inner.replace("`", "\\`") + "`"
    if node.tag == "a":
        target = node.attrs.get("href", "")
        return f"[{inner or target or 'Link'}]({target})"
    if node.tag == "img":
        return f"![{node.attrs.get('alt') or 'Image'}]({node.attrs.get('src', '')})"
    return "\n" if node.tag == "br" else inner


def _strip(text: str) -> str:
    return text.strip(PY_WS)


def _list(node: Node, depth: int) -> str:
    rows = []
    items = [c for c in node.children if isinstance(c, Node)]
    for n, item in enumerate(items, 1):
        lists = [c for c in item.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
        own = _strip("".join(_inline(c) for c in item.children if not any(c is x for x in lists)))
        rows.append("  " * depth + (f"{n}. " if node.tag == "ol" else "- ") + own)
        for inner in lists:
            rows += ["  " + line for line in _strip(_block(inner, depth + 1)).split("\n")]
    return "\n".join(rows) + "\n\n"


def _rows(node: Node):
    for c in node.children:
        if isinstance(c, Node):
            if c.tag == "tr":
                yield c
            yield from _rows(c)


def _block(node, depth: int = 0) -> str:
    if isinstance(node, str):
        return _strip(node)
    tag = node.tag
    if tag in _RAW:
        return ""
    if re.fullmatch("h[1-6]", tag):
        return "#" * int(tag[1]) + " " + _strip(_inline(node)) + "\n\n"
    if tag == "p":
        return _strip(_inline(node)) + "\n\n"
    if tag == "pre":
        return f"```\n{node.text()}\n```\n\n"
    if tag == "hr":
        return "---\n\n"
    if tag in ("ul", "ol"):
        return _list(node, depth)
    if tag == "table":
        cells = [[_strip(_inline(c)) for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")] for row in _rows(node)]
        return "\n".join(f"| {' | '.join(r)} |" for r in cells) + "\n\n"
    inner = "".join(_block(c, depth) for c in node.children)
    if tag == "blockquote":
        return "\n".join(f"> {line}" for line in _strip(inner).split("\n")) + "\n\n"
    return inner


def html_to_markdown(html: str | None) -> str:
    """Markdown of the body of a page; null and empty pages give an empty text."""
    if not html:
        return ""
    html = re.sub("\r\n?", "\n", html).replace("\0", "")
    # A tag that the page's end cuts off takes what follows with it.
    last = html.rfind(">") + 1
    cut = re.search("<[A-Za-z/!?]", html[last:])
    body = parse(html[: last + cut.start()] if cut else html)
    text = "".join(_block(c) for c in body.children)
    return _strip(re.sub("\n{3,}", "\n\n", re.sub(r"(?<![ \t])[ \t]+\n", "\n", text)))


def pages_to_markdown(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    src = df.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("text", T.StringType())])
    return map_batches(src, lambda r: iter([(r["doc_id"], html_to_markdown(r["html"]))]), schema)
