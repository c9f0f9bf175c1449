"""Response bodies: content encodings, and articles out of pages."""

from __future__ import annotations

import gzip
import html
import json
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from evidentia import lexicons as L

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open paragraph, and tags that end an open one of the same name.
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_NO_NEST = frozenset("li option td th tr dt dd".split())
_PART = re.compile(r"([a-z0-9]+)|\.([\w-]+)|\[([\w-]+)(\*?=)'([^']*)'\]")


def inflate(raw: bytes | None, encoding: str | None) -> bytes | None:
    """The body without its encoding; as it is, if it cannot be decoded."""
    if raw is None:
        return None
    kind = (encoding or "").lower()
    try:
        if "gzip" in kind or (not kind and raw[:2] == b"\x1f\x8b"):
            return gzip.decompress(raw)
        if "deflate" in kind:
            try:
                return zlib.decompress(raw)
            except zlib.error:
                return zlib.decompress(raw, -zlib.MAX_WBITS)
        if "br" in kind:
            import brotli

            return brotli.decompress(raw)
    except Exception:  # a body that lies about its encoding stays as it is
        return raw
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


@F.pandas_udf(BinaryType())
def decoded(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([inflate(r, e) for r, e in zip(raw, encoding, strict=True)])


class Node:
    def __init__(self, tag: str, attributes: dict, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Node | str]:
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                yield child
                if isinstance(child, Node):
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def nodes(self) -> Iterator[Node]:
        return (n for n in self.walk() if isinstance(n, Node))

    def text(self) -> str:
        return " ".join(s for s in (n.strip() for n in self.walk() if isinstance(n, str)) if s)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P and self.now.tag == "p" or tag == self.now.tag and tag in _NO_NEST:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in _VOID:
            self.open[tag] = self.open.get(tag, 0) + 1
            self.now = node

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):  # no such element is open: nothing to look for
            return
        at = self.now
        while at and at.tag != tag:
            self.open[at.tag] -= 1
            at = at.parent
        if at and at.parent:
            self.open[tag] -= 1
            self.now = at.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def _fits(node: Node, part: str) -> bool:
    for tag, cls, name, how, value in _PART.findall(part):
        have = node.attributes.get(name, "")
        if tag and node.tag != tag or cls and cls not in node.attributes.get("class", "").split():
            return False
        if name and (value not in have if how == "*=" else value != have):
            return False
    return True


def select_one(root: Node, selector: str) -> Node | None:
    """The first node that fits the last part of a selector, inside nodes that fit those before."""
    *outer, last = selector.split(" ")
    for node in root.nodes():
        if _fits(node, last):
            at, need = node.parent, list(outer)
            while at and need:
                if _fits(at, need[-1]):
                    need.pop()
                at = at.parent
            if not need:
                return node
    return None


def paragraphs(node: Node) -> str | None:
    return " ".join(t for t in (n.text() for n in node.nodes() if n.tag == "p") if t) or None


def json_text(value: object, least: int = 120) -> str | None:
    """The article text in a JSON tree: of an object, its body or description, then embedded content, then children."""
    if isinstance(value, list):
        return next((t for t in map(json_text, value) if t), None)
    if not isinstance(value, dict):
        return None
    strings = {k: v.strip() for k, v in value.items() if isinstance(v, str) and v.strip()}
    for key in ("articleBody", "description"):
        if key in strings:
            return strings[key]
    for key in ("caasArtHtml", "content"):
        found = strings.get(key, "")
        inner = paragraphs(tree(found)) if "<" in found and ">" in found else None
        if inner or len(found) >= least:
            return inner or found
    return json_text(list(value.values()))


def tree(source: str) -> Node:
    parser = _Tree()
    parser.feed(source)
    parser.close()
    return parser.root


def _scripts(root: Node) -> Iterator[str]:
    for node in root.nodes():
        if node.tag == "script":
            raw = "".join(c for c in node.children if isinstance(c, str))
            if node.attributes.get("type") == "application/ld+json":
                yield raw
    for node in root.nodes():
        if node.tag == "script":
            found = re.search(r"root\.App\.main\s*=\s*(\{.*\})\s*;\s*$", "".join(c for c in node.children if isinstance(c, str)), re.S)
            if found:
                yield found[1]


def article(source: str | None, url: str | None) -> str | None:
    """A news page's text: by the site's selectors, by article, main or body, by embedded JSON, by all paragraphs."""
    if not source:
        return None
    root = tree(source)
    host = (re.match(r"^(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)", url or "") or ["", ""])[1].lower()
    for domain, selectors in [*L.ARTICLE_SELECTORS.items(), ("", L.FALLBACK_SELECTORS)]:
        if domain in host:
            for selector in selectors:
                node = select_one(root, selector)
                text = paragraphs(node) if node else None
                if text:
                    return text
    for raw in _scripts(root):
        try:
            text = json_text(json.loads(raw))
        except (json.JSONDecodeError, RecursionError):
            continue
        if text:
            return html.unescape(text)
    return paragraphs(root)


def articles(pages: DataFrame, page: str = "html", url: str = "url", name: str = "article_text") -> DataFrame:
    """Adds the article text of each page."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + f", {name} string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: [article(h, u) for h, u in zip(frame[page], frame[url], strict=True)]})

    return pages.mapInPandas(run, shape)


def found_in_json(column: Column) -> Column:
    """json_text of a column of JSON strings."""

    @F.pandas_udf(StringType())
    def get(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(json_text(json.loads(t)) if t else None)
            except (json.JSONDecodeError, RecursionError):
                out.append(None)
        return pd.Series(out)

    return get(column)
