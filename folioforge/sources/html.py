"""HTML pages as blocks: a tree from the standard library's tokenizer, then one walk in document order."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markdown import block_id

#: Elements that vanish with all they hold, containers, other blocks, elements without content.
DROPPED = frozenset(("script", "style", "noscript", "iframe", "object", "embed", "form"))
CONTAINERS = frozenset(("div", "section", "article", "main", "header", "footer", "aside", "nav"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = CONTAINERS | frozenset(HEADINGS) | frozenset(("p", "ul", "ol", "table", "pre", "blockquote"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: What the start of an element ends, up to the nearest element of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
}
_CLOSES_P = BLOCKS | {"address", "dl", "fieldset", "figure", "figcaption", "hr", "details", "summary", "form", "li", "dt", "dd"}
_SCOPE = frozenset(("table", "td", "th", "caption", "button", "object"))


class Node:
    __slots__ = ("children", "tag")

    def __init__(self, tag: str) -> None:
        self.tag = tag
        self.children: list[Node | str] = []

    def descendants(self) -> Iterator[Node]:
        """Elements below this one in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, without: frozenset[str] = frozenset()) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in without:
                stack += reversed(c.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body"):  # a fragment has none of its own
            return
        if tag in _CLOSES_P:
            self._close({"p"}, _SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in _ENDS:
            own, scope = _ENDS[tag]
            while any(n.tag in own for n in self._within(scope)):
                self._close(own, scope)
        if tag == "br":
            self.open[-1].children.append("\n")
            return
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def _within(self, scope: set[str]) -> list[Node]:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in scope:
                return self.open[k + 1 :]
        return self.open[1:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and all(n.tag != "p" for n in self.open):
            self.open[-1].children.append(Node("p"))
        elif tag in HEADINGS:
            self._close(frozenset(HEADINGS), _SCOPE)
        elif tag == "br":
            self.open[-1].children.append("\n")
        elif tag not in VOID:
            self._close({tag}, {"table"} if tag not in ("table",) and tag in BLOCKS else set())

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse_tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    root = builder.root
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in DROPPED]
        stack += [c for c in node.children if isinstance(c, Node)]
    return root


def _plain(text: str) -> str:
    return " ".join(re.split(r"[\s﻿]+", text)).strip()


def _listed(node: Node) -> str:
    items = [n for n in node.descendants() if n.tag == "li"]
    nested = frozenset(("ul", "ol"))
    return "\n".join(f"{f'{k}.' if node.tag == 'ol' else '-'} {n.text(nested)}" for k, n in enumerate(items, 1))


def _rows(node: Node) -> str:
    rows = [n for n in node.descendants() if n.tag == "tr"]
    return "\n".join(" | ".join(c.text() for c in r.descendants() if c.tag in ("th", "td")) for r in rows)


def blocks_of(root: Node, containers: bool = True) -> list[tuple[str, str, list[str]]]:
    """(kind, text, heading path) in document order. A container counts only where it holds no other block."""
    out: list[tuple[str, str, list[str]]] = []
    path: dict[int, str] = {}
    stack: list[tuple[Node, bool]] = [(c, False) for c in reversed(root.children) if isinstance(c, Node)]
    while stack:
        node, held = stack.pop()
        inside = held or node.tag in ("table", "ul", "ol")
        stack += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]
        if node.tag not in BLOCKS or held:
            continue
        if node.tag in CONTAINERS and (not containers or any(n.tag in BLOCKS for n in node.descendants())):
            continue
        text = node.text()
        if not _plain(text):
            continue
        if node.tag in HEADINGS:
            level = int(node.tag[1])
            path = {k: v for k, v in path.items() if k < level} | {level: _plain(text)}
        kind, body = ("heading", text) if node.tag in HEADINGS else ("list", _listed(node)) if node.tag in ("ul", "ol") else ("table", _rows(node)) if node.tag == "table" else ("paragraph", text)
        if body := _plain(body):
            out.append((kind, body, [path[k] for k in sorted(path)]))
    return out


BLOCK_SCHEMA = "block_index int, kind string, text string, heading_path array<string>"


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block_index, block_id, kind, text, heading_path) of each page, page by page in Arrow batches."""
    rows = pages.select(key, F.coalesce(html, F.lit("")).alias("_html"))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {BLOCK_SCHEMA}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, i, *block) for k, page in zip(frame[key], frame["_html"], strict=True) for i, block in enumerate(blocks_of(parse_tree(page)))]
            yield pd.DataFrame(out, columns=[key, "block_index", "kind", "text", "heading_path"])

    found = rows.mapInPandas(run, schema)
    return found.select(key, "block_index", block_id(F.col("block_index")).alias("block_id"), "kind", "text", "heading_path")


_DATA_URL = re.compile(r"^data:image/(jpeg|png|gif|webp);base64,([A-Za-z0-9+/=\s]+)$", re.IGNORECASE)


def decode_data_url(url: str) -> tuple[str, bytes] | None:
    """(media type, bytes) of an embedded picture of a known kind; None otherwise."""
    if not (m := _DATA_URL.match(url.strip())):
        return None
    try:
        data = base64.b64decode(re.sub(r"\s", "", m[2]), validate=True)
    except (binascii.Error, ValueError):
        return None
    return (f"image/{m[1].lower()}", data) if data else None


def embedded_images(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, image_index, media_type, data, sha256): pictures in data URLs, one of each content per page, without Python."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<img\b[^>]*?\bsrc\s*=\s*["\'](data:image/(?:jpeg|png|gif|webp);base64,[A-Za-z0-9+/=\s]+)["\']'), 1)
    rows = pages.select(key, F.posexplode(found).alias("n", "url"))
    rows = rows.select(
        key, "n", F.lower(F.regexp_extract("url", "^[dD][^:]*:([^;]+);", 1)).alias("media_type"),
        F.try_to_binary(F.regexp_replace(F.regexp_replace("url", "^[^,]*,", ""), r"\s", ""), F.lit("base64")).alias("data"),
    ).where("length(data) > 0")
    return dedupe_bytes(rows, "n", [key]).select(key, F.col("n").alias("image_index"), "media_type", "data", "sha256")


def dedupe_bytes(rows: DataFrame, order: str, within: Sequence[str] = ()) -> DataFrame:
    """rows(data, ...) with one row of each content (in each group): the one with the least `order`; and sha256, copies."""
    names = [c for c in rows.columns if c not in within]
    first = rows.withColumn("sha256", F.sha2("data", 256)).groupBy(*within, "sha256").agg(F.min_by(F.struct(*names), order).alias("x"), F.count(F.lit(1)).alias("copies"))
    return first.select(*within, "sha256", "copies", "x.*")


#: Elements that a page shown to readers must not have.
UNSAFE = frozenset(("script", "iframe", "object", "embed", "form", "input", "button", "textarea", "select", "option", "base", "link", "meta", "foreignobject"))


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.skip: list[str] = []

    def _tag(self, tag: str, attrs: list, end: str) -> None:
        if self.skip or tag in UNSAFE:
            if tag in UNSAFE and tag not in VOID and not end:
                self.skip.append(tag)
            return
        kept = "".join(f' {n}="{_escaped(v or "")}"' for n, v in attrs if _safe(n.lower(), v or ""))
        self.out.append(f"<{tag}{kept}{end}>")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tag(tag, attrs, "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._tag(tag, attrs, "/")

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag not in UNSAFE:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def _escaped(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")


def _safe(name: str, value: str) -> bool:
    """Whether an attribute may stay: no handlers or nested documents, pictures only from data URLs, links only within the page."""
    if name.startswith("on") or name in ("srcdoc", "srcset", "action", "formaction"):
        return False
    if name == "src":
        return decode_data_url(value) is not None
    return value.startswith("#") if name in ("href", "xlink:href") else True


def sanitise(html: str) -> str:
    cleaner = _Cleaner()
    cleaner.feed(html)
    cleaner.close()
    return "".join(cleaner.out)


def sanitised(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the column cleaned for showing, in Arrow batches."""

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else sanitise(x))

    return pages.withColumn(html, clean(html))
