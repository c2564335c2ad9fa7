"""HTML to text, links and markdown, as Arrow-batched functions over the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOISE = {"script", "style", "noscript", "svg", "iframe", "template"}
CHROME = {"nav", "header", "footer", "form"}
#: What markdown leaves out if it is short.
MARKDOWN_CHROME = {"nav", "header", "footer", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A start tag ends these, if they are still open.
_AFTER_P = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div", "section", "article", "blockquote", "pre", "form", "hr", "nav", "header", "footer", "main", "aside")
ENDED_BY = {**{t: {"p"} for t in _AFTER_P}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
SHORT_CHROME = 1000
LINK_TEXT = 120


class _Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def pieces(self, skip: frozenset[str] = frozenset()):
        """The texts below the node in order, without those in tags to skip. Pages nest deeper than Python's calls may."""
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in skip:
                stack.extend(reversed(c.children))

    def text(self) -> str:
        return " ".join(w for p in self.pieces() for w in p.split())

    def is_longer(self, than: int) -> bool:
        """Whether the text has at least so many characters; no more of it is read."""
        n = -1
        for p in self.pieces():
            for w in p.split():
                n += len(w) + 1
                if n >= than:
                    return True
        return False


class _Tree(HTMLParser):
    """A tree that forgives what is not closed: an end tag closes all up to its start."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        while self.open[-1].tag in ENDED_BY.get(tag, ()):
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str | None) -> _Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def text_of(html: str | None) -> str:
    """The pieces of text outside scripts, forms and page furniture, a line each."""
    return "\n".join(x for x in (" ".join(p.split()) for p in tree(html).pieces(frozenset(NOISE | CHROME))) if x)


def links_of(html: str | None) -> list[dict[str, str]]:
    out, stack = [], [tree(html)]
    while stack:
        node = stack.pop()
        if node.tag == "a" and "href" in node.attrs:
            out.append({"href": node.attrs["href"], "text": node.text()[:LINK_TEXT]})
        stack += [c for c in reversed(node.children) if isinstance(c, _Node)]
    return out


def _called(step):
    """The value of a generator that yields generators as calls and is sent their values: recursion on the heap."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _inline(node: _Node):
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
            continue
        if c.tag in NOISE:
            continue
        inner = " ".join((yield _inline(c)).split())
        if c.tag in ("b", "strong") and inner:
            inner = f"**{inner}**"
        elif c.tag in ("i", "em") and inner:
            inner = f"*{inner}*"
        elif c.tag == "a" and inner and c.attrs.get("href"):
            inner = f"[{inner}]({c.attrs['href']})"
        elif c.tag == "br":
            inner = "\n"
        out.append(inner)
    return " ".join(x for x in out if x)


def _line(node: _Node):
    return " ".join((yield _inline(node)).split())


def _list(node: _Node):
    out = []
    for x in node.children:
        if isinstance(x, _Node) and x.tag == "li":
            out.append((f"{len(out) + 1}. " if node.tag == "ol" else "- ") + (yield _line(x)))
    return "\n".join(out)


def _table(node: _Node):
    rows, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.tag == "tr":
            cells = []
            for x in n.children:
                if isinstance(x, _Node) and x.tag in ("td", "th"):
                    cells.append((yield _line(x)))
            rows.append("| " + " | ".join(cells) + " |")
            if len(rows) == 1:
                rows.append("|" + " --- |" * len(cells))
        else:
            stack += [x for x in reversed(n.children) if isinstance(x, _Node)]
    return "\n".join(rows)


def _blocks(node: _Node):
    out: list[str] = []
    loose: list[str] = []

    def flush():
        line = " ".join(" ".join(loose).split())
        loose.clear()
        if line:
            out.append(line)

    for c in node.children:
        if isinstance(c, str):
            loose.append(c)
        elif c.tag in NOISE or c.tag in ("title", "head"):
            continue
        elif c.tag in MARKDOWN_CHROME and not c.is_longer(SHORT_CHROME):
            continue
        elif c.tag in HEADINGS:
            flush()
            out.append(f"{HEADINGS[c.tag]} {(yield _line(c))}")
        elif c.tag in ("ul", "ol"):
            flush()
            out.append((yield _list(c)))
        elif c.tag == "table":
            flush()
            if table := (yield _table(c)):
                out.append(table)
        elif c.tag in ("b", "strong", "i", "em", "a", "span", "br", "code", "small"):
            wrap = _Node("", {})
            wrap.children = [c]
            loose.append((yield _inline(wrap)))
        else:
            flush()
            out += yield _blocks(c)
    flush()
    return [b for b in out if b.strip("#- \n")]


def _find(node: _Node, tag: str) -> _Node | None:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag == tag:
            return n
        stack += [c for c in reversed(n.children) if isinstance(c, _Node)]
    return None


def markdown_of(html: str | None) -> str:
    """The main part, else the article, else the body, as markdown blocks."""
    root = tree(html)
    return "\n\n".join(_called(_blocks(_find(root, "main") or _find(root, "article") or _find(root, "body") or root)))


def meta_of(html: str | None) -> list[dict[str, str]]:
    """The named meta tags of a page: by name, property or http-equiv, the first that is there."""
    out, stack = [], [tree(html)]
    while stack:
        node = stack.pop()
        if node.tag == "meta":
            name = next((node.attrs[k] for k in ("name", "property", "http-equiv") if node.attrs.get(k)), "")
            if name and node.attrs.get("content"):
                out.append({"name": name, "content": node.attrs["content"]})
        stack += [c for c in reversed(node.children) if isinstance(c, _Node)]
    return out


def section_of(html: str | None, fragment: str | None) -> str:
    """The part under the heading that a fragment names, up to a heading of its level or higher."""
    found: list[tuple[int, str, bool]] = []
    stack = [tree(html)]
    while stack:
        n = stack.pop()
        if n.tag in HEADINGS:
            found.append((int(n.tag[1]), n.text(), fragment is not None and n.attrs.get("id") == fragment))
        elif n.tag in ("p", "li", "td"):
            found.append((9, n.text(), False))
        else:
            stack += [c for c in reversed(n.children) if isinstance(c, _Node)]
    out, level = [], 0
    for depth, text, here in found:
        if level and depth <= level:
            break
        if level or here:
            level = level or depth
            out.append(text)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(text_of)


@F.pandas_udf(T.StringType())
def html_markdown(html: pd.Series) -> pd.Series:
    return html.map(markdown_of)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])))
def html_links(html: pd.Series) -> pd.Series:
    return html.map(links_of)


@F.pandas_udf(T.StringType())
def html_section(html: pd.Series, fragment: pd.Series) -> pd.Series:
    return pd.Series([section_of(h, f) for h, f in zip(html, fragment)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.StringType())])))
def html_meta(html: pd.Series) -> pd.Series:
    return html.map(meta_of)
