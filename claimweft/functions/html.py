"""Pages of HTML: container choice, furniture removal, block-aware text, author and date. Arrow in, Arrow out.

The tree is built with the standard library's tolerant parser; elements that are left open are closed by their parents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg".split())
BLOCKS = frozenset("p div section article main header footer aside nav ul ol li table tr blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption form br hr dl dt dd".split())
#: What marks furniture of a page, in the order in which it is taken out: elements, an element with a role,
#: roles, parts of class names, of ids and of labels, overlays, and banners without a role.
NOISE_RULES: list[tuple[str, str]] = [
    ("tag", "nav"), ("tag", "aside"), ("tag", "footer"), ("header-role", "banner"), ("role", "navigation"), ("role", "complementary"), ("role", "search"),
    ("class", "related"), ("class", "teaser"), ("class", "more-from"), ("class", "recommend"), ("class", "trending"), ("class", "newsletter"), ("class", "subscribe"),
    ("class", "paywall"), ("class", "comments"), ("class", "social"), ("class", "share"), ("id", "related"), ("id", "recommend"), ("id", "comments"),
    ("aria-label", "related"), ("aria-label", "more"), ("class", "cookie"), ("class", "consent"), ("class-no-role", "banner"),
]
#: Endings of item types that mark an article.
ARTICLE_TYPES = ("/NewsArticle", "/Article", "/BlogPosting", "/ReportageNewsArticle")
SUBSTANTIAL = 400
_CODE = re.compile(r"&#(x[0-9a-fA-F]+|\d+);")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def path(self) -> list[int]:
        """Places from the root down to this node."""
        out, node = [], self
        while node.parent is not None:
            out.append(next(i for i, c in enumerate(node.parent.children) if c is node))
            node = node.parent
        return out[::-1]

    def follow(self, path: list[int]) -> Node:
        node = self
        for i in path:
            node = node.children[i]
        return node

    def raw_text(self) -> str:
        """All characters below this node, shown or not."""
        return "".join(c if isinstance(c, str) else c.raw_text() for c in self.children)

    def text(self) -> str:
        """One line a block; what isn't shown is left out."""
        parts: list[str] = []

        def visit(node: Node) -> None:
            block = node.tag in BLOCKS
            if block:
                parts.append("\n")
            for c in node.children:
                if isinstance(c, str):
                    parts.append(re.sub(r"\s+", " ", c))
                elif c.tag not in HIDDEN and c.attrs.get("aria-hidden") != "true":
                    visit(c)
            if block:
                parts.append("\n")

        visit(self)
        lines = (re.sub(r" {2,}", " ", x).strip() for x in "".join(parts).split("\n"))
        return "\n".join(x for x in lines if x)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p" or tag == "li" and self.at.tag == "li":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def noise_rule(node: Node) -> int | None:
    """Number of the first rule that takes this node out, if any does."""
    role = node.attrs.get("role")
    by = {name: node.attrs.get(name, "").lower() for name in ("class", "id", "aria-label")}
    for k, (where, value) in enumerate(NOISE_RULES):
        if where == "tag":
            hit = node.tag == value
        elif where == "header-role":
            hit = node.tag == "header" and role == value
        elif where == "role":
            hit = role == value
        elif where == "class-no-role":
            hit = role is None and value in by["class"]
        else:
            hit = value in by[where]
        if hit:
            return k
    return None


def drop_noise(root: Node) -> int:
    """Furniture leaves the tree, rule by rule; how many elements went. What an earlier rule took along isn't counted."""
    gone, found = 0, []
    stack: list[tuple[Node, int]] = [(c, len(NOISE_RULES)) for c in root.children if isinstance(c, Node)]
    while stack:
        node, least = stack.pop()
        rule = noise_rule(node)
        if rule is not None:
            gone += rule <= least
            found.append(node)
            least = min(least, rule)
        stack += [(c, least) for c in node.children if isinstance(c, Node)]
    for node in found:
        node.parent.children = [c for c in node.parent.children if c is not node]
    return gone


def is_substantial(node: Node) -> bool:
    return len(node.raw_text().strip()) > SUBSTANTIAL


def content_score(node: Node) -> int:
    return len(node.raw_text().strip()) - 50 * sum(n.tag == "a" for n in node.walk() if n is not node)


def container(root: Node) -> tuple[Node, str]:
    """The first marked article if substantial, else the only substantial article, the best of them, main, its role, or
    the whole body."""
    marked = next((n for n in root.walk() if n.attrs.get("itemtype", "").endswith(ARTICLE_TYPES)), None)
    if marked is not None and is_substantial(marked):
        return marked, "schema"
    articles = [n for n in root.walk() if n.tag == "article" and is_substantial(n)]
    if articles:
        return max(articles, key=content_score), "article" if len(articles) == 1 else "best-article"
    for test, name in ((lambda n: n.tag == "main", "main"), (lambda n: n.attrs.get("role") == "main", "role-main")):
        node = next((n for n in root.walk() if test(n)), None)
        if node is not None and is_substantial(node):
            return node, name
    return next((n for n in root.walk() if n.tag == "body"), root), "document"


def _meta(root: Node, *names: str) -> str | None:
    for name in names:
        for n in root.walk():
            if n.tag == "meta" and name in (n.attrs.get("name"), n.attrs.get("property"), n.attrs.get("itemprop")) and n.attrs.get("content", "").strip():
                return n.attrs["content"].strip()
    return None


def _by_class(root: Node, *parts: str) -> str | None:
    for p in parts:
        for n in root.walk():
            if (p in n.attrs.get("class", "").lower() or n.attrs.get("itemprop") == p or n.attrs.get("rel") == p) and n.text().strip():
                return n.text().strip()
    return None


def author(root: Node) -> str | None:
    found = _meta(root, "author", "article:author") or _by_class(root, "author", "byline")
    return re.sub(r"^(by|von)\s+", "", found, flags=re.I) if found else None


def published(root: Node) -> str | None:
    found = _meta(root, "article:published_time", "datePublished", "date", "pubdate")
    if found:
        return found
    for n in root.walk():
        if n.attrs.get("itemprop") == "datePublished" or n.tag == "time":
            value = n.attrs.get("datetime") or n.attrs.get("content") or n.text().strip()
            if value:
                return value
    return _by_class(root, "date", "published")


_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}


def _inline(node: Node) -> str:
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(re.sub(r"\s+", " ", c))
        elif c.tag in HIDDEN:
            continue
        elif c.tag == "br":
            parts.append("\n")
        elif c.tag == "img":
            parts.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})" if c.attrs.get("src") else "")
        else:
            inner = _inline(c)
            bare = inner.strip()
            if c.tag == "a" and c.attrs.get("href") and bare:
                inner = f"[{bare}]({c.attrs['href']})"
            elif c.tag in _MARKS and bare:
                mark = _MARKS[c.tag]
                inner = inner.replace(bare, f"{mark}{bare}{mark}", 1)
            parts.append(inner)
    return "".join(parts)


def _blocks(node: Node) -> list[str]:
    """Blocks of markdown below a node; text between blocks is a block of its own."""
    out: list[str] = []
    loose = Node("#loose", {}, None)

    def settle() -> None:
        text = re.sub(r" {2,}", " ", _inline(loose)).strip()
        if text:
            out.append(re.sub(r" ?\n ?", "\n", text))
        loose.children = []

    for c in node.children:
        if isinstance(c, str) or c.tag not in BLOCKS and not any(isinstance(n, Node) and n.tag in BLOCKS for n in c.walk()) or c.tag == "br":
            loose.children.append(c)
            continue
        settle()
        if c.tag in HIDDEN:
            continue
        if c.tag[:1] == "h" and c.tag[1:].isdigit():
            text = re.sub(r"\s+", " ", _inline(c)).strip()
            out += [f"{'#' * int(c.tag[1:])} {text}"] if text else []
        elif c.tag in ("ul", "ol"):
            items = [n for n in c.children if isinstance(n, Node) and n.tag == "li"]
            lines = []
            for k, item in enumerate(items, 1):
                mark = f"{k}. " if c.tag == "ol" else "- "
                inner = "\n".join(_blocks(item)).split("\n")
                lines += [mark + inner[0], *("  " + x for x in inner[1:] if x)] if inner[0] else []
            out += ["\n".join(lines)] if lines else []
        elif c.tag == "blockquote":
            inner = "\n\n".join(_blocks(c))
            out += ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
        elif c.tag == "pre":
            out.append(f"```\n{c.raw_text().strip(chr(10))}\n```")
        elif c.tag == "hr":
            out.append("---")
        elif c.tag == "tr":
            cells = [re.sub(r"\s+", " ", _inline(n)).strip() for n in c.children if isinstance(n, Node) and n.tag in ("td", "th")]
            out += ["| " + " | ".join(cells) + " |"] if cells else []
        else:
            out += _blocks(c)
    settle()
    return out


def markdown(node: Node) -> str:
    """A tree as markdown: headings, paragraphs, lists, quotations, code, links, pictures and emphasis."""
    return "\n\n".join(_blocks(node))


def extract(html: str | None) -> dict:
    root = parse(html or "")
    title = next((re.sub(r"\s+", " ", n.text()).strip() for n in root.walk() if n.tag == "title"), None)
    language = next((n.attrs.get("lang") for n in root.walk() if n.tag == "html"), None)
    who, when = author(root), published(root)
    body, strategy = container(root)
    gone = drop_noise(body)
    text = body.text()
    return {"title": title, "author": who, "published": when, "language": language or None, "markdown": markdown(body), "text": text, "word_count": len(text.split()), "strategy": strategy, "noise_removed": gone}


PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("author", T.StringType()), T.StructField("published", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("markdown", T.StringType()), T.StructField("text", T.StringType()), T.StructField("word_count", T.IntegerType()), T.StructField("strategy", T.StringType()), T.StructField("noise_removed", T.IntegerType()),
])
_ARROW = pa.schema([("title", pa.string()), ("author", pa.string()), ("published", pa.string()), ("language", pa.string()), ("markdown", pa.string()), ("text", pa.string()), ("word_count", pa.int32()), ("strategy", pa.string()), ("noise_removed", pa.int32())])


def extract_pages(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """(keys, title, author, published, language, markdown, text, word_count, strategy, noise_removed) of each page. Narrow."""
    schema = T.StructType([pages.schema[k] for k in keys] + PAGE.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_pylist([extract(h) for h in batch.column(html_col).to_pylist()], schema=_ARROW)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *rows.columns], [*keys, *rows.schema.names])

    return pages.select(*keys, html_col).mapInArrow(run, schema)


def decode_numeric(text: str | None) -> str | None:
    """Numeric entities by UTF-16 code unit, so that large numbers wrap at 65,536."""
    if text is None:
        return None
    value = lambda m: int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
    units = _CODE.sub(lambda m: chr(value(m) % 65536), text)
    return units.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
