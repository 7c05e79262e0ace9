"""Main text of web pages by site template removal.

Element subtrees of the body are hashed; Spark counts, per host, on how many distinct pages each hash occurs; subtrees that
recur on ``LEAST_PAGES`` of them are the host's template and are deleted first. Pages of a host with the same main text are
copies of one page and count once, and the number does not rise with the host. What HTML itself says decides about the rest:
elements for menus, headers, footers, sidebars, forms, scripts and styles go, elements whose class, id or role names such a
thing go, and where a page marks its articles, or else its main elements, only these are taken. Inside an article only
containers can be template, since a sentence that many articles share is still text. How many subtrees each of the two has
removed is told per page.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legispark.llm.storage import materialize

#: A subtree is template if it is on so many distinct pages of the host.
LEAST_PAGES = 4
#: Hosts' templates go to all workers up to so many hashes; beyond it they are joined by host and hash.
BROADCAST_HASHES = 200_000

# Element names of HTML by what they mean here, and words in class, id and role that name what is no text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "head", "datalist", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "select", "td", "th", "blockquote"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "blockquote", "header", "center"}
NAMES_NO_TEXT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "sidenav", "footer", "masthead", "topbar", "toolbar",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus",
    "respond", "replies", "widget", "pagination", "pager", "skip", "search", "complementary", "contentinfo", "alert",
}
NAMES_HEADER = {"header", "head"}
# Words that may stand beside such a name without changing what it names; any other word makes it the name of something else.
NAMES_NEUTRAL = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "inner", "outer", "box", "block", "bar", "area", "wrap", "wrapper", "container", "section", "list", "item", "items",
    "links", "link", "form", "icons", "buttons", "button", "content", "posts", "articles", "stories", "primary", "secondary", "inline", "slot", "unit", "banner", "to", "in", "us", "up",
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("attributes", "children", "digest", "tag")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.digest = tag, attributes, [], 0


def parse(html: str) -> Node:
    """A tree of elements and strings. Missing end tags are implied as HTML does for common cases; an unfinished tag at the end is dropped."""
    root = Node("#", "")
    stack, at = [root], 0
    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        name = m[2] or m[5]
        if not name or m[0][-1] != ">":
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            else:
                if tag in ("p", "br"):
                    stack[-1].children.append(Node("br", ""))
            continue
        if tag in CLOSES_P or tag in CLOSES_SAME:
            closed = ({"p"} if tag in CLOSES_P else set()) | CLOSES_SAME.get(tag, set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    del stack[k:]
                    if tag not in CLOSES_SAME:
                        break
                elif stack[k].tag in SCOPES and not (tag in ("tr", "thead", "tbody", "tfoot") and stack[k].tag in ("td", "th")):
                    break
        node = Node(tag, m[3] or m[6] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = end.start() if end else len(html)
            close = html.find(">", at)
            at = len(html) if close < 0 else close + 1
        elif tag not in VOID and not node.attributes.endswith("/"):
            stack.append(node)


def names(node: Node) -> list[set[str]]:
    """The words of each class, of the id and of the role."""
    if not node.attributes or "=" not in node.attributes:
        return []
    return [{x.lower() for x in _NAME.findall(token)} for m in _ATTRIBUTE.finditer(node.attributes) if m[1].lower() in ("class", "id", "role") for token in (m[2] or m[3] or m[4] or "").split()]


def _named(found: list[set[str]], wanted: set[str]) -> bool:
    """Whether a name is one of ``wanted``, with neutral words and numbers beside it at most: "ad-box" is, "related-work" is not."""
    return any(words & wanted and all(w in wanted or w in NAMES_NO_TEXT or w in NAMES_NEUTRAL or w.isdigit() or len(w) == 1 for w in words) for words in found)


def is_dropped(node: Node, in_article: bool) -> bool:
    if node.tag in RAW or node.tag in DROPPED:
        return True
    if node.tag == "header" and not (in_article and any(isinstance(c, Node) and c.tag in ("h1", "h2") for c in node.children)):
        return True
    if node.tag in ("html", "body", "main", "article", "#"):
        return node.tag == "article" and _named(names(node), {"comment", "comments"})
    found = names(node)
    return bool(found) and (_named(found, NAMES_NO_TEXT) or (not in_article and _named(found, NAMES_HEADER)))


def _hash(node: Node) -> int:
    """The hash of a subtree: its tag and what its children hash to, white space aside. Sets ``digest`` of all elements; iterative, so that depth needs no stack."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(order):
        parts = [x.tag]
        for c in x.children:
            parts.append(str(c.digest) if isinstance(c, Node) else " ".join(c.split()))
        x.digest = int.from_bytes(hashlib.blake2b("\x00".join(p for p in parts if p).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return node.digest


def _roots(tree: Node) -> list[tuple[Node, bool]]:
    """Where the text is, in the order of the page: the articles, else the main elements, else the first body or all."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    todo = [tree]
    while todo:
        x = todo.pop()
        if x.tag in found and not is_dropped(x, False):
            found[x.tag].append(x)
            if x.tag == "article":
                continue  # what is nested in an article is part of it
        elif x.tag not in ("#", "html", "body") and (x.tag in RAW or x.tag in DROPPED):
            continue
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    if found["article"]:
        return [(x, True) for x in found["article"]]
    if found["main"]:
        inner = {id(c) for x in found["main"] for c in _descendants(x)}
        return [(x, True) for x in found["main"] if id(x) not in inner]
    return [(found["body"][0] if found["body"] else tree, False)]


def _descendants(node: Node) -> Iterator[Node]:
    todo = [c for c in node.children if isinstance(c, Node)]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in x.children if isinstance(c, Node)]


def _subtrees(tree: Node) -> list[tuple[Node, bool, bool]]:
    """The subtrees of the body that could be template, each with whether HTML drops it and whether it is in an article.

    What HTML drops counts as a whole and not by its parts, so that a word of a menu is no template elsewhere. Of an article
    only containers can be; of what is outside, all that stands as a block.
    """
    roots = _roots(tree)
    whole = len(roots) == 1 and not roots[0][1]
    inside = set() if whole else {id(root) for root, _ in roots}
    found: list[tuple[Node, bool, bool]] = []
    todo = [(roots[0][0] if whole else tree, False)]
    while todo:
        x, in_article = todo.pop()
        for c in x.children:
            if not isinstance(c, Node) or c.tag in RAW or c.tag == "head":
                continue
            if id(c) in inside:
                todo.append((c, True))
            elif is_dropped(c, in_article):
                if c.tag not in VOID:
                    found.append((c, True, in_article))
            else:
                if c.tag in CONTAINERS if in_article else c.tag not in INLINE and c.tag not in VOID and c.tag not in ("html", "body"):
                    found.append((c, False, in_article))
                todo.append((c, in_article))
    return found


def _hashed(found: list[tuple[Node, bool, bool]]) -> None:
    """Sets the digests of subtrees; a subtree inside another one has its own from that."""
    for x, _, _ in found:
        if not x.digest:
            _hash(x)


def candidates(tree: Node) -> set[int]:
    """Hashes of the subtrees of a page that could be template."""
    found = _subtrees(tree)
    _hashed(found)
    return {x.digest for x, _, _ in found}


def removed(tree: Node, template: frozenset[int] | set[int]) -> tuple[int, int]:
    """How many subtrees of a page go because they are template, and how many others because HTML says that they are no text,
    each counted where it is outermost. Blocks beside the articles or main elements are of the second kind."""
    found = _subtrees(tree)
    _hashed(found)
    roots = {id(root) for root, in_article in _roots(tree) if in_article}
    # What has an article inside stays.
    order, above, holds = [tree], {}, set()
    for x in order:
        for c in x.children:
            if isinstance(c, Node):
                above[id(c)] = x
                order.append(c)
        if id(x) in roots:
            y = above.get(id(x))
            while y is not None and id(y) not in holds:
                holds.add(id(y))
                y = above.get(id(y))
    kind = {id(x): (x.digest in template, dropped, in_article) for x, dropped, in_article in found}
    by_template = by_html = 0
    todo = [tree]
    while todo:
        x = todo.pop()
        for c in x.children:
            if not isinstance(c, Node):
                continue
            is_template, dropped, in_article = kind.get(id(c), (False, False, True))
            if is_template and id(c) not in holds:
                by_template += 1
            elif dropped or (roots and id(c) in kind and not in_article and id(c) not in holds):
                by_html += 1
            else:
                todo.append(c)
    return by_template, by_html


def main_text(html: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of a page without what is dropped and without subtrees whose hash is in ``template``."""
    return _text(parse(html), template)


def _text(tree: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    if template:
        _hashed(_subtrees(tree))
    out: list[str] = []
    for root, in_article in _roots(tree):
        todo: list = [" ", root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x is not root:
                if is_dropped(x, in_article):
                    out.append(" ")
                    continue
                if template and x.digest in template and (x.tag in CONTAINERS if in_article else x.tag not in INLINE):
                    out.append(" ")
                    continue
            if x.tag not in INLINE:
                out.append(" ")
                todo.append(" ")
            todo += reversed(x.children)
    return " ".join("".join(out).split())


def host_of(url: Column) -> Column:
    """The host in lower case; an empty text where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, votes = [], []
        for h in batch.column(2).to_pylist():
            tree = parse(h or "")
            found.append(list(candidates(tree)))
            votes.append(int.from_bytes(hashlib.blake2b(_text(tree).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["host", "page", "vote", "hashes"])


def _keyed(pages: DataFrame, *columns: str) -> DataFrame:
    """With the host and, as ``page``, a digest of the html: equal pages of a host have the same template."""
    return pages.select(*columns, host_of(F.col("url")).alias("host"), F.md5(F.coalesce("html", F.lit(""))).alias("page"), "html")


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, vote, hashes) per row: its candidates, and the hash of its main text with the template in it."""
    return _keyed(pages).mapInArrow(_candidates, "host string, page string, vote bigint, hashes array<bigint>")


def site_templates(found: DataFrame) -> DataFrame:
    """(host, hash) of each host's recurring subtrees. Copies of a page have one vote; no host is too large for one."""
    votes = found.select("host", "vote", F.explode("hashes").alias("hash")).distinct()
    return votes.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host", "hash")


def _extract(batches: Iterator[pa.RecordBatch], sites: dict[str, frozenset[int]] | None) -> Iterator[pa.RecordBatch]:
    """Columns page_id, url, html, and the host if ``sites`` has the templates, else the page's own."""
    for batch in batches:
        own = batch.column(3).to_pylist()
        templates = [frozenset(t or ()) for t in own] if sites is None else [sites.get(host, frozenset()) for host in own]
        trees = [parse(h) if h else None for h in batch.column(2).to_pylist()]
        gone = [removed(x, t) if x else (0, 0) for x, t in zip(trees, templates, strict=True)]
        text = [_text(x, t) if x else "" for x, t in zip(trees, templates, strict=True)]
        counts = [pa.array([g[k] for g in gone], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), *counts], names=["page_id", "url", "text", "n_chars", "n_template", "n_semantic"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_template, n_semantic) per row of ``pages``: the main text, and how many subtrees went as
    template and by what HTML says.

    A null html gives an empty text; a null url shares the host "" with other such rows; rows of a host with the same
    main text count as one page. Extra columns are not read.
    """
    found = materialize(subtrees(pages), "subtrees")
    templates = materialize(site_templates(found), "templates")
    rows = _keyed(pages, "page_id", "url")
    if templates.count() <= BROADCAST_HASHES:
        sites = {r.host: frozenset(r.template) for r in templates.groupBy("host").agg(F.collect_list("hash").alias("template")).collect()}
        rows = rows.select("page_id", "url", "html", "host")
    else:
        sites = None
        marks = found.select("host", "page", F.explode("hashes").alias("hash")).join(templates, ["host", "hash"]).groupBy("host", "page").agg(F.collect_set("hash").alias("template"))
        rows = rows.join(marks, ["host", "page"], "left").select("page_id", "url", "html", "template")
    return rows.mapInArrow(lambda batches: _extract(batches, sites), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_template long, n_semantic long")
