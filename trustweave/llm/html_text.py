"""HTML extraction: main text of pages, with templates found by recurring element subtrees of a host."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

#: A subtree on at least so many pages of a host, and on this share of them, is part of its template. So is one that
#: stands beside so many different articles, or beside SPREAD times the root of the host's pages where that is more.
PAGES, SHARE, SPREAD = 3, 0.3, 0.5
#: Up to so many template subtrees in all (8 bytes each) the table of hosts is broadcast; beyond, joined.
SENT = 200_000

# Names of HTML elements by their part in a page, and words that mark furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe object embed svg math canvas audio video select button textarea input head title dialog menu".split()
)
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("br caption td th tr tbody thead tfoot dd dt li html body".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ITEMS = frozenset("li dt dd tr td th caption figcaption".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|subscription|share|sharing|social|related|recommended|comments?|disqus|respond|pagination|pager|widget|toolbar|skip-link|copyright|legal)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>?", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "hash", "items", "tag")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.hash, self.items = tag, attrs, 0, []

    def seal(self) -> None:
        """Hash name, attributes and items; inner nodes are sealed before, so a page is hashed once however deep it nests."""
        parts = [x if isinstance(x, str) else f"{x.hash:x}" for x in self.items]
        self.hash = xxhash.xxh3_64_intdigest(" ".join("\0".join([self.tag, self.attrs, *parts]).split()).encode("utf-8", "surrogatepass"))

    def marked(self) -> bool:
        """Whether name, class, id or role says that this is page furniture."""
        if self.tag in DROPPED:
            return True
        if not self.attrs or self.tag in ("html", "body", "article", "main"):
            return False
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(self.attrs)}
        if found.get("role", "").lower() in ROLES or "hidden" in self.attrs.lower().split() or found.get("aria-hidden") == "true":
            return True
        return any(FURNITURE.search(found.get(k, "")) for k in ("class", "id"))


def parse(page: str) -> Node:
    """The element tree: items are nodes and text pieces in order. Missing end tags are supplied."""
    root = Node("", "")
    stack, at = [root], 0
    opened = {"": 1}

    def close(until: int) -> None:
        while len(stack) > until:
            node = stack.pop()
            opened[node.tag] -= 1
            node.seal()

    def innermost(names, bounds=()) -> int:
        if len(names) == 1 and not opened.get(names[0], 0):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                return i
            if stack[i].tag in bounds:
                return 0
        return 0

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            i = innermost((tag,), ("table", "td", "th") if tag in INLINE else ())
            if i:
                close(i)
            elif tag == "p":
                empty = Node("p", "")
                empty.seal()
                stack[-1].items.append(empty)
            continue
        if tag in CLOSES_P and (i := innermost(("p",), ("td", "th", "button", "object"))):
            close(i)
        if tag == "li" and (i := innermost(("li",), ("ul", "ol", "menu"))):
            close(i)
        elif tag in ("dd", "dt") and (i := innermost(("dd", "dt"), ("dl",))):
            close(i)
        elif tag in ("td", "th") and (i := innermost(("td", "th"), ("tr", "table"))):
            close(i)
        elif tag == "tr" and (i := innermost(("tr",), ("table",))):
            close(i)
        elif tag == "option" and (i := innermost(("option",), ("select",))):
            close(i)
        node = Node(tag, m[3])
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            stop = end.start() if end else size
            node.items.append(page[at:stop])
            at = end.end() if end else size
            node.seal()
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
        else:
            node.seal()
    close(0)
    return root


def _walk(root: Node):
    """Nodes in page order with whether they lie inside an article or main part; no recursion, pages may nest deeply."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        yield node, inside
        inside = inside or node.tag in ("article", "main")
        stack += [(x, inside) for x in reversed(node.items) if isinstance(x, Node)]


def template_candidates(page: str) -> set[int]:
    """Hashes of the element subtrees that can be template: all but the page's skeleton and the prose of its articles."""
    return {
        node.hash - (1 << 63)
        for node, inside in _walk(parse(page))
        if node.tag not in ("", "html", "head", "body", "article", "main", "br", "meta", "link") and node.tag not in INLINE and not (inside and node.tag in PROSE)
    }


def _known(node: Node, item: bool) -> int:
    """The hash by which a subtree is counted: single items of a text apart from the same ones elsewhere."""
    return (node.hash ^ (0x9E3779B97F4A7C15 if item else 0)) - (1 << 63)


def recurring(page: str) -> dict[int, tuple[bool, int]]:
    """For each candidate: whether it is a single item of the text, and the hash of the longest paragraph or heading outside it.

    That paragraph tells different articles from copies of one page. Without one it is the page's longest piece of text outside.
    """
    root, nodes, ends = parse(page), [], {}
    stack: list = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is None:
            ends[inside] = len(nodes)
            continue
        nodes.append((node, inside))
        stack.append((None, len(nodes) - 1))
        inside = inside or node.tag in ("article", "main")
        stack += [(x, inside) for x in reversed(node.items) if isinstance(x, Node)]
    whole = not any(node.tag in ("article", "main") for node, _ in nodes)
    said = [(sum(len(x) for x in node.items if isinstance(x, str)), i) for i, (node, _) in enumerate(nodes) if node.tag not in RAW]
    ranked = [[i for n, i in sorted((x for x in said if prose == (nodes[x[1]][0].tag in PROSE)), reverse=True) if n] for prose in (True, False)]
    order = ranked[0] + ranked[1]
    out = {}
    for i, (node, inside) in enumerate(nodes):
        if node.tag in ("", "html", "head", "body", "article", "main", "br", "meta", "link") or node.tag in INLINE or (inside and node.tag in PROSE):
            continue
        item = (inside or whole) and node.tag in ITEMS
        around = next((nodes[j][0].hash for j in order if not i <= j < ends[i] and nodes[j][0].hash != node.hash), 0)
        out[_known(node, item)] = (item, around - (1 << 63))
    return out


def main_text(page: str, template: set[int] = frozenset()) -> str:
    """Text of the page's articles (of its body where there is none), without furniture and template subtrees."""
    root = parse(page)
    whole = not any(node.tag in ("article", "main") for node, _ in _walk(root))
    blocks: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(piece))).strip()
        if text:
            blocks.append(text)
        piece.clear()

    stack: list = [(root, whole)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside:
                piece.append(item)
        else:
            if item.marked():
                piece.append(" ")
                continue
            if item.tag == "header" and not any(n.tag == "h1" for n, _ in _walk(item)):
                continue
            if template and item.tag not in ("", "html", "body", "article", "main") and item.tag not in INLINE and not (inside and not whole and item.tag in PROSE):
                if _known(item, inside and item.tag in ITEMS) in template:
                    continue
            inside = inside or item.tag in ("article", "main")
            if item.tag in BLOCKS:
                flush()
                stack.append((None, inside))
            stack += [(x, inside) for x in reversed(item.items)]
    flush()
    return "\n".join(blocks)


def _hashed(batches):
    for batch in batches:
        found = [sorted(recurring(p or "").items()) for p in batch.column(1).to_pylist()]
        flat = [(x, item, around) for f in found for x, (item, around) in f]
        host = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [host, pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.bool_()), pa.array([f[2] for f in flat], pa.int64())],
            names=["host", "x", "item", "around"],
        )


def _extracted(batches):
    for batch in batches:
        texts = [main_text(p or "", frozenset(t or ())) for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page of ``pages`` (page_id long, url, html; other columns are ignored).

    Element subtrees are hashed, counted over the pages of each host and deleted where they recur on at
    least ``PAGES`` pages and a share of ``SHARE`` of the host, or beside many different articles (``SPREAD``), so
    that copies of a page are no template; single items of a text (``ITEMS``) go by the share only; paragraphs and
    headings of an article are kept whatever recurs. Elements that name, class, id or role mark as furniture go too. Returns page_id,
    url, text (blocks joined by newlines, empty if none) and n_chars. Null and empty html give empty text; a
    null or odd url is a host of its own kind (the empty host); repeated rows are pages each; pages that
    stop midway are read as far as they go; an empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), host.alias("host"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    hashes = pages.select("host", "html").mapInArrow(_hashed, "host string, x long, item boolean, around long")
    beside = hashes.groupBy("host", "x", "item", "around").agg(F.count("*").alias("n"))
    often = beside.groupBy("host", "x", "item").agg(F.sum("n").alias("n"), F.count("*").alias("articles")).where(F.col("n") >= PAGES)
    spread = ~F.col("item") & (F.col("articles") >= PAGES) & (F.col("articles") >= SPREAD * F.sqrt("pages"))
    often = often.join(total, "host").where((F.col("n") >= SHARE * F.col("pages")) | spread)
    # a host has at most (mean subtrees of a page) times the root of its pages / SPREAD of them
    often = cut(often.groupBy("host").agg(F.collect_list("x").alias("template")))
    size = often.agg(F.sum(F.size("template"))).first()[0] or 0
    joined = pages.join(F.broadcast(often) if size <= SENT else often, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
