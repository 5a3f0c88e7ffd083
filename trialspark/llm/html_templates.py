"""Main text of web pages: site templates are found by subtree hashes and removed."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import lookup, store

# A subtree is template when at least this many different pages of a host have
# it, however many pages the host has.  Only a container with half the text of an
# article or main element must also be on this share of the host's pages: it is
# rather that element's content, copied.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
# Elements that never hold main text.
DROP = frozenset(
    "head script style noscript template iframe object embed svg canvas nav footer aside form button select "
    "textarea input dialog menu title noembed noframes".split()
)
# Words of a class, id or role that mark menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "nav navbar navigation menu header footer sidebar aside notice cookie cookies consent banner ad ads adv advert "
    "adverts advertisement sponsor sponsored promo comment comments reply replies disqus breadcrumb breadcrumbs "
    "newsletter subscribe popup modal contentinfo complementary search pagination share sharing social related".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
# Opening one of these closes an open element of the second set, up to a boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "marks", "hidden", "kids", "digest", "size")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.digest, self.size = tag, [], 0, 0
        named = ATTR.findall(attrs) if attrs else ()
        self.marks = frozenset(w for _, *v in named for w in WORD.findall("".join(v).lower()))
        self.hidden = bool(attrs) and bool(HIDDEN.search(re.sub(r"\"[^\"]*\"(?<!none\")", "", attrs)))


def parse(page: str) -> Node:
    """A tree of ``Node`` and text; unclosed and stray tags are taken as browsers mostly do."""
    root = Node("#root")
    stack, at = [root], 0

    def pop_to(tags, stops=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            if tag in CLOSES_P:
                pop_to({"p"}, {"table", "td", "th", "li", "article", "section", "div", "body", "button"})
            if tag in CLOSES:
                pop_to(*CLOSES[tag])
            node = Node(tag, m["attrs"])
            stack[-1].kids.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
                node.kids.append(page[at : end.start()])
                at = end.end()
            elif tag not in VOID and not m["attrs"].rstrip().endswith("/") or tag in ("p", "div", "b", "a", "span"):
                stack.append(node)
        elif m["end"]:
            tag = m["end"].lower()
            pop_to({tag}, () if tag not in INLINE else {"p", "div", "li", "td", "article", "section"})
        elif m["cdata"]:
            stack[-1].kids.append(m["cdata"])
    return root


def digest(node: Node) -> int:
    """Hash of a subtree: its tag, marks and content, white space folded.  Signed 64 bits.

    Also sets each node's ``size``, the length of its text.
    """
    below: list[Node] = []
    todo = [node]
    while todo:
        n = todo.pop()
        below.append(n)
        todo += [k for k in n.kids if isinstance(k, Node)]
    # Kids come before their parents, at any depth.
    for n in reversed(below):
        n.size = 0
        h = xxhash.xxh64(f"{n.tag} {' '.join(sorted(n.marks))}\x00")
        for kid in n.kids:
            if isinstance(kid, str):
                text = SPACE.sub(" ", kid).strip()
                n.size += len(text)
                h.update(b"\x01" + text.encode("utf-8", "surrogatepass"))
            else:
                h.update(b"\x02%d" % kid.digest)
                n.size += kid.size
        n.digest = h.intdigest() - (1 << 63)
    return node.digest


def _dropped(node: Node, inside: bool) -> bool:
    if node.tag in DROP or node.hidden or node.tag == "header" and not inside:
        return True
    return node.tag not in ("#root", "html", "body", "article", "main") and bool(node.marks & MARKS) or (
        node.tag == "article" and bool(node.marks & {"comment", "comments", "reply", "replies", "ad", "ads", "advert"})
    )


def mains(node: Node) -> list[Node]:
    """The outermost article or main elements, in page order; the whole tree if there is none."""
    found: list[Node] = []
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main") and not _dropped(n, True):
            found.append(n)
        elif not _dropped(n, False):
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return found or [node]


def subtrees(root: Node) -> dict[int, bool]:
    """Hashes of a page's subtrees that may be template, and whether each has half of its main element's text.

    Text blocks inside the main element are content however often they recur
    (copies and shared passages), so only its containers are counted.
    """
    out: dict[int, bool] = {}
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        n, main = todo.pop()
        main = n if n.tag in ("article", "main") else main
        if n.tag not in ("#root", "html", "head", "body", "article", "main"):
            if main is None or n.tag in ("div", "section", "ul", "ol", "form", "figure", "header", "table"):
                out[n.digest] = out.get(n.digest, False) or main is not None and 2 * n.size >= main.size
        todo += [(k, main) for k in n.kids if isinstance(k, Node) and k.tag not in INLINE]
    return out


def main_text(root: Node, templates: frozenset[int]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def close():
        text = SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    def walk(start: Node):
        todo: list = [start]
        while todo:
            n = todo.pop()
            if n is None:
                close()
            elif isinstance(n, str):
                line.append(n)
            elif n is not start and (_dropped(n, start.tag in ("article", "main")) or n.digest in templates):
                if n.tag not in INLINE:
                    close()
            elif n.tag in INLINE:
                todo += reversed(n.kids)
            else:
                close()
                todo.append(None)
                todo += reversed(n.kids)

    for part in mains(root):
        walk(part)
        close()
    return " ".join(blocks)


def host(url: str = "url"):
    """Lower-case host of a URL; empty for a null or unusual one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _key():
    """Equal for equal pages; found without parsing."""
    return F.md5(F.coalesce("html", F.lit("")).cast("binary"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each subtree of a page, and one with the page's key and no subtree."""
    for batch in batches:
        rows = []
        for name, key, text in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            root = parse(text or "")
            page = digest(root)
            rows.append((name, page, key, None, None))
            rows += [(name, page, None, h, body) for h, body in subtrees(root).items()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["host", "page", "key", "subtree", "body"]
        )


def templates(pages: DataFrame, least: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """``host, key, templates``: for each page with any, hashes of its subtrees that recur on its host.

    Equal pages count once.  A host of many layouts has many templates; a page's
    list holds only its own, so it is never longer than the page.
    """
    rows = pages.select(host().alias("host"), _key().alias("key"), "html")
    kind = "host string, page long, key string, subtree long, body boolean"
    seen = store(rows.mapInArrow(_hashes, kind).distinct(), "subtrees")
    keys = seen.where("key is not null").select("host", "page", "key")
    blocks = seen.where("key is null").select("host", "page", "subtree", "body")
    counts = blocks.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"), F.max("body").alias("body"))
    totals = keys.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    many = counts.where(F.col("n") >= least).join(totals, "host")
    many = many.where(~F.col("body") | (F.col("n") >= share * F.col("pages"))).select("host", "subtree")
    many = lookup(store(many, "recurring"))
    own = blocks.select("host", "page", "subtree").join(many, ["host", "subtree"])
    own = own.groupBy("host", "page").agg(F.collect_set("subtree").alias("templates"))
    return keys.join(own, ["host", "page"]).select("host", "key", "templates")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, known in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist()):
            root = parse(page or "")
            digest(root)
            texts.append(main_text(root, frozenset(known or ())))
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page"), pa.array(texts, pa.string()), lengths], ["page", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null and empty pages give empty text.  Repeated rows are extracted alike and
    count once for templates; rows without a URL share one nameless host; an
    empty table gives no rows.
    """
    known = lookup(store(templates(pages), "templates"), ["templates"])
    rows = pages.select(F.struct("page_id", "url").alias("page"), host().alias("host"), _key().alias("key"), "html")
    rows = rows.join(known, ["host", "key"], "left").select("page", "html", "templates")
    kind = rows.schema["page"].dataType.simpleString()
    out = rows.mapInArrow(_extract, f"page {kind}, text string, n_chars long")
    return out.select("page.page_id", "page.url", "text", "n_chars")
