"""Main text of web pages: site templates removed by recurring subtrees, then blocks of text.

Every page is parsed into elements; each element's subtree (tag, class, texts, children) has a 64-bit hash.
Spark counts, for each host, the different articles (outside of articles, the different pages) that hold a
hash, so that copies of one page or article count once. A subtree is a template of the host if at least
``MIN_PAGES`` hold it, however large the host, or more than ``SMALL_SHARE`` of the pages of a smaller host do.
A second pass drops templates, and
the elements whose tag, or a whole class, id or role, names a menu, header, footer, sidebar, notice, advert,
form, script, style or reader comments; no name but that of comments drops an article, main, or what holds one. Of a page with ``article`` or ``main`` elements only these
count. Short runs of text (a paragraph, heading, list item, table cell or row, or inline element of at most
``SHORT`` characters) recur in prose, too: in an article they are never templates, elsewhere only if
``MIN_SHARE`` of the host's pages hold them. Containers and longer texts go in articles as elsewhere.

Counts are partial sums by (host, hash) before the shuffle, and pages meet templates in a join on (host, hash),
with templates of a host dealt over ``SALTS`` keys each, so a hot host or template meets in no single task.
Pages are parsed twice rather than kept.

Results of the corner cases: a null or empty page has an empty text; a null url is a host of its own;
unclosed and misnested tags are closed as browsers mostly do, a tag cut off at the end is dropped; repeated
rows each get their row and count as one page; columns beyond page_id, url and html are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: A template stands on at least so many pages of its host; a short text outside of articles on this share of them, too.
MIN_PAGES, MIN_SHARE = 10, 0.2
#: On a smaller host, on more than this share of its pages. Characters of a short text; keys that a template is dealt over.
SMALL_SHARE, SHORT, SALTS = 0.5, 200, 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption".split())
MAIN = frozenset(("article", "main"))
#: What never is main text, by tag, and by a class, an id or a role. A name such as cookie-notice or share-box counts
#: if each of its words is of DROP_WORDS or PLACE_WORDS, and one of the former; has-sidebar and tag-search don't.
DROP_TAGS = frozenset("nav header footer aside form script style noscript template iframe button select textarea dialog svg canvas object menu head title input label fieldset".split())
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments respond replies reply disqus share sharing social related recommended newsletter subscribe signup login search pagination pager widget toolbar skip contentinfo complementary".split())
PLACE_WORDS = frozenset("bar block box buttons container form global icons inner links list main outer page panel primary section secondary site top bottom wrap wrapper".split())
COMMENT_WORDS = frozenset("comment comments respond replies".split())
#: An open element of the first kind ends when one of the second opens.
CLOSES = {
    "p": BLOCK - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
_SCOPE = frozenset("article main section div nav aside header footer form table td th ul ol dl body html blockquote".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "label", "children", "hash")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children, self.hash = tag, label, [], 0


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and texts, in order."""
    root = Node("html", "")
    stack = [root]
    at, size = 0, len(page)

    def close() -> None:
        stack.pop()

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(_html.unescape(part))

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue  # a comment, a declaration, or a tag cut off
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE and tag not in _SCOPE:
                    break
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        while len(stack) > 1:
            for k in range(len(stack) - 1, 0, -1):
                own = stack[k].tag
                if tag in CLOSES.get(own, ()):
                    del stack[k:]
                    break
                if own in BLOCK:
                    k = 0
                    break
            else:
                k = 0
            if not k:
                break
        attrs = m[3]
        label = " ".join(x for a in _ATTR.findall(attrs) for x in a[1:] if x).lower() if attrs and "=" in attrs else ""
        node = Node(tag, label)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
    return root


def hashes(root: Node) -> set[int]:
    """Sets every subtree's hash; all of them that hold text, the root and body aside."""
    found, order, stack = set(), [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.children if isinstance(x, Node)]
    for node in reversed(order):
        body = [str(x.hash) if isinstance(x, Node) else " ".join(x.split()) for x in node.children]
        node.hash = xxhash.xxh3_64_intdigest("\0".join((node.tag, node.label, *filter(None, body)))) - (1 << 63)
        if any(body) and node.tag not in ("html", "body"):
            found.add(node.hash)
    return found


def held(root: Node) -> tuple[int, dict[int, int]]:
    """The page's hash, and of each subtree that ``hashes`` finds the hash of the outermost article, or else the page, around it."""
    found = hashes(root)
    out: dict[int, int] = {}
    stack = [(root, root.hash, False)]
    while stack:
        node, within, inside = stack.pop()
        if node.hash in found:
            out.setdefault(node.hash, within)
        if node.tag in MAIN and not inside:
            within, inside = node.hash, True
        stack += [(x, within, inside) for x in reversed(node.children) if isinstance(x, Node)]
    return root.hash, out


def _named(node: Node, words: frozenset) -> bool:
    """Whether a class, id or role of the element, as a whole, is one of ``words``, alone or with words of place."""
    for name in node.label.split():
        parts = _WORDS.findall(name)
        if not words.isdisjoint(parts) and all(x in words or x in PLACE_WORDS for x in parts):
            return True
    return False


def _mains(root: Node) -> tuple[list[Node], set[int]]:
    """The outermost articles that aren't part of reader comments, and the ids of all articles and what is around them."""
    mains: list[Node] = []
    kept: set[int] = set()
    stack: list[tuple[Node, tuple | None, bool]] = [(root, None, False)]
    while stack:
        node, above, within = stack.pop()
        if node.tag not in ("body", "html") and _named(node, COMMENT_WORDS):
            continue
        above = (node, above)
        if node.tag in MAIN:
            if not within:
                mains.append(node)
            within, up = True, above
            while up and id(up[0]) not in kept:
                kept.add(id(up[0]))
                up = up[1]
        stack += [(x, above, within) for x in reversed(node.children) if isinstance(x, Node)]
    return mains, kept


def _dropped(node: Node, inside: bool, kept: set[int]) -> bool:
    if node.tag == "header" and inside and any(isinstance(x, Node) and re.fullmatch("h[1-6]", x.tag) for x in node.children):
        return False  # the heading of the article itself
    return node.tag in DROP_TAGS or bool(node.label) and node.tag not in ("body", "html") and id(node) not in kept and _named(node, DROP_WORDS)


def _short_text(node: Node) -> bool:
    """Running text of at most SHORT characters: a text element or an inline one, without further blocks but the cells of a row or table head."""
    if node.tag in BLOCK and node.tag not in TEXT:
        return False
    size, stack = 0, list(node.children)
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            size += len(" ".join(x.split()))
            if size > SHORT:
                return False
        elif x.tag in BLOCK and not (node.tag in ("tr", "thead") and x.tag in ("tr", "td", "th")):
            return False
        else:
            stack += x.children
    return True


def main_text(root: Node, templates: set[int] = frozenset(), common: set[int] | None = None) -> str:
    """Blocks of the main text, joined by newlines; ``common`` are the templates that many of the host's pages hold (None: all)."""
    common = templates if common is None else common
    if templates:
        hashes(root)
    mains, kept = _mains(root)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(run).split()):
            blocks.append(line)
        run.clear()

    todo: list = [(x, True) for x in reversed(mains)] or [(root, False)]
    inside = bool(mains)
    while todo:
        node, enter = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            run.append(node)
        elif node.tag in ("br", "wbr", "img"):
            run.append(" " if node.tag == "br" else "")
        else:
            own_main = node.tag in MAIN and enter and inside
            if not own_main and _dropped(node, inside, kept):
                continue
            if node.hash in templates and node.tag not in MAIN and node.tag not in ("html", "body") and not ((inside or node.hash not in common) and _short_text(node)):
                flush() if node.tag in BLOCK else None
                continue
            block = node.tag in BLOCK
            if block:
                flush()
                todo.append((None, False))
            todo += [(x, False) for x in reversed(node.children)]
    flush()
    return "\n".join(blocks)


def host_of(url):
    """The host of a url column, lower-cased; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, hash, within) for each different page: a hash of the html, and ``held`` of it; the page's own row has a null hash."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for host, page, body in frame.iloc[at : at + 256].itertuples(index=False, name=None):
                    own, found = held(parse(body or ""))
                    out[0].extend([host] * (len(found) + 1))
                    out[1].extend([page] * (len(found) + 1))
                    out[2].extend([None, *found])
                    out[3].extend([own, *found.values()])
                yield pd.DataFrame({"host": out[0], "page": pd.Series(out[1], dtype="int64"), "hash": pd.Series(out[2], dtype="Int64"), "within": pd.Series(out[3], dtype="int64")})

    return pages.select("host", "page", "html").mapInPandas(hashed, "host string, page long, hash long, within long")


def templates(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash, common): each host's recurring subtrees, and whether ``min_share`` of its pages hold them."""
    counts = found.select("host", "hash", "within").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    least = F.least(F.lit(min_pages), F.floor(F.lit(SMALL_SHARE) * F.col("pages")) + 1)
    known = counts.where("hash IS NOT NULL AND n > 1").join(sizes, "host").where(F.col("n") >= least)
    return known.select("host", "hash", (F.col("n") >= min_share * F.col("pages")).alias("common"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages(page_id, url, html)``."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host")).withColumn("page", F.xxhash64("html"))
    found = C.stored(subtrees(rows), "subtrees")
    known = templates(found, min_pages, min_share).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = found.where("hash IS NOT NULL").withColumn("salt", F.pmod(F.col("page"), F.lit(SALTS)).cast("int")).join(known, ["host", "hash", "salt"])
    own = C.stored(own.groupBy("host", "page").agg(F.collect_set(F.when(F.col("common"), F.col("hash"))).alias("common"), F.collect_set(F.when(~F.col("common"), F.col("hash"))).alias("other")), "templates")

    def extracted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        some = lambda x: frozenset(x.tolist() if x is not None else ())
        for htmls, commons, others in batches:
            yield pd.Series([main_text(parse(x or ""), some(c) | some(o), some(c)) for x, c, o in zip(htmls, commons, others, strict=True)], dtype=object)

    extracted.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    # both sides grow with the pages, whatever size the optimiser sees
    return rows.join(own.hint("merge"), ["host", "page"], "left").select("page_id", "url", F.pandas_udf(extracted, "string")("html", "common", "other").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
