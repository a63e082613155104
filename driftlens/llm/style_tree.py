"""Main text of web pages by site style trees.

All pages of a host are merged into one tree of style nodes: an element's path of tags with
their class, id and role names, digits apart. For every node the pages tell which child
sequences it had (presentation) and which texts its own blocks held (content). A node is
important when presentations vary and texts differ from page to page, and unimportant when
the same few texts come back on every page; a branch is worth its own presentation entropy
blended with the content entropy of all that lies below it. Branches of low importance whose
texts come back are removed from every page, inside the article too; only the article element
itself stays. Paragraphs, headings and lists of an article that stand between important text
are part of its flow and stay even if they repeat.

Two pages cannot show that something repeats, and some menus or adverts differ on every page
though they are none of the text. So branches whose element says what it is (navigation,
footers, forms, ...) go as well. Names (adverts, sidebars, comments, ...) are evidence that the
tree has to confirm: a named branch goes when most of its texts come back on other pages,
however its pages are built. Names say nothing of a page's body, article or headings, nor of
what the article stands in. A page of which all would go keeps its text.

What travels is one row per page and feature, aggregated by (host, node, feature) before the
hosts' verdicts are drawn: a host with a third of all pages is spread like any other. A host's
verdict is the list of its unimportant nodes, bounded by the style nodes that recur on
MIN_PAGES pages.

Defined cases: null or empty html gives an empty text; a null url is a host of its own;
unclosed, wrongly nested and cut-off markup is read as far as it goes; repeated rows give
repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame, functions as F

from driftlens.llm.common import map_batches, materialize

MIN_PAGES = 5
MIN_IMPORTANCE = 0.3
#: Weight of a node's own presentation against the content below it, per the number of its styles.
BLEND = 0.9
#: A branch with more content of its own is never unimportant, however alike its pages are built.
MAX_CONTENT = 0.5

#: Element classes of the HTML standard.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is not running text.
OPAQUE = set("script style noscript template iframe textarea select button svg math title object canvas audio video datalist".split())
CLOSES_PARAGRAPH = BLOCKS - set("body head html caption tbody td tfoot th thead tr".split())
#: Elements that end an open element of the same kind, and where the search for it stops.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "body": (("head",), ()),
}
#: Elements and names that say that a branch is not the article.
ASIDE_TAGS = set("nav footer aside form dialog menu head".split())
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert"
    " popup modal overlay newsletter subscribe subscription signup sidebar widget related recommended recommendations share sharing social"
    " nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer copyright contentinfo complementary comment comments disqus"
    " replies respond login search pagination pager toolbar".split()
)
PAGE_HEADER_NAMES = {"header"}
ARTICLES = {"article", "main"}
#: Their names describe the page or are made from a title.
NEVER_NAMED = ARTICLES | set("html body h1 h2 h3 h4 h5 h6".split())
#: Elements of running text.
FLOW = set("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd pre blockquote".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=50_000)
def element_of(tag: str, attributes: str) -> tuple[str, frozenset[str]]:
    """An element's style key and the lower-case words of its names."""
    names = " ".join(" ".join(filter(None, m.groups()[1:])) for m in NAMED.finditer(attributes)) if "=" in attributes else ""
    words = frozenset(w.lower() for w in NAME_PARTS.findall(html.unescape(names)))
    return f"{tag}.{'.'.join(sorted(words))}" if words else tag, words


class Element:
    """``article`` is the outermost article that it is or stands in; ``under_name`` says that it is or stands in a named element."""

    __slots__ = ("tag", "path", "aside", "named", "under_name", "article", "children")

    def __init__(self, tag: str, key: str, words: frozenset[str], parent: Element | None):
        self.tag = tag
        self.path = xxhash.xxh64_intdigest(key, seed=(parent.path if parent else 0) & 0xFFFFFFFFFFFFFFFF) & 0x7FFFFFFFFFFFFFFF
        article = parent.article if parent else None
        called = bool(words & ASIDE_NAMES) or "skip" in words and "link" in words or bool(words & PAGE_HEADER_NAMES) and not article
        # An article inside an article may be a reader's comment.
        self.named = called and (tag not in NEVER_NAMED or tag == "article" and article is not None)
        self.aside = (parent is not None and parent.aside) or tag in ASIDE_TAGS or tag == "header" and not article
        self.under_name = (parent is not None and parent.under_name) or self.named
        is_article = tag in ARTICLES or "main" in words and tag not in NEVER_NAMED and not called
        self.article = article or (self if is_article and not self.aside else None)
        self.children: list[str] = []


def blocks_of(page: str) -> tuple[list[tuple[str, list[Element]]], list[list[Element]]]:
    """The page's text blocks in order, each with its open elements; and every element's own line."""
    root = Element("", "", frozenset(), None)
    stack, blocks, elements, held = [root], [], [], []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append((text, list(stack)))

    def close(tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].tag in tags:
                del stack[n:]
                return
            if stack[n].tag in until:
                return

    at = 0
    while True:
        found = MARKUP.search(page, at)
        held.append(html.unescape(page[at : found.start() if found else len(page)]))
        if not found:
            break
        at = found.end()
        end, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in OPAQUE:
            if not end and not attributes.rstrip().endswith("/"):
                rest = _closing(tag).search(page, at)
                at = rest.end() if rest else len(page)
            continue
        if tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if end:
            if any(e.tag == tag for e in stack):
                close((tag,), ())
            continue
        if tag in CLOSES_PARAGRAPH:
            close(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "main", "body"))
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        key, words = element_of(tag, attributes)
        stack[-1].children.append(key)
        if tag != "hr":
            stack.append(Element(tag, key, words, stack[-1]))
            elements.append(list(stack))
    flush()
    return blocks, elements


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) & 0x7FFFFFFFFFFFFFFF


def features_of(page: str) -> dict[tuple[int, bool, bool, int], list[int]]:
    """(node, is named, is content, value) of the page's tree, with the nodes above each."""
    blocks, elements = blocks_of(page)
    out = {}
    for line in elements:
        sequence = [c for n, c in enumerate(line[-1].children) if n == 0 or c != line[-1].children[n - 1]]
        out[line[-1].path, line[-1].named, False, _hashed(" ".join(sequence))] = [e.path for e in line]
    for text, line in blocks:
        out[line[-1].path, line[-1].named, True, _hashed(text)] = [e.path for e in line]
    return out


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))


def importances(pages: DataFrame) -> DataFrame:
    """(host, node, named, pages, content, importance) of the site style trees."""

    def make():
        def step(batch):
            out = {"host": [], "node": [], "named": [], "content": [], "value": [], "above": []}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for (node, named, content, value), above in features_of(page or "").items():
                    for column, x in zip(out.values(), (host, node, named, content, value, above)):
                        column.append(x)
            return out

        return step

    rows = map_batches(_hosted(pages).select("host", "html"), "host string, node long, named boolean, content boolean, value long, above array<long>", make)
    counted = rows.groupBy("host", "node", "content", "value").agg(F.count(F.lit(1)).alias("c"), F.max("named").alias("named"), F.first("above").alias("above"))
    # Presentation: entropy of the child sequences over the node's pages. Content: how far each
    # text is from being on all of them; a text on c of m pages has entropy log c / log m.
    nodes = materialize(counted.groupBy("host", "node").agg(
        F.sum(F.when(~F.col("content"), F.col("c"))).alias("pages"),
        F.sum(F.when(~F.col("content"), F.col("c") * F.log("c"))).alias("style_logs"),
        F.sum(F.when(~F.col("content"), 1)).alias("styles"),
        F.sum(F.when(F.col("content"), F.log("c"))).alias("text_logs"),
        F.sum(F.when(F.col("content"), 1)).alias("texts"),
        F.max("named").alias("named"),
        F.first("above").alias("above"),
    ), "style-nodes")
    sized = nodes.select("host", F.explode("above").alias("node"), "text_logs", "texts", F.coalesce("pages", F.lit(1)).alias("m"))
    below = sized.groupBy("host", "node").agg(
        F.sum(F.when(F.col("m") > 1, F.col("text_logs") / F.log("m"))).alias("common"), F.sum("texts").alias("n_texts")
    )
    content = 1 - F.coalesce(F.col("common") / F.col("n_texts"), F.lit(0.0))
    m = F.col("pages")
    presentation = F.when(m > 1, 1 - F.col("style_logs") / (m * F.log(m))).otherwise(1.0)
    share = F.pow(F.lit(BLEND), F.col("styles"))
    return nodes.select("host", "node", "named", "pages", "styles", "style_logs").join(below, ["host", "node"]).select(
        "host", "node", "named", "pages", content.alias("content"), ((1 - share) * presentation + share * content).alias("importance")
    )


Blocks = list[tuple[str, list[Element]]]


def _articles(blocks: Blocks) -> Blocks:
    """What lies in articles outside named elements, or else in the articles that hold the larger part of the text."""
    inside = [b for b in blocks if b[1][-1].article]
    firm = [b for b in inside if not b[1][b[1].index(b[1][-1].article) - 1].under_name]
    # Comments and teasers are articles as well; the page's own text may stand outside of them.
    larger = 2 * sum(len(text) for text, _ in inside) > sum(len(text) for text, _ in blocks)
    return firm or (inside if larger else [])


def _without(blocks: Blocks, unimportant: set[int], spared: set[Element]) -> Blocks:
    """Blocks without their unimportant branches; what flows between important text of one article stays."""
    solid, flowing, ends = [], [], {}
    for n, (_, line) in enumerate(blocks):
        low = next((e for e in line if e.path in unimportant and e not in spared), None)
        if low is None:
            solid.append(n)
            first, _ = ends.get(line[-1].article, (n, n))
            ends[line[-1].article] = first, n
        elif low.tag in FLOW and low.article and not low.named:
            flowing.append(n)
    between = [n for n in flowing if (e := ends.get(blocks[n][1][-1].article)) and e[0] < n < e[1]]
    return [blocks[n] for n in sorted(solid + between)]


def main_text(page: str | None, unimportant: set[int]) -> str:
    """The page's article without the branches that are ``unimportant`` or say that they are something else."""
    if not page:
        return ""
    blocks = blocks_of(page)[0]
    blocks = [b for b in blocks if not b[1][-1].aside] or blocks
    inside = _articles(blocks)
    # The articles, and all that they stand in.
    spared = {e for _, line in inside for e in line if e.article is None or e is e.article or e.tag in ARTICLES and not e.named}
    # A page whose every branch repeats elsewhere is a copy: it keeps its text.
    return "\n".join(text for text, _ in _without(inside or blocks, unimportant, spared) or inside or blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    low = importances(pages).filter(
        (F.col("pages") >= MIN_PAGES) & (F.col("content") < MAX_CONTENT) & (F.col("named") | (F.col("importance") < MIN_IMPORTANCE))
    )
    verdicts = materialize(low.groupBy(F.col("host").alias("of_host")).agg(F.collect_set("node").alias("nodes")), "style-verdicts")
    hosted = _hosted(pages)
    joined = hosted.join(verdicts, F.col("host") == F.col("of_host"), "left").select("page_id", "url", "html", "nodes")

    def make():
        def step(batch):
            texts = [main_text(p, set(n or ())) for p, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return map_batches(joined.withColumn("page_id", F.col("page_id").cast("long")), "page_id long, url string, text string, n_chars long", make)
