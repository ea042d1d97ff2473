"""Main text by site style trees.

Pages of one host are merged into a tree of style nodes: a node is the path of labels (tag and classes) from the
body. For each node of each host two entropies are computed over the pages that have it:

* presentation importance: the entropy of the sequences of child labels that it takes, base m (its pages);
* content importance: 1 less the mean, over the distinct text blocks below it, of log_m(pages with that block).

They combine as ``(1 - g**s) * presentation + g**s * content`` with s the number of its child sequences; below
``min_pages`` pages the tree doesn't know and takes 0.5. Markup is a prior: its odds multiply those of the importance,
``NOISE_ODDS`` for navigation, headers, footers, asides, forms and what a whole class, id or role names as such, and
``ARTICLE_ODDS`` for an article or main element and all below it, each by the share of the node's pages. A node around
an article on a page has no prior there. A branch below ``threshold`` is removed from each page, unless it is around an article.

Only (host, node, kind, feature, pages) counts are shuffled, added up batch by batch before; a host with a third
of all pages is spread by node and feature. A host's list of removed nodes is joined back to its pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import table, written

MIN_PAGES, THRESHOLD, BASE = 5, 0.2, 0.9
#: With the first, a branch stays only at an importance over 0.96; with the second, it goes only below 0.06.
NOISE_ODDS, ARTICLE_ODDS, APART_ODDS = 0.01, 4.0, 0.001
#: Importances are taken as within these, as odds end at 0 and 1.
LEAST, MOST = 0.02, 0.98

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
#: What is not shown as text.
DROPPED = RAW | frozenset("head template svg math canvas object audio video map".split())
NOISE_TAGS = frozenset("nav footer aside form button select option dialog menu label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of these closes an open paragraph.
CLOSES_P = BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot caption".split())
#: An opening tag closes the nearest open one of these, but not beyond the elements in the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Classes, ids and roles that name what is not the article; not parts of them.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " sidebar side-bar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer comment comments respond"
    " discussion disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay search toolbar"
    " widget widgets skip-link contentinfo complementary search-form form tags".split()
)
#: Of these, what is excluded however varied it is.
APART = frozenset("sidebar side-bar related recommended comment comments respond discussion disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


class Node:
    __slots__ = ("tag", "label", "path", "children", "dropped", "article", "noise", "apart", "around")

    def __init__(self, tag: str, label: str, path: int, dropped: bool, article: bool, noise: bool, apart: bool = False):
        self.tag, self.label, self.path, self.children = tag, label, path, []
        self.dropped, self.article, self.noise, self.apart, self.around = dropped, article, noise, apart, False


def _attributes(text: str) -> tuple[str, bool, bool, bool]:
    """(the label's part from classes, whether class, id or role name noise, whether one of those apart, whether the element is hidden)."""
    classes, words, hidden = "", set(), False
    for name, *values in ATTRIBUTE.findall(text):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "class":
            classes = ".".join(sorted({re.sub(r"\d+", "", c) for c in value.lower().split()}))
        if name in ("class", "id", "role"):
            words.update(c.strip("-_:0123456789") for c in value.lower().split())
        hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()
    return classes, not words.isdisjoint(NOISE), not words.isdisjoint(APART), hidden


def parse(html: str) -> tuple[list[tuple[str, tuple[Node, ...]]], list[Node]]:
    """(text blocks with the nodes around them, all nodes) of a page; what isn't shown has no blocks.

    Unclosed and misplaced tags are mended as browsers do in the common cases; a tag cut off by the end is dropped."""
    root = Node("body", "body", 0, False, False, False)
    stack, nodes, blocks, held = [root], [root], [], []

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((text, tuple(stack)))

    def pop(i: int) -> None:
        if any(n.tag in BLOCKS for n in stack[i:]):
            flush()
        del stack[i:]

    def close(tags: frozenset, until: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return pop(i)
            if stack[i].tag in until:
                return None
        return None

    at, n, search = 0, len(html), TAG.search
    while at < n:
        m = search(html, at)
        if not stack[-1].dropped and (m is None or m.start() > at):
            held.append(html[at : m.start() if m else n])
        if m is None:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag or m[5] and m[0][-1] != ">":
            continue
        tag = tag.lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
            continue
        if tag == "body" or tag == "html":
            flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1].dropped:
                held.append(" ")
            continue
        if tag in CLOSES_P:
            close(frozenset(["p"]), frozenset(["article", "aside", "div", "section", "table", "td", "li", "blockquote", "body", "main", "button"]))
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCKS:
            flush()
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = found.start() if found else n
        up = stack[-1]
        classes, noise, apart, hidden = _attributes(attributes) if attributes else ("", False, False, False)
        article = up.article or tag in ("article", "main")
        dropped = up.dropped or hidden or tag in DROPPED
        noise |= tag in NOISE_TAGS or tag == "header" and not up.article
        label = f"{tag}.{classes}" if classes else tag
        node = Node(tag, label, xxhash.xxh64_intdigest(label.encode(), up.path) if not dropped else 0, dropped, article, noise, apart)
        if article and not up.article and not dropped:
            for outer in stack:
                outer.around = True
        if not dropped:
            if not up.children or up.children[-1] != label:
                up.children.append(label)  # runs of one label count once
            nodes.append(node)
        if not attributes or attributes[-1:] != "/" or tag in BLOCKS:
            stack.append(node)
    flush()
    return blocks, nodes


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def page_features(html: str) -> set[tuple[int, int, int]]:
    """(node, kind, feature) of a page, each once; kinds are 0 for presentation, 1 for content, 2 for noise, 3 for an article and 4 for what is apart by markup."""
    blocks, nodes = parse(html)
    styles: dict[int, set[str]] = {}
    found = set()
    for n in nodes:
        if n.path:
            styles.setdefault(n.path, set()).add(">".join(n.children))
            if n.noise and not n.around:
                found.add((_signed(n.path), 4 if n.apart else 2, 0))
            elif n.article:
                found.add((_signed(n.path), 3, 0))
    found.update((_signed(p), 0, _signed(xxhash.xxh64_intdigest("|".join(sorted(s))))) for p, s in styles.items())
    for text, around in blocks:
        h = _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
        found.update((_signed(n.path), 1, h) for n in around if n.path)
    return found


def main_text(html: str, low: frozenset[int] = frozenset()) -> str:
    """The blocks of a page outside the nodes ``low``; if nothing were left, those that markup doesn't call noise, or at least not by a tag."""
    blocks, _ = parse(html)
    kept: list[str] = []
    stays = False  # whether the block behind does
    for text, around in reversed(blocks):
        gone = [n for n in around if not n.around and _signed(n.path) in low]
        own = next((i for i, n in enumerate(around) if n.tag in HEADINGS and n.article), len(around))
        # Below its heading's own node nothing speaks against a heading whose block stays.
        stays = not gone or stays and own < len(around) and all(n in around[own:] for n in gone)
        if stays:
            kept.append(text)
    if not kept:
        for noisy in (lambda n: n.noise, lambda n: n.tag in NOISE_TAGS or n.apart):
            kept = kept or [t for t, around in reversed(blocks) if not any(noisy(n) and not n.around for n in around)]
    return "\n".join(reversed(kept))


def _hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), HOST, 1), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.xxhash64(host).alias("host"))


def node_importance(hosted: DataFrame, base: float = BASE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, node, pages, importance) of every style node."""
    most = 200_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = list(zip(*((*k, n) for k, n in counts.items()), strict=True)) or [[]] * 5
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["host", "node", "kind", "feature", "n"])

        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts.update((host, *f) for f in page_features(html.as_py()))
                if len(counts) > most:
                    yield out()
        yield out()

    seen = hosted.select("host", "html").mapInArrow(run, "host long, node long, kind long, feature long, n long")
    features = seen.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))
    style, content = F.col("kind") == 0, F.col("kind") == 1
    nodes = features.groupBy("host", "node").agg(
        F.sum(F.when(style, F.col("n"))).alias("m"),
        F.sum(F.when(style, F.col("n") * F.ln("n"))).alias("n_ln_n"),
        F.count_if(style).alias("s"),
        F.count_if(content).alias("l"),
        F.sum(F.when(content, F.ln("n"))).alias("ln_n"),
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in ((2, "noise"), (3, "article"), (4, "apart"))),
    )
    ln_m = F.ln(F.greatest("m", F.lit(2)))
    presentation = F.when(F.col("m") > 1, (F.ln("m") - F.col("n_ln_n") / F.col("m")) / ln_m).otherwise(1.0)
    text = F.when((F.col("m") > 1) & (F.col("l") > 0), 1 - F.col("ln_n") / ln_m / F.col("l")).otherwise(1.0)
    weight = F.pow(F.lit(base), F.col("s"))
    entropy = F.when(F.col("m") >= min_pages, (1 - weight) * presentation + weight * text).otherwise(0.5)
    entropy = F.least(F.greatest(entropy, F.lit(LEAST)), F.lit(MOST))
    odds = F.exp((F.col("noise") * math.log(NOISE_ODDS) + F.col("article") * math.log(ARTICLE_ODDS) + F.col("apart") * math.log(APART_ODDS)) / F.col("m")) * entropy / (1 - entropy)
    return nodes.where("m > 0").select("host", "node", F.col("m").alias("pages"), (odds / (1 + odds)).alias("importance"))


def extract(
    pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD, base: float = BASE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars): a row for each page.

    Null html is an empty page with empty text; pages without a host make a site of their own; null and repeated
    ids are kept; an empty table gives an empty result; other columns are ignored."""
    hosted = _hosted(pages, id_col, url_col, html_col)
    low = node_importance(hosted, base, min_pages).where(F.col("importance") < threshold)
    removed = written(low.groupBy("host").agg(F.collect_set("node").alias("removed")), "low-importance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), frozenset(r or ())) for h, r in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    both = hosted.join(removed, "host", "left").select("page_id", "url", "html", "removed")
    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
