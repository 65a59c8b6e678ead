"""HTML main text by a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags,
classes and ids are one node of the host's style tree. A node keeps how often
each presentation (sequence of child tags) occurs, and how many pages carry
each of its text blocks. Node importance is the entropy of presentations, to
the base of their number; content importance is one less the mean of
log(pages with the block) / log(pages with the node) over its blocks, so that
text which a site repeats counts little. A branch's importance combines them
as (1 - GAMMA ** l) * presentation + GAMMA ** l * content, with l its children
and content averaged over the branch's blocks. Branches below IMPORTANT on
nodes that at least MIN_PAGES pages share are removed from each page.

Sites that fill their menus and adverts with ever new text defeat entropy, and
sites that print one article many times would lose it. So what HTML itself
calls a menu, header, footer, aside, form, script or style, or what class, id
or role name as such, is removed as well, and the paragraphs of an <article>
or <main> are kept whatever their entropy. Inside those, ids and parts of class
names say nothing (an id is often a heading's slug): only whole class names that
can mean nothing else count, of elements other than headings, and the tree
decides about the rest.

Defined results: null and empty html give an empty text; unclosed tags end
where the next block or the page does; a tag cut off by the page's end is
dropped; character references are decoded once; rows without a host share the
tree of the empty host; repeated pages count as pages of their host.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick
from cytotide.llm.urls import host
from cytotide.operators.joins import broadcast_fits

GAMMA = 0.9
IMPORTANT = 0.25
MIN_PAGES = 4
#: Measured bytes of all hosts' lists that are broadcast.
MAP_BYTES = 16 << 20
#: Counters of a task go out when so many are held.
HELD = 200_000

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section summary table tbody tfoot thead tr ul""".split())
#: An opening tag ends these open ones.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}}
_NOISE_TAGS = frozenset("""head title nav footer aside form script style noscript template iframe svg button select textarea
    input dialog menu object canvas audio video map datalist search xmp noembed noframes""".split())
_NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo
    promotion promoted menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail masthead header footer copyright legal
    notice notices notification alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login
    paywall related recommended recommendations trending share sharing social follow widget widgets pagination pager toolbar
    disclaimer tags comment comments commentlist disqus respond reply replies responses""".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies responses".split())
#: Inside an article these may name a part of it as well; there a long text of few links stays.
_DOUBTFUL = frozenset("""side rail copyright legal notice notices notification alert modal overlay promotion disclaimer tags
    respond reply replies response responses banner related follow""".split())
#: Inside an article these name parts of its own, its title or a box that the reader should mind.
_OWN = frozenset("header masthead alert".split())
#: Words that a name may have beside its noise word: before it, and behind it.
_BEFORE = frozenset("""site page main top bottom left right global primary secondary post article blog entry content mobile desktop
    sticky fixed inline the my user reader readers js block box section wp m c l u o id""".split())
_BEHIND = frozenset("""area areas list lists section sections box boxes block blocks bar bars button buttons link links slot slots
    wrap wrapper container content contents body inner outer left right top bottom item items unit units group panel row col column
    text title thread form icon icons count holder placeholder region zone position primary secondary main div ul inline large small
    feed policy message msg sticky fixed""".split())
#: An <article> of such a class is a reader's comment or an advert, as is one whose id is such a word and a number.
_NO_ARTICLE = _COMMENT_WORDS | frozenset("comment-body ad ads advert advertisement sponsored promo related recommended".split())
_COMMENT_ID = re.compile(rf"(?:div-)?(?:{'|'.join(sorted(_COMMENT_WORDS))})[-_]?\d+")
#: Elements whose id may name noise; headings, paragraphs and what stands in a line have ids of their own.
_CONTAINERS = frozenset("div section ul ol dl table center details fieldset figure".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Text of a doubtful branch that stays in an article if not half of it is links, and of paragraphs beside an
#: article that is shorter than they are, and so no more than a teaser.
LONG_BRANCH = 400
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong a span br ul ol li blockquote pre code table tbody tr td th section div".split())


def noise_word(name: str) -> str | None:
    """The noise word that a class or id is about: its last part, but for words that go before or behind such a
    word (comment-list, ad_slot_2, main-menu; but not related-work, has-sidebar, promotion-of-health)."""
    parts = [p.rstrip("0123456789") for p in _TOKEN.findall(name)]
    parts = [p for p in parts if p]
    while len(parts) > 1 and parts[-1] in _BEHIND and parts[-1] not in _NOISE_WORDS:
        parts.pop()
    if not parts or parts[-1] not in _NOISE_WORDS or not all(p in _NOISE_WORDS or p in _BEFORE or p in _BEHIND for p in parts[:-1]):
        return None
    return parts[-1]


class Node:
    """An element: its tag, its children (elements and texts) and the hash of its path of tags, classes and ids.
    ``noise``: it goes; ``doubtful``: it goes unless it is long and has few links."""

    __slots__ = ("tag", "names", "bare", "noise", "doubtful", "key", "children")

    def __init__(self, tag: str, attrs: str, parent: Node | None, inside: bool) -> None:
        self.tag, self.children = tag, []
        found = {a.lower(): v.strip("\"'").lower() for a, v in _ATTR.findall(attrs)} if attrs else {}
        self.names = f"{tag}.{found.get('class', '')}#{found.get('id', '')}"
        self.bare = not (found.get("class") or found.get("id"))
        self.key = xxhash.xxh64_intdigest(f"{parent.key if parent else ''}/{self.names}") >> 1
        self.noise = tag in _NOISE_TAGS or tag == "header" and not inside
        self.doubtful = False
        if not found:
            return
        if tag in ("article", "main"):
            self.noise = bool(set(found.get("class", "").split()) & _NO_ARTICLE or _COMMENT_ID.fullmatch(found.get("id", "")))
        elif tag not in ("html", "body") and not self.noise:
            names = [] if inside and tag in _HEADINGS else found.get("class", "").split()
            if tag in _CONTAINERS or not inside and tag not in _HEADINGS:
                names += found.get("id", "").split()
            words = {w for n in names if (w := noise_word(n))} - (_OWN if inside else frozenset())
            self.doubtful = inside and bool(words) and words <= _DOUBTFUL
            self.noise = (bool(words) and not self.doubtful or found.get("role") in _NOISE_ROLES or found.get("aria-hidden") == "true"
                          or "hidden" in found or "display:none" in found.get("style", "").replace(" ", ""))


def parse(html: str) -> Node:
    """The element tree of a page, with implied ends of paragraphs, items, rows and cells."""
    root = Node("#root", "", None, False)
    stack, inside, at, raw = [root], 0, 0, ""
    end = len(html)
    while at < end:
        if raw:
            closing = re.compile(rf"</{raw}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            if stack[-1].tag not in _NOISE_TAGS:
                stack[-1].children.append(html[at:closing.start() if closing else end])
            stack.pop()
            at, raw = closing.end() if closing else end, ""
            continue
        lt = html.find("<", at)
        if lt != at:
            stack[-1].children.append(unescape(html[at:lt if lt >= 0 else end]))
            if lt < 0:
                break
        m = _TAG.match(html, lt)
        if not m:
            if lt + 1 < end and not (html[lt + 1].isascii() and (html[lt + 1].isalpha() or html[lt + 1] == "/")):
                stack[-1].children.append("<")
                at = lt + 1
            else:  # a tag with an open quote ends at the next >, a cut off one at the page's end
                at = (html.find(">", lt) + 1) or end
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    inside -= sum(x.tag in ("article", "main") for x in stack[i:])
                    del stack[i:]
                    break
            continue
        ends = {"p"} if tag in _BLOCKS else set()
        ends |= _ENDS.get(tag, set())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                del stack[i:]
                if tag not in ("tr", "tbody", "thead", "tfoot"):
                    break
            elif stack[i].tag in _BLOCKS and stack[i].tag not in ("p", "li", "dt", "dd", "tr", "option") or stack[i].tag in ("td", "th") and tag not in _ENDS:
                break
        node = Node(tag, m[3], stack[-1], inside > 0)
        stack[-1].children.append(node)
        if tag in _VOID or m[3].endswith("/") and tag in ("path", "rect", "circle", "use"):
            continue
        stack.append(node)
        inside += tag in ("article", "main")
        raw = tag if tag in _RAW else ""
    return root


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _texts(root: Node) -> tuple[int, int, int]:
    """Characters of a branch without noise: all, those in links, and those in paragraphs."""
    counts, todo = [0, 0, 0], [(root, False, False)]
    while todo:
        node, link, plain = todo.pop()
        if isinstance(node, str):
            n = len("".join(node.split()))
            for i, counted in enumerate((True, link, plain)):
                counts[i] += n * counted
        elif not node.noise:
            todo += [(c, link or node.tag == "a", plain or node.tag == "p") for c in node.children]
    return counts[0], counts[1], counts[2]


def _minor(node: Node) -> bool:
    """Whether a doubtful branch goes: it is short, or half of it is links."""
    whole, links, _ = _texts(node)
    return whole < LONG_BRANCH or 2 * links > whole


def _gather(root: Node, gone: frozenset, blocks: list[list[str]]) -> None:
    """Add a branch's text to the blocks; a list is a block, and block elements begin and end one."""
    todo: list = [(root, False)]
    while todo:
        node, protected = todo.pop()
        if node is None:
            blocks.append([])
            continue
        if isinstance(node, str):
            blocks[-1].append(node)
            continue
        protected = protected and node.bare and node.tag in _PLAIN or node.tag in ("article", "main")
        if node.noise or node.key in gone and not protected or node.doubtful and _minor(node):
            continue
        if node.tag in _BLOCKS:
            blocks.append([])
            todo.append((None, False))
        elif node.tag in ("br", "td", "th"):
            blocks[-1].append(" ")
        todo += [(c, protected) for c in reversed(node.children)]


def _articles(node: Node) -> list[Node]:
    """The outermost articles, or else main elements, that aren't inside noise; the whole page if these are
    teasers, with less text than the paragraphs beside them."""
    for tag in ("article", "main"):
        found, todo = [], [node]
        while todo:
            x = todo.pop()
            if x.tag == tag and not x.noise:
                found.append(x)
            elif not x.noise:
                todo += [c for c in reversed(x.children) if not isinstance(c, str)]
        if found:
            held = [_texts(x) for x in found]
            beside = _texts(node)[2] - sum(x[2] for x in held)
            if beside < LONG_BRANCH or sum(x[0] for x in held) >= beside:
                return found
    return [node]


def main_text(html: str | None, gone: frozenset = frozenset()) -> str:
    """Blocks of the page's article (or of what is left of the whole page), without the branches in ``gone``."""
    blocks: list[list[str]] = [[]]
    for x in _articles(parse(html or "")):
        _gather(x, gone, blocks)
        blocks.append([])
    return "\n\n".join(b for b in map(_squeezed, blocks) if b)


def _observe(html: str, held: Counter, at: str) -> None:
    """Count a page's nodes, presentations and text blocks under its host.

    Keys: (host, path, kind, value, children), kinds p (pages with the node), s (a presentation) and f (pages with
    the text). The path has the node's ancestors for f, else the node alone.
    """
    seen = set()
    todo = [(parse(html), ())]
    while todo:
        node, above = todo.pop()
        above = (*above, node.key)
        own = [c for c in node.children if not isinstance(c, str)]
        style = xxhash.xxh64_intdigest(",".join("#" if isinstance(c, str) else c.names for c in node.children if not isinstance(c, str) or c.strip())) >> 1
        held[at, above[-1:], "s", style, len(node.children)] += 1
        seen.add((at, above[-1:], "p", 0, 0))
        texts = _squeezed([c for c in node.children if isinstance(c, str)])
        if texts:
            seen.add((at, above, "f", xxhash.xxh64_intdigest(texts) >> 1, 0))
        todo += [(c, above) for c in own if c.tag not in _RAW]
    held.update(seen)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of every node of every host's tree, from (url, html).

    Tasks count; Spark adds the counts by (host, node, value) before it adds
    them by node, so that a host with a third of all pages is many groups.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = [(h, above[-1], list(above), kind, value, size, n) for (h, above, kind, value, size), n in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "node", "above", "kind", "value", "children", "n"])

        for b in batches:
            for at, html in zip(b["host"], b["html"], strict=True):
                _observe(html, held, at)
                if len(held) >= HELD:
                    yield out()
        yield out()

    d = pick(pages, "url", "html").where("html is not null").select(host(F.col("url")).alias("host"), "html")
    counts = d.mapInPandas(count, "host string, node bigint, above array<bigint>, kind string, value bigint, children bigint, n bigint")
    values = counts.groupBy("host", "node", "kind", "value").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("children")).alias("children"), F.first("above").alias("above"))
    above = F.first(F.when(F.col("kind") == "f", F.col("above")), ignorenulls=True)
    x_ln_x = F.col("n") * F.log(F.col("n").cast("double"))
    of = lambda kind, what: F.sum(F.when(F.col("kind") == kind, what))
    nodes = values.groupBy("host", "node").agg(
        of("p", F.col("n")).alias("pages"), of("s", F.col("n")).alias("shown"), of("s", x_ln_x).alias("shown_ln"),
        of("s", F.col("children")).alias("children"), F.coalesce(of("f", F.lit(1)), F.lit(0)).alias("blocks"),
        F.coalesce(of("f", F.log(F.col("n").cast("double"))), F.lit(0.0)).alias("blocks_ln"), above.alias("above"))
    shown = F.log(F.col("shown").cast("double"))
    nodes = nodes.withColumn("presentation", F.when(F.col("shown") > 1, (shown - F.col("shown_ln") / F.col("shown")) / shown).otherwise(1.0))
    nodes = nodes.withColumn("content", F.when(F.col("pages") > 1, F.col("blocks") - F.col("blocks_ln") / F.log(F.col("pages").cast("double")))
                             .otherwise(F.col("blocks")).cast("double"))
    below = (nodes.where("blocks > 0").select("host", F.explode("above").alias("node"), "content", "blocks")
             .groupBy("host", "node").agg((F.sum("content") / F.sum("blocks")).alias("content")))
    weight = F.pow(F.lit(GAMMA), F.col("children") / F.col("shown"))
    return (nodes.drop("content").join(below, ["host", "node"], "left")
            .withColumn("importance", (1 - weight) * F.col("presentation") + weight * F.coalesce("content", F.lit(0.0)))
            .select("host", "node", "pages", "importance"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per page. The pages are read twice: for the trees, and to cut their unimportant branches.
    A host's list of these goes to the workers once where all lists fit a broadcast, else with its pages."""
    d = pick(pages, "page_id", "url", "html").withColumn("host", host(F.col("url")))
    gone = materialize(style_tree(d).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < IMPORTANT))
                       .groupBy("host").agg(F.collect_list("node").alias("gone")))
    if broadcast_fits(gone, MAP_BYTES):
        lists = d.sparkSession.sparkContext.broadcast({r.host: np.array(r.gone, np.int64) for r in gone.collect()})

        @F.pandas_udf("string")
        def text_of_host(html: pd.Series, at: pd.Series) -> pd.Series:
            sets = {h: frozenset(lists.value[h].tolist()) for h in set(at) if h in lists.value}
            return pd.Series([main_text(page, sets.get(h, frozenset())) for page, h in zip(html, at, strict=True)], dtype=object)

        return d.select("page_id", "url", text_of_host("html", "host").alias("text"))
    d = d.join(gone, "host", "left")

    @F.pandas_udf("string")
    def text(html: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([main_text(page, frozenset() if nodes is None else frozenset(np.asarray(nodes).tolist()))
                          for page, nodes in zip(html, gone, strict=True)], dtype=object)

    return d.select("page_id", "url", text("html", "gone").alias("text"))
