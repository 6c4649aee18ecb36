"""Main text of web pages by tag-path ratios.

The page is read as a stream of tags and texts. Every text node has a root-to-leaf path
of block elements (with class names). Per path of a page: text length, punctuation, and
number of nodes; from these the text-per-node ratio and the punctuation-per-node ratio.
Both are smoothed over neighbouring paths in page order and fused as the sum of their
logarithms, with a finite prior for what the names around a block say (article, main
against menus, adverts, forms, comments); blocks over a share of the page's mean are
chosen. Content is the smallest element around most of the chosen text: its headings, list
items and short paragraphs belong to it, its boilerplate and lists of links do not.

Defined results: null or empty html, and pages without content, give an empty text;
unclosed elements end with their parents, at any depth, and blocks that cannot nest (p, li, td ...)
end their open like; malformed tags are text; nodes without letters or digits are kept
inside content blocks. Extra columns are kept by `extract` inside its row column.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.arrowmap import annotate

#: Element kinds of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select head".split())
NOT_NESTED = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("div ul ol table section article footer header nav aside form blockquote pre".split())
#: Names of parts of a page that are not its article, as elements or as words of class, id or role.
BOILER_TAGS = frozenset("nav footer aside form button menu dialog".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header "
    "login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related replies reply "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCT = re.compile(r"[.,;:!?。，；：！？…]")
_WS = re.compile(r"\s+")

#: Elements that may lie around a whole page: they are boilerplate unless at least half of the text outside other boilerplate is theirs.
WRAPPERS = frozenset("form head".split())
#: A block is content if its fused score and prior reach this share of their mean over the page's text, where boilerplate counts by its ratios.
SHARE = 0.6
#: The prior inside a part named as the article, and inside one named as boilerplate.
NAMED, BOILER = 3.0, -5.0
SMOOTH = (0.05, 0.9, 0.05)
#: Content lies in the smallest element with this share of the text that the ratios choose.
HOLDS = 0.7
#: A part without chosen blocks is a list of links if this share of its text is in links, and they are two or more.
LINKED = 0.8
#: Names around a content part are those of a page if no more than this share of its text is outside boilerplate.
APART = 0.2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of a path that are shown.
SHOWN = 16


class Page:
    """Elements of a page as they open, each with its parent's number, and its blocks of text; every step is linear in the page."""

    def __init__(self) -> None:
        self.parent, self.tag, self.path = [], [], []
        self.strong, self.named, self.content = [], [], []  # boilerplate by kind, by name or as a wrapper; a content part
        self.paths: dict[tuple[int, str], int] = {}  # (path above, name) -> path
        self.blocks: list[tuple[int, str, int, int]] = []  # element, text, characters and number of links

    def open(self, above: int, tag: str, name: str, strong: bool, named: bool, content: bool) -> int:
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[above] if above >= 0 else -1, name), len(self.paths)))
        self.strong.append(strong)
        self.named.append(named)
        self.content.append(content)
        return len(self.tag) - 1

    def down(self, own: list, combine: Callable) -> list:
        """A value for each element from its parent's (None above the page) and its own."""
        out: list = []
        for e, above in enumerate(self.parent):
            out.append(combine(out[above] if above >= 0 else None, own[e], e))
        return out

    def up(self, own: list[int]) -> list[int]:
        """The sum over each element and all below it."""
        out = list(own)
        for e in range(len(out) - 1, -1, -1):
            if self.parent[e] >= 0:
                out[self.parent[e]] += out[e]
        return out

    def path_name(self, path: int, names: list[tuple[int, str]]) -> str:
        shown: list[str] = []
        while path >= 0 and len(shown) < SHOWN:
            path, name = names[path]
            shown.append(name)
        return "/".join(reversed(shown))


def read_page(page: str) -> Page:
    """The page's elements and blocks; texts are decoded, their white space collapsed."""
    out = Page()
    stack: list[int] = []
    open_tags: Counter = Counter()
    pieces: list[str] = []
    links = [False, 0, 0]  # whether inside a link; characters and number of links since the last block

    def pop() -> str:
        tag = out.tag[stack.pop()]
        open_tags[tag] -= 1
        return tag

    def add(text: str) -> None:
        pieces.append(text)
        if links[0]:
            links[1] += len(text.strip())

    def flush() -> None:
        text = _WS.sub(" ", _html.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            if not stack:
                push("", "")
            out.blocks.append((stack[-1], text, min(links[1], len(text)), links[2]))
        links[1] = links[2] = 0

    def push(tag: str, names: str) -> None:
        words = frozenset(re.split(r"[^a-z0-9]+", names)) if names else frozenset()
        if tag in ("html", "body"):  # their names speak of the page
            words = frozenset()
        inside = any(open_tags[t] > 0 for t in CONTENT_TAGS)
        strong = tag in BOILER_TAGS - WRAPPERS or (tag == "header" and not inside)
        named = tag in WRAPPERS or bool(words & BOILER_WORDS)
        content = tag in CONTENT_TAGS or bool(words & CONTENT_WORDS)
        stack.append(out.open(stack[-1] if stack else -1, tag, f"{tag}.{names}" if names else tag, strong, named, content))
        open_tags[tag] += 1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links[0] = not m[1]
            links[2] += not m[1]
        if m[1]:  # an end tag
            if tag in INLINE:
                continue
            flush()
            if open_tags[tag] > 0:
                while pop() != tag:
                    pass
            continue
        if tag in INLINE or tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                add(" ")
            continue
        flush()
        if tag in RAW and tag != "head":
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in ("body", "article", "main", "nav") and open_tags["head"] > 0:
            while pop() != "head":
                pass
        top = out.tag[stack[-1]] if stack else ""
        if top == "p" and (tag in NOT_NESTED or tag in ENDS_P):
            pop()
        elif tag in NOT_NESTED and top == tag:
            pop()
        push(tag, " ".join(x for g in _NAMES.findall(m[3]) for x in g if x).lower())
    flush()
    return out


def priors(page: Page) -> list[float]:
    """What the names around each element say of its text.

    Names of boilerplate count whatever share of the page's text is below them: a long thread
    of comments is no article. They do not count around the first content part if hardly any
    text is outside boilerplate, as then they are names of the whole page.
    """
    sizes = [0] * len(page.tag)
    for e, text, _, _ in page.blocks:
        sizes[e] += len(text)
    flagged = [s or n for s, n in zip(page.strong, page.named, strict=True)]
    inmost = page.down(flagged, lambda above, own, e: e if own else -1 if above is None else above)  # the innermost flagged element around
    own = Counter()
    for e, n in enumerate(sizes):
        own[inmost[e]] += n
    outside = own[-1]
    off = set()  # flags that do not count
    held = page.up([n for n in sizes])
    for e, content in enumerate(page.content):
        if content and not flagged[e] and inmost[e] >= 0:
            around, x = [], inmost[e]
            while x >= 0:
                around.append(x)
                x = inmost[page.parent[x]] if page.parent[x] >= 0 else -1
            if not any(page.strong[x] for x in around):
                if outside <= APART * held[e]:
                    off.update(around)
                break
        elif content and not flagged[e] and held[e]:
            break  # the first content part is in the open
    for e, tag in enumerate(page.tag):
        if tag in WRAPPERS and e not in off and own[e] and own[e] >= outside and (page.parent[e] < 0 or inmost[page.parent[e]] < 0 or inmost[page.parent[e]] in off):
            off.add(e)
    boil = page.down([f and e not in off for e, f in enumerate(flagged)], lambda above, own, e: bool(above) or own)
    good = page.down(page.content, lambda above, own, e: bool(above) or own)
    return [BOILER if b else NAMED if g else 0.0 for b, g in zip(boil, good, strict=True)]


def path_scores(page: Page) -> dict[int, float]:
    """Fused score of each path of the page."""
    stats: dict[int, list[float]] = {}
    for e, text, _, _ in page.blocks:
        s = stats.setdefault(page.path[e], [0.0, 0.0, 0.0])
        s[0] += len(text)
        s[1] += len(_PUNCT.findall(text))
        s[2] += 1
    order = list(stats)

    def smooth(xs: list[float]) -> list[float]:
        wide = [xs[0], *xs, xs[-1]]
        return [sum(k * wide[i + j] for j, k in enumerate(SMOOTH)) for i in range(len(xs))]

    if not order:
        return {}
    length = smooth([stats[p][0] / stats[p][2] for p in order])
    punct = smooth([stats[p][1] / stats[p][2] for p in order])
    return {p: math.log1p(length[i]) + math.log1p(punct[i]) for i, p in enumerate(order)}


def container(page: Page, chosen: list[bool]) -> int:
    """The smallest element with most of the chosen text in elements below it, -1 for the page."""
    sizes = [0] * len(page.tag)
    for (e, text, _, _), ok in zip(page.blocks, chosen, strict=True):
        sizes[e] += len(text) * ok
    held, total = page.up(sizes), sum(sizes)
    best = -1
    for e, above in enumerate(page.parent):  # parents come first, and no two elements side by side hold most of it
        if above == best and held[e] - sizes[e] >= HOLDS * total:
            best = e
    return best


def with_its_company(page: Page, chosen: list[bool], prior: list[float]) -> list[bool]:
    """The chosen blocks, and of their container what is neither boilerplate nor a list of links: headings, lists, short paragraphs.

    In an element of the page's own (body) that is what stands between chosen blocks, and headings right before the first.
    """
    top = container(page, chosen)
    seeds, text, linked, links = ([0] * len(page.tag) for _ in range(4))
    for (e, t, in_links, n), ok in zip(page.blocks, chosen, strict=True):
        seeds[e] += ok
        text[e] += len(t)
        linked[e] += in_links
        links[e] += n
    seeds, text, linked, links = (page.up(x) for x in (seeds, text, linked, links))
    menu = [not s and k >= LINKED * t and n > 1 and t > 0 for s, t, k, n in zip(seeds, text, linked, links, strict=True)]
    menu = page.down(menu, lambda above, own, e: bool(above) or own)
    inside = page.down([e == top for e in range(len(page.tag))], lambda above, own, e: bool(above) or own)
    may = [(top < 0 or inside[e]) and prior[e] >= 0 and not menu[e] for e, _, _, _ in page.blocks]
    if top < 0 or page.tag[top] in ("", "html", "body"):
        places = [i for i, ok in enumerate(chosen) if ok]
        first, last = places[0], places[-1]
        while first > 0 and may[first - 1] and page.tag[page.blocks[first - 1][0]] in HEADINGS:
            first -= 1
        may = [m and first <= i <= last for i, m in enumerate(may)]
    return [m or ok for m, ok in zip(may, chosen, strict=True)]


def main_text(html: str | None) -> tuple[str, list[str]]:
    """The text, and the content paths (their last elements)."""
    page = read_page(html or "")
    scores = path_scores(page)
    if not scores:
        return "", []
    prior = priors(page)
    size = sum(len(t) for _, t, _, _ in page.blocks)
    least = SHARE * sum((scores[page.path[e]] + max(prior[e], 0.0)) * len(t) for e, t, _, _ in page.blocks) / size
    chosen = [scores[page.path[e]] + prior[e] >= least for e, _, _, _ in page.blocks]
    if not any(chosen):
        return "", []
    kept = [b for b, ok in zip(page.blocks, with_its_company(page, chosen, prior), strict=True) if ok]
    names = list(page.paths)
    return " ".join(t for _, t, _, _ in kept), sorted({page.path_name(page.path[e], names) for e, _, _, _ in kept})


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Columns row (all columns of pages) and result: text, content paths."""

    def compute(texts: pa.Array, _):
        made = [main_text(t) for t in texts.to_pylist()]
        return [t for t, _ in made], [p for _, p in made]

    return annotate(pages, html_col, "text string, paths array<string>", compute)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select(
        "row.page_id", "row.url", F.col("result.text").alias("text"), F.length("result.text").cast("bigint").alias("n_chars")
    )
