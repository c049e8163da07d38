"""Operator 4: main text of HTML pages by composite text density.

A tolerant tokenizer builds the element tree of a page. For every element, with C characters of text, T tags, and LC
characters and LT tags inside links, all over its subtree, the composite density is

    C / T * log(C / LC * T / LT) / log(log(C / notLC * LC + LCb / Cb * C + e))

(Sun, Song and Liao, SIGIR 2011), where notLC = C - LC and the b values are those of the body; zero counts become 1. The
subtree with the largest sum of its children's densities is the core of the page. The threshold is the least density
on the path from the body to the core and on to those of its children that hold, the densest first, nine tenths of their
text (a subtree without links is denser than its parts, so the core itself would bar its equals). It holds for the whole
body: under every element that reaches it, the subtree with the largest such sum is main text, as the core is. Within
these, lists, tables and boxes that are mostly links go if they are below it, whatever they are called.

Names help where density cannot tell: elements named as boilerplate cannot be a core, and inside one they go if they are
below the threshold or mostly links; those named as readers' comments always go. A name says nothing if all text that is
neither link nor boilerplate lies inside the element (it tells of the layout), nor if that is the id of a heading or paragraph.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_BLANKS = re.compile(r"[ \t\n\v\f\r\xa0]+")
#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
UNSEEN = frozenset("script style head title noscript template iframe noembed noframes svg math canvas object audio video select option button input textarea form fieldset label datalist map nav footer aside menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Share of the text of the core's children that reaches the threshold; an element with over so many times the text outside it
#: is named for the layout.
MOST_TEXT, OUTSIDE = 0.9, 3
#: Links that make a menu, at least.
MENU = 3
#: Elements that an opening tag closes, up to the nearest of the barriers.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select datalist"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK - frozenset("br body caption dd dt head html legend li option summary tbody td tfoot th thead title tr".split()) | {"p"}
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HOLDS_INLINE = frozenset("article main section div td table body".split())
#: Words of class, id and role that name what is not the article.
NOT_MAIN = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|banner|ads?|adverts?|advertisements?|advertising|promo|promotion|sponsor(?:ed)?|cookies?|consent|gdpr|notice|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|share|sharing|social|related|recommend(?:ed|ations)?|comments?|disqus|replies|respond|pagination|pager|search|toolbar|widget|complementary|contentinfo|skip|copyright|legal|alert)(?:$|[\s_-])",
    re.I,
)


#: Classes and ids that name readers' comments, and elements that hold others.
COMMENTS = re.compile(r"(?:^|\s)(?:(?:user|reader|post|article|page|js)[-_])?(?:comments?|replies|respond|disqus|discussion)(?:[-_](?:list|area|section|wrapper|container|thread|threads|box|block|body|form|inner|content|tree|group))*(?:$|\s)", re.I)
HOLDERS = frozenset("article aside blockquote details div dl fieldset li main ol section table tbody td tr ul".split())


class Node:
    __slots__ = ("name", "kids", "off", "mark", "talk", "chars", "tags", "link_chars", "link_tags", "plain", "density")

    def __init__(self, name: str, off: bool = False, mark: bool = False, talk: bool = False):
        self.name, self.off, self.mark, self.talk = name, off, mark, talk
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.plain = 0
        self.density = 0.0


class _Open:
    """The open elements, outermost first, with the places of each name, of blocks and of boxes; all asked at the cost of a lookup."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}
        self.blocks, self.boxes = [], []

    def push(self, node: Node) -> None:
        at, name = len(self.stack), node.name
        if name in self.places:
            self.places[name].append(at)
        else:
            self.places[name] = [at]
        if name in BLOCK:
            self.blocks.append(at)
            if name in HOLDS_INLINE:
                self.boxes.append(at)
        self.stack.append(node)

    def close(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > at:
            name = self.stack.pop().name
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()
                if name in HOLDS_INLINE:
                    self.boxes.pop()

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name, or 0."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def first_after(self, names: frozenset, at: int) -> int:
        """Place of the outermost open element of these names inside a place, or 0."""
        found = [p[k] for p in map(self.places.get, names) if p and (k := bisect_right(p, at)) < len(p)]
        return min(found, default=0)


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    """Names, lower-cased, and values of a tag's attributes."""
    for a in _ATTRIBUTE.finditer(text):
        if a[1]:
            yield a[1].lower(), a[2] or a[3] or a[4] or ""


def parse(page: str) -> Node:
    """The element tree of a page of any well-formedness; references are decoded, comments and markup are gone."""
    root = Node("html")
    tree = _Open(root)
    stack = tree.stack
    at, n = 0, len(page)

    def add(text: str) -> None:
        if text:
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if m is None:  # a bare <
            stack[-1].kids.append(html.unescape(page[at:lt]) + "<")
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        if m[3] is None:
            if m[1]:
                stack[-1].kids.append(m[1])
            continue
        name = m[3].lower()
        if m[2]:  # closing
            own = tree.last(name)
            if not own:
                if name in ("br", "p"):
                    stack[-1].kids.append(Node(name))
            elif name not in ("html", "body") and (name in BLOCK or own > (tree.boxes[-1] if tree.boxes else 0)):
                tree.close(own)  # a stray inline end does not close a box
            continue
        if name == "html" or name == "body" and tree.last(name):
            continue
        if name in ENDS_P and (own := tree.last("p")) and own >= tree.blocks[-1]:  # p is a block itself
            tree.close(own)
        if name in CLOSES:
            shut, barrier = CLOSES[name]
            if own := tree.first_after(shut, max(map(tree.last, barrier))):
                tree.close(own)
        off = mark = talk = False
        if m[4] and _TELLING.search(m[4]):
            for key, value in _attributes(m[4]):
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    off = True
                elif (key in ("class", "role") or key == "id" and name not in PROSE) and NOT_MAIN.search(value):
                    mark = True
                    talk = talk or key != "role" and name in HOLDERS and COMMENTS.search(value) is not None
        node = Node(name, off or name in UNSEEN, mark, talk)
        stack[-1].kids.append(node)
        if name in RAW:
            found = _RAW_END[name].search(page, at)
            end = found.start() if found else n
            if not node.off:
                node.kids.append(page[at:end])
            close = page.find(">", end)
            at = n if close < 0 else close + 1
        elif name not in VOID and not (m[4].endswith("/") and name in ("svg", "path")):
            tree.push(node)
    return root


def _elements(node: Node) -> list[Node]:
    """Elements of the subtree that are seen, parents before children."""
    out = [node]
    for x in out:
        out.extend(k for k in x.kids if type(k) is Node and not k.off)
    return out


def _outermost(x: Node) -> list[Node]:
    """Marked elements under an element that are in no other one."""
    out, todo = [], [x]
    while todo:
        for k in todo.pop().kids:
            if type(k) is Node and not k.off:
                (out if k.mark else todo).append(k)
    return out


def _unmark(root: Node) -> None:
    """Take the marks off elements, the largest first, beside which the page has too little text that is neither link nor marked.

    Comments lose theirs only if there is none.
    """
    outside, heap = root.plain, []
    for turn, x in enumerate(_outermost(root)):
        heapq.heappush(heap, (x.link_chars - x.chars, turn, x))
    turn = len(heap)
    while heap:
        size, _, x = heapq.heappop(heap)
        if x.tags > 2 and (OUTSIDE * outside < -size and not x.talk or not outside):
            x.mark = x.talk = False
            outside += x.plain
            for k in _outermost(x):
                turn += 1
                heapq.heappush(heap, (k.link_chars - k.chars, turn, k))


def measure(root: Node) -> list[Node]:
    """Counts and densities of all seen elements."""
    found = _elements(root)
    for x in reversed(found):
        if x.name == "a":
            x.link_tags = 1
        for k in x.kids:
            if type(k) is str:
                n = len(_BLANKS.sub("", k))
                x.chars += n
                x.plain += n
            elif not k.off:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags
                x.plain += 0 if k.mark else k.plain
        if x.name == "a":
            x.link_chars, x.plain = x.chars, 0
    _unmark(root)
    body = next((x for x in found if x.name == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for x in found:
        if x.chars:
            c, t, lc, lt = x.chars, max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
            base = math.log(c / max(c - x.link_chars, 1) * lc + share * c + math.e)
            x.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.1))
    return found


def cores(root: Node) -> tuple[list[Node], float]:
    """The elements that hold the main text, in page order, none in another; and the threshold.

    The core is the element with the largest sum of its children's densities. Elsewhere in the body, the element with the
    largest sum under any that reaches the threshold counts too. Elements named as boilerplate, and what they
    hold, cannot be either, nor do they add to a sum. Of equal sums the outermost, first, counts.
    """
    found = measure(root)
    parent: dict[int, Node] = {}
    allowed: list[Node] = []
    for x in found:
        up = parent.get(id(x))
        if up is None and x is not root:
            continue
        allowed.append(x)
        for k in x.kids:
            if type(k) is Node and not k.off and not (k.mark or k.name == "header"):
                parent[id(k)] = x
    best: dict[int, tuple[float, Node]] = {}
    for x in reversed(allowed):
        top = (sum(k.density for k in x.kids if type(k) is Node and not k.off and not k.mark), x)
        for k in x.kids:
            if type(k) is Node and id(k) in best and best[id(k)][0] > top[0]:
                top = best[id(k)]
        best[id(x)] = top
    most, x = best[id(root)]
    if not most:
        return [root], 0.0
    kids = sorted((k for k in x.kids if type(k) is Node and not k.off and k.density), key=lambda k: -k.density)
    held = list(accumulate(k.chars for k in kids))
    least = kids[next(i for i, n in enumerate(held) if n >= MOST_TEXT * held[-1])].density
    y: Node | None = x
    while y is not None:
        least = min(least, y.density)
        if y.name == "body":
            break
        y = parent.get(id(y))

    # text that lies beside an element in its own parent, or anywhere in its article, belongs to it
    joined: dict[int, Node] = {}
    article: dict[int, Node] = {}
    for y in allowed:
        up = parent.get(id(y))
        joined[id(y)] = joined[id(up)] if up is not None and (up.name in ("article", "main") or y.name not in BLOCK) else y
        outer = article.get(id(up)) if up is not None else None
        if outer is not None or y.name == "article":
            article[id(y)] = outer or y

    def whole(x: Node) -> Node:
        """What belongs to an element. Of a body, the one child with all its text stands for it, so that what is named as boilerplate
        beside it is outside."""
        while x.name in ("html", "body"):
            own = [k for k in x.kids if (k.strip() if type(k) is str else not k.off and not k.mark and k.chars)]
            if len(own) != 1 or id(own[0]) not in best:
                break
            x = own[0]
        x = joined[id(x)]
        return article.get(id(x), x)

    kept = {id(whole(x))}
    if least > 0:
        kept |= {id(whole(best[id(y)][1])) for y in allowed if y.density >= least}
    out: list[Node] = []
    todo = [root]
    while todo:
        y = todo.pop()
        if id(y) in kept:
            out.append(y)
        else:
            todo.extend(k for k in reversed(y.kids) if type(k) is Node and id(k) in best)
    return out, least


def blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks under an element in page order."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = _BLANKS.sub(" ", "".join(now)).strip(" ")
        now.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            now.append(x)
        elif x is node or not x.off:
            links, low = x.link_chars * 2 > x.chars, x.density < threshold
            if x is not node and (x.talk or x.mark and (links or low) or links and low and (x.name == "header" or x.name in HOLDERS and x.link_tags >= MENU)):
                flush()
                continue
            if x.name in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; a null or empty page, or one without text, gives the empty string."""
    if not page:
        return ""
    nodes, threshold = cores(parse(page))
    return " ".join(x for node in nodes for x in blocks(node, threshold))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with the column text in place of html; every row stays, other columns pass through (a text is replaced)."""
    pages = pages.select(*[c for c in pages.columns if c not in ("html", "text")], "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            text = pa.array([main_text(x.as_py()) for x in batch.column(last)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], text], names=[*batch.schema.names[:last], "text"])

    return pages.mapInArrow(run, pages.withColumnRenamed("html", "text").schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op4_html_text": op4_html_text}
