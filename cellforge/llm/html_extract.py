"""Main-text extraction from web pages by tag-path ratios (operator 7)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes noembed xmp iframe".split())
#: Elements whose content is never part of the article.
OUTSIDE = frozenset("script style head title nav footer aside form noscript template iframe button select option textarea input label svg canvas object audio video dialog menu noframes noembed xmp math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these ends an open one of the named.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements of running text: one of these beside the content belongs to it, a <div> or <section> without content does not.
FLOW = frozenset("p ul ol dl li dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address hgroup".split()) | HEADINGS
#: Words in class, id or role that say that an element stands around the article, and words that say nothing either way.
#: A name counts only if it is made of such words alone: comments-area does, search-engines does not.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts "
    "popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist respond responses replies disqus discussion share sharing social related recommended recommendations "
    "sidebar sidebars widget widgets menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toc masthead topbar toolbar footer colophon copyright disclaimer search searchbox contentinfo complementary dialog".split()
)
NEUTRAL = frozenset(
    "a the of my our site page post posts article articles story stories news main body box block area wrapper wrap container inner outer section list bar buttons button links link item items left right top bottom header head "
    "form panel group row col column content text slot unit count meta secondary primary global local thread policy message".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
#: What the score of a path below such an element counts for, beside that of other paths; nothing where the page has text in an
#: <article> or <main> outside such elements.
AROUND_FACTOR = 0.05


@cache
def _punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P"


@cache
def _names_surroundings(name: str) -> bool:
    parts = [w.lower() for w in WORDS.findall(name)]
    return not AROUND.isdisjoint(parts) and all(w in AROUND or w in NEUTRAL for w in parts)


@dataclass(eq=False)
class Node:
    tag: str
    parent: "Node | None"
    outside: bool  # by its element
    depth: int = 0
    path: int = 0
    inline: bool = False
    around: bool = False  # a class, id or role of it or of an element above says that it stands around the article


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    free: int = 0  # length of the text outside links


def _attributes(attrs: str) -> tuple[bool, bool, str]:
    """Whether an element is hidden, whether a class, id or role says that it stands around the article, and its classes
    without numbers."""
    hidden = named = False
    classes = ""
    for m in ATTR.finditer(attrs):
        name = m[1].lower()
        value = (m[2] or "").strip("\"'")
        if name in ("class", "id", "role", "data-role"):
            named |= any(map(_names_surroundings, value.split()))
            if name == "class":
                classes = DIGITS.sub("", value)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            bare = value.lower().replace(" ", "")
            hidden |= "display:none" in bare or "visibility:hidden" in bare
    return hidden, named, classes


def blocks_of(html: str) -> list[Block]:
    """Text blocks of a page in order, those in elements that are never part of an article left out."""
    root = Node("", None, False)
    paths: dict[tuple, int] = {}  # numbers of the tag paths: by the path above, the tag, its classes and whether it stands around
    at, links = root, 0
    out: list[Block] = []
    now: Block | None = None

    def text(raw: str) -> None:
        nonlocal now
        if at.outside or not raw:
            return
        if now is None:
            if not raw.strip():
                return
            home = at
            while home.inline:
                home = home.parent
            now = Block(home)
            out.append(now)
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    pos = 0
    while pos < len(html):
        m = TAG.search(html, pos)
        if not m:
            text(html[pos:])
            break
        if m.start() > pos:
            text(html[pos : m.start()])
        pos = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        close, attrs = m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if name == "br" or name == "wbr":
            text(" " if name == "br" else "")
            continue
        if name not in INLINE:
            now = None
        if name in VOID:
            continue
        if close:
            node = at
            while node is not root and node.tag != name:
                if name in INLINE and not node.inline:  # formatting ends inside its block only
                    node = root
                    break
                node = node.parent
            if node is not root:
                while at is not node.parent:
                    links -= at.tag == "a"
                    at = at.parent
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        if attrs.endswith("/") and name in ("svg", "path", "use"):
            continue
        if name not in INLINE:  # a block ends an open paragraph and the formatting inside it
            node = at
            while node is not root and (node.inline or node.tag == "p" or node.tag in HEADINGS and name in HEADINGS):
                links -= node.tag == "a"
                node = node.parent
                at = node
            if name in ENDS:
                node, found = at, None
                while node is not root and node.tag not in FENCE[name]:
                    if node.tag in ENDS[name]:
                        found = node
                    node = node.parent
                if found:
                    while at is not found.parent:
                        links -= at.tag == "a"
                        at = at.parent
        elif name == "a" and links:  # links do not nest
            node = at
            while node is not root and node.tag != "a":
                node = node.parent
            if node is not root:
                links -= 1
                node.tag = "span"
        hidden, named, classes = _attributes(attrs) if attrs else (False, False, "")
        keep = name in ("html", "body", "article", "main")
        skip = at.outside or name in OUTSIDE or not keep and hidden
        around = at.around or not keep and named
        if name == "header" and not skip:
            up = at
            while up is not None and up.tag not in ("article", "main"):
                up = up.parent
            skip = up is None
        at = Node(name, at, skip, at.depth + 1, paths.setdefault((at.path, name, classes, around), len(paths) + 1), name in INLINE, around)
        links += name == "a"
    for b in out:
        b.text = SPACE.sub(" ", unescape("".join(b.parts))).strip()
        b.free = max(0, len(b.text) - b.linked)
    return [b for b in out if b.text]


def _around_factor(found: list[Block]) -> float:
    """0 if some text outside links stands in an <article> or <main> and not below an element named as around it, else
    AROUND_FACTOR; how much text that is makes no difference."""
    marked: dict[Node | None, bool] = {None: False}
    for b in found:
        if b.free and not b.node.around:
            way, node = [], b.node
            while node not in marked:
                way.append(node)
                node = node.parent
            for n in reversed(way):
                marked[n] = marked[n.parent] or n.tag in ("article", "main")
            if marked[b.node]:
                return 0.0
    return AROUND_FACTOR


def path_scores(found: list[Block], spread: int = 2) -> dict[int, float]:
    """The score of each tag path that a block ends.

    Per path, the mean length of the text outside links and the mean punctuation in it are its two ratios. Both are smoothed
    with a Gaussian over the blocks next to each of the path's blocks in page order below the same element, `spread` on
    either side, and averaged with the path's own. The two are fused as length * (0.25 + punctuation), and a path below an
    element that is named as around the article counts _around_factor() of that.
    """
    factor = _around_factor(found)
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.node.path, [0.0, 0.0, 0.0])
        s[0] += b.free
        s[1] += sum(map(_punctuation, b.text)) * b.free / len(b.text)
        s[2] += 1
    ratio = {p: (length / n, marks / n) for p, (length, marks, n) in sums.items()}
    smooth = {p: [0.0, 0.0] for p in ratio}
    kernel = [math.exp(-k * k / 2) for k in range(spread + 1)]
    for i, b in enumerate(found):
        length = marks = weight = 0.0
        for k in range(max(0, i - spread), min(len(found), i + spread + 1)):
            if found[k].node.parent is b.node.parent:
                g = kernel[abs(i - k)]
                x = ratio[found[k].node.path]
                length += g * x[0]
                marks += g * x[1]
                weight += g
        s = smooth[b.node.path]
        s[0] += length / weight
        s[1] += marks / weight
    around = {b.node.path: b.node.around for b in found}
    out = {}
    for p, (a, m) in smooth.items():
        n = sums[p][2]
        out[p] = (ratio[p][0] + a / n) / 2 * (0.25 + (ratio[p][1] + m / n) / 2) * (factor if around[p] else 1)
    return out


def content_paths(found: list[Block], least: float = 0.2) -> set[int]:
    """The paths whose score reaches `least` of the mean score of the page's text (each path weighed by its text)."""
    score = path_scores(found)
    factor = _around_factor(found)
    text = [(score[b.node.path], b.free * (factor if b.node.around else 1)) for b in found]
    total = sum(n for _, n in text)
    mean = sum(s * n for s, n in text) / total if total else 0.0
    return {p for p, x in score.items() if x > 0 and x >= least * mean}


def _container(found: list[Block], content: set[int], share: float) -> Node | None:
    """The smallest element with `share` of the text on content paths, or the <article> (or else the <main>) around it."""
    weight: dict[Node, float] = {}
    factor = _around_factor(found)
    for b in found:
        own = b.free * (factor if b.node.around else 1) if b.node.path in content else 0.0
        node = b.node
        while node is not None and node not in weight:
            weight[node] = 0.0
            node = node.parent
        weight[b.node] += own
    nodes = sorted(weight, key=lambda n: -n.depth)
    for n in nodes:
        if n.parent is not None:
            weight[n.parent] += weight[n]
    total = weight[nodes[-1]]
    best = next((n for n in nodes if weight[n] >= share * total), None) if total else None
    if best is None:
        return None
    for tag in ("article", "main"):
        up = best
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None:
            return up
    # a single paragraph or cell stands in an element of its own; a cell that holds paragraphs is such an element
    while best.parent is not None and best.tag in FLOW and any(b.node is best for b in found):
        best = best.parent
    return best


def main_text(html: str | None, share: float = 0.9, ratios: bool = True) -> str:
    """The article's blocks, joined by newlines; '' if there is none.

    Blocks on the content paths (content_paths()) are the content nodes. They name the element that holds them: the
    smallest one with `share` of their text, or the <article> or <main> around that. In it the blocks on other paths stay
    too, as short paragraphs, cells and headings belong to an article, but for those
    * below an element that a class, id or role names as around the article, or in a <header> (its headings stay),
    * mainly of links, unless they are paragraphs, headings, or list items and cells between content nodes,
    * before the first or behind the last content node, in a <div> or the like without content, outside an <article>.
    A page's only <h1> before the article is its title. Without `ratios` every path counts as content, for comparison.
    """
    found = blocks_of(html or "")
    if not found:
        return ""
    content = content_paths(found) if ratios else {b.node.path for b in found}
    best = _container(found, content, share)
    if best is None:
        return ""
    # where each node stands: (inside the element, its part of the element, in a header, in a heading)
    places: dict[Node, tuple[bool, Node | None, bool, bool]] = {}

    def place(node: Node) -> tuple[bool, Node | None, bool, bool]:
        way = []
        while node is not None and node not in places:
            way.append(node)
            node = node.parent
        at = places[node] if node is not None else (False, None, False, False)
        for n in reversed(way):
            if n is best:
                at = (True, None, False, False)
            elif at[0]:
                at = (True, at[1] or n, at[2] or n.tag == "header", at[3] or n.tag in HEADINGS)
            places[n] = at
        return at

    where = [place(b.node) for b in found]
    core = [i for i, b in enumerate(found) if where[i][0] and b.node.path in content]
    if not core:
        return ""
    article = best.tag == "article"
    kept = []
    for i, (b, (inside, part, header, heading)) in enumerate(zip(found, where)):
        if not inside or header and not heading:
            continue
        within = core[0] < i < core[-1]
        if b.node.path in content:
            stays = True
        elif b.node.around:
            stays = False
        elif b.linked * 2 > len(b.text):
            stays = heading or b.node.tag == "p" or within and b.node.tag in FLOW
        else:
            stays = article or within or part is None or part.tag in FLOW or part.inline or b.node.tag == "h1"
        if stays:
            kept.append(i)
    titles = [i for i, b in enumerate(found) if b.node.tag == "h1" and not b.node.around]
    if len(titles) == 1 and kept and titles[0] < kept[0] and not where[titles[0]][0]:
        kept.insert(0, titles[0])
    return "\n".join(found[i].text for i in kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, the kept columns, text, n_chars) of every page; a null or empty page gives ''. Repeated rows each give one.

    Pages are parsed whole, one after the other, so memory is bounded by the largest page. Paths with one score are content
    together or not at all. Other columns are not read, and an empty table gives no rows.
    """
    kinds = dict(pages.dtypes)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string, n_chars long"
    return small_batches(pages).select(*names, html_col).mapInArrow(run, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
