"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks, each with its root-to-leaf tag path.  Per
path, text length and punctuation per block are aggregated, smoothed along the
tree (a path takes part in the scores of its ancestors' subtrees, and in those of the blocks
that lie in the same container, not counting lists, tables and the like as one), fused into
one score, and paths below a share of the best score are dropped, unless a block lies
between kept blocks of its container.  Blocks that
are all link have a path of their own, which goes if it holds several links
(headings excepted), wherever it lies, unless they are a list below a heading of the article
("Sources"), whose words do not announce furniture.  Subtrees
whose tag or role names furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments) never take part; those that only a class name or id
names so come back if they hold the page's article or most of its text, or if
nothing else is left.  Inside a marked article a class name names furniture only as a whole
("share", "share-buttons", not "share-price-table").  If the page marks its article, that weights the scores:
a path inside it stays with less, one outside it needs more.

Defined results: a null or empty page, or one without text, gives an empty
text; markup that is never closed or closed twice is read as browsers do in
the cases that matter for text (implied ends of p, li, td and the like; raw
text of script and style); repeated rows are extracted one by one; an empty
table gives an empty table; extra columns are left out.  Whole pages are read
in about linear time at any depth: paths are nodes of a tree, scores go up and down it once.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Decay of a subtree's best score per level on its way to a path inside it.
DECAY = 0.5
#: Paths below this share of the best smoothed score are not content.
THRESHOLD = 0.08
#: An <article> or <main> counts if it holds this share of the candidate text.
MARKED_SHARE = 0.3
#: Weights of the scores inside and outside of it.
INSIDE, OUTSIDE = 2.0, 0.25
#: A block with this share of link text is all link.
ALL_LINK = 0.9

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img br".split())
#: A start tag that ends open elements of these names, up to the given limits.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ("html",)),
    "thead": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that structure text within a container.
STRUCTURE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address center".split())
#: Elements inside which an open p of outside is not ended.
P_LIMIT = frozenset("table td th caption button object html body article section div aside nav li dd blockquote".split())
# Furniture by tag, by role, and by words of class and id.
DROP_TAGS = frozenset(
    "head nav footer aside form script style noscript iframe template button select textarea svg math canvas audio video object "
    "dialog menu fieldset datalist noembed noframes title map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
DROP_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts "
    "advertisement advertising adsense adslot banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "commentlist disqus respond replies reply discussion responses pagination pager toolbar widget skip alert alerts disclaimer legal "
    "copyright paywall toast cookiebar teaser outbrain taboola topbar submenu mainmenu sitemap crumb crumbs rail colophon branding "
    "logo".split())
#: Whole class names that make even an <article> furniture (comments and teasers are often articles).
DROP_ARTICLES = frozenset("comment comments reply ad ads advert advertisement sponsored promo teaser related".split())
#: Words that say nothing about what a named box holds.
BOX_WORDS = frozenset(
    "box bar list links link buttons button btn btns block wrap wrapper wrapping container section area panel posts post icons icon row inner outer media tools "
    "tool items item group widget sidebar top bottom left right main article stories story signup form counts count bottombar topbar holder slot unit space zone".split())
#: Beginnings of headings above lists of links that are no part of an article.
FURNITURE_HEADING = re.compile(
    r"(?:related|recommended|popular|trending|most read|latest|more|read (?:more|next|also)|you (?:may|might)|share|follow|advert|sponsored|promoted|"
    r"comments?|newsletter|subscribe|navigation|menu|categories|tags|archives?|in this section)\b", re.I)
_AD = re.compile(r"ad(?:s|box|slot|unit|container|wrapper|block|space|zone|link|vert\w*)?s?")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>?"
                       r"|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = regex.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORDS = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCT = regex.compile(r"[.,;:!?…。，；：！？、]")
_SPACE = regex.compile(r"\s+")


#: A class name that starts or ends so tells of layout or of content, whatever else it holds.
LAYOUT_FIRST = frozenset("has with without no not is layout left right".split())
LAYOUT_LAST = frozenset("content contents page pages paper text body main article post story layout template".split())


class Path:
    """A root-to-leaf tag path as a node of the tree of all paths of a page; ``order`` numbers them, parents first."""

    __slots__ = ("parent", "tag", "depth", "order", "below", "all")

    def __init__(self, parent: "Path | None", tag: str):
        self.parent, self.tag, self.below = parent, tag, {}
        self.depth = parent.depth + 1 if parent else 0
        self.all = parent.all if parent else []
        self.order = len(self.all)
        self.all.append(self)

    def child(self, tag: str) -> "Path":
        found = self.below.get(tag)
        if found is None:
            found = self.below[tag] = Path(self, tag)
        return found


class Node:
    """An open element.  ``block``: the nearest block element, ``box``: the nearest container, ``named``: (outer, number) of
    the nearest element named as furniture.  An inline element that was ended across blocks has no name."""

    __slots__ = ("name", "path", "drop", "marked", "is_block", "block", "box", "link", "named")

    def __init__(self, name: str, path: Path, drop: bool, marked: int, up: "Node | None", is_block: bool, link: bool = False, named: tuple | None = None):
        self.name, self.path, self.drop, self.marked, self.link, self.named = name, path, drop, marked, link, named
        self.is_block = is_block
        self.block = self if is_block else up.block
        self.box = self if is_block and name not in STRUCTURE else up.box if up else self


class Block:
    """A block of text: its path, number of the marked article around it (0: none), text, share of link text, links, and containers."""

    __slots__ = ("owner", "path", "marked", "text", "link", "links", "box", "heading", "listed", "named")

    def __init__(self, owner: Node, text: str, link: float, links: int):
        self.heading = owner.name in HEADINGS
        self.listed = link >= ALL_LINK and not self.heading
        self.path = owner.path.child("a") if self.listed else owner.path
        self.marked, self.text, self.link, self.links = owner.marked, text, link, links
        self.owner, self.box, self.named = owner, owner.box, owner.named


def furniture_name(name: str, in_marked: bool) -> bool:
    """Whether one class name or id names furniture; inside a marked article only if all of its words do."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if len(words) > 1 and (words[0] in LAYOUT_FIRST or words[-1] in LAYOUT_LAST):
        return False
    ads = {w for w in words if _AD.fullmatch(w)}
    if in_marked:
        found = (DROP_WORDS.intersection(words) | ads) - {"header"}
        return bool(found - {"widget", "sidebar"} or len(words) == 1 and found) and all(w in found or w in BOX_WORDS for w in words)
    return bool(ads or DROP_WORDS.intersection(words))


def furniture(name: str, attrs: str, in_marked: bool) -> int:
    """Whether an element's subtree is no main text: 2 surely, 1 by a class name or id."""
    if name in DROP_TAGS or name == "header" and not in_marked:
        return 2
    if not attrs or name in ("html", "body"):
        return 0
    named = 0
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in DROP_ROLES:
            return 2
        if key in ("class", "id") and name not in ("article", "main") and any(furniture_name(x, in_marked) for x in value.split()):
            named = 1
        if key == "class" and name == "article" and DROP_ARTICLES & set(value.lower().split()):
            return 2
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and regex.search(r"display\s*:\s*none", value, regex.I):
            return 2
    return 2 if regex.search(r"(?:^|\s)hidden(?:\s|$)", attrs) else named


def unnamed(found: list[Block], holds: dict[int, tuple | None]) -> list[Block]:
    """The blocks outside subtrees that are furniture by name.  A subtree that holds the page's
    article (of the marked ones, that with most text) is none, nor, on a page that marks none
    outside of it, one that holds most of the text; if nothing is left, all blocks stay."""
    marks: dict[int, int] = {}
    names: dict[int, int] = {}
    outer: dict[int, tuple | None] = {}
    for f in found:
        if f.marked:
            marks[f.marked] = marks.get(f.marked, 0) + len(f.text)
        at = f.named
        if at:
            names[at[1]] = names.get(at[1], 0) + len(f.text)
        while at and at[1] not in outer:
            outer[at[1]] = at[0]
            at = at[0]
    if not outer:
        return found
    for k in sorted(outer, reverse=True):  # inner ones have higher numbers
        if outer[k]:
            names[outer[k][1]] = names.get(outer[k][1], 0) + names.get(k, 0)
    article = max(marks, key=marks.get) if marks else 0
    around, at = set(), holds.get(article)
    while at:
        around.add(at[1])
        at = at[0]
    whole = sum(len(f.text) for f in found)
    gone: set[int] = set()
    for k in sorted(outer):
        if outer[k] and outer[k][1] in gone or k not in around and (article or 2 * names.get(k, 0) <= whole):
            gone.add(k)
    return [f for f in found if not f.named or f.named[1] not in gone] or found


def blocks(page: str) -> list[Block]:
    """Every block that is no furniture, in page order."""
    out: list[Block] = []
    holds: dict[int, tuple | None] = {}  # of marked articles, the subtrees named as furniture around them
    opened = 0
    root = Node("", Path(None, ""), False, 0, None, True)
    stack = [root]
    where: dict[str, list[int]] = {}  # positions on the stack by name, of limits of p, of blocks
    limits: list[int] = []
    block_at: list[int] = [0]
    text: list[str] = []
    linked = anchors = seen = 0  # characters in links, links, characters of pieces that are not only space
    owner = root  # the block element that the collected text belongs to

    def flush() -> None:
        nonlocal linked, anchors, seen
        if text:
            raw = "".join(text)
            joined = _SPACE.sub(" ", html.unescape(raw)).strip()
            text.clear()
            if joined:
                out.append(Block(owner, joined, linked / max(seen, 1), anchors))
        linked = anchors = seen = 0

    def push(node: Node) -> None:
        k = len(stack)
        stack.append(node)
        where.setdefault(node.name, []).append(k)
        if node.name in P_LIMIT:
            limits.append(k)
        if node.is_block:
            block_at.append(k)

    def pop_to(k: int) -> None:
        if block_at[-1] >= k:
            flush()
        for node in reversed(stack[k:]):
            if node.name:
                where[node.name].pop()
        del stack[k:]
        while limits and limits[-1] >= k:
            limits.pop()
        while block_at[-1] >= k:
            block_at.pop()

    def last(name: str) -> int:
        at = where.get(name)
        return at[-1] if at else 0

    def add(raw: str) -> None:
        nonlocal owner, linked, anchors, seen
        top = stack[-1]
        if raw and not top.drop:
            if top.block is not owner:
                flush()
                owner = top.block
            text.append(raw)
            n = 0 if raw.isspace() else len(raw)
            seen += n
            linked += n if top.link else 0
            anchors += top.name == "a"

    pos, size, tags_end = 0, len(page), page.rfind(">")
    while pos < size:
        m = _TOKEN.search(page, pos) if pos <= tags_end or page.find("<!", pos) >= 0 else None
        if m is None:
            add(page[pos:])
            break
        add(page[pos:m.start()])
        pos = m.end()
        if m["cdata"] is not None:
            add(html.escape(m["cdata"]))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                add(" ")
            k = last(name)
            if k and (name not in INLINE or block_at[-1] < k):
                pop_to(k)
            elif k:  # an inline end across blocks ends only that inline element
                where[name].pop()
                stack[k].name = ""
            continue
        if name == "br":
            add(" ")
            continue
        inline = name in INLINE
        if not inline:
            k = last("p")
            if k and (not limits or k >= limits[-1]):
                pop_to(k)
            if name in ENDS:
                ended, within = ENDS[name]
                limit = max(map(last, within))
                low = min((at[j] for at in (where.get(x, ()) for x in ended) if (j := bisect_right(at, limit)) < len(at)), default=0)
                if low:
                    pop_to(low)
            if name in VOID:
                if not stack[-1].drop:
                    flush()
                continue
        elif name in VOID:
            continue
        if name in RAW:
            end = regex.compile(rf"</{name}\s*>", regex.I).search(page, pos)
            pos = end.end() if end else size
            continue
        top = stack[-1]
        attrs = m["attrs"] or ""
        opened += 1
        marked = top.marked
        if not marked and (name in ("article", "main") or 'role="main"' in attrs or "articleBody" in attrs):
            marked = opened
            holds[marked] = top.named
        kind = 2 if top.drop else furniture(name, attrs, bool(top.marked))
        drop = kind == 2 or kind == 1 and inline
        named = (top.named, opened) if kind == 1 and not inline else top.named
        if drop and not top.drop and not inline:
            flush()
        if not inline and not drop:
            flush()
        if attrs.endswith("/") and name in ("path", "g", "use"):
            continue
        push(Node(name, top.path if inline or drop else top.path.child(name), drop, marked, top, not inline, top.link or name == "a", named))
        if not inline and not drop:
            owner = stack[-1]
    flush()
    return unnamed(out, holds)


def raw_scores(found: list[Block]) -> dict[tuple[Path, bool], tuple[float, float, int]]:
    """Per (path, inside an article): text length and punctuation per block, fused, less what is link text; share of
    text that is no link; number of links."""
    n: dict[tuple, list] = {}
    for f in found:
        k = n.setdefault((f.path, bool(f.marked)), [0, 0, 0, 0.0, 0])
        k[0] += 1
        k[1] += len(f.text)
        k[2] += len(_PUNCT.findall(f.text))
        k[3] += 0.0 if f.heading else f.link * len(f.text)
        k[4] += f.links
    return {key: (math.log1p(chars / m) * math.log1p(1 + punct / m) * (1 - links / chars) ** 2, (1 - links / chars) ** 2, anchors)
            for key, (m, chars, punct, links, anchors) in n.items()}


def smoothed(raw: dict[tuple[Path, bool], float], container: dict[Path, Path], top: int) -> dict[tuple[Path, bool], float]:
    """The best of a path's own score, those in the subtrees of its ancestors at level ``top`` or below, less by
    ``DECAY`` with each level up, and, less by ``DECAY``, those of its container (if it has one, see ``Block``): one pass up the
    tree of paths, one down."""
    nodes = next(iter(raw))[0].all
    best = [0.0] * len(nodes)
    inside: dict[Path, float] = {}
    for (p, _), s in raw.items():
        best[p.order] = max(best[p.order], s)
        if p in container:
            inside[container[p]] = max(inside.get(container[p], 0.0), s)
    for p in reversed(nodes):
        if p.parent:
            best[p.parent.order] = max(best[p.parent.order], best[p.order])
    above = [0.0] * len(nodes)
    for p in nodes:
        if p.parent:
            above[p.order] = DECAY * max(above[p.parent.order], best[p.parent.order] if p.parent.depth >= top else 0.0)
    return {key: max(s, above[key[0].order], DECAY * inside[container[key[0]]] if key[0] in container else 0.0) for key, s in raw.items()}


def containers(found: list[Block]) -> dict[Path, Path]:
    """The container of every path whose blocks are text elements (p, li, h2, ...), not containers with text of their own."""
    return {f.path: f.box.path for f in found if f.box is not f.owner}


def scores(found: list[Block]) -> dict[tuple[Path, bool], float]:
    """Fused, smoothed and weighted score by (tag path, inside an article), about 1 for the best."""
    measures = raw_scores(found)
    container = containers(found)
    article = marked_share(found) >= MARKED_SHARE
    # the subtree that holds all of the page says nothing, unless it is the page's article
    top = _spine([p for p, _ in measures]) + 1
    raw = {key: s for key, (s, _, _) in measures.items()}
    smooth = smoothed(raw, container, top)
    if article:
        depth = min(f.box.path.depth for f in found if f.marked)
        if depth < top:
            low = smoothed({k: s for k, s in raw.items() if k[1]}, container, depth)
            smooth.update(low)
    # a path of links only has no part in the text around it; a single link may be a line of it
    smooth = {key: s * measures[key][1] if key[0].tag == "a" and measures[key][2] > 1 else s for key, s in smooth.items()}
    most = max(smooth.values())
    out = {key: s / most if most else 1.0 for key, s in smooth.items()}
    # weight by the page's own mark, if the marked part holds enough text to be the article
    return {key: s * (INSIDE if key[1] else OUTSIDE) for key, s in out.items()} if article else out


def marked_share(found: list[Block]) -> float:
    return sum(len(f.text) for f in found if f.marked) / sum(len(f.text) for f in found)


def _spine(paths: list[Path]) -> int:
    """Levels that all paths share."""
    own = set(paths)
    if len(own) < 2:
        return paths[0].depth if len(paths) > 1 else 0
    nodes = paths[0].all
    n = [0] * len(nodes)
    depth = 0
    for p in reversed(nodes):  # the first to hold all of them is the deepest
        n[p.order] += p in own
        if n[p.order] == len(own):
            depth = p.depth
            break
        if p.parent:
            n[p.parent.order] += n[p.order]
    return depth


def kept(found: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    s = scores(found)
    out = [s[f.path, bool(f.marked)] >= THRESHOLD for f in found]
    # a list of links below a heading of the article
    article = marked_share(found) >= MARKED_SHARE
    head = None
    for k, f in enumerate(found):
        if f.heading:
            head = f if out[k] and (f.marked or not article) and not FURNITURE_HEADING.match(f.text) else None
        elif not f.listed or head is None or f.box is not head.box:
            head = None
        else:
            out[k] = True
    # headings and short blocks between kept blocks of one container
    ends: dict[Node, tuple[int, int]] = {}
    for k, f in enumerate(found):
        if out[k]:
            ends[f.box] = (ends.get(f.box, (k,))[0], k)
    return [keep or not f.listed and f.box in ends and ends[f.box][0] < k < ends[f.box][1] for k, (keep, f) in enumerate(zip(out, found))]


def extract(page: str | None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    return "\n".join(f.text for f, keep in zip(found, kept(found)) if keep) if found else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 8 << 20):
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string")
