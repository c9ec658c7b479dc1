"""Operator 3: main text of HTML pages by minimum-cut labelling.

A page is read into blocks of text, each with the elements above it. A classifier turns evidence into
log-odds of being content: a block's shape (words, link share, heading, list item) and its elements' kinds,
class, id and role names, which speak for or against all that is below them the weaker the deeper it is,
and not at all where they name a wrapper of most of the page. Positive log-odds are a block's
capacity from the source, negative ones its capacity to the sink. Edges between neighbouring blocks, and
between following blocks of one container, carry a smoothness capacity that falls with their distance
in the tree and with the contrast of their elements' evidence. The minimum cut labels all blocks of the
page together: a short paragraph between long ones stays, a long line in a menu goes. The text of the
blocks on the source's side, in page order, is the result.

Blocks whose own capacity is over all of their edges' together are decided beforehand and passed on
to their neighbours (no minimum cut can say otherwise); augmenting paths settle the rest.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import _common as C

#: Names as HTML fixes them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never shown as running text, with what is in them.
UNSEEN = frozenset("title head select option datalist button textarea noscript template iframe object svg math canvas audio video map dialog".split())
#: Controls, by which a form is told from a form around a page.
CONTROLS = frozenset("input select textarea button".split())
#: Evidence of elements: kinds that hold for all below, those that an article below may outweigh, those that speak for it.
NEVER, OUTSIDE, WITHIN = frozenset("nav menu footer aside".split()), frozenset("header fieldset".split()), {"article": 5.0, "main": 3.0}
#: Words of class, id and role names that speak against or for what is below; those of reader comments.
AGAINST = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline complementary consent contentinfo cookie cookies copyright dialog disclaimer feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager paywall popup privacy promo promoted promotion recommended related search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription teaser toc toolbar topbar widget widgets anuncio anuncios anzeige barre cabecera fusszeile kopfzeile lateral navegacion pied publicidad publicite seitenleiste werbung".split())
COMMENTS = frozenset("comment comments commentaires comentarios discussion disqus kommentar kommentare replies reply".split())
FOR = frozenset("article articlebody body content entry main maincontent post postcontent story text".split())
#: Names that are written together with others; words with which a name tells what a part has or is laid out for.
COMPOUND = re.compile("(?:advert|breadcrumb|cookie|newsletter|sidebar)[a-z]*|[a-z]+(?:banner|footer|header|menu|modal|nav|popup|sidebar|widget)")
COMPOUND_COMMENTS = re.compile("comment[a-z]+|[a-z]+comments")
STATE = frozenset("has have is js layout no not page template with without wrapper".split())
#: Log-odds that the evidence is worth, and what of it is left one element further down.
HINT_NEVER, HINT_OUTSIDE, HINT_NAME, HINT_FOR, KEEP = -8.0, -4.0, -6.0, 2.0, 0.95
#: Words for each control from which a form isn't one for filling in.
FORM_WORDS = 30
#: Log-odds of a block's own shape: start, a heading, each word up to LONG, links throughout, a list item.
START, HEADING, PER_WORD, LONG, LINKS, ITEM = -0.7, 1.5, 0.08, 40, -5.0, -0.5
#: Capacity of an edge between blocks of one parent; each step of tree distance divides it further, as does each CONTRAST of evidence.
SMOOTH, CONTRAST = 3.0, 1.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|xmp|noembed|noframes)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|[^<]++|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = frozenset("class id role".split())
HIDES = re.compile(r"display\s*:\s*none", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element: where it is, what its names say, and how much text, links and controls are in it."""

    __slots__ = ("controls", "depth", "linked", "name", "odds", "parent", "tag", "unseen", "words")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.odds = tag, parent, 0.0
        self.depth = parent.depth + 1 if parent else 0
        self.unseen = bool(parent and parent.unseen) or tag in UNSEEN
        self.words = self.linked = self.controls = 0
        self.name = ""
        if attributes:
            given = attributes_of(attributes)
            self.name = evidence_of(given)
            if any(name == "hidden" or (name == "style" and HIDES.search(value)) for name, value in given):
                self.unseen = True


def attributes_of(raw: str) -> list[tuple[str, str]]:
    """Names in lower case and values ("" if there is none) of a tag's attributes."""
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)]


def evidence_of(attributes: list[tuple[str, str]]) -> str:
    """What class, id and role names say: "comments", "against", "for" or nothing. A name of both kinds, or of a layout, says nothing."""
    said = set()
    for attribute, value in attributes:
        for name in value.split() if attribute in NAMING else ():
            words = {w.lower() for w in NAME_WORD.findall(name)}
            comments = not COMMENTS.isdisjoint(words) or any(map(COMPOUND_COMMENTS.fullmatch, words))
            against, favour = comments or not AGAINST.isdisjoint(words) or any(map(COMPOUND.fullmatch, words)), not FOR.isdisjoint(words)
            if not STATE.isdisjoint(words) or (against and favour):
                continue
            said |= {"comments"} if comments else {"against"} if against else {"for"} if favour else set()
    return "comments" if "comments" in said else "" if {"against", "for"} <= said else next(iter(said), "")


def weigh(nodes: list[Node]) -> None:
    """Sets all elements' evidence; parents come first in `nodes`."""
    for node in reversed(nodes[1:]):
        for what in ("words", "linked", "controls"):
            setattr(node.parent, what, getattr(node.parent, what) + getattr(node, what))
    page = max(1, nodes[0].words)
    for node in nodes[1:]:
        above, tag = node.parent.odds * KEEP, node.tag
        # a name around most of the page's text is one of its layout
        share = node.words / page if node.linked < 0.5 * node.words else 0.0
        name = HINT_NAME * min(1.0, 2 * (1 - share)) if node.name == "against" else HINT_NEVER if node.name == "comments" else 0.0
        if tag in NEVER:
            own = HINT_NEVER
        elif tag in WITHIN:
            own = name + (WITHIN[tag] if above > HINT_NEVER * KEEP**4 else 0.0)
        elif tag == "form":
            own = min(name if node.name != "against" else 0.0, HINT_OUTSIDE if node.words < FORM_WORDS * max(1, node.controls) else 0.0)
        elif tag in OUTSIDE:
            own = min(name, 0.0 if above >= WITHIN["main"] * KEEP**6 else HINT_OUTSIDE)
        elif tag in ("html", "body"):
            own = 0.0
        else:
            own = name or HINT_FOR * (node.name == "for" and above >= 0)
        # what speaks against isn't outweighed by what spoke for it further up
        node.odds = max(HINT_NEVER, min(WITHIN["article"] + HINT_FOR, (min(above, 0.0) if own < -1 else above) + own))


class Open:
    """The open elements: of each kind the places in the stack, so that the nearest one is found without a walk."""

    def __init__(self):
        self.nodes = [Node("", None)]
        self.stack, self.at = [self.nodes[0]], {}

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)
        self.nodes.append(node)

    def close(self, names: Iterable[str], within: Iterable[str] = ()) -> None:
        """Ends the nearest open element of these names, unless one of `within` comes first."""
        nearest = lambda tags: max((p[-1] for t in tags if (p := self.at.get(t))), default=0)
        to = nearest(names)
        if to and to > nearest(t for t in within if t not in names):
            while len(self.stack) > to:
                self.at[self.stack.pop().tag].pop()


def blocks_of(page: str) -> list[tuple[str, Node, float]]:
    """(text, the element that holds it, share of its characters in links) of each block, in page order."""
    tree = Open()
    out, held, linked, total, anchors = [], [], 0, 0, 0

    def flush():
        nonlocal linked, total
        if held:
            raw = "".join(held)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            node = tree.top
            if text and not node.unseen:
                share = linked / max(1, total)
                n = text.count(" ") + 1
                node.words += n
                node.linked += round(n * share)
                out.append((text, node, share))
            held.clear()
            linked = total = 0

    for m in TOKEN.finditer(page):
        tag = m[3] or m[6]
        if tag is None:
            if (t := m[0])[0] != "<" or t == "<":
                held.append(t)
                n = len(t.strip())
                total += n
                linked += n if anchors else 0
            continue
        tag, end = tag.lower(), m[2] or m[5]
        if tag in CONTROLS and not end:
            tree.top.controls += 1
        if tag in INLINE:
            if tag == "a":
                anchors = 0 if end else 1
            continue
        if tag == "br" or tag == "img":
            held.append(" ")
            continue
        flush()
        if end:
            tree.close((tag,), ("article", "main", "body", "div", "section", "td", "li") if tag in ("p", *HEADINGS) else ())
        else:
            if tag in CLOSES_P:
                tree.close(("p",), ("article", "main", "div", "section", "li", "td", "blockquote", "body"))
            if tag in SELF_CLOSING:
                names, within = SELF_CLOSING[tag]
                tree.close(names.split(), within.split())
            if tag == "body":
                tree.close(("head",))
            if tag not in VOID:
                tree.push(Node(tag, tree.top, m[4] or m[7] or ""))
            anchors = 0
    flush()
    weigh(tree.nodes)
    return out


def log_odds(text: str, node: Node, links: float) -> float:
    """Classifier: over 0 speaks for content."""
    words = text.count(" ") + 1
    own = START + PER_WORD * min(words, LONG) + LINKS * links
    own += HEADING if node.tag in HEADINGS else ITEM if node.tag == "li" else 0.0
    return own + node.odds


def distance(a: Node, b: Node) -> int:
    """Steps in the tree between two elements."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def smoothness(nodes: list[Node]) -> list[dict[int, float]]:
    """Edges of each block: to the next one, and to the next one with the same container."""
    edges: list[dict[int, float]] = [{} for _ in nodes]
    last: dict[int, int] = {}
    for i, node in enumerate(nodes):
        pairs = {last[id(node.parent)]} if id(node.parent) in last else set()
        pairs |= {i - 1} if i else set()
        for j in pairs:
            c = SMOOTH / (1 + max(0, distance(nodes[j], node) - 2)) / (1 + abs(nodes[j].odds - node.odds) / CONTRAST)
            edges[i][j] = edges[j][i] = c
        last[id(node.parent)] = i
    return edges


def min_cut(odds: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Which blocks are on the source's side of a minimum cut (the largest such side isn't asked for: ties go to the sink)."""
    n = len(odds)
    odds, label = list(odds), [None] * n
    weight = [sum(e.values()) for e in edges]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) >= weight[i] and (odds[i] or not weight[i]):
            label[i] = odds[i] > 0
            for j, c in edges[i].items():
                if label[j] is None:
                    odds[j] += c if label[i] else -c
                    weight[j] -= c
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        flow = {i: {j: c for j, c in edges[i].items() if label[j] is None} for i in rest}
        excess = {i: odds[i] for i in rest}  # what is left from the source (over 0) or to the sink (under 0)
        cut_off: set[int] = set()  # from where no path leads to the sink any more: nothing flows in or out later
        for s in rest:
            while excess[s] > 1e-12 and s not in cut_off:
                came, queue, t = {s: s}, deque([s]), None
                while queue:
                    i = queue.popleft()
                    if excess[i] < -1e-12:
                        t = i
                        break
                    for j, c in flow[i].items():
                        if c > 1e-12 and j not in came and j not in cut_off:
                            came[j] = i
                            queue.append(j)
                if t is None:
                    cut_off.update(came)
                    break
                path, i = [], t
                while i != s:
                    path.append((came[i], i))
                    i = came[i]
                push = min(excess[s], -excess[t], *(flow[a][b] for a, b in path))
                for a, b in path:
                    flow[a][b] -= push
                    flow[b][a] += push
                excess[s] -= push
                excess[t] += push
        reached = deque(i for i in rest if excess[i] > 1e-12)
        side = set(reached)
        while reached:
            for j, c in flow[reached.popleft()].items():
                if c > 1e-12 and j not in side:
                    side.add(j)
                    reached.append(j)
        for i in rest:
            label[i] = i in side
    return label


def main_text(page: str | None) -> tuple[str, int, int, int]:
    """(text of the content blocks joined by a space, numbers of blocks, of content blocks, of blocks that the cut labelled against the classifier)."""
    blocks = blocks_of(page or "")
    odds = [log_odds(*b) for b in blocks]
    keep = min_cut(odds, smoothness([b[1] for b in blocks]))
    chosen = [b[0] for b, k in zip(blocks, keep, strict=True) if k]
    return " ".join(chosen), len(blocks), len(chosen), sum((o > 0) != k for o, k in zip(odds, keep, strict=True))


def extract(df: DataFrame, html_col: str = "html", id_cols: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """(id columns, text, n_chars, n_blocks, n_content, n_turned) of every row; text is empty if there is none.

    n_turned counts the blocks that the cut labelled against the classifier.

    Null and empty pages give empty texts, broken markup is read as far as it goes, pages of any length
    are read whole, repeated rows repeat, further columns are left out, an empty table gives an empty one.
    """
    id_cols = list(id_cols)

    def rows(*columns):
        found = [main_text(p) for p in columns[-1]]
        return [*columns[:-1], [f[0] for f in found], [len(f[0]) for f in found], *([f[k] for f in found] for k in (1, 2, 3))]

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c].replace('bigint', 'long')}" for c in id_cols)
    return C.per_batch(df, [*id_cols, html_col], f"{schema}, text string, n_chars long, n_blocks int, n_content int, n_turned int", rows)


def op3_mincut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(C.dealt(spark, sf_dir, "pages"))
