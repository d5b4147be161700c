"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors (parent: all, next: half,
then a third of that each), a container's points are discounted by its share of linked text,
the best container is taken, widened to the article element it stands in, and joined by those
of its siblings that read like text and by the bare text beside it.  Elements whose name or role says that they are menus,
headers, footers, sidebars, notices, forms, scripts or styles are left out, and so are lists and
boxes beside the container that consist of links, and inside of it menus (nothing but two or
more short links, not under a heading of the text).  A class or id that says so only discounts the points of its box:
the box is left out unless it is the best container, holds it, or is a part of it with text of
its own (boxes of the same words count together; adverts and reader comments are no parts).

Output: character references decoded, white space inside a block turned into one space,
blocks trimmed and joined in page order by one line feed; nothing else is dropped or cut.

Defined cases: null or empty html, or a page without text, gives the empty text; markup that
is not closed ends with its parent; ``<`` that starts no tag is text; repeated rows give a row
each; only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W_]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody td tfoot th thead tr ul""".split())
#: A start tag ends open elements of these names, up to the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
DROP = set("""head script style noscript template svg math canvas object audio video map nav header footer aside form
button select textarea input label fieldset iframe menu dialog title search""".split())
DROP_ROLE = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
DROP_WORD = set("""nav navbar navigation menu menus menubar breadcrumb breadcrumbs header masthead footer foot sidebar side aside
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner banners
cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall
comment comments commentlist respond reply replies disqus discussion
share sharing social related recommended recommendations newsletter subscribe subscription signup login
pagination pager toolbar widget widgets skip tags taglist copyright legal""".split())
#: Words of adverts and reader comments: such boxes are no part of an article around them.
FIRM_WORD = set("ad ads adv advert adverts advertisement advertising sponsored comment comments commentlist disqus respond reply replies".split())
#: ``has-sidebar``, ``no-ads``: the class names a part of the box, not the box.
PART_WORD = {"has", "no", "with", "without"}
DISCOUNT, FIRM_DISCOUNT = 0.25, 0.05
KEEP_WORD = set("article articlebody content main post entry story body text page".split())
SCORED = {"p", "pre", "td", "blockquote", "li", "dd", "div", "section", "article", "main", "body", "html", "center", "details", "h2", "h3"}
#: Containers that may hold text of their own; ``html`` is the page.
HOLDS = {"article", "main", "body", "section", "div", "html", "center", "details"}
MIN_PARAGRAPH = 25


HEADING = object()
KEEP, NAMED, NEVER = 0, 1, 2                     # an element's verdict: kept, discounted by its names, left out


class Node:
    __slots__ = ("name", "parent", "kids", "verdict", "drop", "points", "chars", "linked", "good", "inside",
                 "words", "bad", "weight", "share", "mass", "long", "links", "plain")

    def __init__(self, name: str, parent: Node | None, verdict: int = KEEP, good: bool = False,
                 words: frozenset = frozenset(), bad: frozenset = frozenset()):
        self.name, self.parent, self.good, self.words, self.bad = name, parent, good, words, bad
        self.verdict = NEVER if parent is not None and parent.verdict == NEVER else verdict
        self.drop = self.verdict == NEVER
        self.weight = 1.0 if verdict != NAMED else FIRM_DISCOUNT if bad & FIRM_WORD else DISCOUNT
        self.share = min(self.weight, parent.share) if parent is not None else self.weight
        self.mass, self.long = 0.0, 0            # points and characters of the paragraphs in it, as they are
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main"))
        self.kids: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.links, self.plain = 0, False        # link elements, and whether words stand outside of them


NONE = frozenset()


def _judge(name: str, attrs: str, parent: Node) -> tuple[int, bool, frozenset, frozenset]:
    """(verdict, looks like the article, name words, those that discount it) of a start tag."""
    inside = parent.inside or parent.name in ("article", "main")
    if name in DROP and not (name == "header" and inside):      # an article's own header holds its title
        return NEVER, False, NONE, NONE
    if not attrs.strip() or name in ("html", "body"):
        return KEEP, name in ("article", "main"), NONE, NONE
    words, parts, good = set(), set(), name in ("article", "main")
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), html.unescape(values[0] or values[1] or values[2])
        if key in ("class", "id"):
            for token in value.split():
                found = {w.lower() for w in _PART.findall(token)}
                words |= found
                if found & PART_WORD:
                    parts |= found & DROP_WORD
        elif key == "role":
            if value.lower() in DROP_ROLE:
                return NEVER, False, NONE, NONE
            good |= value.lower() in ("main", "article")
        elif key == "itemprop" and value.lower() in ("articlebody", "text"):
            good = True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or (
                key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return NEVER, False, NONE, NONE
    words = frozenset(words)
    if name == "article":                        # comments and teasers may be articles too
        bad = words & {"comment", "comments", "reply", "ad", "advert", "advertisement", "sponsored", "promo", "related"} - parts
        return NAMED if bad else KEEP, not bad, words, bad
    if name == "main":
        return KEEP, True, words, NONE
    box = name in ("div", "section", "ul", "ol", "dl", "table", "p", "span", "a", "li", "details", "figure", "blockquote", "center")
    bad = (words & DROP_WORD) - parts
    if inside or words & KEEP_WORD:              # article-header, post-title-header
        bad -= {"header"}
    if box and bad:
        return NAMED, False, words, bad
    return KEEP, good or bool(name in ("div", "section") and words & KEEP_WORD), words, NONE


def parse(page: str) -> Node:
    """The page's tree; left-out elements stay in place, marked."""
    root = now = Node("html", None)
    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        end = tag.start() if tag else size
        if end > at and now.verdict != NEVER:
            now.kids.append(html.unescape(page[at:end]))
        if not tag:
            break
        at = tag.end()
        if not tag.group(2):
            continue
        name, close = tag.group(2).lower(), bool(tag.group(1))
        if close:
            node = now
            while node is not None and node.name != name:
                # an inline end tag does not end the block it stands in
                node = None if node.name in BLOCK and name not in BLOCK else node.parent
            if node is not None and node.parent is not None:
                now = node.parent
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P or name in CLOSES:
            ends, stop = CLOSES.get(name, ({"p"}, set()))
            node = now
            while node is not None and node.name not in ends and node.name not in stop and not (
                    ends == {"p"} and node.name in ("td", "th", "button", "caption", "table")):
                node = node.parent
            if node is not None and node.name in ends:
                now = node.parent
        node = Node(name, now, *_judge(name, tag.group(3), now))
        now.kids.append(node)
        if name in VOID or tag.group(3).endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        now = node
    return root


def _walk(root: Node):
    """Nodes that are kept, each before its children (no recursion: depth is the page's)."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.drop]


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        own = sum(len(" ".join(k.split())) for k in node.kids if isinstance(k, str))
        kids = [k for k in node.kids if isinstance(k, Node) and not k.drop]
        node.chars = own + sum(k.chars * k.weight for k in kids)
        node.linked = node.chars if node.name == "a" else sum(k.linked * k.weight for k in kids)
        node.links = (node.name == "a") + sum(k.links for k in kids)
        node.plain = node.name != "a" and (any(k.plain for k in kids) or any(isinstance(k, str) and _WORD.search(k) for k in node.kids))


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _inline_text(node: Node) -> str:
    """Text of a node outside of blocks inside of it."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not (x.drop or x.name in BLOCK):
            stack += reversed(x.kids)
    return " ".join("".join(out).split())


def _score(nodes: list[Node]) -> Node | None:
    for node in nodes:
        if node.name not in SCORED:
            continue
        text = _inline_text(node)
        if len(text) < MIN_PARAGRAPH:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - _density(node))
        up = node
        while up is not None:
            up.mass, up.long = up.mass + points, up.long + len(text)
            up = up.parent
        share, up = node.share, node.parent if node.name not in HOLDS else node
        level = 0
        while up is not None:
            up.points += points * share
            level += 1
            share = node.share * 0.5 if level == 1 else share / 3
            up = up.parent
    best = max(nodes, key=lambda n: n.points * (1 - _density(n)))
    return best if best.points else None


def _settle(nodes: list[Node], best: Node) -> None:
    """What holds the best container stays; other boxes with names against them wait for _parts."""
    up = best
    while up is not None:
        if up.verdict == NAMED:
            up.verdict = KEEP
        up.weight, up = 1.0, up.parent
    for node in nodes:
        if node.verdict == NAMED:
            node.drop = True


def _repeated(best: Node) -> Node:
    """The outermost box around the best container that stands among boxes of its own name and
    words which hold text too (page builders put every paragraph into boxes of its own)."""
    wide, node = best, best
    while node.parent is not None:
        if node.words and any(isinstance(k, Node) and k is not node and k.verdict != NEVER and k.name == node.name and k.words == node.words
                              and k.mass >= 0.2 * node.mass and _density(k) < 0.5 for k in node.parent.kids):
            wide = node
        node = node.parent
    return wide


def _parts(best: Node, wide: Node, tops: list[Node]) -> None:
    """Boxes with names against them that are parts of the best container, or of the article element,
    are taken up again; those named like a box around the best container as well."""
    same, up = set(), best
    while up is not None:
        if up.bad:
            same.add(up.bad)
        if up is wide:
            break
        up = up.parent
    stack = [(t, t is best or t.name in ("article", "main")) for t in tops]
    waiting: dict[frozenset, list[Node]] = {}
    while stack:
        node, part = stack.pop()
        for k in node.kids:
            if isinstance(k, Node) and k.verdict != NEVER:
                own = part or k is best
                if k.drop and (k.bad in same or own and not k.bad & FIRM_WORD):
                    waiting.setdefault(k.bad, []).append(k)
                if not k.drop or k.bad in same or own and not k.bad & FIRM_WORD:
                    stack.append((k, own))
    for bad, boxes in waiting.items():
        if bad in same or _has_text(boxes):
            for k in boxes:
                k.drop, k.weight = False, 1.0


def _has_text(boxes: list[Node]) -> bool:
    return sum(k.long for k in boxes) > 80 and sum(k.linked for k in boxes) < 0.25 * sum(k.chars for k in boxes)


def _link_box(node: Node) -> bool:
    return node.name in ("ul", "ol", "dl", "div", "section") and _density(node) > 0.5 and node.chars > 0


def _menu(node: Node) -> bool:
    return _link_box(node) and not node.plain and node.links > 1 and node.linked < MIN_PARAGRAPH * node.links


def _reads_like_text(node: Node, best: Node) -> bool:
    if _link_box(node):
        return False
    if node.points * (1 - _density(node)) >= max(3.0, 0.2 * best.points):
        return True
    if node.name in ("h1", "h2", "h3"):
        return True
    return node.name == "p" and (node.chars > 80 and _density(node) < 0.25 or node.chars > 0 and not node.linked)


def _beside(parent: Node, wide: Node, best: Node) -> list:
    """The container and what of its parent reads like text, in page order: elements, and runs of
    bare text and inline elements that are not mostly links (None ends a run)."""
    out, run = [], []

    def end():
        chars = sum(len(" ".join(k.split())) if isinstance(k, str) else k.chars for k in run)
        if 2 * sum(k.linked for k in run if isinstance(k, Node)) <= chars and any(
                _WORD.search(k) if isinstance(k, str) else k.chars for k in run):
            out.extend([None, *run, None])
        run.clear()

    for k in parent.kids:
        if isinstance(k, str) or k is not wide and k.name not in BLOCK:
            if isinstance(k, str) or not k.drop:
                run.append(k)
        elif not k.drop:
            end()
            if k is wide or k.bad or _reads_like_text(k, best):
                out.append(k)
    end()
    return out


def _blocks(tops: list) -> list[str]:
    out, run, head = [], [], [0]                 # head: blocks there were when the last heading ended
    chosen = {id(t) for t in tops}

    def end():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    def titled():
        return head[0] and head[0] == len(out) and not "".join(run).strip() and not DROP_WORD & set(_PART.findall(out[-1].lower()))

    stack: list = list(reversed(tops))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif x is HEADING:
            end()
            head[0] = len(out)
        elif isinstance(x, str):
            run.append(x)
        elif x.name == "br":
            run.append(" ")
        elif not x.drop and (id(x) in chosen or not _menu(x) or titled()):
            if x.name in BLOCK:
                end()
                stack.append(HEADING if x.name in ("h1", "h2", "h3", "h4", "h5", "h6") else None)
            stack += reversed(x.kids)
    end()
    return out


def main_text(page: str | None) -> str:
    """The page's article as text."""
    if not page:
        return ""
    root = parse(page)
    nodes = list(_walk(root))
    _measure(nodes)
    best = _score(nodes)
    own = next((n for n in nodes if n.name in ("article", "main") and n.chars and n.verdict == KEEP), None)
    if best is None or own is not None and best.share < 1 and best.points < 3 and not own.points:
        best = own or root                       # no paragraph, or only an advert's: what an article element holds, else the page
        text = _blocks([best])
        _settle(nodes, best)
        return "\n".join(_blocks([best]) or text)
    _settle(nodes, best)
    wide = _repeated(best)
    _measure([n for n in nodes if not n.drop])
    up = wide.parent
    while up is not None:                        # the outermost article-like element it stands in
        if up.good and (up.name == "article" or _density(up) < 0.5):
            wide = up
        up = up.parent
    parent = wide.parent
    if parent is None or wide.good and wide.name in ("article", "main"):
        tops = [wide]
        if parent is not None:                   # an article in several parts of equal rank
            tops = [k for k in parent.kids if isinstance(k, Node) and not k.drop and (
                k is wide or k.name == wide.name and _reads_like_text(k, best))]
    else:
        for k in parent.kids:                    # boxes named like this one, sections of a text
            if isinstance(k, Node) and k.verdict == NAMED and (
                    wide.bad and k.bad == wide.bad or k.name == wide.name == "section" and not k.bad & FIRM_WORD and _has_text([k])):
                k.drop, k.weight = False, 1.0
        tops = _beside(parent, wide, best)
    _parts(best, wide, [t for t in tops if isinstance(t, Node)])
    _measure([n for n in nodes if not n.drop])
    return "\n".join(_blocks(tops))


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` per row of ``pages``."""
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_extract, "id long, url string, text string, n_chars long")
