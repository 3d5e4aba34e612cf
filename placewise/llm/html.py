"""Main text of HTML pages: blocks pass points to their ancestors, the best container and its telling siblings are kept.

A name like "sidebar" marks boilerplate, but not where the element holds the page's text. Names of reader comments, notices, adverts and forms always do, unless the element is also
named as content and nothing lies beside it. Among equals the outer and earlier container is taken, and texts are kept in page order.
"""

from __future__ import annotations

import heapq
import html as references
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from placewise.llm.rows import add_columns

# Kinds of elements, after the HTML standard.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "head", "html", "body"}
# An opening tag ends an open element of these kinds, up to the named borders.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
}
NEVER_TEXT = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input label iframe object embed svg math canvas "
    "audio video map menu dialog noframes noembed datalist applet xmp".split()
)
# A part of a class, id or role that marks boilerplate.
JUNK_WORDS = frozenset(
    "sidebar sidebars rail widget widgets menu menus nav navbar navigation navigational breadcrumb breadcrumbs toolbar footer foot colophon masthead header topbar "
    "share sharing social related recommended recommendations more pagination pager search tags copyright legal skip complementary contentinfo dialog hidden".split()
)
# The same, for what is never the page's text whatever its length.
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion promoted comment comments commentlist disqus "
    "reply replies respond discussion cookie cookies consent gdpr notice notices notification alert popup popups modal overlay newsletter subscribe "
    "subscription signup login shoutbox trackback trackbacks".split()
)
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?(?=[\s/]|\Z)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "junk", "unsure", "never", "points", "chars", "linked", "content")

    def __init__(self, tag: str, parent: Node | None, junk: bool = False, content: bool = False, unsure: bool = False, never: bool = False):
        self.tag, self.parent, self.junk, self.content, self.unsure, self.never = tag, parent, junk, content, unsure, never
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0


def _marks(tag: str, raw: str, inside_article: bool) -> tuple[bool, bool, bool, bool]:
    """(boilerplate, named as content, boilerplate only by its name or as a form, by a name that never is the text) by tag and attributes."""
    if tag in NEVER_TEXT and tag != "form":
        return True, False, False, False
    if tag == "header" and not inside_article:
        return True, False, False, False
    named, never, hidden, content = tag == "form", False, False, False
    if raw:
        for name, value in ATTRIBUTE.findall(raw):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
                hidden = True
            elif name in ("class", "id", "role"):
                words = set(_SPLIT.split(_HUMP.sub(" ", value).lower()))
                if tag not in ("html", "body", "article", "main"):
                    never |= bool(words & NEVER_WORDS)
                    named |= bool(words & JUNK_WORDS)
                content |= bool(words & ARTICLE_WORDS)
    return hidden or named or never, content, not hidden, never


def parse(page: str) -> Node:
    """The page's tree; unclosed and wrongly nested tags are put right as browsers roughly do.

    The time is about linear in the page's length, broken pages included: a "<" after the last ">" is text at once, an end tag whose element is not open is passed over without
    a look at the open ones, and where very much was searched for the ends of tags in vain, quotes no longer hide a ">".
    """
    root = at = Node("#root", None)
    opened: Counter[str] = Counter()  # open elements by tag

    def close(node: Node, up: Node) -> Node:
        """Closes ``node`` and all around it below ``up``."""
        while node is not up:
            opened[node.tag] -= 1
            node = node.parent
        return up

    here = 0
    size, last = len(page), page.rfind(">")
    patience = 4 * size
    while here < size:
        begin, found = page.find("<", here), None
        while begin >= 0:  # a stray "<" is text
            after = page[begin + 1 : begin + 2]
            if begin < last or after in "!?":
                found = (TAG if patience > 0 else PLAIN_TAG).match(page, begin)
                if found:
                    break
                if after.isalpha() or after == "/":
                    patience -= last - begin
            begin = page.find("<", begin + 1)
        text = page[here : begin if found else size]
        if text:
            at.children.append(references.unescape(text) if "&" in text else text)
        if not found:
            break
        here = found.end()
        closing, tag = found[1], found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if opened[tag]:
                node = at
                while node.tag != tag:
                    node = node.parent
                at = close(at, node.parent)
            continue
        ends, borders = IMPLIED.get(tag, (None, None))
        if tag in CLOSES_P and opened["p"]:
            node = at
            while node is not root and node.tag != "p" and (node.tag not in BLOCK):
                node = node.parent
            if node.tag == "p":
                at = close(at, node.parent)
        if ends and (many := sum(opened[e] for e in ends)):
            node, outer = at, None
            while node is not root and node.tag not in borders and many:
                if node.tag in ends:
                    outer, many = node, many - 1
                node = node.parent
            at = close(at, outer.parent) if outer else at
        junk, content, unsure, never = _marks(tag, found[3], opened["article"] > 0)
        node = Node(tag, at, junk, content, junk and unsure, never)
        at.children.append(node)
        if tag in VOID or found[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, here)
            node.children.append(page[here : end.start() if end else size])
            here = end.end() if end else size
            continue
        opened[tag] += 1
        at = node
    return root


def _order(root: Node) -> list[Node]:
    """Nodes outside of boilerplate, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.junk]
    return out


def _settle(root: Node) -> None:
    """Takes the mark from elements that are boilerplate by name only but hold the page's text.

    The largest first: an element that is also named as content and holds more text outside of links than all that is kept without it; one that holds ten times as
    much, if what is kept has no article or main element with text; and one with a name of comments, notices, adverts or forms only if it is also named as content and nothing
    is kept without it. What is marked inside of a freed element is then judged in turn.
    """
    every, todo = [], [root]
    while todo:
        node = todo.pop()
        every.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and (not c.junk or c.unsure)]
    if not any(n.unsure for n in every):
        return
    texts = {id(n): [0, 0] for n in every}  # all, and outside of marks
    for node in reversed(every):
        mine = texts[id(node)]
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        mine[0], mine[1] = mine[0] + own, mine[1] + own
        if node.parent is not None and node.tag != "a":
            up = texts[id(node.parent)]
            up[0] += mine[0]
            up[1] += 0 if node.junk else mine[1]
    kept, told, heap = 0, False, []

    def release(top: Node) -> None:
        nonlocal kept, told
        kept += texts[id(top)][1]
        todo = [top]
        while todo:
            node = todo.pop()
            told |= node.tag in ("article", "main") and texts[id(node)][1] > 0
            for child in node.children:
                if isinstance(child, Node) and child.unsure:
                    heapq.heappush(heap, (-texts[id(child)][0], len(texts) + len(heap), id(child), child))
                elif isinstance(child, Node) and not child.junk:
                    todo.append(child)

    release(root)
    while heap:
        size, _, _, node = heapq.heappop(heap)
        if node.never:
            free = node.content and not kept
        else:
            free = -size > kept if node.content else -size > 10 * kept and not told
        if free:
            node.junk = node.unsure = False
            release(node)


def _score(nodes: list[Node]) -> None:
    for node in reversed(nodes):  # children first
        own = [" ".join(c.split()) for c in node.children if isinstance(c, str)]
        node.chars += sum(map(len, own))
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
        if node.tag in SCORED:
            inline = sum(map(len, own)) + sum(c.chars for c in node.children if isinstance(c, Node) and not c.junk and c.tag not in BLOCK)
            if inline:
                commas = sum(x.count(",") + x.count("、") + x.count("،") for x in own)
                points = (1 + commas + min(inline / 100, 3)) * (1 - min(node.linked / max(node.chars, 1), 1))
                share, up = 1.0, node.parent
                while up is not None and share > 0.05:
                    up.points += points * share
                    share /= 2
                    up = up.parent
    for node in nodes:
        if node.content or node.tag in ("article", "main"):
            node.points *= 1.5
        node.points *= 1 - min(node.linked / max(node.chars, 1), 1)


def _kept(root: Node) -> list[Node]:
    """The best container, lifted to the article around it, and siblings that score or read like it."""
    _settle(root)
    nodes = _order(root)
    _score(nodes)
    inner = [n for n in nodes if n.tag not in ("#root", "html")]
    if not inner:
        return [root]
    best = max(inner, key=lambda n: n.points)  # the first of equals, so the outer one
    if best.points <= 0:
        return [n for n in nodes if n.tag == "body"][:1] or [root]
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.tag in BLOCK and best.tag != "body" and best.parent is not None:
        least, beside = best.points * 0.2, []
        for other in best.parent.children:
            if isinstance(other, Node) and not other.junk:
                density = other.linked / max(other.chars, 1)
                reads = other.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and other.chars and density < 0.25
                if other is best or other.points >= least or reads:
                    beside.append(other)
        return beside
    return [best]


def main_text(page: str) -> str:
    """Blocks of the main text in page order, joined by line breaks."""
    blocks: list[str] = []
    current: list[str] = []

    def end_block():
        if line := " ".join("".join(current).split()):
            blocks.append(line)
        current.clear()

    for top in _kept(parse(page)):  # marks are settled by then
        todo: list[Node | str | None] = [top]
        while todo:
            item = todo.pop()
            if item is None:
                end_block()
            elif isinstance(item, str):
                current.append(item)
            elif item.tag == "br":
                current.append(" ")
            elif not item.junk:
                if item.tag in BLOCK:
                    end_block()
                    todo.append(None)
                todo += reversed(item.children)
        end_block()
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "main_text", keep_html: bool = True) -> DataFrame:
    """``pages`` with the main text of the whole page; null or empty html, or a page without text: an empty text.

    All other columns and all rows stay, repeated ones too; a column with the new one's name is replaced. A page is held by one task as a whole, in time about linear in its length.
    """
    return add_columns(pages, html, [(text, T.StringType())], lambda found: [[main_text(x) for x in found]], keep_text=keep_html)
