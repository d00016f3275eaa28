"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas up to their ancestors (whole to the parent, half to the
grandparent, less beyond); a container's points are discounted by its link density. The best container is
kept, or the article that it is a part of, with those siblings that score well, read like text or have few
links, and all that is furniture within is left out. Furniture is told by element, by words in class, id and
role, and by how much of the page's text and links an element holds: see left_out().
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame

from lattica.llm.common import in_batches

#: Elements by what they are to the reader.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg head title iframe object canvas audio video select option textarea button".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
HOLDERS = BLOCK - SCORED | {"td"}  # what can be the container of an article
CLOSES_P = BLOCK - {"html", "body"}
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe"))
#: Words in class, id and role of readers' comments, of other furniture, of what is furniture outside of an article or if it
#: mostly links, and of articles.
REPLIES = re.compile(r"\b(comments?|replies|respond|disqus)\b")
UNLIKELY = re.compile(r"\b(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|share|social|sidebar|breadcrumbs?|menu|navbar|navigation|nav|footer|masthead|pagination|pager|toolbar|widget|notice|login|skip)\b")
DOUBTFUL = re.compile(r"\b(side|related|recommend\w*|header|disclaimer|legal|tags?)\b")
LIKELY = re.compile(r"\b(article|body|content|entry|main|page|post|story|text|blog)\b")
WITHIN = re.compile(r"\b(article|entry|post|story)\b")

#: A tag by HTML's own rules, where a quote counts at the start of a value only, and one that ends at the next > whatever it holds.
TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[\s/]|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+)*+)>")
LOOSE_TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>[^>]*+)>")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$")
SPACES = re.compile(r"[\s_-]+")


class Node:
    __slots__ = ("name", "parent", "children", "hint", "score", "hidden", "within", "out", "length", "linked", "titled")

    def __init__(self, name: str, parent: Node | None, hint: str = "", hidden: bool = False):
        self.name, self.parent, self.hint, self.hidden = name, parent, hint, hidden
        self.children: list[Node | str] = []
        self.score = self.length = self.linked = 0.0
        self.out = self.titled = False
        self.within = parent is not None and (parent.within or parent.name in ("article", "main") or bool(parent.hint and WITHIN.search(parent.hint)))


def parse(html: str) -> Node:
    """A tree of elements and decoded text. Unclosed elements end where HTML ends them, and no text is lost: a closing tag
    without its element is passed over, and a < that starts nothing, or a tag without an end, is text, but for one that ends the page."""
    root = node = Node("html", None)
    opened: Counter[str] = Counter()
    at, end, tag, last = 0, len(html), TAG, html.rfind(">")
    while at < end:
        less = html.find("<", at)
        if less != at:
            less = end if less < 0 else less
            node.children.append(htmllib.unescape(html[at:less]))
            at = less
            continue
        m = tag.match(html, at) if at < last else None
        if m is None:
            if skipped := OTHER.match(html, at):
                at = skipped.end()
                continue
            if html[at + 1 : at + 3].lstrip("/")[:1].isalpha() and tag is TAG and at < last:
                tag = LOOSE_TAG  # a quote that never ends: from here on, tags end at the next >
                continue
            if at + 1 < end:
                node.children.append("<")
            at += 1
            continue
        at = m.end()
        name = m["name"].lower()
        if m["close"]:
            if opened[name]:
                while node.name != name:
                    opened[node.name] -= 1
                    node = node.parent
                opened[name] -= 1
                node = node.parent
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P and opened["p"]:
            node = _closed(node, "p", ("div", "article", "section", "td", "li", "blockquote", "main"), opened)
        if name in ("li", "td", "th", "tr", "dd", "dt", "option") and opened[name]:
            node = _closed(node, name, ("ul", "ol", "table", "dl", "select", "div"), opened)
        attrs = m["attrs"]
        found = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)} if attrs.strip() else {}
        hint = SPACES.sub(" ", f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower()).strip() if found else ""
        hidden = found.get("aria-hidden", "").lower() == "true" or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        child = Node(name, node, hint, hidden)
        node.children.append(child)
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            child.children.append(html[at : close.start() if close else end])
            at = close.end() if close else end
        elif name not in VOID and not EMPTY.search(attrs):
            opened[name] += 1
            node = child
    return root


def _closed(node: Node, name: str, until: tuple[str, ...], opened: Counter[str]) -> Node:
    """The place for a new element that ends an open one of that name, unless it lies outside of one of until."""
    up: Node | None = node
    passed: Counter[str] = Counter()
    while up is not None and up.name not in until:
        passed[up.name] += 1
        if up.name == name:
            opened.subtract(passed)
            return up.parent or up
        up = up.parent
    return node


def _judge(root: Node) -> None:
    """Note for every element whether it is left out, from the text, the links and the title that it holds."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        n, done = stack.pop()
        if not done:
            stack.append((n, True))
            stack += [(c, False) for c in n.children if isinstance(c, Node) and not c.hidden and c.name not in HIDDEN]
            continue
        n.length = float(sum(len(c.strip()) if isinstance(c, str) else c.length for c in n.children))
        n.linked = n.length if n.name == "a" else float(sum(c.linked for c in n.children if isinstance(c, Node)))
        n.titled = n.name == "h1" or any(isinstance(c, Node) and (c.titled or c.name in ("article", "main")) and not (c.hint and REPLIES.search(c.hint)) for c in n.children)
    todo = [root]
    while todo:
        n = todo.pop()
        n.out = n is not root and left_out(n, root.length)
        todo += [c for c in n.children if isinstance(c, Node)]


def left_out(node: Node, total: float) -> bool:
    """Whether an element is furniture: by its kind; by words for comments, unless it holds the title or, as an article, half
    of the page's text; by other such words, unless it holds the title or half of the text or is an article; and by doubtful
    words, outside of an article or where half of its text is links. A header within an article belongs to it."""
    if node.hidden or node.name in HIDDEN or node.name in FURNITURE or node.name == "header" and not node.within:
        return True
    if not node.hint or node.titled:
        return False
    article, most = node.name in ("article", "main"), node.length > 0.5 * total
    if REPLIES.search(node.hint):
        return not (article and most)
    if article or most:
        return False
    if UNLIKELY.search(node.hint):
        return True
    return bool(DOUBTFUL.search(node.hint)) and (node.linked > 0.5 * node.length or not node.within and not WITHIN.search(node.hint))


def _measure(node: Node) -> tuple[float, float]:
    """Give points to the ancestors of paragraphs; returns the length of the node's text, and of that in links. Iterative: pages may nest deeply."""
    sizes: dict[int, tuple[float, float]] = {}
    stack = [(node, False)]
    while stack:
        n, done = stack.pop()
        if not done:
            stack.append((n, True))
            stack += [(c, False) for c in n.children if isinstance(c, Node) and not c.out]
            continue
        own = [c for c in n.children if isinstance(c, str)]
        length = sum(len(c.strip()) for c in own)
        linked, commas = 0.0, sum(c.count(",") + c.count("，") for c in own)
        for c in n.children:
            if isinstance(c, Node) and id(c) in sizes:
                length += sizes[id(c)][0]
                linked += sizes[id(c)][1]
        if n.name == "a":
            linked = length
        sizes[id(n)] = n.length, n.linked = length, linked
        loose = n.name not in SCORED and sum(len(c.strip()) for c in own) >= 25
        if (n.name in SCORED and length >= 1 or loose) and linked <= 0.5 * length:
            points, up = (1 + commas + min(length / 100, 3)) * (1 if length >= 25 else 0.2), n if loose else n.parent
            if n.name == "li" and up is not None:
                up = up.parent  # to what holds the list
            for share in (1, 0.5, 0.25, 0.125):
                if up is None:
                    break
                up.score += points * share
                up = up.parent
    todo = [node]
    while todo:
        n = todo.pop()
        length, linked = sizes[id(n)]
        if n.name in ("article", "main") or n.hint and LIKELY.search(n.hint):
            n.score *= 1.25
        n.score *= 1 - (linked / length if length else 0)
        todo += [c for c in n.children if isinstance(c, Node) and id(c) in sizes]
    return sizes[id(node)]


def _blocks(node: Node, keep: Callable[[Node | str], bool] = lambda c: True) -> list[str]:
    """The white-space-normalised text of each block, in page order, of those children of the node that keep takes."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    stack: list[Node | str | None] = list(reversed([c for c in node.children if keep(c)]))
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif n.name == "br":
            line.append("\n")
        elif not n.out:
            if n.name in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(n.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's text: blocks joined by one space, white space within a block folded. Empty for null, empty or text-free pages."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    _judge(root)
    length, _ = _measure(root)
    if not length:
        return ""
    best, stack = root, [root]
    while stack:
        n = stack.pop()
        if n.score > best.score and n.name in HOLDERS:
            best = n
        stack += [c for c in n.children if isinstance(c, Node) and not c.out]
    while best.name not in ("article", "main") and best.parent is not None and best.parent.name in ("article", "main"):
        best = best.parent
    if best.parent is None:
        return " ".join(_blocks(best))
    return " ".join(_blocks(best.parent, lambda c: c is best or (best.name != "article" if isinstance(c, str) else _reads_on(c, best))))


def _reads_on(node: Node, best: Node) -> bool:
    """Whether a sibling of the best container belongs to the article."""
    if best.score and node.score >= 0.2 * best.score:
        return True
    if best.name not in ("article", "main") and node.length and node.linked <= 0.5 * node.length:
        return True
    return node.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "ul", "ol", "dl", "table") and (best.name != "article" or node.name == "p")


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page, repeated ones too: id, url, text, n_chars. Null, empty and text-free pages have an empty text."""

    def run(texts):
        got = [main_text(t) for t in texts]
        return {"text": got, "n_chars": [len(t) for t in got]}

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id, url))
    return in_batches(pages, [id, url, html], run, f"{kinds}, text string, n_chars bigint", passed=[id, url])
