"""A forgiving HTML reader: block elements as a tree, and the text between their edges in page order.

Time is in proportion to the page, whatever its markup: open elements are found by name, not
by search, and what a scan for a closing quote or tag has learnt holds for the later ones.

Defined results: a tag ends at the first ``>`` outside quotes or, if there is none, at the
first ``>``; without any, it is text. Blocks nested deeper than ``DEEPEST`` hang on the block
of that depth. Elements of ``RAW`` without an end tag take the rest of the page; those of
``LEFT_OUT`` without an end tag (a self-closed ``svg``) are empty.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

# Elements laid out as blocks; all others run on within a line.
BLOCKS = {*"address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()}
# Elements whose content is no markup.
RAW = {*"script style textarea title iframe noembed noframes xmp".split()}
# Elements whose content is markup that belongs to no text.
LEFT_OUT = {*"template noscript svg math object audio video canvas".split()}
# Elements without content.
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
# What an opening element ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements inside which an open paragraph of their surroundings stays open.
WALLS = {"td", "th", "caption", "table", "button", "html"}

#: Open blocks at most; browsers stop at as many.
DEEPEST = 512
START = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass
class Tree:
    """Nodes in page order, the root first; pieces: (node, text) in page order, node -1 for the edge of a block."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)

    def add(self, tag: str, parent: int, attributes: dict[str, str]) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.attributes.append(attributes)
        self.chars.append(0)
        self.linked.append(0)
        return len(self.tags) - 1


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def name_words(value: str) -> list[str]:
    """The lower-case words of names like siteHeader, main-menu or AD_BOX2."""
    return [w.lower() for w in WORDS.findall(value)]


class Ends:
    """Where tags end. The first tag whose quotes never close has the rest of the page read once, backwards, for all later ones."""

    def __init__(self, page: str):
        self.page = page
        self.marks: list[int] | None = None
        self.ends: list[int] = []
        self.none_from = len(page)  # no ">" stands here or later

    def read(self, begin: int) -> None:
        self.marks = [m.start() for m in MARK.finditer(self.page, begin)]
        outside, quoted = -1, {'"': -1, "'": -1}
        ends = []
        for at in reversed(self.marks):
            c = self.page[at]
            if c == ">":
                outside = at
            else:
                outside, quoted[c] = quoted[c], outside
            ends.append(outside)
        self.ends = ends[::-1]

    def after(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``; -1 if it does not end."""
        if at >= self.none_from:
            return -1
        if self.marks is None:
            if (m := QUOTED.match(self.page, at)) is not None:
                return m.end()
            self.read(at)
        k = bisect_left(self.marks, at)
        end = self.ends[k] if k < len(self.marks) else -1
        if end < 0:
            end = self.page.find(">", at)
        if end < 0:
            self.none_from = min(self.none_from, at)
        return end + 1 if end >= 0 else -1


def parse(page: str, parts: frozenset[str] = frozenset()) -> Tree:
    """The tree of a page. Elements within a line whose names hold a word of ``parts`` are nodes as well, without edges."""
    tree = Tree()
    lines: dict[str, list[int]] = {}  # by tag of elements within a line, the nodes that are open, -1 for one that is no node
    stack = [tree.add("#root", -1, {})]
    open_: dict[str, list[int]] = {}  # by tag, where in the stack
    ends, unclosed = Ends(page), set()
    links, at, seek = 0, 0, 0

    def text(value: str) -> None:
        if value:
            value = html.unescape(value) if "&" in value else value
            n = len(value) - value.count(" ") if not value.isspace() else 0
            tree.pieces.append((stack[-1], value))
            tree.chars[stack[-1]] += n
            if links:
                tree.linked[stack[-1]] += n

    def edge() -> None:
        tree.pieces.append((-1, " "))

    def close(names: set[str], walls: set[str]) -> None:
        k = 0
        for name in names:
            if (places := open_.get(name)) and places[-1] > k:
                k = places[-1]
        if k and all(not (places := open_.get(w)) or places[-1] <= k for w in walls):
            for n in stack[k:]:
                open_[tree.tags[n]].pop()
            del stack[k:]

    while (m := START.search(page, seek)) is not None:
        name = m[2]
        if name is None:
            text(page[at : m.start()])
            at = seek = m.end()
            continue
        stop = ends.after(m.end())
        if stop < 0:
            seek = m.end()
            continue
        text(page[at : m.start()])
        raw = page[m.end() : stop - 1]
        at = seek = stop
        name = name.lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                edge()
                close({name}, set() if name in ("html", "body", "table") else {"table"} - {name})
            elif lines.get(name) and (node := lines[name].pop()) >= 0 and (places := open_.get(name)) and stack[places[-1]] == node:
                close({name}, {*BLOCKS})
            continue
        if name in RAW or name in LEFT_OUT:
            empty = name in LEFT_OUT and (name in unclosed or name in ("svg", "math") and raw.endswith("/"))
            end = None if empty else re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if end is not None:
                closing = page.find(">", end.start())
                at = closing + 1 if closing >= 0 else len(page)
            elif name in RAW:
                at = len(page)
            elif not empty:
                unclosed.add(name)
            seek = at
            if name in ("textarea", "iframe", "object", "video", "canvas"):
                edge()
            continue
        if name == "br":
            edge()
            continue
        if name == "a":
            links = 1
            continue
        if name not in BLOCKS:
            if parts and name not in VOID:
                held = attributes(raw) if raw and not raw.isspace() else {}
                named = any(w in parts for k in ("class", "id", "role") if (value := held.get(k)) for w in name_words(value))
                lines.setdefault(name, []).append(len(tree.tags) if named else -1)
                if named:
                    open_.setdefault(name, []).append(len(stack))
                    stack.append(tree.add(name, stack[min(len(stack), DEEPEST) - 1], held))
            continue
        edge()
        if name == "hr":
            close({"p"}, WALLS)
            continue
        if name in ("html", "body") and open_.get(name):
            for k, v in attributes(raw).items():
                tree.attributes[stack[open_[name][0]]].setdefault(k, v)
            continue
        if name in ENDS:
            close(*ENDS[name])
        if name not in ("button", "option", "optgroup", "select", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
            close({"p"}, WALLS)
        if name == "body" or name not in ("html", "head"):
            close({"head"}, {"html", "body"})
        open_.setdefault(name, []).append(len(stack))
        stack.append(tree.add(name, stack[min(len(stack), DEEPEST) - 1], attributes(raw) if raw else {}))
        if name in ("p", "div", "section", "article", "ul", "nav", "footer", "header", "body"):
            links = 0
    text(page[at:])
    return tree
