"""A small tree for HTML on the standard parser, and what is read from it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

# Boilerplate, and where the main content is, in order of preference.
BOILERPLATE = [
    "nav", "header", "footer", "aside", ".md-header", ".md-sidebar", ".md-nav", ".md-footer", ".md-search",
    ".md-search__overlay", ".md-tabs", ".skip-link", ".sr-only", ".visually-hidden", "script", "style",
]
MAIN_CONTENT = ["main[role='main']", "main", "div.md-content__inner", "div.md-content", "div.md-main__inner", "article", "div.md-typeset"]

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset(("script", "style"))
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SELECTOR = re.compile(r"^(\w*)(?:\.([\w-]+))?(?:\[role='(\w+)'\])?$")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in _RAW:
                stack.extend(reversed(x.children))

    def text(self, separator: str = "", strip: bool = False) -> str:
        found = (s.strip() for s in self.strings()) if strip else self.strings()
        return separator.join(s for s in found if s or not strip)

    @property
    def heading_level(self) -> int:
        return int(self.tag[1]) if len(self.tag) == 2 and self.tag[0] == "h" and self.tag[1] in "123456" else 0

    def matches(self, rules: Rules) -> bool:
        classes = self.attrs.get("class")
        return any(
            (not tag or self.tag == tag) and (not cls or (classes is not None and cls in classes.split())) and (not role or self.attrs.get("role") == role)
            for tag, cls, role in rules.get(self.tag, rules[""])
        )


Rules = dict[str, list[tuple[str, str, str]]]


def compiled(selectors: list[str]) -> Rules:
    """Selectors by the tag they can match; those of any tag stand under each and under ''."""
    parts = [tuple(x or "" for x in _SELECTOR.match(s).groups()) for s in selectors]
    anywhere = [p for p in parts if not p[0]]
    return {tag: [p for p in parts if p[0] in ("", tag)] for tag in {p[0] for p in parts}} | {"": anywhere}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self._close_implied(tag)
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if data:
            self.at.children.append(data)

    def _close_implied(self, tag: str) -> None:
        ends = _CLOSES.get(tag, ("p",) if tag in _BLOCKS else ())
        if self.at.tag in ends and self.at.parent is not None:
            self.at = self.at.parent
            if tag == "tr" and self.at.tag == "tr" and self.at.parent is not None:
                self.at = self.at.parent


def parse(html: str | None) -> Node:
    """The tree of a text; damaged and missing text give what can be read of it."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_BOILERPLATE = compiled(BOILERPLATE)
_MAIN_CONTENT = [compiled([s]) for s in MAIN_CONTENT]
#: Tags that any of these can match.
_MAIN_TAGS = {tag for rules in _MAIN_CONTENT for tag in rules if tag}


def without_boilerplate(root: Node) -> Node:
    """Drop navigation and the like, keep only the main content if there is one: the first
    element of the most preferred kind that occurs."""
    _prune(root)
    main, preferred = None, len(_MAIN_CONTENT)
    for node in root.walk():
        if node.tag not in _MAIN_TAGS:
            continue
        rank = next((k for k in range(preferred) if node.matches(_MAIN_CONTENT[k])), preferred)
        if rank < preferred:
            main, preferred = node, rank
        if not preferred:
            break
    if main is None:
        return root
    top = Node("", {}, None)
    top.children.append(main)
    return top


def _prune(node: Node) -> None:
    stack = [node]
    while stack:
        x = stack.pop()
        x.children = [c for c in x.children if isinstance(c, str) or not c.matches(_BOILERPLATE)]
        stack.extend(c for c in x.children if isinstance(c, Node))


def headings(root: Node) -> list[tuple[str, str]]:
    """(anchor, title) of every h1 to h3 that has an id."""
    return [(n.attrs["id"], n.text(" ", strip=True)) for n in root.walk() if 1 <= n.heading_level <= 3 and n.attrs.get("id")]


def sections(root: Node) -> list[tuple[str | None, str, int, list[Node | str]]]:
    """(anchor, title, level, content) of every h1 to h3 with an id: the elements after it
    up to the next heading of its level or above. Without any, one row for the whole text."""
    found = []
    places: dict[int, dict[int, int]] = {}
    for node in root.walk():
        if not (1 <= node.heading_level <= 3 and node.attrs.get("id")):
            continue
        siblings = node.parent.children
        if id(node.parent) not in places:
            places[id(node.parent)] = {id(c): k for k, c in enumerate(siblings)}
        content: list[Node | str] = []
        for other in islice(siblings, places[id(node.parent)][id(node)] + 1, None):
            if isinstance(other, str):
                continue
            if 0 < other.heading_level <= node.heading_level:
                break
            content.append(other)
        found.append((node.attrs["id"], node.text(" ", strip=True), node.heading_level, content))
    return found or [(None, "", 0, root.children)]


def section_text(root: Node, anchor: str) -> str:
    """Text from the element with this id on, element by element (nested ones again), up to
    the next heading of its level or above; an element that is no heading counts as level 2."""
    nodes = list(root.walk())
    at = next((k for k, n in enumerate(nodes) if n.attrs.get("id") == anchor), None)
    if at is None:
        return ""
    level = nodes[at].heading_level or 2
    lines = [nodes[at].text(" ", strip=True)]
    for node in nodes[at + 1 :]:
        if 0 < node.heading_level <= level:
            break
        lines.append(node.text(" ", strip=True))
    return "\n".join(x for x in lines if x)


_WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~"}


def markdown(content: list[Node | str]) -> str:
    """Markdown of a fragment, with `#` headings, however deep its elements are nested."""
    # an element, what is left of its content, its Markdown so far, its cells
    stack: list[tuple[Node | None, Iterator[Node | str], list[str], list[str]]] = [(None, iter(content), [], [])]
    numbers: dict[int, dict[int, int]] = {}
    while True:
        node, rest, out, cells = stack[-1]
        x = next(rest, None)
        if x is None:
            stack.pop()
            inner = "".join(out)
            if node is None:
                return inner
            stack[-1][2].append(_marked_up(node, inner, cells, numbers))
            if node.tag in ("td", "th"):
                stack[-1][3].append(" ".join(inner.split()))
        elif isinstance(x, str):
            out.append(x)
        elif x.tag == "pre":
            out.append(f"\n\n```\n{x.text()}\n```\n\n")
        elif x.tag not in _RAW:
            stack.append((x, iter(x.children), [], []))


def _number(item: Node, numbers: dict[int, dict[int, int]]) -> int:
    """The number of an item in its ordered list; ``numbers`` keeps those of lists seen before."""
    if id(item.parent) not in numbers:
        items = (c for c in item.parent.children if isinstance(c, Node) and c.tag == "li")
        numbers[id(item.parent)] = {id(c): k for k, c in enumerate(items, 1)}
    return numbers[id(item.parent)][id(item)]


def _marked_up(x: Node, inner: str, cells: list[str], numbers: dict[int, dict[int, int]]) -> str:
    """Markdown of one element, from that of its content."""
    if x.heading_level:
        return f"\n\n{'#' * x.heading_level} {' '.join(inner.split())}\n\n"
    if x.tag in _WRAP and inner.strip():
        return f"{_WRAP[x.tag]}{inner.strip()}{_WRAP[x.tag]}"
    if x.tag == "a" and x.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({x.attrs['href']})"
    if x.tag == "img":
        return f"![{x.attrs.get('alt', '')}]({x.attrs.get('src', '')})"
    if x.tag == "br":
        return "\n"
    if x.tag == "hr":
        return "\n\n---\n\n"
    if x.tag == "li":
        ordered = x.parent is not None and x.parent.tag == "ol"
        return f"\n{f'{_number(x, numbers)}.' if ordered else '*'} {inner.strip()}"
    if x.tag == "blockquote":
        return "\n\n" + "\n".join(f"> {line}" for line in inner.strip().split("\n")) + "\n\n"
    if x.tag == "tr":
        return f"\n| {' | '.join(cells)} |\n"
    return f"\n\n{inner}\n\n" if x.tag in _BLOCKS else inner
