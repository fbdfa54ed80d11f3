"""A small element tree of a page on the standard library's parser: what the record parsers ask of one."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end at the start of another of these kinds, unless one of the fences stands between; fixed values
ENDS = {
    "p": (frozenset({"p"}), frozenset({"table", "td", "th", "div", "article", "section", "li", "body", "blockquote"})), "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
BLOCKS = frozenset("div table ul ol article section header footer h1 h2 h3 h4 h5 h6 blockquote form".split())
UNREAD = frozenset({"script", "style", "template"})


def clean(value) -> str:
    """NFC without outer white space."""
    return unicodedata.normalize("NFC", str(value or "")).strip()


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def below(self) -> Iterator[Node]:
        """All elements within, in document order; iterative, so that depth is no limit."""
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))

    def all(self, tag: str | None = None, cls: str | None = None) -> Iterator[Node]:
        return (n for n in self.below() if (tag is None or n.tag == tag) and (cls is None or cls in n.classes()))

    def first(self, tag: str | None = None, cls: str | None = None) -> Node | None:
        return next(self.all(tag, cls), None)

    def own(self, *tags: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag in tags]

    def above(self, tag: str, cls: str | None = None) -> Node | None:
        node = self.parent
        while node is not None and not (node.tag == tag and (cls is None or cls in node.classes())):
            node = node.parent
        return node

    def next(self, tag: str, cls: str | None = None) -> Node | None:
        """The first later sibling of that kind."""
        if self.parent is None:
            return None
        after = self.parent.children[next(i for i, c in enumerate(self.parent.children) if c is self) + 1 :]
        return next((c for c in after if isinstance(c, Node) and c.tag == tag and (cls is None or cls in c.classes())), None)

    def strings(self) -> Iterator[str]:
        """Stripped pieces of text that aren't empty, without those of scripts and styles."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, Node):
                if item.tag not in UNREAD:
                    stack.extend(reversed(item.children))
            elif piece := item.strip():
                yield piece

    def text(self, between: str = " ") -> str:
        return between.join(self.strings())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def _close(self, tags: frozenset[str], fences: frozenset[str]) -> None:
        node = self.at
        while node is not self.root and node.tag not in fences:
            if node.tag in tags:
                self.at = node.parent
                return self._close(tags, fences)
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(*ENDS[tag])
        elif tag in BLOCKS:
            self._close(*ENDS["p"])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    """The tree of a page; broken markup is closed where it must be, and null is an empty page."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
