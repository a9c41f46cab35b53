"""A small HTML tree with the selectors that adapters use: tag, #id, .class, [attr], [attr=v], [attr*=v], descendant, child, comma."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Opening one of these closes an open one of those, up to a barrier.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: An open paragraph ends where one of these begins.
BLOCKS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def stripped(self) -> str:
        return self.text().strip()

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def descendants(self):
        for c in self.elements():
            yield c
            yield from c.descendants()

    def siblings_after(self) -> list[Node]:
        own = self.parent.elements() if self.parent else []
        return own[next((k for k, x in enumerate(own) if x is self), len(own)) + 1 :]

    def next(self) -> Node | None:
        return next(iter(self.siblings_after()), None)

    def previous(self) -> Node | None:
        own = self.parent.elements() if self.parent else []
        at = next((k for k, x in enumerate(own) if x is self), 0)
        return own[at - 1] if at else None

    def find(self, selector: str) -> list[Node]:
        """Descendants that a selector matches, in the document's order."""
        options = [_compiled(s) for s in selector.split(",")]
        return [n for n in self.descendants() if any(_matches(n, steps, self) for steps in options)]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.find(selector)), None)


_SIMPLE = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)['"]?(?P<val>[^'"\]]*)['"]?)?\]""")
_cache: dict[str, list[tuple[str, list]]] = {}


def _compiled(selector: str) -> list[tuple[str, list]]:
    """[(combinator before, [conditions])], the last one for the element itself."""
    selector = selector.strip()
    if selector not in _cache:
        steps, combinator = [], " "
        for part in re.findall(r">|[^\s>]+", selector):
            if part == ">":
                combinator = ">"
            else:
                steps.append((combinator, [m.groupdict() for m in _SIMPLE.finditer(part)]))
                combinator = " "
        _cache[selector] = steps
    return _cache[selector]


def _fits(n: Node, conditions: list) -> bool:
    for c in conditions:
        if c["tag"] and n.tag != c["tag"].lower():
            return False
        if c["id"] and n.attrs.get("id") != c["id"]:
            return False
        if c["cls"] and c["cls"] not in n.attrs.get("class", "").split():
            return False
        if c["attr"]:
            value = n.attrs.get(c["attr"])
            if value is None or c["op"] == "=" and value != c["val"] or c["op"] == "*=" and (not c["val"] or c["val"] not in value):
                return False
    return True


def _matches(n: Node, steps: list, top: Node) -> bool:
    combinator, conditions = steps[-1]
    if not _fits(n, conditions):
        return False
    if len(steps) == 1:
        return True
    up = n.parent
    while up is not None:
        if _matches(up, steps[:-1], top):
            return True
        if combinator == ">":
            return False
        up = up.parent
    return False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def _close(self, tags: set[str], barriers: set[str]) -> None:
        n, hit = self.at, None
        while n.parent is not None and n.tag not in barriers:
            if n.tag in tags:
                hit = n
            n = n.parent
        if hit is not None:
            self.at = hit.parent

    def _open(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._close(CLOSES[tag], BARRIERS[tag])
        if tag in BLOCKS:
            self._close({"p"}, {"button", "table", "td", "th"})
        if tag == "tr" and self.at.tag == "table":
            self.at = self._open("tbody", {})
        if tag in ("td", "th") and self.at.tag in ("table", "tbody", "thead", "tfoot"):
            if self.at.tag == "table":
                self.at = self._open("tbody", {})
            self.at = self._open("tr", {})
        node = self._open(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        if data:
            self.at.children.append(data)


def parse(text: str) -> Node:
    b = _Builder()
    b.feed(text or "")
    b.close()
    return b.root
