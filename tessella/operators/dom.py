"""A small document tree on the standard library's parser.

Open elements form a stack; an end tag closes up to the nearest open element of its name
and is ignored where there is none; nothing closes by itself. Trees are treated as
values: transformations return new lists of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())


class Note(str):
    """A comment, declaration or processing instruction, in its written form."""


class Element:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, children: list | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, children or []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self) -> Iterator[Element]:
        """Descendant elements in document order."""
        stack = self.elements()[::-1]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(e.elements()[::-1])

    def strings(self) -> Iterator[str]:
        """Texts in document order, comments aside."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            if isinstance(n, Element):
                stack.extend(n.children[::-1])
            elif not isinstance(n, Note):
                yield n

    def text(self) -> str:
        return "".join(self.strings())

    def copy(self, children: list) -> Element:
        return Element(self.name, dict(self.attrs), children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("[document]")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        siblings = self.open[-1].children
        if siblings and isinstance(siblings[-1], str) and not isinstance(siblings[-1], Note):
            siblings[-1] += data
        else:
            siblings.append(data)

    def handle_comment(self, data):
        self.open[-1].children.append(Note(f"<!--{data}-->"))

    def handle_decl(self, decl):
        self.open[-1].children.append(Note(f"<!{decl}>"))

    def handle_pi(self, data):
        self.open[-1].children.append(Note(f"<?{data}>"))


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def render(node: Element | str) -> str:
    """Markup of a node; the root renders its children alone."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, Note):
            out.append(n)
        elif isinstance(n, str):
            out.append(escape(n, quote=False))
        elif n.name == "[document]":
            stack.extend(n.children[::-1])
        else:
            attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
            if n.name in VOID:
                out.append(f"<{n.name}{attrs}/>")
            else:
                out.append(f"<{n.name}{attrs}>")
                stack.append((f"</{n.name}>",))
                stack.extend(n.children[::-1])
    return "".join(out)


Change = Callable[[Element, list], list]


def rewrite(root: Element, change: Change, keep: Callable[[Element], bool] | None = None) -> Element:
    """Bottom-up rewriting: ``change`` gets an element and its new children and returns what takes its place.

    Subtrees that ``keep`` rejects go before their inside is looked at.
    """

    open_now: list[tuple[Element, Iterator, list]] = [(root, iter(root.children), [])]
    while True:
        e, rest, made = open_now[-1]
        for c in rest:
            if not isinstance(c, Element):
                made.append(c)
            elif keep is None or keep(c):
                open_now.append((c, iter(c.children), []))
                break
        else:
            open_now.pop()
            if not open_now:
                return e.copy(made)
            open_now[-1][2].extend(change(e, made))
