"""A small element tree over the standard library's HTML parser.

Used inside the page job's tasks, one page at a time. Text nodes stay apart when elements are
replaced by text, because some rules look at whole text nodes.
"""

from __future__ import annotations

from html.parser import HTMLParser

# fixed values: elements that never have content
VOID = set(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split()
)
HIDDEN = {"script", "style", "template"}


class Leaf:
    """A text node; ``shown`` is false for comments and the like."""

    __slots__ = ("text", "shown", "up")

    def __init__(self, text: str, shown: bool = True):
        self.text, self.shown, self.up = text, shown, None


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], None

    def add(self, kid):
        kid.up = self
        self.kids.append(kid)

    def walk(self):
        """Descendants in document order."""
        stack = list(reversed(self.kids))
        while stack:
            item = stack.pop()
            yield item
            if isinstance(item, Node):
                stack.extend(reversed(item.kids))

    def elements(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if isinstance(n, Node) and (not tags or n.tag in tags)]

    def strings(self) -> list[str]:
        """Shown text in order. Scripts and styles show theirs only when asked for directly."""
        own = self.tag in HIDDEN
        return [n.text for n in self.walk() if isinstance(n, Leaf) and n.shown and (own or n.up.tag not in HIDDEN)]

    def text(self, sep: str = "", stripped: bool = False) -> str:
        found = self.strings()
        if stripped:
            found = [t.strip() for t in found if t.strip()]
        return sep.join(found)

    def matches(self, rule: tuple) -> bool:
        """rule: (tag or None, attribute or None, value). A class rule takes one class or the whole list."""
        tag, name, value = rule
        if tag and self.tag != tag:
            return False
        if not name:
            return True
        have = self.attrs.get(name)
        if have is None:
            return False
        return have == value or (name == "class" and (value in have.split() or " ".join(have.split()) == value))

    def find_all(self, rule: tuple) -> list[Node]:
        return [n for n in self.elements() if n.matches(rule)]

    def find(self, rule: tuple) -> Node | None:
        return next((n for n in self.walk() if isinstance(n, Node) and n.matches(rule)), None)


def replace(old, *new):
    """Put nodes in the place of ``old``; nothing happens to a node that is no longer in the tree."""
    if old.up is None:
        return
    kids = old.up.kids
    i = next(k for k, kid in enumerate(kids) if kid is old)
    kids[i : i + 1] = new
    for n in new:
        n.up = old.up
    old.up = None


def release(root: Node) -> None:
    """Take a tree apart that is no longer needed: its nodes know their parents, so only a search for cycles would free it."""
    nodes = list(root.walk())
    for node in nodes:
        node.up = None
        if isinstance(node, Node):
            node.kids = []
    root.kids = []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {})
        for k, v in attrs:
            node.attrs[k] = v or ""
        self.open[-1].add(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        last = self.open[-1].kids[-1] if self.open[-1].kids else None
        if isinstance(last, Leaf) and last.shown:
            last.text += data
        else:
            self.open[-1].add(Leaf(data))

    def handle_comment(self, data):
        self.open[-1].add(Leaf(data, shown=False))


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
