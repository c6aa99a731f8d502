"""Document trees: a recovering HTML builder and a strict XML one, with preorder ids.

Recovery rules: names are lower-cased; void elements close themselves; a new p, li, dt, dd,
tr, td, th or option closes an open one of its kind within its container, and a block closes
an open p; script and style hold raw text; an end tag closes up to its nearest open element
and is dropped without one; comments and declarations are dropped; entities are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SELF_CLOSING = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
TEXT = "#text"


class Node:
    """An element, or a text where ``name`` is #text."""

    __slots__ = ("attrs", "children", "end", "id", "name", "parent", "text")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, text: str = "", parent: Node | None = None):
        self.name, self.attrs, self.text, self.parent = name, attrs or {}, text, parent
        self.children: list[Node] = []
        self.id = self.end = 0
        if parent is not None:
            parent.children.append(self)

    @property
    def is_text(self) -> bool:
        return self.name == TEXT

    @property
    def class_attr(self) -> str:
        return self.attrs.get("class", "")

    def walk(self) -> Iterator[Node]:
        """Itself and all below it in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self) -> list[Node]:
        return [c for c in self.children if not c.is_text]

    def content(self) -> str:
        return "".join(n.text for n in self.walk() if n.is_text)

    def has_class_part(self, part: str) -> bool:
        return part in self.class_attr


def _numbered(root: Node) -> Node:
    order = list(root.walk())
    for i, n in enumerate(order):
        n.id = n.end = i
    for n in reversed(order):
        if n.parent is not None:
            n.parent.end = max(n.parent.end, n.end)
    return root


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("#document")
        self.open = [self.top]

    def _close(self, name: str, within: tuple[str, ...] = ()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == name:
                del self.open[k:]
                return
            if self.open[k].name in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in SELF_CLOSING:
            self._close(tag, SELF_CLOSING[tag])
        elif tag in BLOCKS:
            self._close("p", ("div", "td", "li", "section", "article", "body"))
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, parent=self.open[-1])
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].name == tag and tag in ("math", "mi", "mo", "mn", "svg", "path"):
            self.open.pop()

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        last = self.open[-1].children[-1:]
        if last and last[0].is_text:
            last[0].text += data
        else:
            Node(TEXT, text=data, parent=self.open[-1])


def parse_html(source: str) -> Node:
    """The tree of any text; its root is html, made up where it is missing."""
    builder = _Builder()
    builder.feed(source or "")
    builder.close()
    top = builder.top
    roots = [c for c in top.children if c.name == "html"]
    if len(roots) == 1 and all(c is roots[0] or (c.is_text and not c.text.strip()) for c in top.children):
        root = roots[0]
        root.parent = None
    else:
        root = Node("html")
        for c in top.children:
            c.parent = root
            root.children.append(c)
    return _numbered(root)


def parse_xml(source: str) -> Node:
    """The tree of well-formed XML, by local names; ValueError where it is not."""
    try:
        element = ElementTree.fromstring(source)
    except ElementTree.ParseError as e:
        raise ValueError(f"not well-formed: {e}") from e

    def local(name: str) -> str:
        return name.rpartition("}")[2]

    root = Node(local(element.tag), {local(k): v for k, v in element.attrib.items()})
    stack = [(element, root)]
    while stack:
        e, node = stack.pop()
        if e.text:
            Node(TEXT, text=e.text, parent=node)
        for child in e:
            if isinstance(child.tag, str):
                stack.append((child, Node(local(child.tag), {local(k): v for k, v in child.attrib.items()}, parent=node)))
            if child.tail:
                Node(TEXT, text=child.tail, parent=node)
    return _numbered(root)


def parse(source: str, path: str = "") -> Node:
    return parse_xml(source) if path.lower().endswith(".xhtml") else parse_html(source)


def from_text(text: str) -> Node:
    """A document of one paragraph."""
    root = Node("html")
    para = Node("div", {"class": "ltx_para"}, parent=Node("body", parent=root))
    if text:
        Node(TEXT, text=text, parent=para)
    return _numbered(root)
