"""Trees flattened to normalised plain text, with the way back.

A rule for a class comes before one for a name; the first that is found decides: ENTER,
SKIP, a token or a function of the node. Offsets count code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from ..functions.stem import stem_once, stem_words
from ..functions.tables import TRANSLIT_MANY, TRANSLIT_ONE
from ..sources.dom import Node, from_text

ENTER, SKIP = object(), object()


@dataclass(frozen=True)
class Parameters:
    names: dict = field(default_factory=dict)
    classes: dict = field(default_factory=dict)
    normalize_white_spaces: bool = True
    wrap_tokens: bool = False
    normalize_unicode: bool = False
    stem_once: bool = False
    stem_full: bool = False
    lowercase: bool = False
    back_mapping: bool = True

    def check(self) -> list[str]:
        """What looks like a mistake."""
        out = []
        if self.stem_once and self.stem_full:
            out.append("one kind of stemming is enough")
        if (self.stem_once or self.stem_full) and self.back_mapping:
            out.append("stemmed text can't be mapped back")
        if self.wrap_tokens and not (self.names or self.classes):
            out.append("there are no tokens to wrap")
        return out


DEFAULT = Parameters()
LATEXML = Parameters(
    names={"math": "mathformula", "cite": "CitationElement", "img": SKIP, "table": SKIP, "head": SKIP, "footer": SKIP},
    classes={"ltx_equation": "\nmathformula\n", "ltx_equationgroup": "\nmathformula\n", "ltx_ref": "REF"}
    | dict.fromkeys(("ltx_authors", "ltx_TOC", "ltx_note_mark", "ltx_note_outer", "ltx_bibliography", "ltx_tag_figure", "ltx_tag_table"), SKIP),
    normalize_white_spaces=False,
    wrap_tokens=True,
    normalize_unicode=True,
)


def to_ascii(c: str) -> str:
    return c if c.isascii() else TRANSLIT_ONE.get(c) or TRANSLIT_MANY.get(c, "")


_ALL_ASCII = str.maketrans(TRANSLIT_ONE | TRANSLIT_MANY)
_RUNS, _DOUBLE, _NOT_ASCII = re.compile(r"\s+"), re.compile(r"\s\s"), re.compile(r"[^\x00-\x7F]+")


def _shown(text: str, p: Parameters) -> str:
    """A text as it is flattened, but for white space."""
    if p.normalize_unicode and not text.isascii():
        text = _NOT_ASCII.sub("", text.translate(_ALL_ASCII))
    if p.stem_full or p.stem_once:
        text = (stem_words if p.stem_full else stem_once)(text)
    if p.lowercase:
        # Letter by letter: what a letter becomes must not depend on its neighbours.
        text = text.lower() if text.isascii() else "".join(map(str.lower, text))
    return text


def _places(text: str, p: Parameters, blank: bool) -> Sequence[int]:
    """Of each character that a text is flattened to its place there, -1 where it was stemmed."""
    letters = not (p.normalize_unicode and not text.isascii() or p.stem_full or p.stem_once or p.lowercase)
    if letters and not (p.normalize_white_spaces and (blank and text[:1].isspace() or _DOUBLE.search(text))):
        return range(len(text))
    pairs = [(c, i) for i, c in enumerate(text)]
    if p.normalize_unicode:
        pairs = [(d, i) for c, i in pairs for d in to_ascii(c)]
    if p.stem_full or p.stem_once:
        pairs = [(c, -1) for c in (stem_words if p.stem_full else stem_once)("".join(c for c, _ in pairs))]
    if p.lowercase:
        pairs = [(d, i) for c, i in pairs for d in c.lower()]
    out = []
    for c, i in pairs:
        space = p.normalize_white_spaces and c.isspace()
        if not (space and blank):
            out.append(i)
        blank = space
    return out


@dataclass
class Flat:
    root: Node
    plaintext: str
    spans: dict[int, tuple[int, int]]  # node id: start, end
    # Where each run of one node's characters begins, the node, and whether a blank stood before
    # it, None for a token; empty without a way back.
    runs: list[tuple[int, Node, bool | None]]
    parameters: Parameters
    _known: dict[int, Sequence[int]] = field(default_factory=dict, repr=False)
    _nth: dict[int, dict[int, int]] = field(default_factory=dict, repr=False)

    def span_of(self, node: Node) -> tuple[int, int]:
        """Where a node's text is; (0, 0) where the node was skipped."""
        return self.spans.get(node.id, (0, 0))

    def node_at(self, at: int) -> Node:
        return self.runs[bisect_right(self.runs, at, key=_start) - 1][1]

    def nodes_at(self, places: list[int]) -> list[Node | None]:
        """The nodes of characters in ascending order."""
        if not self.runs:
            return [None] * len(places)
        out, k = [], bisect_right(self.runs, places[0], key=_start) - 1 if places else 0
        last = len(self.runs) - 1
        for at in places:
            while k < last and self.runs[k + 1][0] <= at:
                k += 1
            out.append(self.runs[k][1])
        return out

    def origin(self, at: int) -> tuple[Node, int]:
        """A character's node and place there, -1 for a token. Places are made out for the nodes that
        are asked for."""
        start, node, blank = self.runs[k := bisect_right(self.runs, at, key=_start) - 1]
        if blank is None:
            return node, -1
        if k not in self._known:
            self._known[k] = _places(node.text, self.parameters, blank)
        return node, self._known[k][at - start]

    @property
    def back(self) -> list[tuple[Node, int]]:
        """Of each character its node and place there, -1 for a token."""
        return [self.origin(at) for at in range(len(self.plaintext))] if self.runs else []

    def nth(self, node: Node) -> int:
        """A node's number among the children of its name, from 1; a parent's are counted at once."""
        if id(node.parent) not in self._nth:
            seen: dict[str, int] = {}
            own = self._nth[id(node.parent)] = {}
            for c in node.parent.children:
                own[id(c)] = seen[c.name] = seen.get(c.name, 0) + 1
        return self._nth[id(node.parent)][id(node)]


def _start(run: tuple) -> int:
    return run[0]


def flatten(root: Node, p: Parameters = DEFAULT) -> Flat:
    parts: list[str] = []
    runs: list[tuple[int, Node, bool | None]] = []
    spans: dict[int, tuple[int, int]] = {}
    size, blank = 0, True

    def token(node: Node, text: str) -> None:
        nonlocal size, blank
        before = " " if p.wrap_tokens and not (blank and p.normalize_white_spaces) else ""
        blank = blank or bool(before)
        if p.wrap_tokens:
            # With the space behind it, which normalised white space has too: a token is no blank.
            text, blank = f"{before}{text} ", True
        else:
            blank = False
        if text:
            runs.append((size, node, None))
            parts.append(text)
            size += len(text)

    def text_node(node: Node) -> None:
        nonlocal size, blank
        text, before = _shown(node.text, p), blank
        if not text:
            return
        if p.normalize_white_spaces:
            text = _RUNS.sub(" ", text)
            blank = text[-1] == " "
            if before and text[0] == " ":
                text = text[1:]
        else:
            blank = False
        if text:
            runs.append((size, node, before))
            parts.append(text)
            size += len(text)

    def rule(node: Node):
        if p.classes and (names := node.attrs.get("class")):
            for name in names.split():
                if name in p.classes:
                    return p.classes[name]
        return p.names.get(node.name, ENTER)

    stack: list[tuple[Node, int | None]] = [(root, None)]
    while stack:
        node, start = stack.pop()
        if start is not None:
            spans[node.id] = (start, size)
            continue
        at = size
        if node.is_text:
            text_node(node)
            spans[node.id] = (at, size)
            continue
        what = rule(node)
        if what is ENTER:
            stack.append((node, at))
            stack.extend((c, None) for c in reversed(node.children))
            continue
        if what is not SKIP:
            token(node, what(node) if callable(what) else what)
        spans[node.id] = (at, size)
    return Flat(root, "".join(parts), spans, runs if p.back_mapping else [], p)


def flat_text(text: str, p: Parameters = DEFAULT) -> Flat:
    return flatten(from_text(text), p)


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    """A range without white space at its ends; nothing but it is an empty range at the end."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def from_byte_offsets(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of a range of UTF-8 bytes; a character that it ends in is included."""
    raw = text.encode()
    lead = lambda b: len(raw[:b].decode("utf-8", "ignore"))
    a, b = lead(start), lead(end)
    return a, b + (len(text[:b].encode()) < min(end, len(raw)))


def _path(flat: Flat, node: Node) -> str:
    steps = []
    while node is not None:
        if "id" in node.attrs:
            return f'//*[@id="{node.attrs["id"]}"]' + "".join(reversed(steps))
        if node.parent is None:
            break
        name = "text()" if node.is_text else node.name
        steps.append(f"/{name}[{flat.nth(node)}]")
        node = node.parent
    return f"/{node.name}[1]" + "".join(reversed(steps)) if steps else "/"


def _pointer(flat: Flat, at: int) -> str:
    if not flat.runs or at >= len(flat.plaintext):
        return "/"
    node, i = flat.origin(at)
    return f"string-index({_path(flat, node)},{i + 1})" if i >= 0 else _path(flat, node)


def serialize(flat: Flat, start: int, end: int) -> str:
    """A range as an XPointer; the end of the document is its root."""
    return f"arange({_pointer(flat, start)},{_pointer(flat, end)})"


def deserialize(flat: Flat, pointer: str) -> tuple[int, int] | None:
    """The range of an XPointer that ``serialize`` made, None where it has no place here."""
    m = re.fullmatch(r"arange\((string-index\(.*?,\d+\)|[^,]*),(string-index\(.*,\d+\)|[^,]*)\)", pointer)
    if not m:
        return None
    at = {}
    size = len(flat.plaintext) if flat.runs else 0
    for k in range(size - 1, -1, -1):
        at[_pointer(flat, k)] = k
    found = [size if k == 1 and g == "/" and g not in at else at.get(g) for k, g in enumerate(m.groups())]
    return None if None in found else (found[0], found[1])


def canonical(node: Node, flat: Flat) -> str:
    """A subtree by names, sorted classes and text. Annotations go, semantics is unwrapped,
    blank text and text that isn't in ``flat`` go."""
    out, stack = [], [node]
    while stack:  # of nodes, and of end tags that follow them; markup may be deep
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.is_text:
            a, b = flat.span_of(n)
            text = flat.plaintext[a:b]
            out.append(text if text.strip() else "")
        elif n.name not in ("annotation", "annotation-xml"):
            if n.name != "semantics":
                classes = sorted(n.class_attr.split())
                mark = f' class="{" ".join(classes)}"' if classes else ""
                out.append(f"<{n.name}{mark}>")
                stack.append(f"</{n.name}>")
            stack.extend(reversed(n.children))
    return "".join(out)


def readable(node: Node) -> str:
    """A formula for reading: element names and text, without annotations; semantics is unwrapped."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.is_text:
            out.append(n.text)
        elif n.name not in ("annotation", "annotation-xml"):
            if n.name != "semantics":
                out.append(f"<{n.name}>")
                stack.append(f"</{n.name}>")
            stack.extend(reversed(n.children))
    return "".join(out)


def canonical_hash(node: Node, flat: Flat) -> str:
    return hashlib.md5(canonical(node, flat).encode()).hexdigest()


def with_rules(p: Parameters, names: dict[str, object | str | Callable] | None = None, classes: dict | None = None) -> Parameters:
    return replace(p, names=p.names | (names or {}), classes=p.classes | (classes or {}))
