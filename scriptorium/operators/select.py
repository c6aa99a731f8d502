"""Selecting nodes of document trees.

``named`` are the fixed selectors over one tree; class tests are by substring, as markup
writers combine classes freely. ``nodes`` and ``items`` make them tables: one Arrow pass a
document, wide trees never leaving the worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dom import Node
from ..sources.readers import map_documents
from .dnm import LATEXML, Parameters, flatten

NODES = (
    "doc_id long, node_id int, parent_id int, subtree_end int, depth int, sib_idx int, kind string, "
    "name string, class_attr string, attrs map<string,string>, text string"
)
ITEMS = (
    "doc_id long, item_seq int, item_kind string, node_id int, root_class string, parent_class string, prev_name string, "
    "prev_heading string, prev_text string, has_markup boolean, plaintext string, math array<string>"
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _clean(n: Node) -> bool:
    return not any(d.has_class_part("ltx_ERROR") for d in n.walk() if d is not n)


def paragraphs(root: Node, outermost: bool = False) -> list[Node]:
    """div.ltx_para without errors inside or before it among its siblings."""
    out, end = [], -1
    spoilt: set[int] = set()  # siblings after an error
    for n in root.walk():
        bad = False
        for c in n.children:
            if bad:
                spoilt.add(id(c))
            bad = bad or c.has_class_part("ltx_ERROR")
        if n.name != "div" or not n.has_class_part("ltx_para") or id(n) in spoilt or not _clean(n):
            continue
        if outermost and n.id <= end:
            continue
        end = max(end, n.end)
        out.append(n)
    return out


def headings(root: Node) -> list[Node]:
    return [n for n in root.walk() if n.name in HEADINGS and n.has_class_part("ltx_title") and not n.has_class_part("ltx_title_document") and _clean(n)]


def abstract(root: Node) -> list[Node]:
    """The first paragraph of an abstract."""
    for n in root.walk():
        if n.name == "div" and n.has_class_part("ltx_abstract") and _clean(n):
            for p in n.walk():
                if p.name == "p" and p.has_class_part("ltx_p"):
                    return [p]
    return []


def _first(name: str, part: str) -> Callable[[Node], list[Node]]:
    return lambda root: next(([n] for n in root.walk() if n.name == name and n.has_class_part(part)), [])


keywords, acknowledgement = _first("div", "ltx_keywords"), _first("div", "ltx_acknowledgement")


def captions(root: Node) -> list[Node]:
    return [n for n in root.walk() if n.name == "figcaption" and n.has_class_part("ltx_caption")]


def maths(root: Node) -> list[Node]:
    return [n for n in root.walk() if n.name == "math"]


def references(root: Node) -> list[Node]:
    """span or a whose class has "ltx_ref " or is ltx_ref."""
    return [n for n in root.walk() if n.name in ("span", "a") and ("ltx_ref " in n.class_attr or n.class_attr == "ltx_ref")]


def has_theorems(root: Node) -> bool:
    return any(n.name == "div" and n.has_class_part("ltx_theorem") for n in root.walk())


def extended(root: Node) -> list[tuple[str, Node]]:
    """Abstract, keywords, paragraphs, acknowledgement and captions, in this order."""
    kinds = (("abstract", abstract), ("keywords", keywords), ("paragraph", paragraphs), ("acknowledgement", acknowledgement), ("caption", captions))
    return [(kind, n) for kind, pick in kinds for n in pick(root)]


def filtered(root: Node, test: Callable[[Node], bool]) -> list[Node]:
    return [n for n in root.walk() if test(n)]


_STEP = re.compile(r"(//?)([\w*.-]+)((?:\[[^\]]*\])*)$")


def by_path(root: Node, path: str) -> list[Node]:
    """A subset of XPath: / and // steps by local name or *, with [n], [@a], [@a='v'],
    [contains(@a,'v')] and [local-name()='x']. Any other path is a ValueError."""
    steps = re.findall(r"//?[^/\[]+(?:\[[^\]]*\])*", path.lstrip("."))
    if not steps or "".join(steps) != path.lstrip("."):
        raise ValueError(f"path {path!r} is beyond the subset")
    here, top = [], True
    for step in steps:
        m = _STEP.match(step)
        if not m:
            raise ValueError(f"step {step!r} of {path!r} is beyond the subset")
        deep, name, tests = m.groups()
        found: list[Node] = []
        for base in [root] if top else here:
            pool = ([base] if deep == "/" else list(base.walk())) if top else (base.elements() if deep == "/" else [n for n in base.walk() if n is not base])
            found += [n for n in pool if not n.is_text and name in ("*", n.name)]
        for test in re.findall(r"\[([^\]]*)\]", tests):
            kept = _tested(found, test.strip())
            if kept is None:
                raise ValueError(f"test [{test}] of {path!r} is beyond the subset")
            found = kept
        here, top = sorted(set(found), key=lambda n: n.id), False
    return here


def _tested(found: list[Node], test: str) -> list[Node] | None:
    if test.isdigit():
        at, out = {}, []
        for n in found:
            at[id(n.parent)] = at.get(id(n.parent), 0) + 1
            if at[id(n.parent)] == int(test):
                out.append(n)
        return out
    if m := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*['\"](.*)['\"])?", test):
        return [n for n in found if m[1] in n.attrs and (m[2] is None or n.attrs[m[1]] == m[2])]
    if m := re.fullmatch(r"contains\(\s*@([\w:-]+)\s*,\s*['\"](.*)['\"]\s*\)", test):
        return [n for n in found if m[2] in n.attrs.get(m[1], "")]
    if m := re.fullmatch(r"local-name\(\)\s*=\s*['\"](.*)['\"]", test):
        return [n for n in found if n.name == m[1]]
    return None


def lexemes(math: Node) -> str | None:
    """A formula's lexeme annotation: the one of its own application/x- encoding that isn't TeX."""
    for n in math.walk():
        code = n.attrs.get("encoding", "")
        if n.name == "annotation" and code.startswith("application/x-") and code != "application/x-tex":
            return n.content()
    return None


def node_row(doc_id: int, n: Node, depth: int, sib: int) -> tuple:
    return (doc_id, n.id, None if n.parent is None else n.parent.id, n.end, depth, sib, "text" if n.is_text else "element", n.name, n.class_attr, list(n.attrs.items()), n.text)


def nodes(docs: DataFrame) -> DataFrame:
    """All nodes of documents (doc_id, html): intervals [node_id, subtree_end] hold subtrees."""

    def each(root: Node, doc_id: int) -> Iterator[tuple]:
        stack = [(root, 0, 0)]
        while stack:
            n, depth, sib = stack.pop()
            yield node_row(doc_id, n, depth, sib)
            stack.extend((c, depth + 1, i) for i, c in reversed(list(enumerate(n.children))))

    return map_documents(docs, each, NODES)


def xpath_nodes(docs: DataFrame, *paths: str) -> DataFrame:
    """(path, doc_id, node_id, name, class_attr, text) of the nodes that ``by_path`` selects; a tree is
    built once for all paths."""

    def each(root: Node, doc_id: int) -> Iterator[tuple]:
        for path in paths:
            for n in by_path(root, path):
                yield path, doc_id, n.id, n.name, n.class_attr, n.content()

    return map_documents(docs, each, "path string, doc_id long, node_id int, name string, class_attr string, text string")


GENERIC = {
    "paragraph": lambda root: [n for n in root.walk() if n.name == "p"],
    "heading": lambda root: [n for n in root.walk() if n.name in HEADINGS],
    "reference": lambda root: [n for n in root.walk() if n.name == "a"],
}
KINDS = {
    "extended": extended,
    "paragraph": lambda root: [("paragraph", n) for n in paragraphs(root)],
    "heading": lambda root: [("heading", n) for n in headings(root)],
    "reference": lambda root: [("reference", n) for n in references(root)],
    "math": lambda root: [("math", n) for n in maths(root)],
} | {f"generic_{k}": (lambda root, k=k, pick=pick: [(k, n) for n in pick(root)]) for k, pick in GENERIC.items()}


def item_rows(root: Node, doc_id: int, kind: str, parameters: Parameters) -> Iterator[tuple]:
    """The rows (ITEMS) of one document."""
    theorems = has_theorems(root)
    around: dict[int, dict[int, tuple]] = {}  # of a parent's children the element and the text right before
    for seq, (name, n) in enumerate(KINDS[kind](root)):
        flat = flatten(n, parameters)
        if n.parent is not None and id(n.parent) not in around:
            element = text = None
            own = around[id(n.parent)] = {}
            for c in n.parent.children:
                own[id(c)] = element, text
                element, text = (element, c.text) if c.is_text else (c, None)
        prev, prev_text = around[id(n.parent)][id(n)] if n.parent is not None else (None, None)
        heading = flatten(prev, parameters).plaintext if prev is not None and prev.name.startswith("h") else None
        math = [lexemes(flat.node_at(m.start())) for m in re.finditer("mathformula", flat.plaintext)] if flat.runs else []
        yield (doc_id, seq, name, n.id, n.class_attr, n.parent.class_attr if n.parent is not None else "", prev.name if prev is not None else None, heading, prev_text, theorems, flat.plaintext, math)


def items(docs: DataFrame, kind: str = "extended", parameters: Parameters = LATEXML) -> DataFrame:
    """The selected items of documents (doc_id, html), flattened to plain text, with what
    stands around them."""
    return map_documents(docs, lambda root, doc_id: item_rows(root, doc_id, kind, parameters), ITEMS)


def items_of(docs: DataFrame, kinds: tuple[str, ...], parameters: Parameters = LATEXML) -> DataFrame:
    """The items of several kinds, each with its kind as ``part``; a tree is built once for all."""

    def each(root: Node, doc_id: int) -> Iterator[tuple]:
        for kind in kinds:
            for row in item_rows(root, doc_id, kind, parameters):
                yield kind, *row

    return map_documents(docs, each, f"part string, {ITEMS}")


def lifted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Plain texts (doc_id, text) as documents of one paragraph a line that isn't empty."""
    escaped = F.replace(F.replace(F.replace(F.col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.split(escaped, "\n"), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit('<div class="ltx_para"><p class="ltx_p">'), x, F.lit("</p></div>"))), "")
    return docs.select("doc_id", F.concat(F.lit("<html><body>"), F.coalesce(body, F.lit("")), F.lit("</body></html>")).alias("html"))
