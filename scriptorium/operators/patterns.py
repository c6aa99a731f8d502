"""A pattern language over words, parts of speech, phrases and formulas.

A pattern file is XML: named rules (pos_rule, mtext_rule, math_rule, word_rule, seq_rule) that
refer to one another, forward too. ``load`` compiles every rule to a function, so matching
walks no syntax tree. Found markers are a tree, flattened in preorder for DataFrames.

Where ``compat`` is off, ``word_not`` is a negation; otherwise it passes what its pattern
matches. ``deep`` lets ``math_descendant`` look below a node's children.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from ..functions.batches import map_rows
from ..functions.segment import sentence_spans
from ..functions.tagger import Phrase, chunks, tag
from ..sources.dom import Node, parse
from .dnm import DEFAULT, Flat, Parameters, flat_text, flatten, serialize

FAMILIES = ("pos", "mtext", "math", "word", "seq")
# Options of the constructs, the first of each is its default where it has one.
SEQ_OR = ("first", "atleastone", "any", "longest")
CHILDREN = ("starts_with", "exact", "ends_with", "arbitrary")
DESCENDANT = ("first", "at_least_one", "arbitrary")
PHRASE = ("longest", "shortest")
CONTAINMENT = ("any", "lessorequal")


@dataclass
class Match:
    kind: str  # text or math
    name: str
    tags: list[str]
    start: int
    end: int
    node_id: int | None = None
    below: list[Match] = field(default_factory=list)

    def flat(self, depth: int = 0) -> Iterator[tuple[int, Match]]:
        yield depth, self
        for m in self.below:
            yield from m.flat(depth + 1)


@dataclass(slots=True)
class Word:
    text: str
    pos: str
    start: int
    end: int
    node: Node | None = None


@dataclass
class Parsed:
    """A sentence's words and its phrases' tree; offsets are of the flattened document. A chunker
    makes the tree out where a pattern asks for it."""

    words: list[Word]
    tree: Phrase | None = None
    chunker: Callable | None = None

    def phrases(self) -> Phrase | None:
        if self.tree is None and self.chunker is not None:
            self.tree = self.chunker([w.pos for w in self.words])
        return self.tree


Marks = list[Match] | None
Reached = tuple[int, list[Match]] | None


class PatternFile:
    def __init__(self, source: str, compat: bool = False, deep: bool = False):
        self.compat, self.deep = compat, deep
        self.rules: dict[str, dict[str, Callable]] = {f: {} for f in FAMILIES}
        self.descriptions: dict[tuple[str, str], str] = {}
        self.wanted: set[tuple[str, str]] = set()
        self.bodies: dict[tuple[str, str], ElementTree.Element] = {}
        self._openers: dict[str, frozenset[str] | None] = {}
        try:
            root = ElementTree.fromstring(source)
        except ElementTree.ParseError as e:
            raise ValueError(f"the pattern file is not well-formed: {e}") from e
        for rule in root:
            if rule.tag == "meta":
                continue
            family, _, kind = rule.tag.rpartition("_")
            if kind != "rule" or family not in FAMILIES:
                raise ValueError(f"unexpected rule <{rule.tag}>")
            name, body = _needed(rule, "name"), [c for c in rule if c.tag != "meta"]
            if name in self.rules[family]:
                raise ValueError(f"{family} rule {name!r} is defined twice")
            if len(body) != 1:
                raise ValueError(f"{family} rule {name!r} needs one pattern, it has {len(body)}")
            self.descriptions[family, name] = " ".join((rule.findtext("meta/description") or "").split())
            self.rules[family][name] = getattr(self, family)(body[0])
            self.bodies[family, name] = body[0]
        if missing := sorted(w for w in self.wanted if w[1] not in self.rules[w[0]]):
            raise ValueError(f"rules are missing: {missing}")

    def _ref(self, family: str, e) -> Callable:
        _childless(e)
        name, rules = _needed(e, "ref"), self.rules[family]
        self.wanted.add((family, name))
        return lambda *a: rules[name](*a)

    def _each(self, family: str, e) -> list[Callable]:
        return [getattr(self, family)(c) for c in e]

    def _one(self, family: str, e) -> Callable:
        if len(e) != 1:
            raise ValueError(f"<{e.tag}> needs one child, it has {len(e)}")
        return getattr(self, family)(e[0])

    # Parts of speech and symbols: a test of a string.

    def _test(self, family: str, e, literal: str, attribute: str) -> Callable[[str], bool]:
        if e.tag == f"{family}_ref":
            return self._ref(family, e)
        if e.tag == f"{family}_or":
            parts = self._each(family, e)
            return lambda s: any(p(s) for p in parts)
        if e.tag == f"{family}_not":
            inner = self._one(family, e)
            return lambda s: not inner(s)
        if e.tag == literal:
            _childless(e)
            value = _needed(e, attribute)
            return lambda s: s == value
        raise ValueError(f"<{e.tag}> is no {family} pattern")

    def pos(self, e) -> Callable[[str], bool]:
        return self._test("pos", e, "pos", "tag")

    def mtext(self, e) -> Callable[[str], bool]:
        return (lambda s: True) if e.tag == "mtext_any" else self._test("mtext", e, "mtext_lit", "str")

    # Formulas: a node's marks, or None.

    def math(self, e) -> Callable[[Node], Marks]:
        if e.tag == "math_any":
            return lambda n: []
        if e.tag == "math_ref":
            return self._ref("math", e)
        if e.tag == "math_or":
            return _first(self._each("math", e))
        if e.tag == "math_marker":
            inner, (name, tags) = self._one("math", e), _marker(e)

            def marked(n: Node) -> Marks:
                below = inner(n)
                return None if below is None else [Match("math", name, tags, -1, -1, n.id, below)]

            return marked
        if e.tag == "math_descendant":
            return self._descendant(self._one("math", e), _option(e, "match_type", DESCENDANT))
        if e.tag == "math_node":
            return self._math_node(e)
        raise ValueError(f"<{e.tag}> is no math pattern")

    def _math_node(self, e) -> Callable[[Node], Marks]:
        name, text, below = e.get("name"), None, None
        for c in e:
            if c.tag == "mtext_ref" and text is None:
                text = self._ref("mtext", c)
            elif c.tag == "math_children" and below is None:
                below = _children(self._each("math", c), _option(c, "match_type", CHILDREN))
            else:
                raise ValueError(f"unexpected or repeated <{c.tag}> in <math_node>")

        def node(n: Node) -> Marks:
            if name is not None and n.name != name:
                return None
            if text is not None and (n.elements() or not text(n.content().strip())):
                return None
            return [] if below is None else below(n.elements())

        return node

    def _descendant(self, inner: Callable, kind: str) -> Callable[[Node], Marks]:
        def any_below(n: Node) -> Marks:
            found, hit = [], False
            pool = [x for x in n.walk() if not x.is_text] if self.deep else [n, *n.elements()]
            for x in pool:
                if hit and kind == "first":
                    break
                marks = inner(x)
                if marks is not None:
                    found, hit = found + marks, True
            return found if hit or kind == "arbitrary" else None

        return any_below

    # Words: the marks of the word at a place, or None.

    def word(self, e) -> Callable[[Parsed, int], Marks]:
        if e.tag == "word":
            if len(e):
                raise ValueError("<word> holds text only")
            text = (e.text or "").strip()
            return lambda s, i: [] if s.words[i].text == text else None
        if e.tag == "word_any":
            return lambda s, i: []
        if e.tag == "word_ref":
            return self._ref("word", e)
        if e.tag == "word_or":
            return _first(self._each("word", e))
        if e.tag == "word_not":
            inner = self._one("word", e)
            return inner if self.compat else lambda s, i: [] if inner(s, i) is None else None
        if e.tag == "word_pos":
            if len(e) != 2:
                raise ValueError("<word_pos> needs a pos pattern and a word pattern")
            pos, inner = self.pos(e[0]), self.word(e[1])
            return lambda s, i: inner(s, i) if pos(s.words[i].pos) else None
        if e.tag == "word_math":
            formula = self._one("math", e)

            def math(s: Parsed, i: int) -> Marks:
                n = s.words[i].node
                top = n.elements() if n is not None and n.name == "math" else []
                if top and top[0].name == "semantics":
                    top = top[0].elements()
                return formula(top[0]) if top else None

            return math
        if e.tag == "word_marker":
            inner, (name, tags) = self._one("word", e), _marker(e)

            def marked(s: Parsed, i: int) -> Marks:
                below = inner(s, i)
                return None if below is None else [Match("text", name, tags, s.words[i].start, s.words[i].end, None, below)]

            return marked
        raise ValueError(f"<{e.tag}> is no word pattern")

    # Sequences: from a place, the place after and the marks, or None.

    def seq(self, e) -> Callable[[Parsed, int], Reached]:
        if e.tag == "seq_ref":
            return self._ref("seq", e)
        if e.tag == "seq_word":
            word = self._one("word", e)

            def one(s: Parsed, i: int) -> Reached:
                marks = word(s, i) if i < len(s.words) else None
                return None if marks is None else (i + 1, marks)

            return one
        if e.tag == "seq_seq":
            return _chain(self._each("seq", e))
        if e.tag == "seq_or":
            return _choice(self._each("seq", e), _option(e, "match_type", SEQ_OR, SEQ_OR[0]))
        if e.tag == "seq_marker":
            inner, (name, tags) = self._one("seq", e), _marker(e)

            def marked(s: Parsed, i: int) -> Reached:
                got = inner(s, i)
                if got is None:
                    return None
                end, below = got
                a = s.words[i].start if i < len(s.words) else (s.words[-1].end if s.words else 0)
                return end, [Match("text", name, tags, a, s.words[end - 1].end if end > i else a, None, below)]

            return marked
        if e.tag == "phrase":
            return self._phrase(e)
        raise ValueError(f"<{e.tag}> is no sequence pattern")

    def _phrase(self, e) -> Callable[[Parsed, int], Reached]:
        label, order, first, last, bound = _needed(e, "tag"), PHRASE[0], None, None, CONTAINMENT[0]
        for c in e:
            if c.tag == "match_type":
                order = (c.text or "").strip()
                if order not in PHRASE:
                    raise ValueError(f"unknown match_type {order!r} of <phrase>")
            elif c.tag == "starts_with_seq" and first is None:
                first, bound = self._one("seq", c), _option(c, "containment", CONTAINMENT, CONTAINMENT[0])
            elif c.tag == "ends_with_seq" and last is None:
                last = self._one("seq", c)
            else:
                raise ValueError(f"unexpected or repeated <{c.tag}> in <phrase>")

        def phrase(s: Parsed, i: int) -> Reached:
            ends = phrase_ends(s.phrases(), i, label)
            for end in ends if order == "shortest" else reversed(ends):
                marks: list[Match] = []
                if first is not None:
                    got = first(s, i)
                    if got is None or (bound == "lessorequal" and got[0] > end):
                        continue
                    marks += got[1]
                if last is not None:
                    tail = next((got for k in range(i, end) if (got := last(s, k)) and got[0] == end), None)
                    if tail is None:
                        continue
                    marks += tail[1]
                return end, marks
            return None

        return phrase

    def openers(self, rule: str) -> frozenset[str] | None:
        """The words that a match of a sequence rule may begin with, None where any may."""
        if rule not in self._openers:
            self._openers[rule] = self._first_words("seq", self.bodies["seq", rule], frozenset())
        return self._openers[rule]

    def _first_words(self, family: str, e, above: frozenset) -> frozenset[str] | None:
        if e.tag == f"{family}_ref":
            key = family, e.attrib["ref"]
            return None if key in above else self._first_words(family, self.bodies[key], above | {key})
        if e.tag == "word":
            return frozenset([(e.text or "").strip()])
        if e.tag == "seq_word":
            return self._first_words("word", e[0], above)
        if e.tag == "word_pos":
            return self._first_words("word", e[1], above)
        # A sequence begins with its first part, which has a word where it has openers.
        if e.tag in ("seq_seq", "seq_marker", "word_marker") and len(e):
            return self._first_words(family, e[0], above)
        if e.tag == "word_or" or (e.tag == "seq_or" and e.get("match_type", SEQ_OR[0]) != "any"):
            found = [self._first_words(family, c, above) for c in e]
            return None if None in found else frozenset().union(*found)
        return None

    def match_sentence(self, sentence: Parsed, rule: str) -> list[Match]:
        """The markers found from every word of a sentence on; overlapping ones stay."""
        if rule not in self.rules["seq"]:
            raise ValueError(f"there is no sequence rule {rule!r}")
        if sentence.tree is None and sentence.chunker is None:
            raise ValueError("the sentence has no phrase tree")
        out, openers = [], self.openers(rule)
        for i, word in enumerate(sentence.words):
            if openers is not None and word.text not in openers:
                continue
            got = self.rules["seq"][rule](sentence, i)
            out += got[1] if got else []
        return out


def _needed(e, name: str) -> str:
    if name not in e.attrib:
        raise ValueError(f"<{e.tag}> needs the attribute {name}")
    return e.attrib[name]


def _option(e, name: str, known: tuple[str, ...], default: str | None = None) -> str:
    value = e.get(name, default) if default else _needed(e, name)
    if value not in known:
        raise ValueError(f"unknown {name} {value!r} of <{e.tag}>")
    return value


def _childless(e) -> None:
    if len(e):
        raise ValueError(f"<{e.tag}> has no children")


def _marker(e) -> tuple[str, list[str]]:
    return _needed(e, "name"), [t.strip() for t in e.get("tags", "").split(",")] if "tags" in e.attrib else []


def _first(parts: list[Callable]) -> Callable:
    return lambda *a: next((m for m in (p(*a) for p in parts) if m is not None), None)


def _chain(parts: list[Callable]) -> Callable[[Parsed, int], Reached]:
    def chain(s: Parsed, i: int) -> Reached:
        marks: list[Match] = []
        for p in parts:
            got = p(s, i)
            if got is None:
                return None
            i, marks = got[0], marks + got[1]
        return i, marks

    return chain


def _choice(parts: list[Callable], kind: str) -> Callable[[Parsed, int], Reached]:
    def choice(s: Parsed, i: int) -> Reached:
        got = [g for g in (p(s, i) for p in parts) if g is not None]
        if not got:
            return (i, []) if kind == "any" else None
        if kind == "first":
            return got[0]
        end = max(g[0] for g in got)
        if kind == "longest":
            return (end, next(g[1] for g in got if g[0] == end)) if end > i else (i, [])
        return end, [m for g in got for m in g[1]]

    return choice


def _children(parts: list[Callable], kind: str) -> Callable[[list[Node]], Marks]:
    def below(nodes: list[Node]) -> Marks:
        spare = len(nodes) - len(parts)
        if spare < 0 or (kind == "exact" and spare):
            return None
        for at in {"arbitrary": range(spare + 1), "ends_with": [spare]}.get(kind, [0]):
            got = [p(n) for p, n in zip(parts, nodes[at:])]
            if all(m is not None for m in got):
                return [x for m in got for x in m]
        return None

    return below


def phrase_ends(tree: Phrase | None, at: int, label: str) -> list[int]:
    """Where the phrases of a label that begin at a word end (exclusive), ascending."""
    while tree is not None and tree.start < at:
        tree = next((c for c in tree.children if c.start <= at <= c.end), None)
    ends = []
    while tree is not None and tree.start == at:
        if tree.label == label:
            ends.append(tree.end + 1)
        tree = tree.children[0] if tree.children else None
    return ends[::-1]


def load(source: str, compat: bool = False, deep: bool = False) -> PatternFile:
    """A compiled pattern file; ValueError says what is wrong with it."""
    return PatternFile(source, compat, deep)


def load_file(path: str, compat: bool = False, deep: bool = False) -> PatternFile:
    """A compiled pattern file from the driver's disk."""
    return load(Path(path).read_text(encoding="utf-8"), compat, deep)


def parsed_sentence(flat: Flat, start: int, end: int, tagger: Callable = tag, chunker: Callable = chunks) -> Parsed:
    """A sentence of a flattened document with tags and phrases."""
    found = tagger(flat.plaintext[start:end])
    nodes = flat.nodes_at([start + a for _, _, a, _ in found])
    words = [Word(text, pos, start + a, start + b, n) for (text, pos, a, b), n in zip(found, nodes)]
    return Parsed(words, None, chunker)


MATCHES = (
    "doc_id long, sent_seq int, match_seq int, depth int, parent_idx int, kind string, name string, tags array<string>, "
    "start int, end int, node_id int, text string, pointer string"
)


def match_documents(docs: DataFrame, source: str, rule: str, parameters: Parameters = DEFAULT, text: str | None = None, compat: bool = False, deep: bool = False) -> DataFrame:
    """The markers that a rule finds in the sentences of documents (doc_id, html), or of plain
    texts (doc_id, ``text``), flattened in preorder with their parents' indexes."""
    if rule not in load(source, compat, deep).rules["seq"]:
        raise ValueError(f"there is no sequence rule {rule!r}")
    column = text or "html"
    held: list[PatternFile] = []  # compiled once a worker

    def each(doc_id: int, content: str | None) -> Iterator[tuple]:
        if not held:
            held.append(load(source, compat, deep))
        flat = flat_text(content or "", parameters) if text else flatten(parse(content or ""), parameters)
        openers = held[0].openers(rule)
        for k, (start, end) in enumerate(sentence_spans(flat.plaintext, whole=True)):
            if openers is not None and not any(flat.plaintext.find(w, start, end) >= 0 for w in openers):
                continue
            yield from _match_rows(flat, doc_id, k, held[0].match_sentence(parsed_sentence(flat, start, end), rule))

    return map_rows(docs.select("doc_id", column), each, MATCHES)


def _match_rows(flat: Flat, doc_id: int, sent: int, found: list[Match]) -> Iterator[tuple]:
    index, above = 0, []
    for depth, m in (x for top in found for x in top.flat()):
        above = above[:depth]
        start, end = (m.start, m.end) if m.kind == "text" else flat.spans.get(m.node_id, (None, None))
        shown = None if start is None else flat.plaintext[start:end]
        yield (doc_id, sent, index, depth, above[-1] if above else None, m.kind, m.name, m.tags, start, end, m.node_id, shown, serialize(flat, start, end) if start is not None else None)
        above.append(index)
        index += 1
