"""A small part-of-speech tagger and phrase chunker.

An approximation by a lexicon and word endings, in Penn tags; any function of the same form
takes its place where a trained one is at hand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

LEXICON = {
    w: pos
    for pos, listed in {
        "DT": "a an the this that these those some any every each no all both",
        "IN": "of in on at by for with from to as into over under between if because since while although than whether via",
        "CC": "and or but nor",
        "PRP": "i we you he she it they them us him",
        "PRP$": "my our your his her its their",
        "MD": "can could may might must shall should will would",
        "VBZ": "is has does denotes holds",
        "VBP": "are have do am",
        "VBD": "was were had did",
        "VB": "be let denote assume suppose consider",
        "VBN": "been given called",
        "RB": "not then thus hence also very only here there where",
        "WDT": "which",
        "WP": "who what whom",
        "EX": "there",
    }.items()
    for w in listed.split()
}
#: Endings in the order in which they are tried.
ENDINGS = (("ing", "VBG"), ("ed", "VBN"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("ical", "JJ"), ("ness", "NN"), ("ss", "NN"), ("s", "NNS"))
_TOKEN = re.compile(r"['’](?:t|s|un|th|ll|d|ve|il|re|m)(?!\w)|[^\W_]+|[^\w\s]|_")


@dataclass
class Phrase:
    label: str
    start: int
    end: int  # the last word
    children: list[Phrase] = field(default_factory=list)


@lru_cache(1 << 16)
def pos_of(word: str, first: bool = False) -> str:
    low = word.lower()
    if low in LEXICON:
        return LEXICON[low]
    if word[0].isdigit():
        return "CD"
    if not word[0].isalnum():
        return "POS" if len(word) > 1 else word
    if word[0].isupper() and not first:
        return "NNP"
    return next((pos for end, pos in ENDINGS if low.endswith(end) and len(low) > len(end) + 2), "NN")


def tag(text: str) -> list[tuple[str, str, int, int]]:
    """(word, tag, start, end) of a sentence's words and punctuation."""
    return [(w := m[0], pos_of(w, i == 0), *m.span()) for i, m in enumerate(_TOKEN.finditer(text))]


def tags(text: str) -> list[str]:
    """The tags of a sentence's words and punctuation alone."""
    return [pos_of(w, i == 0) for i, w in enumerate(_TOKEN.findall(text))]


NOUN = ("NN", "NNS", "NNP", "CD", "PRP")


def chunks(tags: list[str]) -> Phrase | None:
    """S over flat NP, VP and PP chunks; a PP holds the NP after its preposition, and an NP that
    a PP with "of" may follow is nested in one that holds both."""
    top, i = Phrase("S", 0, max(0, len(tags) - 1)), 0

    def noun(at: int) -> Phrase | None:
        k = at
        while k < len(tags) and tags[k] in ("DT", "PRP$", "JJ", "VBN", "VBG", *NOUN):
            k += 1
        while k > at and tags[k - 1] not in NOUN:
            k -= 1
        return Phrase("NP", at, k - 1) if k > at else None

    while i < len(tags):
        node = noun(i)
        if node is not None and node.end + 1 < len(tags) and tags[node.end + 1] == "IN" and (inner := noun(node.end + 2)):
            node = Phrase("NP", i, inner.end, [node, Phrase("PP", node.end + 1, inner.end, [inner])])
        elif node is None and tags[i] == "IN" and (inner := noun(i + 1)):
            node = Phrase("PP", i, inner.end, [inner])
        elif node is None and tags[i].startswith(("VB", "MD")):
            k = i
            while k + 1 < len(tags) and tags[k + 1].startswith(("VB", "MD", "RB")):
                k += 1
            node = Phrase("VP", i, k)
        if node is not None:
            top.children.append(node)
            i = node.end + 1
        else:
            i += 1
    return top if tags else None
