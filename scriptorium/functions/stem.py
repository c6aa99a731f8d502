"""An inflectional stemmer: suffix rules after Minnen, Carroll and Pearce (2001), in outline,
with the usual irregular forms. An approximation: it knows no dictionary."""

from __future__ import annotations

import re

IRREGULAR = {
    w: base
    for base, forms in {
        "be": "am is are was were been being", "have": "has had having", "do": "does did done doing", "go": "goes went gone", "see": "saw seen",
        "give": "gave given giving", "take": "took taken taking", "make": "made making", "find": "found", "get": "got gotten getting", "know": "knew known",
        "show": "shown", "write": "wrote written writing", "begin": "began begun beginning", "choose": "chose chosen choosing", "hold": "held", "say": "said",
        "think": "thought", "man": "men", "woman": "women", "child": "children", "foot": "feet", "mouse": "mice", "lemma": "lemmata", "index": "indices",
        "matrix": "matrices", "vertex": "vertices", "axis": "axes", "basis": "bases", "hypothesis": "hypotheses", "analysis": "analyses", "datum": "data", "lie": "lying",
    }.items()
    for w in forms.split()
}
KEEP = frozenset("this thus his its us as has was is always perhaps series species news physics mathematics less unless across bus gas lens plus amazing".split()) - {"has", "was", "is", "amazing"}
_VOWEL = re.compile("[aeiouy]")


def _restored(stem: str) -> str:
    """A stem as its base form: doubled consonants and silent e."""
    if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "aeiouylsz":
        return stem[:-1]
    if re.search(r"(?:[^aeiou][aeiou](?:[kmtvz]|gg)|at|iz|[iu]s|[aeiou]r|v|c|u|[^aeiou]i?l|dg)$", stem) and not re.search(r"(?:er|or|en|et|it|ou.|ea.|oo.|ee.|ai.)$", stem):
        return stem + "e"
    return stem


def stem_word(word: str) -> str:
    """The base form of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word in KEEP or len(word) < 4:
        return word
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if re.search(r"(?:s|x|z|ch|sh)es$", word):
        return word[:-2] if not re.search("(?:[^s]s|z)es$", word) or word.endswith("xes") else word[:-1]
    if word.endswith("s") and not re.search("(?:ss|us|is)$", word):
        return word[:-1]
    if word.endswith("ing") and _VOWEL.search(word[:-3]) and len(word) > 5:
        return _restored(word[:-3])
    if word.endswith("ied") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith("ed") and _VOWEL.search(word[:-2]) and len(word) > 4:
        return _restored(word[:-2])
    return word


def stem_once(text: str) -> str:
    """Every word of a text, lower-cased, in its base form."""
    return re.sub(r"[A-Za-z]+", lambda m: stem_word(m[0].lower()), text)


def stem_words(text: str) -> str:
    """Again until nothing changes."""
    for _ in range(4):
        after = stem_once(text)
        if after == text:
            break
        text = after
    return text
