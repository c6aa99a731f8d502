"""Sentences of plain text, by a scan with a short memory.

A dot or colon ends a sentence before a capitalised word, unless an abbreviation stands
before it; a stopword always ends it. A blank line ends one before a capital. ``?`` and ``!``
end one unless brackets or quotes enclose them. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .batches import bounded
from .lexical import col
from .tables import ABBREVIATIONS, STOPWORDS

#: Characters that are remembered, bytes of a word that is looked at, pairs that
#: enclose a question mark, characters that open a sentence after a dot.
MEMORY, WORD_BYTES = 11, 20
PAIRS = frozenset(("[]", "()", "{}", "''", '""'))
OPENERS = frozenset('*"(')
FORMULA = "mathformula"
_ENDS = re.compile(r"[.:?!\n]")


def _word_at(text: str, i: int) -> str:
    """Letters from i on, until they reach WORD_BYTES."""
    out, size = [], 0
    for c in takewhile(str.isalpha, (text[k] for k in range(i, len(text)))):
        if size >= WORD_BYTES:
            break
        out.append(c)
        size += len(c.encode())
    return "".join(out)


def _capital_ahead(text: str, i: int) -> bool:
    while i < len(text) and text[i].isalpha():
        if text[i].isupper():
            return True
        i += 1
    return False


def is_abbreviation(before: str) -> bool:
    """Whether the last word of a text is one that a dot belongs to: a letter but I, or a known one."""
    before = before.strip()
    i = len(before)
    while i and before[i - 1].isalpha():
        i -= 1
    word = before[i:]
    return len(word.encode()) == 1 and word != "I" or word in ABBREVIATIONS


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    start += len(part) - len(part.lstrip())
    return (start, start + len(part.strip())) if part.strip() else (end, end)


def sentence_spans(text: str | None, whole: bool = False) -> list[tuple[int, int]]:
    """(start, end) of every sentence. The rules and their order are fixed: they decide the results.

    They drop what stands behind the last end where no letter is among its last MEMORY characters, as
    before a long number; with ``whole`` it stays where it has any letter."""
    text = text or ""
    n, i, start = len(text), 0, 0
    memory = ""  # the last MEMORY characters
    found: list[tuple[int, int]] = []

    def split(at: int) -> None:
        nonlocal start, memory
        memory = ""
        found.append((start, at))
        start = at

    while i < n:
        # Up to the next character that may end a sentence nothing counts but a formula before a capital.
        stop = _ENDS.search(text, i)
        j = stop.start() if stop else n
        if j > i:
            if FORMULA in (seen := memory + text[i:j]):
                for k in range(i, j):
                    if memory == FORMULA and text[k].isupper():
                        split(k)
                    memory = (memory + text[k])[-MEMORY:]
            else:
                memory = seen[-MEMORY:]
            i = j
            continue
        c = text[i]
        i += 1
        if c in ".:":
            while i < n and (text[i].isspace() or text[i] == "'"):
                i += 1
            if i == n:
                break
            word = _word_at(text, i)
            if _capital_ahead(text, i):
                if word.lower() in STOPWORDS:
                    split(i)
                    i += len(word)
                    continue
                if is_abbreviation(memory):
                    memory += "."
                else:
                    split(i)
            elif text[i] in OPENERS:
                split(i)
                continue
            elif c == "." and word:
                if word.lower().startswith(FORMULA) and not is_abbreviation(memory):
                    split(i)
                else:
                    memory += "."
            else:
                memory = (memory + ".")[-MEMORY:]
                continue
            memory = (memory + word)[-MEMORY:]
            i += len(word)
        elif c in "?!":
            if not (memory and i < n and memory[-1] + text[i] in PAIRS):
                split(i)
        elif i < n and text[i] == "\n":
            while i < n and text[i].isspace():
                i += 1
            if i == n:
                break
            word = _word_at(text, i)
            if not word or word.startswith(FORMULA) or word[0].islower():
                memory = (memory + word)[-MEMORY:]
            else:
                split(i)
            i += len(word)
    if any(map(str.isalpha, text[start:i] if whole else memory)):
        found.append((start, i))
    return [(a, b) for a, b in (_trimmed(text, *s) for s in found) if a < b]


SPANS = "array<struct<start:int,end:int>>"


def _spans(text: pa.Array) -> pa.Array:
    at, starts, ends = [0], [], []
    for t in text.to_pylist():
        for a, b in sentence_spans(t):
            starts.append(a)
            ends.append(b)
        at.append(len(starts))
    span = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), span)


def sentences(text: Column | str) -> Column:
    """array of (start, end) of a text's sentences."""
    bounded()
    return F.arrow_udf(_spans, SPANS)(col(text))


def sentence_rows(items: DataFrame, text: str = "plaintext", *keep: str) -> DataFrame:
    """A row (keep..., sent_seq, start, end, text) for each sentence of each item."""
    rows = items.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("sent_seq int, start int, end int, text string").fields])
    shape = to_arrow_schema(schema)
    bounded(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []  # of each sentence the row, its number, start, end and text
            for i, t in enumerate(b.column(len(keep)).to_pylist()):
                made += [(i, k, s, e, t[s:e]) for k, (s, e) in enumerate(sentence_spans(t))]
            if made:
                at, *columns = zip(*made)
                kept = [b.column(i).take(pa.array(at)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, shape.field(len(keep) + i).type) for i, c in enumerate(columns)], schema=shape)

    return rows.mapInArrow(run, schema).toDF(*keep, "sent_seq", "start", "end", "text")
