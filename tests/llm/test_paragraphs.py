import random
import re
from itertools import combinations

import pytest

from scriptorium.llm import paragraphs

from .conftest import DOCS, components, words


def shingles(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """Removed paragraphs as (doc, first word)."""
    units = []
    for key, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            w, s = shingles(line)
            if len(w) >= paragraphs.PARAGRAPH_WORDS:
                units.append((key, at, s))
            at += len(w)
    units = sorted({(u[0], u[1]): u for u in units}.values(), key=lambda u: u[:2])
    links = [(i, j) for (i, a), (j, b) in combinations(enumerate(units), 2) if len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2])]
    part = components(range(len(units)), links)
    return {units[i][:2] for i in part if part[i] != i}


def removed(df, kind):
    return {(r.doc_id, r.first_word) for r in df.where(f"kind = '{kind}' and removed").collect()}


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    bases = [words(rng, rng.randrange(20, 120)).split() for _ in range(12)]
    rows = []
    for i in range(90):
        lines = [words(rng, rng.randrange(0, 60)) for _ in range(3)]
        for _ in range(2):
            w = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            lines.insert(rng.randrange(4), " ".join(w))
        rows.append((i, "\n".join(lines), None, None, None))
    return rows


def test_paragraphs_against_brute_force(spark, planted, monkeypatch):
    want = brute([r[:2] for r in planted])
    docs = spark.createDataFrame(planted, DOCS).repartition(5)
    found = removed(paragraphs.repeats(docs), "paragraph")
    # Bands miss a pair once in 10,000 times; verification adds none.
    assert found <= want and len(found) >= 0.99 * len(want) > 20
    monkeypatch.setattr(paragraphs, "BLOCK", 4)
    assert removed(paragraphs.repeats(docs), "paragraph") == found


def test_passages_inside_paragraphs(spark):
    rng = random.Random(9)
    passage = words(rng, 55, 100_000)
    rows = [(i, words(rng, 150, 100_000) + " " + passage + " " + words(rng, 150, 100_000), None, None, None) for i in range(12)]
    rows += [(50 + i, words(rng, 300, 100_000), None, None, None) for i in range(12)]
    out = paragraphs.repeats(spark.createDataFrame(rows, DOCS)).where("kind = 'passage'").collect()
    assert {r.doc_id for r in out if r.removed} == set(range(1, 12))
    assert {r.group_doc_id for r in out} == {0}


def test_awkward(awkward, clashing, empty):
    for docs in (awkward, clashing):
        out = paragraphs.repeats(docs).collect()
        assert {r.doc_id for r in out} >= {None, 1, 2, 7, 8}
        assert all(r.group_doc_id is None for r in out if r.doc_id in (1, 2, None) and r.kind == "paragraph")
    assert paragraphs.repeats(empty).collect() == []


def test_driver_table(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    want, found = brute(rows), removed(paragraphs.op5(spark, tiny), "paragraph")
    assert found <= want and len(found) >= 0.99 * len(want)


@pytest.mark.parametrize("key", [None, 7])
@pytest.mark.parametrize("first", [True, False])
def test_rows_of_one_id_are_documents_of_their_own(spark, key, first):
    """A second, unrelated text of the same id hides no group, in whatever order the rows come."""
    rng = random.Random(13)
    near = words(rng, 60, 100_000)
    rows = [(key, near, None, None, None), (8, near.replace(near.split()[30], "changed"), None, None, None)]
    rows.insert(0 if first else 1, (key, words(rng, 60, 100_000), None, None, None))
    out = paragraphs.repeats(spark.createDataFrame(rows, DOCS).coalesce(1)).where("kind = 'paragraph'").collect()
    assert sorted((str(r.doc_id), r.removed) for r in out) == sorted([(str(key), False), ("8", True)])


def test_passages_within_one_document_and_at_its_ends(spark):
    rng = random.Random(14)
    passage = words(rng, 60, 100_000)
    rows = [(1, f"{passage} {words(rng, 80, 100_000)} {passage} {words(rng, 50, 100_000)}", None, None, None), (2, words(rng, 90, 100_000), None, None, None)]
    out = paragraphs.repeats(spark.createDataFrame(rows, DOCS)).where("kind = 'passage' and removed").collect()
    assert {r.doc_id for r in out} == {1} and sum(r.n_words for r in out) >= 30 and min(r.first_word for r in out) >= 140
