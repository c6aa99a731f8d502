import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from scriptorium.llm import simhash
from scriptorium.llm.common import NO_ID

from .conftest import DOCS, components, words


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Rows are the nodes; a group is named by its smallest id."""
    prints = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for (a, f), (b, g) in combinations(enumerate(prints), 2) if (f ^ g).bit_count() <= 2]
    part = components(range(len(rows)), links)
    least = {}
    for i, p in part.items():
        least[p] = min(least.get(p, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], f"{prints[i]:016x}", least[part[i]]) for i in part)


def got(df):
    low = NO_ID
    return sorted((low if r.doc_id is None else r.doc_id, r.fingerprint, low if r.component_id is None else r.component_id) for r in df.collect())


def test_awkward_rows(spark, awkward, clashing):
    rows = [(NO_ID if r.doc_id is None else r.doc_id, r.text) for r in awkward.collect()]
    assert got(simhash.near_duplicates(awkward)) == brute(rows)
    assert got(simhash.near_duplicates(clashing)) == brute(rows)


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_driver_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash.op10(spark, tiny)) == brute(rows)


@pytest.mark.parametrize("bits", [8, 32])
def test_trie_finds_all_pairs(bits):
    rng = np.random.default_rng(bits)
    values = np.unique(rng.integers(0, 1 << min(bits, 12), 300).astype(np.uint64))
    groups = np.zeros(len(values), np.int64)
    found = {(int(i), int(j)) for a, b in simhash.trie_pairs(values, groups, 2, bits) for i, j in zip(a, b)}
    want = {(i, j) for i, j in combinations(range(len(values)), 2) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert found == want


@pytest.mark.parametrize("splits", [((16, 6),), ((4, 4), (16, 9)), ((4, 4), (8, 6), (16, 14))])
def test_large_paths_are_dealt_out(spark, monkeypatch, splits):
    """Many fingerprints below one path link as by brute force."""
    monkeypatch.setattr(simhash, "SPLITS", splits)
    rng = random.Random(3)
    prints = sorted({rng.randrange(1 << 12) << 20 for _ in range(400)})
    classes = spark.createDataFrame([(p,) for p in prints], "fp long")
    tables, place = simhash.Tables(spark), {p: i for i, p in enumerate(prints)}
    links = [(place[r.a], place[r.b]) for r in simhash.near_links(tables.write(classes), tables).collect()]
    want = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert components(range(len(prints)), links) == components(range(len(prints)), want)


def test_rows_of_one_id_are_nodes_of_their_own(spark):
    rng = random.Random(9)
    a, b = words(rng, 80), words(rng, 80)
    docs = spark.createDataFrame([(6, a, None, None, None), (6, b, None, None, None), (2, b, None, None, None), (None, a + " x", None, None, None), (None, words(rng, 50), None, None, None)], DOCS)
    rows = [(NO_ID if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash.near_duplicates(docs)) == brute(rows)


def test_copies_and_near_copies(spark):
    rng = random.Random(5)
    base = words(rng, 400)
    rows = [(i, base if i % 2 else base + " x", None, None, None) for i in range(40)] + [(100 + i, words(rng, 400), None, None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    assert got(simhash.near_duplicates(docs)) == brute([(r[0], r[1]) for r in rows])
