import random
import re

import numpy as np
import pytest

from scriptorium.llm import decontaminate

from .conftest import DOCS, words


def shingles(text, n=None):
    """Of n words; of an item (no n) of five, or of all its words if they are fewer."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    n = n or min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(docs, items):
    sets = [(k, shingles(t)) for k, t in items]
    out = []
    for k, t in docs:
        grams = {n: shingles(t, n) for n in range(1, 6)}
        for item, s in sets:
            own = grams[len(next(iter(s)))] if s else set()
            if s and 5 * len(s & own) >= 4 * len(s):
                out.append((str(k), item, len(s & own), len(s)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.item_id, r.n_shared, r.n_shingles) for r in df.collect())


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.choice([1, 3, 4, 5, 6, 12, 40]))) for i in range(40)] + [(99, None), (98, "")]
    rows = []
    for i in range(80):
        text = words(rng, rng.randrange(0, 400))
        if i % 3 == 0:
            w = rng.choice(items)[1]
            if w:
                w = w.split()
                if i % 2:
                    w[rng.randrange(len(w))] = "changed"
                text += " " + " ".join(w).upper() + ", " + words(rng, 50)
        rows.append((i, text, None, None, None))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")


def test_planted(planted, monkeypatch):
    docs, items = planted
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and got(decontaminate.contained(docs, items)) == want
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 60)  # several blocks
    assert got(decontaminate.contained(docs, items)) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)  # the longer ones are joined
    assert got(decontaminate.contained(docs, items)) == want
    kept = {str(r.doc_id) for r in decontaminate.clean(docs, items).collect()}
    assert kept == {str(i) for i in range(80)} - {w[0] for w in want}


def test_driver_table(spark, tiny):
    docs, items = (spark.read.parquet(f"{tiny}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert got(decontaminate.op8(spark, tiny)) == brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])


def test_awkward(spark, awkward, clashing, empty, planted):
    items = awkward.where("doc_id in (1, 7) or doc_id is null").selectExpr("doc_id as item_id", "text")
    want = brute([(r.doc_id, r.text) for r in awkward.collect()], [(r.item_id, r.text) for r in items.collect() if r.item_id is not None])
    assert got(decontaminate.contained(awkward, items)) == want
    assert decontaminate.contained(empty, items).collect() == [] and decontaminate.contained(awkward, items.limit(0)).collect() == []
    out = decontaminate.clean(clashing, items)
    assert out.columns == clashing.columns
    # Items without an id leak too: both rows without an id equal one.
    assert out.where("doc_id is null").collect() == []


def test_candidates_come_from_the_sketches(planted, monkeypatch):
    """Without the sketches nothing is found, and a sketch of the largest hashes serves as well."""
    docs, items = planted
    own = [(i, *decontaminate.shingles_of(t.encode())) for i, t in ((r.item_id, r.text or "") for r in items.collect())]
    own = [x for x in own if len(x[1])]
    texts = [(r.text or "").encode() for r in docs.collect()]
    want = sorted(decontaminate.Block(own).leaks(texts))
    monkeypatch.setattr(decontaminate, "sketch", lambda s: s[len(s) - (len(s) - int(decontaminate.needed(np.array(len(s)))) + 1) :])
    assert want and sorted(decontaminate.Block(own).leaks(texts)) == want
    monkeypatch.setattr(decontaminate, "sketch", lambda s: s[:0] if len(s) > 1 else s)
    assert {x[3] for x in decontaminate.Block(own).leaks(texts)} <= {1}


def test_short_documents_pass_over_large_items():
    """A size class is searched only by documents with shingles enough for its smallest item."""
    rng = random.Random(5)
    item = words(rng, 70)
    c = decontaminate.SizeClass([(1, decontaminate.shingles_of(item.encode())[0])])
    h = decontaminate.shingles_of(" ".join(item.split()[:40]).encode())[0]
    doc = np.zeros(len(h), np.int64)
    assert len(c.candidates(doc, h, np.array([len(h)]))) == 0 < len(c.candidates(doc, h, np.array([c.least])))
