import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from scriptorium.llm import similar

from .conftest import DOCS, components, words
from .test_paragraphs import shingles

LOW = -(2**63)


def brute(rows):
    """The smallest id of each group by exact 5-word Jaccard; texts without a shingle only if equal."""
    sets = [s or frozenset([" ".join((t or "").lower().split())]) for _, t in rows for s in [shingles(t or "")[1]]]
    links = [(a, b) for (a, s), (b, t) in combinations(enumerate(sets), 2) if len(s & t) >= 0.8 * len(s | t)]
    least = {}
    for i, p in components(range(len(rows)), links).items():
        least[p] = min(least.get(p, rows[i][0]), rows[i][0])
    return sorted(least.values())


def kept(df):
    return sorted(LOW if r.doc_id is None else r.doc_id for r in df.collect())


def near_copies(rng):
    """Texts of 50 to 300 words, each with copies of which every 25th to 100th word is new."""
    rows = []
    for base in range(40):
        text = words(rng, rng.randrange(50, 300), 100_000).split()
        for copy in range(4):
            step = rng.randrange(25, 100)
            rows.append((base + 100 * copy, " ".join(f"new{copy}" if copy and i % step == step // 2 else w for i, w in enumerate(text)), None, None, None))
    return rows


def test_near_copies_leave_the_pipeline(spark, tiny, monkeypatch):
    rows = near_copies(random.Random(4))
    want = brute([r[:2] for r in rows])
    assert 40 <= len(want) < 150
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert kept(corpus_pipeline.near_dedup(spark, docs, tiny)) == want
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", 200)
    assert kept(corpus_pipeline.near_dedup(spark, docs, tiny)) == want


def test_driver_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert kept(corpus_pipeline.near_dedup(spark, docs, tiny)) == want


def test_awkward(spark, awkward, clashing, empty, tiny):
    want = brute([(LOW if r.doc_id is None else r.doc_id, r.text) for r in awkward.collect()])
    out = corpus_pipeline.near_dedup(spark, clashing, tiny)
    assert out.columns == clashing.columns and kept(out) == want and out.where("score <> 4").count() == 0
    assert corpus_pipeline.near_dedup(spark, empty, tiny).collect() == []


def test_rows_of_one_id_stay(spark, tiny):
    """Different texts without an id, or of one id, are documents of their own; equal rows are one."""
    rng = random.Random(11)
    a, b, c = (words(rng, 60, 100_000) for _ in range(3))
    rows = [(None, a, None, None, 1), (None, b, None, None, 1), (7, c, None, None, 1), (7, a, None, None, 1), (8, c + " more", None, None, 1), (None, b, None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, tiny).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("None", a), ("None", b), ("7", c)])


def test_simhash_groups_are_candidates(spark, monkeypatch):
    """Without the bands, the trie join alone still finds nearly equal texts."""
    monkeypatch.setattr(similar, "band_keys", lambda h, first, size: np.arange(len(first) * similar.BANDS, dtype=np.uint64).reshape(-1, similar.BANDS) + np.uint64(int(h[0]) if len(h) else 0))
    rng = random.Random(12)
    base = words(rng, 600, 100_000)
    rows = [(i, base + f" tail{i}", None, None, None) for i in range(6)] + [(50 + i, words(rng, 300, 100_000), None, None, None) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    out = [r._k for r in similar.similar_documents(docs).where("kept").collect()]
    assert len([k for k in out if k < 50]) < 6 and len([k for k in out if k >= 50]) == 6
