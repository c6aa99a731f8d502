import math
import random

import numpy as np
import pytest

from scriptorium.llm import embeddings

from .conftest import components

LOW = -(2**63)


def brute(rows):
    """rows of (vec_id, vector or None)."""
    fine = []
    for i, (k, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine.append((i, np.array(v, np.float64)))
    count, links = [0] * len(rows), []
    for p, (i, v) in enumerate(fine):
        for j, w in fine[p + 1 :]:
            if len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.9:
                count[i] += 1
                count[j] += 1
                links.append((rows[i][0], rows[j][0]))
    part = components({k for k, _ in rows}, links)
    return sorted((k, n, part[k], part[k] == k) for (k, _), n in zip(rows, count))


def got(df):
    return sorted((LOW if r.vec_id is None else r.vec_id, r.n_links, LOW if r.component_id is None else r.component_id, r.kept) for r in df.collect())


def test_driver_table(spark, tiny):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    assert got(embeddings.op3(spark, tiny)) == brute(rows)


@pytest.fixture
def odd(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]),
        (9, [1.0, 0.1]), (9, [1.0, 0.1]), (None, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1e30, 1e29]), (12, [-1.0, 0.0]), (-3, [0.1, 1.0]),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_odd_vectors(odd):
    rows = [(LOW if r.vec_id is None else r.vec_id, r.embedding) for r in odd.collect()]
    assert got(embeddings.near_duplicates(odd)) == brute(rows)


def test_empty_and_clashing(odd):
    assert embeddings.near_duplicates(odd.limit(0)).collect() == []
    clashing = odd.selectExpr("*", "1 as rep", "2 as v", "3 as n", "4 as _k", "5 as label")
    assert got(embeddings.near_duplicates(clashing)) == got(embeddings.near_duplicates(odd))


def test_many_cells_and_blocks(spark, monkeypatch):
    """With cells, probes and blocks cut small, links are found with a recall of 0.9 or more, none below the cosine."""
    monkeypatch.setattr(embeddings, "CELL_ROWS", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 16))
    x = np.repeat(centers, 20, 0) + rng.normal(size=(1200, 16)) * rng.choice([0.02, 0.25], (1200, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    found = got(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    want = brute(rows)
    assert all(a[1] <= b[1] for a, b in zip(found, want))
    assert sum(a[1] for a in found) >= 0.9 * sum(b[1] for b in want) > 0
    assert sum(a[2] == b[2] for a, b in zip(found, want)) >= 0.9 * len(rows)
    assert got(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), exact=True)) == want


def test_exact_mode_without_clusters(spark, monkeypatch):
    """Uniform directions in few dimensions: every border is crossed by links."""
    monkeypatch.setattr(embeddings, "CELL_ROWS", 20)
    monkeypatch.setattr(embeddings, "probes", lambda cells: 1)
    x = np.random.default_rng(5).normal(size=(900, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    assert got(embeddings.near_duplicates(vectors, exact=True)) == want
    assert sum(r[1] for r in got(embeddings.near_duplicates(vectors))) < sum(r[1] for r in want)


def test_hot_group(spark):
    random.seed(1)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(3000)] + [(5000 + i, [random.gauss(0, 1) for _ in range(3)]) for i in range(50)]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.where("vec_id < 3000 and n_links >= 2999 and component_id = 0").count() == 3000
