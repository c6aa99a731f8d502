import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm import toxicity

from .conftest import DOCS


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    """On labels that training never sees."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op9(spark, folder).where("held_out").join(labels, "doc_id").toPandas()
    y = rows["toxic"].to_numpy()
    assert auc(rows["score"].to_numpy(), y) > 0.95
    caught = rows["predicted"][rows["toxic"] == 1].mean()
    wrong = rows["predicted"][rows["toxic"] == 0].mean()
    assert caught > 0.75 and wrong < 0.03


def test_labels_of_held_out_rows_do_not_matter(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit_model(docs, labels), toxicity.fit_model(docs, other)
    assert (one.weight == two.weight).all() and one.bias == two.bias


def test_held_out_rows(spark, tiny):
    for r in toxicity.op9(spark, tiny).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_misspellings_share_grams():
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["river", "market", "garden", "window", "paper", "stone"]) for _ in range(40)) for _ in range(300)]
    toxic = [t + " " + rng.choice(["blorgface", "snarkwit"]) * 1 for t in clean]
    y = np.r_[np.zeros(300, int), np.ones(300, int)]
    model = toxicity.train(clean + toxic, y)
    a, b = model.scores(pa.array(["river market garden blorgfaces", "river market garden window"]))
    assert a > b


def test_pieces_of_long_texts_add_up(monkeypatch):
    rng = np.random.default_rng(2)
    weight = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    texts = pa.array(["alpha beta " * 500, None, "", "x", "é" * 700, "gamma " * 90])
    one = toxicity.window_sums(texts, weight)
    monkeypatch.setattr(toxicity, "BLOCK", 97)
    two = toxicity.window_sums(texts, weight)
    assert (one[1] == two[1]).all() and (one[2] == two[2]).all() and np.allclose(one[0], two[0])


def test_vectors_are_learned_together():
    """Vectors span more than one direction, and the trained part of them tells the classes apart."""
    rng = np.random.default_rng(3)
    windows = [np.unique(rng.integers(0, 500, 60)) for _ in range(200)]
    y = np.array([float((w < 25).sum() > 3) for w in windows])
    layers = toxicity.train_layers(windows, y, rng)
    assert np.linalg.matrix_rank(layers.vectors) == toxicity.DIM
    weight = layers.weight()
    logit = np.array([weight[w].sum() / (len(w) + toxicity.PRIOR) for w in windows]) + layers.bias
    assert auc(logit, y) > 0.95


def test_windows_cover_every_gram():
    """Windows part a text's grams without loss, whatever its words' lengths; long words too."""
    rng = random.Random(4)
    for _ in range(30):
        text = " ".join("x" * rng.choice([1, 3, 9, 200]) for _ in range(rng.randrange(40)))
        total, count, of = toxicity.window_sums(pa.array([text]), np.ones(toxicity.BUCKETS, np.float32))
        data, end = toxicity._stream(pa.array([text]))
        grams = sum(len(b) for _, b in toxicity._hashes(data))
        assert count.sum() == grams == total.sum() and (of == 0).all()
        ends, _ = toxicity.window_ends(data, end)
        assert ends[-1] == len(data) and (np.diff(ends) > 0).all()


def test_one_insult_in_a_long_text_counts():
    rng = random.Random(5)
    plain = lambda n: " ".join(rng.choice(["river", "market", "garden", "window", "paper", "stone"]) for _ in range(n))
    texts = [plain(40) for _ in range(200)] + [f"{plain(20)} snarkwit {plain(20)}" for _ in range(200)]
    model = toxicity.train(texts, np.r_[np.zeros(200, int), np.ones(200, int)])
    a, b, c = model.scores(pa.array([f"{plain(3000)} snarkwit {plain(3000)}", plain(6000), ""]))
    assert a >= toxicity.THRESHOLD > b and c < toxicity.THRESHOLD


def test_awkward(spark, awkward, clashing, empty, tiny):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit_model(awkward, labels)
    out = toxicity.score(clashing, model)
    assert out.count() == clashing.count() and toxicity.score(empty, model).collect() == []
    assert out.where("score is null").count() == 0
    assert toxicity.fit_model(empty, labels).scores(pa.array(["a"]))[0] == 0
    assert toxicity.fit_model(awkward, labels.limit(0)).scores(pa.array([None], pa.string()))[0] == 0
    kept = toxicity.toxicity_stage(spark, clashing, tiny)
    assert kept.columns == clashing.columns and kept.select("score").distinct().collect()[0][0] == 4


def test_repeated_rows_score_alike(spark, tiny):
    docs = spark.createDataFrame([(1, "some text", "en", "a", 9)] * 3, DOCS)
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = toxicity.fit_model(spark.read.parquet(f"{tiny}/documents.parquet"), labels)
    assert len({r.score for r in toxicity.score(docs, model).collect()}) == 1
