"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is read in windows of about WINDOW bytes that end between words. A window is the bag
of the byte n-grams (sizes GRAMS) of its words, boundaries included, so a misspelling that
was never seen shares most vectors with what was. Each n-gram hashes to one of BUCKETS
vectors; a window's vector is the average of its bag, weighted by smooth inverse frequency
and drawn to the clean texts' average by PRIOR grams, so that very short windows count as
clean, and a linear softmax tells the classes apart. A text is as toxic as its worst window, so one insult in a long text is not averaged
away.

Training. Vectors start at random, softmax and vectors are trained together by gradient
descent with momentum. Labels are of texts, not of windows: of a toxic text the window that
scores highest is an example, of a clean text that one and two others; ROUNDS of choosing
and training start from the n-grams that are surely more frequent in toxic texts. This is done FOLDS
times, each without a part of the sample, and the vectors' weights are averaged. The logits of the
texts left out set the scale: a Platt scaling over the worst window's logit and the logarithm of
the number of windows, shifted so that THRESHOLD lies where the share of toxic texts
missed and CLEAN_COST times the share of clean texts caught are least in sum.

The sample is at most SAMPLE labelled texts of each class, taken by a hash of the id, and of
each at most TEXT_WINDOWS windows, taken by a hash over its whole length: the only bounds
here, for training alone. Scoring reads every whole text.

As softmax and average are linear, executors need one weight a bucket (1 MB, of fixed size).

Nulls are empty texts; empty texts score as a clean window. Rows are scored one by one, so
repeats repeat their score and a null doc_id stays null (held_out false). Null labels are not
used; of several labels of one doc_id the largest counts, of several texts the smallest.
Without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, documents, put_back, set_aside

GRAMS = (3, 4, 5, 6)
BUCKETS, DIM = 1 << 18, 8
WINDOW, PRIOR = 64, 60
SAMPLE, TEXT_WINDOWS = 1250, 256
FOLDS, ROUNDS, STEPS, MOMENTUM, COMMON = 3, 2, 60, 0.9, 3e-4
START = 2e-4 / DIM
#: Standard errors by which a gram is more frequent in toxic texts to choose the first windows.
SURELY = 2.5
THRESHOLD, CLEAN_COST = 0.7, 2.0
#: Bytes that are hashed at once.
BLOCK = 1 << 20


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _hashes(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram the places in ``data`` and their buckets. A gram is within one
    word; the space before or after it may be its first or last byte."""
    space = _SPACE[data]
    value = np.where(space, 32, data).astype(np.uint32) + np.uint32(1)
    gaps = np.r_[0, np.cumsum(space)]
    h = value[: len(data)].copy()
    done = 1
    for size in GRAMS:
        n = len(data) - size + 1
        if n <= 0:
            return
        h = h[:n]
        while done < size:
            h = h * np.uint32(0x01000193) ^ value[done : done + n]
            done += 1
        # No space but at the ends.
        at = np.flatnonzero(gaps[size - 1 : size - 1 + n] == gaps[1 : 1 + n])
        x = h[at] + np.uint32(size * 0x9E37)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        yield at, (x & np.uint32(BUCKETS - 1)).astype(np.int32)


def _stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts as one run of bytes, each between spaces, and their ends."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    joined = [t.as_py() for t in low]
    size = np.fromiter((len(t) + 2 for t in joined), np.int64, len(joined))
    # Two spaces between texts: no gram spans two of them.
    return np.frombuffer(b"".join(b" " + t + b" " for t in joined), np.uint8), np.cumsum(size)


def window_ends(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of each text end, and each window's text: every WINDOW bytes or at the next space."""
    first = np.r_[0, end[:-1]]
    n = -(-(end - first) // WINDOW)
    of = np.repeat(np.arange(len(end)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    space = np.flatnonzero(_SPACE[data])
    start = first[of] + step * WINDOW
    start = np.where(step == 0, start, space[np.minimum(np.searchsorted(space, start), len(space) - 1)])
    # A word longer than a window ends several; the space that closes a text starts none.
    keep = (step == 0) | ((start < end[of] - 1) & (start != np.r_[-1, start[:-1]]))
    start, of = start[keep], of[keep]
    return np.r_[start[1:], len(data)], of


def window_sums(texts: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each text the sum of its grams' weights, their number, and its text."""
    data, end = _stream(texts)
    end, of = window_ends(data, end)
    total, count = np.zeros(len(end)), np.zeros(len(end), np.int64)
    reach = max(GRAMS) - 1
    for at in range(0, len(data), BLOCK):
        piece = data[at : at + BLOCK + reach]
        for place, bucket in _hashes(piece):
            own = place < BLOCK  # later ones belong to the next piece
            place, bucket = place[own] + at, bucket[own]
            first, last = np.searchsorted(end, [at, at + BLOCK - 1], side="right")
            cut = np.searchsorted(place, np.r_[0, end[first : last + 1]])
            run = np.r_[0.0, np.cumsum(weight[bucket], dtype=np.float64)]
            got = np.diff(run[cut])
            total[first : first + len(got)] += got
            count[first : first + len(got)] += np.diff(cut)
    return total, count, of


def worst_windows(texts: pa.Array, weight: np.ndarray, clean: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text the highest logit of a window, without the bias, and its windows' number.
    ``clean`` is what PRIOR grams of every window weigh each."""
    total, count, of = window_sums(texts, weight)
    if not len(of):
        return np.zeros(0), np.zeros(0)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return np.maximum.reduceat((total + PRIOR * clean) / (count + PRIOR), first), np.diff(np.r_[first, len(of)]).astype(np.float64)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, float32, scaled
    bias: float
    length: float = 0.0  # of the logarithm of the number of windows
    clean: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        worst, n = worst_windows(texts, self.weight, self.clean)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(worst + self.length * np.log(np.maximum(n, 1)) + self.bias)))


def _grams(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *(b for _, b in _hashes(data))])


def _surely_toxic(texts: list[str], y: np.ndarray) -> np.ndarray:
    """A weight for each bucket that is surely in a larger share of the toxic texts, else 0."""
    share = np.zeros((2, BUCKETS))
    for t, k in zip(texts, y.tolist()):
        share[k][np.unique(_grams(_stream(pa.array([t]))[0]))] += 1
    n = np.array([max(1, (y == k).sum()) for k in (0, 1)])
    both = (share.sum(0) + 1) / (n.sum() + 2)
    far = (share[1] / n[1] - share[0] / n[0]) / np.sqrt(both * (1 - both) * (1 / n).sum())
    odds = np.log((share[1] + 0.5) / (n[1] + 1)) - np.log((share[0] + 0.5) / (n[0] + 1))
    return np.where(far > SURELY, odds, 0).astype(np.float32)


@dataclass
class Layers:
    ids: np.ndarray  # buckets that training met
    vectors: np.ndarray  # of each of them
    soft: np.ndarray  # class 1 less class 0
    rare: np.ndarray  # inverse frequency of each
    bias: float
    clean: float  # the clean windows' average weight of a gram

    def weight(self) -> np.ndarray:
        """Of each bucket; those that training never met say nothing."""
        out = np.zeros(BUCKETS, np.float32)
        out[self.ids] = (self.vectors @ self.soft) * self.rare
        return out


def train_layers(windows: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Layers:
    """Vectors and softmax of the windows' grams, trained together from a random start."""
    size = np.array([len(w) for w in windows])
    r = np.repeat(np.arange(len(windows)), size)
    ids, c = np.unique(np.concatenate(windows), return_inverse=True)
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    v = 1 / (size + PRIOR)[r]
    # Smooth inverse frequency: common grams count less in the average.
    rare = 1 / (np.bincount(c, v * each[r], len(ids)) + COMMON)
    v = (v * rare[c]).astype(np.float32)
    vectors = rng.uniform(-START, START, (len(ids), DIM))
    soft = rng.normal(size=DIM)
    soft /= np.sqrt((soft * soft).sum())
    bias, moved = 0.0, [0.0, 0.0, 0.0]
    rate = 4 / max(1e-9, np.bincount(r, v * v, len(windows)).mean())
    for _ in range(STEPS):
        logit = np.bincount(r, (vectors @ soft)[c] * v, len(windows)) + bias
        slope = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) * each
        by_gram = np.bincount(c, slope[r] * v, len(ids))
        grads = (by_gram[:, None] * soft, by_gram @ vectors / max(1, len(ids)), slope.sum())
        moved = [MOMENTUM * m - rate * g for m, g in zip(moved, grads)]
        vectors, soft, bias = vectors + moved[0], soft + moved[1], bias + moved[2]
    fine = np.flatnonzero(y[r] == 0)
    clean = (vectors @ soft * rare)[c[fine]].mean() if len(fine) else 0.0
    return Layers(ids, vectors, soft, rare, bias, float(clean))


def fit_layers(texts: list[str], y: np.ndarray, rng: np.random.Generator) -> Layers:
    """The layers from labels of texts, which say nothing of their windows."""
    weight, clean = _surely_toxic(texts, y), 0.0
    for _ in range(ROUNDS):
        windows, known = [], []
        for t, k in zip(texts, y.tolist()):
            column = pa.array([t])
            data, end = _stream(column)
            end, _ = window_ends(data, end)
            total, count, _ = window_sums(column, weight)
            chosen = {int(np.argmax((total + PRIOR * clean) / (count + PRIOR)))}
            chosen |= set() if k else set(rng.integers(0, len(end), 2).tolist())
            start = np.r_[0, end[:-1]]
            windows += [_grams(data[start[i] : end[i] + 1]) for i in sorted(chosen)]
            known += [k] * len(chosen)
        layers = train_layers(windows, np.array(known, np.float64), rng)
        weight, clean = layers.weight(), layers.clean
    return layers


def train(texts: list[str], labels: np.ndarray, seed: int = 0) -> Model:
    y = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    fold = np.zeros(len(y), np.int64)
    for k in (0, 1):  # each class is dealt out evenly
        own = rng.permutation(np.flatnonzero(y == k))
        fold[own] = np.arange(len(own)) % FOLDS
    weight, bias, clean = np.zeros(BUCKETS, np.float64), 0.0, 0.0
    logit, n = np.zeros(len(y)), np.ones(len(y))
    for f in range(FOLDS):
        own, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(set(y[own].tolist())) < 2:
            own = np.arange(len(y))
        layers = fit_layers([texts[i] for i in own], y[own], rng)
        weight, bias, clean = weight + layers.weight() / FOLDS, bias + layers.bias / FOLDS, clean + layers.clean / FOLDS
        for i in range(0, len(out), 256):  # some texts at a time
            part = out[i : i + 256]
            worst, n[part] = worst_windows(pa.array([texts[j] for j in part], pa.string()), layers.weight(), layers.clean)
            logit[part] = worst + layers.bias
    a, length, shift = _scaled(logit, np.log(n), y)
    return Model((weight * a).astype(np.float32), float(a * bias + shift), float(length), float(a * clean))


def _scaled(logit: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Factors of logit and length and a shift, so that THRESHOLD is where the errors cost least.

    Platt scaling with classes of equal weight; a longer text never counts as more toxic for its length."""
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    m, s = logit.mean(), logit.std() + 1e-9
    fit = [1.0, 0.0, 0.0]
    for used in ((0, 1, 2), (0, 2)):
        x, p = np.c_[(logit - m) / s, length, np.ones(len(y))][:, used], np.eye(len(used))[0]
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(x @ p, -50, 50)))
            h = (x * (w * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(len(used))
            p = p - np.clip(np.linalg.solve(h, x.T @ (w * (q - target)) + 1e-4 * p * (np.array(used) < 2)), -1, 1)
        fit = [p[0], p[1] if len(used) > 2 else 0.0, p[-1]]
        if fit[1] <= 0:
            break
    a, b = max(fit[0], 1e-3) / s, fit[1]
    x = a * logit + b * length
    order = np.argsort(x, kind="stable")
    missed, caught = np.r_[0, np.cumsum(y[order])] / n1, 1 - np.r_[0, np.cumsum(1 - y[order])] / n0
    cost = missed + CLEAN_COST * caught
    cost[1:-1][x[order][1:] == x[order][:-1]] = np.inf  # equal values are not parted
    best = np.flatnonzero(cost == cost.min())
    edges = np.r_[x[order][0] - 1, x[order], x[order][-1] + 1]
    at = (edges[best[0]] + edges[best[-1] + 1]) / 2
    return a, b, np.log(THRESHOLD / (1 - THRESHOLD)) - at


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cut to TEXT_WINDOWS of their windows at most."""
    for b in batches:
        texts = []
        for t in b.column("text").to_pylist():
            data, end = _stream(pa.array([t or ""]))
            end, _ = window_ends(data, end)
            if len(end) > TEXT_WINDOWS:
                start = np.r_[0, end[:-1]]
                take = np.sort(np.random.default_rng(len(data)).permutation(len(end))[:TEXT_WINDOWS])
                data = np.concatenate([data[start[i] : end[i]] for i in take])
            texts.append(data.tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(texts, pa.string())], ["doc_id", "toxic", "text"])


def fit_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labelled documents that are not held out."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    by_hash = F.xxhash64(F.lit(9), "doc_id")
    chosen = known.where("toxic = 1").orderBy(by_hash, "doc_id").limit(SAMPLE).union(known.where("toxic = 0").orderBy(by_hash, "doc_id").limit(SAMPLE))
    # At most 2 * SAMPLE ids: safe to broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_sampled, "doc_id long, toxic int, text string")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id", kind="stable")
    y = sample["toxic"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -np.inf)
    return train(sample["text"].tolist(), y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (any columns) with ``score`` and ``predicted``, which replace columns of these names."""
    out, names = _scored(docs.drop("score", "predicted"), model)
    return out.select(*put_back(names), "score", "predicted")


def _scored(docs: DataFrame, model: Model) -> tuple[DataFrame, dict[str, str]]:
    spark = docs.sparkSession
    arrow_limits(spark, 4)
    shared = spark.sparkContext.broadcast((model.weight, model.bias, model.length, model.clean))
    plain, renamed = set_aside(docs)
    names = list(renamed.values())
    kinds = ", ".join(f"{n} {plain.schema[n].dataType.simpleString()}" for n in names)
    plain = plain.withColumn("_text", F.col(renamed["text"]).cast("string"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Model(*shared.value)
        for b in batches:
            s = use.scores(b.column("_text"))
            cols = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    return plain.mapInArrow(each, f"{kinds}, score double, predicted int"), renamed


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # Only the id and the text reach the scorer.
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that are predicted toxic. Rows are judged one by one: null and empty
    texts score as clean windows, repeated rows stay or go together, null ids stay null, and an
    empty table stays empty. Columns, extra ones included, are as they came."""
    model = fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, names = _scored(docs, model)
    return out.where("predicted = 0").select(*put_back(names))
