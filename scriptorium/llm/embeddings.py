"""Near-duplicate vectors: spherical k-means cells and blocked cosine products within them.

Vectors of equal components are one class. The centroids are fit on at most SAMPLE classes
(taken by a hash, an even sample); every class is indexed. A class lies in the cell of its
nearest centroid and is compared with all of the nearest cells, PROBES of them and two more each time
the cells beyond that double, so links across a border are found too: with no more than PROBES
cells the search is exhaustive, and beyond that tests hold recall against brute force. ``exact``
compares a class with every cell that may hold a link instead: one whose widest member is no
farther from the centroid than the class is, less the angle of COSINE. A cell is cut into blocks of at most
BLOCK rows on either side, so that no task grows with a hot cell, and a block leaves only
the counts of its rows and a spanning forest of its links, never its pairs.

Cosines are double precision, of vectors scaled by their largest component first. Vectors
that are null, empty, zero or hold null or non-finite components link with nothing, and
vectors of different lengths never link. Repeated rows are vectors of their own, linked to
each other. A null vec_id counts as the smallest id and is returned as null. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Tables, arrow_limits
from .components import connected_components
from .simhash import forest

COSINE = 0.9
SAMPLE, CELL_ROWS, MOST_CELLS, PROBES = 16_384, 1024, 16_384, 8
#: Bytes of all centroids, which are broadcast.
CENTROID_BYTES = 64 << 20
BLOCK = 2048
KMEANS_ROUNDS = 10


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as unit rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1))


def fit_cells(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids of unit rows x by spherical k-means."""
    rng = np.random.default_rng(0)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(KMEANS_ROUNDS if k > 1 else 1):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        total = np.zeros_like(c)
        total[near[order][at]] = np.add.reduceat(x[order], at, axis=0)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def probes(cells: int) -> int:
    return min(cells, PROBES + 2 * max(0, int(np.ceil(np.log2(max(1, cells) / PROBES)))))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The cells of the nearest centroids, the nearest first."""
    m = probes(len(c))
    out = np.zeros((len(x), m), np.int32)
    for i in range(0, len(x), 1024):
        near = x[i : i + 1024] @ c.T
        top = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(m), (len(near), 1))
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        out[i : i + 1024, :m] = np.take_along_axis(top, order, 1)
    return out


def _model(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by length of the vectors."""
    out = {}
    for row in classes.groupBy(F.size("v").alias("d")).count().collect():
        k = max(1, min(-(-row["count"] // CELL_ROWS), MOST_CELLS, SAMPLE, CENTROID_BYTES // (8 * row.d)))
        some = classes.where(F.size("v") == row.d).orderBy(F.xxhash64("v"), "rep").select("v").limit(SAMPLE)
        x = np.array([r.v for r in some.toLocalIterator()], np.float64)
        out[row.d] = fit_cells(unit(x), int(k))
    return out


def within_reach(x: np.ndarray, c: np.ndarray, widest: np.ndarray) -> list[np.ndarray]:
    """For each row its own cell and all others that may hold a link; ``widest``: the angle of
    each cell's farthest member."""
    out = []
    for i in range(0, len(x), 1024):
        near = x[i : i + 1024] @ c.T
        own = near.argmax(1)
        near = np.arccos(np.clip(near, -1, 1)) <= widest + np.arccos(COSINE) + 1e-6
        near[np.arange(len(near)), own] = False
        out += [np.r_[a, np.flatnonzero(row)].astype(np.int32) for a, row in zip(own, near)]
    return out


def _widths(shared):
    """(d, cell, angle): of each row the angle to its cell's centroid, the widest of a batch."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                x, c = matrix(b.column("v").take(pa.array(np.flatnonzero(size == d)))), shared.value[d]
                near = np.concatenate([np.c_[(p := x[i : i + 1024] @ c.T).argmax(1), p.max(1)] for i in range(0, len(x), 1024)])
                angle = np.full(len(c), -1.0)
                np.maximum.at(angle, near[:, 0].astype(int), np.arccos(np.clip(near[:, 1], -1, 1)))
                cells = np.flatnonzero(angle >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), d, np.int32)), pa.array(cells.astype(np.int32)), pa.array(angle[cells])], ["d", "cell", "angle"])

    return each


def _widest(rows: DataFrame, model: dict[int, np.ndarray], shared) -> dict[int, np.ndarray]:
    """The widest angle of each cell: a number for each centroid."""
    out = {d: np.full(len(c), -np.inf) for d, c in model.items()}
    for r in rows.mapInArrow(_widths(shared), "d int, cell int, angle double").groupBy("d", "cell").agg(F.max("angle").alias("angle")).toLocalIterator():
        out[r.d][r.cell] = r.angle
    return out


def _assign(shared, widest=None):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            cells = [None] * len(size)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                x = matrix(b.column("v").take(pa.array(rows)))
                found = within_reach(x, shared.value[d], widest.value[d]) if widest else nearest(x, shared.value[d])
                for r, own in zip(rows.tolist(), found):
                    cells[r] = own
            flat = pa.array(cells, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "n", "v")), flat], ["rep", "n", "v", "cells"])

    return each


def _compare(group: pa.Table) -> pa.Table:
    """Counts (a, n) and links (a, b) of one block: queries (ask) against stored vectors."""
    group = group.combine_chunks()
    ask = group.column("ask").to_numpy(zero_copy_only=False).astype(bool)
    rep, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
    if not len(rep) or ask.all() or not ask.any():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    x = matrix(group.column("v").chunk(0))
    cells = group.column("cells").chunk(0)
    times = cells.value_lengths().to_numpy(zero_copy_only=False)
    cells = cells.flatten().to_numpy()
    home = cells[np.cumsum(times) - times]
    # Rows and the cells that they ask, as one number each.
    wide = int(cells.max()) + 1
    asking = np.sort(np.repeat(np.arange(len(rep)), times) * wide + cells)
    q, s = np.flatnonzero(ask), np.flatnonzero(~ask)
    ids, node = np.unique(rep, return_inverse=True)  # a class may be query and stored
    count, links = np.zeros(len(ids), np.int64), []
    for at in range(0, len(q), 512):
        own = q[at : at + 512]
        i, j = np.nonzero(x[own] @ x[s].T >= COSINE)
        i, j = own[i], s[j]
        other = rep[i] != rep[j]
        i, j = i[other], j[other]
        np.add.at(count, node[i], n[j])
        # The stored side counts the pair here only if it won't ask for it itself.
        both = j * wide + home[i]
        once = asking[np.minimum(np.searchsorted(asking, both), len(asking) - 1)] != both
        np.add.at(count, node[j[once]], n[i[once]])
        root = forest(len(ids), iter([(node[i], node[j])]))
        tied = np.flatnonzero(root != np.arange(len(ids)))
        links.append((tied, root[tied]))
    root = forest(len(ids), iter(links))
    tied, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(count)
    a, b = np.r_[ids[tied], ids[some]], np.r_[ids[root[tied]], ids[some]]
    return pa.table({"a": pa.array(a), "b": pa.array(b), "n": pa.array(np.r_[np.zeros(len(tied), np.int64), count[some]])})


def near_duplicates(vectors: DataFrame, tables: Tables | None = None, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors (vec_id, embedding); ``exact``: no link is missed."""
    spark = vectors.sparkSession
    tables = tables or Tables(spark)
    arrow_limits(spark)
    v = F.col("embedding")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("_k"), F.when(fine, v).alias("v"))
    valid = rows.where("v is not null")
    classes = tables.write(valid.groupBy("v").agg(F.min("_k").alias("rep"), F.count("*").alias("n")))
    model = _model(classes)
    shared = spark.sparkContext.broadcast(model)
    doubles = classes.select("rep", "n", F.col("v").cast("array<double>").alias("v"))
    widest = spark.sparkContext.broadcast(_widest(doubles, model, shared)) if exact else None
    placed = tables.write(doubles.mapInArrow(_assign(shared, widest), "rep long, n long, v array<double>, cells array<int>"))
    # Rows that each cell stores and that ask it: two numbers a cell, of at most MOST_CELLS each length.
    size = F.size("v").alias("d")
    asked = placed.select(size, F.explode("cells").alias("cell")).groupBy("d", "cell").agg(F.count("*").alias("q"))
    stored = placed.select(size, F.element_at("cells", 1).alias("cell")).groupBy("d", "cell").agg(F.count("*").alias("s"))
    parts = asked.join(stored, ["d", "cell"]).select(
        "d", "cell", F.ceil(F.col("q") / BLOCK).cast("int").alias("nq"), F.ceil(F.col("s") / BLOCK).cast("int").alias("ns")
    )
    parts = F.broadcast(tables.write(parts))  # as bounded as the centroids
    row = F.xxhash64(F.lit(3), "rep")
    asks = placed.select("rep", "n", "v", "cells", size, F.explode("cells").alias("cell")).join(parts, ["d", "cell"]).select(
        "rep", "n", "v", "cells", "d", "cell", F.lit(True).alias("ask"), F.pmod(row, F.col("nq")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("j")
    )
    stores = placed.select("rep", "n", "v", "cells", size, F.element_at("cells", 1).alias("cell")).join(parts, ["d", "cell"]).select(
        "rep", "n", "v", "cells", "d", "cell", F.lit(False).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("i"), F.pmod(row, F.col("ns")).cast("int").alias("j")
    )
    found = tables.write(asks.unionByName(stores).groupBy("d", "cell", "i", "j").applyInArrow(_compare, "a long, b long, n long"))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("links"))
    groups = connected_components(found.where("n = 0").select("a", "b"), tables)
    named = tables.write(
        classes.join(counts, classes.rep == counts.a, "left").join(groups, classes.rep == groups.node, "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    out = valid.join(named, "v").select("_k", "n_links", "c")
    out = out.union(rows.where("v is null").select("_k", F.lit(0).cast("long"), "_k"))
    whole = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(whole("_k").alias("vec_id"), "n_links", whole("c").alias("component_id"), (F.col("_k") == F.col("c")).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN links ON r = a
), part AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN part USING (vec_id) LEFT JOIN counts ON a = e.vec_id
"""
