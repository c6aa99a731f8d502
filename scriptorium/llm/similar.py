"""Near-duplicate documents by MinHash banding, verified by exact shingle Jaccard.

Documents are similar from 0.8 on, by the distinct 5-word shingles of their whole texts.
Candidates are the groups of the SimHash trie join (``simhash``, over 5-word shingles) and, as
64-bit majorities differ in some ten bits at 0.8 and a budget wide enough for them would also
admit a share of all pairs, the bands of ``paragraphs``: a pair of similarity 0.8 shares none
of those once in 5,000 times. A group counts as one more band.

Documents of the same words are one class; those of fewer than five words are alike only if
they are the same but for case and white space, as are texts without a word. Bands with the same
members are compared once, and large ones in blocks of some BLOCK_SHINGLES shingles a side.

Nulls and empty texts are alike. A document is known by doc_id and text; rows of one id (or
none) and different texts are documents of their own. A null doc_id counts as the smallest.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow_limits, keyed
from .components import connected_components
from .decontaminate import WORDS, U, _parts, shingle_hashes
from .paragraphs import BANDS, _keys, _runs, _sequence_hash, _texts, _verified, _words, band_keys
from .simhash import fingerprint, near_links

BLOCK_SHINGLES = 1 << 20


def _classes(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of some texts their class, and of those with a shingle their index, first word and words; all their words."""
    from xxhash import xxh64_intdigest

    h, of, _, _ = _words(texts)
    first = _runs(of)
    size = np.diff(np.r_[first, len(h)])
    first, size = first[size >= WORDS], size[size >= WORDS]
    long = of[first]
    classes = np.zeros(len(texts), U)
    classes[long] = _sequence_hash(h, first, size)
    for i in np.setdiff1d(np.arange(len(texts)), long).tolist():
        classes[i] = xxh64_intdigest(b" ".join(texts[i].lower().split()), 9)
    return classes, long, first, size, h


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k, texts = _keys(b), _texts(b)
        for part, start in _parts(texts):
            classes, long, first, size, h = _classes(part)
            n = np.zeros(len(part), np.int32)
            n[long] = size
            at = np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(at), pa.array(band_keys(h, first, size).ravel().view(np.int64)))
            fp = np.array([fingerprint(t, WORDS) for t in part], U).view(np.int64)
            own = [pa.array(x[start : start + len(part)]) for x in k]
            yield pa.RecordBatch.from_arrays([*own, pa.array(classes.view(np.int64)), pa.array(n), bands, pa.array(fp)], ["_k", "_x", "h", "n", "bands", "fp"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted distinct shingles of documents of a wanted class (list column of classes)."""
    for b in batches:
        texts = _texts(b)
        want = b.column("want").to_pylist()
        for part, start in _parts(texts):
            classes, long, first, size, h = _classes(part)
            own = classes.view(np.int64).tolist()
            take = [(own[i], a, n) for i, a, n in zip(long.tolist(), first.tolist(), size.tolist()) if own[i] in want[start + i]]
            sets = [np.unique(shingle_hashes(h[a : a + n])).view(np.int64) for _, a, n in take]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in take], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["h", "shingles"])


def similar_documents(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(_k, _x, kept) for each row of docs (doc_id, text)."""
    tables = tables or Tables(docs.sparkSession)
    arrow_limits(docs.sparkSession, 4)
    texts = keyed(docs, F.col("text").cast("string").alias("text"))
    units = tables.write(texts.mapInArrow(_document_rows, "_k long, _x long, h long, n int, bands array<long>, fp long"))
    classes = tables.write(units.groupBy("h").agg(F.min(F.struct("_k", "_x")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")))
    # Groups of the trie join, named by their smallest fingerprint, are bands as well.
    prints = tables.write(classes.where("n > 0").select("fp").distinct())
    near = connected_components(near_links(prints, tables), tables)
    trie = classes.where("n > 0").join(near, classes.fp == near.node, "left")
    bands = classes.select("h", "n", F.explode("bands").alias("band")).union(trie.select("h", "n", F.xxhash64(F.lit(10), F.coalesce("component", "fp"))))
    bands = tables.write(bands)
    members = bands.groupBy("band").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("h")).alias("x"), F.sum("n").alias("all"))
    shared = tables.write(members.where("h0 <> h1").groupBy("h0", "h1", "m", "x").agg(F.min("band").alias("band"), F.first("all").alias("all")).select("band", "all"))
    met = tables.write(bands.join(shared, "band").select("band", "h", "all"))
    want = met.select("h").distinct().join(classes, "h").groupBy("rep._k", "rep._x").agg(F.collect_set("h").alias("want"))
    sets = tables.write(texts.join(want, ["_k", "_x"]).mapInArrow(_set_rows, "h long, shingles array<long>").dropDuplicates(["h"]))
    # Large bands are cut in parts; each pair of parts is a block.
    parts = F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), "h"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    rows = met.select("band", "h", own.alias("own"), other.alias("other")).select(
        "band", "h", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    rows = rows.join(sets, "h").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    links = tables.write(rows.mapInArrow(_verified, "a long, b long"))
    found = connected_components(links, tables)
    named = tables.write(classes.join(found, classes.h == found.node, "left").select("h", "rep", F.coalesce("component", "h").alias("part")))
    first = tables.write(named.groupBy("part").agg(F.min("rep").alias("first")))
    named = tables.write(named.join(first, "part").select("h", "first"))
    return units.join(named, "h").select("_k", "_x", (F.struct("_k", "_x") == F.col("first")).alias("kept"))
