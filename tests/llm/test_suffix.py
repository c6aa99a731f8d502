import hashlib
import random
from itertools import groupby

import numpy as np

from scriptorium.llm import suffix

from .conftest import DOCS, words


def brute(rows):
    """rows of (key, text), each against smaller keys and itself; rows of one key don't count
    for each other."""
    seen, out = set(), []
    for key, group in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        new = set()
        for _, text in group:
            data, own = (text or "").encode(), set()
            gone = bytearray(len(data))
            for i in range(len(data) - suffix.DEPTH + 1):
                w = data[i : i + suffix.DEPTH]
                if w in seen or w in own:
                    gone[i : i + suffix.DEPTH] = b"\1" * suffix.DEPTH
                own.add(w)
            new |= own
            kept = bytes(b for b, g in zip(data, gone) if not g)
            spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        seen |= new
    return sorted(out)


def got(df):
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def run(docs):
    found = suffix.with_runs(docs, suffix.Tables(docs.sparkSession)).mapInArrow(suffix._digest_rows, suffix.RESULT)
    return found.select(suffix.own_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def rows_of(df):
    return [(-(2**63) if r.doc_id is None else r.doc_id, r.text) for r in df.collect()]


def test_radix_passes_leave_exactly_the_repeated_windows():
    """Digit by digit against a dictionary of windows, over texts whose windows differ in any one byte."""
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 100, 160).astype(np.uint8))
    texts = [base, base, *(base[:i] + b"Z" + base[i + 1 :] for i in range(0, 160, 3)), b"ab" * 120]
    data = b"".join(texts)
    at, group = [], []
    for k, t in enumerate(texts):
        start = sum(map(len, texts[:k]))
        at += range(start, start + len(t) - suffix.DEPTH + 1)
    group = [a % 2 for a in at]
    lanes = np.ndarray((len(data) - 7,), ">u8", np.frombuffer(data, np.uint8), strides=(1,))
    member, label = suffix.radix_groups(lanes, np.array(at), np.array(group))
    want = {}
    for i, (a, g) in enumerate(zip(at, group)):
        want.setdefault((g, data[a : a + suffix.DEPTH]), []).append(i)
    found = {}
    for i, g in zip(member.tolist(), label.tolist()):
        found.setdefault(g, []).append(i)
    assert sorted(map(sorted, found.values())) == sorted(v for v in want.values() if len(v) > 1)
    # Groups come in the order of their bytes.
    shown = [(group[i], data[at[i] : at[i] + suffix.DEPTH]) for i in member.tolist()]
    assert shown == sorted(shown)


def test_hot_anchors_are_dealt_out(spark, tiny, monkeypatch):
    """With every anchor hot, and with every window ordered, the same bytes go."""
    want = got(suffix.op7(spark, tiny))
    monkeypatch.setattr(suffix, "TOGETHER", 0)
    assert got(suffix.op7(spark, tiny)) == want


def test_awkward_rows(awkward, clashing):
    awkward = awkward.where("doc_id is null or doc_id not in (7, 8)").union(awkward.where("doc_id = 7").selectExpr("doc_id", "substr(text, 1, 40000)", "lang", "source", "n_chars"))
    assert got(run(awkward)) == brute(rows_of(awkward))
    assert got(run(clashing.where("doc_id < 7"))) == brute(rows_of(clashing.where("doc_id < 7")))


def test_empty(empty):
    assert run(empty).collect() == []


def test_driver_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert got(suffix.op7(spark, tiny)) == brute(rows_of(docs))


def test_overlaps_periods_and_shifted_passages(spark):
    rng = random.Random(2)
    passages = [words(rng, 30) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(1, 40)) + rng.choice(["", " é"])]
        for p in rng.sample(passages, 3):
            cut = rng.randrange(0, 30)
            parts += [p[cut:], words(rng, rng.randrange(0, 20))]
        rows.append((rng.randrange(40), " ".join(parts), None, None, None))
    rows += [(100, "ab" * 300, None, None, None), (101, "a" * 99, None, None, None), (102, "a" * 100, None, None, None), (103, "a" * 250, None, None, None)]
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(run(docs)) == brute([r[:2] for r in rows])


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(6)
    for key in (None, 7):
        z, y = words(rng, 60, 100_000), words(rng, 120, 100_000)
        docs = spark.createDataFrame([(k, t, None, None, None) for k, t in ((key, f"{z} {z}"), (key, y), (key, y), (900, z))], DOCS).repartition(3)
        out = got(run(docs))
        assert out == brute(rows_of(docs))
        assert [r[2] for r in out if r[1] == len(y)] == [0, 0]
