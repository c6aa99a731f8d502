"""The pipeline stage by stage, each on its own input, against the brute-force versions."""

import pytest

import corpus_pipeline
from scriptorium.llm import components, toxicity
from scriptorium.llm.common import Tables

from . import test_decontaminate, test_lines, test_mixing, test_similar


@pytest.fixture(scope="module")
def inputs(spark, tiny):
    """The input of each stage, and the result."""
    tables, out = Tables(spark), [spark.read.parquet(f"{tiny}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(tables.write(stage(spark, out[-1], tiny)))
    return out


def test_toxicity(spark, tiny, inputs):
    toxic = {r.doc_id for r in toxicity.op9(spark, tiny).where("predicted = 1").collect()}
    assert toxic and {r.doc_id for r in inputs[1].collect()} == {r.doc_id for r in inputs[0].collect()} - toxic


def test_lines_stage(inputs):
    want = test_lines.brute(test_lines.rows_of(inputs[1]))
    assert sorted((r.doc_id, str(r.text)) for r in inputs[2].collect()) == [(w[0], w[3]) for w in want]


def test_near_dedup(inputs):
    want = test_similar.brute([(r.doc_id, r.text) for r in inputs[2].collect()])
    assert sorted(r.doc_id for r in inputs[3].collect()) == want


def test_decontaminate_stage(spark, tiny, inputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in inputs[3].collect()]
    bad = {w[0] for w in test_decontaminate.brute(docs, items)}
    assert {str(r.doc_id) for r in inputs[4].collect()} == {str(k) for k, _ in docs} - bad


def test_mixing_stage(inputs):
    test_mixing.held(inputs[4].collect(), inputs[5].collect(), 0.02)


def test_columns_and_run(spark, tiny, inputs):
    for t in inputs[1:-1]:
        assert t.columns == inputs[0].columns
    assert sorted(map(str, corpus_pipeline.run(spark, tiny).collect())) == sorted(map(str, inputs[-1].collect()))


def test_components(spark):
    from .conftest import components as brute

    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (-7, 2000), (2000, -7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    found = {r.node: r.component for r in components.connected_components(df, Tables(spark)).collect()}
    want = brute({x for p in links for x in p}, links)
    assert found == {k: v for k, v in want.items() if k != v}
