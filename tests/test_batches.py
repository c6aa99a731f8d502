"""Python passes read and make batches of bounded size, and build each tree once."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import batches
from scriptorium.functions.segment import sentence_rows, sentence_spans, sentences
from scriptorium.functions.tagger import tag, tags
from scriptorium.operators.dnm import LATEXML, flatten, serialize
from scriptorium.operators.select import items
from scriptorium.plans import programs, registry
from scriptorium.sources.dom import parse
from scriptorium.sources.readers import read_corpus

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def passes(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(f"{k} ") for k in ("MapInArrow", "MapInPandas", "ArrowEvalPython"))


def test_made_batches_are_bounded(spark):
    docs = spark.range(3, numPartitions=1).select("id", F.lit("x" * 10).alias("text"))
    rows = batches.map_rows(docs, lambda i, text: ((i, k) for k in range(batches.MADE_ROWS + 1)), "id long, k int")
    assert rows.groupBy("id").agg(F.count("*").alias("n"), F.max("k").alias("k")).orderBy("id").collect() == [(i, batches.MADE_ROWS + 1, batches.MADE_ROWS) for i in range(3)]


@pytest.mark.parametrize("name", ["article_parts", "article_surroundings", "range_pointers", "canonical_paragraphs", "plain_texts", "sentence_counts", "sentence_lengths", "md5_c14n", "attr_catalog", "pattern_spans"])
def test_read_batches_are_bounded(spark, tiny, name):
    spark.conf.unset(LIMIT)
    registry.QUERIES[name](spark, tiny)
    assert int(spark.conf.get(LIMIT)) == batches.READ_BYTES


@pytest.mark.parametrize("name", ["article_parts", "article_paths", "pos_tag_counts", "word_report", "made_sentences", "sentence_lengths"])
def test_one_python_pass(spark, tiny, name):
    assert passes(registry.QUERIES[name](spark, tiny)) == 1


def test_ids_stay_exact_beside_null(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "<p>a.</p>"), (None, "<p>b</p>")], "doc_id long, html string").coalesce(1)
    assert {r.doc_id for r in items(docs, "generic_paragraph").collect()} == {big, None}
    assert {r.doc_id for r in sentence_rows(docs, "html", "doc_id").collect()} == {big, None}


def test_way_back_is_made_out_on_demand():
    root = parse("<html><body><p>Ünder <cite>1</cite> œ x</p><p>a</p><p>b</p></body></html>")
    flat = flatten(root, LATEXML)
    assert flat.plaintext == "Under  CitationElement  oe xab" and not flat._known
    at = flat.plaintext.index("oe")
    assert flat.origin(at)[1] == flat.origin(at + 1)[1] == 1 and len(flat._known) == 1
    assert len(flat.back) == len(flat.plaintext)
    assert serialize(flat, len(flat.plaintext) - 1, len(flat.plaintext)) == "arange(string-index(/html[1]/body[1]/p[3]/text()[1],1),/)"


def test_sentences_of_a_column(spark):
    text = "A first one. The second mathformula Third? no"
    row = spark.createDataFrame([(text,), (None,)], "t string").select("t", sentences("t").alias("s")).collect()
    assert [[(x.start, x.end) for x in r.s] for r in row] == [sentence_spans(text), []]
    assert tags(text) == [pos for _, pos, _, _ in tag(text)]


def test_report_counts_in_one_pass(spark):
    found = spark.createDataFrame([("One two. The two",), ("...",), (None,)], "plaintext string")
    assert programs.word_report(found).collect() == [(3, 2, 4, 3)]
    assert programs.word_report(found.where("false")).collect() == [(0, 0, 0, 0)]


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.html").write_text(f"<p>{i}</p>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        docs = read_corpus(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert {r.html for r in docs.collect()} == {f"<p>{i}</p>" for i in range(60)} and docs.select("path").distinct().count() == 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
