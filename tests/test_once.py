"""What is dear is computed once a row, and training runs on all cores."""

import pyspark.ml.feature
import pytest
from pyspark.sql import functions as F

from scriptorium.plans import programs, registry


@pytest.mark.parametrize("name", ["token_model", "lifted_token_model", "document_text"])
def test_words_are_cut_once(spark, tiny, name):
    plan = registry.QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_statement_lexemes_are_made_once(spark, tiny):
    plan = registry.QUERIES["statement_paragraphs"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("octet_length(lambda") <= 10 and plan.count("sha2(") == 1


def test_vectors_are_trained_in_parts(spark, monkeypatch):
    seen, fit = [], pyspark.ml.feature.Word2Vec._fit
    monkeypatch.setattr(pyspark.ml.feature.Word2Vec, "_fit", lambda self, rows: seen.append(self.getNumPartitions()) or fit(self, rows))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"))
    vectors = [r.vector for r in programs.document_vectors(docs, size=4).collect()]
    assert seen[0] >= spark.sparkContext.defaultParallelism
    assert len(vectors) == 40 and all(abs(x) < 10 for v in vectors for x in v) and any(x for x in vectors[0])
