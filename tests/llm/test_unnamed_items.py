import random

from scriptorium.llm import decontaminate

from .conftest import DOCS, words


def test_items_without_an_id_leak_too(spark):
    rng = random.Random(2)
    item = words(rng, 30)
    docs = spark.createDataFrame([(1, f"{words(rng, 20)} {item}", None, None, None), (2, words(rng, 50), None, None, None)], DOCS)
    items = spark.createDataFrame([(None, item), (3, None)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]
    assert decontaminate.contained(docs, items).collect() == []
