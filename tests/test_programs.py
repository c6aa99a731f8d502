import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.lexical import words
from scriptorium.operators import ngrams
from scriptorium.operators.select import items, lifted
from scriptorium.plans import programs, registry
from scriptorium.streaming import catalog

from .test_documents import PAPER

TABLES = "documents pages conversations lineitem".split()


@pytest.fixture(scope="module")
def sql(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_against_sql(spark, tiny, sql, name):
    mine = registry.QUERIES[name](spark, tiny)
    cursor = sql.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    assert sorted(mine.columns) == columns
    index = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted(str([row[i] for i in index]) for row in cursor.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in mine.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, tiny, name):
    assert registry.QUERIES[name](spark, tiny).count() > 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("a b c d A e f g h i", ["c d", "d A", "h i"]), ("a A b A c", ["b A", "A c"]), ("A e", ["A e"]), ("a b c d e", ["c d", "d e"]), ("", []), ("! A ?", [])],
)
def test_anchored_compat(spark, text, want):
    row = spark.createDataFrame([(text,)], "x string").select(ngrams.anchored_ngrams("x", "A", 3, 2).alias("y")).first()
    assert sorted(row.y) == sorted(want)


def test_anchored_window(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("aabbcdA") for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", ngrams.anchored_ngrams("x", "A", 3, 2, "window").alias("y")).orderBy("i").collect()
    for t, r in zip(texts, rows):
        w = t.split()
        near = [any(x == "A" for x in w[max(0, i - 3) : i + 4]) for i in range(len(w))]
        assert r.y == [f"{w[i]} {w[i + 1]}" for i in range(len(w) - 1) if near[i] and near[i + 1]]


def test_dictionary_crosses_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-9000, 30000), i, f"w{rng.randrange(200)}") for i in range(900)] + [(None, 0, "w0")]
    got = {r.word: r.first_index for r in ngrams.dictionary(spark.createDataFrame(rows, "doc_id long, pos int, word string")).collect()}
    order = {}
    for _, _, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        order.setdefault(w, len(order) + 1)
    assert got == order


def test_lifted_markup_agrees_with_lines(spark, tiny):
    docs = registry.documents(spark, tiny).where("text rlike '^[ -~\n]*$'")
    plain = programs.token_model(programs.line_items(docs)).collect()
    through = programs.token_model(items(lifted(docs), "paragraph")).collect()
    assert Counter((r.doc_id, r.text) for r in plain) == Counter((r.doc_id, r.text) for r in through) and plain


@pytest.fixture(scope="module")
def paper(spark):
    return spark.createDataFrame([(1, PAPER)], "doc_id long, html string")


def test_token_model_with_formulas(paper):
    rows = programs.token_model(items(paper)).orderBy("item_seq").collect()
    assert rows[2].text == "let ATOM:x be of citationelement as in ref . "
    plain = programs.token_model(items(paper), True).orderBy("item_seq").collect()
    assert plain[2].text == "let  be of citationelement as in ref . "
    c = programs.token_model_counters(items(paper), paper).first()
    assert (c.document_count, c.paragraph_count, c.formula_count, c.citation_count) == (1, 9, 1, 1)


def test_overflow_counts_what_came_before(spark):
    docs = spark.createDataFrame([(1, "one two 3 " + "x" * 26 + " four"), (2, None), (3, "five")], "doc_id long, text string")
    c = programs.token_model_counters(programs.line_items(docs), docs).first()
    assert (c.document_count, c.paragraph_count, c.word_count, c.num_count, c.overflow_count) == (3, 2, 3, 1, 1)
    assert programs.statement_overflows(programs.line_items(docs)).first().overflow_count == 3


def test_statements(paper):
    found = {(r.label, r.text) for r in programs.statements(items(paper)).collect()}
    labels = {label for label, _ in found}
    assert {"lemma", "proof", "acknowledgement", "caption", "introduction"} <= labels
    assert ("lemma", "all tiles are square by this lemma . \n") in found


def test_headings(paper):
    got = {r.heading: r.frequency for r in programs.heading_stats(items(paper, "heading")).collect()}
    assert got == {"abstract": 1, "introduction": 1, "lemma": 1}


def test_markup_catalogs(spark):
    docs = spark.createDataFrame([(1, '<math id="a" class="x y"><mi>z</mi></math><p class="b a">t</p>'), (2, "<p>u</p>")], "doc_id long, html string")
    got = {r.key: r.frequency for r in programs.attribute_catalog(docs).collect()}
    assert got == {"math": 1, "math@id": 1, "math@class": 1, "math@class[x]": 1, "math@class[y]": 1, "mi": 1}
    assert [r.text for r in programs.node_model(docs).orderBy("doc_id").collect()] == ["html math_x_y p_a_b", "html p"]
    histogram, total = programs.element_histogram(docs, lambda n: n.name == "p")
    assert [(r.elements, r.documents) for r in histogram.collect()] == [(1, 2)] and total.first().total == 2
    forms = programs.canonical_nodes(docs, ("p",)).collect()
    assert len({r.canonical for r in forms}) == len({r.md5 for r in forms}) == 2


def test_words_before_references(spark):
    docs = spark.createDataFrame([(1, '<p>see <a class="ltx_ref">1</a> and See  <a class="ltx_ref">2</a></p>')], "doc_id long, html string")
    for kind in ("reference", "generic_reference"):
        rows = programs.words_before(items(docs, kind)).collect()
        assert [(r.word, r.frequency) for r in rows] == [("see", 2)]


def test_word_report(spark):
    docs = spark.createDataFrame([(1, "One two. Three two.\nfour")], "doc_id long, text string")
    r = programs.word_report(programs.line_items(docs)).first()
    assert (r.paragraphs, r.sentences, r.words, r.distinct_words) == (2, 3, 5, 4)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b w{i}") for i in range(20)], "doc_id long, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    text = catalog.stream_documents(spark, str(tmp_path / "in"), "doc_id long, text string", 2)
    keys = text.select(F.explode(words("text")).alias("key"))
    catalog.run_catalog(keys, "counted", str(tmp_path / "state")).awaitTermination()
    got = {r.key: r.frequency for r in spark.table("counted").collect()}
    assert got["a"] == got["b"] == 20 and len(got) == 22


def test_windowed_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2020-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, 'k' as key from range(0, 180, 10)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = catalog.windowed_catalog(catalog.stream_documents(spark, str(tmp_path / "in"), "ts timestamp, key string"), "ts", "1 hour", "1 hour")
    stream.writeStream.outputMode("update").format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r.frequency for r in spark.table("spans").collect()} == {6}


def test_scan_reads_only_what_it_needs(spark, tiny):
    plan = registry.unigram_counts(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "Python" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["word", "frequency"]


def test_dictionary_of_any_ids(spark):
    """Dense, negative and hashed ids."""
    import random

    from scriptorium.operators import ngrams

    rng = random.Random(4)
    ids = [-(2**63), -5, 0, 1, 2, 70_000, 2**40, 2**63 - 1] + [rng.randrange(-(2**63), 2**63) for _ in range(60)]
    rows = [(i, p, f"w{rng.randrange(300)}") for i in ids for p in range(8)]
    first = {}
    for i, p, w in rows:
        first[w] = min(first.get(w, (i, p)), (i, p))
    got = {r.word: r.first_index for r in ngrams.dictionary(spark.createDataFrame(rows, "doc_id long, pos int, word string")).collect()}
    assert got == {w: k + 1 for k, w in enumerate(sorted(first, key=first.get))}
