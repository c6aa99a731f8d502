from scriptorium.operators.patterns import load_file
from scriptorium.plans import declarations, sql_functions

HTML = (
    "<html><body><div class='ltx_para'><p>Let <math><semantics><mi>x</mi></semantics></math> be a tile of the plane. "
    "It holds for all <math><mrow><mi>y</mi><mo>∈</mo><mi>A</mi></mrow></math> here. Nothing <math><mn>1</mn></math> else.</p></div></body></html>"
)


def test_declarations(spark):
    docs = spark.createDataFrame([(1, HTML), (2, None)], "doc_id long, html string")
    rows = declarations.declarations(docs).orderBy("sent_seq", "match_seq").collect()
    shown = [(r.name, " ".join((r.text or "").split())) for r in rows]
    assert shown[0] == ("declaration", "Let mathformula be a tile of the plane")
    assert [n for n, _ in shown] == ["declaration", "formula", "identifier", "kind", "declaration", "formula", "restriction", "identifier"]
    assert ("kind", "a tile of the plane") in shown and shown[4] == ("declaration", "for all mathformula")
    assert rows[2].kind == "math" and rows[2].parent_idx == 1 and all(r.pointer for r in rows if r.kind == "text")


def test_lists_and_tags(spark):
    x = lambda *parts: f"<math><mrow>{''.join(parts)}</mrow></math>"
    mi = lambda v: f"<mi>{v}</mi>"
    comma, sub = "<mo>,</mo>", "<msub><mi>x</mi><mn>1</mn></msub>"
    html = (
        f"<html><body><div class='ltx_para'><p>Suppose {x(sub, comma, '<mo>…</mo>', comma, mi('z'))} is a basis of the space. "
        f"There exists {x(mi('y'), '<mo>&lt;</mo>', mi('A'))} in it. For every {x(mi('sin'))} it fails.</p></div></body></html>"
    )
    rows = declarations.declarations(spark.createDataFrame([(1, html)], "doc_id long, html string")).orderBy("sent_seq", "match_seq").collect()
    assert [(r.name, list(r.tags)) for r in rows if r.name == "declaration"] == [("declaration", ["universal"]), ("declaration", ["existential"])]
    assert [r.name for r in rows].count("identifier") == 3 and [r.name for r in rows].count("restriction") == 1


def test_files(tmp_path):
    (tmp_path / "p.xml").write_text(declarations.SOURCE, encoding="utf-8")
    assert "declaration" in load_file(str(tmp_path / "p.xml")).rules["seq"]


def test_sql(spark, tiny):
    sql_functions.register_tables(spark, tiny)
    sql_functions.register_functions(spark)
    spark.createDataFrame([(1, HTML)], "doc_id long, html string").createOrReplaceTempView("papers")
    row = spark.sql("select word_tokenize(html) as w, size(sentence_spans(flat_text(html))) as n from papers").first()
    assert row.n == 3 and row.w.split("\n")[0] == "let mathformula be a tile of the plane"
    assert spark.sql("select count(*) as n from documents where size(sentence_spans(text)) > 1").first().n > 0


def test_markers_for_reading(spark, tmp_path):
    from scriptorium.sources import sinks

    found = declarations.declarations(spark.createDataFrame([(1, HTML)], "doc_id long, html string"))
    rows = {r.sent_seq: r.html for r in sinks.match_sections(found).collect()}
    assert len(rows) == 2 and "declaration {'universal'}" in rows[0] and rows[0].index("declaration") < rows[0].index("kind {}")
    sinks.write_matches(found, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 2 and all(x.startswith("<section>") for x in lines)


def test_markers_before_a_last_long_number(spark, tmp_path):
    """A last sentence that ends in a long number counts as SQL counts it."""
    import duckdb

    from scriptorium.plans import registry

    rows = [(1, "it is one of two a. 4225571210290012"), (2, "of of. +1 (846) 555-8663"), (3, "a of b. Then of c"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["declaration_markers"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, found)) == sorted(con.execute(registry.ORACLES["declaration_markers"]).fetchall())
