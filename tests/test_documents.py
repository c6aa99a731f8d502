import pytest

from scriptorium.sources.dom import parse
from scriptorium.operators import dnm, select
from scriptorium.sources import dom, readers, sinks

PAPER = """<html><head><title>t</title></head><body>
<div class="ltx_abstract"><h6 class="ltx_title">Abstract</h6><p class="ltx_p">We show it.</p><p class="ltx_p">Second.</p></div>
<div class="ltx_keywords">tiles</div>
<section><h2 class="ltx_title ltx_title_section">1 Introduction</h2>
<div class="ltx_para"><p class="ltx_p">Let <math><semantics><mi>x</mi><annotation encoding="application/x-tex">x</annotation><annotation encoding="application/x-lexemes">ATOM:x</annotation></semantics></math> be of <cite class="ltx_cite">[1]</cite> as in <a class="ltx_ref " href="#s">Section 2</a>.</p></div>
<div class="ltx_para ltx_noindent"><p>Outer <span>text</span></p><ul><li><div class="ltx_para">inner</div></li></ul></div></section>
<section><h2 class="ltx_title">2 Proofs<span class="ltx_ERROR">?</span></h2><div class="ltx_theorem ltx_theorem_lem"><h6 class="ltx_title">Lemma 1</h6><div class="ltx_para"><p>All tiles are square by this lemma.</p></div></div>
<div class="ltx_proof"><div class="ltx_para"><p>This proof is very clear to everybody.</p></div></div>
<div class="ltx_para">bad <b class="ltx_ERROR">x</b></div></section>
<figure><figcaption class="ltx_caption">Figure 1: The tiles are shown here.</figcaption></figure>
<div class="ltx_acknowledgement">We thank all of our friends warmly.</div>
<div class="ltx_bibliography"><div>Refs</div></div></body></html>"""


@pytest.fixture(scope="module")
def paper(spark):
    return spark.createDataFrame([(1, PAPER), (2, None), (3, "")], "doc_id long, html string")


def test_flatten_with_rules():
    root = dom.parse_html("<html><body><h1>Title</h1><h2>no</h2> Some text <a href='x'>link</a>  and a bit\n more text.</body></html>")
    p = dnm.with_rules(dnm.DEFAULT, {"h2": dnm.SKIP, "a": "[link]"})
    flat = dnm.flatten(root, p)
    assert flat.plaintext.strip() == "Title Some text [link] and a bit more text."
    a = flat.plaintext.index("bit")
    pointer = dnm.serialize(flat, a, a + 3)
    assert pointer.startswith("arange(string-index(") and dnm.deserialize(flat, pointer) == (a, a + 3)
    assert dnm.deserialize(flat, "nonsense") is None
    end = len(flat.plaintext)
    assert dnm.deserialize(flat, dnm.serialize(flat, a, end)) == (a, end)


def test_class_rules_come_first():
    root = dom.parse_html('<html><body><p class="normalized">Some</p><p class="kept">Else</p></body></html>')
    p = dnm.Parameters(names={"p": dnm.SKIP}, classes={"normalized": "[NORMALIZED]", "kept": dnm.ENTER}, wrap_tokens=True)
    assert dnm.flatten(root, p).plaintext.strip() == "[NORMALIZED] Else"


def test_functions_and_options():
    root = dom.parse_html("<p>Häuser <b>x</b></p>")
    p = dnm.Parameters(names={"b": lambda n: n.content().upper()}, normalize_unicode=True, lowercase=True)
    assert dnm.flatten(root, p).plaintext == "hauser X"
    assert dnm.flat_text("Here is one sentences with multiple words.", dnm.Parameters(stem_once=True, back_mapping=False)).plaintext == "here be one sentence with multiple word."
    assert dnm.Parameters(stem_once=True, stem_full=True).check()
    assert dnm.trim("  ab ", 0, 5) == (2, 4) and dnm.trim("   ", 0, 3) == (3, 3)
    assert dnm.from_byte_offsets("aéb", 1, 3) == (1, 2) and dnm.from_byte_offsets("aéb", 0, 2) == (0, 2)


def test_recovery():
    root = dom.parse_html("<UL><li>one<li>two</ul><p>a<p>b<script>var x='</p>';</script><br>c &amp; d</b></i>")
    names = [n.name for n in root.walk() if not n.is_text]
    assert names.count("li") == 2 and names.count("p") == 2
    assert [n.content() for n in root.walk() if n.name == "li"] == ["one", "two"]
    assert "c & d" in root.content()
    with pytest.raises(ValueError):
        dom.parse_xml("<a><b></a>")
    assert dom.parse("<a xmlns='u'><b/></a>", "x.xhtml").children[0].name == "b"


def test_selectors(paper):
    root = dom.parse_html(PAPER)
    assert [n.content() for n in select.headings(root)] == ["Abstract", "1 Introduction", "Lemma 1"]
    assert len(select.paragraphs(root)) == 5 and len(select.paragraphs(root, outermost=True)) == 4
    assert [k for k, _ in select.extended(root)] == ["abstract", "keywords", *["paragraph"] * 5, "acknowledgement", "caption"]
    assert [n.content() for n in select.references(root)] == ["Section 2"] and select.has_theorems(root)
    assert len(select.maths(root)) == 1 and len(select.filtered(root, lambda n: n.name == "section")) == 2
    assert [n.content() for n in select.by_path(root, "//section/h2[1]")] == ["1 Introduction", "2 Proofs?"]
    assert len(select.by_path(root, "//*[contains(@class,'ltx_para')]")) == 6
    for path in ("//[", "p", "//p[position() < 3]", "//p/text()", "//p[last()]"):
        with pytest.raises(ValueError):
            select.by_path(root, path)
    assert select.xpath_nodes(paper, "//div[@class='ltx_keywords']").first().text == "tiles"
    assert select.nodes(paper).where("doc_id = 1 and name = 'math'").select("subtree_end", "node_id").first().subtree_end > 0


def test_items(paper):
    rows = select.items(paper).where("doc_id = 1").orderBy("item_seq").collect()
    assert " ".join(rows[2].plaintext.split()) == "Let mathformula be of CitationElement as in REF ."
    assert rows[2].math == ["ATOM:x"] and rows[2].prev_name == "h2" and rows[2].prev_heading == "1 Introduction"


def test_canonical(spark):
    root = dom.parse_html('<math class="b a"><semantics><mi>x</mi><annotation>y</annotation></semantics></math>')
    flat = dnm.flatten(root)
    math = select.maths(root)[0]
    assert dnm.canonical(math, flat) == '<math class="a b"><mi>x</mi></math>'
    assert len(dnm.canonical_hash(math, flat)) == 32


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.html").write_text("<p>one</p>")
    (tmp_path / "a" / "b" / "y.xhtml").write_text("<html><p>two</html>")
    (tmp_path / "a" / "z.txt").write_text("no")
    (tmp_path / "a" / ".hidden.html").write_text("no")
    docs = readers.read_corpus(spark, str(tmp_path))
    assert docs.count() == 2 and readers.read_corpus(spark, str(tmp_path), "z.txt").count() == 1
    assert readers.checked(docs).where("_error is not null").count() == 1
    assert readers.checked(docs, "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="not well-formed"):
        readers.checked(docs, "FAILFAST").collect()
    (tmp_path / "model.txt").write_text("a citationelement b\nplain\n")
    assert readers.token_model_lines(spark, str(tmp_path / "model.txt")).count() == 1


def test_texts_and_token_lines(spark):
    docs = spark.createDataFrame([(1, "a < b & c"), (2, None)], "doc_id long, text string")
    got = select.items(readers.from_texts(docs), "paragraph", dnm.DEFAULT).collect()
    assert [r.plaintext for r in got] == ["a < b & c", ""]
    lines = spark.createDataFrame([(1, "we let x_y NUM be\n\nthen it is so\n")], "doc_id long, text string")
    (row,) = select.items(readers.from_token_lines(lines), "paragraph", dnm.DEFAULT).collect()
    assert row.plaintext == "We let mathformula be . Then it is so"


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "word string, frequency long")
    sinks.write_csv(report, str(tmp_path / "csv"), "word")
    rows = spark.read.csv(str(tmp_path / "csv"), header=True).collect()
    assert [r.word for r in rows] == ["c", "a", "b"]
    sinks.write_pairs(report, str(tmp_path / "pairs"), "word")
    assert spark.read.text(str(tmp_path / "pairs")).first().value == "c, 5"
    found = spark.createDataFrame([("proof", "s1", "x\n"), ("proof", "s1", "x\n"), ("lemma", "s2", "y\n")], "label string, sha256 string, text string")
    sinks.write_labelled(found, str(tmp_path / "labelled"))
    assert spark.read.parquet(str(tmp_path / "labelled")).count() == 2
    assert sinks.write_tar(found, str(tmp_path / "x.tar")) == 2
    assert [(r.x, r.log2_y) for r in sinks.log_scatter(report.where("word = 'b'"), "frequency", "frequency").collect()] == [(2, 1.0)]


def test_deep_markup_has_a_canonical_form():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    root = parse(f"<html><body>{deep}</body></html>")
    flat = dnm.flatten(root, dnm.DEFAULT)
    assert dnm.canonical(root, flat).count("<div>") == 5000


def test_readable_formulas():
    root = parse("<math><semantics><mrow class='b a'><mi>x</mi><mo>&lt;</mo></mrow><annotation>tex</annotation></semantics></math>")
    assert dnm.readable(next(n for n in root.walk() if n.name == "math")) == "<math><mrow><mi>x</mi><mo><</mo></mrow></math>"
