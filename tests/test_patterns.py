import pytest

from scriptorium.functions.tagger import Phrase, chunks, tag
from scriptorium.operators.patterns import Parsed, PatternFile, Word, match_documents, phrase_ends
from scriptorium.plans.registry import PATTERNS
from scriptorium.sources.dom import parse_html


def wrap(body, kind="seq"):
    return f'<p><{kind}_rule name="r">{body}</{kind}_rule></p>'


def sentence(words, tree=None, nodes=None):
    out, at = [], 0
    for i, w in enumerate(words):
        text, _, pos = w.partition("/")
        out.append(Word(text, pos or "NN", at, at + len(text), (nodes or {}).get(i)))
        at += len(text) + 1
    return Parsed(out, tree or Phrase("S", 0, len(out) - 1))


def found(body, s, **kw):
    return [(m.name, m.start, m.end) for m in PatternFile(wrap(body), **kw).match_sentence(s, "r")]


W = "<seq_word><word>{}</word></seq_word>"
M = '<seq_marker name="m">{}</seq_marker>'


def test_words_and_sequences():
    s = sentence(["the", "red", "tile", "red"])
    assert found(M.format(W.format("red")), s) == [("m", 4, 7), ("m", 13, 16)]
    assert found(M.format(f"<seq_seq>{W.format('red')}{W.format('tile')}</seq_seq>"), s) == [("m", 4, 12)]
    assert found(W.format("red"), s) == []  # without a marker there is nothing to report
    assert found('<seq_word><word_marker name="w" tags="a, b"><word_or><word>the</word><word>tile</word></word_or></word_marker></seq_word>', s) == [("w", 0, 3), ("w", 8, 12)]


def test_word_not():
    s = sentence(["a", "b"])
    body = M.format("<seq_word><word_not><word>a</word></word_not></seq_word>")
    assert found(body, s) == [("m", 2, 3)] and found(body, s, compat=True) == [("m", 0, 1)]


def test_alternatives():
    s = sentence(["x", "y", "z"])
    xy = f"<seq_seq>{W.format('x')}{W.format('y')}</seq_seq>"
    for kind, want in (("first", [("m", 0, 1)]), ("longest", [("m", 0, 3)]), ("atleastone", [("m", 0, 3)])):
        assert found(M.format(f'<seq_or match_type="{kind}">{W.format("x")}{xy}</seq_or>'), s) == want
    optional = f'<seq_seq><seq_or match_type="any">{W.format("x")}</seq_or>{W.format("y")}</seq_seq>'
    assert found(M.format(optional), s) == [("m", 0, 3), ("m", 2, 3)]
    assert found(M.format(f'<seq_or match_type="any">{W.format("q")}</seq_or>'), s) == [("m", 0, 0), ("m", 2, 2), ("m", 4, 4)]


def test_pos_and_refs():
    source = """<p><pos_rule name="n"><pos_not><pos_or><pos tag="DT"/><pos tag="VB"/></pos_or></pos_not></pos_rule>
      <word_rule name="w"><word_pos><pos_ref ref="n"/><word_any/></word_pos></word_rule>
      <seq_rule name="r"><seq_ref ref="later"/></seq_rule>
      <seq_rule name="later"><meta><description> a  noun </description></meta><seq_marker name="m"><seq_word><word_ref ref="w"/></seq_word></seq_marker></seq_rule></p>"""
    pf = PatternFile(source)
    assert [m.start for m in pf.match_sentence(sentence(["the/DT", "tile/NN", "be/VB"]), "r")] == [4]
    assert pf.descriptions["seq", "later"] == "a noun"


def test_phrases():
    inner = Phrase("NP", 0, 1)
    tree = Phrase("S", 0, 4, [Phrase("NP", 0, 3, [inner, Phrase("PP", 2, 3)]), Phrase("VP", 4, 4)])
    assert phrase_ends(tree, 0, "NP") == [2, 4] and phrase_ends(tree, 2, "PP") == [4] and phrase_ends(tree, 1, "NP") == []
    s = sentence(["the", "side", "of", "it", "is"], tree)
    np = '<phrase tag="NP">{}</phrase>'
    assert found(M.format(np.format("")), s) == [("m", 0, 14)]
    assert found(M.format(np.format("<match_type>shortest</match_type>")), s) == [("m", 0, 8)]
    assert found(M.format(np.format(f"<ends_with_seq>{W.format('side')}</ends_with_seq>")), s) == [("m", 0, 8)]
    long = f"<seq_seq>{W.format('the')}{W.format('side')}{W.format('of')}</seq_seq>"
    start = f'<match_type>shortest</match_type><starts_with_seq containment="{{}}">{long}</starts_with_seq>'
    assert found(M.format(np.format(start.format("any"))), s) == [("m", 0, 8)]
    assert found(M.format(np.format(start.format("lessorequal"))), s) == [("m", 0, 14)]


MATH = '<math><semantics><mrow><mi>x</mi><mo>∈</mo><msub><mi>A</mi><mn>1</mn></msub></mrow></semantics></math>'


def math_names(body, **kw):
    source = f"""<p><mtext_rule name="rel"><mtext_or><mtext_lit str="∈"/><mtext_lit str="="/></mtext_or></mtext_rule>
      <mtext_rule name="no"><mtext_not><mtext_ref ref="rel"/></mtext_not></mtext_rule><mtext_rule name="any"><mtext_any/></mtext_rule>
      <seq_rule name="r"><seq_word><word_math>{body}</word_math></seq_word></seq_rule></p>"""
    node = next(n for n in parse_html(MATH).walk() if n.name == "math")
    return [m.name for m in PatternFile(source, **kw).match_sentence(sentence(["mathformula"], nodes={0: node}), "r")]


def test_formulas():
    mi, mo = '<math_marker name="mi"><math_node name="mi"/></math_marker>', '<math_marker name="mo"><math_node name="mo"><mtext_ref ref="{}"/></math_node></math_marker>'
    row = '<math_node name="mrow"><math_children match_type="{}">{}</math_children></math_node>'
    assert math_names(row.format("starts_with", mi)) == ["mi"]
    assert math_names(row.format("exact", mi + mo.format("rel") + "<math_any/>")) == ["mi", "mo"]
    assert math_names(row.format("exact", mi)) == [] and math_names(row.format("ends_with", mi)) == []
    assert math_names(row.format("arbitrary", mo.format("rel"))) == ["mo"] and math_names(row.format("arbitrary", mo.format("no"))) == []
    deep = '<math_descendant match_type="at_least_one">' + mi + "</math_descendant>"
    assert math_names(deep) == ["mi"] and math_names(deep, deep=True) == ["mi", "mi"]
    assert math_names('<math_marker name="all"><math_descendant match_type="arbitrary"><math_node name="q"/></math_descendant></math_marker>') == ["all"]
    assert math_names(f'<math_or><math_node name="q"/>{row.format("starts_with", mi)}</math_or>') == ["mi"]


@pytest.mark.parametrize(
    "source",
    [
        "<p><seq_rule name='r'><seq_ref ref='x'/></seq_rule></p>", "<p><seq_rule><seq_seq/></seq_rule></p>", wrap("<nonsense/>"), wrap("<seq_or match_type='worst'/>"),
        wrap("<seq_word/>"), "<p><what_rule name='r'/></p>", "<p>", wrap("<seq_seq/>") .replace("</p>", "") + "<seq_rule name='r'><seq_seq/></seq_rule></p>", wrap("<phrase/>"), wrap("<seq_seq/><seq_seq/>"),
    ],
)
def test_faults_are_told(source):
    with pytest.raises(ValueError):
        PatternFile(source)


def test_unknown_entry_and_missing_tree():
    pf = PatternFile(wrap(M.format(W.format("x"))))
    with pytest.raises(ValueError):
        pf.match_sentence(sentence(["x"]), "other")
    with pytest.raises(ValueError):
        pf.match_sentence(Parsed([], None), "r")


def test_documents(spark):
    docs = spark.createDataFrame([(1, "We know the side of the tile. Nothing here."), (2, None), (3, "the end of a day")], "doc_id long, text string")
    rows = match_documents(docs, PATTERNS, "of phrase", text="text").orderBy("doc_id", "match_seq").collect()
    assert [(r.doc_id, r.name, r.text) for r in rows] == [(1, "of phrase", "the side of the tile"), (1, "head", "side"), (1, "head", "tile"), (1, "of phrase", "side of the tile"), (1, "head", "side"), (1, "head", "tile")] + [
        (3, "of phrase", "the end of a day"), (3, "head", "end"), (3, "head", "day"), (3, "of phrase", "end of a day"), (3, "head", "end"), (3, "head", "day")
    ]
    assert [r.parent_idx for r in rows[:3]] == [None, 0, 0] and rows[0].tags == ["relation", "noun"]


def test_tagger():
    assert [t[1] for t in tag("The red tiles are nicely cut.")] == ["DT", "NN", "NNS", "VBP", "RB", "NN", "."]
    tree = chunks(["DT", "NN", "IN", "DT", "NN", "VBZ"])
    assert [(c.label, c.start, c.end) for c in tree.children] == [("NP", 0, 4), ("VP", 5, 5)]


def test_openers_of_a_rule():
    """Words that a match can begin with; a rule that may begin with any word has none."""
    from scriptorium.plans import articles, declarations, registry

    assert PatternFile(articles.PATTERNS).openers("place") == {"of", "in"}
    assert {"let", "Let", "for", "there"} <= PatternFile(declarations.SOURCE).openers("declaration")
    assert PatternFile(registry.PATTERNS).openers("of phrase") is None
