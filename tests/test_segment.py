import pytest

from scriptorium.functions import segment


def cut(text):
    return [text[a:b] for a, b in segment.sentence_spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One ends. Two begins here.", ["One ends.", "Two begins here."]),
        ("Prof. Smith came. He left.", ["Prof. Smith came.", "He left."]),
        ("by J. Smith in town", ["by J. Smith in town"]),
        ("So did I. Nobody saw.", ["So did I.", "Nobody saw."]),
        ("See Fig. The picture shows.", ["See Fig.", "The picture shows."]),  # a stopword always splits
        ("Take Fig. Seven now", ["Take Fig. Seven now"]),
        ("the law vMF. vMF is known", ["the law vMF.", "vMF is known"]),
        ("a list: First item", ["a list:", "First item"]),
        ("a list: first item", ["a list: first item"]),
        ("Is it so? Yes it is! Good", ["Is it so?", "Yes it is!", "Good"]),
        ("Unknown [?] stays", ["Unknown [?] stays"]),
        ("Head line\n\nNew paragraph here", ["Head line\n\n", "New paragraph here"]),
        ("head line\n\ngoes on", ["head line\n\ngoes on"]),
        ("One line\nNext line", ["One line\nNext line"]),
        ("It ends. (Indeed so)", ["It ends.", "(Indeed so)"]),
        ("It holds. mathformula is zero", ["It holds.", "mathformula is zero"]),
        ("at version 1.5 of it", ["at version 1.5 of it"]),
        ("He said so. 'Twas late", ["He said so. '", "Twas late"]),  # the quote belongs to the sentence that ends
        ("mathformula\nThen it ends", ["mathformula", "Then it ends"]),
        ("...", []),
        ("", []),
        (None, []),
        ("Über alles. Ärger kommt. Ω", ["Über alles.", "Ärger kommt.", "Ω"]),
    ],
)
def test_rules(text, want):
    assert cut(text) == [w.strip() for w in want]


def test_a_stopword_alone_at_the_end_is_dropped():
    assert cut("It ended. The") == ["It ended."]


def test_rows_match_the_scan(spark):
    texts = ["One ends. Two begins. Ω é \U0001f600 Three! Four", None, "", "single"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = segment.sentence_rows(docs, "text", "doc_id").orderBy("doc_id", "sent_seq").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(i, s) for i, t in enumerate(texts) for s in cut(t)]
    assert all(texts[r.doc_id][r.start : r.end] == r.text for r in rows)
