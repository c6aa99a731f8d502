import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import labels, lexical, stem


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", make(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_words(spark):
    assert column(spark, ["Bernstein's don't 'small 2nd naïve Ⅷ", "", None], lexical.words) == [["Bernstein's", "don", "t", "'small", "2nd", "naïve", "Ⅷ"], [], None]


def test_words_and_punct(spark):
    got = column(spark, ["don't stop, 'quoted' x", "we'll see: ’s", "a-b (c)."], lexical.words_and_punct)
    assert got == [["don", "'t", "stop", ",", "'", "quoted", "'", "x"], ["we", "'ll", "see", ":", "’s"], ["a", "-", "b", "(", "c", ")", "."]]


def test_lexemes(spark):
    values = ["12", "-1", "3b", "1.5e-3", "a" * 25, "a" * 26, "é" * 13, "Word", "mathformula-dimensional", "xCitationElement", "3z"]
    plain = column(spark, values, lambda c: lexical.normalize_lexeme(c, discard_punct=False))
    assert plain == ["NUM", "NUM", "NUM", "NUM", "a" * 25, None, None, "word", "mathformula", "citationelement", "3z"]
    assert column(spark, ["Bern's", "it-"], lexical.normalize_lexeme) == ["berns", "it"]
    assert one(spark, "mathformula", lexical.normalize_lexeme("x", discard_math=True)) == ""


def test_formula_lexemes(spark):
    got = column(spark, ["NUMBER:3 ATOM:x italic_a:b-c ARRAY:start q ARRAY:end", "", None], lexical.lexematize_math)
    assert got[0].split()[:3] == ["NUM", "ATOM", "italic_a_b_c"] and got[1:] == ["mathformula", "mathformula"]


def test_ngrams(spark):
    make = lambda n: lambda c: lexical.ngrams(F.split(c, " "), n)
    assert column(spark, ["a b c", "a b", "a"], make(2)) == [["a b", "b c"], ["a b"], []]
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    for n in (1, 3, 4):
        want = [[" ".join(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)] for t in texts]
        assert column(spark, texts, make(n)) == want


def test_text_normalisation(spark):
    assert column(spark, [" a \t\n b c ", ""], lexical.normalize_whitespace) == ["a b c ", ""]
    assert column(spark, ["Äŧ ħøµ€…", "Ærø", "日本 x"], lexical.transliterate) == ["At houEUR...", "AEro", " x"]
    assert column(spark, ["see the Word  ", "2.", ""], lexical.previous_word) == ["word", "", ""]
    assert column(spark, ["NUM a_b is here\n\nnext b_c"], lexical.rebuild_text) == ["Mathformula is here . Next mathformula "]
    got = one(spark, "z a", lexical.model_token(F.lit("div"), "x"))
    assert got == "div_a_z"


def test_languages(spark):
    texts = ["the cat is on the mat with it", "le chat est sur la table et il dort", "der Hund und die Katze sind nicht da", "привет мир", "", "12"]
    assert column(spark, texts, lexical.language)[:3] == ["en", "fr", "de"]
    assert column(spark, texts, lexical.is_latin) == [True, True, True, False, True, True]
    assert column(spark, texts, lexical.invalid_for_english) == [False, True, True, True, False, False]


@pytest.mark.parametrize(
    ("heading", "want"),
    [
        ("part ii intro", "partintro"), ("theorems of x", "theorem"), ("proof of lemma NUM", "proof"), ("NUM introduction", "introduction"), ("sketch of the proof", "proof"),
        ("general theorems", "theorem"), ("list of list of examples", "example"), ("analaysis of x", "analysis"), ("exercise", "problem"), ("keywords", "keywords"), ("", ""),
        ("related studies", "related work"), ("methods", "methods"), ("data set", "data set"), ("unknown thing", "unknown thing"),
    ],
)
def test_headings(spark, heading, want):
    assert one(spark, heading, labels.normalize_heading("x")) == want


def test_headings_against_recursion(spark):
    """The bounded passes reach what unbounded recursion does."""

    def reduced(h):
        for pattern, new in (
            (labels.ROMAN, ""), (labels.NUMBER, " "), (labels.LETTER_FIRST, ""), (labels.LETTER_LAST, ""), (rf"^({'|'.join(labels.PHRASE_FIRST)})\s", ""), (rf"\s({'|'.join(labels.WORD_LAST)})$", ""), (rf"({labels.PLURALS})s(?:\s|$)", r"\1"),
        ):
            h = re.sub(pattern, new, h.strip(" "))
        return h

    def fixed(h):
        while (after := reduced(h)) != h:
            h = after
        return h

    rng = random.Random(3)
    pool = "list of the NUM a b x iv theorems lemmas general first some proof proofs of for see words outline section results".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    got = column(spark, texts, labels.normalize_heading)
    want = column(spark, [fixed(t) for t in texts], labels.normalize_heading)
    assert got == want


def test_environments(spark):
    classes = ["ltx_theorem_thm", "x ltx_theorem_mylemma", "ltx_theorem_defn2", "ltx_theorem_remarks", "ltx_theorem_qwerty", "ltx_proof", "x ltx_proof", ""]
    assert column(spark, classes, labels.class_label) == ["theorem", "lemma", "definition", "remark", "other", "proof", None, None]


def test_stems():
    assert stem.stem_words("The tilings are amazing") == "the tile be amaze"
    assert stem.stem_once("Here is one sentences with multiple words.") == "here be one sentence with multiple word."


def test_paths(spark):
    assert one(spark, "abc", lexical.content_path(F.lit("proof"), "x")).startswith("proof/ba7816bf")
    assert column(spark, ["/a/b/0903.1000.html", "x"], lexical.file_label) == ["0903.1000", "x"]


def test_headings_of_the_query(spark):
    from scriptorium.plans.registry import HEADINGS

    assert column(spark, [h for h, _ in HEADINGS], labels.structural_label) == [label for _, label in HEADINGS]
