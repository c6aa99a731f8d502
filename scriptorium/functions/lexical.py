"""Words, lexemes and text normalisation as column expressions.

Character classes are Unicode's: a letter is Alphabetic, a digit any number character,
white space White_Space. Offsets, where any, count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import STOPWORDS, TRANSLIT_MANY, TRANSLIT_ONE

ALNUM = r"\p{IsAlphabetic}\p{N}"
BLANK = r"\p{IsWhite_Space}"
#: Alphanumeric runs; an apostrophe right before an s belongs to its word.
WORDS = rf"(?:[{ALNUM}]|['’](?=s))+"
_GLUED = "t|s|un|th|ll|d|ve|il|re|m"
#: Words, contracted endings and every other visible character by itself.
WORDS_PUNCT = rf"['’](?:{_GLUED})(?![{ALNUM}])|[{ALNUM}]+|[^{ALNUM}{BLANK}]"
NUMERIC = r"^-?\p{Nd}+(?:[a-k]|(?:\.\p{Nd}+(?:[eE][+-]?\p{Nd}+)?))?$"
MOST_BYTES = 25


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with columns that are computed once a row. Filters on a plain column are pushed below it,
    where every use computes it anew; they stay above what is exploded."""
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_once")
    return rows.select(*[c for c in rows.columns if c not in values], made).select("*", "_once.*").drop("_once")


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(WORDS), F.lit(0))


def words_and_punct(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(WORDS_PUNCT), F.lit(0))


def is_numeric(word: Column | str) -> Column:
    """Integers, decimals, exponents and sub-figure numbers such as 3b."""
    return col(word).rlike(NUMERIC)


def is_overflow(word: Column | str, discard_punct: bool = False) -> Column:
    """Longer than 25 bytes of UTF-8 once lower-cased: such words spoil their item."""
    return F.octet_length(_lowered(col(word), discard_punct)) > MOST_BYTES


def _lowered(word: Column, discard_punct: bool) -> Column:
    low = F.lower(word)
    return F.regexp_replace(low, f"[^{ALNUM}]", "") if discard_punct else low


def normalize_lexeme(word: Column | str, discard_math: bool = False, discard_punct: bool = True, math: Column | None = None) -> Column:
    """The lexeme of a word: NUM, citationelement, a formula's lexemes (``math``, else
    mathformula) or the lower-cased word. Null where the word overflows."""
    return lexeme(_lowered(col(word), discard_punct), discard_math, math)


def lexeme(low: Column, discard_math: bool = False, math: Column | None = None) -> Column:
    """The lexeme of a word that is lower-cased; it is used several times, so it should be a column."""
    formula = F.lit("") if discard_math else F.coalesce(math, F.lit("mathformula")) if math is not None else F.lit("mathformula")
    return (
        F.when(F.octet_length(low) > MOST_BYTES, F.lit(None).cast("string"))
        .when(low.contains("mathformula"), formula)
        .when(low.contains("citationelement"), "citationelement")
        .when(low.rlike(NUMERIC), "NUM")
        .otherwise(low)
    )


def lexemes(tokens: Column) -> Column:
    """The lexemes of words without punctuation inside; each is lower-cased once."""
    return F.transform(F.transform(tokens, lambda w: _lowered(w, True)), lambda w: lexeme(w))


def lexematize_math(annotation: Column | str) -> Column:
    """A formula's lexeme annotation as space-separated lexemes, mathformula where it has none."""
    padded = F.regexp_replace(col(annotation), r"(\S+):(start|end)", r" $1_$2 ")
    plain = ("NUM", "ARRAY", "ATOM", "SUPERSCRIPTOP")

    def lexeme(w: Column) -> Column:
        out = F.regexp_replace(w, "[:-]", "_")
        for p in reversed(plain):
            out = F.when(w.startswith(p), F.lit(p)).otherwise(out)
        return out

    parts = F.filter(F.split(F.trim(padded), r"\s+"), lambda w: w != "")
    joined = F.array_join(F.transform(parts, lexeme), " ")
    return F.when(F.coalesce(F.length(joined), F.lit(0)) > 0, joined).otherwise("mathformula")


def normalize_whitespace(text: Column | str, at_start: bool = True) -> Column:
    """Runs of white space become one space; a leading run goes where the text begins a document."""
    out = F.regexp_replace(col(text), f"{BLANK}+", " ")
    return F.ltrim(out) if at_start else out


def transliterate(text: Column | str) -> Column:
    """ASCII for Latin letters with marks, punctuation, Greek and Cyrillic; others are dropped."""
    out = F.translate(col(text), "".join(TRANSLIT_ONE), "".join(TRANSLIT_ONE.values()))
    for source, target in TRANSLIT_MANY.items():
        out = F.replace(out, F.lit(source), F.lit(target))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def is_stopword(word: Column | str) -> Column:
    return F.lower(col(word)).isin(*sorted(STOPWORDS))


def without_stopwords(tokens: Column | str) -> Column:
    return F.filter(col(tokens), lambda w: ~is_stopword(w))


def ngrams(tokens: Column | str, n: int) -> Column:
    """All runs of n tokens joined by a space; fewer tokens have none."""

    def runs(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    return bound(col(tokens), runs)


def previous_word(text: Column | str) -> Column:
    """The last word before the end of a text, lower-cased, or an empty string."""
    return F.lower(F.regexp_extract(F.regexp_replace(col(text), f"{BLANK}+$", ""), f"([{ALNUM}]+)$", 1))


def model_token(name: Column | str, class_attr: Column | str) -> Column:
    """An element as name_class1_class2, its classes sorted."""
    classes = F.array_sort(F.filter(F.split(F.coalesce(col(class_attr), F.lit("")), " "), lambda c: c != ""))
    return F.array_join(F.concat(F.array(col(name)), classes), "_")


def rebuild_text(lines: Column | str) -> Column:
    """A token model's lines as sentences: empty lines go, runs of NUM and of words with an
    underscore become a formula, the first letter is a capital, sentences end with a dot."""
    runs = r"(?:(?<!\S)(?:NUM|\S+_\S+)(?:\s+|$))+"

    def sentence(line: Column) -> Column:
        out = F.regexp_replace(line, runs, "mathformula ")
        return F.concat(F.translate(F.left(out, F.lit(1)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(out, 2, 2**30))

    kept = F.filter(F.split(col(lines), "\n"), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(kept, sentence), " . ")


def latin_share(text: Column | str) -> Column:
    """The share of letters that are Latin, null without letters. Stand-ins for formulas,
    citations and references don't count."""
    plain = F.regexp_replace(col(text), "mathformula|CitationElement|REF", " ")
    letters = F.length(F.regexp_replace(plain, r"[^\p{IsAlphabetic}]", ""))
    latin = F.length(F.regexp_replace(plain, r"[^\p{IsLatin}]", ""))
    return F.when(letters > 0, latin / letters)


def is_latin(text: Column | str) -> Column:
    """Whether most letters are Latin; texts without letters are."""
    return F.coalesce(latin_share(text) > 0.5, F.lit(True))


#: The language gate weighs common words of four languages against each other.
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it with as was on be by this are from at or an which we",
    "fr": "le la les de des et en un une du que est pour qui dans par sur pas au avec ce il elle",
    "de": "der die und das den von zu mit dem des ist ein eine nicht auf für im sich auch als es",
    "es": "el la los las de que y en un una del se por con para no es al lo como más su este",
}


def common_words(tokens: Column, language: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*LANGUAGE_WORDS[language].split())))


def language(text: Column | str) -> Column:
    """The language with most common words, null where none has any; first of equals."""


    def named(hits: Column) -> Column:
        best, out = F.array_max(hits), F.lit(None).cast("string")
        for i, k in reversed(list(enumerate(LANGUAGE_WORDS))):
            out = F.when(hits[i] == best, k).otherwise(out)
        return F.when(best > 0, out)

    return bound(words(F.lower(col(text))), lambda tokens: bound(F.array(*[common_words(tokens, k) for k in LANGUAGE_WORDS]), named))


def invalid_for_english(text: Column | str) -> Column:
    """Not Latin script, or plainly of another language (an approximation by common words)."""

    def foreign(tokens: Column) -> Column:
        most = F.greatest(*[common_words(tokens, k) for k in LANGUAGE_WORDS if k != "en"])
        return (most >= 3) & (most > 3 * common_words(tokens, "en"))

    return ~is_latin(text) | bound(words(F.lower(col(text))), foreign)


def content_path(label: Column | str, text: Column | str) -> Column:
    """label/sha256.txt, where a labelled text is filed."""
    return F.concat(col(label), F.lit("/"), F.sha2(col(text), 256), F.lit(".txt"))


def file_label(path: Column | str) -> Column:
    """A document's name from its file's: no folder, no extension."""
    return F.regexp_extract(col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)
