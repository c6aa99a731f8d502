"""The queries of the corpus engine, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, lexical
from ..functions.lexical import words, words_and_punct
from ..functions.batches import map_rows
from ..functions.segment import sentence_rows, sentence_spans, sentences
from ..functions.tagger import tags
from ..operators import ngrams as grams
from ..operators.patterns import match_documents
from ..operators.select import items, lifted
from ..sources.readers import escaped, spread
from ..sources.sinks import log_scatter
from ..streaming import catalog as stream
from . import articles, declarations, oracles, programs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ANCHOR, REACH = "the", 3
#: Headings and environments with their labels; every kind of rule once.
HEADINGS = [
    ("introduction ", "introduction"), ("introduction and motivation ", "introduction"), ("definition xiii a ", "definition"), ("theorems of ", "theorem"),
    ("proof of lemma NUM ", "proof"), ("the main results ", "result"), ("summary of results ", "result"), ("bibliography ", "other"), ("keywords ", "other"), ("prior work ", "related work"),
    ("acknowledgments ", "acknowledgement"), ("exercises ", "problem"), ("concluding remarks ", "remark"), ("numerical experiment ", "experiment"), ("appendix ", "other"),
    ("future directions ", "future work"), ("hypothesis ", "conjecture"), ("a new method ", "methods"), ("lemme ", "other"), ("", "other"), ("outline of the proof ", "proof"),
]
CLASSES = [
    ("ltx_theorem", "theorem"), ("ltx_theorem ltx_theorem_thm", "theorem"), ("ltx_theorem ltx_theorem_lem", "lemma"), ("ltx_theorem ltx_theorem_prop", "proposition"),
    ("ltx_theorem ltx_theorem_cor", "corollary"), ("ltx_theorem ltx_theorem_def", "definition"), ("ltx_theorem ltx_theorem_rem", "remark"), ("ltx_theorem ltx_theorem_ex", "example"),
    ("ltx_theorem ltx_theorem_conj", "conjecture"), ("ltx_theorem ltx_theorem_prob", "problem"), ("ltx_theorem ltx_theorem_prf", "proof"), ("ltx_theorem ltx_theorem_claim2", "claim"),
    ("ltx_theorem ltx_theorem_mythm", "theorem"), ("ltx_theorem ltx_theorem_lemmas", "lemma"), ("ltx_theorem ltx_theorem_unknownxyz", "other"), ("ltx_proof", "proof"),
    ("x ltx_proof", None), ("", None), ("ltx_para", None), ("ltx_theorem ltx_theorem_notation", "notation"), ("ltx_theorem ltx_theorem_ques", "question"),
]
TITLES = ("Introduction", "Proof of Lemma 2", "Definitions", "Main results", "On the sea")
#: A small program: "the X of the Y" and a noun phrase before "is".
PATTERNS = """<patterns>
  <pos_rule name="noun"><pos_or><pos tag="NN"/><pos tag="NNS"/><pos tag="NNP"/></pos_or></pos_rule>
  <word_rule name="article"><word_or><word>the</word><word>a</word><word>an</word></word_or></word_rule>
  <word_rule name="noun"><word_pos><pos_ref ref="noun"/><word_any/></word_pos></word_rule>
  <seq_rule name="noun phrase"><seq_seq>
    <seq_or match_type="any"><seq_word><word_ref ref="article"/></seq_word></seq_or>
    <seq_word><word_marker name="head"><word_ref ref="noun"/></word_marker></seq_word></seq_seq></seq_rule>
  <seq_rule name="of phrase"><seq_marker name="of phrase" tags="relation, noun">
    <seq_seq><seq_ref ref="noun phrase"/><seq_word><word>of</word></seq_word><seq_ref ref="noun phrase"/></seq_seq></seq_marker></seq_rule>
</patterns>"""


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), "html"))


def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, word) of each document's distinct words in the order of their first places."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.array_distinct(words(F.lower("text")))).alias("pos", "word"))


def bare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode(words(F.lower("text"))).alias("word"))


@query
def unigram_counts(spark, sf_dir):
    return grams.counts(bare_words(spark, sf_dir), "word")


@query
def words_punct_counts(spark, sf_dir):
    return grams.counts(documents(spark, sf_dir).select(F.explode(words_and_punct("text")).alias("word")), "word")


@query
def stopword_filtered_counts(spark, sf_dir):
    return grams.counts(bare_words(spark, sf_dir).where(~lexical.is_stopword("word")), "word")


@query
def stopword_counts(spark, sf_dir):
    return grams.counts(bare_words(spark, sf_dir).where(lexical.is_stopword("word")), "word")


@query
def numeric_normalised_tokens(spark, sf_dir):
    lexeme = bare_words(spark, sf_dir).select(lexical.normalize_lexeme("word").alias("lexeme"))
    return grams.counts(lexeme.where("lexeme <> ''"), "lexeme")


@query
def numeric_literals(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = F.explode(F.array(F.concat(F.col("l_quantity").cast("int").cast("string"), "l_returnflag"), F.col("l_linenumber").cast("string")))
    return rows.select(x.alias("x")).groupBy(lexical.is_numeric("x").alias("numeric")).agg(F.count("*").alias("n"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.line_items(documents(spark, sf_dir))


@query
def overflow_paragraphs(spark, sf_dir):
    return programs.tokenized(lines(spark, sf_dir)).where("overflow").select("doc_id", F.col("item_seq").cast("long").alias("item_seq"))


@query
def token_model(spark, sf_dir):
    return programs.token_model(lines(spark, sf_dir)).withColumn("item_seq", F.col("item_seq").cast("long"))


@query
def token_model_counters(spark, sf_dir):
    return programs.token_model_counters(lines(spark, sf_dir), documents(spark, sf_dir))


@query
def conversation_token_model(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("plaintext"), F.array().cast("array<string>").alias("math"))
    return programs.token_model(turns, False, "conv_id", "turn")


@query
def dictionary_first_index(spark, sf_dir):
    return grams.dictionary(first_words(spark, sf_dir))


@query
def inorder_frequency(spark, sf_dir):
    return grams.dictionary(first_words(spark, sf_dir)).join(unigram_counts(spark, sf_dir), "word")


@query
def freq_of_freq(spark, sf_dir):
    return unigram_counts(spark, sf_dir).groupBy("frequency").agg(F.count("*").alias("words"))


@query
def frequency_scatter(spark, sf_dir):
    return log_scatter(freq_of_freq(spark, sf_dir), "frequency", "words").withColumn("log2_y", F.round("log2_y", 6))


@query
def bigram_counts(spark, sf_dir):
    return programs.item_ngrams(documents(spark, sf_dir).withColumnRenamed("text", "plaintext"), 2)


@query
def fourgram_counts(spark, sf_dir):
    return programs.item_ngrams(documents(spark, sf_dir).withColumnRenamed("text", "plaintext"), 4)


@query
def anchored_ngrams_window(spark, sf_dir):
    return grams.counts(documents(spark, sf_dir).select(F.explode(grams.anchored_ngrams("text", ANCHOR, REACH, 2, "window")).alias("ngram")), "ngram")


@query
def anchored_ngrams_compat(spark, sf_dir):
    return grams.counts(documents(spark, sf_dir).select(F.explode(grams.anchored_ngrams("text", ANCHOR, REACH, 2)).alias("ngram")), "ngram")


@query
def citation_ngrams(spark, sf_dir):
    """The program's shape over a token model of documents, around a frequent word."""
    return programs.citation_ngrams(token_model(spark, sf_dir), anchor=ANCHOR)


@query
def sentence_counts(spark, sf_dir):
    """(doc_id, sentences) of whole documents."""
    return documents(spark, sf_dir).select("doc_id", F.size(sentences("text")).alias("sentences"))


@query
def sentence_lengths(spark, sf_dir):
    """(words, sentences): how many sentences have how many words."""
    rows = sentence_rows(documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")
    return rows.groupBy(F.size(words("text")).alias("words")).agg(F.count("*").alias("sentences"))


@query
def word_report(spark, sf_dir):
    return programs.word_report(lines(spark, sf_dir))


@query
def pos_tag_counts(spark, sf_dir):
    def each(text):
        text = text or ""
        yield from Counter(pos for a, b in sentence_spans(text) for pos in tags(text[a:b])).items()

    found = map_rows(documents(spark, sf_dir).select("text"), each, "pos string, n long")
    return found.groupBy("pos").agg(F.sum("n").alias("frequency"))


@query
def lifted_token_model(spark, sf_dir):
    """(doc_id, item_seq, text) through markup: lines as paragraphs, trees, flattened text, tokens."""
    return programs.token_model(items(lifted(documents(spark, sf_dir).where("text is not null")), "paragraph"))


@query
def statement_paragraphs(spark, sf_dir):
    """Statements of documents with a heading by their id before their lines, each line a paragraph."""
    head = F.element_at(F.array(*map(F.lit, TITLES)), (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(TITLES))) + 1).cast("int"))
    titled = lifted(documents(spark, sf_dir)).withColumn("html", F.concat(F.lit('<h2 class="ltx_title">'), head, F.lit("</h2>"), F.regexp_replace("html", "</?(?:html|body)>", "")))
    return programs.statements(items(titled))


@query
def heading_stats(spark, sf_dir):
    return programs.heading_stats(items(pages(spark, sf_dir), "generic_heading"))


@query
def node_catalog(spark, sf_dir):
    return programs.node_statistics(programs.node_model(pages(spark, sf_dir)))


@query
def node_model(spark, sf_dir):
    return programs.node_model(pages(spark, sf_dir))


@query
def attr_catalog(spark, sf_dir):
    return programs.attribute_catalog(pages(spark, sf_dir), None)


@query
def count_histogram(spark, sf_dir):
    return programs.element_histogram(pages(spark, sf_dir), lambda n: n.name == "p")[0]


@query
def pre_link_words(spark, sf_dir):
    """Words before links; every "of" between spaces is made one."""
    linked = F.replace(escaped("text"), F.lit(" of "), F.lit(' <a href="#">of</a> '))
    return programs.words_before(items(documents(spark, sf_dir).select("doc_id", linked.alias("html")), "generic_reference"))


@query
def document_text(spark, sf_dir):
    return programs.document_text(lifted(documents(spark, sf_dir).where("text is not null")))


@query
def paragraph_dedup_sha(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(F.sha2("plaintext", 256).alias("sha256")).agg(F.count("*").alias("copies"))


@query
def md5_c14n(spark, sf_dir):
    """(md5, copies) of the canonical forms of paragraphs and headings."""
    return programs.canonical_nodes(pages(spark, sf_dir), ("p", "h1")).groupBy("md5").agg(F.count("*").alias("copies"))


@query
def whitespace_norm(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", lexical.normalize_whitespace("text").alias("text"))


@query
def unicode_translit(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", lexical.transliterate("text").alias("text"))


@query
def rebuild_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", lexical.rebuild_text("text").alias("text"))


@query
def language_gate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", lexical.language("text").alias("language"), lexical.is_latin("text").alias("is_latin"))


@query
def structural_labels(spark, sf_dir):
    """(doc_id, heading, label): by their id documents get a heading, alone or with their first word
    behind or before it."""
    n, word = len(HEADINGS), F.coalesce(F.element_at(F.slice(words(F.lower("text")), 1, 1), 1), F.lit(""))
    head = F.element_at(F.array(*[F.lit(h) for h, _ in HEADINGS]), (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(n)) + 1).cast("int"))
    way = F.pmod(F.floor(F.coalesce("doc_id", F.lit(0)) / n), F.lit(3))
    heading = F.when(way == 0, head).when(way == 1, F.concat(head, word, F.lit(" "))).otherwise(F.concat(word, F.lit(" "), head))
    rows = documents(spark, sf_dir).select("doc_id", heading.alias("heading"))
    return rows.select("doc_id", "heading", labels.structural_label("heading").alias("label"))


@query
def ams_env_labels(spark, sf_dir):
    rows = spark.createDataFrame([(c,) for c, _ in CLASSES], "class_attr string")
    return rows.select("class_attr", labels.class_label("class_attr").alias("label"))


@query
def pattern_matches(spark, sf_dir):
    return match_documents(documents(spark, sf_dir), PATTERNS, "of phrase", text="text")


@query
def declaration_markers(spark, sf_dir):
    """(name, tags, frequency) of the declaration spotter's markers; every "of" between spaces is made
    a quantified formula."""
    formula = " for every <math><mrow><mi>x</mi><mo>∈</mo><mi>A</mi></mrow></math> "
    html = F.concat(F.lit("<p>"), F.replace(escaped("text"), F.lit(" of "), F.lit(formula)), F.lit("</p>"))
    found = declarations.declarations(documents(spark, sf_dir).select("doc_id", html.alias("html")))
    return found.groupBy("name", F.array_join("tags", ", ").alias("tags")).agg(F.count("*").alias("frequency"))


@query
def document_vectors(spark, sf_dir):
    return programs.document_vectors(documents(spark, sf_dir), rounds=1)


@query
def stream_unigram_counts(spark, sf_dir):
    """Word counts by a stream over the documents' files, as a table that each batch replaces."""
    folder = f"{stream.state_folder(spark)}/{uuid.uuid4().hex}"
    schema = documents(spark, sf_dir).schema.simpleString()[7:-1]
    text = stream.stream_documents(spark, f"{sf_dir}/documents.parque[t]", schema.replace(":", " "))
    keys = text.select(F.explode(words(F.lower("text"))).alias("key"))
    stream.run_catalog(keys, "words", f"{folder}/state", lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/counts")).awaitTermination()
    return spark.read.schema("key string, frequency long").parquet(f"{folder}/counts").withColumnRenamed("key", "word")


ORACLES: dict[str, str] = oracles.by_queries(HEADINGS, CLASSES, ANCHOR, REACH)
QUERIES |= articles.QUERIES
ORACLES |= articles.oracles(*(ORACLES[k] for k in ("node_catalog", "unigram_counts", "token_model")))
ORACLES["statement_paragraphs"] = articles.statements_sql(TITLES, ("introduction", "proof", "definition", "result", "other"))
