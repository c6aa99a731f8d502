"""Queries over markup that is built from the lines of documents, so that SQL can say what
selecting, flattening, reading and writing must return for every document.

An article has a part of every kind: title, abstract (the first line), keywords (the language),
a paragraph for each line with a citation at its end, one with a reference and a formula, one that
an error spoils, a caption (the source) and an acknowledgement (the language).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import map_rows
from ..functions.lexical import LANGUAGE_WORDS, words
from ..functions.segment import sentence_rows
from ..operators.dnm import Parameters, flat_text, flatten, serialize
from ..operators.patterns import match_documents
from ..operators.select import items, items_of, xpath_nodes
from ..sources import sinks
from ..sources.dom import Node
from ..sources.readers import escaped, map_documents, read_corpus, spread, token_model_lines
from ..streaming.catalog import state_folder
from . import programs
from .oracles import CUT, LEXEME, LINES, quoted, translit, words as sql_words, words_punct

PARTS = ("extended", "heading", "reference", "math")
WORD = "the"
FORMULA = '<math alttext="x"><semantics><mi mathvariant="bold">x</mi><annotation encoding="application/x-llamapun">italic_x</annotation></semantics></math>'
#: Text as it is, but for citations.
CITED = Parameters(names={"cite": "CitationElement"}, normalize_white_spaces=False, wrap_tokens=True)
PLAIN = Parameters(normalize_unicode=True, lowercase=True, back_mapping=False)
#: Words of a made-up sentence, and its four forms: how it opens and ends.
CHUNK = 6
FORMS = (("The ", " end. "), ("Xa Prof. Smith ", " end. "), ("Xa ", " end? "), ("Xa ", " end\n\n"))
PATTERNS = """<patterns>
  <word_rule name="opener"><word_or><word>of</word><word>in</word></word_or></word_rule>
  <seq_rule name="place"><seq_marker name="place" tags="span"><seq_seq>
    <seq_word><word_ref ref="opener"/></seq_word><seq_word><word>the</word></seq_word>
    <seq_word><word_marker name="head"><word_any/></word_marker></seq_word></seq_seq></seq_marker></seq_rule>
</patterns>"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _lines() -> Column:
    return F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x != "")


def _joined(parts: Column, each) -> Column:
    return F.array_join(F.transform(parts, each), "")


def articles(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source) as articles (doc_id, html)."""
    para = lambda x: F.concat(F.lit('<div class="ltx_para"><p class="ltx_p">'), escaped(x), F.lit('<cite class="ltx_cite">[1]</cite></p></div>'))
    field = lambda c: escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    html = F.concat(
        F.lit('<html><head><title>A title</title></head><body><h1 class="ltx_title ltx_title_document">An article</h1>'),
        F.lit('<div class="ltx_abstract"><h6 class="ltx_title">Abstract</h6><p class="ltx_p">'), escaped(F.coalesce(F.try_element_at(_lines(), F.lit(1)), F.lit(""))),
        F.lit('</p></div><div class="ltx_keywords">'), field("lang"), F.lit('</div><h2 class="ltx_title">1 Introduction</h2>'), _joined(_lines(), para),
        F.lit(f'<div class="ltx_para"><p class="ltx_p">see <a class="ltx_ref" href="#">1</a>{FORMULA}</p></div>'),
        F.lit('<div class="ltx_para"><p class="ltx_p">spoilt<span class="ltx_ERROR">?</span></p></div><figure><figcaption class="ltx_caption">'), field("source"),
        F.lit('</figcaption></figure><div class="ltx_acknowledgement">'), field("lang"), F.lit("</div></body></html>"),
    )
    return docs.select("doc_id", html.alias("html"))


def cited(docs: DataFrame) -> DataFrame:
    """(doc_id, html): each line a paragraph that ends in a citation."""
    body = _joined(_lines(), lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("<cite>1</cite></p>")))
    return docs.select("doc_id", F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))


def _folder(spark: SparkSession) -> str:
    return f"{state_folder(spark)}/{uuid.uuid4().hex}"


def article_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, item_seq, item_kind, plaintext) of what the selectors find in articles."""
    found = items_of(articles(_documents(spark, sf_dir)), PARTS)
    return found.select("doc_id", "part", F.col("item_seq").cast("long").alias("item_seq"), "item_kind", "plaintext")


def article_surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prev_name, prev_heading, items) of articles' paragraphs."""
    found = items(articles(_documents(spark, sf_dir)), "paragraph")
    return found.groupBy("prev_name", "prev_heading").agg(F.count("*").alias("items"))


def article_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, frequency) of elements and attributes below articles' formulas."""
    return programs.attribute_catalog(articles(_documents(spark, sf_dir)))


def article_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, text) of the nodes that paths select in articles."""
    docs = articles(_documents(spark, sf_dir))
    paths = ("//div[@class='ltx_keywords']", "/html/body/h2[1]", "//figure//*[contains(@class,'caption')]", "//*[local-name()='mi']")
    return xpath_nodes(docs, *paths).select("path", "doc_id", "text")


def canonical_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(md5, copies) of the canonical forms of cited paragraphs."""
    found = programs.canonical_nodes(cited(_documents(spark, sf_dir)), ("p",), CITED)
    return found.groupBy("md5").agg(F.count("*").alias("copies"))


def range_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_seq, start, end, pointer) of the text of cited paragraphs."""

    def each(root: Node, doc_id: int) -> Iterator[tuple]:
        flat = flatten(root, CITED)
        for i, n in enumerate(n for n in root.walk() if n.is_text and n.parent.name == "p"):
            start, end = flat.span_of(n)
            yield doc_id, i, start, end, serialize(flat, start, end)

    return map_documents(cited(_documents(spark, sf_dir)), each, "doc_id long, item_seq long, start long, end long, pointer string")


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): texts flattened to lower-case ASCII with single spaces."""

    def each(doc_id: int, text: str | None) -> Iterator[tuple]:
        yield doc_id, flat_text(text or "", PLAIN).plaintext

    return map_rows(_documents(spark, sf_dir).select("doc_id", "text"), each, "doc_id long, text string")


def _bare(docs: DataFrame) -> DataFrame:
    """(doc_id, w): a document's words of Latin letters alone."""
    return docs.select("doc_id", F.filter(words(F.lower(F.coalesce("text", F.lit("")))), lambda x: x.rlike("^[a-z]+$")).alias("w"))


def made_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_seq, text): sentences of texts whose words are put in sentences of four forms."""
    opens, ends = (F.array(*[F.lit(f[k]) for f in FORMS]) for k in (0, 1))
    form = lambda i: F.pmod(F.floor(i / CHUNK), F.lit(len(FORMS))).cast("int") + 1
    put = lambda x, i: F.concat(
        F.when(i % CHUNK == 0, F.element_at(opens, form(i))).otherwise(""), x, F.when(i % CHUNK == CHUNK - 1, F.element_at(ends, form(i))).otherwise(" ")
    )
    # A last sentence may have fewer words.
    rest = F.when(F.size("w") % CHUNK > 0, F.ltrim(F.element_at(ends, form(F.size("w"))))).otherwise("")
    text = F.concat(F.array_join(F.transform("w", put), ""), rest)
    rows = sentence_rows(_bare(_documents(spark, sf_dir)).select("doc_id", text.alias("text")), "text", "doc_id")
    return rows.select("doc_id", F.col("sent_seq").cast("long").alias("sent_seq"), "text")


def pattern_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name, tags, start, end, text): markers of "of the ..." and "in the ..." in bare words."""
    rows = _bare(_documents(spark, sf_dir)).select("doc_id", F.array_join("w", " ").alias("text"))
    found = match_documents(rows, PATTERNS, "place", text="text")
    return found.select("doc_id", "name", F.array_join("tags", ",").alias("tags"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


def folder_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, frequency) of pages that are written as files and read as a corpus folder."""
    folder = _folder(spark)
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    pages.where("html is not null").write.partitionBy("page_id").text(folder)
    return programs.node_statistics(programs.node_model(read_corpus(spark, folder, ".txt")))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, word, frequency): word counts written as CSV and as lines, and read again."""
    folder = _folder(spark)
    counts = _documents(spark, sf_dir).select(F.explode(words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("frequency"))
    sinks.write_csv(counts, f"{folder}/csv", "word")
    sinks.write_pairs(spark.read.csv(f"{folder}/csv", header=True, schema="word string, frequency long"), f"{folder}/pairs", "word")
    pair = F.split("value", ", ")
    lines = spark.read.text(f"{folder}/pairs").select(F.lit("pairs").alias("report"), pair[0].alias("word"), pair[1].cast("long").alias("frequency"))
    table = spark.read.csv(f"{folder}/csv", header=True, schema="word string, frequency long")
    return table.select(F.lit("csv").alias("report"), "word", "frequency").union(lines)


def token_model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, copies) of a token model's lines with a word, written and read again."""
    folder = _folder(spark)
    sinks.write_lines(programs.token_model(programs.line_items(_documents(spark, sf_dir))), folder)
    return token_model_lines(spark, folder, WORD).groupBy("text").agg(F.count("*").alias("copies"))


def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, sha256, text): lines labelled by their documents' language, once each, in a folder for each label."""
    folder = _folder(spark)
    rows = _documents(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("label"), F.explode(_lines()).alias("text"))
    sinks.write_labelled(rows.select("label", F.sha2("text", 256).alias("sha256"), "text"), folder)
    return spark.read.schema("sha256 string, text string, label string").parquet(folder)


QUERIES = {
    f.__name__: f
    for f in (
        article_parts, article_surroundings, article_formulas, article_paths, canonical_paragraphs, range_pointers, plain_texts, made_sentences,
        pattern_spans, folder_catalog, report_files, token_model_files, labelled_files,
    )
}


def statements_sql(titles: tuple[str, ...], kinds: tuple[str, ...]) -> str:
    """Statements of documents whose first line stands below a heading chosen by their id."""
    hits = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(map(quoted, ws.split()))}], x))) AS {k}" for k, ws in LANGUAGE_WORDS.items())
    most = f"greatest({', '.join(k for k in LANGUAGE_WORDS if k != 'en')})"
    return (
        f"WITH {LINES}, plain AS (SELECT doc_id, item_seq, {translit('line')} AS line FROM lines WHERE item_seq = 0), "
        f"toks AS (SELECT doc_id, item_seq, list_transform({words_punct('line')}, lambda x: lower(x)) AS w FROM plain), {CUT}, "
        f"hits AS (SELECT doc_id, {hits} FROM (SELECT doc_id, {sql_words('lower(line)')} AS w FROM plain)), "
        f"named AS (SELECT [{', '.join(map(quoted, kinds))}][doc_id % {len(titles)} + 1] AS label, list_filter(list_transform(w, lambda x: {LEXEME}), lambda x: x <> '') AS l "
        f"FROM held JOIN hits USING (doc_id) WHERE NOT overflow AND NOT ({most} >= 3 AND {most} > 3 * en)), "
        f"texts AS (SELECT label, array_to_string(list_transform(l, lambda x: x || ' '), '') || chr(10) AS text FROM named WHERE label <> 'other' AND len(l) BETWEEN {programs.LEAST_WORDS} AND {programs.MOST_WORDS}) "
        "SELECT DISTINCT label, sha256(text) AS sha256, text FROM texts"
    )


def oracles(node_catalog: str, unigram_counts: str, token_model: str) -> dict[str, str]:
    seen = f"{translit('line')} || ' CitationElement '"
    whole = f"parts AS (SELECT doc_id, 3 AS rank, item_seq AS i, 'paragraph' AS item_kind, {seen} AS plaintext FROM lines UNION ALL SELECT doc_id, 4, 0, 'paragraph', 'see  REF  mathformula ' FROM documents "
    whole += f"UNION ALL SELECT doc_id, 1, 0, 'abstract', coalesce((SELECT {translit('line')} FROM lines l WHERE l.doc_id = d.doc_id AND item_seq = 0), '') FROM documents d "
    for rank, kind, column in ((2, "keywords", "lang"), (5, "acknowledgement", "lang"), (6, "caption", "source")):
        whole += f"UNION ALL SELECT doc_id, {rank}, 0, '{kind}', coalesce({translit(column)}, '') FROM documents "
    single = " UNION ALL ".join(
        f"SELECT doc_id, '{part}' AS part, {i} AS item_seq, '{part}' AS item_kind, '{text}' AS plaintext FROM documents"
        for part, i, text in (("heading", 0, "Abstract"), ("heading", 1, "1 Introduction"), ("reference", 0, " REF "), ("math", 0, " mathformula "))
    )
    keys = (
        "math", "math@alttext", "semantics", "mi", "mi@mathvariant", "mi@mathvariant[bold]", "annotation", "annotation@encoding", "annotation@encoding[application/x-llamapun]",
    )
    bare = f"b AS (SELECT doc_id, list_filter({sql_words('lower(text)')}, lambda x: regexp_matches(x, '^[a-z]+$')) AS w FROM documents)"
    forms = " ".join(f"WHEN {k} THEN {quoted(a)} || c || {quoted(b.rstrip())}" for k, (a, b) in enumerate(FORMS))
    return {
        "article_parts": f"WITH {LINES}, {whole}) SELECT doc_id, 'extended' AS part, row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) - 1 AS item_seq, item_kind, plaintext FROM parts UNION ALL {single}",
        "article_surroundings": f"WITH {LINES}, n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM lines) AS lines) "
        "SELECT 'h2' AS prev_name, '1 Introduction' AS prev_heading, docs AS items FROM n UNION ALL SELECT 'div', NULL, lines FROM n WHERE lines > 0",
        "article_formulas": f"SELECT key, n AS frequency FROM (VALUES {', '.join(f'({quoted(k)})' for k in keys)}) AS k(key), (SELECT count(*) AS n FROM documents)",
        "article_paths": "SELECT '//div[@class=''ltx_keywords'']' AS path, doc_id, coalesce(lang, '') AS text FROM documents UNION ALL SELECT '/html/body/h2[1]', doc_id, '1 Introduction' FROM documents "
        "UNION ALL SELECT '//figure//*[contains(@class,''caption'')]', doc_id, coalesce(source, '') FROM documents UNION ALL SELECT '//*[local-name()=''mi'']', doc_id, 'x' FROM documents",
        "canonical_paragraphs": rf"WITH {LINES} SELECT md5('<p>' || CASE WHEN regexp_matches(line, '[^\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]') THEN line ELSE '' END || '<cite></cite></p>') AS md5, count(*) AS copies FROM lines GROUP BY 1",
        "range_pointers": f"WITH {LINES}, o AS (SELECT *, coalesce(sum(length(line) + 17) OVER (PARTITION BY doc_id ORDER BY item_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM lines) "
        "SELECT doc_id, item_seq, a AS start, a + length(line) AS end, 'arange(string-index(/html[1]/body[1]/p[' || (item_seq + 1) || ']/text()[1],1),/html[1]/body[1]/p[' || (item_seq + 1) || ']/cite[1])' AS pointer FROM o",
        "plain_texts": rf"SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce({translit('text')}, '')), '[\s\x0B\x1C-\x1F]+', ' ', 'g'), '^ ', '') AS text FROM documents",
        "made_sentences": f"WITH {bare}, s AS (SELECT doc_id, i AS sent_seq, array_to_string(w[i * {CHUNK} + 1:i * {CHUNK} + {CHUNK}], ' ') AS c FROM b, LATERAL (SELECT unnest(range(0, (len(w) + {CHUNK - 1}) // {CHUNK})) AS i)) "
        f"SELECT doc_id, sent_seq, CASE sent_seq % 4 {forms} END AS text FROM s",
        "pattern_spans": f"WITH {bare}, p AS (SELECT doc_id, w, i, CASE WHEN i > 1 THEN length(array_to_string(w[1:i - 1], ' ')) + 1 ELSE 0 END AS a FROM b, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) WHERE w[i] IN ('of', 'in') AND w[i + 1] = 'the'), "
        "m AS (SELECT doc_id, 'place' AS name, 'span' AS tags, a AS start, array_to_string(w[i:i + 2], ' ') AS text FROM p UNION ALL SELECT doc_id, 'head', '', a + length(w[i]) + 5, w[i + 2] FROM p) "
        "SELECT doc_id, name, tags, start, start + length(text) AS end, text FROM m",
        "folder_catalog": node_catalog,
        "report_files": f"WITH u AS ({unigram_counts}) SELECT 'csv' AS report, word, frequency FROM u UNION ALL SELECT 'pairs', word, frequency FROM u",
        "token_model_files": f"SELECT text, count(*) AS copies FROM ({token_model}) WHERE contains(text, '{WORD}') GROUP BY text",
        "labelled_files": f"WITH {LINES} SELECT DISTINCT coalesce(lang, 'none') AS label, sha256(line) AS sha256, line AS text FROM lines JOIN documents USING (doc_id)",
    }
