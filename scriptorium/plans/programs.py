"""The corpus programs, each from DataFrames to DataFrames.

Items are rows of (doc_id, item_seq, plaintext, math, ...) as ``operators.select.items`` makes
them from markup and ``line_items`` from plain texts. Trees and sentences are Python; all
that follows is column expressions over arrays that stay whole, so no token is shuffled but
as a partial count.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.lexical import MOST_BYTES, NUMERIC, bound, invalid_for_english, lexeme, lexemes, once, previous_word, words, words_and_punct
from ..functions.segment import sentences
from ..operators import ngrams as grams
from ..operators.dnm import DEFAULT, LATEXML, Parameters, canonical, flatten
from ..operators.select import items
from ..sources.dom import Node
from ..sources.readers import map_documents

#: Words that a statement has.
LEAST_WORDS, MOST_WORDS = 4, 1024
PLAIN_ATTRIBUTES = ("id", "xref", "alttext", "href", "altimg")


def line_items(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The lines of plain texts that aren't empty, as items."""
    keep = keep or ("doc_id",)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x != "")
    rows = docs.select(*keep, F.posexplode(lines).alias("item_seq", "plaintext"))
    return rows.withColumn("math", F.array().cast("array<string>"))


def _lexemes(tokens: Column, math: Column, discard_math: bool) -> Column:
    """Lexemes of lower-cased tokens; the k-th formula takes the k-th annotation."""
    formula = lambda w: w.contains("mathformula")
    plain = F.transform(tokens, lambda w: lexeme(w, discard_math))
    if discard_math:
        return plain
    nth = lambda i: F.size(F.filter(F.slice(tokens, 1, i + 1), formula))
    named = F.transform(
        tokens,
        lambda w, i: F.when(formula(w), F.coalesce(F.try_element_at(math, nth(i)), F.lit("mathformula"))).otherwise(lexeme(w)),
    )
    return F.when(F.exists(F.coalesce(math, F.array().cast("array<string>")), lambda m: m.isNotNull()), named).otherwise(plain)


def tokenized(found: DataFrame) -> DataFrame:
    """Items with ``tokens`` (lower-cased words and punctuation) up to the first that overflows,
    and whether one does."""
    first = lambda t: F.array_position(F.transform(t, lambda w: F.octet_length(w) > MOST_BYTES), F.lit(True)).cast("int")
    cut = lambda t: bound(first(t), lambda k: F.struct((k > 0).alias("overflow"), F.when(k > 0, F.slice(t, 1, k - 1)).otherwise(t).alias("tokens")))
    out = once(found, _cut=bound(F.transform(words_and_punct("plaintext"), lambda w: F.lower(w)), cut))
    return out.withColumns({"tokens": F.col("_cut.tokens"), "overflow": F.col("_cut.overflow")}).drop("_cut")


def token_model(found: DataFrame, discard_math: bool = False, *keep: str) -> DataFrame:
    """(doc_id, item_seq, text): each valid item as its lexemes, each followed by a space."""
    keep = keep or ("doc_id", "item_seq")
    lexemes = _lexemes(F.col("tokens"), F.col("math"), discard_math)
    valid = tokenized(found).where(~F.col("overflow"))
    return valid.select(*keep, F.array_join(F.transform(lexemes, lambda w: F.concat(w, F.lit(" "))), "").alias("text"))


def token_model_counters(found: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of the token model's counters. Those of an item that overflows count what came before."""
    t = F.col("tokens")
    is_math, is_cite = (lambda w: w.contains("mathformula")), (lambda w: w.contains("citationelement"))
    size = lambda test: F.sum(F.size(F.filter(t, test)))
    counts = tokenized(found).agg(
        F.count("*").alias("paragraph_count"),
        size(lambda w: ~is_math(w) & ~is_cite(w) & ~w.rlike(NUMERIC)).alias("word_count"),
        F.count_if("overflow").alias("overflow_count"),
        size(is_math).alias("formula_count"),
        size(lambda w: ~is_math(w) & is_cite(w)).alias("citation_count"),
        size(lambda w: ~is_math(w) & ~is_cite(w) & w.rlike(NUMERIC)).alias("num_count"),
    )
    # Two rows of one number each.
    return documents.agg(F.count("*").alias("document_count")).crossJoin(counts).select(
        "document_count", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts.columns]
    )


def statements(found: DataFrame, discard_math: bool = False) -> DataFrame:
    """(label, sha256, text): paragraphs that open a named section or environment, once each."""
    special = F.when(F.col("root_class").contains("ltx_acknowledgement"), "acknowledgement").when(F.col("root_class").contains("ltx_caption"), "caption")
    prev = F.coalesce("prev_name", F.lit(""))
    opens = found.withColumn("special", special).where(F.col("special").isNotNull() | (prev == "") | prev.startswith("h"))
    opens = opens.where(~invalid_for_english("plaintext"))
    env = F.when(F.col("has_markup"), labels.class_label("parent_class"))
    heading = F.when(prev != "", labels.structural_label(labels.heading_text("prev_heading")))
    named = opens.withColumn("env", env).withColumn("heading", F.when(F.col("env").isNull(), heading))
    label = F.coalesce("special", F.when(~F.col("env").isin(*labels.NOISY), F.col("env")), F.when(F.col("heading") != "other", F.col("heading")))
    named = tokenized(once(named, label=label).where("label is not null"))
    own = F.filter(_lexemes(F.col("tokens"), F.col("math"), discard_math), lambda w: w != "")
    kept = once(named.where(~F.col("overflow")).select("label", "tokens", "math"), lexemes=own).where(F.size("lexemes").between(LEAST_WORDS, MOST_WORDS))
    text = F.concat(F.array_join(F.transform("lexemes", lambda w: F.concat(w, F.lit(" "))), ""), F.lit("\n"))
    return once(kept.select("label", "lexemes"), text=text).select("label", F.sha2("text", 256).alias("sha256"), "text").dropDuplicates(["label", "sha256"])


def statement_overflows(found: DataFrame) -> DataFrame:
    """(overflow_count): words too long, and items outside the range; an item can count twice."""
    t = tokenized(found)
    n = F.size("tokens")
    return t.agg((F.count_if("overflow") + F.count_if(~n.between(LEAST_WORDS, MOST_WORDS))).alias("overflow_count"))


def heading_stats(found: DataFrame) -> DataFrame:
    """(heading, frequency) of the headings' kinds."""
    kept = found.where(~invalid_for_english("plaintext"))
    text = labels.heading_text("plaintext")
    rows = kept.select(labels.normalize_heading(text).alias("heading")).where("heading <> ''")
    return grams.counts(rows, "heading")


def attribute_catalog(docs: DataFrame, within: str | None = "math") -> DataFrame:
    """(key, frequency) of name, name@attribute and name@attribute[value] of the elements below
    ``within``, or of all."""

    def each(root: Node, doc_id: int) -> Iterator[tuple]:
        tops = [root] if within is None else [n for n in root.walk() if n.name == within]
        for top in tops:
            for n in top.walk():
                if not n.is_text:
                    yield n.name, list(n.attrs), list(n.attrs.values())

    found = map_documents(docs, each, "name string, attrs array<string>, vals array<string>")
    pair = lambda p: F.concat(F.lit("@"), p.a)
    valued = lambda p: F.when(p.a.isin(*PLAIN_ATTRIBUTES), F.array().cast("array<string>")).otherwise(
        F.transform(F.filter(F.split(p.v, r"\s+"), lambda x: x != ""), lambda x: F.concat(pair(p), F.lit("["), x, F.lit("]")))
    )
    pairs = F.transform(F.arrays_zip(F.col("attrs").alias("a"), F.col("vals").alias("v")), lambda p: F.concat(F.array(pair(p)), valued(p)))
    keys = F.explode(F.concat(F.array(F.lit("")), F.flatten(pairs))).alias("rest")
    return grams.counts(found.select("name", keys).select(F.concat("name", "rest").alias("key")), "key")


def element_histogram(docs: DataFrame, test) -> tuple[DataFrame, DataFrame]:
    """((elements, documents) of how many documents hold how many elements that pass a test,
    (total) elements)."""

    def each(root: Node, doc_id: int) -> Iterator[tuple]:
        yield (sum(1 for n in root.walk() if not n.is_text and test(n)),)

    found = map_documents(docs, each, "elements long").groupBy("elements").agg(F.count("*").alias("documents"))
    return found, found.agg(F.coalesce(F.sum(F.col("elements") * F.col("documents")), F.lit(0)).alias("total"))


def node_model(docs: DataFrame, closed: tuple[str, ...] = ("math", "table")) -> DataFrame:
    """(doc_id, text): a document's elements in order as name_class1_class2, without what is in
    formulas and tables."""

    def each(root: Node, doc_id: int) -> Iterator[tuple]:
        out, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.is_text:
                continue
            out.append("_".join([n.name, *sorted(n.class_attr.split())]))
            if n.name not in closed:
                stack.extend(reversed(n.children))
        yield doc_id, " ".join(out)

    return map_documents(docs, each, "doc_id long, text string")


def node_statistics(model: DataFrame) -> DataFrame:
    return grams.counts(model.select(F.explode(F.split("text", " ")).alias("node")).where("node <> ''"), "node")


def words_before(found: DataFrame) -> DataFrame:
    """(word, frequency) of the words right before references."""
    rows = found.select(previous_word("prev_text").alias("word")).where("word <> ''")
    return grams.counts(rows, "word")


def citation_ngrams(lines: DataFrame, n: int = 4, reach: int = 15, anchor: str = "citationelement", mode: str = "compat") -> DataFrame:
    """(ngram, frequency) around citations in a token model's lines (text)."""
    kept = lines.where(F.col("text").contains(anchor))
    return grams.counts(kept.select(F.explode(grams.anchored_ngrams("text", anchor, reach, n, mode)).alias("ngram")), "ngram")


def word_report(found: DataFrame) -> DataFrame:
    """(paragraphs, sentences, words, distinct_words) of items."""
    cut = found.select("plaintext", sentences("plaintext").alias("s"))
    each = F.transform("s", lambda s: F.substr("plaintext", s.start + 1, s.end - s.start))
    # A null word for each paragraph holds the paragraph's sentences, so one pass counts all.
    w = F.concat(F.array(F.lit(None).cast("string")), F.flatten(F.transform(each, lambda t: words(F.lower(t)))))
    rows = cut.select(F.size("s").alias("n"), F.explode(w).alias("word"))
    per_word = rows.groupBy("word").agg(F.count("*").alias("m"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("n"))
    of = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    none = F.col("word").isNull()
    return per_word.agg(of(none, "m").alias("paragraphs"), of(none, "n").alias("sentences"), of(~none, "m").alias("words"), F.count("word").alias("distinct_words"))


def document_text(docs: DataFrame, parameters: Parameters = LATEXML) -> DataFrame:
    """(doc_id, text): paragraphs' sentences as lines of lexemes; a paragraph with a word that
    overflows is left out."""
    found = items(docs, "paragraph", parameters).select("doc_id", "item_seq", "plaintext", sentences("plaintext").alias("s"))
    lines = F.transform("s", lambda s: words(F.substr("plaintext", s.start + 1, s.end - s.start)))
    long = lambda ls: F.exists(ls, lambda ws: F.exists(ws, lambda w: F.octet_length(F.lower(w)) > MOST_BYTES))
    line = lambda ws: F.concat(F.array_join(F.transform(lexemes(ws), lambda w: F.concat(w, F.lit(" "))), ""), F.lit("\n"))
    text = bound(lines, lambda ls: F.when(~long(ls), F.array_join(F.transform(ls, line), "")))
    rows = once(found, t=text).select("doc_id", "item_seq", "t").where("t is not null")
    ordered = F.array_sort(F.collect_list(F.struct("item_seq", "t")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda r: r.t), "").alias("text"))


def canonical_nodes(docs: DataFrame, names: tuple[str, ...], parameters: Parameters = DEFAULT) -> DataFrame:
    """(doc_id, node_id, canonical, md5) of the elements of some names."""
    def each(root: Node, doc_id: int) -> Iterator[tuple]:
        flat = flatten(root, parameters)
        for n in root.walk():
            if n.name in names:
                yield doc_id, n.id, canonical(n, flat)

    found = map_documents(docs, each, "doc_id long, node_id int, canonical string")
    return found.withColumn("md5", F.md5("canonical"))


def document_vectors(docs: DataFrame, size: int = 32, window: int = 10, least: int = 5, rounds: int = 2, seed: int = 1) -> DataFrame:
    """(doc_id, vector): the mean of a text's word vectors, trained on the corpus; stands in for
    paragraph vectors."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = docs.select("doc_id", words(F.lower(F.coalesce("text", F.lit("")))).alias("words"))
    # Each part of the texts is trained by a task of its own and a word's vectors are averaged; by default one task trains all.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    trainer = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, numPartitions=parts, inputCol="words", outputCol="v")
    model = trainer.fit(rows)
    return model.transform(rows).select("doc_id", vector_to_array("v").alias("vector"))


def item_ngrams(found: DataFrame, n: int) -> DataFrame:
    """(ngram, frequency) of the lower-cased words of items."""
    rows = found.select(words(F.lower("plaintext")).alias("w"))
    if n < 3:  # these repeat, so partial counts are the smaller
        return grams.ngram_counts(rows, "w", n)
    size = found.agg(F.sum(F.octet_length("plaintext").cast("long"))).first()[0] or 0
    return grams.dealt_ngram_counts(rows, "w", n, max(found.sparkSession.sparkContext.defaultParallelism, -(-size // grams.TASK_BYTES)))
