"""SQL for DuckDB that says what the queries must return, written apart from their plans.

RE2 has no look-around, so an apostrophe that belongs to a word is first marked by a
private character and turned back afterwards.
"""

from __future__ import annotations

from ..functions import labels
from ..functions.lexical import LANGUAGE_WORDS
from ..functions.tables import STOPWORDS, TRANSLIT_MANY, TRANSLIT_ONE

A1, A2 = "chr(57344)", "chr(57345)"
ALNUM = r"\p{L}\p{N}"
SPACES = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NUMERIC = r"^-?\p{Nd}+([a-k]|(\.\p{Nd}+([eE][+-]?\p{Nd}+)?))?$"
GLUED = "t|s|un|th|ll|d|ve|il|re|m"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def restored(x: str) -> str:
    return f"replace(replace({x}, {A1}, ''''), {A2}, '’')"


def words(text: str) -> str:
    marked = f"replace(replace({text}, '''s', {A1} || 's'), '’s', {A2} || 's')"
    return rf"list_transform(regexp_extract_all({marked}, '[{ALNUM}\x{{E000}}\x{{E001}}]+'), lambda x: {restored('x')})"


def words_punct(text: str) -> str:
    marked = text
    for _ in range(2):  # neighbours share the character between them
        for quote, mark in (("''", A1), ("’", A2)):
            marked = f"regexp_replace({marked}, '{quote}({GLUED})($|[^{ALNUM}])', {mark} || '\\1\\2', 'g')"
    return rf"list_transform(regexp_extract_all({marked}, '[\x{{E000}}\x{{E001}}][a-z]+|[{ALNUM}]+|[^{ALNUM}{SPACES}]'), lambda x: {restored('x')})"


WORDS = f"WITH t AS (SELECT doc_id, {words('lower(text)')} AS w FROM documents), words AS (SELECT doc_id, i AS pos, w[i] AS word FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)) "
LINES = "lines AS (SELECT doc_id, i AS item_seq, x AS line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents), LATERAL (SELECT unnest(range(0, len(l))) AS i), LATERAL (SELECT l[i + 1] AS x))"
TOKENS = f"toks AS (SELECT doc_id, item_seq, list_transform({words_punct('line')}, lambda x: lower(x)) AS w FROM lines)"
CUT = (
    "cut AS (SELECT doc_id, item_seq, coalesce(list_position(list_transform(w, lambda x: strlen(x) > 25), true), 0) AS p, w FROM toks), "
    "held AS (SELECT doc_id, item_seq, p > 0 AS overflow, CASE WHEN p > 0 THEN w[1:p - 1] ELSE w END AS w FROM cut)"
)
LEXEME = f"CASE WHEN contains(x, 'mathformula') THEN 'mathformula' WHEN contains(x, 'citationelement') THEN 'citationelement' WHEN regexp_matches(x, '{NUMERIC}') THEN 'NUM' ELSE x END"
STOP = "(VALUES " + ", ".join(f"({quoted(w)})" for w in sorted(STOPWORDS)) + ") AS s(word)"


def gram(n: int) -> str:
    return WORDS + (
        f"SELECT ngram, count(*) AS frequency FROM (SELECT array_to_string(w[i:i + {n - 1}], ' ') AS ngram FROM t, LATERAL (SELECT unnest(range(1, len(w) - {n - 2})) AS i)) GROUP BY ngram"
    )


FIRST = "firsts AS (SELECT word, row_number() OVER (ORDER BY min((doc_id, pos))) AS first_index, count(*) AS frequency FROM words GROUP BY word)"


def translit(text: str) -> str:
    out = f"translate({text}, {quoted(''.join(TRANSLIT_ONE))}, {quoted(''.join(TRANSLIT_ONE.values()))})"
    for a, b in TRANSLIT_MANY.items():
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return rf"regexp_replace({out}, '[^\x00-\x7F]', '', 'g')"


def language() -> str:
    hits = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(map(quoted, ws.split()))}], x))) AS {k}" for k, ws in LANGUAGE_WORDS.items())
    names = list(LANGUAGE_WORDS)
    best = f"greatest({', '.join(names)})"
    case = " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in names)
    return (
        f"WITH t AS (SELECT doc_id, text, {words('lower(text)')} AS w FROM documents), h AS (SELECT doc_id, text, {hits} FROM t), "
        r"l AS (SELECT *, len(regexp_replace(plain, '[^\p{L}]', '', 'g')) AS letters, len(regexp_replace(plain, '[^\p{Latin}]', '', 'g')) AS latin FROM (SELECT *, regexp_replace(text, 'mathformula|CitationElement|REF', ' ', 'g') AS plain FROM h)) "
        f"SELECT doc_id, CASE WHEN {best} > 0 THEN CASE {case} END END AS language, coalesce(letters = 0 OR latin > 0.5 * letters, true) AS is_latin FROM l"
    )


STRIPPED = r"regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '<x-raw>', 'g')"
TAGS = (
    rf"WITH tags AS (SELECT page_id, unnest(regexp_extract_all({STRIPPED}, '<[A-Za-z][^>]*>')) AS tag FROM pages UNION ALL "
    r"SELECT page_id, unnest(regexp_extract_all(html, '<(?:script|style)\b[^>]*>')) FROM pages), "
    r"names AS (SELECT page_id, tag, lower(regexp_extract(tag, '^<([A-Za-z0-9]+)', 1)) AS name FROM tags WHERE tag <> '<x-raw>') "
)
ATTRS = TAGS + (
    r", attrs AS (SELECT name, lower(regexp_extract(a, '([A-Za-z-]+)=', 1)) AS a, regexp_extract(a, '\"(.*)\"', 1) AS v FROM names, LATERAL (SELECT unnest(regexp_extract_all(tag, '[A-Za-z-]+=\"[^\"]*\"')) AS a)), "
    "keys AS (SELECT name AS key FROM names UNION ALL SELECT name || '@' || a FROM attrs UNION ALL SELECT name || '@' || a || '[' || x || ']' FROM (SELECT name, a, "
    r"unnest(list_filter(regexp_split_to_array(v, '\s+'), lambda x: x <> '')) AS x FROM attrs WHERE a NOT IN ('id', 'xref', 'alttext', 'href', 'altimg'))) "
    "SELECT key, count(*) AS frequency FROM keys GROUP BY key"
)


def heading_label(rows: str) -> str:
    """Structural labels of rows (doc_id, heading): reductions until nothing changes, by recursion,
    and then the first rule that fits."""
    steps = [
        (labels.ROMAN, ""), (labels.NUMBER, " "), (labels.LETTER_FIRST, ""), (labels.LETTER_LAST, ""), (rf"^({'|'.join(labels.PHRASE_FIRST)})\s", ""),
        (rf"\s({'|'.join(labels.WORD_LAST)})$", ""), (rf"({labels.PLURALS})s(?:\s|$)", r"\1"),
    ]
    reduced = "h"
    for pattern, new in steps:
        reduced = f"regexp_replace(trim({reduced}, ' '), {quoted(pattern)}, {quoted(new)}, 'g')"
    rules = [f"WHEN h = {quoted(a)} THEN {quoted(b)}" for a, b in labels.EXACT]
    rules += [f"WHEN {test}(h, {quoted(a)}) THEN {quoted(b)}" for test, table in (("starts_with", labels.STARTS), ("suffix", labels.ENDS)) for a, b in table]
    return (
        f"WITH RECURSIVE t AS ({rows}), r AS (SELECT doc_id, heading, lower(heading) AS h, 0 AS i FROM t UNION ALL SELECT doc_id, heading, {reduced}, i + 1 FROM r WHERE {reduced} <> h), "
        "last AS (SELECT doc_id, heading, arg_max(h, i) AS h FROM r GROUP BY doc_id, heading), "
        f"named AS (SELECT doc_id, heading, CASE {' '.join(rules)} ELSE h END AS name FROM last) "
        f"SELECT doc_id, heading, CASE WHEN name IN ({', '.join(map(quoted, labels.STRUCTURAL))}) THEN name ELSE 'other' END AS label FROM named"
    )


def headed(headings: list[tuple[str, str]]) -> str:
    """(doc_id, heading) of documents, as the query makes them up."""
    n = len(headings)
    head = f"[{', '.join(quoted(h) for h, _ in headings)}][doc_id % {n} + 1]"
    return (
        f"SELECT doc_id, CASE doc_id // {n} % 3 WHEN 0 THEN head WHEN 1 THEN head || word || ' ' ELSE word || ' ' || head END AS heading "
        f"FROM (SELECT doc_id, {head} AS head, coalesce({words('lower(text)')}[1], '') AS word FROM documents)"
    )


def golden(column: str, pairs: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"({quoted(a)}, {quoted(b) if b is not None else 'NULL'})" for a, b in pairs)
    return f"SELECT {column}, label FROM (VALUES {rows}) AS t({column}, label)"


def compat_ngrams(texts: str, anchor: str, reach: int, n: int) -> str:
    """n-grams around an anchor as the reading automaton records them, by the places of anchors.

    The ring of words is emptied at every anchor and where an anchor's right side is full, ``reach``
    words on; a run goes from there, or from ``reach`` words back, up to the anchor, if no other anchor
    stands within its right side. The text's end closes a last run."""
    return (
        rf"WITH t AS (SELECT row_number() OVER () AS id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}]')) AS w FROM ({texts})), "
        f"p AS (SELECT id, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = '{anchor}')) AS pos FROM t), "
        "a AS (SELECT id, pos, lag(pos) OVER o AS prev, lead(pos) OVER o AS next FROM p WINDOW o AS (PARTITION BY id ORDER BY pos)), "
        f"sided AS (SELECT *, greatest(coalesce(CASE WHEN pos - prev > {reach} THEN prev + {reach} ELSE prev END, 0) + 1, pos - {reach - 1}) AS low FROM a), "
        f"runs AS (SELECT id, low, pos AS high FROM sided JOIN t USING (id) WHERE pos + {reach} <= len(w) AND coalesce(next > pos + {reach}, true) "
        f"UNION ALL SELECT t.id, CASE WHEN pos IS NULL THEN greatest(1, len(w) - {reach - 1}) WHEN pos + {reach} <= len(w) THEN greatest(pos + {reach + 1}, len(w) - {reach - 1}) ELSE low END, len(w) "
        "FROM t LEFT JOIN sided ON sided.id = t.id AND next IS NULL) "
        f"SELECT ngram, count(*) AS frequency FROM (SELECT array_to_string(w[i:i + {n - 1}], ' ') AS ngram FROM runs JOIN t USING (id), LATERAL (SELECT unnest(range(low, high - {n - 2})) AS i)) GROUP BY ngram"
    )


def by_queries(headings: list[tuple[str, str]], classes: list[tuple[str, str]], anchor: str, reach: int) -> dict[str, str]:
    token_model = f"WITH {LINES}, {TOKENS}, {CUT} SELECT doc_id, item_seq, array_to_string(list_transform(w, lambda x: {LEXEME} || ' '), '') AS text FROM held WHERE NOT overflow"
    # Raw elements and comments hold no elements, but a raw element's own tag counts.
    bare = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'g')"
    return {
        # Flattening transliterates.
        "lifted_token_model": token_model.replace(words_punct("line"), words_punct(translit("line"))),
        "citation_ngrams": compat_ngrams(f"SELECT text FROM ({token_model}) WHERE contains(text, '{anchor}')", anchor, 15, 4),
        "anchored_ngrams_compat": compat_ngrams("SELECT text FROM documents", anchor, reach, 2),
        "node_model": rf"SELECT page_id AS doc_id, array_to_string(list_transform(regexp_extract_all({bare}, '<[A-Za-z][^>]*>'), lambda tag: lower(regexp_extract(tag, '^<([A-Za-z0-9]+)', 1)) || "
        r"coalesce('_' || nullif(regexp_extract(tag, 'class=\"([^\"]*)\"', 1), ''), '')), ' ') AS text FROM pages",
        "declaration_markers": "WITH c AS (SELECT coalesce(sum((length(text) - length(replace(text, ' of ', ''))) // 4), 0)::BIGINT AS n FROM documents) "
        "SELECT name, tags, n AS frequency FROM c, (VALUES ('declaration', 'universal'), ('formula', ''), ('restriction', ''), ('identifier', '')) AS m(name, tags) WHERE n > 0",
        "unigram_counts": WORDS + "SELECT word, count(*) AS frequency FROM words GROUP BY word",
        "stream_unigram_counts": WORDS + "SELECT word, count(*) AS frequency FROM words GROUP BY word",
        "words_punct_counts": f"SELECT word, count(*) AS frequency FROM (SELECT unnest({words_punct('text')}) AS word FROM documents) GROUP BY word",
        "stopword_filtered_counts": WORDS + f"SELECT word, count(*) AS frequency FROM words ANTI JOIN {STOP} USING (word) GROUP BY word",
        "stopword_counts": WORDS + f"SELECT word, count(*) AS frequency FROM words SEMI JOIN {STOP} USING (word) GROUP BY word",
        "numeric_normalised_tokens": WORDS
        + f", low AS (SELECT regexp_replace(word, '[^{ALNUM}]', '', 'g') AS x FROM words) SELECT {LEXEME} AS lexeme, count(*) AS frequency FROM low WHERE strlen(x) <= 25 AND x <> '' GROUP BY 1",
        "numeric_literals": f"SELECT regexp_matches(x, '{NUMERIC}') AS numeric, count(*) AS n FROM (SELECT CAST(l_quantity AS INTEGER)::VARCHAR || l_returnflag AS x FROM lineitem UNION ALL SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem) GROUP BY 1",
        "overflow_paragraphs": f"WITH {LINES}, {TOKENS}, {CUT} SELECT doc_id, item_seq FROM held WHERE overflow",
        "token_model": token_model,
        "token_model_counters": f"WITH {LINES}, {TOKENS}, {CUT}, tok AS (SELECT unnest(w) AS x FROM held), kinds AS (SELECT {LEXEME} AS k, x FROM tok) "
        "SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(*) FROM held) AS paragraph_count, "
        "count(*) FILTER (WHERE NOT contains(x, 'mathformula') AND k NOT IN ('citationelement', 'NUM')) AS word_count, (SELECT count(*) FROM held WHERE overflow) AS overflow_count, "
        "count(*) FILTER (WHERE contains(x, 'mathformula')) AS formula_count, count(*) FILTER (WHERE k = 'citationelement') AS citation_count, count(*) FILTER (WHERE k = 'NUM') AS num_count FROM kinds",
        "conversation_token_model": f"WITH toks AS (SELECT conv_id AS doc_id, turn AS item_seq, list_transform({words_punct('text')}, lambda x: lower(x)) AS w FROM conversations), {CUT} "
        f"SELECT doc_id AS conv_id, item_seq AS turn, array_to_string(list_transform(w, lambda x: {LEXEME} || ' '), '') AS text FROM held WHERE NOT overflow",
        "dictionary_first_index": WORDS + f", {FIRST} SELECT word, first_index FROM firsts",
        "inorder_frequency": WORDS + f", {FIRST} SELECT word, first_index, frequency FROM firsts",
        "freq_of_freq": WORDS + "SELECT frequency, count(*) AS words FROM (SELECT count(*) AS frequency FROM words GROUP BY word) GROUP BY frequency",
        "frequency_scatter": WORDS + "SELECT frequency AS x, round(log2(count(*)), 6) AS log2_y FROM (SELECT count(*) AS frequency FROM words GROUP BY word) GROUP BY frequency",
        "bigram_counts": gram(2),
        "fourgram_counts": gram(4),
        "anchored_ngrams_window": "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: regexp_matches(x, '^[\\p{L}\\p{N}]')) AS w FROM documents), "
        f"p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN w[i] = '{anchor}' THEN i END AS a FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)), "
        "near AS (SELECT doc_id, i, word, max(a) OVER (PARTITION BY doc_id ORDER BY i) AS before, min(a) OVER (PARTITION BY doc_id ORDER BY i DESC) AS after FROM p), "
        f"kept AS (SELECT *, coalesce(i - before <= {reach}, false) OR coalesce(after - i <= {reach}, false) AS ok FROM near), "
        "pairs AS (SELECT word || ' ' || lead(word) OVER w AS ngram, ok AND lead(ok) OVER w AS inside FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY i)) "
        "SELECT ngram, count(*) AS frequency FROM pairs WHERE inside GROUP BY ngram",
        "pre_link_words": "WITH parts AS (SELECT string_split(text, ' of ') AS p FROM documents), t AS (SELECT unnest(p[1:len(p) - 1]) AS x FROM parts), "
        f"w AS (SELECT lower(regexp_extract(regexp_replace(x, '[{SPACES}]+$', ''), '([{ALNUM}]+)$', 1)) AS word FROM t) SELECT word, count(*) AS frequency FROM w WHERE word <> '' GROUP BY word",
        "paragraph_dedup_sha": f"WITH {LINES} SELECT sha256(line) AS sha256, count(*) AS copies FROM lines GROUP BY 1",
        "whitespace_norm": f"SELECT doc_id, regexp_replace(regexp_replace(text, '[{SPACES}]+', ' ', 'g'), '^ ', '') AS text FROM documents",
        "unicode_translit": f"SELECT doc_id, {translit('text')} AS text FROM documents",
        "rebuild_text": r"SELECT doc_id, array_to_string(list_transform(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: regexp_replace(x, '(?:(?:NUM|\S+_\S+)(?:\s+|$))+', 'mathformula ', 'g')), lambda x: translate(x[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || x[2:]), ' . ') AS text FROM documents",
        "language_gate": language(),
        "node_catalog": TAGS + r"SELECT name || coalesce('_' || nullif(regexp_extract(tag, 'class=\"([^\"]*)\"', 1), ''), '') AS node, count(*) AS frequency FROM names GROUP BY 1",
        "attr_catalog": ATTRS,
        "count_histogram": TAGS + ", c AS (SELECT pages.page_id, count(name) AS elements FROM pages LEFT JOIN names ON names.page_id = pages.page_id AND name = 'p' GROUP BY 1) SELECT elements, count(*) AS documents FROM c GROUP BY 1",
        "structural_labels": heading_label(headed(headings)),
        "ams_env_labels": golden("class_attr", classes),
    }
