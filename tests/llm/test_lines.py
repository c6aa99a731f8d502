import random

import duckdb

from scriptorium.llm import lines

from .conftest import DOCS

LOW = -(2**63)
WHITE = " \t\n\r\x0b\x0c"


def brute(rows):
    """Texts without every line of a run that starts earlier too, in a smaller id or in the same
    document: of RUN lines, of fewer with LONG_WORDS words, or of a whole short document."""
    own, where = {}, {}
    for i, (key, text) in enumerate(rows):
        own[i] = [(j, x.strip(WHITE)) for j, x in enumerate((text or "").split("\n")) if x.strip(WHITE)]
        kept = own[i]
        for m in range(1, lines.RUN + 1):
            for s in range(len(kept) - m + 1):
                w = tuple(x for _, x in kept[s : s + m])
                if m < lines.RUN and sum(len(x.split()) for x in w) < lines.LONG_WORDS:
                    if m < len(kept):
                        continue
                    w = ("whole", *w)
                where.setdefault(w, []).append((key, i, s, m))
    gone = {i: set() for i in own}
    for places in where.values():
        low = min(p[0] for p in places)
        for key, i, s, m in places:
            if key > low or any(j == i and t < s for _, j, t, _ in places):
                gone[i] |= {j for j, _ in own[i][s : s + m]}
    out = []
    for i, (key, text) in enumerate(rows):
        kept = None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone[i])
        out.append((key, len(own[i]), len(gone[i]), str(kept)))
    return sorted(out)


def got(df):
    return sorted((LOW if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed, str(r.text)) for r in df.collect())


def rows_of(df):
    return [(LOW if r.doc_id is None else r.doc_id, r.text) for r in df.collect()]


def test_awkward(awkward, clashing, empty):
    assert got(lines.dedup_lines(awkward)) == brute(rows_of(awkward))
    out = lines.dedup_lines(clashing)
    assert out.columns == [*[c for c in clashing.columns if c != "n_lines"], "n_lines", "n_removed"]
    assert got(out) == brute(rows_of(clashing))
    assert lines.dedup_lines(empty).collect() == []


def test_random_runs(spark):
    rng = random.Random(7)
    pool = [f"line {i} of the pool" for i in range(25)] + ["", "  "]
    rows = [(rng.randrange(1000), "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 20))), None, None, None) for _ in range(120)]
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert got(lines.dedup_lines(docs)) == brute([r[:2] for r in rows])


def test_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tiny}/documents.parquet')")
    want = con.execute(f"select doc_id, n_lines, n_removed, text from ({lines.ORACLE})").fetchall()
    assert got(lines.op6(spark, tiny)) == sorted((a, b, c, str(d)) for a, b, c, d in want)


def test_stage(spark, clashing, tiny):
    out = lines.lines_stage(spark, clashing, tiny)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert out.where("n_chars <> length(text)").count() == 0


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Two texts without an id, and two of one id, lose nothing to each other's spans."""
    rng = random.Random(3)
    from .conftest import words

    run = "\n".join(words(rng, 5, 100_000) for _ in range(4))
    clean = "\n".join(words(rng, 6, 100_000) for _ in range(10))
    rows = [(k, t, None, None, None) for k in (None, 7) for t in (f"{run}\n{run}", clean, clean)] + [(1, run, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = got(lines.dedup_lines(docs))
    assert out == brute(rows_of(docs)) and [r[2] for r in out if r[1] == 10 and r[0] == LOW] == [0, 0]


def test_long_lines_and_short_documents(spark):
    rng = random.Random(17)
    from .conftest import words

    pool = [words(rng, n) for n in (1, 2, 5, 9, 11, 12, 19, 20, 21, 60) for _ in range(3)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 6))), None, None, 0) for i in range(80)]
    passage = words(rng, 55, 100_000)
    rows += [(100 + i, "\n".join([words(rng, 8, 100_000), passage, words(rng, 8, 100_000)]), None, None, 0) for i in range(3)]
    rows += [(200 + i, "one short text", None, None, 0) for i in range(3)]
    out = got(lines.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(6)))
    assert out == brute([r[:2] for r in rows])
    texts = {r[0]: r[3] for r in out}
    assert [passage in texts[100 + i] for i in range(3)] == [True, False, False]
    assert [texts[200 + i] for i in range(3)] == ["one short text", "", ""]
