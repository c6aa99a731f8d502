import random

from scriptorium.llm import paragraphs

from .conftest import DOCS, words


def test_each_removed_word_has_a_kept_copy(spark):
    """The first document holds half of a license; the other half stays once. So do chains."""
    rng = random.Random(21)
    text = lambda n: words(rng, n, 1_000_000)
    one, two, three, four = text(120), text(120), text(120), text(120)
    parts = [one, f"{one} {two}", f"{one} {two}", three, f"{three} {four}", f"{three} {four}", four]
    rows = [(i, f"{text(80)} {p} {text(80)}", None, None, None) for i, p in enumerate(parts)]
    cut = {}
    for r in paragraphs.repeats(spark.createDataFrame(rows, DOCS)).where("kind = 'passage' and removed").collect():
        cut.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    kept = {w for i, text, *_ in rows for j, w in enumerate(text.split()) if j not in cut.get(i, ())}
    assert set(" ".join([one, two, three, four]).split()) <= kept
    assert {2, 5, 6} <= set(cut) and min(len(cut[i]) for i in (2, 5)) > 200


def test_passages_to_the_word(spark):
    """Passages of 51 words in other surroundings are found and removed from their first word to their last."""
    rng = random.Random(22)
    text = lambda n: words(rng, n, 1_000_000)
    passages = [text(51) for _ in range(400)]
    rows, want = [], {}
    for i, p in enumerate(passages + passages):
        before = rng.randrange(0, 90)
        rows.append((i, f"{text(before)} {p} {text(rng.randrange(0, 90))}".strip(), None, None, None))
        want[i] = before
    found = {(r.doc_id, r.first_word): r.n_words for r in paragraphs.repeats(spark.createDataFrame(rows, DOCS)).where("kind = 'passage' and removed").collect()}
    assert set(found) <= {(i, want[i]) for i in range(400, 800)} and set(found.values()) == {51}
    assert len(found) >= 396  # one of several hundred has no two cuts
    firsts = {(i, want[i]) for i in range(400)}
    kept = paragraphs.repeats(spark.createDataFrame(rows, DOCS)).where("kind = 'passage' and not removed").collect()
    assert len(kept) == len(found) and all(any(r.doc_id == i and a <= r.first_word for i, a in firsts) for r in kept)
