"""n-grams of words that are dealt out as runs: the same counts, in fewer bytes."""

import random
from collections import Counter

from scriptorium.functions.lexical import words
from scriptorium.operators import ngrams
from scriptorium.plans import programs


def counted(texts, n):
    return Counter(" ".join(w[i : i + n]) for w in (t.lower().split() for t in texts if t) for i in range(len(w) - n + 1))


def test_dealt_ngrams(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "É", "on", "No", "the", "word", "drow", "x" * 200]) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    texts += [None, "", "a b c", "a b c d", "The sea " * 500, "on " * 300, texts[7], texts[7]]
    rows = spark.createDataFrame([(t,) for t in texts], "plaintext string")
    monkeypatch.setattr(ngrams, "TASK_BYTES", 2000)  # many tasks
    for n in (3, 4, 5):
        found = [tuple(r) for r in programs.item_ngrams(rows, n).collect()]
        assert len(found) == len(dict(found)) and dict(found) == counted(texts, n)


def test_a_run_keeps_the_bucket_of_its_ngrams(spark):
    text = " ".join(random.Random(6).choice(["one", "two", "three", "of"]) for _ in range(400))
    runs = spark.createDataFrame([(text,)], "x string").select(ngrams.stretches(words("x"), 4).alias("r")).first().r
    buckets: dict[str, set[int]] = {}
    for r in runs:
        for gram in counted([r.run], 4):
            buckets.setdefault(gram, set()).add(r.bucket)
    assert set(buckets) == set(counted([text], 4)) and all(len(b) == 1 for b in buckets.values())
    assert sum(counted([r.run for r in runs], 4).values()) == 397


def test_fourgrams_that_occur_once_are_not_shuffled_whole(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("aeioulnrst", k=rng.randrange(2, 9))) for _ in range(300)) for _ in range(60)]
    found = programs.item_ngrams(spark.createDataFrame([(t,) for t in texts], "plaintext string"), 4)
    assert found.count() == len(counted(texts, 4))  # compiles
    rows = found._jdf.queryExecution().toRdd()
    assert rows.count() == len(counted(texts, 4))
    stack, sent = [found._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            stack.append(node.plan())
        else:
            if name == "Exchange":
                sent += node.metrics().apply("dataSize").value()
            stack += [node.children().apply(i) for i in range(node.children().size())]
    # A row for each 4-gram takes over 8 times the text.
    assert 0 < sent < 6 * sum(map(len, texts))
