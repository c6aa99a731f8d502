"""Small tables with the awkward cases that every operator is held to."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(1)
    long = "\n".join(words(rng, 12) for _ in range(4000))
    base = words(rng, 60)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "  \n\t ", "en", None, 5),
        (None, base, None, "a", None), (None, words(rng, 40), "en", "b", 2), (6, "one", "en", "c", 3), (6, "one", "en", "c", 3),
        (7, long, "en", "a", len(long)), (8, long + " tail", "en", "a", len(long) + 5), (9, "Ünï côdé \U0001f600 " + base, "fr", "é", 9), (-5, words(rng, 30), "en", "z", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns named as operators name their own."""
    from pyspark.sql import functions as F

    names = ["_k", "c0", "c1", "fp", "score", "predicted", "starts", "_found", "new", "n_lines", "runs", "component_id", "odd name.x", "_text"]
    return awkward.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def components(nodes, links):
    """The smallest node that each is tied to."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
