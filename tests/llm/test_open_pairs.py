import numpy as np
import pyarrow as pa

from scriptorium.llm import paragraphs


def test_tied_pairs_are_not_built(monkeypatch):
    """Once the stars tie a block, none of its pairs is built."""
    built, made = [], paragraphs._open_pairs

    def watched(groups, root):
        for pairs in made(groups, root):
            built.extend(pairs)
            yield pairs

    monkeypatch.setattr(paragraphs, "_open_pairs", watched)
    n = 50
    columns = {c: pa.array(np.zeros(n, np.int64)) for c in ("band", "x", "y", "side")}
    columns |= {"h": pa.array(np.arange(n)), "shingles": pa.array([np.arange(30)] * n, pa.list_(pa.int64()))}
    out = list(paragraphs._verified(iter([pa.RecordBatch.from_pydict(columns)])))
    assert sum(b.num_rows for b in out) == n - 1
    assert sum(map(len, built)) == 0
