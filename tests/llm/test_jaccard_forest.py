"""op4: rows that stay apart in a group are told as a forest, never as all pairs, and none of their links is lost."""

import random

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import jaccard_join as jj
from tests.llm.fixtures import table
from tests.llm.test_jaccard import Counter, brute


def near_copies(n, size=100, edits=2):
    """Each replaces its own words of one text; two of them are about as far apart as 0.8 allows."""
    rng, base = random.Random(6), [f"w{k}" for k in range(size)]
    out = []
    for k in range(n):
        words = list(base)
        at = rng.randrange(size - edits)
        for j in range(at, at + edits):
            words[j] = f"x{k}_{j}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("low, high", [(0, 0), (0, 1)])
def test_a_task_tells_fewer_pairs_than_rows(low, high):
    sets = jj.shingle_sets([t.encode() for t in near_copies(80)])
    block = np.arange(80) % 2 if low != high else np.zeros(80, int)
    rows = {"uid": range(80), "root": range(80), "n": [len(s) for s in sets], "block": block, "sketch": [jj.sketch(s) for s in sets], "low": [low] * 80, "high": [high] * 80}
    got = jj._left_forest(pa.table({k: list(v) for k, v in rows.items()})).to_pydict()
    may = lambda i, j: (low == high or block[i] != block[j]) and jj.possible(len(sets[i]), rows["sketch"][i], len(sets[j]), rows["sketch"][j])
    pairs = [(i, j) for i in range(80) for j in range(i) if may(i, j)]
    assert len(pairs) > 200 and len(got["a"]) < 80
    tree = list(range(80))
    for a, b in zip(got["a"], got["b"], strict=True):
        assert may(a, b)
        tree = [tree[a] if x == tree[b] else x for x in tree]
    assert all(tree[i] == tree[j] for i, j in pairs)


@pytest.mark.parametrize("block", [7, 512])
def test_near_copies_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "NEXT", 1)
    rows = [(k, t) for k, t in enumerate(near_copies(60) + near_copies(40, 150, 4))]
    got = jj.jaccard_join(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
