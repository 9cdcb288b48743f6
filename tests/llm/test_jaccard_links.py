"""n_links of op4: the number of links, by brute force."""

from collections import Counter

import pytest

from folioscope.llm import jaccard_join as jj
from tests.llm.fixtures import table
from tests.llm.test_jaccard import cases, shingles


@pytest.mark.parametrize("block", [4, 512])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    near = " ".join(f"n{k}" for k in range(80))
    rows = cases() + [(20000 + k, near + f" tail{k}") for k in range(9)] + [(21000 + k, near + " tail0") for k in range(3)]
    sets = [shingles(t) for _, t in rows]
    want = Counter()
    for i, (doc, _) in enumerate(rows):
        want[doc, len(sets[i]), sum(bool(sets[i] and s) and j != i and 100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for j, s in enumerate(sets))] += 1
    got = jj.jaccard_join(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == want
