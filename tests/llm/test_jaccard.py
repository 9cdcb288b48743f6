import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.llm import jaccard_join as jj
from tests.llm.fixtures import lower, prose, table, words


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 63)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], (1 << 63) if i is None else i)
    return Counter((i, len(sets[k]), None if least[find(k)] == 1 << 63 else least[find(k)]) for k, (i, _) in enumerate(rows))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([["new%d" % rng.randrange(9999)], [], [w[k], "ins"]])
    return " ".join(w)


def cases():
    rng = random.Random(11)
    base = prose(31, 40, 300, 400) + ["a b c d e f", "a b c d e", "one two three", "x " * 300] + ["w%d " % k * 1 + " ".join(f"u{k}{j}" for j in range(k)) for k in range(4, 40, 3)]
    line = "this very common line stands in many of the documents here"
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        for e in range(4):
            rows.append((1000 + 10 * k + e, edited(rng, t, 1 + e * max(1, len(t.split()) // 60))))
    rows += [(5000 + k, t + " " + line) for k, t in enumerate(prose(41, 40, 30, 300))]
    chain = base[0].split(" ") + ["z%d" % j for j in range(200)]
    for k in range(30):  # neighbours link, ends do not
        chain = chain[6:] + ["c%d_%d" % (k, j) for j in range(6)]
        rows.append((9000 - k, " ".join(chain)))
    rows += [(7000, None), (7001, ""), (7002, " \t"), (None, base[1]), (None, "only null here now"), (None, None), (3, base[3]), (3, base[2]), (7003, base[1].replace("th", "TH"))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("pack_bytes", [4000, 1 << 22])
def test_against_brute_force(spark, pack_bytes):
    rows = cases()
    got = jj.jaccard_join(table(spark, rows), pack_bytes=pack_bytes).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_signatures_meet_wherever_sets_link():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        n = len(a)
        drop = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jj.signatures(a), jj.signatures(b))), (len(a), len(b), both)


def test_every_band_keeps_the_promise():
    for b in range(40):
        h, m, spare, small = jj.scheme(b)
        assert m == h + 1 + spare and h // (h // 2 + 1) <= 1
    for s in range(1, 2000):
        for r in (s, s * 5 // 4):
            assert jj.band(r)[0] - jj.band(s)[0] in (0, 1)
            both = s if r > s else -(-80 * 2 * s // 180)
            assert r + s - 2 * both <= jj.scheme(jj.band(s)[0])[0] + (r == s)  # most differences of partners


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(500, 300), (300, 400), (400, 500)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.root for r in jj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[500] == got[400] == 300 and got[1099] == 1000


def test_tiny_sets_share_no_empty_signature():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 1, 2, 2, 3, 3)]
    found = np.concatenate([jj.signatures(s) for s in sets])
    assert len(np.unique(found)) == len(found)


def test_group_of_many_parts_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 3)
    rows = cases()
    got = jj.jaccard_join(table(spark, rows), buckets=3).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_nothing(spark):
    assert jj.jaccard_join(table(spark, [])).collect() == []
    got = jj.jaccard_join(table(spark, [(2, None), (1, "")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2)]
