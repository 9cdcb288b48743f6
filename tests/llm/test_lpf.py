import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import lpf_dedup as lpf
from tests.llm.fixtures import prose, table


def brute(rows):
    big = 1 << 63
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, big), big if i is None else i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (big if i is None else i):
                gone[k : k + 50] = True
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def cases():
    rng = random.Random(7)
    base = prose(21, 60, 150, 300)
    passages = [" ".join(p.split()[:25]) for p in prose(22, 5, 60, 200)] + ["é" * 60, "the " * 40, "ab" * 100]
    rows = []
    for k, t in enumerate(base):
        w = t.split()
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = p.split(" ")
        rows.append((k, " ".join(w)))
    rows += [(100 + k, rows[k][1]) for k in range(10)]  # copies
    for k in range(20):  # near copies
        b = list(rows[k][1])
        for _ in range(3):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        rows.append((200 + k, "".join(b)))
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (None, None), (300, ""), (301, None), (302, "x" * 49), (303, "x" * 50), (304, "x" * 51), (305, "x" * 300), (1, "the " * 4000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("pack_bytes", [3000, 1 << 22])
def test_against_brute_force(spark, pack_bytes):
    rows = cases()
    got = lpf.lpf_dedup(table(spark, rows), with_kept=True, pack_bytes=pack_bytes).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("least", [1, 4])
@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors(seed, least):
    """The array against its definition: the longest prefix shared with a suffix of a smaller id."""
    rng = random.Random(seed)
    suffixes = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    ids = np.array([rng.randrange(3 + 40 * seed) for _ in suffixes])
    if seed == 5:  # long chains of candidates
        suffixes, ids = [b"aaaa" + b"%04d" % k for k in range(150)], np.array([*range(1, 150), 0])
    padded = np.frombuffer(b"".join(s.ljust(9, b"\0") for s in suffixes), np.uint8).reshape(-1, 9)
    order, lcp = lpf.suffix_order(padded, np.array(list(map(len, suffixes))))
    got = np.zeros(len(ids), np.int64)
    got[order] = lpf.longest_previous(ids[order], lcp, least)
    want = [max([common(s, t) for t, j in zip(suffixes, ids, strict=True) if j < i], default=0) for s, i in zip(suffixes, ids, strict=True)]
    assert got.tolist() == [w if w >= least else 0 for w in want]


def test_windows_of_one_minimiser_by_place(monkeypatch):
    """A hot minimiser is worked off place by place, with the same answers."""
    rng = random.Random(9)
    text = bytes(rng.choice(b"xyz") for _ in range(24))
    strings = [(bytes(rng.choice(b"ab") for _ in range(6)) * 3 + text + b"c" * 20 + b"%d" % (k % 7), 18, rng.randrange(50)) for k in range(300)]
    whole, parts = {}, {}
    lpf._window_masks(strings, whole)
    monkeypatch.setattr(lpf, "PART", 2)
    lpf._window_masks(strings, parts)
    assert whole == parts and any(whole.values()) and not all(whole.values())


def test_chunks_do_not_change_the_answer(spark, monkeypatch):
    text = " ".join(prose(33, 40, 200, 100))
    units = lpf.Units(lpf.pack(([1, 2], [text.encode(), b"z" + text[5:9000].encode()])))
    whole = {(a, b, c, h) for a, b, c, h in zip(*units.runs())}
    monkeypatch.setattr(lpf, "CHUNK", 1000)
    grams = lambda runs: {(t, c, h) for a, b, c, h in runs for t in range(a, b + 1)}
    assert grams(whole) == grams(zip(*units.runs()))


def test_nothing(spark):
    assert lpf.lpf_dedup(table(spark, [])).collect() == []
