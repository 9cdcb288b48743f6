"""Word hashes and slices by brute force."""

import random

import numpy as np
import pytest

from folioscope.llm import packs
from folioscope.llm.common import WORD_BYTES


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_hashed_words(monkeypatch, block):
    monkeypatch.setattr(packs, "WORD_BLOCK", block)
    rng = random.Random(3)
    texts = [b"", b" ", b"One", b" two  words\n", "é ü\tß".encode(), b"a" * 5000, b"\x00 \x01\x00", b"one ONE two"]
    texts += [bytes(rng.choice(b"ab \nXY") for _ in range(rng.randrange(60))) for _ in range(200)]
    h, sizes = packs.hashed_words(texts)
    words = [t.translate(WORD_BYTES).split(b" ") for t in texts]
    words = [[w for w in ws if w] for ws in words]
    assert sizes.tolist() == list(map(len, words)) and len(h) == sizes.sum()
    of = {}
    for w, x in zip((w for ws in words for w in ws), h.tolist()):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)
    assert len(packs.hashed_words([])[0]) == 0


def test_run_hashes():
    values = np.array([5, 1, 2, 3, 1, 2, 3, 9], np.uint64)
    for size in (1, 2, 3, 5, 8):
        got = packs.run_hashes(values, size).tolist()
        want = [tuple(values[i : i + size].tolist()) for i in range(len(values) - size + 1)]
        assert len(got) == len(want) and all((a == b) == (x == y) for a, x in zip(got, want) for b, y in zip(got, want))


def test_slices_cover_everything_once():
    rng = np.random.default_rng(1)
    arrays = [np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64)) for n in (0, 1, 500, 2000)]
    parts = list(packs.slices(arrays, 100))
    assert len(parts) > 20
    for k, a in enumerate(arrays):
        ranges = [p[k] for p in parts]
        assert ranges[0][0] == 0 and ranges[-1][1] == len(a) and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    for p in parts:  # equal hashes are in one slice of all arrays
        low = min((int(a[x]) for a, (x, y) in zip(arrays, p) if y > x), default=0)
        assert all(x == 0 or a[x - 1] < low or x == y for a, (x, y) in zip(arrays, p))
