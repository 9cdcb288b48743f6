import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from folioscope.llm import byte_bpe as bpe
from folioscope.llm import lattice_lm as lm
from folioscope.llm import license_templates as lt
from folioscope.llm import tiling
from tests.llm.fixtures import lower, prose, table, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  \n\t x", "it's 'S don't!'s", "é　  ü 中文字 🙂🙂", "<|endoftext|> a", "0" * 3000, "a " * 30000, "\x00\x1f\x85 x", "Ⅷ ½ ٣"]


def test_bpe_equals_the_library(spark):
    texts = ODD + prose(2, 30)
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "a b")]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    got = bpe.byte_bpe(table(spark, rows), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want
    assert bpe.byte_bpe(table(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def marginal(own, logs, word):
    """All spellings, one by one."""
    end, bare = math.exp(logs[own.END]), math.exp(logs[own.BARE])

    def rest(i):
        if i == len(word):
            return end
        out = sum(math.exp(logs[own.next[word[i:j]]]) * rest(j) for j in range(i + 1, len(word) + 1) if word[i:j] in own.next)
        if word[i] not in own.next:
            out += math.exp(logs[len(word[i].encode()) - 1]) * rest(i + 1)
        return out

    return bare * rest(0) + sum(math.exp(logs[own.first[word[:j]]]) * rest(j) for j in range(1, len(word) + 1) if word[:j] in own.first)


def test_forward_recursion_sums_all_spellings():
    own = lm.lattice(PIECES)
    logs = own.weights(own.start)
    for word in ["a", "the", "thon", "ération", "中x", "zq🙂z"]:
        total = own.forward(logs, *own.arcs([word]))[1][0]
        assert math.isclose(math.exp(total), marginal(own, logs, word), rel_tol=1e-9)
    assert math.isclose(np.exp(logs[own.begins]).sum(), 1)
    assert np.exp((logs - own.fixed)[~own.begins]).sum() == pytest.approx(1)
    counts = np.zeros(own.n)
    own.expect(logs, ["thon", "abcd"], np.array([2.0, 1.0]), counts)
    assert counts[own.begins].sum() == pytest.approx(3) and counts[own.END] == pytest.approx(3)


def test_long_words_take_the_same_sums():
    own = lm.lattice(PIECES)
    logs = own.weights(own.start)
    rng = random.Random(4)
    for size in (1, 5, 17, 300):
        word = "".join(rng.choice("theéan中🙂") for _ in range(size))
        assert own.marginal(logs, word) == pytest.approx(own.forward(logs, *own.arcs([word]))[1][0], rel=1e-9)


def test_a_word_of_megabytes_is_scored_in_bounded_memory():
    import tracemalloc

    own = lm.lattice(PIECES)
    logs = own.weights(own.start)
    word = "the" * 100_000
    tracemalloc.start()
    got = own.scores(logs, [word, "the"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and got[0] < 1000 * got[1] < 0
    assert got[0] / got[1] == pytest.approx(own.marginal(logs, "the" * 50_000) / got[1] * 2, rel=1e-3)


@pytest.mark.parametrize("pack_bytes", [2000, 1 << 22])
def test_lm_against_brute_force(spark, pack_bytes):
    texts = [None, "", "The the THE", "neverseenword", "é \x85 ü", "a " * 500, "z" * 3000, "nope" * 3000] + prose(3, 40, 80, 60)
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, "a b")]
    tokens = {k: [*words(lower(t)), None] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and crc32(str(i).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    want = Counter((i, held[k], len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n, round(sum(map(base, tokens[k])), 6)) for k, (i, _) in enumerate(rows))
    got = lm.lattice_lm(table(spark, rows), PIECES, pack_bytes=pack_bytes).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(-1e9 < r.score <= 0 for r in got)
    own, counts = lm.lattice(PIECES), np.zeros(lm.lattice(PIECES).n)
    for w in c:
        for i in range(0, len(w or ""), lm.LONG):
            own.expect(own.weights(own.start), [w[i : i + lm.LONG]], np.array([min(c[w], lm.DISCOUNT)]), counts)
    logs = own.weights(counts)

    def model(w):
        if w is None:
            return math.log10(c[None] / n)
        whole = math.log(max(c[w] - lm.DISCOUNT, 0) / n) if c[w] else -math.inf
        return np.logaddexp(whole, math.log(lm.DISCOUNT * (v - 1) / n) + own.marginal(logs, w)) / math.log(10)

    for r in got:
        assert r.score == pytest.approx(sum(map(model, tokens[len(rows) - 1 if r.doc_id is None else r.doc_id])), rel=1e-6)


def test_lm_of_nothing(spark):
    assert lm.lattice_lm(table(spark, []), PIECES).collect() == []


LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_base_phrases_against_brute_force(spark):
    texts = [None, "", "CC-BY cc by,cc by cc", "All Rights Reserved. all rights reserved", "xcc by", "general public  license\ncc by", "cc by " * 5000, "é cc by é", "general public"]
    got = lt.license_scan(table(spark, list(enumerate(texts)) + [(2, texts[2])])).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        w = LETTER_WORD.findall(lower(texts[r.doc_id]))
        places = [(i, label) for phrase, label in lt.PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def labels(text):
    automata = {k: lt.Automaton(v) for k, v in lt.TEMPLATES.items()}
    return set(filter(None, lt.scan(text, automata)[5].split(",")))


def test_templates_accept_only_the_mandatory_wording():
    assert labels("x Released under the MIT License. y") == {"mit"}
    assert labels("under MIT license") == {"mit"}
    assert labels("the MIT license") == set()  # without its mandatory "under"
    assert labels("Licensed under the terms of the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels("Licensed under the Apache License, Version 1.0.") == set()
    assert labels("licensed under the GNU General Public License, version 3 or (at your option) any later version") == {"gpl", "gpl-3.0"}
    assert labels("Copyright (c) 2020 Some One. All rights reserved") == {"copyright", "reserved"}
    assert labels("Copyright all rights reserved") == {"reserved"}  # the replaceable region takes one word at least
    assert labels("Copyright 1 2 3 4 5 6 7 8 9 all rights reserved") == {"reserved"}
    with pytest.raises(ValueError):
        lt.parse("<<beginOptional>> a")


def check_tiles(item, doc, tiles, least):
    used_i, used_d = set(), set()
    for i, d, n in tiles:
        assert n >= least and item[i : i + n] == doc[d : d + n]
        assert not used_i & set(range(i, i + n)) and not used_d & set(range(d, d + n))
        used_i |= set(range(i, i + n))
        used_d |= set(range(d, d + n))
    for i in range(len(item) - least + 1):  # nothing of the least size is left
        for d in range(len(doc) - least + 1):
            if item[i : i + least] == doc[d : d + least]:
                assert used_i & set(range(i, i + least)) or used_d & set(range(d, d + least))


def test_tiles_are_greedy_and_complete():
    rng = random.Random(4)
    for _ in range(300):
        item = [rng.randint(1, 4) for _ in range(rng.randint(3, 40))]
        doc = [rng.randint(0, 4) for _ in range(rng.randint(0, 60))] + item[: rng.randint(0, 40)]
        check_tiles(item, doc, tiling.tile(item, doc, 3), 3)
    long = list(range(1, 101))
    assert tiling.tile(long, [0, *long[50:], 0, *long[:50]]) == [(0, 52, 50), (50, 1, 50)]


def test_contamination_catches_reordered_passages(spark):
    items = [" ".join(t.split()[:40]) for t in prose(9, 40, 90, 500) if len(t.split()) >= 40][:6]
    a = items[0].split()
    half = len(a) // 2
    docs = prose(10, 10, 200, 400)
    rows = [(0, docs[0] + " " + items[1].replace("th", "TH").replace(" ", ", ") + " " + docs[1]), (1, " ".join(a[half:]) + ". -- " + docs[2] + " " + " ".join(a[:half])), (2, docs[3]), (3, None), (4, ""), (5, " ".join(a[: len(a) // 3])), (None, items[2])]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)] + [(97, None, 1), (98, "", 1), (99, "two words", 1)], "item_id long, text string, doc_id int")
    for size in (1, tiling.BLOCK_WORDS):  # one item a block, and all at once
        got = {(r.doc_id, r.item_id): r for r in tiling.contaminated(table(spark, rows), bench, block_words=size).collect()}
        assert set(got) == {(0, 1), (1, 0), (None, 2)}
        assert got[1, 0].n_tiles == 2 and got[1, 0].coverage == 1
        kept = tiling.clean(table(spark, rows), bench, block_words=size)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == table(spark, rows).columns
    assert tiling.contaminated(table(spark, []), bench).collect() == []
    assert tiling.contaminated(table(spark, rows), bench.limit(0)).collect() == []


def greedy(item, doc, least):
    """Greedy string tiling by its definition: the longest match of unmarked words, the first of equals, again and again."""
    used_i, used_d, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < least:
            return out
        used_i.update(range(i, i + n)), used_d.update(range(d, d + n))
        out.append((i, d, n))


def test_tiles_against_greedy_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        item = [rng.randint(1, 4) for _ in range(rng.randint(3, 40))]
        doc = [rng.randint(0, 4) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):  # pieces of the item in another order
            at, i = rng.randint(0, len(doc)), rng.randrange(len(item))
            doc[at:at] = item[i : i + rng.randint(3, 25)]
        assert tiling.tile(item, doc, 3) == greedy(item, doc, 3)


@pytest.mark.parametrize("extra", [0, 1])
def test_a_large_benchmark_is_joined_with_the_same_result(spark, extra):
    base = prose(71, 30, 120, 500)
    items = [(k, " ".join(t.split()[:30])) for k, t in enumerate(base[:12])] + [(50, "one two"), (51, None), (52, ""), (3, base[20]), (3, base[3]), (None, base[21])]
    rows = [(k, t) for k, t in enumerate(base)] + [(100, base[0].split(" ", 15)[-1] + " " + " ".join(base[0].split()[:15])), (101, "say ONE, two!"), (None, base[4]), (7, base[5]), (102, None), (103, "")]
    docs = table(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = Counter(map(tuple, tiling.contaminated(docs, bench).collect()))
    assert Counter(map(tuple, tiling.contaminated(docs, bench, block_words=extra * 40).collect())) == whole and len(whole) > 12
    key = lambda df: Counter((r.doc_id, r.text, r.n) for r in df.collect())
    assert key(tiling.clean(docs, bench, block_words=extra * 40)) == key(tiling.clean(docs, bench))
