import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat_windows as cw
from folioscope.llm import hash_ring as hr
from folioscope.llm import host_rules as rules
from tests.llm.fixtures import prose, table, words

ODD = [None, "", " \t\n", "a b c a b c a b c", "x\n\nx\nx y\n  \nx y\n", "# $ <|>" * 30, "é é   ü\x85ü", "w " * 70000]


def measured(text):
    text = text or ""
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    marked = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))


def test_measures_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(ODD + prose(1, 40, 200, 12))] + [(3, ODD[3]), (None, "a b")]
    got = rules.host_rules(table(spark, rows), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = measured(r["text"])
        assert tuple(r[m] for m in rules.MEASURES) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_bad_host_and_clean_host(spark):
    good = " ".join(f"w{i}" for i in range(80))
    noisy = good + " " + " ".join("####" for _ in range(1)) * 30
    rows = [(i, "too short", "bad") for i in range(60)] + [(100, good, "bad"), (101, noisy, "bad"), (102, noisy, None), (103, good, None)]
    rows += [(200 + i, good + f" {i}", "fine") for i in range(60)]
    got = {r["doc_id"]: r for r in rules.host_rules(table(spark, rows), ["doc_id"]).collect()}
    assert not got[100]["host_trusted"] and got[100]["kept"] and not got[101]["kept"]
    assert got[102]["kept"] and got[103]["kept"] and got[200]["host_trusted"]
    assert abs(got[100]["host_rate"] - 60 / 62) < 0.05


def test_rules_of_nothing(spark):
    assert rules.host_rules(table(spark, []), ["doc_id"]).collect() == []


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 1000])
def test_ring_is_balanced_and_gapless(spark, n):
    rows = [(i if i % 7 else i // 2, None if i % 11 == 0 else "té" * (i % 5)) for i in range(n)]
    got = hr.hash_ring(table(spark, rows)).collect()
    assert len(got) == n
    counts = Counter(r["shard"] for r in got)
    assert not n or max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    assert Counter((r["shard"], r["slot"]) for r in got) == Counter((s, k) for s, c in counts.items() for k in range(c))
    assert all(r["size"] >= 8 for r in got)


def test_ring_moves_little():
    rng = random.Random(5)
    loads = [rng.randint(20, 60) for _ in range(24 * 64)]

    def owner(shards):
        points = hr.ring(shards)
        cells = [c for c, _ in points]
        per = [0] * len(points)
        keys = [rng2 for rng2 in range(0, hr.CELLS, 3)]
        import bisect

        arcs = [bisect.bisect_left(cells, k) % len(points) for k in keys]
        rank = []
        for a in arcs:
            rank.append(per[a])
            per[a] += 1
        out = {}
        segments = {}
        for a, lo, hi, s, slot in hr.allocate(points, per, shards):
            segments.setdefault(a, []).append((lo, hi, s))
        for k, a, r in zip(keys, arcs, rank):
            out[k] = next(s for lo, hi, s in segments[a] if lo <= r < hi)
        return out

    assert sum(loads)
    a, b = owner(24), owner(25)
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert moved < 0.35  # all but 1/24 would move if rows were dealt anew


def brute(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    said = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
    learned = "".join(x or "" for _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(learned), sha(learned)


def conversations(spark):
    rng = random.Random(3)
    odd = ["", None, "\\", "\\n", "<|", "<\\|", "<|im_end|>\n<|im_start|>user\nx", "\\\\n|\\|", "a<", "🙂" * 900, "line\nline\r\n", "x" * 9000]
    rows = []
    for c in [*range(12), None]:
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and (c or 0) % 2 else rng.choice(["user", "assistant", "assistant", None, "ro\nle", "to<|ol"])
            rows.append((c, t if c != 5 else t // 3, role, rng.choice(odd + ["hello there " * rng.randint(1, 60)])))
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 9)) for t in range(3000)] + [(78, None, "system", "only")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, span int").repartition(5)


def test_windows_read_back(spark):
    rows, df = conversations(spark)
    got = {r["conv_id"]: r for r in cw.digest(cw.chat_windows(df, block=64)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == brute(turns), c


def test_windows_hold_budget_system_and_history(spark):
    _, df = conversations(spark)
    windows = cw.chat_windows(df)
    rows = windows.where("conv_id = 77").orderBy("window").collect()
    assert len(rows) > 20
    assert all(r["tokens"] <= cw.BUDGET for r in rows)
    assert rows[0]["n_context"] == 0 and all(r["n_context"] > 0 for r in rows[1:])
    heads = windows.where("conv_id = 3").orderBy("window").select(F.substring("text", 1, 18).alias("h")).collect()
    assert {r["h"] for r in heads} == {"<|im_start|>system"}


def test_windows_of_nothing(spark):
    assert cw.digest(cw.chat_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
