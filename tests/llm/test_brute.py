"""Results of native operators and of templates by brute force."""

import random
import re
from collections import defaultdict

import pytest

from folioscope.llm import hash_ring as ring
from folioscope.llm import host_rules as rules
from folioscope.llm import license_templates as lt
from tests.llm.fixtures import prose, table


def test_prior_rates_and_verdicts(spark):
    rng = random.Random(5)
    good = prose(91, 60, 120, 3000)
    rows = []
    for k in range(300):
        host = rng.choice(["a", "b", "c", "spam", None, "once"] if k else ["once"])
        bad = {"a": 0.1, "b": 0.4, "c": 0.0, "spam": 0.9, None: 0.5, "once": 1.0}[host]
        text = "too short" if rng.random() < bad else good[k % 60] + " " + good[(k * 7 + 1) % 60]
        rows.append((k, text + rng.choice(["", " " + "# " * 40, "\nline of it" * 30]), host))
    got = rules.host_rules(table(spark, rows), ["doc_id", "source"]).collect()
    n, f = defaultdict(int), defaultdict(int)
    for r in got:
        n[r.source] += 1
        f[r.source] += r.base_failed
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    total = sum(n.values())
    mean = sum(f.values()) / total
    spread = sum(n[h] * (f[h] / n[h]) ** 2 for h in n) / total - mean * mean
    strength = max(2.0, min(1e6, mean * (1 - mean) / max(spread, 1e-9) - 1))
    text_of = {k: t for k, t, _ in rows}
    for r in got:
        rate = (f[r.source] + mean * strength) / (n[r.source] + strength)
        assert r.host_rate == pytest.approx(rate) and r.host_trusted == (rate <= rules.HOST_LIMIT)
        lines = [x for x in text_of[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        strict = 100 * r.n_repeat_words > 20 * r.n_words or 100 * r.n_symbols > 10 * r.word_chars or 100 * r.n_dup_lines > 30 * len(lines)
        assert r.kept == (not r.base_failed and (r.host_trusted or not strict))
    assert {r.host_trusted for r in got} == {True, False} and any(r.kept for r in got if not r.host_trusted)


def test_rows_walk_clockwise_one_by_one():
    """Segments against rows that walk round the ring step by step, each to the next point while its shard is full."""
    rng = random.Random(2)
    for _ in range(40):
        shards, vnodes = rng.randint(1, 6), rng.randint(1, 5)
        points = ring.ring(shards, vnodes, 64)
        loads = [rng.choice([0, 1, 2, 5, 40]) for _ in points]
        total = sum(loads)
        room = [total // shards + (s < total % shards) for s in range(shards)]
        where, pending = {}, [(a, k) for a in range(len(points)) for k in range(loads[a])]
        used = [0] * shards
        for step in range(len(points)):
            left = []
            for a, k in pending:
                shard = points[(a + step) % len(points)][1]
                if used[shard] < room[shard]:
                    where[a, k] = shard, used[shard]
                    used[shard] += 1
                else:
                    left.append((a, k))
            pending = left
        got = {(a, k): (shard, slot + k - first) for a, first, end, shard, slot in ring.allocate(points, loads, shards) for k in range(first, end)}
        assert got == where and len(got) == total and max(used) - min(used) <= 1


def filled(template, rng, optional):
    """A text that a template accepts: optional regions kept or not, variables replaced, layout and case changed."""
    out = []
    for x in lt.parse(template):
        if isinstance(x, bytes):
            out.append(x.decode())
        elif isinstance(x, tuple):
            out += [f"v{rng.randrange(99)}" for _ in range(rng.randint(*x))]
        elif optional:
            out += [w.decode() for w in x if isinstance(w, bytes)]
    return out


@pytest.mark.parametrize("label", sorted(lt.WHOLE))
def test_whole_licences(label):
    rng = random.Random(label)
    automata = {k: lt.Automaton(v) for k, v in (lt.TEMPLATES | lt.WHOLE).items()}
    for optional in (True, False):
        words = filled(lt.WHOLE[label], rng, optional)
        text = "Intro, of ours.\n * " + "".join(w.capitalize() + rng.choice([" ", ", ", "\n * ", ' "']) for w in words) + " end"
        found = lt.scan(text, automata)[5].split(",")
        assert label in found, (label, optional)
        must = {x.decode() for x in lt.parse(lt.WHOLE[label]) if isinstance(x, bytes)}
        at = rng.choice([k for k, w in enumerate(words) if w in must and words.count(w) == 1])
        assert label not in lt.scan(" ".join([*words[:at], "altered", *words[at + 1 :]]), automata)[5].split(",")


def test_a_template_of_regions_only_is_tried_everywhere():
    own = {"x": lt.Automaton("<<beginOptional>>alpha beta<<endOptional>> <<beginOptional>>gamma<<endOptional>>")}
    assert lt.scan("so alpha beta gamma it is", own)[5] == "x" and lt.scan("nothing here", own)[5] == "" and lt.scan(None, own)[5] == ""
