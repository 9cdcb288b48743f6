"""Removal of repeated byte strings by longest previous factors.

Every byte that lies in a string of ``LENGTH`` bytes which also starts in a document
of a smaller id is removed: the first document keeps it. Strings are those of the
input and do not cross documents.

A suffix array of the whole corpus is never built. Every window of ``LENGTH`` bytes
has one minimiser, the least-hashed ``GRAM`` bytes in it (the leftmost among equals),
and equal windows have it at the same place. So consecutive windows with one
minimiser go together, as the string that they cover, and only windows of one
minimiser can be equal:

1. packs tell buckets the hashes of their minimisers, buckets answer which occur in
   two packs; text around all others is unique and goes no further;
2. the strings around shared minimisers go to the buckets, each distinct one of a
   pack once, with the smallest id that has it there;
3. a bucket puts the suffixes of the strings of one minimiser in suffix order, with the
   common prefixes of neighbours. The nearest suffixes before and after one that have a
   smaller id (the previous and next smaller positions) give its longest previous
   factor, the least common prefix on the way; from ``LENGTH`` on its window is a
   repetition. The answers go back and packs mark the bytes. A suffix ends with its
   string, so factors are known up to ``LONGEST`` bytes, more than is asked.

Defined results: a null text is empty; a null id is after every other, and null ids
do not precede each other; rows with equal id and text do not precede each other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialise
from folioscope.llm.packs import CELLS, LOW48, NO_ID, PACK_BYTES, bucket_count, bucket_of, cells, pack, pack_docs, pack_hashes, release, run_hashes, slices, sliding_min, tidy, unpack, unpack_hashes

LENGTH, GRAM = 50, 24
LONGEST = 2 * LENGTH - GRAM  # bytes that the windows of one minimiser cover at most
CHUNK = 1 << 16
SLICE = 1 << 19  # hashes of a bucket that are sorted at a time
PART = 8192  # strings whose windows are sorted together, or those of one minimiser
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on."""
    return run_hashes(data.astype(np.uint64) + np.uint64(1), size)


def _no_runs() -> tuple[np.ndarray, ...]:
    return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))


class Units:
    """The distinct texts of a pack, end to end, each with its smallest id."""

    def __init__(self, payload: bytes):
        self.ids, texts = unpack(payload)
        at: dict[bytes, int] = {}
        self.unit = [at.setdefault(t, len(at)) for t in texts]
        self.texts = list(at)
        self.least = np.full(len(at), NO_ID, np.int64)
        np.minimum.at(self.least, self.unit, np.array(self.ids, np.int64))
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(at))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = b"".join(self.texts)
        self.data = np.frombuffer(self.bytes, np.uint8)

    def runs(self) -> tuple[np.ndarray, ...]:
        """Windows that share a minimiser: first and last start, the minimiser's place, its hash."""
        total = len(self.data)
        if total < LENGTH:
            return _no_runs()
        inside = np.zeros(total + 1, np.int32)
        long = self.sizes >= LENGTH
        np.add.at(inside, self.starts[:-1][long], 1)
        np.add.at(inside, self.starts[:-1][long] + self.sizes[long] - LENGTH + 1, -1)
        inside = np.cumsum(inside, dtype=np.int32) > 0
        place_bits, out = np.uint64(17), []
        for low in range(0, total - LENGTH + 1, CHUNK):
            high = min(low + CHUNK, total - LENGTH + 1)
            h = gram_hashes(self.data[low : high + LENGTH - 1])
            order = (h >> place_bits << place_bits) | np.arange(len(h), dtype=np.uint64)
            at = (sliding_min(order, LENGTH - GRAM + 1) & np.uint64((1 << 17) - 1)).astype(np.int64)
            t = np.flatnonzero(inside[low:high])
            if not len(t):
                continue
            at = at[t]
            cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(t) != 1)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(t) - 1]])
            out.append((t[first] + low, t[last] + low, at[first] + low, h[at[first]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _no_runs()

    def told(self, buckets: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, dict[int, np.ndarray]]:
        """Runs, their buckets, and for each bucket the distinct hashes in order."""
        runs = self.runs()
        bucket = bucket_of(runs[3], buckets)
        order = np.argsort(bucket, kind="stable")
        keys, first = np.unique(bucket[order], return_index=True)
        parts = np.split(runs[3][order] & LOW48, first[1:]) if len(keys) else []
        return runs, bucket, {int(k): np.unique(p) for k, p in zip(keys, parts, strict=True)}

    def strings(self, buckets: int, flags: dict[int, bytes]) -> tuple[tuple[np.ndarray, ...], np.ndarray, list[tuple[bytes, int]], np.ndarray, np.ndarray, np.ndarray]:
        """Runs around shared minimisers: (runs, their unit, the distinct strings with the minimiser's offset, the string of each run, least id and bucket of each string)."""
        (t0, t1, at, h), bucket, told = self.told(buckets)
        unit = np.searchsorted(self.starts, t0, "right") - 1
        shared = np.zeros(len(t0), bool)
        for k, hashes in told.items():
            if k in flags:
                hit = np.unpackbits(np.frombuffer(flags[k], np.uint8), count=len(hashes)).astype(bool)
                rows = np.flatnonzero(bucket == k)
                shared[rows] = hit[np.searchsorted(hashes, h[rows] & LOW48)]
        order = np.lexsort((unit, h))  # shared inside the pack: one hash in two units
        same = (h[order][1:] == h[order][:-1]) & (unit[order][1:] != unit[order][:-1])
        shared |= np.isin(h, h[order][1:][same])
        rows = np.flatnonzero(shared)
        t0, t1, at, unit, bucket = t0[rows], t1[rows], at[rows], unit[rows], bucket[rows]
        seen: dict[tuple[bytes, int], int] = {}
        data = self.bytes
        which = np.fromiter((seen.setdefault((data[a : b + LENGTH], c - a), len(seen)) for a, b, c in zip(t0.tolist(), t1.tolist(), at.tolist(), strict=True)), np.int64, len(rows))
        least = np.full(len(seen), NO_ID, np.int64)
        np.minimum.at(least, which, self.least[unit])
        dealt = np.zeros(len(seen), np.int64)
        dealt[which] = bucket
        return (t0, t1), unit, list(seen), which, least, dealt


def suffix_order(suffixes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of rows of bytes, zeros after their sizes: ``lcp[k]`` is the common prefix of the k-th and the one before it."""
    keys = np.column_stack([suffixes, sizes.astype(np.uint8)])  # of rows that differ in zeros at their end the shorter one is first
    order = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
    rows, sizes = suffixes[order], sizes[order]
    apart = rows[1:] != rows[:-1]
    lcp = np.where(apart.any(axis=1), apart.argmax(axis=1), suffixes.shape[1])
    return order, np.concatenate([[0], np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))]).astype(np.int64)


def longest_previous(ids: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factor of each suffix in suffix order; one shorter than ``least`` counts as none.

    The factor of a suffix is shared with the nearest suffix before it or after it in
    this order that has a smaller id (the previous and the next smaller position). Both
    are found by jumps: from a candidate that is not smaller on to its own candidate.
    """
    out = np.zeros(len(ids), np.int64)
    for turn in (1, -1):
        own = ids[::turn]
        length = lcp if turn == 1 else np.concatenate([lcp[:1], lcp[:0:-1]])
        length = np.where(length >= least, length, 0)
        at, live = np.arange(-1, len(ids) - 1), np.flatnonzero(length)
        while len(live):
            c = at[live]
            more = own[c] >= own[live]
            live, c = live[more], c[more]
            at[live], length[live] = at[c], np.minimum(length[live], length[c])
            live = live[length[live] > 0]
        out = np.maximum(out, length[::turn])
    return out


def _tell(buckets: int):
    def run(batches):
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, told = Units(payload.as_py()).told(buckets)
                yield from cells(number, {k: pack_hashes(v) for k, v in told.items()}).to_batches()
                release()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """A bit for each hash of a cell: whether another pack has it as well."""
    told = [unpack_hashes(p.as_py()) for p in table.column("payload")]
    hit = [np.zeros(len(t), bool) for t in told]
    for ranges in slices(told, SLICE):
        values, n = np.unique(np.concatenate([t[a:b] for t, (a, b) in zip(told, ranges, strict=True)]), return_counts=True)
        for t, own, (a, b) in zip(told, hit, ranges, strict=True):
            own[a:b] = n[np.searchsorted(values, t[a:b])] > 1
    answers = [np.packbits(own).tobytes() for own in hit]
    return table.select(["pack", "bucket"]).append_column("payload", pa.array(answers, pa.binary()))


def _flags(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True))


def _send(buckets: int):
    def run(packs: pa.Table, flags: pa.Table) -> pa.Table:
        out = []
        for number, payload in zip(packs.column("pack").to_pylist(), packs.column("payload"), strict=True):
            _, _, strings, _, least, bucket = Units(payload.as_py()).strings(buckets, _flags(flags))
            dealt = {}
            for k in np.unique(bucket).tolist():
                rows = np.flatnonzero(bucket == k).tolist()
                dealt[k] = pack(([strings[i][0] for i in rows], [strings[i][1] for i in rows], least[rows].tolist()))
            out.append(cells(number, dealt))
        return pa.concat_tables(out) if out else cells(0, {})

    return run


def _judge(table: pa.Table) -> pa.Table:
    """For each string sent, a bit for each of its windows: whether it stands in a smaller id."""
    told = [unpack(p.as_py()) for p in table.column("payload")]
    least: dict[bytes, int] = {}
    place: dict[bytes, int] = {}
    for strings, offsets, ids in told:
        for s, o, i in zip(strings, offsets, ids, strict=True):
            if least.get(s, NO_ID) >= i:
                least[s] = i
            place[s] = o
    masks: dict[bytes, int] = {}
    part: list[tuple[bytes, int, int]] = []
    group: list[bytes] = []
    held = b""
    for s in [*sorted(place, key=lambda s: s[place[s] : place[s] + GRAM]), b""]:
        gram = s[place[s] : place[s] + GRAM] if s else b""
        if gram != held or not s:  # a part holds whole groups: only windows of one minimiser can be equal
            if len(group) > 1:
                part += [(x, place[x], least[x]) for x in group]
            if len(part) > PART or not s:
                _window_masks(part, masks)
                part = []
            group, held = [], gram
        group.append(s)
    answers = []
    for strings, _, ids in told:
        answers.append(pack([(1 << (len(s) - LENGTH + 1)) - 1 if least[s] < i else masks.get(s, 0) for s, i in zip(strings, ids, strict=True)]))
    return table.select(["pack", "bucket"]).append_column("payload", pa.array(answers, pa.binary()))


def _window_masks(strings: list[tuple[bytes, int, int]], masks: dict[bytes, int]) -> None:
    """Adds the bits of (string, place of its minimiser, least id): windows whose longest previous factor is as long as they."""
    if not strings:
        return
    sizes = np.fromiter((len(s) for s, _, _ in strings), np.int64, len(strings))
    ids = np.array([i for _, _, i in strings], np.int64)
    wide = 2 * LONGEST - LENGTH
    data = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s, _, _ in strings), np.uint8)
    suffix = np.lib.stride_tricks.sliding_window_view(data, LONGEST)
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(strings)), n)
    t = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    before = np.array([o for _, o, _ in strings], np.int64)[owner] - t  # equal windows have their minimiser at one place
    order = np.argsort(before, kind="stable")
    cuts = np.flatnonzero(np.diff(before[order])) + 1 if len(order) > 16 * PART else []
    hit = np.zeros(len(owner), bool)
    for rows in np.split(order, cuts):
        by, lcp = suffix_order(suffix[owner[rows] * wide + t[rows]], sizes[owner[rows]] - t[rows])
        hit[rows[by]] = longest_previous(ids[owner[rows]][by], lcp, LENGTH) >= LENGTH
    bits = np.add.reduceat(hit.astype(np.int64) << t, np.cumsum(n) - n)
    for (s, _, _), b in zip(strings, bits.tolist(), strict=True):
        masks[s] = b


def _remove(buckets: int, with_kept: bool):
    def run(packs: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        kind = told.column("kind").to_pylist()
        flags = _flags(told.filter(pa.array([k == 0 for k in kind], pa.bool_())))
        masks = _flags(told.filter(pa.array([k == 1 for k in kind], pa.bool_())))
        for payload in packs.column("payload"):
            units = Units(payload.as_py())
            (t0, t1), unit, strings, which, least, bucket = units.strings(buckets, flags)
            answer = [0] * len(strings)
            for k, payload_k in masks.items():
                for i, m in zip(np.flatnonzero(bucket == k).tolist(), unpack(payload_k), strict=True):
                    answer[i] = m
            full = np.fromiter(((1 << (len(s) - LENGTH + 1)) - 1 for s, _ in strings), np.int64, len(strings))
            mask = np.array(answer, np.int64)[which] if len(which) else np.zeros(0, np.int64)
            # The same string in a smaller id of this very pack counts as well.
            mask = np.where(units.least[unit] > least[which], full[which], mask) if len(which) else mask
            change = np.zeros(len(units.data) + 1, np.int32)
            whole = mask == (full[which] if len(which) else mask)
            np.add.at(change, t0[whole], 1)
            np.add.at(change, t1[whole] + LENGTH, -1)
            for i in np.flatnonzero(~whole & (mask != 0)).tolist():
                for t in range(int(t0[i]), int(t1[i]) + 1):
                    if int(mask[i]) >> (t - int(t0[i])) & 1:
                        change[t] += 1
                        change[t + LENGTH] -= 1
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            results = []
            for u, text in enumerate(units.texts):
                part = gone[units.starts[u] : units.starts[u + 1]]
                n = int(part.sum())
                kept = units.data[units.starts[u] : units.starts[u + 1]][~part].tobytes() if n else text
                spans = int(part[0]) + int((part[1:] & ~part[:-1]).sum()) if n else 0
                results.append((len(text), n, spans, kept))
            for i, u in zip(units.ids, units.unit, strict=True):
                n, removed, spans, kept = results[u]
                if i > units.least[u] and n >= LENGTH:
                    removed, spans, kept = n, 1, b""
                rows.append((None if i == NO_ID else i, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["kept"] * with_kept
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table({n: pa.array([r[j] for r in rows], kinds[j]) for j, n in enumerate(names)})

    return run


def lpf_dedup(docs: DataFrame, with_kept: bool = False, buckets: int | None = None, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and the remaining bytes if asked for."""
    packs = pack_docs(docs, pack_bytes)
    n = buckets or bucket_count(packs, pack_bytes)
    flags = materialise(packs.mapInArrow(_tell(n), CELLS).groupBy("bucket").applyInArrow(tidy(_shared), CELLS), "lpf-shared")
    sent = packs.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(tidy(_send(n)), CELLS)
    masks = materialise(sent.groupBy("bucket").applyInArrow(tidy(_judge), CELLS), "lpf-masks")
    told = flags.withColumn("kind", F.lit(0)).unionByName(masks.withColumn("kind", F.lit(1)))
    schema = SCHEMA + ", kept binary" * with_kept
    return packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(tidy(_remove(n, with_kept)), schema)
