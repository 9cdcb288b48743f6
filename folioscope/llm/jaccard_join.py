"""Exact n-gram Jaccard join by universe partition and pigeonhole.

A document's set is its distinct 5-word shingles (64-bit hashes). Sizes fall into
bands so that partners of 0.8 or more lie in one band or two neighbours; a document
is indexed in the scheme of its own band and in that of the band below.

In a scheme two partners differ in at most H tokens. Two allocations index a set, and
the cheaper one that keeps the promise is taken:

* the token universe is hashed into H + 1 + E segments and each non-empty segment is
  one signature. H differences leave E + 1 segments equal, so if one of the two sets
  has at most E empty segments, an equal one that is not empty is shared;
* the universe is hashed into H/2 + 1 segments; some segment differs in one token at
  most, and so its signature or one of its one-deletion neighbours is shared. This
  costs a signature for each token; it is taken for small sets, and besides the first
  by sets with more than E empty segments.

Signatures go packed to buckets, which find the groups that share one; the groups are
dealt again by their membership, so that each distinct one counts once. Groups are never
expanded into all pairs:

1. sets that are equal are one class at once;
2. each member of a group is compared with the best of its groups' first members:
   of those whose sizes and parity sketches (their differing bits are at most the
   differing tokens) leave 0.8 possible, that of the most shared signatures. The
   comparison is exact; components follow. A row that this leaves apart from others of a
   group is compared with its next best heads, a few, and components follow again;
3. in groups whose members are still in different components, sizes and sketches leave
   some pairs of different components possible. Of these each task tells a spanning forest,
   fewer edges than it has rows, never the pairs; the trees of all groups together then
   hold all of them. The rows of a tree are compared exactly, and what links joins the
   components, again as a forest. Groups and trees are dealt to blocks of about ``BLOCK``
   rows, each two in a task of their own. No link between components is lost;
4. links are counted inside components: the classes of one are dealt to blocks of about
   ``BLOCK``, each two blocks are compared exactly in a task of their own, and a link
   of two classes counts for each of their rows.

Defined results: a null or empty text, or one without words, has the empty set and
links with nothing; fewer words than five are one shingle; equal rows are one class;
a null id is after every other and its component is null only if no other id is in
it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialise
from folioscope.llm.packs import LOW48, NO_ID, ORDINAL_BITS, PACK_BYTES, bucket_count, bucket_of, hashed_words, mix, pack, pack_docs, pack_hashes, release, slices, tidy, unpack, unpack_hashes

WORDS = 5
SMALL = 64  # bands up to this size take the one-deletion allocation
BLOCK = 512  # rows of a group or component that are compared with as many others in one task
NEXT = 6  # further heads that a row is compared with before the pairs of its groups are
BLOCK_TOKENS = 1 << 20  # tokens of a block, about
SLICE = 1 << 19  # signatures of a bucket that are sorted at a time
SKETCH_WORDS = 8  # parity sketches have 512 bits at least
_B = np.uint64(0x9E3779B97F4A7C15)


def _combine(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` neighbours."""
    out = np.full(len(h) - size + 1, np.uint64(size))
    for j in range(size):
        out = out * _B + h[j : len(h) - size + 1 + j]
    return mix(out)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all texts are hashed and sorted together."""
    flat, sizes = hashed_words(texts)
    ends = np.cumsum(sizes)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for i in np.flatnonzero((sizes > 0) & (sizes < WORDS)).tolist():
        out[i] = _combine(flat[ends[i] - sizes[i] : ends[i]], int(sizes[i]))
    long = np.flatnonzero(sizes >= WORDS)
    if len(long):
        flat = flat[np.repeat(sizes >= WORDS, sizes)]
        owner = np.repeat(np.arange(len(long), dtype=np.int32), sizes[long])
        grams = np.concatenate([_combine(flat[k : k + (1 << 16) + WORDS - 1], WORDS) for k in range(0, len(flat) - WORDS + 1, 1 << 16)])
        inside = owner[: len(grams)] == owner[WORDS - 1 :]
        grams, owner = grams[inside], owner[: len(inside)][inside]
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
        grams, owner = grams[new], owner[new]
        cuts = np.searchsorted(owner, np.arange(1, len(long)))
        for i, part in zip(long.tolist(), np.split(grams, cuts), strict=True):
            out[i] = part
    return out


@cache
def band(size: int) -> tuple[int, int]:
    """(number, largest size) of the band of a size: a band ends at the largest partner of its smallest size."""
    number, low = 0, 1
    while True:
        high = low * 5 // 4
        if size <= high:
            return number, high
        number, low = number + 1, high + 1


@cache
def scheme(number: int) -> tuple[int, int, int, bool]:
    """Of a band: most differences H between a set of it and a partner of its size or more, segments, spare segments, whether its sets are small."""
    low, b = 1, 0
    while b < number:
        low, b = low * 5 // 4 + 1, b + 1
    high = low * 5 // 4
    h = high // 4  # a partner of s has 5/4 s tokens at most, and then holds all of s
    spare, m = 0, h + 1
    for _ in range(20):  # enough spare segments for almost every set of the band's smallest size
        empty = m * np.exp(-low / m)
        spare = int(np.ceil(empty + 3 * np.sqrt(empty)))
        m = h + 1 + spare
        if spare > h:
            break
    return h, m, spare, high <= SMALL


def _segments(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each token, order by segment, start of each filled segment in that order)."""
    segment = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    s = segment[order]
    return s, order, np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])


def signatures(tokens: np.ndarray) -> np.ndarray:
    """All signatures of a set, for the scheme of its band and the one below."""
    out = []
    number = band(len(tokens))[0]
    value = mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for b in {max(number - 1, 0), number}:
        h, m, spare, small = scheme(b)
        if not h:  # partners are equal: the whole set
            out.append(mix(value.sum(keepdims=True) + np.uint64((2 * b) ^ 0x5555)))
            continue
        few = small
        if not small:
            s, order, first = _segments(tokens, m)
            total = np.add.reduceat(value[order], first)
            out.append(mix(total + s[first] * _B + np.uint64(2 * b + 1)))
            few = m - len(first) > spare
        if few:
            m1 = h // 2 + 1
            s, order, first = _segments(tokens, m1)
            total = np.zeros(m1, np.uint64)
            total[s[first]] = np.add.reduceat(value[order], first)
            place = np.arange(m1, dtype=np.uint64)
            tag = np.uint64((2 * b) ^ 0x5555)
            out.append(mix(total + place * _B + tag))
            out.append(mix(total[s] - value[order] + s * _B + tag))
    return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens by their low bits, as many bits as tokens or more: folding halves gives a shorter sketch."""
    size = max(64 * SKETCH_WORDS, 1 << (len(tokens) - 1).bit_length() if len(tokens) else 0)
    bits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def fold(sketch_bytes: bytes, size: int) -> np.ndarray:
    bits = np.frombuffer(sketch_bytes, np.uint64)
    while len(bits) * 8 > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def possible(n: int, sketch_n: bytes, m: int, sketch_m: bytes) -> bool:
    """Whether sizes and sketches leave a similarity of 0.8: their differing bits are at most the differing tokens."""
    if 4 * max(n, m) > 5 * min(n, m):
        return False
    size = min(len(sketch_n), len(sketch_m))
    return 9 * int(np.bitwise_count(fold(sketch_n, size) ^ fold(sketch_m, size)).sum()) <= n + m


def _texts_and_sets(payload: bytes) -> tuple[list[int], list[np.ndarray]]:
    """Ids of a pack and the set of each row; equal texts share one."""
    ids, texts = unpack(payload)
    at: dict[bytes, int] = {}
    unit = [at.setdefault(t, len(at)) for t in texts]
    found = shingle_sets(list(at))
    return ids, [found[u] for u in unit]


SURVEY = "uid long, id long, n long, digest binary, sketch binary, pack long, bucket int, payload binary"


def _survey(buckets: int):
    """Of each row its uid, id, set size, 128 bits that stand for the set, and sketch; of each pack a cell of signatures for each bucket."""
    fields = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("pack", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in fields], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, sets = _texts_and_sets(payload.as_py())
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                uids = (np.int64(number) << ORDINAL_BITS) + np.arange(len(ids), dtype=np.int64)
                yield rows(uid=uids, id=ids, n=list(map(len, sets)), digest=digests, sketch=list(map(sketch, sets)))
                dealt = _dealt_signatures(sets, digests, buckets)
                keys = sorted(dealt)
                yield rows(pack=[number] * len(keys), bucket=keys, payload=[dealt[k] for k in keys])
                del sets, dealt
                release()

    return run


def _dealt_signatures(sets: list[np.ndarray], digests: list[bytes], buckets: int) -> dict[int, bytes]:
    hashes, owners, seen = [], [], set()
    for k, (tokens, digest) in enumerate(zip(sets, digests, strict=True)):
        if len(tokens) and digest not in seen:
            seen.add(digest)
            hashes.append(signatures(tokens))
            owners.append(np.full(len(hashes[-1]), k, np.uint32))
    if not hashes:
        return {}
    h, o = np.concatenate(hashes), np.concatenate(owners)
    bucket = bucket_of(h, buckets)
    order = np.lexsort((h & LOW48, bucket))
    keys, first = np.unique(bucket[order], return_index=True)
    parts = np.split(order, first[1:]) if len(keys) else []
    return {k: pack((pack_hashes(h[rows] & LOW48), o[rows].tobytes())) for k, rows in zip(keys.tolist(), parts, strict=True)}


def _meetings(buckets: int):
    """Memberships of two or more that share a signature, with the number of its signatures in a bucket, dealt by themselves."""

    def run(table: pa.Table) -> pa.Table:
        told = []
        for number, payload in zip(table.column("pack").to_pylist(), table.column("payload"), strict=True):
            h, o = unpack(payload.as_py())
            told.append((unpack_hashes(h), np.frombuffer(o, np.uint32), np.int64(number) << ORDINAL_BITS))
        found: dict[bytes, int] = {}
        for ranges in slices([t[0] for t in told], SLICE):
            h = np.concatenate([t[0][a:b] for t, (a, b) in zip(told, ranges, strict=True)])
            o = np.concatenate([t[1][a:b].astype(np.int64) + t[2] for t, (a, b) in zip(told, ranges, strict=True)])
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            first = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            shared = np.diff(first) > 1
            for a, b in zip(first[:-1][shared].tolist(), first[1:][shared].tolist(), strict=True):
                key = o[a:b].tobytes()
                found[key] = found.get(key, 0) + 1
        dealt: dict[int, list[tuple[bytes, int]]] = {}
        for key, weight in found.items():
            dealt.setdefault(xxhash.xxh3_64_intdigest(key) % buckets, []).append((key, weight))
        keys = sorted(dealt)
        return pa.table({"bucket": pa.array(keys, pa.int32()), "payload": pa.array([pack(dealt[k]) for k in keys], pa.binary())})

    return run


def _groups(table: pa.Table) -> pa.Table:
    """The rows (gid, weight, uid) of the distinct memberships of a bucket."""
    found: dict[bytes, int] = {}
    for payload in table.column("payload"):
        for key, weight in unpack(payload.as_py()):
            found[key] = found.get(key, 0) + weight
    sizes = np.fromiter((len(k) // 8 for k in found), np.int64, len(found))
    gid = (np.int64(table.column("bucket")[0].as_py()) << 40) + np.arange(len(found), dtype=np.int64)
    weight = np.fromiter(found.values(), np.int64, len(found))
    return pa.table({"gid": np.repeat(gid, sizes), "weight": np.repeat(weight, sizes), "uid": np.frombuffer(b"".join(found), np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), the root being the least node of its component.

    Roots hook on to the least root that an edge leads to, and chains are then
    shortened by jumping, until no edge joins two roots. Every round is written to
    the shared folder; nothing is gathered in the driver but whether edges are left.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        while True:  # jump to the root's root
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = roots.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            jumped = materialise(jumped, "roots")
            roots = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        across = edges.join(a, "a").join(b, "b").where("ra != rb").select(F.greatest("ra", "rb").alias("high"), F.least("ra", "rb").alias("low"))
        hooks = materialise(across.groupBy("high").agg(F.min("low").alias("low")), "hooks")
        if hooks.isEmpty():
            return roots
        roots = materialise(roots.join(hooks, roots["root"] == hooks["high"], "left").select("node", F.coalesce("low", "root").alias("root")), "roots")


def _fetch(packs: DataFrame, uids: DataFrame) -> DataFrame:
    """(uid, tokens) of the asked rows, from their packs."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        uids, sets = [], []
        if len(own) and len(asked):
            uids = asked.column("uid").to_pylist()
            texts = unpack(own.column("payload")[0].as_py())[1]
            sets = shingle_sets([texts[u & ((1 << ORDINAL_BITS) - 1)] for u in uids])
        return pa.table({"uid": pa.array(uids, pa.int64()), "tokens": pa.array([t.tobytes() for t in sets], pa.binary())})

    asked = uids.select("uid", F.shiftright("uid", ORDINAL_BITS).alias("pack")).distinct()
    return packs.groupBy("pack").cogroup(asked.groupBy("pack")).applyInArrow(tidy(run), "uid long, tokens binary")


def _linked(packs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose Jaccard similarity is 0.8 or more, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    pairs = materialise(pairs, "jaccard-pairs")  # read three times
    uids = pairs.select(F.explode(F.array("a", "b")).alias("uid"))
    sets = materialise(_fetch(packs, uids), "jaccard-sets")
    a = sets.select(F.col("uid").alias("a"), F.col("tokens").alias("x"))
    b = sets.select(F.col("uid").alias("b"), F.col("tokens").alias("y"))
    whole = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return materialise(whole.mapInArrow(run, "a long, b long"), "jaccard-links")


def _possible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")), strict=True)
        yield batch.filter(pa.array([possible(*r) for r in rows], pa.bool_())).select(["uid", "head", "w"])


def _left_forest(table: pa.Table) -> pa.Table:
    """Of the pairs of different components in two blocks of a group (or in one) that size and sketch leave possible, a spanning forest: it holds every row of such a pair."""
    uid, root, n, block = (table.column(c).to_numpy() for c in ("uid", "root", "n", "block"))
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    order = np.argsort(n, kind="stable")
    sketches = table.column("sketch").to_pylist()
    uid, root, n, block, sketches = uid[order], root[order], n[order], block[order], [sketches[i] for i in order]
    bits = np.stack([fold(x, 8 * SKETCH_WORDS) for x in sketches])
    tree, found = np.arange(len(uid)), []
    for i in range(len(uid) - 1):
        rest = slice(i + 1, np.searchsorted(n, n[i] * 5 // 4, "right"))
        meets = (root[rest] != root[i]) & (tree[rest] != tree[i])
        if low != high:
            meets &= block[rest] != block[i]
        hit = np.flatnonzero(meets) + i + 1
        apart = np.bitwise_count(bits[hit] ^ bits[i]).sum(axis=1).astype(np.int64)
        for j in hit[9 * apart <= n[hit] + n[i]].tolist():
            if tree[j] != tree[i] and possible(n[i], sketches[i], n[j], sketches[j]):
                tree[tree == tree[j]] = tree[i]
                found.append((uid[i], uid[j]))
    return _edges(found)


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([min(e) for e in found], pa.int64()), "b": pa.array([max(e) for e in found], pa.int64())})


def _paired(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows dealt to the blocks of their key, each with every block of it: (low, high) is a pair of blocks."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(key, "uid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Number of tokens that each set of ``x`` shares with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.int64)
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    step = 8192
    for k in range(0, len(both), step):
        part = both[k : k + step]
        marks = []
        for sets in (x, y):
            mark = np.zeros((len(sets), len(part)), np.float32)
            for i, tokens in enumerate(sets):
                inside = tokens[np.searchsorted(tokens, part[0]) : np.searchsorted(tokens, part[-1], "right")]
                at = np.searchsorted(part, inside)
                mark[i, at[part[at] == inside]] = 1
            marks.append(mark)
        out += (marks[0] @ marks[1].T).astype(np.int64)
    return out


def _count_links(table: pa.Table) -> pa.Table:
    """Rows that each class of two blocks of a component links with in the other block; in its own, if both are one."""
    uid, block, copies = (table.column(c).to_numpy() for c in ("uid", "block", "copies"))
    tokens = [np.frombuffer(t.as_py(), np.uint64) for t in table.column("tokens")]
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if not len(a) or not len(b):
        return pa.table({"uid": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    both = _shared([tokens[i] for i in a], [tokens[i] for i in b])
    sizes = np.array(list(map(len, tokens)), np.int64)
    linked = 100 * both >= 80 * (sizes[a][:, None] + sizes[b][None, :] - both)
    if low == high:
        np.fill_diagonal(linked, False)
        return pa.table({"uid": uid[a], "links": linked @ copies[b]})
    return pa.table({"uid": np.concatenate([uid[a], uid[b]]), "links": np.concatenate([linked @ copies[b], copies[a] @ linked])})


def _joining(table: pa.Table) -> pa.Table:
    """Links that join the components which stand in two blocks of rows (or in one): of all links between different ones a spanning forest."""
    uid, root, block = (table.column(c).to_numpy() for c in ("uid", "root", "block"))
    tokens = [np.frombuffer(t.as_py(), np.uint64) for t in table.column("tokens")]
    a, b = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("low", "high"))
    found: list[tuple[int, int]] = []
    if len(a) and len(b):
        both = _shared([tokens[i] for i in a], [tokens[i] for i in b])
        sizes = np.array(list(map(len, tokens)), np.int64)
        linked = 100 * both >= 80 * (sizes[a][:, None] + sizes[b][None, :] - both)
        tree = root.copy()
        for i, k in enumerate(a.tolist()):
            for j in b[linked[i] & (tree[b] != tree[k])].tolist():
                if tree[j] != tree[k]:
                    tree[tree == tree[j]] = tree[k]
                    found.append((uid[k], uid[j]))
    return _edges(found)


def _blocks() -> Column:
    """Number of blocks of ``c`` rows with ``total`` tokens."""
    return F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("total") / BLOCK_TOKENS))


def _apart(packs: DataFrame, forest: DataFrame, roots: DataFrame, profile: DataFrame) -> DataFrame:
    """(a, b): links that join all components between which there is a link among rows of one tree of ``forest``."""
    of = roots.select(F.col("node").alias("uid"), "root")
    rows = components(forest).select(F.col("node").alias("uid"), F.col("root").alias("tree")).join(of, "uid", "left").join(profile.select("uid", "n"), "uid")
    sizes = rows.groupBy("tree").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    rows = materialise(rows.join(sizes, "tree").withColumn("root", F.coalesce("root", "uid")).drop("n"), "jaccard-apart")
    held = _paired(rows.join(_fetch(packs, rows.select("uid")), "uid"), "tree", _blocks()).select("uid", "tree", "root", "block", "low", "high", "tokens")
    return held.groupBy("tree", "low", "high").applyInArrow(tidy(_joining), "a long, b long")


def _links(packs: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(uid, links) of every class's root: rows of other classes that it links with; ``classes`` has root, copies and n."""
    of = roots.select(F.col("node").alias("uid"), F.col("root").alias("component"))
    inside = classes.select(F.col("root").alias("uid"), "copies", "n").join(of, "uid")
    sizes = inside.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("total")).where("c > 1")
    inside = materialise(inside.join(sizes, "component").drop("n"), "jaccard-inside")
    held = inside.join(_fetch(packs, inside.select("uid")), "uid")
    held = _paired(held, "component", _blocks()).select("uid", "component", "copies", "block", "low", "high", "tokens")
    found = held.groupBy("component", "low", "high").applyInArrow(tidy(_count_links), "uid long, links long")
    return found.groupBy("uid").agg(F.sum("links").alias("links"))


def _mixed(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((gid, uid, root), (gid, number of rows) of the groups whose members are in different components)."""
    told = members.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("gid", "uid", F.coalesce("root", "uid").alias("root"))
    sizes = told.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"))
    return told, sizes.where("lo != hi").select("gid", "c")


def jaccard_join(docs: DataFrame, buckets: int | None = None, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows of 0.8 or more, equal sets included) of every row."""
    packs = pack_docs(docs, pack_bytes)
    count = buckets or bucket_count(packs, pack_bytes)
    survey = materialise(packs.mapInArrow(_survey(count), SURVEY), "jaccard-survey")
    profile = survey.where("uid is not null").select("uid", "id", "n", "digest", "sketch")
    classes = profile.where("n > 0").groupBy("digest").agg(F.min("uid").alias("root"), F.count("*").alias("copies"), F.first("n").alias("n"))
    classes = materialise(classes, "jaccard-classes")
    equal = profile.where("n > 0").join(classes.where("copies > 1"), "digest").select(F.col("root").alias("a"), F.col("uid").alias("b")).where("a != b")
    equal = materialise(equal, "jaccard-equal")

    signed = survey.where("payload is not null").select("pack", "bucket", "payload")
    met = signed.groupBy("bucket").applyInArrow(tidy(_meetings(count)), "bucket int, payload binary")
    members = met.groupBy("bucket").applyInArrow(tidy(_groups), "gid long, weight long, uid long")
    same = equal.select(F.col("b").alias("uid"), F.col("a").alias("of"))
    members = members.join(same, "uid", "left").select("gid", "weight", F.coalesce("of", "uid").alias("uid")).distinct()
    members = materialise(members, "jaccard-groups")

    # Best first member of each row.
    heads = members.groupBy("gid").agg(F.min("uid").alias("head"))
    star = members.join(heads, "gid").where("uid != head").groupBy("uid", "head").agg(F.sum("weight").alias("w"))
    a, b = (profile.select(F.col("uid").alias(k), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for k, x in (("uid", "a"), ("head", "b")))
    star = star.join(a, "uid").join(b, "head").select("uid", "head", "w", "na", "sa", "nb", "sb").mapInArrow(_possible_pairs, "uid long, head long, w long")
    star = materialise(star, "jaccard-star")
    best = star.groupBy("uid").agg(F.max(F.struct("w", -F.col("head"))).alias("m"))
    tried = materialise(best.select((-F.col("m.col2")).alias("a"), F.col("uid").alias("b")), "jaccard-best")
    links = _linked(packs, tried)
    roots = components(links)

    # Rows that their best head left apart: the next best ones, a few for each row.
    told, mixed = _mixed(members, roots)
    of = roots.select(F.col("node").alias("uid"), F.col("root").alias("r"))
    left = star.join(told.join(mixed, "gid", "left_semi").select("uid").distinct(), "uid", "left_semi").join(of, "uid", "left")
    left = left.join(of.select(F.col("uid").alias("head"), F.col("r").alias("q")), "head", "left").where(F.coalesce("r", "uid") != F.coalesce("q", "head"))
    left = left.select(F.col("head").alias("a"), F.col("uid").alias("b"), "w").join(tried, ["a", "b"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("w"), "a"))
    more = materialise(left.withColumn("nth", nth).where(F.col("nth") <= NEXT).select("a", "b"), "jaccard-next")
    links = materialise(links.unionByName(_linked(packs, more)), "jaccard-star-links")
    roots = components(links)

    # What is still apart inside a group.
    told, mixed = _mixed(members, roots)
    apart = _paired(told.join(mixed, "gid"), "gid", F.ceil(F.col("c") / BLOCK)).join(profile.select("uid", "n", "sketch"), "uid")
    forest = apart.groupBy("gid", "low", "high").applyInArrow(tidy(_left_forest), "a long, b long").distinct()
    forest = materialise(forest, "jaccard-forest")
    links = materialise(links.unionByName(_apart(packs, forest, roots, profile)), "jaccard-all-links")
    roots = components(links.unionByName(equal))

    counted = classes.join(_links(packs, classes, roots).withColumnRenamed("uid", "root"), "root", "left")
    counted = materialise(counted.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-counted")
    rows = profile.select("uid", "id", "n", "digest").join(roots.withColumnRenamed("node", "uid"), "uid", "left").join(counted, "digest", "left")
    rows = rows.withColumn("root", F.coalesce("root", "uid"))
    least = rows.groupBy("root").agg(F.min("id").alias("component"))
    rows = rows.join(least, "root")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "uid")
