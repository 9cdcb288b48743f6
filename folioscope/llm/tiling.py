"""Benchmark decontamination by greedy string tiling.

Every document is compared with the test items with which it shares a seed, that is
``MIN_TILE`` consecutive words. Tiles are then marked greedily: the longest matches
of unmarked words first, found by running Karp-Rabin hashes, down to ``MIN_TILE``
words. The item's words under tiles over its words is its coverage; from
``COVERAGE`` on the document is taken to hold the item, in whatever order its
passages stand.

The size of the benchmark is looked up first. One of at most ``BLOCK_WORDS`` words is
sent to the tasks, where its seeds meet the documents' in one narrow pass. A larger one
is joined: seeds of items and of packs of documents meet in buckets by hash, and a pack
is sent only the items that share a seed with it, in blocks of ``BLOCK_WORDS`` words.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered, so that case and
punctuation do not hide a copy. Defined results: null or empty texts and items hold
nothing; an item of fewer than ``MIN_TILE`` words counts only as one tile; ties
between matches of one length go to the earliest item word, then document word;
repeated items give a row each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialise, quoted
from folioscope.llm.license_templates import LETTERS
from folioscope.llm.packs import CELLS, LOW48, NO_ID, bucket_count, bucket_of, cells, hashed_words, mix, pack, pack_docs, pack_hashes, release, run_hashes, tidy, unpack, unpack_hashes

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_WORDS = 1 << 20
_BASE, _MOD = 1_000_003, (1 << 61) - 1
SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, n_covered int, item_words int"


def tokens(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(LETTERS).split()


def _runs(marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``size`` unmarked places."""
    at = 0
    while at < len(marked):
        at = marked.find(0, at)
        if at < 0:
            return
        end = marked.find(1, at)
        end = len(marked) if end < 0 else end
        if end - at >= size:
            yield at, end
        at = end


def _hashes(ids: list[int], marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of each window of ``size`` unmarked words."""
    top = pow(_BASE, size - 1, _MOD)
    for low, high in _runs(marked, size):
        h = 0
        for i in range(low, high):
            h = (h * _BASE + ids[i]) % _MOD
            if i - low >= size - 1:
                yield i - size + 1, h
                h = (h - ids[i - size + 1] * top) % _MOD


def tile(item: list[int], doc: list[int], min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (item place, document place, length). Word ids are over 0; 0 in ``doc`` is a word the item lacks.

    Always the longest match of unmarked words is marked next. Matches of ``size`` words
    or more are found by running hashes; one of which a part is marked meanwhile goes
    back in line with what is left of it.
    """
    seen_i, seen_d = bytearray(len(item)), bytearray(x == 0 for x in doc)
    tiles: list[tuple[int, int, int]] = []
    size = max(min_tile, min(len(item), 20))
    while size >= min_tile:
        places: dict[int, list[int]] = {}
        for i, h in _hashes(item, seen_i, size):
            places.setdefault(h, []).append(i)
        line = []
        if places:
            for d, h in _hashes(doc, seen_d, size):
                for i in places.get(h, ()):
                    if i and d and not seen_i[i - 1] and not seen_d[d - 1] and item[i - 1] == doc[d - 1]:
                        continue  # part of a match that begins before
                    n = 0
                    while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not seen_i[i + n] and not seen_d[d + n]:
                        n += 1
                    if n >= size:
                        line.append((-n, i, d))
        heapq.heapify(line)
        while line:
            n, i, d = heapq.heappop(line)
            left = list(_unmarked(seen_i, seen_d, i, d, -n, size))
            if left == [(n, i, d)]:
                seen_i[i : i - n] = seen_d[d : d - n] = b"\1" * -n
                tiles.append((i, d, -n))
            else:
                for part in left:
                    heapq.heappush(line, part)
        size = size - 1 if size <= min_tile else max(min_tile, size // 2)
    return tiles


def _unmarked(seen_i: bytearray, seen_d: bytearray, i: int, d: int, n: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of at least ``size`` words of a match that are unmarked on both sides."""
    run = 0
    for k in range(n + 1):
        if k < n and not seen_i[i + k] and not seen_d[d + k]:
            run += 1
            continue
        if run >= size:
            yield -run, i + k - run, d + k - run
        run = 0


class Block:
    """An index of some items: word ids, and the items of each seed."""

    def __init__(self, items: list[tuple[int, str | None]], min_tile: int):
        self.ids: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.seeds: dict[tuple[int, ...], list[int]] = {}
        self.min_tile = min_tile
        self.least = min_tile
        self.widths: set[int] = set()
        for item_id, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in tokens(text)]
            if not words:
                continue
            width = min(min_tile, len(words))
            self.widths.add(width)
            self.least = min(self.least, width)
            for seed in {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}:
                self.seeds.setdefault(seed, []).append(len(self.items))
            self.items.append((item_id, words))

    def matches(self, text: str | bytes | None) -> Iterator[tuple]:
        get = self.ids.get
        ids = [get(w, 0) for w in tokens(text)]
        foreign = bytearray(map(0 .__eq__, ids))
        found: set[int] = set()
        for low, high in _runs(foreign, self.least):
            for width in self.widths:
                for i in range(low, high - width + 1):
                    found.update(self.seeds.get(tuple(ids[i : i + width]), ()))
        for k in sorted(found):
            item_id, words = self.items[k]
            own = set(words)
            tiles = tile(words, [x if x in own else 0 for x in ids], min(self.min_tile, len(words)))
            n = sum(t[2] for t in tiles)
            yield item_id, n / len(words), len(tiles), n, len(words)


KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table({x.split()[0]: pa.array([r[i] for r in rows], k) for i, (x, k) in enumerate(zip(SCHEMA.split(", "), KINDS, strict=True))})


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_covered, item_words) where an item is covered to ``coverage`` or more."""
    if _words_of(benchmark) > block_words:
        return _joined(docs, benchmark, coverage, min_tile, block_words)
    held = _broadcast(benchmark, min_tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Block(held.value, min_tile)
        for batch in batches:
            yield from _rows([(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1), strict=True) for m in index.matches(t.as_py()) if m[1] >= coverage]).to_batches()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def _words_of(benchmark: DataFrame) -> int:
    """The items' words, at most: a word and what follows it have two bytes at least."""
    return (benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 1)).first()[0] or 0) // 2


def _broadcast(benchmark: DataFrame, min_tile: int):
    """A benchmark of at most ``BLOCK_WORDS`` words, as its size was found to be."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).collect()
    return benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


def _seeds(texts: list[bytes], widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, hash, number of the text) of all runs of some widths inside texts."""
    hashes, sizes = hashed_words(texts, LETTERS)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for width in widths:
        if len(hashes) >= width:
            inside = owner[: len(hashes) - width + 1] == owner[width - 1 :]
            yield width, mix(run_hashes(hashes, width) + np.uint64(width))[inside], owner[: len(inside)][inside]


def _item_cells(buckets: int, min_tile: int):
    """Seeds of items: a cell has the hashes and the number of each one's item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array(batch.column(0).to_pylist(), np.int64)
            texts = [t.as_py() or b"" for t in batch.column(1)]
            _, sizes = hashed_words(texts, LETTERS)
            for width, h, own in _seeds(texts, list(range(1, min_tile + 1))):
                mine = np.minimum(sizes, min_tile)[own] == width
                h, own = h[mine], own[mine]
                bucket = bucket_of(h, buckets)
                for k in np.unique(bucket).tolist():
                    rows = bucket == k
                    yield from cells(-width, {k: pack(((h[rows] & LOW48).tobytes(), at[own[rows]].tobytes()))}).to_batches()

    return run


def _doc_cells(buckets: int, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, h, _ in _seeds(unpack(payload.as_py())[1], widths)]]))
                bucket = bucket_of(h, buckets)
                yield from cells(number, {k: pack_hashes(np.unique(h[bucket == k] & LOW48)) for k in np.unique(bucket).tolist()}).to_batches()
                release()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """(pack, at): items that share a seed with a text of a pack."""
    numbers, payloads = table.column("pack").to_pylist(), table.column("payload")
    told = [unpack(p.as_py()) for n, p in zip(numbers, payloads, strict=True) if n < 0]
    packs_, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if told:
        h, at = (np.concatenate([np.frombuffer(t[k], kind) for t in told]) for k, kind in ((0, np.uint64), (1, np.int64)))
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        for number, payload in zip(numbers, payloads, strict=True):
            if number >= 0:
                found = np.unique(at[np.isin(h, unpack_hashes(payload.as_py()))])
                packs_.append(np.full(len(found), number, np.int64))
                ats.append(found)
    return pa.table({"pack": np.concatenate(packs_), "at": np.concatenate(ats)})


def _joined(docs: DataFrame, benchmark: DataFrame, coverage: float, min_tile: int, block_words: int) -> DataFrame:
    """The same for a benchmark of any size: seeds of items and of packs of documents meet in buckets, and a pack gets the items that share one."""
    items = benchmark.select(F.monotonically_increasing_id().alias("at"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialise(items, "tiling-items")
    packs = pack_docs(docs)
    buckets = bucket_count(packs)
    told = items.select("at", F.col("text").cast("binary").alias("text")).mapInArrow(_item_cells(buckets, min_tile), CELLS)
    told = materialise(told, "tiling-seeds")
    widths = sorted(-r["pack"] for r in told.select("pack").distinct().collect())  # at most ``min_tile`` numbers
    met = told.unionByName(packs.mapInArrow(_doc_cells(buckets, widths), CELLS)).groupBy("bucket").applyInArrow(tidy(_meet), "pack long, at long")
    wanted = met.distinct().join(items, "at").select("pack", "at", "item_id", "text")

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(own) and len(asked):
            ids, texts = unpack(own.column("payload")[0].as_py())
            block: list[tuple[int, str | None]] = []
            held = 0
            entries = asked.sort_by("at")
            for k, (item_id, text) in enumerate(zip(entries.column("item_id").to_pylist(), entries.column("text").to_pylist(), strict=True), start=1):
                block.append((item_id, text))
                held += len(text or "") // 2
                if held >= block_words or k == len(entries):
                    index = Block(block, min_tile)
                    rows += [(None if i == NO_ID else i, *m) for i, t in zip(ids, texts, strict=True) for m in index.matches(t) if m[1] >= coverage]
                    block, held = [], 0
        return _rows(rows)

    return packs.groupBy("pack").cogroup(wanted.groupBy("pack")).applyInArrow(tidy(run), SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item; columns and copies as they were."""
    if _words_of(benchmark) > block_words:
        rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("row"))
        rows = materialise(rows, "tiling-rows")
        found = _joined(rows.select(F.col("row").alias("doc_id"), F.col("whole.text").alias("text")), benchmark, coverage, min_tile, block_words)
        return rows.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select("whole.*")
    held, at = _broadcast(benchmark, min_tile), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Block(held.value, min_tile)
        for batch in batches:
            yield batch.filter(pa.array([all(m[1] < coverage for m in index.matches(t.as_py())) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
