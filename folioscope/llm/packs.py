"""Packs: whole documents in compressed rows of some MB, and compact cells that are dealt between packs and buckets.

Operators that compare all documents read them several times. ``pack_docs`` writes
them once to the shared folder, as rows that hold whole documents; a task then works
on a pack with array operations, and what packs tell each other goes as cells, one
row for each pack and bucket, compressed: a few bytes for a hash instead of a row.

The number of a pack is made of the task's partition and a count, so it is unique,
and it is fixed once the packs are written.

Memory: a task holds one pack, or the cells of one bucket. A pack has ``PACK_BYTES``
of text or one longer document; ``bucket_count`` takes so many buckets that one has
the cells of ``BUCKET_BYTES`` of text, whatever the input, and buckets that make large
arrays go through their cells by ranges of hashes (``slices``).
"""

from __future__ import annotations

import ctypes
import marshal
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD_BYTES, materialise, partitions

PACK_BYTES = 3 << 20
BUCKET_BYTES = 16 << 20
ORDINAL_BITS = 19
CELLS = "pack long, bucket int, payload binary"
#: Stands for a null id: after every other.
NO_ID = (1 << 63) - 1
LOW48 = np.uint64((1 << 48) - 1)


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def tidy(work: Callable) -> Callable:
    """A function of Arrow tables that gives what it has freed back to the system.

    Workers are reused; without this each keeps the most it ever took.
    """

    def one(table: pa.Table) -> pa.Table:
        out = work(table)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        release()
        return out

    return one if work.__code__.co_argcount == 1 else two


def release() -> None:
    pa.default_memory_pool().release_unused()
    _trim()(0)


def bucket_count(packs: DataFrame, pack_bytes: int = PACK_BYTES) -> int:
    """Buckets for written packs: by their bytes, and not fewer than shuffle partitions."""
    return max(partitions(packs.sparkSession), math.ceil(packs.count() * pack_bytes / BUCKET_BYTES))


def bucket_count_of(texts: DataFrame, text: str) -> int:
    """The same for packs that are not written: by the bytes of the texts."""
    size = texts.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(partitions(texts.sparkSession), math.ceil(size / BUCKET_BYTES))


def slices(cells_of: list[np.ndarray], most: int, bits: int = 48) -> Iterator[list[tuple[int, int]]]:
    """Ranges (low, high) of each array of sorted hashes, for ranges of hashes of so many bits that hold about ``most`` in all."""
    total = sum(map(len, cells_of))
    parts = max(1, math.ceil(total / most))
    at = [0] * len(cells_of)
    for k in range(1, parts + 1):
        end = [len(a) if k == parts else int(np.searchsorted(a, np.uint64((k << bits) // parts))) for a in cells_of]
        yield list(zip(at, end, strict=True))
        at = end


def pack(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(marshal.dumps(value))


def unpack(payload: bytes):
    return marshal.loads(zstandard.ZstdDecompressor().decompress(payload))


def pack_docs(docs: DataFrame, pack_bytes: int = PACK_BYTES, written: bool = True) -> DataFrame:
    """(pack, payload): payload unpacks to the ids and the UTF-8 texts of some rows; a null text is empty, a null id ``NO_ID``.

    Packs that are not written are made again by each use; what rests on them must
    then hold even if rows fall into other packs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush():
            nonlocal number, ids, texts, held
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack((ids, texts))], pa.binary())], ["pack", "payload"])
            number, ids, texts, held = number + 1, [], [], 0
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or b""
                ids.append(NO_ID if i is None else i)
                texts.append(text)
                held += len(text) + 16
                if held >= pack_bytes or len(ids) == 1 << ORDINAL_BITS:
                    yield flush()
        if ids:
            yield flush()
        release()

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(cast(text as string) as binary) as text")
    packs = rows.mapInArrow(run, "pack long, payload binary")
    return materialise(packs, "packs") if written else packs


def pack_rows(rows: DataFrame, text: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(pack, payload, rest): packs of whole rows, which are not written.

    A row's id is its number: that of its pack and its place there, so ids follow the order
    of reading. ``rest`` holds the rows as Arrow data with the texts emptied. All uses of
    these packs must be in one plan, whose scans read the same rows in the same tasks.
    """
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            low, held = 0, 0
            for k, size in enumerate([len(t.as_py() or "") for t in batch.column(at)], start=1):
                held += size + 16
                if held >= pack_bytes or k == len(batch) or k - low == 1 << ORDINAL_BITS:
                    part = batch.slice(low, k - low)
                    texts = [(t.as_py() or "").encode() for t in part.column(at)]
                    columns = [pa.array([None if not t.is_valid else "" for t in c], c.type) if j == at else c for j, c in enumerate(part.columns)]
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=part.schema))
                    ids = [(number << ORDINAL_BITS) + j for j in range(len(texts))]
                    rest = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack((ids, texts))], pa.binary()), pa.array([rest], pa.binary())], ["pack", "payload", "rest"])
                    number, low, held = number + 1, k, 0
        release()

    return rows.mapInArrow(run, "pack long, payload binary, rest binary")


def rows_of(rest: bytes, texts: list[str], at: int) -> pa.Table:
    """The rows of a pack with these texts in place of theirs; a null text stays null if its new one is empty."""
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)).read_all()
    was = table.column(at)
    column = pa.array([None if not t and not w.is_valid else t for t, w in zip(texts, was, strict=True)], was.type)
    return table.set_column(at, table.field(at), column)


def cells(pack_number: int, dealt: dict[int, bytes]) -> pa.Table:
    keys = sorted(dealt)
    return pa.table(
        {
            "pack": pa.array([pack_number] * len(keys), pa.int64()),
            "bucket": pa.array(keys, pa.int32()),
            "payload": pa.array([dealt[k] for k in keys], pa.binary()),
        }
    )


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def pack_hashes(sorted48: np.ndarray) -> bytes:
    """Sorted 48-bit numbers, byte plane by byte plane: the high planes compress well."""
    planes = np.ascontiguousarray(sorted48.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_hashes(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


WORD_BLOCK = 1 << 18


@cache
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from the 0th on."""
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(size, np.uint64(b))
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def word_table(texts: list[bytes], letters: bytes = WORD_BYTES) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered texts end to end, and of all their words the 64-bit hash, first byte and last byte; the number of words of each text.

    ``letters`` is the translation that lowers letters and puts spaces between words.
    A word's hash is a scrambled polynomial of its bytes, taken from sums over blocks of
    about ``WORD_BLOCK`` bytes, which end between words; no word becomes an object.
    """
    joined = b" ".join(texts).translate(letters)
    hashes, starts, ends, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(joined):
        end = joined.find(b" ", at + WORD_BLOCK)
        end = len(joined) if end < 0 else end
        block = np.frombuffer(joined, np.uint8, end - at, at)
        inside = np.zeros(len(block) + 2, bool)
        inside[1:-1] = block != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[0::2], edges[1::2]
        if len(first):
            powers, inverse = _power_table(max(2 * WORD_BLOCK, 1 << len(block).bit_length()))
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * powers[: len(block)], out=sums[1:])
            hashes.append(mix((sums[last] - sums[first]) * inverse[first]))
            starts.append(first + at)
            ends.append(last + at)
        at = end + 1
    start, sizes = np.concatenate(starts), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    places = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return joined, np.concatenate(hashes), start, np.concatenate(ends), np.diff(places)


def hashed_words(texts: list[bytes], letters: bytes = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the lowered words of all texts, end to end, number of words of each text)."""
    _, hashes, _, _, sizes = word_table(texts, letters)
    return hashes, sizes


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Scrambled polynomial hash of the ``size`` values from each place on, by doubling."""
    have, h, out, done = 1, values, None, 0
    while True:
        if size & have:  # binary digits of the size, smallest first: append this power's hash
            if out is None:
                out, done = h, have
            else:
                n = min(len(h) - done, len(out))
                out = out[:n] * _power(have) + h[done : done + n]
                done += have
        if done == size:
            return mix(out[: len(values) - size + 1])
        h = h[: len(h) - have] * _power(have) + h[have:]
        have *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have, out = 1, a
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
