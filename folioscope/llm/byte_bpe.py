"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Packs of documents explode their texts into pre-tokens with positions and list
   their distinct pre-tokens once, dealt into buckets by a hash of the word (one
   compressed cell per pack and bucket).
2. A bucket receives all cells of its words, so each distinct word of the corpus is
   encoded once; the ids go back to the packs that asked, cell by cell.
3. A pack joins the ids to its words and reassembles every text by position.
   Decoding joins the ids to the token-byte table.

A word travels once per pack however often it occurs, so a word that fills the
corpus is as cheap as any other. Packs are made again for step 3 rather than written;
should a row then fall into another pack, its missing words are encoded there, and the
worker's log says so.

Defined results: a null text is empty and has no tokens; a null id is kept; repeated
rows are encoded each; an empty table gives an empty result; other columns are
ignored. Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import logging
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import partitions
from folioscope.llm.packs import CELLS, NO_ID, cells, pack, pack_docs, release, tidy, unpack

PACK_BYTES = 8 << 20
log = logging.getLogger(__name__)


@cache
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: token for token, i in ranks(path).items()}


@cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return regex.compile(pattern).findall


def decode(ids: list[int], path: str) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, ids))


class Dictionary(dict):
    """Ids of words; a word that is not there is encoded, and counted."""

    def __init__(self, path: str, pattern: str):
        self.encode = encoder(path, pattern).encode_ordinary
        self.encoded = 0

    def __missing__(self, word: str) -> list[int]:
        self.encoded += 1
        ids = self[word] = self.encode(word)
        return ids


class Numbers(dict):
    """Numbers of words, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _dealt(words: Iterable[str], buckets: int) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(crc32(w.encode()) % buckets, []).append(w)
    return {k: sorted(v) for k, v in out.items()}


def _sum(words: list[str]) -> tuple[int, int]:
    """Tells one list of words from another."""
    return len(words), crc32("\0".join(words).encode())


def _cells(split_by: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(split_by)
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words: set[str] = set()
                for text in unpack(payload.as_py())[1]:
                    words.update(split(text.decode()))
                yield from cells(number, {k: pack(v) for k, v in _dealt(words, buckets).items()}).to_batches()
                del words
                release()

    return run


def _encoded(path: str, pattern: str):
    def run(table: pa.Table) -> pa.Table:
        known, out = Dictionary(path, pattern), []
        for cell in table.column("payload"):
            words = unpack(cell.as_py())
            ids = [known[w] for w in words]
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
            out.append(pack((_sum(words), sizes.tobytes(), flat.tobytes())))
        return table.select(["pack", "bucket"]).append_column("payload", pa.array(out, pa.binary()))

    return run


def _reassembled(path: str, pattern: str, buckets: int, with_ids: bool):
    def run(packs: pa.Table, told: pa.Table) -> pa.Table:
        split = splitter(pattern)
        rows: list[tuple] = []
        answers = dict(zip(told.column("bucket").to_pylist(), told.column("payload"), strict=True))
        for payload in packs.column("payload"):
            ids, texts = unpack(payload.as_py())
            number = Numbers()
            places = [array("I", map(number.__getitem__, split(text.decode()))) for text in texts]  # of each text: its words in order
            del texts
            ids_of = Dictionary(path, pattern)
            for k, words in _dealt(number, buckets).items():
                if k in answers:
                    asked, *arrays = unpack(answers[k].as_py())
                    if asked == _sum(words):
                        sizes, flat = (np.frombuffer(x, np.uint32) for x in arrays)
                        ends, flat = np.cumsum(sizes).tolist(), flat.tolist()
                        ids_of.update(zip(words, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            found = [ids_of[w] for w in number]
            if ids_of.encoded:
                log.warning("a pack was made of other rows than before: %d of %d words are encoded again", ids_of.encoded, len(number))
            del ids_of, number
            said = [" ".join(map(str, x)) for x in found]
            raw = [decode(x, path) for x in found]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            for i, at in zip(ids, places, strict=True):
                rows.append(
                    (
                        None if i == NO_ID else i,
                        int(sizes[at].sum()) if at else 0,
                        hashlib.sha256(" ".join(map(said.__getitem__, at)).encode()).hexdigest(),
                        hashlib.sha256(b"".join(map(raw.__getitem__, at))).hexdigest(),
                        np.fromiter((x for k in at for x in found[k]), np.int32) if with_ids else None,
                    )
                )
        names = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
        return pa.table({n: pa.array([r[j] for r in rows], kind) for j, (n, kind) in enumerate(names.items())})

    return run


def byte_bpe(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, pack_bytes: int = PACK_BYTES, buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and the ids themselves if asked for.

    ``path`` is a rank file that every executor can open; ``pattern`` splits texts into pre-tokens.
    """
    n = buckets or partitions(docs.sparkSession)
    packs = pack_docs(docs, pack_bytes, written=False)
    told = packs.mapInArrow(_cells(pattern, n), CELLS)
    encoded = told.groupBy("bucket").applyInArrow(tidy(_encoded(path, pattern)), CELLS)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return packs.groupBy("pack").cogroup(encoded.groupBy("pack")).applyInArrow(tidy(_reassembled(path, pattern, n, with_ids)), schema)
