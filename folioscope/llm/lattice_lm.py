"""Language-model scoring by the likelihood of the subword lattice.

A word is spelled by pieces of an existing subword vocabulary: one piece that begins
a word, then pieces that continue it, then the word's end. All spellings count: a
log-space forward recursion over the lattice of pieces returns the marginal
probability of the word, and a document's is the product over its words and its end.

What is learned, from all training documents:

* counts of words (one global aggregation);
* weights of the pieces: from the ranks of the existing vocabulary as a start, by
  expected counts over all spellings of all training words (forward and backward
  recursion), one round; a word counts as far as the lattice has to spell it, which
  is the mass that the discount takes off it;
* the word model's discount: a word seen c times keeps (c - D) / N, and what is
  taken off all words is spread by the lattice, so words never seen have a
  probability as well. In the lattice this is one more arc over the whole word.

The probabilities of all texts sum to at most one.

Words travel in packs and cells: a pack of documents tells each bucket its distinct
words with their counts, once each; a bucket merges the counts of its words, gathers
expected counts, scores its words and answers every pack that asked. A pack then adds up
the answers over its documents' words. A word that fills the corpus is one entry a pack.

A word of more than ``LONG`` characters is scored by a recursion that holds the last
``longest`` places only; for the expected counts it is cut into stretches of that size.

Defined results: a null text is empty and has one token, its end; characters outside
the vocabulary are spelled by their bytes; repeated rows are scored each; without any
training text the lattice alone scores; an empty table gives an empty result; other
columns are ignored. A word of any length takes memory in proportion to its bytes.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialise
from folioscope.llm.packs import CELLS, NO_ID, PACK_BYTES, bucket_count, bucket_of, cells, pack, pack_docs, release, tidy, unpack, word_table

DISCOUNT = 0.75
LONG = 4096
PARTS = 16
SMOOTH = 0.1
START = "▁"  # the mark of a piece that begins a word


class Lattice:
    """Pieces by number. Numbers 0..3 are the characters of 1 to 4 bytes that no piece spells, 4 is the word's end, 5 the bare start mark."""

    END, BARE = 4, 5

    def __init__(self, pieces: list[str], max_chars: int = 16):
        self.first: dict[str, int] = {}
        self.next: dict[str, int] = {}
        self.n = 6
        ranks = [0.0] * 6
        for rank, piece in enumerate(pieces):
            body = piece[1:] if piece.startswith(START) else piece
            table = self.first if piece.startswith(START) else self.next
            if body and len(body) <= max_chars and START not in body and body not in table:
                table[body] = self.n
                ranks.append(float(rank))
                self.n += 1
        self.longest = max([1, *map(len, self.first), *map(len, self.next)])
        self.begins = np.zeros(self.n, bool)
        self.begins[[self.BARE, *self.first.values()]] = True
        self.fixed = np.zeros(self.n)
        self.fixed[:4] = [-math.log(256) * k for k in (1, 2, 3, 4)]
        self.start = 1.0 / (10.0 + np.array(ranks))
        self.start[self.END] = self.start[: self.n][~self.begins].sum() / 3

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Log-probabilities from counts: pieces that begin a word sum to one, and so do the others with the end."""
        p = counts + SMOOTH * (1 if counts.sum() > self.n else counts.sum() / self.n)
        total = np.where(self.begins, p[self.begins].sum(), p[~self.begins].sum())
        return np.log(p / total) + self.fixed

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers (-1: none) of words of one length: [word, end] that begin a word, [word, start, length - 1] that continue."""
        size, most = len(words[0]), min(len(words[0]), self.longest)
        first, following = self.first.get, self.next.get
        head = np.array([[first(w[:j], -1) for j in range(1, most + 1)] for w in words], np.int32).reshape(len(words), most)
        spans = [(i, j) for i in range(size) for j in range(i + 1, min(size, i + most) + 1)]
        found = np.array([[following(w[i:j], -1) for i, j in spans] for w in words], np.int32).reshape(len(words), len(spans))
        body = np.full((len(words), size, most), -1, np.int32)
        at = np.array(spans)
        body[:, at[:, 0], at[:, 1] - at[:, 0] - 1] = found
        for k, i in zip(*np.nonzero(body[:, :, 0] < 0), strict=True):
            body[k, i, 0] = len(words[k][i].encode("utf-8", "surrogatepass")) - 1
        return head, body

    def forward(self, logs: np.ndarray, head: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log forward sums [word, place], and the log marginal of each word."""
        (n, size, most), gap = body.shape, np.append(logs, -np.inf)
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = logs[self.BARE]
        for j in range(1, size + 1):
            low = max(0, j - most)
            starts = np.arange(low, j)
            terms = alpha[:, low:j] + gap[body[:, starts, j - starts - 1]]
            if j <= most:
                terms = np.concatenate([terms, gap[head[:, j - 1]][:, None]], axis=1)
            alpha[:, j] = np.logaddexp.reduce(terms, axis=1)
        return alpha, alpha[:, size] + logs[self.END]

    def marginal(self, logs: np.ndarray, word: str) -> float:
        """Log marginal of one word of any length; only the last ``longest`` forward sums are held."""
        held: deque[float] = deque([float(logs[self.BARE])], self.longest)
        for j in range(1, len(word) + 1):
            terms = []
            for n, alpha in enumerate(reversed(held), start=1):  # a piece of n characters ends here
                piece = self.next.get(word[j - n : j])
                if piece is None and n == 1:
                    piece = len(word[j - 1].encode("utf-8", "surrogatepass")) - 1
                if piece is not None:
                    terms.append(alpha + logs[piece])
            if j <= self.longest and (piece := self.first.get(word[:j])) is not None:
                terms.append(logs[piece])
            top = max(terms, default=-math.inf)
            held.append(top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top)
        return held[-1] + float(logs[self.END])

    def scores(self, logs: np.ndarray, words: list[str]) -> np.ndarray:
        """Log marginals of words."""
        out = np.empty(len(words))
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k in set(range(len(words))) - set(short) if len(short) < len(words) else ():
            out[k] = self.marginal(logs, words[k])
        some = [words[k] for k in short]
        at = np.array(short, np.int64)
        for rows in batches_by_length(some):
            out[at[rows]] = self.forward(logs, *self.arcs([some[i] for i in rows]))[1]
        return out

    def expect(self, logs: np.ndarray, words: list[str], times: np.ndarray, counts: np.ndarray) -> None:
        """Adds to ``counts`` how often each piece is expected in ``times`` of each word."""
        head, body = self.arcs(words)
        alpha, total = self.forward(logs, head, body)
        (n, size, most), gap = body.shape, np.append(logs, -np.inf)
        beta = np.full((n, size + 1), -np.inf)
        beta[:, size] = logs[self.END]
        for i in range(size - 1, -1, -1):
            width = min(most, size - i)
            arc = gap[body[:, i, :width]]
            terms = arc + beta[:, i + 1 : i + 1 + width]
            beta[:, i] = np.logaddexp.reduce(terms, axis=1)
            mass = np.exp(alpha[:, i, None] + terms - total[:, None]) * times[:, None]
            counts += np.bincount(body[:, i, :width].ravel() + 1, mass.ravel(), self.n + 1)[1:]
        mass = np.exp(gap[head] + beta[:, 1 : head.shape[1] + 1] - total[:, None]) * times[:, None]
        counts += np.bincount(head.ravel() + 1, mass.ravel(), self.n + 1)[1:]
        counts[self.BARE] += (np.exp(logs[self.BARE] + beta[:, 0] - total) * times).sum()
        counts[self.END] += times.sum()


def batches_by_length(words: list[str], cells: int = 400_000) -> Iterator[np.ndarray]:
    """Row numbers of words of one length, few enough that their arcs take bounded memory."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        size = sizes[order[at]]
        end = min(np.searchsorted(sizes[order], size, "right"), at + max(1, cells // (int(size) * min(int(size), 16) + 1)))
        yield order[at:end]
        at = end


@cache
def lattice(path: str) -> Lattice:
    """The lattice of a sentencepiece vocabulary file, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Lattice([model.id_to_piece(i) for i in sorted(plain, key=lambda i: (-model.get_score(i), i))])


def held_out(doc_id: int) -> bool:
    """Whether a document is kept from training: by its id as text; a null id is not."""
    return doc_id != NO_ID and crc32(str(doc_id).encode()) % 5 == 1


def _distinct(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(a place of each distinct word, the number of every word, distinct hashes, rows of each bucket in order of their hashes)."""
    unique, place, number = np.unique(hashes, return_index=True, return_inverse=True)
    bucket = bucket_of(unique, buckets)
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    dealt = dict(zip(keys.tolist(), np.split(order, first[1:]), strict=True)) if len(keys) else {}
    return place, number, unique, dealt


def _tell(buckets: int):
    """Distinct words of a pack with their counts in training texts, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, texts = unpack(payload.as_py())
                joined, hashes, start, end, sizes = word_table(texts)
                place, number, unique, dealt = _distinct(hashes, buckets)
                train = np.repeat(np.array([not held_out(i) for i in ids], bool), sizes)
                c = np.bincount(number[train], minlength=len(unique)).astype(np.uint32)
                out = {}
                for k, rows in dealt.items():
                    words = [joined[a:b] for a, b in zip(start[place[rows]].tolist(), end[place[rows]].tolist(), strict=True)]
                    out[k] = pack((b" ".join(words), c[rows].tobytes()))
                yield from cells(name, out).to_batches()
                release()

    return run


COUNTED = "bucket int, payload binary, n long, v long, pieces array<int>, expected array<double>"


def _counted(path: str):
    """Words of a bucket with their counts in all training texts, and how often each piece is expected in them."""

    def run(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for payload in table.column("payload"):
            words, c = unpack(payload.as_py())
            for w, n in zip(words.split(b" "), np.frombuffer(c, np.uint32).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        known = [(w.decode("utf-8", "surrogatepass"), n) for w, n in total.items() if n]
        stretches = [(w[i : i + LONG], n) for w, n in known for i in range(0, len(w), LONG)]
        own = lattice(path)
        logs, expected = own.weights(own.start), np.zeros(own.n)
        words, times = [w for w, _ in stretches], np.minimum(np.array([n for _, n in stretches], float), DISCOUNT)
        for rows in batches_by_length(words):
            own.expect(logs, [words[i] for i in rows], times[rows], expected)
        kept = np.nonzero(expected)[0]
        return pa.table(
            {
                "bucket": table.column("bucket").combine_chunks()[:1],
                "payload": pa.array([pack((b" ".join(total), np.fromiter(total.values(), np.int64, len(total)).tobytes()))], pa.binary()),
                "n": pa.array([sum(total.values())], pa.int64()),
                "v": pa.array([len(known)], pa.int64()),
                "pieces": pa.array([kept.astype(np.int32)], pa.list_(pa.int32())),
                "expected": pa.array([expected[kept]], pa.list_(pa.float64())),
            }
        )

    return run


def _summed(size: int):
    """The expected counts of some buckets in one row, added in the buckets' order, so that the sum is always the same."""

    def run(table: pa.Table) -> pa.Table:
        out = np.zeros(size)
        for row in table.sort_by("bucket").select(["pieces", "expected"]).to_batches():
            for pieces, expected in zip(row.column(0), row.column(1), strict=True):
                out[pieces.values.to_numpy()] += expected.values.to_numpy()
        return pa.table({"part": table.column("part").combine_chunks()[:1], "expected": pa.array([out.tobytes()], pa.binary())})

    return run


def _scored(path: str, held, n: int, v: int):
    """Answers to the packs: of each word they told, its count and the log of the model's probability."""

    def run(table: pa.Table, counted: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({k: pa.array([], t) for k, t in (("pack", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()))})
        joined, c = unpack(counted.column("payload")[0].as_py())
        words, c = joined.split(b" "), np.frombuffer(c, np.int64)
        own = lattice(path)
        spelled = own.scores(held.value, [w.decode("utf-8", "surrogatepass") for w in words])
        spelled += math.log(DISCOUNT * max(v - 1, 0) / n) if v > 1 else math.log(0.5)
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - DISCOUNT, 0) / n) if n else np.full(len(words), -np.inf)
        model = np.logaddexp(whole, spelled)
        number = {w: k for k, w in enumerate(words)}
        out = []
        for payload in table.column("payload"):
            at = np.array([number[w] for w in unpack(payload.as_py())[0].split(b" ")], np.int64)
            out.append(pack((c[at].tobytes(), model[at].tobytes())))
        return table.select(["pack", "bucket"]).append_column("payload", pa.array(out, pa.binary()))

    return run


SUMS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _added(buckets: int, n: int, v: int, ends: int):
    """The sums of every document of a pack over its words and its end."""

    def run(packs: pa.Table, told: pa.Table) -> pa.Table:
        parts = []
        answers = dict(zip(told.column("bucket").to_pylist(), told.column("payload"), strict=True))
        base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        end_model = math.log10(ends / n) if n else math.log10(0.5)
        for payload in packs.column("payload"):
            ids, texts = unpack(payload.as_py())
            _, hashes, _, _, sizes = word_table(texts)
            del texts
            _, number, unique, dealt = _distinct(hashes, buckets)
            c, model = np.zeros(len(unique), np.int64), np.zeros(len(unique))
            for k, rows in dealt.items():
                one, two = unpack(answers[k].as_py())
                c[rows], model[rows] = np.frombuffer(one, np.int64), np.frombuffer(two, np.float64)
            full = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[full]

            def added(values: np.ndarray, number=number, first=first, full=full, size=len(sizes)) -> np.ndarray:
                out = np.zeros(size, values.dtype)
                if len(full):
                    out[full] = np.add.reduceat(values[number], first)
                return out

            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array([None if i == NO_ID else i for i in ids], pa.int64()),
                        "held_out": pa.array([held_out(i) for i in ids], pa.bool_()),
                        "n_tokens": sizes.astype(np.int64) + 1,
                        "n_known": added((c > 0).astype(np.int64)) + int(ends > 0),
                        "train_tokens": np.full(len(ids), n, np.int64),
                        "base_score": added(base_of(c)) + base_of(ends),
                        "score": added(model) / math.log(10) + end_model,
                    }
                )
            )
        return pa.concat_tables(parts) if parts else pa.table({x.split()[0]: pa.array([], t) for x, t in zip(SUMS.split(", "), (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2), strict=True)})

    return run


def lattice_lm(docs: DataFrame, path: str, buckets: int | None = None, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``path`` is a sentencepiece model file that every executor can open.
    """
    spark = docs.sparkSession
    packs = pack_docs(docs, pack_bytes)
    k = buckets or bucket_count(packs, pack_bytes)
    told = materialise(packs.mapInArrow(_tell(k), CELLS), "lm-told")
    counts = materialise(told.groupBy("bucket").applyInArrow(tidy(_counted(path)), COUNTED), "lm-counts")
    totals = counts.agg(F.sum("n"), F.sum("v")).first()
    key = F.col("doc_id").cast("long")
    ends = docs.where(~F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(False))).count()
    n, v = (totals[0] or 0) + ends, (totals[1] or 0) + (ends > 0)

    own = lattice(path)
    expected = np.zeros(own.n)
    parts = counts.select((F.col("bucket") % PARTS).alias("part"), "bucket", "pieces", "expected").groupBy("part").applyInArrow(tidy(_summed(own.n)), "part int, expected binary")
    for row in sorted(parts.collect()):  # at most ``PARTS`` rows of a number for each piece of the fixed vocabulary
        expected += np.frombuffer(row["expected"], np.float64)
    held = spark.sparkContext.broadcast(own.weights(expected if n else own.start))  # a number for each piece of the vocabulary
    answers = told.groupBy("bucket").cogroup(counts.select("bucket", "payload").groupBy("bucket")).applyInArrow(tidy(_scored(path, held, n, v)), CELLS)
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(tidy(_added(k, n, v, ends)), SUMS)
