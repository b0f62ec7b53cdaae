"""Stupid-backoff scores of documents under a bigram model of the corpus itself.

For words ``v w`` in a row, with counts over all documents,

    S(w | v) = count(v w) / count(v)          if count(v w) >= MIN_COUNT
             = ALPHA * count(w) / tokens       otherwise

and a document's score is the sum of ``ln S`` over its words.  ``v`` of a document's
first word is a start mark, whose count is the number of documents with words.  Every
word and every bigram is counted, whatever the size of the corpus, under a 64-bit hash;
nothing is collected or broadcast.  Logarithms are taken to ``UNIT`` and summed as
integers, so that a score doesn't depend on the order of addition.

Relationally, with packed and compressed columns in place of rows of words:

1. a batch of documents becomes its distinct words' hashes and a code for each token,
   staged, so that texts are read once and a batch keeps its number;
2. each batch deals its distinct words and bigrams, with how often it has them, to
   tiles by ranges of the hash, with about ``TILE`` of them to a tile;
3. a tile sums them over the batches, and gives each batch the totals of those it sent;
4. a batch's totals meet its tokens, and the logarithms are summed for each document.

A batch sends a word or a bigram once however many documents have it, so very frequent
ones swell no tile.

Defined results: a null text, or one without words, has no words and the score 0;
repeated rows count and are scored each; other columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow
from tidewell.llm.words import gathered, hashed_words
from tidewell.plans.staging import stage

ALPHA, MIN_COUNT, UNIT = 0.4, 2, 1_000_000
TILE = 2_000_000
#: Characters and documents of a batch.
CHARS, DOCS = 8_000_000, 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(32)
#: Stands for the start mark.
_START = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Batch:
    """Distinct words and bigrams of a batch: ``keys`` of both, words first, how often each occurs, and their order by key."""

    words: int
    first: np.ndarray  # codes of each bigram's words; ``words`` is the start mark
    second: np.ndarray
    of_token: np.ndarray  # number of each token's bigram
    keys: np.ndarray
    times: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, code: np.ndarray, per_text: np.ndarray) -> Batch:
        ends = np.cumsum(per_text)
        before = np.roll(code, 1).astype(np.uint64)
        before[(ends - per_text)[per_text > 0]] = len(words)
        pairs, of_token, times = np.unique((before << _LOW) | code.astype(np.uint64), return_inverse=True, return_counts=True)
        first, second = (pairs >> _LOW).astype(np.int64), (pairs & np.uint64((1 << 32) - 1)).astype(np.int64)
        x = np.append(words, _START)[first] * _ODD + words[second]
        x = (x ^ (x >> np.uint64(31))) * _MIX
        keys = np.concatenate([words, x ^ (x >> np.uint64(29))])
        return cls(len(words), first, second, of_token, keys, np.concatenate([np.bincount(code, minlength=len(words)), times]), np.argsort(keys, kind="stable"))

    def log_scores(self, totals: np.ndarray, starts: int, tokens: int, min_count: int, alpha: float) -> np.ndarray:
        """ln S of each bigram in units of 1 / UNIT, from the corpus's counts of ``keys``."""
        ones, twos = totals[: self.words], totals[self.words :]
        seen = np.log(twos / np.append(ones, starts)[self.first])
        unseen = np.log(alpha * ones[self.second] / tokens)
        return np.rint(np.where(twos >= min_count, seen, unseen) * UNIT).astype(np.int64)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers (unsigned, or whole) as compressed byte planes, the first one as differences."""
    import zstandard

    columns = [columns[0].astype(np.uint64), *(c.astype(np.int64).view(np.uint64) for c in columns[1:])]
    columns[0] = np.diff(columns[0], prepend=np.uint64(0))
    planes = b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, width: int) -> list[np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(planes) // (8 * width)
    columns = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes.reshape(width, 8, n)]
    return [np.cumsum(columns[0], dtype=np.uint64), *(c.view(np.int64) for c in columns[1:])]


def _hold(ids: np.ndarray, null: np.ndarray, per_text: np.ndarray, words: np.ndarray, code: np.ndarray) -> bytes:
    rows, tokens = pack([np.arange(len(ids)), ids, null, per_text]), pack([np.arange(len(code)), code])
    return struct.pack("<QQ", len(rows), len(tokens)) + rows + tokens + pack([words])


def _held(data: bytes) -> tuple[np.ndarray, ...]:
    a, b = struct.unpack_from("<QQ", data)
    _, ids, null, per_text = unpack(data[16 : 16 + a], 4)
    return ids, null, per_text, unpack(data[16 + a + b :], 1)[0], unpack(data[16 + a : 16 + a + b], 2)[1]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_count: int = MIN_COUNT, tile: int = TILE) -> DataFrame:
    """One row per row: doc_id, n_words, score (sum of ln S)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch of documents as words and codes, with its sums."""
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for number, part in enumerate(gathered(batches, "_text", CHARS, DOCS)):
            hashes, per_text = hashed_words(part["_text"])
            words, codes, times = np.unique(hashes, return_inverse=True, return_counts=True)
            frequent = np.argsort(-times, kind="stable")  # first: codes of frequent words are small numbers, which pack well
            rank = np.empty_like(frequent)
            rank[frequent] = np.arange(len(frequent))
            words, codes = words[frequent], rank[codes]
            ids = part["doc_id"].fill_null(0).to_numpy()
            data = _hold(ids, np.asarray(part["doc_id"].is_null()), per_text, words, codes)
            sums = [base + number, len(codes), int((per_text > 0).sum()), len(words)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in sums), pa.array([data], pa.binary())], ["base", "tokens", "starts", "words", "data"])

    coded = stage(in_arrow(rows, code, "base long, tokens long, starts long, words long, data binary"), "backoff-coded")
    tokens, starts, words = (x or 0 for x in coded.agg(F.sum("tokens"), F.sum("starts"), F.sum("words")).first())
    tiles = max(1, -(-(tokens + words) // tile))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed keys and counts for each tile, which is a range of keys."""
        for batch in batches:
            for base, data in zip(batch["base"].to_pylist(), batch["data"], strict=True):
                _, _, per_text, hashes, codes = _held(data.as_py())
                if not len(codes):
                    continue
                own = Batch.of(hashes, codes, per_text)
                keys, times = own.keys[own.order], own.times[own.order]
                to, starts_at = np.unique(((keys >> _LOW) * np.uint64(tiles)) >> _LOW, return_index=True)
                cuts = np.append(starts_at, len(keys))
                out = [pack([keys[a:b], times[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), pa.array([base] * len(out), pa.int64()), pa.array(out, pa.binary())], ["tile", "base", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each tile and batch the totals of the keys that it sent, in their order."""
        now, held = None, []

        def sums() -> pa.RecordBatch:
            columns = [unpack(x, 2) for _, x in held]
            ends = np.cumsum([len(c[0]) for c in columns])
            keys, times = (np.concatenate([c[k] for c in columns]) for k in range(2))
            kinds, at = np.unique(keys, return_inverse=True)
            totals = np.bincount(at, times, len(kinds)).astype(np.int64)[at]
            out = [pack([np.arange(len(x)), x]) for x in np.split(totals, ends[:-1])]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(out), pa.int64()), pa.array([b for b, _ in held], pa.int64()), pa.array(out, pa.binary())], ["tile", "base", "data"])

        for batch in batches:  # sorted by tile
            for to, base, data in zip(batch["tile"].to_pylist(), batch["base"].to_pylist(), batch["data"], strict=True):
                if to != now and held:
                    yield sums()
                    held = []
                now = to
                held.append((base, data.as_py()))
        if held:
            yield sums()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a batch of documents from its totals; the documents come first, as tile -1."""
        now, docs, totals = None, b"", []

        def done() -> pa.RecordBatch:
            ids, null, per_text, hashes, codes = _held(docs)
            summed = np.zeros(len(codes) + 1, np.int64)
            if len(codes):
                own = Batch.of(hashes, codes, per_text)
                total = np.empty(len(own.keys), np.int64)
                total[own.order] = np.concatenate([unpack(x, 2)[1] for x in totals])
                np.cumsum(own.log_scores(total, starts, tokens, min_count, alpha)[own.of_token], out=summed[1:])
            ends = np.cumsum(per_text)
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(per_text), pa.array((summed[ends] - summed[ends - per_text]) / UNIT)], ["doc_id", "n_words", "score"])

        for batch in batches:  # sorted by base, then tile
            for base, data in zip(batch["base"].to_pylist(), batch["data"], strict=True):
                if base != now:
                    if now is not None:
                        yield done()
                    now, docs, totals = base, data.as_py(), []
                else:
                    totals.append(data.as_py())
        if now is not None:
            yield done()

    kind = "tile long, base long, data binary"
    dealt = in_arrow(coded.select("base", "data"), deal, kind)
    summed = in_arrow(dealt.repartition("tile").sortWithinPartitions("tile", "base"), add, kind)
    whole = coded.select(F.lit(-1).cast("long").alias("tile"), "base", "data").unionByName(summed)
    return in_arrow(whole.repartition("base").sortWithinPartitions("base", "tile"), rate, "doc_id long, n_words long, score double")
