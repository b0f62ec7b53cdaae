"""Byte-level BPE with a segment tree over byte positions.

A piece of text starts as single bytes.  Leaf *i* of a segment tree holds the rank of
the pair that begins at live position *i*, combined with *i* so that equal ranks order
from the left; the root is the leftmost pair of least rank.  A merge changes three
leaves (the merged pair, the live neighbour before it, the position that dies) and
their ancestors, which is logarithmic in the piece's length.

``encode_piece`` is that algorithm for one piece.  ``encode_pieces`` runs it for many
short pieces side by side on numpy arrays, one tree per row.  Both give what the
tiktoken library gives for the same ranks and pattern.

A Python worker keeps the pieces of up to ``SHORT`` bytes that it has met in a cache of
about ``CACHE`` entries at most.

Defined results: a null text is empty and has no ids; special-token strings are
ordinary text; rows that repeat an id are encoded each for itself; other columns are
not looked at.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow

#: Pieces that one Python worker remembers (about 150 bytes each).
CACHE = 400_000
#: Characters of texts that are encoded at a time.
CHARS = 500_000
#: Bytes up to which pieces are merged side by side, and remembered.
SHORT = 64
_NONE = np.int64(1) << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = len(self.tokens)
        #: Pairs of tokens that make a token, as left * width + right in order, and its rank.
        found = ((ranks[t[:i]] * self.width + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        pairs = np.fromiter(found, np.dtype([("key", np.int64), ("rank", np.int64)]))
        pairs.sort(order="key")
        self.pair_keys, self.pair_ranks = pairs["key"].copy(), pairs["rank"].copy()
        #: Ids of pieces as little-endian 32-bit integers.
        self.cache: dict[str, bytes] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, width, keys, ranks = int(_NONE), self.width, self.pair_keys, self.pair_ranks

        def leaf(i: int) -> int:
            j = after[i]
            if j >= n:
                return none
            key = ids[i] * width + ids[j]
            at = int(keys.searchsorted(key))
            return int(ranks[at]) * size + i if at < len(keys) and keys[at] == key else none

        tree = [none] * (2 * size)
        tree[size : size + n] = map(leaf, range(n))
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        dead = bytearray(n)
        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            ids[i], after[i], dead[j] = rank, after[j], 1
            if after[i] < n:
                before[after[i]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [x for x, gone in zip(ids, dead, strict=True) if not gone]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0) & (left >= 0), self.pair_ranks[at], -1)

    def _encode_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of pieces of 2 to ``size`` bytes, ``size`` a power of two; a row and a tree for each."""
        rows, lengths = len(pieces), np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        live = np.arange(size) < lengths[:, None]
        ids = np.full((rows, size + 1), -1, np.int64)  # the last column stands for what is beyond the end
        ids[:, :size][live] = self.byte_ids[flat]
        after = np.where(live, np.minimum(np.arange(1, size + 1), lengths[:, None]), size)
        after = np.where(after >= lengths[:, None], size, after)
        before = np.tile(np.arange(-1, size), (rows, 1))
        tree = np.full((rows, 2 * size), _NONE, np.int64)
        rank = self._rank(ids[:, : size - 1].ravel(), ids[:, 1:size].ravel()).reshape(rows, size - 1)
        tree[:, size : 2 * size - 1] = np.where(rank >= 0, rank * size + np.arange(size - 1), _NONE)
        k = size
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray | np.int64) -> None:
            k = i + size
            tree[r, k] = value
            while k[0] > 1:  # all rows are at the same level
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        def pair(r: np.ndarray, i: np.ndarray) -> np.ndarray:
            rank = self._rank(ids[r, i], ids[r, after[r, i]])
            return np.where(rank >= 0, rank * size + i, _NONE)

        r = np.flatnonzero(tree[:, 1] < _NONE)
        while len(r):
            i = tree[r, 1] % size
            ids[r, i] = tree[r, 1] // size
            j = after[r, i]
            live[r, j] = False
            after[r, i] = then = after[r, j]
            before[r, then] = i
            put(r, j, _NONE)
            put(r, i, pair(r, i))
            p = before[r, i]
            if len(has := np.flatnonzero(p >= 0)):
                put(r[has], p[has], pair(r[has], p[has]))
            r = r[tree[r, 1] < _NONE]
        kept, ends = ids[:, :size][live].astype("<i4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [kept[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > SHORT:
                out[k] = np.array(self.encode_piece(piece), "<i4").tobytes()
            else:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for size, which in groups.items():
            for a in range(0, len(which), step := max(64, 400_000 // size)):
                part = which[a : a + step]
                for k, ids in zip(part, self._encode_rows([pieces[k] for k in part], size), strict=True):
                    out[k] = ids
        return out  # type: ignore[return-value]

    def encode_flat(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has); pieces that the cache lacks are merged together."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list(set().union(*split) - self.cache.keys())
        coded = [p.encode() for p in new]
        known, long = self.cache, {}
        for piece, raw, ids in zip(new, coded, self.encode_pieces(coded), strict=True):
            (known if len(raw) <= SHORT else long)[piece] = ids
        if long:
            own = [b"".join([known[p] if p in known else long[p] for p in pieces]) for pieces in split]
        else:
            own = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        return np.frombuffer(b"".join(own), "<i4"), np.fromiter(map(len, own), np.int64, len(own)) // 4

    def encode_texts(self, texts: Iterable[str]) -> list[list[int]]:
        """Ids of each text."""
        flat, counts = self.encode_flat(texts)
        ends = np.cumsum(counts).tolist()
        return [flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[int, str], ByteBPE] = {}


def codec(data: bytes, pattern: str) -> ByteBPE:
    """The codec for a rank file's bytes; a Python worker builds one once."""
    key = (binascii.crc32(data), pattern)
    if key not in _codecs:
        _codecs[key] = ByteBPE(read_ranks(data), pattern)
    return _codecs[key]


def _runs(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows whose lengths add up to about ``most``."""
    a = total = n = 0
    for n, length in enumerate(lengths, 1):
        total += length
        if total >= most:
            yield a, n
            a, total = n, 0
    if a < n:
        yield a, n


def _encoded(batches: Iterator[pa.RecordBatch], bpe: ByteBPE, both: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _runs(pc.utf8_length(batch["_text"]).to_pylist(), CHARS):
            flat, counts = bpe.encode_flat(batch["_text"].slice(a, b - a).to_pylist())
            ends = np.cumsum(counts)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            more = []
            if both:
                each, cuts = flat.tolist(), ends.tolist()
                more = [pa.array([bpe.decode(each[x:y]) for x, y in zip([0, *cuts], cuts, strict=False)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), ids, *more], ["doc_id", "ids", "decoded"][: 2 + both])


def _encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str, text_col: str, both: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(batches, codec(shared.value, pattern), both)

    return in_arrow(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>{', decoded binary' if both else ''}")


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's token ids.  ``ranks`` are the bytes of a rank file, under 2 MB."""
    return _encode(docs, ranks, pattern, id_col, text_col, False)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``encode``, and the bytes that the ids decode to, in one pass and one Python worker a task."""
    return _encode(docs, ranks, pattern, id_col, text_col, True)


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that each row's ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value, "")
        for batch in batches:
            ids = batch["ids"]
            for a, b in _runs(pc.list_value_length(ids).to_pylist(), 1_000_000):
                part = ids.slice(a, b - a)
                flat, ends = part.flatten().to_pylist(), np.cumsum(pc.list_value_length(part).to_numpy()).tolist()
                texts = pa.array([bpe.decode(flat[x:y]) for x, y in zip([0, *ends], ends, strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), part, texts], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return in_arrow(encoded.select("doc_id", "ids"), work, f"doc_id {kind}, ids array<int>, decoded binary")
