"""Token ids in a bit-plane-shuffled binary file format.

A shard file (little endian) holds whole documents in ascending id order:

    header   "TWTS" | u16 version | u16 mode (0 bytes, 1 bits) | u32 block | u32 documents | u64 ids | u32 chunks
    chunks   for each chunk: u32 ids, then u32 compressed bytes of each plane
    planes   for each chunk its planes, each a zstandard frame
    tail     zstandard frames, each after its u32 size: document ids (i64), null flags (u8), token counts (u32)

A chunk is ``BLOCK`` ids at most.  Its ids are 32-bit; the matrix of ids by bytes (4
planes) or by bits (32 planes) is transposed, so that the high planes, which hardly
vary, nearly vanish.  The chunk index gives the place of any id without reading
other planes.

Shard files are written as rows of a Parquet table by Spark's own writer, so a lost
executor or a repeated task leaves no half file and any shared store will do;
``export_files`` puts them into a folder as plain files.

Documents are range-partitioned and sorted by id, then by a hash of the text, so shards
in order of (partition, sequence) hold ascending ids, however many rows share one, and
the first id position of a shard is a running sum over shards.

Ids come from the tokenizers library, which is given each distinct run of
non-blank characters once; white space only separates tokens in its word model, so
runs are encoded alike wherever they stand.  A Python worker remembers at most
``CACHE`` runs.

Defined results: a null text is empty and has the end id alone; null ids come first;
rows that repeat an id stay apart, in order of their texts' hashes; other columns are
not looked at.
"""

from __future__ import annotations

import binascii
import struct
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow
from tidewell.llm.words import gathered
from tidewell.plans.staging import stage

BLOCK = 1 << 16
#: Ids that fill a shard; a document that goes beyond stays whole.
SHARD_IDS = 4_000_000
CACHE = 700_000
#: Bytes of texts that are encoded at a time.
CHARS = 8_000_000
#: Words that the library is given in one text.
TOGETHER = 2000
#: Marks that are one unit together wherever they follow a word.
_MARKS = ".,;:!?#*$%&"
#: Words whose letters are lower case and composed already.
_PLAIN = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"
#: What the model's tokens end with at the end of a word, and the word put between others.
_LAST, _BETWEEN = "</w>", "\x01"
_HEAD = struct.Struct("<4sHHIIQI")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte or bit planes of 32-bit ids, lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [rows[:, k].tobytes() for k in range(4)]
    table = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(table[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").ravel()
    table = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(table, axis=1, bitorder="little").view("<u4").ravel()


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: bool = False, block: int = BLOCK, level: int = 1) -> bytes:
    """The bytes of one shard file."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    chunks = [ids[a : a + block] for a in range(0, len(ids), block)]
    planes = [[pack(p) for p in to_planes(c, bits)] for c in chunks]
    index = b"".join(struct.pack(f"<{1 + len(ps)}I", len(c), *map(len, ps)) for c, ps in zip(chunks, planes, strict=True))
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    tail = [pack(x) for x in (keys.tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.asarray(lengths, "<u4").tobytes())]
    head = _HEAD.pack(b"TWTS", 1, int(bits), block, len(doc_ids), len(ids), len(chunks))
    return head + index + b"".join(chain.from_iterable(planes)) + b"".join(struct.pack("<I", len(x)) + x for x in tail)


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and ids of a shard file."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    magic, version, bits, _, n_docs, n_ids, n_chunks = _HEAD.unpack_from(data)
    if magic != b"TWTS" or version != 1:
        raise ValueError("not a token shard")
    width = 32 if bits else 4
    index = np.frombuffer(data, "<u4", n_chunks * (1 + width), _HEAD.size).reshape(n_chunks, 1 + width)
    at, ids = _HEAD.size + index.nbytes, [np.empty(0, "<u4")]
    for n, *sizes in index.tolist():
        planes = []
        for size in sizes:
            planes.append(unpack(data[at : at + size]))
            at += size
        ids.append(from_planes(planes, n))
    tail = []
    for _ in range(3):
        (size,) = struct.unpack_from("<I", data, at)
        tail.append(unpack(data[at + 4 : at + 4 + size]))
        at += 4 + size
    keys, nulls = np.frombuffer(tail[0], "<i8").tolist(), tail[1]
    found = np.concatenate(ids)
    if len(found) != n_ids or len(keys) != n_docs:
        raise ValueError("a token shard is damaged")
    return [None if gone else k for k, gone in zip(keys, nulls, strict=True)], np.frombuffer(tail[2], "<u4"), found


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    return pool[np.arange(total, dtype=kind) + np.repeat((starts - (ends - sizes)).astype(kind), sizes)]


class WordEncoder:
    """Ids of whole texts by way of their distinct non-blank runs.

    Runs are given to the library many at a time, as words of one text.  The model marks
    each word's last token, which tells the words of plain letters apart; other runs, which
    can be several words each, have a word of their own between them.
    """

    def __init__(self, model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_str(model.decode())
        # Lower-case letters of the first Latin blocks are their own normal form and one unit of
        # the split, so for words of them alone normalising and splitting can be left out.
        self.plain = Tokenizer.from_str(model.decode())
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(_LAST)]] = True
        between = self.model.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 and self._marks_ends() else None
        self.clear()

    def _marks_ends(self) -> bool:
        """Whether this model marks the last tokens of words, and of those only."""
        ids = np.array(self.plain.encode("abc zyxwvutsrq m", add_special_tokens=False).ids)
        return bool(self.last[ids].sum() == 3 and self.last[ids[-1]])

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int32)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _together(self, tokenizer, words: list[str], between: str) -> np.ndarray:
        flat, _ = self._ids(tokenizer, [between.join([*words[k : k + TOGETHER], ""]) for k in range(0, len(words), TOGETHER)])
        return flat

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many each has); a plain word with marks after it is two units, which are encoded once each."""
        if self.between is None:
            return self._ids(self.model, words)
        every = pa.array(words, pa.string())
        stems = pc.utf8_rtrim(every, _MARKS)
        plain = pc.match_substring_regex(stems, _PLAIN).to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.match_substring(every, "<|"), pc.match_substring(every, _BETWEEN)).to_numpy(zero_copy_only=False)
        starts, sizes = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        pools, at = [self.flat[: self.ends[-1]]], int(self.ends[-1])

        def put(which: np.ndarray, column: int, code: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
            nonlocal at
            begin = np.cumsum(counts) - counts + at
            starts[which, column], sizes[which, column] = begin[code], counts[code]
            pools.append(flat)
            at += len(flat)

        if len(which := np.flatnonzero(plain)):
            coded = pc.dictionary_encode(stems.filter(pa.array(plain)))
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            known = np.fromiter((self.place.get(x, -1) for x in names), np.int64, len(names))
            met = known[code] >= 0  # stems that are words met before
            begin, end = self.ends[known], self.ends[known + 1]
            starts[which[met], 0], sizes[which[met], 0] = begin[code[met]], (end - begin)[code[met]]
            fresh = np.flatnonzero(known < 0)
            if len(fresh):
                flat = self._together(self.plain, [names[k] for k in fresh.tolist()], " ")
                place = np.zeros(len(names), np.int64)
                place[fresh] = np.arange(len(fresh))
                put(which[~met], 0, place[code[~met]], flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1))
            own = pc.utf8_length(stems).to_numpy(zero_copy_only=False)
            whole = pc.utf8_length(every).to_numpy(zero_copy_only=False)
            ending = which[whole[which] > own[which]]
            if len(ending):
                tails = pc.dictionary_encode(pa.array([words[k][n:] for k, n in zip(ending.tolist(), own[ending].tolist(), strict=True)], pa.string()))
                put(ending, 1, tails.indices.to_numpy(), *self._ids(self.model, tails.dictionary.to_pylist()))
        if len(which := np.flatnonzero(~plain & ~odd)):
            flat = self._together(self.model, [words[k] for k in which.tolist()], f" {_BETWEEN} ")
            cuts = np.flatnonzero(flat == self.between)
            real = flat != self.between
            put(which, 0, np.arange(len(which)), flat[real], np.diff(cuts, prepend=-1) - 1)
        if len(which := np.flatnonzero(~plain & odd)):
            put(which, 0, np.arange(len(which)), *self._ids(self.model, [words[k] for k in which.tolist()]))
        return _gather(np.concatenate(pools), starts.ravel(), sizes.ravel()), sizes.sum(axis=1)

    def _learn(self, words: list[str]) -> None:
        if len(self.place) > CACHE:  # words met once go, with what is known of them
            again = np.flatnonzero(self.met > 1)
            names = list(self.place)
            flat, ends = self.flat, self.ends
            self.clear()
            if len(again) < CACHE // 2:
                sizes = ends[again + 1] - ends[again]
                self._add([names[k] for k in again.tolist()], _gather(flat, ends[again], sizes), sizes)
        new = [w for w in words if w not in self.place]
        if new:
            self._add(new, *self._encode_words(new))

    def _add(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if not new:
            return
        ends = self.ends[-1] + np.cumsum(sizes)
        if ends[-1] > len(self.flat):
            self.flat = np.resize(self.flat, int(ends[-1] * 1.5))
        self.flat[self.ends[-1] : ends[-1]] = ids
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.ends = np.concatenate([self.ends, ends])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, ids) of the texts, each with the end id after it."""
        runs = pc.ascii_split_whitespace(texts)
        per_text = pc.list_value_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(runs.flatten())
        # The model folds case, but not that of special tokens, and composes marks before it does.
        folds = pc.and_(pc.string_is_ascii(coded.dictionary), pc.invert(pc.match_substring(coded.dictionary, "<|")))
        folded = pc.dictionary_encode(pc.if_else(folds, pc.ascii_lower(coded.dictionary), coded.dictionary))
        words = folded.dictionary.to_pylist()
        self._learn(words)
        own = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        self.met[own] += 1
        place = own[folded.indices.to_numpy(zero_copy_only=False)]
        starts, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        code = coded.indices.to_numpy(zero_copy_only=False)
        # One more, made-up word at each text's end stands for the end id.
        n_texts, slots = len(per_text), len(code) + len(per_text)
        last = np.cumsum(per_text + 1) - 1
        inner = np.ones(slots, bool)
        inner[last] = False
        size, start = np.ones(slots, np.int64), np.zeros(slots, np.int64)
        size[inner], start[inner] = sizes[code], starts[code]
        offset = np.cumsum(size)
        ids = _gather(self.flat, start, size)
        ids[offset[last] - 1] = end_id
        return np.diff(offset[last], prepend=0) if n_texts else np.empty(0, np.int64), ids


_encoders: dict[int, WordEncoder] = {}


def word_encoder(model: bytes) -> WordEncoder:
    key = binascii.crc32(model)
    if key not in _encoders:
        _encoders[key] = WordEncoder(model)
    return _encoders[key]


def write_shards(docs: DataFrame, model: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode the documents and write shard files; returns them as (part, seq, start, n_docs, n_ids, data).

    ``model`` is the text of a tokenizers file, under 2 MB.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # Beside the id, the text and at last the row: so many rows of one id, or of none, are dealt over partitions too.
    keys = [F.col("_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    ordered = rows.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = word_encoder(shared.value), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            lengths, ids = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            row = [[part], [seq], [len(keys)], [len(ids)], [write_shard(keys, lengths, ids, bits)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_ids", "data"])

        total = 0
        for some in gathered(batches, "_text", CHARS):
            lengths, ids = encoder.encode(some["_text"], end_id)
            keys += some["_id"].to_pylist()
            held.append((lengths, ids))
            total += len(ids)
            if total >= shard_ids:
                yield shard()
                keys, held, total, seq = [], [], 0, seq + 1
        if keys:
            yield shard()

    written = stage(in_arrow(ordered, work, "part int, seq int, n_docs int, n_ids long, data binary"), "token-shards")
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # one row for each task of the writer
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_in")).join(offsets, "part")
    index = starts.select(F.col("part").alias("_p"), F.col("seq").alias("_s"), (F.col("_before") + F.col("_in")).alias("start"))
    index = stage(index, "token-shard-index")
    return written.join(index, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s"))).select("part", "seq", "start", "n_docs", "n_ids", "data")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, read from the shard files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch["start"].to_pylist(), batch["data"], strict=True):
                keys, lengths, ids = read_shard(data.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                for a, b in _blocks(ends, 1_000_000):
                    lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
                    offsets = (np.concatenate([[lo], ends[a:b]]) - lo) * 4
                    raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids[lo:hi].astype("<u4").tobytes())])
                    at = start + np.concatenate([[lo], ends[a : b - 1]])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(at.astype(np.int64)), pa.array(lengths[a:b].astype(np.int64)), raw], ["doc_id", "start", "n_tokens", "ids"])

    return in_arrow(shards.select("start", "data"), work, "doc_id long, start long, n_tokens long, ids binary")


def _blocks(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` ids."""
    cuts = np.flatnonzero(np.diff(ends // most, prepend=0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(ends)], strict=True):
        if a < b:
            yield int(a), int(b)


def export_files(shards: DataFrame, folder: str) -> int:
    """Write the shard files, one at a time, into a folder of the driver's file system; returns how many."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for row in shards.select("start", "data").toLocalIterator():
        Path(folder, f"tokens-{row['start']:016d}.twts").write_bytes(bytes(row["data"]))
        n += 1
    return n
