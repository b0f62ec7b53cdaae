"""Words of texts as 64-bit hashes, for whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text).

    Words are runs of other characters than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.
    """
    import xxhash

    runs = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(runs.flatten())
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:  # at the ends of texts that begin or end with white space
        real = code != words.index("")
        owner, code = owner[real], code[real]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    return hashes[code], np.bincount(owner, minlength=len(texts))


def parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` characters."""
    chars = pc.fill_null(pc.utf8_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(chars) // most, prepend=0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(chars)], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of text and at most ``rows`` rows, whatever Arrow's are."""
    held: list[pa.RecordBatch] = []
    size = n = 0
    for batch in batches:
        for part in parts(batch, column, most):
            for a in range(0, len(part), rows):
                piece = part.slice(a, rows)
                more = piece[column].nbytes
                if held and (size + more > most or n + len(piece) > rows):
                    yield pa.concat_batches(held)
                    held, size, n = [], 0, 0
                held.append(piece)
                size, n = size + more, n + len(piece)
    if held:
        yield pa.concat_batches(held)
