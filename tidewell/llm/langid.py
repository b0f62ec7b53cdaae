"""Language identification with language-bitmask n-gram filters.

Learning counts character n-grams for each language over labelled rows and keeps, for
each language, the n-grams that are frequent in it and not much more frequent in
another.  They go into one Bloom filter for each language.  The filters are
bit-sliced: slot *s* of the table is a word whose bit *l* belongs to language *l*, so
the AND of an n-gram's slots is the mask of all languages that contain it.  64
languages fit a word; more take more words.

A text's n-grams are looked up and the bits of each language counted.  A filter with
fill *f* and *k* probes answers falsely with probability ``p = f ** k``, so of *n*
n-grams with *h* hits ``(h - n * p) / (1 - p)`` are expected to be true ones.  The
language with most of them is predicted, and their share of *n* is the score.

The labelled rows learned from are a sample of at most about ``sample_rows``, chosen
by a hash of the id and used whole; the model is of bounded size
(``languages * per_language`` n-grams) and is collected to the driver.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go
to the language first in the alphabet; without labelled rows every text is ``und``;
rows that repeat an id are judged each for itself; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow
from tidewell.llm.words import parts
from tidewell.plans.staging import compact

GRAM = 4
#: Characters of texts that are judged at a time.
CHARS = 1_000_000
SAMPLE_ROWS = 20_000
PER_LANGUAGE = 20_000
SLOTS_LOG2, PROBES = 18, 3
#: An n-gram belongs to a language if it is at least this often in it, relative to where it is most frequent.
RELATIVE = 0.2
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def grams(texts: list[str], size: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, its text's number, whether each text has a letter).

    Texts are lower-cased; every run of other characters than letters is one blank; an
    n-gram has blanks at its ends only.
    """
    coded = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    chars = np.zeros(int(lengths.sum()) + len(coded) + 1, np.uint32)  # a blank before each text and after the last
    owner = np.repeat(np.arange(len(coded)), lengths + 1)
    owner = np.append(owner, max(0, len(coded) - 1))
    starts = np.cumsum(lengths + 1) - lengths
    body = np.ones(len(chars), bool)
    body[starts - 1] = False
    body[-1] = False
    if coded:
        chars[body] = np.concatenate(coded)
    chars[~_letters()[np.minimum(chars, 0x10FFFF)]] = 0
    some = np.zeros(len(coded), bool)
    some[owner[chars > 0]] = True
    keep = (chars > 0) | np.concatenate([[True], chars[:-1] > 0])
    chars, owner = chars[keep].astype(np.uint64), owner[keep]
    n = len(chars) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), some
    mixed, inner = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        mixed = (mixed ^ (chars[k : k + n] + np.uint64(k + 1))) * _MIX[k % 4]
        mixed ^= mixed >> np.uint64(29)
        if 0 < k < size - 1:
            inner &= chars[k : k + n] > 0
    return mixed[inner], owner[1 : n + 1][inner], some


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filters; ``table[word, slot]`` has a bit for each of 64 languages."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    size: int = GRAM

    @classmethod
    def build(cls, members: dict[str, np.ndarray], size: int = GRAM, slots_log2: int = SLOTS_LOG2) -> LanguageFilter:
        languages = sorted(members)
        table = np.zeros((max(1, -(-len(languages) // 64)), 1 << slots_log2), np.uint64)
        for k, language in enumerate(languages):
            for at in cls._slots(members[language], slots_log2):
                table[k // 64, at] |= np.uint64(1) << np.uint64(k % 64)
        fill = np.array([((table[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, table, fill**PROBES, size)

    @staticmethod
    def _slots(hashes: np.ndarray, slots_log2: int) -> Iterator[np.ndarray]:
        for k in range(PROBES):
            yield ((hashes * _MIX[k]) >> np.uint64(64 - slots_log2)).astype(np.int64)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram, the words whose bits are the languages that contain it."""
        slots_log2 = self.table.shape[1].bit_length() - 1
        found = np.full((len(self.table), len(hashes)), ~np.uint64(0))
        for at in self._slots(hashes, slots_log2):
            found &= self.table[:, at]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        hashes, owner, some = grams([t or "" for t in texts], self.size)
        total = np.bincount(owner, minlength=len(texts))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        found = self.masks(hashes)
        hits = np.stack([np.bincount(owner, (found[k // 64] >> np.uint64(k % 64)) & np.uint64(1), len(texts)) for k in range(len(self.languages))])
        rate = self.false_rate[:, None]
        true = np.maximum(0, (hits - total * rate) / (1 - rate))
        best = true.argmax(axis=0)
        score = np.clip(true[best, np.arange(len(texts))] / np.maximum(1, total), 0, 1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, some, strict=True)], np.where(some, score, 0.0)


def learn(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = GRAM, sample_rows: int = SAMPLE_ROWS, per_language: int = PER_LANGUAGE) -> LanguageFilter:
    """Filters learned from rows that ``allowed`` admits; about ``sample_rows`` of them."""
    rows = docs.filter(allowed).select(F.xxhash64(F.col(id_col)).alias("_h"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).filter("_lang is not null and _text is not null")
    n = rows.count()
    # The hash is even over its range, so this share of it admits about sample_rows rows.
    part = min(1.0, sample_rows / max(1, n))
    sample = rows.filter((F.col("_h") / F.lit(2.0**64) + 0.5) < part) if part < 1 else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.dictionary_encode(batch["_lang"])
            code = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch["_text"].filter(pa.array(code == k)).to_pylist()
                for a in range(0, len(own), 500):
                    got, counts = np.unique(grams(own[a : a + 500], size)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(got.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    counted = in_arrow(sample.select("_text", "_lang"), count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).filter("n > 2")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    most = F.max("share").over(Window.partitionBy("gram"))
    own = rated.withColumn("most", most).filter(F.col("share") >= F.lit(RELATIVE) * F.col("most"))
    top = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= per_language)
    members: dict[str, list[int]] = {}
    for row in top.select("lang", "gram").collect():  # at most languages * per_language
        members.setdefault(row["lang"], []).append(row["gram"])
    return LanguageFilter.build({k: np.array(v, np.int64).view(np.uint64) for k, v in members.items()}, size)


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; the model is a few MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, scores in _predicted(shared.value, batches, "_text"):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return in_arrow(rows, work, kind)


def _predicted(model: LanguageFilter, batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Bounded parts of the batches with their predictions."""
    for batch in batches:
        for part in parts(batch, text_col, CHARS):
            yield part, *model.predict(part[text_col].to_pylist())


def keep_identified(docs: DataFrame, model: LanguageFilter, least: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with their columns, whose text is in some language with at least the score ``least``.

    Columns may have any names, those of ``identify`` included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, scores in _predicted(shared.value, batches, text_col):
            yield part.filter(pa.array([lang != "und" and score >= least for lang, score in zip(langs, scores.tolist(), strict=True)], pa.bool_()))

    return in_arrow(compact(docs, docs), work, docs.schema)
