"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank is good or bad.  The potentials of a line are sums of
weights of binned features of the line itself and of its neighbours, the potentials
of a pair of lines are a 2 x 2 matrix.  The forward-backward recursion gives each
line's probability of being good; the mean of these, weighted by the lines' lengths,
is the document's quality, which a logistic curve fitted on the learning rows turns
into the probability of label 1.

There are no labels of lines: in learning, a line has its document's label.  The
model is fitted on whole texts of at most about ``sample_rows`` labelled documents
chosen by a hash of the id; in the order of that hash their binned features (one byte
each) come to the driver, of each document whose lines still fit into ``SAMPLE_LINES``.

Defined results: a null or blank text has no lines and gets the share of label 1 among
learned texts without lines, which counts a text of surely bad lines beside them;
rows that repeat an id are scored each for itself; a document labelled more than once
counts with its least label; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow
from tidewell.plans.staging import stage, unstage

SAMPLE_ROWS, SAMPLE_LINES = 6_000, 200_000
STEPS = 120
#: Upper edges of the bins of each feature: shares of characters of a class, then numbers of words and ratios.
_SHARES = [0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5]
BINS = {
    "upper": _SHARES,
    "digit": _SHARES,
    "symbol": _SHARES,
    "mark": _SHARES,
    "other": _SHARES,
    "repeated": [0.0, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8],
    "adjacent": [0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7],
    "word": [2.5, 3.5, 4.5, 5.0, 5.5, 6.5, 8.0],
    "words": [1, 3, 8, 20, 50, 120, 400],
    "seen": [0, 1, 2, 4, 8, 16, 32],
}
_N_BINS = 8
_KINDS = np.zeros(256, np.int8)  # 1 upper, 2 digit, 3 symbol, 4 mark, 5 other than ASCII
_KINDS[[*range(65, 91)]], _KINDS[[*range(48, 58)]], _KINDS[128:] = 1, 2, 5
_KINDS[list(b"#$%&*+/<=>@\\^_`{|}~")] = 3
_KINDS[list(b"!?.,;:()[]-\"'")] = 4


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of each line's features, each line's length, number of lines of each text)."""
    lines: list[str] = []
    per_text = np.zeros(len(texts), np.int64)
    rows: list[tuple[int, int, int, int]] = []
    for k, text in enumerate(texts):
        seen: dict[str, int] = {}
        own = [x for x in text.split("\n") if x and not x.isspace()]
        per_text[k] = len(own)
        lines += own
        for line in own:
            words = line.split()
            times = seen.get(line, 0)
            seen[line] = times + 1
            kinds = len(set(words))
            adjacent = sum(map(str.__eq__, words, words[1:])) if kinds < len(words) else 0
            rows.append((len(words), kinds, adjacent, times))
    if not lines:
        return np.empty((0, len(BINS)), np.int8), np.empty(0, np.int64), per_text
    coded = [x.encode("utf-8", "surrogatepass") for x in lines]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    kinds_of = _KINDS[np.frombuffer(b"".join(coded), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    shares = [np.add.reduceat(kinds_of == k, starts, dtype=np.int64) / sizes for k in range(1, 6)]
    words, kinds, adjacent, times = np.array(rows, np.int64).T
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    values = [*shares, 1 - kinds / words, adjacent / words, (lengths + 1) / words - 1, words, times]
    return np.stack([np.searchsorted(edges, v, "left") for edges, v in zip(BINS.values(), values, strict=True)], axis=1).astype(np.int8), lengths, per_text


def _neighbours(bins: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Feature numbers of each line: its own, those of the line before and those of the line after (0 where none)."""
    width = bins.shape[1]
    own = bins.astype(np.int64) + np.arange(width) * _N_BINS + 1
    ends = np.cumsum(per_text)
    first, last = np.zeros(len(bins), bool), np.zeros(len(bins), bool)
    first[(ends - per_text)[per_text > 0]], last[ends[per_text > 0] - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    block = width * _N_BINS + 1
    return np.concatenate([own, np.where(first[:, None], 0, before) + block, np.where(last[:, None], 0, after) + 2 * block], axis=1)


@dataclass
class LineCRF:
    weights: np.ndarray  # of being good against bad, for each feature number
    pairs: np.ndarray  # [before, after]
    slope: float = 1.0
    shift: float = 0.0
    empty: float = 0.0  # probability of label 1 for a text without lines

    @classmethod
    def blank(cls) -> LineCRF:
        return cls(np.zeros(3 * (len(BINS) * _N_BINS + 1)), np.zeros((2, 2)))

    def marginals(self, features: np.ndarray, per_text: np.ndarray, want_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of being good; sums of the pairs' probabilities.

        Texts go side by side, longest first, so that step t touches only texts of over t lines.
        """
        unary = self.weights[features].sum(axis=1)
        potential = np.stack([np.zeros(len(unary)), unary], axis=1)
        order = np.argsort(-per_text, kind="stable")
        lengths = per_text[order]
        starts = (np.cumsum(per_text) - per_text)[order]
        steps = int(lengths[0]) if len(lengths) else 0
        live = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts with a line t
        forward, backward = np.zeros_like(potential), np.zeros_like(potential)
        for t in range(steps):
            at = starts[: live[t]] + t
            now = potential[at]
            if t:
                now = now + np.logaddexp(forward[at - 1, :1] + self.pairs[0], forward[at - 1, 1:] + self.pairs[1])
            forward[at] = now - now.max(axis=1, keepdims=True)
        pair_sums = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            onward = potential[at + 1] + backward[at + 1]
            if want_pairs:
                joint = forward[at][:, :, None] + self.pairs + onward[:, None, :]
                joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
                pair_sums += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            now = np.logaddexp(onward[:, :1] + self.pairs[:, 0], onward[:, 1:] + self.pairs[:, 1])
            backward[at] = now - now.max(axis=1, keepdims=True)
        both = forward + backward
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pair_sums

    def fit(self, bins: np.ndarray, lengths: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = STEPS, decay: float = 1e-3) -> LineCRF:
        """Maximise the conditional likelihood of the lines' labels by adaptive gradient steps."""
        features = _neighbours(bins, per_text)
        truth = np.repeat(labels, per_text)
        n = max(1, len(truth))
        real_pairs = np.zeros((2, 2))
        for label in (0, 1):
            real_pairs[label, label] = np.maximum(0, per_text[labels == label] - 1).sum()
        size = np.zeros_like(self.weights), np.zeros_like(self.pairs)
        for _ in range(steps):
            good, pairs = self.marginals(features, per_text, want_pairs=True)
            slope = np.zeros_like(self.weights)
            error = truth - good
            for k in range(features.shape[1]):
                slope += np.bincount(features[:, k], error, len(slope))
            for value, grad, past in ((self.weights, slope / n - decay * self.weights, size[0]), (self.pairs, (real_pairs - pairs) / n - decay * self.pairs, size[1])):
                past += grad**2
                value += 0.3 * grad / np.sqrt(past + 1e-12)
        quality = self.quality(bins, lengths, per_text)
        x, has = np.log((quality + 1e-4) / (1 - quality + 1e-4)), per_text > 0
        a, b = 1.0, 0.0
        for _ in range(300):  # logistic curve through the documents
            error = (labels - 1 / (1 + np.exp(-(a * x + b))))[has]
            a, b = a + 0.3 * ((error * x[has]).mean() if len(error) else 0), b + 0.3 * (error.mean() if len(error) else 0)
        self.slope, self.shift = float(a), float(b)
        none = labels[~has]
        self.empty = float((none.sum() + self._curve(np.zeros(1))[0]) / (len(none) + 1))
        return self

    def _curve(self, quality: np.ndarray) -> np.ndarray:
        x = np.log((quality + 1e-4) / (1 - quality + 1e-4))
        return 1 / (1 + np.exp(-(self.slope * x + self.shift)))

    def quality(self, bins: np.ndarray, lengths: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; nan where there are no lines."""
        good, _ = self.marginals(_neighbours(bins, per_text), per_text)
        owner = np.repeat(np.arange(len(per_text)), per_text)
        with np.errstate(invalid="ignore"):
            return np.bincount(owner, good * lengths, len(per_text)) / np.bincount(owner, lengths, len(per_text))

    def score(self, texts: list[str | None]) -> np.ndarray:
        bins, lengths, per_text = line_features([t or "" for t in texts])
        return np.where(per_text > 0, self._curve(self.quality(bins, lengths, per_text)), self.empty)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> LineCRF:
    """Fit on about ``sample_rows`` labelled documents that ``allowed`` admits (a condition on the id column)."""
    marked = labels.filter(allowed).filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_label"))
    part = min(1.0, sample_rows / max(1, marked.count()))
    few = marked.withColumn("_h", F.xxhash64("_id")).filter((F.col("_h") / F.lit(2.0**64) + 0.5) <= part)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")  # about sample_rows ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label, h in zip(batch["_text"], batch["_label"].to_pylist(), batch["_h"].to_pylist(), strict=True):
                bins, lengths, _ = line_features([text.as_py() or ""])
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([label], pa.int32()), pa.array([bins.tobytes()]), pa.array([lengths.astype("<i4").tobytes()])], ["h", "label", "bins", "lengths"])

    kept: list[tuple[int, np.ndarray, np.ndarray]] = []
    lines = 0
    coded = stage(in_arrow(rows.select("_text", "_label", "_h"), work, "h long, label int, bins binary, lengths binary"), "crf-sample")
    for row in coded.orderBy("h", F.length("bins"), "label", "bins", "lengths").toLocalIterator():
        bins = np.frombuffer(row["bins"], np.int8).reshape(-1, len(BINS))
        if lines + len(bins) <= SAMPLE_LINES:
            kept.append((row["label"], bins, np.frombuffer(row["lengths"], "<i4")))
            lines += len(bins)
    unstage(coded)
    model = LineCRF.blank()
    if not kept:
        return model
    return model.fit(np.concatenate([x for _, x, _ in kept]), np.concatenate([x for _, _, x in kept]).astype(np.int64), np.array([len(x) for _, x, _ in kept]), np.array([x for x, _, _ in kept], float))


def score(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1 for every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch["_text"]), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(chars) // 4_000_000, prepend=0)) + 1  # bounded work at a time
            for a, b in zip([0, *cuts], [*cuts, len(chars)], strict=True):
                if a < b:
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.score(part["_text"].to_pylist()))], ["doc_id", "score"])

    return in_arrow(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
