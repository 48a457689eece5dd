"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score z into grades:
P(grade <= k) = sigmoid(threshold[k] - z). The grades come from the two labels: 2 * quality + (1 - toxic), so 0 and 1
are bad documents, 2 and 3 good ones. A fit gives the expected grade and the tail probability P(grade >= 2), by which
documents are selected.

Features of a whole text: shares of hashed words (A-Z lower-cased, signs around them cut off), of hashed word tails
(the last three bytes as they stand) and of word shapes, and hashed bins of length, repetition and line repetition.
Scoring is one scan without a shuffle. The fit uses a bounded sample of labelled rows.

Defined results: null and empty texts have no words, and get the score of the bins alone; repeated rows score alike;
rows without an id are scored, never learned from; a missing quality label leaves a row out, a missing toxic label
counts as 0; with no labelled rows the tail probability is 0.5 everywhere (nothing is rejected); extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkernel as tk
from quire.llm.boosting import sigmoid
from quire.llm.common import set_aside
from quire.llm.toxicity import _core, sampled

#: Labelled rows that a model is fitted on at most.
SAMPLE = 3000
#: Hash buckets of the weight vector; part of the model's format.
BUCKETS = 1 << 16
GRADES = 4

_TAIL, _SHAPE, _BIN = (np.uint64(x) for x in (0x51ED270B7A0F9A3D, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25))


def _bin(kind: int, value: np.ndarray) -> np.ndarray:
    return tk.mix(np.array([kind], dtype=np.uint64) * _BIN + value.astype(np.uint64)) & np.uint64(BUCKETS - 1)


def coded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets as three rows, first word of each text, bin buckets as one row per text)."""
    starts, ends, first = tk.words(raw, offsets)
    s, e = _core(raw, starts, ends)
    low = tk.lower_ascii(raw)
    word = tk.range_hashes(low, s, e)
    tail = tk.mix(tk.range_hashes(raw, np.maximum(starts, ends - 3), ends) + _TAIL)
    upper = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
    lower = np.concatenate(([0], np.cumsum((raw >= 97) & (raw <= 122))))
    caps, smalls = upper[ends] - upper[starts], lower[ends] - lower[starts]
    size = np.minimum(ends - starts, 24)
    shape = (np.minimum(caps, 2) * 2 + (smalls > 0)) * 32 + size
    shape = tk.mix(shape.astype(np.uint64) + _SHAPE)
    mask = np.uint64(BUCKETS - 1)
    buckets = np.stack([word & mask, tail & mask, shape & mask]).astype(np.int64)
    n = np.diff(first)
    count = len(n)
    # repetition: words equal to the one before, and words whose next-but-k twin stands close by
    same = np.zeros(len(word) + 1)
    same[1:-1] = word[1:] == word[:-1] if len(word) > 1 else 0
    inner = first[:-1][n > 0]
    same[inner] = 0
    total = np.concatenate(([0], np.cumsum(same)))
    again = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
    kinds = np.fromiter((len(np.unique(word[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)), np.float64, count)
    fresh = kinds / np.maximum(np.sqrt(n), 1)
    loud = np.concatenate(([0], np.cumsum((caps >= 2) & (smalls == 0))))
    loud = (loud[first[1:]] - loud[first[:-1]]) / np.maximum(n, 1)
    signs = np.concatenate(([0], np.cumsum((ends - starts) > (e - s) + 1)))
    signs = (signs[first[1:]] - signs[first[:-1]]) / np.maximum(n, 1)
    rows = (np.log2(n + 1), np.minimum(again * 20, 19), np.minimum(fresh * 4, 60), np.minimum(loud * 20, 19), np.minimum(signs * 20, 19))
    bins = np.stack([_bin(k, np.floor(v)) for k, v in enumerate(rows)], axis=1).astype(np.int64)
    return buckets, first, bins


def latent(weights: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """z of each text: mean weight of its words, tails and shapes, plus the weights of its bins."""
    buckets, first, bins = coded(raw, offsets)
    total = np.concatenate(([0], np.cumsum(weights[buckets].sum(0))))
    n = np.diff(first)
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1) + weights[bins].sum(1)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 2, a column each."""
        return sigmoid(z[:, None] - self.thresholds[None, :])


def _fit(index: np.ndarray, owner: np.ndarray, value: np.ndarray, grade: np.ndarray, steps: int = 200, rate: float = 0.15, ridge: float = 2e-5) -> Ordinal:
    """Adam on the mean negative log likelihood; thresholds are kept in order by log gaps."""
    used, index = np.unique(index, return_inverse=True)
    n = len(grade)
    share = np.clip(np.array([(grade > k).mean() for k in range(GRADES - 1)]), 1e-3, 1 - 1e-3)
    cuts = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    w = np.zeros(len(used) + 1 + len(gaps))
    w[len(used)], w[len(used) + 1 :] = cuts[0], gaps
    m, v = np.zeros_like(w), np.zeros_like(w)
    low, high = np.maximum(grade - 1, 0), np.minimum(grade, GRADES - 2)
    for step in range(1, steps + 1):
        head, gap = w[: len(used)], np.exp(w[len(used) + 1 :])
        cuts = w[len(used)] + np.concatenate(([0], np.cumsum(gap)))
        z = np.bincount(owner, head[index] * value, n)
        up = np.where(grade == GRADES - 1, 1.0, sigmoid(cuts[high] - z))
        down = np.where(grade == 0, 0.0, sigmoid(cuts[low] - z))
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = up * (1 - up) / p / n, down * (1 - down) / p / n
        grad = np.empty_like(w)
        grad[: len(used)] = np.bincount(index, (d_up - d_down)[owner] * value, len(used)) + ridge * head
        g_cut = np.bincount(low, d_down, GRADES - 1) - np.bincount(high, d_up, GRADES - 1)
        grad[len(used)] = g_cut.sum()
        grad[len(used) + 1 :] = g_cut[::-1].cumsum()[::-1][1:] * gap
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = w[: len(used)]
    return Ordinal(weights, w[len(used)] + np.concatenate(([0], np.cumsum(np.exp(w[len(used) + 1 :])))))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Ordinal:
    sample = sampled(docs, labels, "quality", limit)
    has_toxic = "toxic" in labels.columns

    def sparse(batches):
        for rows, raw, offsets in tk.pieces(batches, "text"):
            buckets, first, bins = coded(raw, offsets)
            grade = 2 * (rows.column(rows.schema.get_field_index("quality")).to_numpy(zero_copy_only=False) > 0)
            toxic = rows.column(rows.schema.get_field_index("toxic")).fill_null(0).to_numpy(zero_copy_only=False) if has_toxic else np.zeros(len(grade))
            out = []
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                at, n = np.unique(buckets[:, a:b], return_counts=True)
                out.append((np.concatenate((at, bins[k])).astype(np.int32).tobytes(), np.concatenate((n / max(b - a, 1), np.ones(bins.shape[1]))).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(grade + (toxic <= 0), pa.int32()), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["grade", "at", "value"])

    rows = sample.mapInArrow(sparse, "grade int, at binary, value binary").toPandas().sort_values(["at", "grade"])
    if not len(rows):
        return Ordinal(np.zeros(BUCKETS), np.array([-1.0, 0.0, 1.0]))
    at = [np.frombuffer(b, np.int32) for b in rows["at"]]
    owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
    value = np.concatenate([np.frombuffer(b, np.float32) for b in rows["value"]]).astype(np.float64)
    return _fit(np.concatenate(at), owner, value, rows["grade"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Ordinal, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, expected_grade and tail_probability; one scan, nothing is shuffled."""
    fields = docs.select(*keep).schema

    def scored(batches):
        for rows, raw, offsets in tk.pieces(batches, "text"):
            p = model.grades(latent(model.weights, raw, offsets))
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in keep], pa.array(p.sum(1)), pa.array(p[:, GRADES // 2 - 1])], [*keep, "expected_grade", "tail_probability"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "expected_grade double", "tail_probability double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scored, schema)


def quality_filter(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """docs, in their own columns, whose tail probability is least or more."""
    own, names = set_aside(docs, ("expected_grade", "tail_probability"))
    return score(own, model, tuple(own.columns)).where(F.col("tail_probability") >= least).select(*[F.col(f"`{names[c]}`").alias(c) for c in docs.columns])
