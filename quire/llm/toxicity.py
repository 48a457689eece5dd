"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features of a whole text: densities of an insult lexicon (a fixed seed plus words that the labelled rows show to be
telling), how near the hits stand to second-person words, capitals, punctuation, and how often words are obfuscated
(letters swapped for digits or signs, signs inside words, stretched letters). Trees are boosted on a bounded sample of
labelled rows; the calibration curve is fitted on out-of-fold scores.

Scoring is one scan of the texts without a shuffle; the model (a few kilobytes) travels with the task.

Defined results: null and empty texts have zero features and get the score that those have; repeated rows score alike;
rows without an id are scored and never learned from; without labelled rows of both classes the score is
hits / (hits + 3) of the seed lexicon; extra columns are ignored or, by toxic_filter, kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkernel as tk
from quire.llm.boosting import Boosted, Isotonic, boost, isotonic, sigmoid
from quire.llm.common import drop_written, id_text_crc, set_aside, written

#: Labelled rows that a model is fitted on at most.
SAMPLE = 6000
#: A word joins the lexicon if this share of the toxic sample has it, in so many rows at least, and so many times the share elsewhere.
LEARNED_SHARE, LEARNED_ROWS, LEARNED_ODDS = 0.03, 4, 12.0
#: Parts of the sample, by hash of the text, that are scored without their own labels.
FOLDS = 4
#: Words between a hit and a second-person word that count as near.
NEAR = 6

# Seed insults and second-person words of four languages.
SEED = (
    "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile fool garbage vermin filth "
    "dummkopf trottel abschaum wertlos widerlich blöd blödmann depp arschloch "
    "imbécile crétin abruti débile ordure minable pathétique dégueulasse connard "
    "idiota imbécil estúpido estúpida basura escoria inútil patético asqueroso payaso"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()

#: Signs that stand for letters.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _sign, _letter in zip("013457@$!", "oieastasi", strict=True):
    _PLAIN[ord(_sign)] = ord(_letter)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_ALNUM = _LETTER.copy()
_ALNUM[48:58] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True

FEATURES = ("words", "density", "hits", "kinds", "obfuscated", "near_second", "second", "capitals", "capital_words", "exclaims", "punctuation", "mixed", "stretched", "dense_window")


def _hash_words(items) -> np.ndarray:
    raw, offsets = tk.utf8(pa.array(list(items), type=pa.string()))
    return np.unique(tk.range_hashes(tk.lower_ascii(raw), offsets[:-1], offsets[1:]))


def _core(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges without the signs around them."""
    n = len(raw)
    solid = _ALNUM[raw]
    at = np.arange(n)
    after = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1] if n else at
    before = np.maximum.accumulate(np.where(solid, at, -1)) if n else at
    s = np.minimum(after[starts], ends) if n else starts
    e = np.maximum(before[np.maximum(ends - 1, 0)] + 1, s) if n else ends
    return s, e


def _member(sorted_set: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), dtype=bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)] == h


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def word_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word without the signs around it, first word of each text)."""
    starts, ends, first = tk.words(raw, offsets)
    s, e = _core(raw, starts, ends)
    return tk.range_hashes(tk.lower_ascii(raw), s, e), first


def features(raw: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    count = len(offsets) - 1
    starts, ends, first = tk.words(raw, offsets)
    s, e = _core(raw, starts, ends)
    h = tk.range_hashes(tk.lower_ascii(raw), s, e)
    # letters behind signs: swap look-alikes, drop what is still no letter
    plain = _PLAIN[raw]
    keep = _LETTER[plain]
    moved = np.concatenate(([0], np.cumsum(keep)))
    shown = tk.range_hashes(plain[keep], moved[s], moved[e])
    plainly = _member(lexicon, h)
    hidden = _member(lexicon, shown) & ~plainly & (e > s)
    hit = plainly | hidden
    is_second = _member(second, h)
    n = np.maximum(np.diff(first), 1).astype(float)
    number = np.arange(len(h))
    owner = np.repeat(np.arange(count), np.diff(first))
    at = np.flatnonzero(hit)
    near = np.zeros(len(h))
    kinds = np.zeros(count)
    dense = np.zeros(count)
    if len(at):
        spots = np.flatnonzero(is_second)
        if len(spots):
            right = np.searchsorted(spots, at)
            for side in (np.clip(right - 1, 0, len(spots) - 1), np.clip(right, 0, len(spots) - 1)):
                ok = (np.abs(spots[side] - at) <= NEAR) & (owner[spots[side]] == owner[at])
                near[at[ok]] = 1
        pairs = np.unique(np.stack([owner[at].astype(np.uint64), np.where(plainly[at], h[at], shown[at])]), axis=1)
        kinds = np.bincount(pairs[0].astype(np.int64), minlength=count).astype(float)
        # hits among a hit and the 24 words after it
        ahead = np.searchsorted(at, np.minimum(number[at] + 25, first[owner[at] + 1])) - np.arange(len(at))
        np.maximum.at(dense, owner[at], ahead)
    letters = np.maximum(_per_text(_LETTER[raw], offsets), 1)
    upper = (raw >= 65) & (raw <= 90)
    size = np.maximum(np.diff(offsets), 1)
    alpha_c = np.concatenate(([0], np.cumsum(_LETTER[raw])))
    upper_c = np.concatenate(([0], np.cumsum(upper)))
    punct_c = np.concatenate(([0], np.cumsum(_PUNCT[raw] | ((raw >= 48) & (raw <= 57)))))
    loud = (upper_c[e] - upper_c[s] == alpha_c[e] - alpha_c[s]) & (upper_c[e] - upper_c[s] >= 2)
    mixed = (punct_c[e] - punct_c[s] > 0) & (alpha_c[e] - alpha_c[s] > 0)
    same = np.zeros(len(raw) + 1)
    if len(raw) > 2:
        same[2:-1] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & _LETTER[raw[2:]]
    hits, seconds = _per_text(hit, first), _per_text(is_second, first)
    columns = (np.log1p(np.diff(first)), hits / n, np.log1p(hits), kinds, _per_text(hidden, first) / n, _per_text(near, first) / np.maximum(hits, 1), seconds / n, _per_text(upper, offsets) / letters, _per_text(loud, first) / n, _per_text(raw == 33, offsets) / size, _per_text(_PUNCT[raw], offsets) / size, _per_text(mixed, first) / n, _per_text(same[:-1], offsets) / size, dense)
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Model:
    lexicon: np.ndarray
    trees: Boosted | None = None
    curve: Isotonic | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or self.curve is None:
            hits = np.expm1(x[:, 2])
            return hits / (hits + 3)
        raw = sigmoid(self.trees.raw(x))
        return np.clip(0.999 * self.curve(raw) + 0.001 * raw, 0, 1)


def sampled(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """text and label of the labelled training rows with the smallest id hashes, limit at most (so it may be broadcast)."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_text_crc() % 5 != 0)).select("doc_id", *[c for c in ("quality", "toxic") if c in labels.columns])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), *chosen.columns).limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").drop("doc_id")


def telling_words(bags: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Words that toxic rows have far more often than others, with the seed lexicon."""
    seed = _hash_words(SEED)
    if not len(y) or y.min() == y.max():
        return seed
    words, toxic = np.unique(np.concatenate([b for b, v in zip(bags, y, strict=True) if v]), return_counts=True)
    others, elsewhere = np.unique(np.concatenate([b for b, v in zip(bags, y, strict=True) if not v]), return_counts=True)
    plain = np.zeros(len(words))
    if len(others):
        found = np.minimum(np.searchsorted(others, words), len(others) - 1)
        plain = np.where(others[found] == words, elsewhere[found], 0)
    pos, neg = y.sum(), len(y) - y.sum()
    telling = (toxic >= max(LEARNED_ROWS, LEARNED_SHARE * pos)) & ((toxic / pos) >= LEARNED_ODDS * (plain + 0.5) / neg)
    return np.union1d(seed, words[telling])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> Model:
    """Lexicon, trees and calibration curve. Equal texts are in one fold, and a fold's scores, on which the curve is
    fitted, come from a lexicon and trees that have seen none of its labels."""
    second = _hash_words(SECOND_PERSON)
    # the sample is bounded, read from the documents once and kept
    sample = written(sampled(docs, labels, label, limit).select(F.col(label).cast("int").alias("label"), "text", F.xxhash64("text").alias("key")).coalesce(8), "toxic-sample")

    def bags(batches):
        for rows, raw, offsets in tk.pieces(batches, "text"):
            h, first = word_keys(raw, offsets)
            bag = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(bag, pa.binary())], ["label", "key", "bag"])

    rows = sample.mapInArrow(bags, "label int, key long, bag binary").toPandas().drop_duplicates(["key", "label"]).sort_values(["key", "label"])
    y = (rows["label"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        drop_written(sample)
        return Model(_hash_words(SEED))
    bag_of, fold = [np.frombuffer(b, np.uint64) for b in rows["bag"]], rows["key"].to_numpy() % FOLDS
    # the last lexicon is that of all rows
    lexicons = [telling_words([b for b, k in zip(bag_of, fold, strict=True) if k != own], y[fold != own]) for own in range(FOLDS + 1)]

    def dense(batches):
        for rows, raw, offsets in tk.pieces(batches, "text"):
            x = np.stack([features(raw, offsets, lexicon, second) for lexicon in lexicons], axis=1)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["label", "key", "x"])

    rows = sample.mapInArrow(dense, "label int, key long, x binary").toPandas().sort_values(["key", "label"])
    drop_written(sample)
    x = np.stack([np.frombuffer(b).reshape(FOLDS + 1, -1) for b in rows["x"]])
    y, fold = (rows["label"].to_numpy() > 0).astype(float), rows["key"].to_numpy() % FOLDS
    held = np.full(len(y), y.mean())
    for k in range(FOLDS):
        own = fold == k
        if own.any() and len(set(y[~own])) == 2:
            held[own] = sigmoid(boost(x[~own, k], y[~own]).raw(x[own, k]))
    return Model(lexicons[FOLDS], boost(x[:, FOLDS], y), isotonic(held, y))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score; one scan, nothing is shuffled."""
    fields = docs.select(*keep).schema
    second = _hash_words(SECOND_PERSON)

    def scored(batches):
        for rows, raw, offsets in tk.pieces(batches, "text"):
            s = model(features(raw, offsets, model.lexicon, second))
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in keep], pa.array(s, pa.float64())], [*keep, "score"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scored, schema)


def toxic_filter(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """docs, in their own columns, without those whose score reaches limit."""
    own, names = set_aside(docs, ("score",))
    return score(own, model, tuple(own.columns)).where(F.col("score") < limit).select(*[F.col(f"`{names[c]}`").alias(c) for c in docs.columns])
