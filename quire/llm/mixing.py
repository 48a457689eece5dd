"""Mixing sources to target weights by iterative proportional fitting.

Documents are classed by source, language and topic; tokens are summed per cell of the three (partial sums per task).
Iterative proportional fitting rakes the cells' token weights until the weighted shares of every source, language and
topic are the targets. Documents are then sampled by a hash of their id with their cell's calibrated probability: the
weights are scaled to the wanted share of the corpus, and where that takes cells beyond probability 1 all are raked again
under that bound, so that the marginals of the sample are the targets as far as the tokens there are allow. What is left
between the two is the residual that fit() gives.

Levels without a target of their own are one level, "other", which keeps its observed share if it has no target, so the cells are at most the product of the targets'
lengths plus one each, whatever the corpus holds: a proven bound for what the driver rakes and broadcasts.

Topics are told from the text's form by column expressions: signs, capitals, repeats, else its length.

Defined results: a null source or language is "other"; a null or empty text has 0 tokens, topic "brief", and the
probability of its cell; targets of levels that no document has are spread over the others of that marginal;
repeated rows share their fate if they have no id or the same id and text; an empty table gives no rows; other columns
stay in mix(), and columns named tokens, topic, weight, probability or selected are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import set_aside

#: Rounds of raking, and the largest error of a share at which it ends.
ROUNDS, ENOUGH = 200, 1e-9
OTHER = "other"
TOPICS = ("signs", "capitals", "brief", "medium", "long")


@dataclass(frozen=True)
class Targets:
    """Wanted shares of all tokens; each marginal is brought to a sum of 1."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]

    def marginals(self) -> tuple[tuple[str, dict[str, float]], ...]:
        return ("source", self.source), ("lang", self.lang), ("topic", self.topic)


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: str = "text") -> Column:
    """One of TOPICS. Byte counts by translate and octet_length, without regular expressions."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body)
    lost = lambda letters: size - F.octet_length(F.translate(body, letters, ""))
    signs, capitals = lost("%&$#*|@<>{}[]=+~^\\"), lost("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    long = F.when(size < 1000, "brief").when(size < 6000, "medium").otherwise("long")
    return F.when(signs * 20 > size, "signs").when(capitals * 5 > size, "capitals").otherwise(long)


def _level(column: str, targets: dict[str, float]) -> Column:
    known = [k for k in targets if k != OTHER]
    return F.when(F.col(column).isin(known), F.col(column)).otherwise(F.lit(OTHER)) if known else F.lit(OTHER)


def rake(tokens: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """Weights of a contingency table's cells that bring each marginal's shares to wanted, as far as cells allow.

    wanted[k] has a share per level of axis k; levels without tokens lose theirs to the others.
    """
    share = tokens / max(tokens.sum(), 1e-300)
    fitted = share.copy()
    goals = []
    for axis, want in enumerate(wanted):
        there = axis_sums(share, axis) > 0
        want = np.where(there, want, 0.0)
        goals.append(want / want.sum() if want.sum() else there / max(there.sum(), 1))
    for _ in range(ROUNDS):
        worst = 0.0
        for axis, goal in enumerate(goals):
            now = axis_sums(fitted, axis)
            worst = max(worst, float(np.abs(now - goal).max(initial=0)))
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            fitted = fitted * factor.reshape([-1 if a == axis else 1 for a in range(share.ndim)])
        if worst < ENOUGH:
            break
    return np.divide(fitted, share, out=np.zeros_like(share), where=share > 0)


def scaled(tokens: np.ndarray, weight: np.ndarray, goal: float) -> np.ndarray:
    """weight times the one factor at which sum(tokens * min(1, weight)) is goal; at least 1 where that can't be reached."""
    live = weight > 0
    if not live.any() or tokens[live].sum() <= goal:
        return np.where(live, np.maximum(weight, 1.0), 0.0)
    order = np.argsort(-weight[live], kind="stable")
    w, t = weight[live][order], tokens[live][order].astype(float)
    full = np.concatenate(([0.0], np.cumsum(t)))[:-1]  # tokens of the cells that are full before this one
    rest = np.cumsum((w * t)[::-1])[::-1]
    scale = np.divide(goal - full, rest, out=np.zeros_like(rest), where=rest > 0)
    fits = np.flatnonzero((scale * w <= 1 + 1e-12) & (scale >= 0))
    return scale[fits[0]] * weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """min(1, scale * weight), scaled so that the expected tokens are share of all; 1 everywhere weighted if they can't be."""
    return np.minimum(1.0, scaled(tokens, weight, share * tokens.sum()))


def attainable(goals: np.ndarray, there: np.ndarray, total: float) -> np.ndarray:
    """Tokens of each level that come nearest to goals (shares of total) with no more than there are; the rest is spread."""
    out, open_ = np.zeros_like(goals), goals > 0
    while open_.any() and total - out.sum() > 1e-9 * total:
        want = np.where(open_, goals, 0.0)
        out += (total - out.sum()) * want / want.sum()
        over = out >= there
        out, open_ = np.minimum(out, there), open_ & ~over
        if not over.any():
            break
    return out


def axis_sums(table: np.ndarray, axis: int) -> np.ndarray:
    return table.sum(tuple(a for a in range(table.ndim) if a != axis))


def fit(tokens: np.ndarray, wanted: list[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(raked weights, probabilities, the largest difference between a level's expected and wanted share, by axis)."""
    weight = rake(tokens, wanted)
    total = share * tokens.sum()
    latent = scaled(tokens, weight, total)
    if (latent > 1).any():
        goals = [attainable(w / max(w.sum(), 1e-300), axis_sums(tokens * (weight > 0), k), total) for k, w in enumerate(wanted)]
        for _ in range(ROUNDS):
            for axis, goal in enumerate(goals):
                for level, g in enumerate(goal):
                    at = tuple(level if a == axis else slice(None) for a in range(tokens.ndim))
                    latent[at] = np.clip(scaled(tokens[at].ravel(), latent[at].ravel(), g).reshape(latent[at].shape), 0.0, 1e6)
            chance = np.minimum(1.0, latent)
            if max(float(np.abs(axis_sums(tokens * chance, k) - g).max(initial=0)) for k, g in enumerate(goals)) < 1e-6 * max(total, 1):
                break
    chance = np.minimum(1.0, latent)
    expected = tokens * chance
    residual = [float(np.abs(axis_sums(expected, k) / max(expected.sum(), 1e-300) - w / max(w.sum(), 1e-300)).max(initial=0)) for k, w in enumerate(wanted)]
    return weight, chance, residual


_LEVELS = {"source": "_level_source", "lang": "_level_lang", "topic": "_level_topic"}


def cells(docs: DataFrame, targets: Targets) -> DataFrame:
    """docs with tokens and topic, and the levels that they count as (_LEVELS)."""
    classed = docs.withColumns({"tokens": token_count(), "topic": topic_of()})
    return classed.withColumns({_LEVELS[name]: _level(name, wanted) for name, wanted in targets.marginals()})


def _goal(table: np.ndarray, axis: int, wanted: dict[str, float], levels: list[str]) -> np.ndarray:
    """The shares wanted of an axis; "other" without a target keeps the share that it has."""
    goal = np.array([wanted.get(k, 0.0) for k in levels])
    goal /= goal.sum() or 1.0
    if OTHER not in wanted and table.sum():
        now = axis_sums(table, axis)
        at = levels.index(OTHER)
        goal *= 1 - now[at] / now.sum()
        goal[at] = now[at] / now.sum()
    return goal


def probabilities(classed: DataFrame, targets: Targets, share: float) -> DataFrame:
    """A row per cell: its levels, raked weight and sampling probability."""
    spark = classed.sparkSession
    names = [_LEVELS[name] for name, _ in targets.marginals()]
    levels = [sorted({*wanted, OTHER}) for _, wanted in targets.marginals()]
    table = np.zeros([len(x) for x in levels])
    found = classed.groupBy(*names).agg(F.sum("tokens").alias("tokens")).collect()  # a row a cell at most
    for r in found:
        table[tuple(x.index(r[n]) for n, x in zip(names, levels, strict=True))] = r["tokens"]
    wanted = [_goal(table, axis, w, x) for axis, ((_, w), x) in enumerate(zip(targets.marginals(), levels, strict=True))]
    weight, chance, _ = fit(table, wanted, share)
    rows = [(*[x[i] for x, i in zip(levels, at, strict=True)], float(weight[at]), float(chance[at])) for at in np.ndindex(*table.shape)]
    return spark.createDataFrame(rows, ", ".join([*[f"{n} string" for n in names], "weight double", "probability double"]))


def mix(docs: DataFrame, targets: Targets, share: float, seed: int = 17) -> DataFrame:
    """docs with tokens, topic, weight, probability and selected. Two scans, no shuffle of documents."""
    own, kept = set_aside(docs.drop("tokens", "topic", "weight", "probability", "selected"), tuple(_LEVELS.values()))
    classed = cells(own, targets)
    levels = list(_LEVELS.values())
    chance = probabilities(classed, targets, share)
    luck = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 11) / float(1 << 53)
    joined = classed.join(F.broadcast(chance), levels, "left").drop(*levels)  # at most the product of the targets' lengths
    mixed = joined.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "probability": F.coalesce("probability", F.lit(0.0))}).withColumn("selected", luck < F.col("probability"))
    return mixed.withColumnsRenamed({n: c for c, n in kept.items() if n != c})


#: Production targets: the sources found share alike what others leave, whatever their size; languages and topics as wanted for training.
PRODUCTION = Targets(
    source={OTHER: 0.04},
    lang={"en": 0.55, "fr": 0.17, "de": 0.17, "es": 0.11},
    topic={"signs": 0.02, "capitals": 0.01, "brief": 0.12, "medium": 0.55, "long": 0.30},
)
#: Share of all tokens that is sampled.
SHARE = 0.6
#: Sources with a level of their own at most, those with the most documents; the rest are one level.
SOURCES = 1000


def production(docs: DataFrame) -> Targets:
    """PRODUCTION with the sources that docs has, all alike. SOURCES bounds what is collected and the raked table."""
    named = docs.where(F.col("source").isNotNull() & (F.col("source") != OTHER))
    found = [r["source"] for r in named.groupBy("source").count().orderBy(F.desc("count"), "source").limit(SOURCES).collect()]
    share = (1 - PRODUCTION.source[OTHER]) / max(len(found), 1)
    return Targets(dict.fromkeys(found, share) | {OTHER: PRODUCTION.source[OTHER]}, PRODUCTION.lang, PRODUCTION.topic)
