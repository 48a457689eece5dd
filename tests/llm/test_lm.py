"""The LM's scores against a plain version that reads one token at a time with dictionaries."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digits(v: int) -> int:
    return min(int(v).bit_length(), 15)


def ratio(t: int, n: int) -> int:
    return 15 * t // n if n else 15


class Plain:
    """Counts of the other documents, by recounting them for each document."""

    def __init__(self, docs: list[tuple[str, bool]]):
        self.docs = [([*WORD.findall((t or "").translate(LOWER)), None], held) for t, held in docs]
        self.training = [d for d, held in self.docs if not held]

    def contexts(self, doc: list):
        short = "start"
        for t, w in enumerate(doc):
            one = doc[t - 1] if t else "start"
            yield t, w, {lm.TWO: (one, doc[t - 2] if t > 1 else "start", 2), lm.ONE: (one, 1)}, short
            if w is not None and len(w.encode()) <= lm.SHORT:
                short = w

    def counted(self, docs: list[list]) -> tuple[Counter, dict]:
        words, after = Counter(), defaultdict(Counter)
        for d in docs:
            for _, w, contexts, _ in self.contexts(d):
                words[w] += 1
                for c in contexts.values():
                    after[c][w] += 1
        return words, after

    def discounts(self) -> dict[int, float]:
        words, after = self.counted(self.training)
        pairs = {o: Counter() for o in (lm.ONE, lm.TWO)}
        for c, found in after.items():
            for n in found.values():
                pairs[c[-1]][n] += 1
        pairs[lm.VOCABULARY] = Counter(words.values())
        return {o: min(max((p[1] + 0.5) / (p[1] + 2 * p[2] + 1), 0.1), 0.9) for o, p in pairs.items()}

    def read(self, number: int, less: dict[int, float]):
        """(asked bits as (bit, code, outcome, place), log10 of the choices, spelled words with the last short word)."""
        doc, held = self.docs[number]
        rest, seen = [], held
        for d, h in self.docs:
            if not h and (seen or d is not doc):
                rest.append(d)
            seen = seen or d is doc
        rest = self.training if held else [d for d in self.training if d is not doc]
        words, after = self.counted(rest)
        total, kinds = sum(words.values()), len(words)
        asked, choice, spelled = [], 0.0, []
        past = defaultdict(list)
        novel: list = []
        last_of: dict = {}
        run = 0
        for t, w, contexts, short in self.contexts(doc):
            one = doc[t - 1] if t else None
            prior = words[one] if t else 0
            n = {o: sum(after[c].values()) for o, c in contexts.items()}
            kinds_of = {o: len(after[c]) for o, c in contexts.items()}

            def ask(bit: int, outcome: bool, code) -> bool:
                h = sum(int(b) << k for k, b in enumerate(past[bit][::-1][:4]))
                a, b, c, d = code(h)
                asked.append((bit, ((a * 16 + b) * 16 + c) * 16 + d, outcome, t))
                past[bit].append(outcome)
                return outcome

            def tell() -> float:
                nonlocal run
                guess_at = last_of.get(one) if t else None
                if guess_at is not None:
                    hit = doc[guess_at] == w
                    before, run = run, run + 1 if hit else 0
                    if ask(lm.REPEAT, hit, lambda h: (min(before, 15), h, digits(prior), digits(words[doc[guess_at]]))):
                        return 0.0
                else:
                    run = 0
                codes = {
                    lm.SEEN_TWO: (lm.TWO, lambda h: (digits(n[lm.TWO]), ratio(kinds_of[lm.TWO], n[lm.TWO]), h, ratio(kinds_of[lm.ONE], n[lm.ONE]))),
                    lm.SEEN_ONE: (lm.ONE, lambda h: (digits(n[lm.ONE]), ratio(kinds_of[lm.ONE], n[lm.ONE]), h, ratio(kinds_of[lm.TWO], n[lm.TWO]))),
                }
                for bit, (o, code) in codes.items():
                    own = after[contexts[o]][w]
                    if n[o] and ask(bit, own > 0, code):
                        return math.log10((own - less[o]) / (n[o] - less[o] * kinds_of[o]))
                if ask(lm.KNOWN, words[w] > 0, lambda h: (h, ratio(kinds_of[lm.ONE], n[lm.ONE]), digits(prior), 15 * len(novel) // max(t, 1))):
                    return math.log10((words[w] - less[lm.VOCABULARY]) / (total - less[lm.VOCABULARY] * kinds))
                if novel and ask(lm.AGAIN, w in novel, lambda h: (digits(len(novel)), h, digits(t), digits(prior))):
                    return -math.log10(len(novel))
                spelled.append((w, short))
                return 0.0

            choice += tell()
            if not words[w] and w not in novel:
                novel.append(w)
            if t:
                last_of[one] = t
        return asked, choice, spelled


def short_code(word) -> int:
    import quire.llm.textkernel as tk

    raw = np.frombuffer((word or "").encode(), np.uint8)
    h = lm._START if word == "start" else tk.range_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
    return int(tk.mix(np.array([h], np.uint64) + lm._SALT[3])[0] & np.uint64(0xFFFF))


def letters(words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raws = [(w or "").encode() for w, _ in words]
    return np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws], np.int64), np.array([short_code(s) for _, s in words], np.int64)


def plain_scores(docs: list[tuple[str, bool]]) -> list[float]:
    model = Plain(docs)
    less = model.discounts()
    read = [model.read(k, less) for k in range(len(docs))]
    tables = np.zeros((lm.CHAIN, 2, lm.JOINT), dtype=np.int64)
    for (asked, _, _), (_, held) in zip(read, model.docs, strict=True):
        for bit, code, outcome, _ in asked if not held else ():
            tables[bit, 0, code] += 1
            tables[bit, 1, code] += outcome
    chain = [lm.refined(*t) for t in tables]
    taught = sorted(((w or "").encode(), short_code(s), w, s) for (_, _, spelled), (_, held) in zip(read, model.docs, strict=True) if not held for w, s in spelled)
    counts = np.zeros((2, lm._TABLE))
    raw, size, short = letters([(w, s) for *_, w, s in taught])
    for _, bit, at in lm.Spelled(raw, size, short).bits() if len(size) else ():
        for row in at:
            np.add.at(counts[1], row, 1)
            np.add.at(counts[0], row, bit)
    slots = lm.predictions(counts.astype(np.float32))
    w, map_ = np.full((lm.GATES, len(lm.ORDERS)), 0.3), np.tile(lm.sigmoid((np.arange(lm.MAP) - lm.MAP // 2) / 2), (256, 1))
    if len(size):
        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([lm.pack(size, short)], pa.binary()), pa.array([raw.tobytes()], pa.binary())], ["shard", "sizes", "words"])
        out = next(lm._learn(slots)((pa.scalar(0),), iter([batch])))
        w = np.frombuffer(out.column(2)[0].as_py()).reshape(w.shape)
        seen = np.stack(lm.unpack(out.column(3)[0].as_py())).reshape(2, 256, lm.MAP)
        map_ = (seen[0] + 20 * map_) / (seen[1] + 20)
    scores = []
    for (asked, choice, spelled), (_, held) in zip(read, model.docs, strict=True):
        total = choice
        for bit in range(lm.CHAIN):
            bias, waiting, block = 0.0, 0.0, None
            for b, code, outcome, place in asked:
                if b != bit:
                    continue
                if block is not None and place // lm.BLOCK != block:
                    bias, waiting = lm.BIAS_HOLD * bias + lm.BIAS_RATE * waiting, 0.0
                block = place // lm.BLOCK
                p = 1 / (1 + math.exp(-(math.log(chain[bit][code] / (1 - chain[bit][code])) + bias)))
                total += math.log10(p if outcome else 1 - p)
                waiting += outcome - p
        if spelled:
            raw, size, short = letters(spelled)
            total += lm.spelling(raw, size, short, np.full(len(size), not held), slots, w, map_).sum()
        scores.append(total)
    return scores


DOCS = [
    "The cat sat on the mat. The cat sat on the rug!",
    "the dog sat on the mat and the dog ate the cat",
    "a new word zyxw and again zyxw and zyxw qqqq zyxw",
    "the cat sat on the mat and a new dog ate a rug",
    None,
    "",
    "der Hund und die Katze und der Hund der die Katze jagt " * 4,
    "der Hund jagt die Katze und die Katze jagt den Hund",
    "ein " * 70 + "x",
    "The cat sat on the mat. The cat sat on the rug!",
]
ROWS = [(k, t, k in (3, 7, 9)) for k, t in enumerate(DOCS)]
SCHEMA = "doc_id long, text string, out boolean"


def scored(spark, rows, partitions: int = 1) -> dict:
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return {r["doc_id"]: r for r in lm.score_documents(df, df["out"]).collect()}


@pytest.fixture(scope="module")
def plain():
    return plain_scores([(t, out) for _, t, out in ROWS])


def test_scores_are_those_of_a_plain_reading(spark, plain):
    got = scored(spark, ROWS)
    assert [got[k]["score"] for k in range(len(ROWS))] == pytest.approx(plain, rel=1e-9)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, plain, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 60)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = scored(spark, ROWS, partitions)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert [got[k]["score"] for k in range(len(ROWS))] == pytest.approx(plain, rel=1e-9)


def test_hot_contexts_are_summed_over_their_shares(spark, plain, monkeypatch):
    monkeypatch.setattr(lm, "RANGE", 40)
    monkeypatch.setattr(lm, "EVERY", 1)
    monkeypatch.setattr(lm, "HOT", 4)
    got = scored(spark, ROWS, 2)
    assert [got[k]["score"] for k in range(len(ROWS))] == pytest.approx(plain, rel=1e-9)


def test_copies_are_told_apart(spark):
    rng = np.random.default_rng(3)
    common = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(40)]
    texts = [" ".join(rng.choice(common, 60)) for _ in range(120)]
    rows = [(k, t, k % 7 == 2) for k, t in enumerate([*texts, *texts[:20]])]
    got = scored(spark, rows, 3)
    single = sorted(got[k]["bits_per_byte"] for k in range(20, 120))
    # those whose other copy teaches
    twice = [got[k]["bits_per_byte"] for k in [*range(20), *range(120, 140)] if (k + 120 if k < 20 else k - 120) % 7 != 2]
    assert max(twice) < single[0]


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, "one two three four five", k > 2) for k in range(6)]
    got = scored(spark, rows)
    other = scored(spark, [*rows[:3], (3, "six seven eight nine", True)])
    assert [got[k]["score"] for k in range(3)] == [other[k]["score"] for k in range(3)]


def test_odd_rows(spark):
    got = lm.score_documents(spark.createDataFrame([(None, "a b", "x"), (None, None, "y"), (1, "", "z")], "doc_id long, text string, chunk string")).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 3] and all(r["score"] < 0 for r in got)
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # nothing to learn from
    alone = scored(spark, [(1, "a b a b", True), (2, None, True)])
    assert alone[1]["n_known"] == 0 and alone[1]["train_tokens"] == 0 and alone[1]["score"] < alone[2]["score"] < 0


def test_order_helpers():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 300, 5000, 5000, 5000):
        context = rng.integers(0, 1 << 30, n).astype(np.uint64) << np.uint64(rng.integers(4, 34))
        context[rng.random(n) < 0.3] = np.uint64(12345) << np.uint64(40)
        token = rng.integers(0, 1 << 31, n).astype(np.uint32) & np.uint32(0xFF0003)
        order, c, t = lm.pair_order(context, token)
        assert order.tolist() == sorted(range(n), key=lambda k: (int(context[k]), int(token[k])))
        assert (c == context[order]).all() and (t == token[order]).all()
        values = rng.integers(0, 50, n)
        assert lm.order_of(values).tolist() == sorted(range(n), key=lambda k: values[k])
        assert [a.tolist() for a in lm.unpack(lm.pack(context, token))] == [context.tolist(), token.tolist()]


def test_spelling_is_a_distribution():
    """Over all strings of up to two letters of a tiny alphabet, the probabilities sum to less than one."""
    slots = lm.predictions(np.zeros((2, lm._TABLE), dtype=np.float32))
    w, map_ = np.full((lm.GATES, len(lm.ORDERS)), 0.3), np.tile(lm.sigmoid((np.arange(lm.MAP) - lm.MAP // 2) / 2), (256, 1))
    strings = [bytes([a]) for a in range(256) if a != 32] + [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)]
    size = np.array([len(s) for s in strings])
    q = lm.spelling(np.frombuffer(b"".join(strings), np.uint8), size, np.zeros(len(size), np.int64), np.zeros(len(size), bool), slots, w, map_)
    assert (10**q).sum() < 1
