"""Document fingerprints by randomised edit embedding.

All texts share one random walk: at step j the walk emits the character under its pointer and moves on by a bit that
depends on j and that character alone. Texts of small edit distance fall back into step after each edit, so their
emitted strings have a small Hamming distance. A fingerprint samples that string: slot k keeps a byte of the four
characters under the pointer at the step with the smallest hash h_k among those that the text reaches. Texts of
different lengths thus sample the same steps wherever both go. Likeness is the share of equal slots.

Near duplicates come from several such walks, whose slots are each a band of its own that keeps a longer gram. Texts that agree in a band are candidates, and a bounded edit distance over the whole texts verifies them.

Texts longer than SEGMENT characters are walked in segments of that length, each from its first character, and every slot
samples the segment that a hash of slot and segment picks, so that another segment changes few slots. An edit moves the
later segments' edges by a few characters, after which their walks fall back into step.

Kernel: one lane per segment in numpy, all lanes at the same step; a step costs three vector operations, and there are a
few steps for each character of a segment, whatever a text's length. Memory is bounded by STEP_BYTES of text (or one text). Defined results: a null text is empty; an empty text has the all-zero fingerprint,
and two empty ones are alike (1.0); rows without an id come last in the order; equal ids are ordered by their texts;
a single document is its own neighbour; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkernel as tk
from quire.llm.common import drop_written, shuffle_partitions, written
from quire.llm.components import components

SLOTS = 64
#: Walks of near_duplicates, the slots of each, every one a band of its own, and the characters that one holds.
NEAR_WALKS, NEAR_SLOTS, NEAR_GRAM = 4, 64, 8
#: Bytes of text that walk together.
STEP_BYTES = 12_000_000
NEAR_STEP = 4_000_000

#: Characters that one walk takes in.
SEGMENT = 8192

_PERIOD = 4096
_BLOCK = 8192


def _bits() -> np.ndarray:
    """move[j % _PERIOD, c]: whether the walk moves on at step j from a character of class c; class 0 ends the text."""
    grid = tk.mix(np.arange(_PERIOD * 256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)).reshape(_PERIOD, 256)
    out = (grid & np.uint64(1)).astype(np.int64)
    out[:, 0] = 0
    return out


def _cache(slots: int) -> dict:
    return {"bits": None, "least": np.full(slots, 2**64 - 1, dtype=np.uint64), "until": 0, "events": {}}


_CACHE, _NEAR = _cache(SLOTS), _cache(NEAR_SLOTS)


def _events(until: int, cache: dict = _CACHE) -> dict[int, np.ndarray]:
    """For each step that is a new minimum of some h_k: those slots k."""
    slots = np.uint64(len(cache["least"]))
    while cache["until"] < until:
        a = cache["until"]
        j = np.arange(a, a + _BLOCK, dtype=np.uint64)
        h = tk.mix(j[None, :] * slots + np.arange(slots, dtype=np.uint64)[:, None] + np.uint64(0x14057B7EF767814F))
        running = np.minimum.accumulate(np.concatenate((cache["least"][:, None], h), axis=1), axis=1)
        slot, step = np.nonzero(h < running[:, :-1])
        for s, k in zip((step + a).tolist(), slot.tolist(), strict=True):
            cache["events"].setdefault(s, []).append(k)
        cache["least"] = running[:, -1]
        cache["until"] = a + _BLOCK
    return cache["events"]


class _Walk:
    """Texts laid end to end as classes of characters 1..255, with zeros behind each that hold its walk at the end."""

    def __init__(self, chars: list[np.ndarray], slots: int, behind: int):
        if _CACHE["bits"] is None:
            _CACHE["bits"] = _bits()
        length = np.array([len(c) for c in chars], dtype=np.int64)
        begin = np.cumsum(length + behind) - length - behind
        self.flat = np.zeros(int((length + behind).sum()), dtype=np.uint8)
        for c, b in zip(chars, begin.tolist(), strict=True):
            self.flat[b : b + len(c)] = (c * np.uint32(0x9E3779B1) >> np.uint32(13)) % np.uint32(255) + np.uint32(1)
        segments = -(-length // SEGMENT)
        self.text = np.repeat(np.arange(len(chars)), segments)
        self.number = np.arange(len(self.text)) - np.repeat(np.cumsum(segments) - segments, segments)
        self.at = begin[self.text] + self.number * SEGMENT
        self.end = np.minimum(self.at + SEGMENT, (begin + length)[self.text])
        self.pick = None
        if (segments > 1).any():
            self.pick = np.zeros((len(chars), slots), dtype=np.int64)
            slot = np.arange(slots, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
            for k in np.flatnonzero(segments > 1).tolist():
                self.pick[k] = tk.mix(slot + np.arange(segments[k], dtype=np.uint64)[None, :]).argmin(1)

    def steps(self, cache: dict, shift: int = 0):
        """(step, places of the pointers, segments, slots) at each step that is a new minimum of some slots."""
        bits, lane = _CACHE["bits"], np.argsort(self.at - self.end, kind="stable")
        at, end, step = self.at[lane], self.end[lane], 0
        while len(lane):
            events = _events(step + 256, cache)
            for j in range(step, step + 256):
                if j in events:
                    on = at < end
                    yield j, at[on], lane[on], np.array(events[j])
                at += bits[(j + shift) % _PERIOD].take(self.flat.take(at))
            step += 256
            on = at < end
            if on.sum() < 0.9 * len(lane):
                lane, at, end = lane[on], at[on], end[on]

    def put(self, out: np.ndarray, lane: np.ndarray, slots: np.ndarray, value: np.ndarray) -> None:
        """Writes the lanes' values into the slots that sample their segments."""
        text = self.text[lane]
        if self.pick is None:
            out[text[:, None], slots[None, :]] = value[:, None]
            return
        row, column = np.nonzero(self.pick[text][:, slots] == self.number[lane][:, None])
        out[text[row], slots[column]] = value[row]


def fingerprints(chars: list[np.ndarray]) -> np.ndarray:
    """SLOTS bytes for each text, given as code points."""
    out = np.zeros((len(chars), SLOTS), dtype=np.uint8)
    if not len(chars):
        return out
    walk = _Walk(chars, SLOTS, 4)
    flat = walk.flat
    for _, p, lane, slots in walk.steps(_CACHE):
        gram = flat[p].astype(np.uint64) | flat[p + 1].astype(np.uint64) << np.uint64(8) | flat[p + 2].astype(np.uint64) << np.uint64(16) | flat[p + 3].astype(np.uint64) << np.uint64(24)
        walk.put(out, lane, slots, np.maximum((tk.mix(gram + np.uint64(1)) >> np.uint64(56)).astype(np.uint8), 1))
    return out


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)


def edited(own: np.ndarray, following: np.ndarray) -> np.ndarray:
    """own with its last third (rounded down) replaced by as many first characters of following, or all."""
    k = len(own) // 3
    return np.concatenate((own[: len(own) - k], following[:k]))


def _rows(ids: list, texts: list[bytes], follow: int) -> tuple[list, np.ndarray, np.ndarray, list]:
    """Everything of the first len(ids) - follow rows, each one's neighbour being the row after it."""
    chars = [code_points(t) for t in texts]
    changed = [edited(a, b) for a, b in zip(chars[: len(ids) - follow], chars[1:], strict=False)]
    fp = fingerprints(chars + changed)
    sha = [hashlib.sha256(c.tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")).hexdigest() for c in changed]
    return [len(c) for c in chars], fp[: len(chars)], fp[len(chars) :], sha


_OUT = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.binary())])
_OUT_SQL = "part int, kind string, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text binary"


def _batch(part: int, kind: str, ids, n, sha, fp, fe, fn, texts) -> pa.RecordBatch:
    m = len(ids)
    likeness = lambda a, b: pa.array((a == b).mean(1) if m else [], pa.float64())
    blank = fe is None
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * m, pa.int32()), pa.array([kind] * m), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([None] * m if blank else sha, pa.string()), pa.array([x.tobytes() for x in fp], pa.binary())]
        + ([pa.nulls(m, pa.binary()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())] if blank else [pa.array([x.tobytes() for x in fe], pa.binary()), likeness(fp, fe), likeness(fp, fn)])
        + [pa.array(texts, pa.binary()) if texts is not None else pa.nulls(m, pa.binary())],
        schema=_OUT,
    )


def _walk_partition(batches):
    """Rows in their order; the partition's first row and its last, whose neighbour is elsewhere, come with their texts."""
    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[bytes] = []
    size, started = 0, False

    def flush(last: bool):
        nonlocal ids, texts, size, started
        n, fp, fe, sha = _rows(ids, texts, 1)
        m = len(ids) - 1
        if not started:
            yield _batch(part, "first", ids[:1], n[:1], None, fp[:1], None, None, texts[:1])
            started = True
        if m:
            yield _batch(part, "row", ids[:m], n[:m], sha, fp[:m], fe, fp[1 : m + 1], None)
        if last:
            yield _batch(part, "open", ids[m:], n[m:], None, fp[m:], None, None, texts[m:])
        ids, texts = ids[m:], texts[m:]
        size = len(texts[0])

    for batch in batches:
        raw, offsets = tk.utf8(batch.column(1))
        data = raw.tobytes()
        for k, i in enumerate(batch.column(0).to_pylist()):
            ids.append(i)
            texts.append(data[offsets[k] : offsets[k + 1]])
            size += len(texts[-1])
            if size >= STEP_BYTES and len(ids) > 1:
                yield from flush(False)
    if ids:
        yield from flush(True)


def _close(batches):
    """The rows that were left open, now beside their neighbours: doc_id, text, next_text."""
    for batch in batches:
        for i, own, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            n, fp, fe, sha = _rows([i, None], [own, following], 1)
            yield _batch(0, "row", [i], n[:1], sha, fp[:1], fe, fp[1:2], None)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The neighbour is the next document by descending id (after the last: the first). Texts move once, to ranges of ids;
    only the rows at the ends of ranges (two a partition) are joined to neighbours in another one.
    """
    spark = docs.sparkSession
    by = (F.desc_nulls_last("doc_id"), F.desc_nulls_last("tie"))
    ranged = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    done = written(ranged.select("doc_id", "text").mapInArrow(_walk_partition, _OUT_SQL), "fingerprints")
    firsts = done.where("kind = 'first'").select(F.col("part").alias("at"), F.col("text").alias("next_text"))
    parts = sorted(r["at"] for r in firsts.select("at").collect())  # one number a partition
    after = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    lookup = spark.createDataFrame(list(after.items()), "part int, at int")
    opened = done.where("kind = 'open'").select("part", "doc_id", "text").join(F.broadcast(lookup), "part").join(firsts, "at")
    closed = opened.select("doc_id", "text", "next_text").mapInArrow(_close, _OUT_SQL)
    return done.where("kind = 'row'").union(closed).select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def edit_distance_within(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is most or less. Furthest-reaching diagonals: O(most^2) steps besides the matching runs."""
    if abs(len(a) - len(b)) > most:
        return None
    goal, reach = len(b) - len(a), {0: _run(a, b, 0, 0)}
    for d in range(most + 1):
        if reach.get(goal, -1) >= len(a):
            return d
        new: dict[int, int] = {}
        for k in range(-d - 1, d + 2):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            if i >= 0 and i <= len(a) and 0 <= i + k <= len(b):
                new[k] = _run(a, b, i, i + k)
            elif i > len(a) and k in reach:
                new[k] = reach[k]
        reach = new
    return None


def _run(a: str, b: str, i: int, j: int) -> int:
    """The first place from i on where a and b (from j on) differ; doubling steps compare whole slices."""
    step = 1
    while step:
        if a[i : i + step] == b[j : j + step] and i + step <= len(a) and j + step <= len(b):
            i, j, step = i + step, j + step, step * 2
        else:
            step //= 2
    return i


def edit_distance(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is most or less. Bit-parallel: a column of the table in one integer, a step per letter of b."""
    head = _run(a, b, 0, 0)
    a, b = a[head:], b[head:]
    tail = _run(a[::-1], b[::-1], 0, 0)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return max(len(a), len(b))
    spots: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        spots.setdefault(c, []).append(i)
    at: dict[str, int] = {}
    for c, places in spots.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        at[c] = int.from_bytes(bits, "little")
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        eq = at.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        if distance - left > most:
            return None
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
    return distance if distance <= most else None


def most_edits(least: float, longest: int) -> int:
    return int((1 - least) * longest + 1e-9)


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - distance / longer length is least or more. An edit takes q of a text's q-grams at most, so that too few in common settle it."""
    longest = max(len(a), len(b))
    most = most_edits(least, longest)
    if abs(len(a) - len(b)) > most:
        return False
    for q in (2, 3):
        grams = [Counter(t[i : i + q] for i in range(len(t) - q + 1)) for t in (a, b)]
        if (grams[0] & grams[1]).total() < longest - q + 1 - most * q:
            return False
    return edit_distance(a, b, most) is not None


def near_keys(chars: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct band keys of each text: sampled steps, each with the NEAR_GRAM characters under the pointer.

    A band is one slot. It holds a long gram instead of several slots of a byte, so one place in step is enough. Walks
    that lose their step at an edit do so apart from each other, so some walks find more than as many slots of one.
    """
    found = np.zeros((len(chars), NEAR_WALKS, NEAR_SLOTS), dtype=np.uint64)
    if not len(chars):
        return []
    walked = _Walk(chars, NEAR_SLOTS, NEAR_GRAM)
    for walk in range(NEAR_WALKS):
        for j, p, lane, slots in walked.steps(_NEAR, walk * (_PERIOD // NEAR_WALKS)):
            gram = np.full(len(p), j * NEAR_WALKS + walk, dtype=np.uint64)
            for i in range(NEAR_GRAM):
                gram = tk.mix(gram * np.uint64(257) + walked.flat[p + i])
            walked.put(found[:, walk], lane, slots, gram)
    return [np.unique(r[r != 0]) for r in found]


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id: classes are components of verified links, class_id the smallest id in the class.

    Equal texts are one candidate. Texts that share a band key and whose lengths allow it are candidates. First each is
    compared with one head; then every pair of a band that is in different classes by then is compared. So all pairs
    that share a key are linked, in one class already, or found apart. Pairs without a shared key are missed: the
    README gives the measured recall.
    """

    def keys(batches):
        for rows, raw, offsets in tk.pieces(batches, "text", NEAR_STEP):
            data = raw.tobytes()
            size = len(offsets) - 1
            for i in range(0, size, 20_000):
                chars = [code_points(data[offsets[k] : offsets[k + 1]]) for k in range(i, min(i + 20_000, size))]
                own = near_keys(chars)
                n = np.array([len(k) for k in own])
                every = np.concatenate(own) if own else np.zeros(0, np.uint64)
                node = np.repeat(rows.column(0).to_numpy()[i : i + 20_000], n)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.repeat([len(c) for c in chars], n), pa.int32()), pa.array(every.view(np.int64))], ["node", "n", "band"])

    def verify(batches):
        for batch in batches:
            a, b, own, other = (batch.column(k).to_pylist() for k in range(4))
            keep = pa.array([similar(x, y, least) for x, y in zip(own, other, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keep], ["a", "b", "near"])

    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    keyed = written(whole.select("node", "text").mapInArrow(keys, "node long, n int, band long"), "bands")
    apart = lambda x, y: F.abs(F.col(x) - F.col(y)) <= F.floor(F.greatest(x, y) * (1 - least) + 1e-9)

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select("a", "b").distinct(), "pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        texts = written(whole.select("node", "text").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "texts")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("own")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
        out = written(both.select("a", "b", "own", "other").mapInArrow(verify, "a long, b long, near boolean"), "checked")
        drop_written(texts, pairs)
        return out

    heads = keyed.groupBy("band").agg(F.min_by(F.struct("node", "n"), "node").alias("head"))
    led = keyed.join(heads, "band").select(F.col("node").alias("a"), "n", F.col("head.node").alias("b"), F.col("head.n").alias("m")).where("a <> b").where(apart("n", "m"))
    first = checked(led.groupBy("a", "b").count().groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")))
    known = components(first.where("near"))
    labelled = keyed.join(known.select("node", F.col("label").alias("_l")), "node", "left").withColumn("label", F.coalesce("_l", "node"))
    groups = written(labelled.groupBy("band", "label").agg(F.collect_set(F.struct("node", "n")).alias("members")), "groups")
    left, right = (groups.select("band", F.col("label").alias(f"_{k}"), F.col("members").alias(k)) for k in "xy")
    rest = left.join(right, "band").where("_x < _y").select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
    rest = rest.select(F.col("x.node").alias("_a"), F.col("x.n").alias("n"), F.col("y.node").alias("_b"), F.col("y.n").alias("m")).where(apart("n", "m"))
    rest = rest.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = checked(rest.join(done, ["a", "b"], "left_anti"))
    classes = components(first.union(second).where("near").select("a", "b"))
    member = whole.select("doc_id", "node").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return member.select("doc_id", "label").join(member.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("doc_id", "class_id")
