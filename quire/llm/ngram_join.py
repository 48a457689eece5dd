"""N-gram Jaccard join by token-combination prefixes.

Tokens are a text's distinct word shingles (five words by default). All sets share one order: light tokens first, then
heavy ones (frequent by a count sketch over the whole corpus), each by hash. Two sets of n and m tokens that reach the
threshold share o = ceil(t * n) tokens at least, so their prefixes of n - o + l tokens share l; l is 1 + n / 20, so that
sets which share a passage and little else are told apart by counting. A set with more than n - o light tokens is
indexed by those alone, as many as a prefix of such an l (a smaller one, if it has few more) takes. Others are indexed by
all light tokens, each alone, and by combinations of heavy ones: heavy tokens fall into g classes and are indexed as
pairs within a class, for which the prefix is extended by g: of l + g shared tokens, those that are heavy form pairs
within classes, g fewer at most. So linked sets share l signatures; two sets of this kind share a light token, or have
so many heavy ones that these may suffice.
g grows with the size class of a set, which keeps the pairs of a set in proportion to its prefix; a set is indexed for
its own size class and the one below, so sizes up to 1.25 apart always meet. Signatures thus find every pair that
reaches the threshold, whatever the sketch says; its counts only decide how much there is to verify.

Verification: equal sets are one class. In large buckets, all classes are compared with the most central one first (whose
tokens are in most sets, as those of an original are in its copies), for a few rounds; whole sets are compared, by 40 bits of each token, so a link is exact up to
collisions of those. What that has linked is one component, and only classes that are still in different components and
share l signatures are compared after that. A bucket of near copies of any size so costs a few comparisons per member.

Whole texts never reach the driver; it holds a sketch of 2**22 counters and a bitmap of 2**24 bits (which copies of
texts may be candidates), both of fixed size. Intermediate tables are written to the shared folder.

Defined results: null, empty and blank texts have no tokens, n_shingles 0, and are linked with nothing; repeated rows
are one class; rows without an id join in but lend no id (component_id is null if all of a component lack one);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import textkernel as tk
from quire.llm.common import drop_written, shuffle_partitions, summed_in_two, written
from quire.llm.components import components

WIDTH = 5
#: Jaccard similarity of a link, in hundredths.
PERCENT = 80
#: The count sketch has 2**SKETCH counters; a token is heavy if its counter stands SIGMAS above the mean.
SKETCH, SIGMAS, HEAVY = 22, 6.0, 64
_BLOCK = 16
#: Bits of the candidates' bitmap, as a power of two.
MARKS = 24
#: Heavy tokens of a prefix that share a class, on average.
PER_CLASS = 8
#: Of a set of n tokens, n / SHARE more than one have to meet.
SHARE = 20
#: Class keys that a task remembers so as to skip copies.
REMEMBERED = 300_000
#: Tokens of the pairs that one group compares; a home with more is salted.
GROUP = 8_000_000
#: Rows of a home's buckets that one task counts; a home with more is salted.
HOME = 200_000
#: Rounds of comparisons with the most central set of each large bucket.
ROUNDS = 3
#: Classes of a bucket whose pairs are all counted at once; larger buckets are first cleared by a few comparisons.
SMALL = 8

_EVEN = ~np.uint64(1)
_SINGLE, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _size_classes(percent: int, most: int = 1 << 40) -> np.ndarray:
    """First sizes of the classes; sizes that can reach the threshold together are in the same or adjacent classes."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds)


def _key(s: np.ndarray) -> int:
    """A 63-bit key of a set of hashes."""
    h = tk.mix((tk.mix(s).sum(keepdims=True) + np.array([len(s)], dtype=np.uint64) * _PAIR) ^ np.bitwise_xor.reduce(s))
    return int(h[0] >> np.uint64(1))


def need(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set it is linked to."""
    return -(-n * percent // 100)


def shared(n: int) -> int:
    """Signatures that linked sets of n tokens are asked to share, if their prefixes allow it."""
    return min(1 + n // SHARE, 63)


def signatures(s: np.ndarray, heavy: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, int]:
    """(all signatures of a set, how many of them any linked set shares at least, its light tokens if all are indexed
    with heavy ones); heavy marks its heavy tokens. Signatures of pairs are odd."""
    n = len(s)
    slack = n - need(n, percent)
    light = s[~heavy]
    if len(light) > slack:  # a linked set shares some of so many light tokens
        least = min(shared(n), len(light) - slack)
        return tk.mix(light[: slack + least] ^ _SINGLE) & _EVEN, least, 0
    least = shared(n)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    prefix = lambda m: m - need(m, percent) + shared(m)
    out, dark = [tk.mix(light ^ _SINGLE) & _EVEN], s[heavy]
    for q in (own, own - 1):
        if q < 0:
            continue
        g = max(1, -(-prefix(int(bounds[q + 1])) // PER_CLASS))
        some = dark[: slack + least + g - len(light)]
        cls = (some >> np.uint64(9)) % np.uint64(g)
        order = np.argsort(cls, kind="stable")
        some, cls = some[order], cls[order]
        salt = tk.mix(np.array([q + 1], dtype=np.uint64))[0]
        for d in range(1, len(some)):
            same = cls[d:] == cls[:-d]
            if not same.any():
                break
            out.append(tk.mix(tk.mix(some[:-d][same] ^ _PAIR) + some[d:][same] + salt) | ~_EVEN)
    return np.concatenate(out), least, len(light)


class _Seen:
    """Keys met in this task, forgotten when there are too many."""

    def __init__(self):
        self.keys: set[int] = set()

    def new(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= REMEMBERED:
            self.keys.clear()
        self.keys.add(key)
        return True


_SCAN = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])


def _scan(width: int):
    """Rows of documents (their set's size and key), and at the end the task's part of the sketch."""

    def run(batches):
        counters = np.zeros(1 << SKETCH, dtype=np.uint32)
        waiting, held, seen = [], 0, _Seen()
        for rows, raw, offsets in tk.pieces(batches, "text"):
            sizes, keys = [], []
            for s in tk.shingle_sets(raw, offsets, width):
                key = _key(s) if len(s) else None
                sizes.append(len(s))
                keys.append(key)
                if key is not None and seen.new(key):
                    waiting.append(s >> np.uint64(64 - SKETCH))
                    held += len(s)
            if held > 2_000_000:
                counters += np.bincount(np.concatenate(waiting).view(np.int64), minlength=1 << SKETCH).astype(np.uint32)
                waiting, held = [], 0
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=_SCAN)
        if held:
            counters += np.bincount(np.concatenate(waiting).view(np.int64), minlength=1 << SKETCH).astype(np.uint32)
        parts = counters.reshape(-1, 1 << _BLOCK)
        on = [k for k in range(len(parts)) if parts[k].any()]
        m = len(on)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(on, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in on], pa.binary())], schema=_SCAN)

    return run


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of one block's parts; one part is in memory at a time."""
    total = np.zeros(1 << _BLOCK, dtype=np.uint64)
    for batch in batches:
        for part in batch.column(1):
            data = zlib.decompress(part.as_py())
            total += np.frombuffer(data, dtype=np.uint32 if len(data) == 4 << _BLOCK else np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["block", "counts"])


def sketch(scanned: DataFrame) -> np.ndarray:
    """A level from 0 to 255 for each of the 2**SKETCH counters; tokens are heavy from HEAVY on, four times that at most."""
    counts = np.zeros((1 << SKETCH - _BLOCK, 1 << _BLOCK), dtype=np.uint64)
    for r in summed_in_two(scanned.where("block is not null"), "block", "counts", _summed, "block int, counts binary").toLocalIterator():
        counts[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint64)
    mean = counts.mean()
    limit = max(1, int(mean + SIGMAS * np.sqrt(mean) + 2))
    return np.minimum(counts.ravel() * np.uint64(HEAVY) // np.uint64(limit), 255).astype(np.uint8)


def _index(width: int, percent: int, levels: np.ndarray):
    """(sig, key, n) of every set that is new to the task; n holds centrality, light tokens, size, signatures to share.

    Centrality is the tokens' mean level: an original's tokens are in all its copies, a copy's own ones in none.
    """

    def run(batches):
        bounds, seen = _size_classes(percent), _Seen()
        for _, raw, offsets in tk.pieces(batches, "text"):
            sigs, keys, sizes, counts = [], [], [], []
            for s in tk.shingle_sets(raw, offsets, width):
                # sets that no other size can be linked to are found as equal sets
                if len(s) and len(s) * 100 // percent > need(len(s), percent) and seen.new(key := _key(s)):
                    level = levels[(s >> np.uint64(64 - SKETCH)).view(np.int64)]
                    sig, least, light = signatures(s, level >= HEAVY, bounds, percent)
                    central = int(level.mean() * 32)
                    sigs.append(sig)
                    keys.append(key)
                    sizes.append(central << 50 | min(light, _LIGHT) << 32 | len(s) << 6 | least)
                    counts.append(len(sig))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int64), counts))], ["sig", "key", "n"])

    return run


def _packed(s: np.ndarray) -> bytes:
    """The upper 40 bits of each token."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), dtype=np.uint8)
    out[:, 3:] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.uint64)


def _sets(width: int, marks: bytes):
    """(key, tokens) of the sets whose mark is set, once a task."""

    def run(batches):
        on = np.frombuffer(marks, np.uint64)
        seen = _Seen()
        for _, raw, offsets in tk.pieces(batches, "text"):
            keys, sets = [], []
            for s in tk.shingle_sets(raw, offsets, width):
                if len(s):
                    key = _key(s)
                    at = key & ((1 << MARKS) - 1)
                    if int(on[at >> 6]) >> (at & 63) & 1 and seen.new(key):
                        keys.append(key)
                        sets.append(_packed(s))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "tokens"])

    return run


def _compare(percent: int):
    """Rows sorted by (home, salt, kind): a group's sets (kind 0), then its pairs (kind 1)."""

    def run(batches):
        group, sets = None, {}
        for batch in batches:
            a, b = [], []
            homes, salts, kinds, heads, keys = (batch.column(k).to_pylist() for k in range(5))
            for h, x, kind, head, key, t in zip(homes, salts, kinds, heads, keys, batch.column(5), strict=True):
                if (h, x) != group:
                    group, sets = (h, x), {}
                if not kind:
                    sets[head] = t.as_py()
                elif head in sets and key in sets:
                    both = np.sort(np.concatenate((_unpacked(sets[head]), _unpacked(sets[key]))))
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        a.append(head)
                        b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (a, b) among the candidate pairs (head, key, n, head_n), which is a written table.

    Pairs are dealt to homes: the smallest key that either end is paired with. The pairs of a cluster so share a home,
    and a set goes there once however many pairs it is in. Homes with many tokens are salted by the pairs' heads.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.col("head").alias("k"), F.col("key").alias("other")).union(pairs.select(F.col("key").alias("k"), F.col("head").alias("other")))
    least = ends.groupBy("k").agg(F.least(F.min("other"), F.col("k")).alias("near"))
    at = F.expr(f"k & {(1 << MARKS) - 1}L")
    words = least.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("bits")).toPandas()
    marks = np.zeros(1 << MARKS - 6, dtype=np.int64)
    marks[words["word"].to_numpy()] = words["bits"].to_numpy()
    sets = docs.select("text").mapInArrow(_sets(width, marks.tobytes()), "k long, tokens binary")
    homed = pairs.join(least.select(F.col("k").alias("head"), F.col("near").alias("a")), "head").join(least.select(F.col("k").alias("key"), F.col("near").alias("b")), "key")
    homed = written(homed.select("head", "key", (F.col("n") + F.col("head_n")).cast("long").alias("size"), F.least("a", "b").alias("home")), "homes")
    salts = homed.groupBy("home").agg(F.ceil(F.sum("size") / GROUP).alias("salts"))
    salted = homed.join(salts, "home").select("home", F.pmod(F.xxhash64("head"), "salts").cast("int").alias("salt"), "head", "key")
    sent = salted.select("home", "salt", F.explode(F.array("head", "key")).alias("k")).distinct().join(sets, "k")
    sent = sent.select("home", "salt", F.lit(0).alias("kind"), F.col("k").alias("head"), F.lit(None).cast("long").alias("key"), "tokens")
    rows = sent.unionByName(salted.select("home", "salt", F.lit(1).alias("kind"), "head", "key", F.lit(None).cast("binary").alias("tokens")))
    ordered = rows.repartition(shuffle_partitions(spark), "home", "salt").sortWithinPartitions("home", "salt", "kind")
    # links are few: many tasks compare, few files hold what they find
    return ordered.mapInArrow(_compare(percent), "a long, b long").repartition(max(1, shuffle_partitions(spark) // 8))


#: n holds, from the lowest bit on: 6 bits of signatures to share, 26 of size, 18 of light tokens, 13 of centrality.
_SIZE, _LIGHT = (1 << 26) - 1, (1 << 18) - 1
#: Shared pairs of heavy tokens are counted above this bit, shared light tokens below.
_HEAVY = 24
_MET = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("met", pa.int64())])
_MET_SQL = "sig long, a long, b long, na long, nb long, met long"


def _combined(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b, na, nb) with the sums of their weights."""
    rows = np.concatenate(parts, axis=1)
    order = np.lexsort((rows[1], rows[0]))
    rows = rows[:, order]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    at = np.flatnonzero(new)
    return np.concatenate((rows[:4, at], np.add.reduceat(rows[4], at)[None, :]))


def _ordered_pairs(sig: np.ndarray, key: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """(a, b, na, nb, weight) with a < b of the index pairs whose sizes allow a link."""
    a, b = n[i] >> 6 & _SIZE, n[j] >> 6 & _SIZE
    small, large = np.minimum(a, b), np.maximum(a, b)
    ok = (small * 100 >= large * percent) & (key[i] != key[j])
    i, j = i[ok], j[ok]
    swap = key[i] > key[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return np.stack([key[i], key[j], n[i], n[j], np.where(sig[i] & 1, 1 << _HEAVY, 1)])


def _buckets(percent: int):
    """From rows sorted by (sig, key): the pairs of small buckets, counted (sig is null), and the rows of large ones
    (b is null)."""

    def run(batches):
        carry: np.ndarray | None = None
        small: list[np.ndarray] = []
        held = 0

        def cut(rows: np.ndarray):
            """Whole buckets only."""
            nonlocal held
            keep = np.ones(rows.shape[1], dtype=bool)
            keep[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            rows = rows[:, keep]
            first = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
            size = np.diff(np.append(first, rows.shape[1]))
            for m in range(2, SMALL + 1):
                at = first[size == m]
                for d in range(m if len(at) else 0):
                    for e in range(d + 1, m):
                        small.append(_ordered_pairs(rows[0], rows[1], rows[2], at + d, at + e, percent))
                        held += small[-1].shape[1]
            inside = np.repeat(size > SMALL, size)
            if inside.any():
                own, m = rows[:, inside], np.repeat(size, size)[inside]
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.nulls(len(m), pa.int64()), pa.array(own[2]), pa.nulls(len(m), pa.int64()), pa.array(m, pa.int64())], schema=_MET)
            if held > 500_000:
                yield from flush()

        def flush():
            nonlocal small, held
            if held:
                rows = _combined(small)
                yield pa.RecordBatch.from_arrays([pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3]), pa.array(rows[4])], schema=_MET)
            small, held = [], 0

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            if carry is not None:
                rows = np.concatenate((carry, rows), axis=1)
            if not rows.shape[1]:
                continue
            last = int(np.searchsorted(rows[0], rows[0, -1]))  # the last bucket may go on
            carry = rows[:, last:]
            if last:
                yield from cut(rows[:, :last])
        if carry is not None and carry.shape[1]:
            yield from cut(carry)
        yield from flush()

    return run


def _apart(percent: int):
    """From rows (home, sig, key, n, label) sorted by home and sig: the pairs of different labels, counted.

    A pair that shares no light token is counted only if its heavy ones may suffice. Counts are handed on when a home
    ends, or sooner if there are many, so memory is bounded.
    """

    def run(batches):
        held: list[np.ndarray] = []
        size, home, carry = 0, None, None

        def flush():
            nonlocal held, size
            if held:
                rows = _combined(held)
                yield pa.RecordBatch.from_arrays([pa.nulls(rows.shape[1], pa.int64()), *[pa.array(r) for r in rows]], schema=_MET)
            held, size = [], 0

        def bucket(rows: np.ndarray):
            nonlocal size
            _, sig, key, n, label = rows
            m = len(key)
            block = max(1, 400_000 // m)
            for i in range(0, m, block):
                x, y = np.nonzero((np.arange(i, min(i + block, m))[:, None] < np.arange(m)[None, :]) & (label[i : i + block, None] != label[None, :]))
                x += i
                if not len(x):
                    continue
                heavy = (n >> 6 & _SIZE) - (n >> 32 & _LIGHT)
                both = (n[x] >> 6 & _SIZE) + (n[y] >> 6 & _SIZE)
                ok = (sig[x] & 1 == 0) | (np.minimum(heavy[x], heavy[y]) * (100 + percent) >= both * percent)
                held.append(_ordered_pairs(sig, key, n, x[ok], y[ok], percent))
                size += held[-1].shape[1]
                if size > 800_000:
                    merged = _combined(held)
                    held[:] = [merged]
                    size = merged.shape[1]
                    if size > 400_000:
                        yield from flush()

        def whole(rows: np.ndarray):
            nonlocal home
            cut = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            for part in np.split(rows, cut, axis=1):
                if part[0, 0] != home:
                    home = part[0, 0]
                    if size > 200_000:
                        yield from flush()
                yield from bucket(part)

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)])
            rows = rows if carry is None else np.concatenate((carry, rows), axis=1)
            if not rows.shape[1]:
                continue
            same = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            carry, rows = rows[:, same], rows[:, ~same]
            if rows.shape[1]:
                yield from whole(rows)
        if carry is not None and carry.shape[1]:
            yield from whole(carry)
        yield from flush()

    return run


class _Linker:
    """Links found so far, and what they connect."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.done: DataFrame | None = None

    def labelled(self, rows: DataFrame, key: str, label: str) -> DataFrame:
        if self.labels is None:
            return rows.withColumn(label, F.col(key))
        return rows.join(self.labels.select(F.col("node").alias(key), F.col("label").alias("_label")), key, "left").withColumn(label, F.coalesce("_label", key)).drop("_label")

    def add(self, pairs: DataFrame) -> bool:
        """Compares pairs (a, b, na, nb) of different components that weren't compared before; whether some are linked."""
        apart = self.labelled(self.labelled(pairs, "a", "a_label"), "b", "b_label").where("a_label <> b_label")
        if self.done is not None:
            apart = apart.join(self.done, ["a", "b"], "left_anti")
        new = written(apart.select(F.col("a").alias("head"), F.col("b").alias("key"), F.shiftright("na", 6).bitwiseAND(_SIZE).alias("head_n"), F.shiftright("nb", 6).bitwiseAND(_SIZE).alias("n")), "pairs")
        if new.isEmpty():
            return False
        found = written(verified(self.docs, new, self.width, self.percent), "links")
        pair = new.select(F.col("head").alias("a"), F.col("key").alias("b"))
        self.done = pair if self.done is None else self.done.union(pair)
        if found.isEmpty():
            return False
        self.links = found if self.links is None else self.links.union(found)
        before, self.labels = self.labels, components(self.links)
        if before is not None:
            drop_written(before)
        return True


def _components_of(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame | None:
    """(node, label) of all sets that are linked to others; none if there are no links."""
    index = docs.select("text").mapInArrow(_index(width, percent, levels), "sig long, key long, n long")
    dealt = index.repartition(shuffle_partitions(docs.sparkSession), "sig").sortWithinPartitions("sig", "key")
    live = written(dealt.mapInArrow(_buckets(percent), _MET_SQL), "buckets")
    total = lambda rows: rows.groupBy("a", "b", "na", "nb").agg(F.sum("met").alias("met"))
    least = F.least(F.col("na").bitwiseAND(63), F.col("nb").bitwiseAND(63))
    size = lambda c: F.shiftright(c, 6).bitwiseAND(_SIZE)
    fits = F.least(size("n"), size("other_n")) * 100 >= F.greatest(size("n"), size("other_n")) * percent
    first = F.col("key") < F.col("other")
    pair = (F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), F.when(first, F.col("n")).otherwise(F.col("other_n")).alias("na"), F.when(first, F.col("other_n")).otherwise(F.col("n")).alias("nb"), F.when(F.col("sig").bitwiseAND(1) == 1, 1 << _HEAVY).otherwise(1).alias("met"))
    light = lambda c: F.shiftright(c, 32).bitwiseAND(_LIGHT)
    # tokens that both may have in common besides shared light ones, and whether those and some more suffice
    heavy = lambda a, b: F.least(size(a) - light(a), size(b) - light(b))
    enough = lambda a, b, more: (heavy(a, b) + more) * (100 + percent) >= (size(a) + size(b)) * percent
    lights, heavies = F.col("met").bitwiseAND((1 << _HEAVY) - 1), F.shiftright("met", _HEAVY)
    both_dark = (light("na") > 0) & (light("nb") > 0)
    candidate = ((lights + heavies >= least) | (both_dark & (lights > 0))) & (~both_dark | enough("na", "nb", lights))
    bucket = Window.partitionBy("sig")
    linker = _Linker(docs, width, percent)
    large = live.where("b IS NULL").select("sig", F.col("a").alias("key"), F.col("na").alias("n"))
    rows = large
    for _ in range(ROUNDS):
        # all are compared with the most central set of their bucket; the next round leaves that one's component out
        top = F.max(F.struct("n", "key", "label")).over(bucket)
        seen = linker.labelled(rows, "key", "label").withColumn("top", top).where(F.col("label") != F.col("top.label"))
        seen = written(seen.select("sig", "key", "n", F.col("top.key").alias("other"), F.col("top.n").alias("other_n")), "rest")
        found = linker.add(total(seen.where(fits).select(*pair)).where((lights + heavies) * 4 >= least))
        rows = seen.select("sig", "key", "n")
        if not found:
            break
    # all pairs of small buckets, and those of large ones that are still apart: a cluster's buckets, which share their
    # smallest set, are dealt to one task, so that it hands on each pair once and not once a bucket
    apart = linker.labelled(large, "key", "label").select("*", F.min("label").over(bucket).alias("low"), F.max("label").over(bucket).alias("high"), F.min("key").over(bucket).alias("home"))
    apart = written(apart.where("low <> high").select("home", "sig", "key", "n", "label"), "apart")
    salts = apart.groupBy("home").agg(F.ceil(F.count("*") / HOME).alias("salts"))
    dealt = apart.join(salts, "home").withColumn("salt", F.pmod(F.xxhash64("sig"), "salts"))
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "home", "salt").sortWithinPartitions("home", "salt", "sig", "key")
    met = dealt.select("home", "sig", "key", "n", "label").mapInArrow(_apart(percent), _MET_SQL)
    linker.add(total(live.where("sig IS NULL").select("a", "b", "na", "nb", "met").unionByName(met.select("a", "b", "na", "nb", "met"))).where(candidate))
    drop_written(live, apart)
    return linker.labels


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id of an equal set) and component_id (smallest id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = written(docs.mapInArrow(_scan(width), "doc_id long, n_shingles long, key long, block int, counts binary"), "scan")
    labels = _components_of(docs, width, percent, sketch(scanned))
    rows = scanned.where("n_shingles is not null").select("doc_id", "n_shingles", "key")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    if labels is None:
        classes = classes.withColumn("component_id", F.col("class_id"))
    else:
        classes = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "class_id", F.coalesce("label", "key").alias("label"))
        reach = classes.groupBy("label").agg(F.min("class_id").alias("component_id"))
        classes = classes.join(reach, "label").select("key", "class_id", "component_id")
    joined = rows.join(classes, "key", "left")
    alone = F.col("key").isNull()
    return joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without those that are in a component of a smaller id.

    The join gives the ids to drop; repeated rows of a kept id are one document if their texts are equal, and texts that
    share an id are judged by that id. Rows without an id stay.
    """
    joined = jaccard_join(docs, width, percent)
    gone = joined.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 AND doc_id IS NOT NULL").select("doc_id")
    once = stay.join(again, "doc_id", "left_anti").select(*docs.columns)
    several = stay.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(several)
