"""LM scoring by online logistic context mixing over running text.

A text is a sequence of tokens: its words (A-Z lower-cased), then one end. Every token is told by a chain of bits, and
the model's log10 probability of a text is the sum over its bits and choices:

1. repeat: is it what followed the last occurrence of the token before, in the same document?
2. two, one: has it been seen after the two tokens before, after the token before? If so the choice is
   (n - D) / (N - D * T): n its count in that context, N and T the context's tokens and distinct tokens, D the order's
   absolute discount.
3. known: does the corpus know it? If so the choice is the discounted share of its count.
4. again: is it one of the unknown words that the document had before? If so all of them are alike.
5. Otherwise it is spelled bit by bit, ending in a space.

Each bit of 1 to 4 is mixed from three hashed-context predictors by weights that a gate selects, refined by the counts
of the joint context, and shifted by a bias that is learned online while the document is read. The bits of a spelling are
mixed from predictors of orders 2 to 4 and one of the last short word (SHORT bytes at most) with two letters;
their weights are learned online and an adaptive map refines the mix by the byte before.

What the corpus teaches are exact counts of tokens and of tokens in contexts over all training documents; they grow with
the corpus and stay in the shared folder. A training document is scored by what the others teach: its own counts are
taken out. All counts are integers and all weights are learned in a fixed order (cells of tables, words by name in shards
by hash), so a score doesn't depend on how rows are dealt.

Work is laid out by chunks of at most CHUNK bytes of text. A chunk sends each context's distinct tokens as sorted runs to
ranges of the contexts' hashes (there are as many ranges as the corpus needs) and gets their counts back, so no token is
a row. A context that more than one in 2 ** HOT tokens has is dealt over several ranges by its tokens and summed. Tokens
and contexts are told apart by 64 bits of hash and more, growing with the number of ranges. Tables on the driver have
fixed sizes but for the hot contexts' (about one row for each range).

Defined results: a null text is empty, and an empty text is the end alone; repeated rows score alike; rows without an
id are training rows like others (their crc32 is that of the empty text); an empty table gives no rows; a corpus
without training rows has N = V = 0 and scores by spelling alone; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkernel as tk
from quire.llm.boosting import sigmoid
from quire.llm.common import drop_written, id_text_crc, summed_in_two, written

#: Bytes of text whose contexts are looked up together, and bytes of text that a range of contexts stands for.
CHUNK, RANGE = 4_000_000, 12_000_000
#: Bits of a context's hash beyond those of its range, and bits of a token's hash in it.
CONTEXT_BITS, TOKEN_BITS = 33, 31
#: A context with more than one in 2**HOT tokens is dealt over ranges; it is told from one position in EVERY.
HOT, EVERY = 14, 16
#: Bytes of a short word.
SHORT = 3
#: Orders that are counted: 0 the token itself, then contexts of one token and of two.
VOCABULARY, ONE, TWO = 0, 1, 2
#: The chain's bits in the order they are asked.
REPEAT, SEEN_TWO, SEEN_ONE, KNOWN, AGAIN = range(5)
CHAIN = 5
#: A bit's joint context: four values below 16, the first of which is the gate.
JOINT = 16**4
#: Tokens whose bits are put together at once.
TOLD = 1 << 16
#: The online bias: tokens between updates, rate, and how much it is drawn to nothing.
BLOCK, BIAS_RATE, BIAS_HOLD = 32, 0.02, 0.98

#: Orders of the spelling's predictors (0: the last short word with two letters) and the bits of their tables' addresses.
ORDERS, SLOT_BITS = (2, 3, 4, 0), (18, 18, 19, 19)
_ADDRESS = np.concatenate(([0], np.cumsum([1 << b for b in SLOT_BITS])))
_TABLE = int(_ADDRESS[-1])
_PART = 1 << 17
#: Gates of the spelling: bit number times how many predictors know their context.
GATES = 8 * (len(ORDERS) + 1)
#: Buckets of the adaptive map, per byte before.
MAP = 33
#: Words that are mixed in one step, those whose weights are updated together, and those of a shard of the learning.
STEP, ONLINE, SHARD = 20_000, 4_000, 100_000
RATE = 0.02

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SALT = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Values of bytes for a second hash of tokens.
_OTHER = (tk.mix(np.arange(256, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


# ---- packing


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers >= 0 as byte planes of the width they need, compressed together."""
    parts = [np.array([len(arrays)], "<u8").tobytes()]
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
        planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
        parts += [np.array([width, len(a)], "<u8").tobytes(), planes.tobytes()]
    raw = b"".join(parts)
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(data, "<u8", 1)[0])
    raw = pa.decompress(memoryview(data)[8:], size, codec="zstd", asbytes=True)
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw, "<u8", 1)[0])):
        width, n = (int(v) for v in np.frombuffer(raw, "<u8", 2, at))
        planes = np.frombuffer(raw, np.uint8, width * n, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 16 + width * n
    return out


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(starts: np.ndarray, n: int) -> np.ndarray:
    """The number of its run for each of n places."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def order_of(values: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers >= 0. Numbers and places are sorted as one number where they fit, which is fast."""
    bits = max(len(values) - 1, 1).bit_length()
    if len(values) and int(values.max()) < 1 << (63 - bits):
        return np.sort((values.astype(np.int64) << bits) | np.arange(len(values))) & ((1 << bits) - 1)
    return np.argsort(values, kind="stable")


def pair_order(context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the stable order by context, then by token; contexts and tokens in it). First by 26 and 18 of their bits; groups
    that these don't tell apart are put right."""
    n = len(context)
    if n > 1 << 20:
        order = np.lexsort((token, context))
        return order, context[order], token[order]
    fine, wide, place = np.uint64(20), np.uint64(38), np.uint64((1 << 20) - 1)
    key = np.sort((context >> wide << wide) | (token.astype(np.uint64) >> np.uint64(TOKEN_BITS - 18) << fine) | np.arange(n, dtype=np.uint64))
    order = (key & place).astype(np.int64)
    c, t = context[order], token[order]
    ranges = []
    for bits, mixed in ((wide, c[1:] != c[:-1]), (fine, t[1:] != t[:-1])):
        part = key >> bits
        bad = np.unique(part[1:][(part[1:] == part[:-1]) & mixed])
        first, last = np.searchsorted(part, bad), np.searchsorted(part, bad, side="right")
        if ranges and len(ranges[0][0]):  # within a range that is put right anyway
            within = ranges[0][1][np.maximum(np.searchsorted(ranges[0][0], first, side="right") - 1, 0)] > first
            within &= ranges[0][0][0] <= first
            first, last = first[~within], last[~within]
        ranges.append((first, last))
    first, last = (np.concatenate([r[k] for r in ranges]) for k in (0, 1))
    if len(first):
        by = np.argsort(first)
        size = (last - first)[by]
        group = np.repeat(first[by], size)
        at = group + np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        right = at[np.lexsort((order[at], t[at], c[at], group))]
        order[at], c[at], t[at] = order[right], c[right], t[right]
    return order, c, t


# ---- chunks

_CHUNK = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("hot", pa.binary())])
_CHUNK_SQL = "chunk long, docs binary, ids binary, sizes binary, words binary, hot binary"


class Chunk:
    """The documents of a chunk: token ids (0: the end), the tokens' bytes and hashes, and hashes of all contexts."""

    def __init__(self, docs: bytes, ids: bytes, sizes: bytes, words: bytes):
        self.doc_id, self.no_id, held, self.n_bytes, tokens = unpack(docs)
        self.held = held.astype(bool)
        (width,) = unpack(sizes)
        self.offsets = np.concatenate(([0], np.cumsum(width.astype(np.int64))))
        self.raw = np.frombuffer(pa.decompress(memoryview(words), int(self.offsets[-1]), codec="zstd", asbytes=True), np.uint8) if self.offsets[-1] else np.zeros(0, np.uint8)
        self.hash = tk.range_hashes(self.raw, self.offsets[:-1], self.offsets[1:])
        self.hash[0] = _END
        self.other = (tk.range_hashes(_OTHER[self.raw], self.offsets[:-1], self.offsets[1:]) >> np.uint64(64 - TOKEN_BITS)).astype(np.uint32)
        self._lay(unpack(ids)[0].astype(np.int64), tokens.astype(np.int64))

    def _lay(self, ids: np.ndarray, tokens: np.ndarray) -> None:
        self.ids, self.first = ids, np.concatenate(([0], np.cumsum(tokens)))
        self.owner = np.repeat(np.arange(len(tokens)), tokens)
        self.place = np.arange(len(ids)) - self.first[self.owner]

    @classmethod
    def unpacked(cls, ids: np.ndarray, tokens: np.ndarray, hashes: np.ndarray) -> Chunk:
        """A chunk that knows its tokens' hashes alone."""
        self = cls.__new__(cls)
        self.hash = hashes
        self._lay(ids, tokens)
        return self

    @classmethod
    def of(cls, row: dict) -> Chunk:
        return cls(row["docs"], row["ids"], row["sizes"], row["words"])

    def last_short(self) -> np.ndarray:
        """For each token the place of the last short word before it in its document, or -1."""
        short = np.diff(self.offsets) <= SHORT
        short[0] = False
        at = np.where(short[self.ids], np.arange(len(self.ids)), -1)
        last = np.full(len(self.ids), -1, dtype=np.int64)
        last[1:] = np.maximum.accumulate(at)[:-1]
        last[last < self.first[self.owner]] = -1
        return last

    def before(self, back: int, at: np.ndarray | None) -> np.ndarray:
        """The hash of the token that many places before, or that of the start."""
        if at is not None:
            return np.where(self.place[at] < back, _START, self.hash[self.ids[np.maximum(at - back, 0)]])
        h = np.full(len(self.ids), _START, dtype=np.uint64)
        h[back:] = self.hash[self.ids[:-back]]
        h[self.place < back] = _START
        return h

    def context(self, order: int, at: np.ndarray | None = None) -> np.ndarray:
        """The hash of the context of each token, or of those at some places; order 0 has an entry for each distinct token."""
        if order == VOCABULARY:
            return self.hash
        if order == ONE:
            return tk.mix(self.before(1, at) + _SALT[0])
        return tk.mix(self.before(1, at) * _SALT[1] + self.before(2, at) * _SALT[2])

    def short_codes(self, at: np.ndarray) -> np.ndarray:
        """16 bits of the hash of the last short word before each place."""
        last = self.last_short()[at]
        return tk.mix(np.where(last >= 0, self.hash[self.ids[np.maximum(last, 0)]], _START) + _SALT[3]) & np.uint64(0xFFFF)

    def training(self) -> np.ndarray:
        return ~self.held[self.owner]


class Entries:
    """A chunk's distinct (context, token) pairs of an order, sorted; hot contexts are salted by their tokens."""

    def __init__(self, chunk: Chunk, order: int, hot: Hot):
        context, token = chunk.context(order), chunk.other if order == VOCABULARY else chunk.other[chunk.ids]
        if order != VOCABULARY:
            context = hot.salted(order, context, token)
        self.order, context, token = pair_order(context, token)
        self.pair = runs(context, token)
        self.pair_of = spread(self.pair, len(context))
        self.context, self.token = context[self.pair], token[self.pair]
        self.run = runs(self.context)
        self.run_of = spread(self.run, len(self.context))

    def ranges(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(ranges, first pair of each and the total); a run of a context is never cut."""
        of = (self.context >> np.uint64(64 - bits)) if bits else np.zeros(len(self.context), np.uint64)
        starts = runs(of)
        return of[starts].astype(np.int64), np.append(starts, len(of))

    def within(self, bits: int) -> np.ndarray:
        """The contexts' hashes without the bits of the range."""
        return (self.context << np.uint64(bits)) >> np.uint64(64 - CONTEXT_BITS)


class Hot:
    """Contexts that are dealt over several ranges, and the totals of all their shares once these are counted."""

    def __init__(self, bits: int):
        self.bits = bits
        self.context = {o: np.zeros(0, np.uint64) for o in (ONE, TWO)}
        self.shares = dict.fromkeys(self.context, np.zeros(0, np.uint64))
        self.totals: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, order: int, context: np.ndarray, share: np.ndarray) -> None:
        """Contexts with their shares of all tokens."""
        by = np.argsort(context)
        self.context[order] = context[by]
        self.shares[order] = (1 + np.ceil(share[by] * (1 << self.bits) * 2)).astype(np.uint64)

    def _salt(self, context: np.ndarray, number: np.ndarray) -> np.ndarray:
        return tk.mix(context + (number + np.uint64(1)) * _C1)

    def salted(self, order: int, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        known = self.context[order]
        if not len(known):
            return context
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        hit = known[at] == context
        number = (tk.mix(token[hit].astype(np.uint64)) >> np.uint64(11)) % self.shares[order][at[hit]]
        out = context.copy()
        out[hit] = self._salt(context[hit], number)
        return out

    def salts(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted salted contexts, the hot context each belongs to)."""
        n = self.shares[order].astype(np.int64)
        of = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        salted = self._salt(self.context[order][of], number.astype(np.uint64))
        by = np.argsort(salted)
        return salted[by], of[by]

    def key(self, context: np.ndarray) -> np.ndarray:
        """The bits of a context that the ranges see."""
        return context >> np.uint64(max(0, 64 - CONTEXT_BITS - self.bits))

    def sum(self, order: int, keys: np.ndarray, tokens: np.ndarray, distinct: np.ndarray) -> None:
        """Takes the shares' counts and keeps the totals by salted context."""
        salted, of = self.salts(order)
        total = np.zeros((2, len(self.context[order])), dtype=np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(self.key(salted), keys), max(0, len(salted) - 1))
            for row, v in zip(total, (tokens, distinct), strict=True):
                np.add.at(row, of[at], v.astype(np.int64))
        self.totals[order] = (salted, total[0][of], total[1][of])

    def whole(self, order: int, context: np.ndarray, tokens: np.ndarray, distinct: np.ndarray) -> None:
        """Replaces the counts of salted contexts by those of the whole context."""
        salted, n, t = self.totals[order]
        if len(salted):
            at = np.minimum(np.searchsorted(salted, context), len(salted) - 1)
            hit = salted[at] == context
            tokens[hit], distinct[hit] = n[at[hit]], t[at[hit]]


def _chunks(batches):
    """A row for each chunk: its documents, token ids (by falling frequency), words, and frequent contexts of a sample."""
    task, number = TaskContext.get().partitionId(), 0
    held: list = []
    size = 0

    def flush():
        nonlocal held, size, number
        hashes = np.concatenate([h for _, h, _, _ in held])
        first, base, spans = [0], 0, []
        doc_ids, outs, n_bytes = [], [], []
        for rows, _, (starts, ends, f, sizes), raw in held:
            doc_ids.append(rows.column(0))
            outs.append(rows.column(1))
            n_bytes.append(sizes)
            first += (f[1:] + first[-1]).tolist()
            spans.append(np.stack([starts, ends]) + base)
            base += len(raw)
        first, spans = np.array(first), np.concatenate(spans, axis=1)
        raw = np.concatenate([r for *_, r in held])
        by, sorted_, _ = pair_order(hashes, np.zeros(len(hashes), np.uint32))
        starts = runs(sorted_)
        uniq, where, n = sorted_[starts], by[starts], np.diff(np.append(starts, len(by)))
        back = np.empty(len(by), dtype=np.int64)
        back[by] = spread(starts, len(by))
        order = np.lexsort((uniq, -n))
        # id 0 is the end; words follow by falling frequency
        place = np.empty(len(uniq), dtype=np.int64)
        place[order] = np.arange(1, len(uniq) + 1)
        docs = len(first) - 1
        ids = np.zeros(len(hashes) + docs, dtype=np.int64)
        if len(hashes):
            ids[np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(first))] = place[back]
        starts, ends = spans[0][where[order]], spans[1][where[order]]
        width = ends - starts
        offsets = np.concatenate(([0], np.cumsum(width)))
        picked = np.repeat(starts - offsets[:-1], width) + np.arange(int(offsets[-1]))
        id_of = pa.concat_arrays([a.cast(pa.int64()) for a in doc_ids])
        rows = pack(id_of.fill_null(0).to_numpy().view(np.uint64), id_of.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), np.concatenate([o.to_numpy(zero_copy_only=False) for o in outs]).astype(np.uint8), np.concatenate(n_bytes), np.diff(first) + 1)
        row = {"docs": rows, "ids": pack(ids), "sizes": pack(np.concatenate(([0], width))), "words": pa.compress(raw[picked].tobytes(), codec="zstd", asbytes=True)}
        row |= {"chunk": (task << 24) + number, "hot": _frequent(Chunk.unpacked(ids, np.diff(first) + 1, np.concatenate(([_END], uniq[order]))))}
        yield pa.RecordBatch.from_pylist([row], schema=_CHUNK)
        held, size, number = [], 0, number + 1

    for rows, raw, offsets in tk.pieces(batches, "text"):
        if held and size + len(raw) > CHUNK:
            yield from flush()
        low = tk.lower_ascii(raw)
        starts, ends, f = tk.words(raw, offsets)
        held.append((rows, tk.range_hashes(low, starts, ends), (starts, ends, f, np.diff(offsets)), low))
        size += len(raw)
    if held:
        yield from flush()


def _frequent(chunk: Chunk) -> bytes:
    """Of every EVERY-th token the contexts that more than one in 2**(HOT + 2) has, by order: they only steer the dealing."""
    out, at = [], np.arange(0, len(chunk.ids), EVERY)
    for order in (ONE, TWO):
        context, n = np.unique(chunk.context(order, at), return_counts=True)
        often = n > max(1, len(chunk.ids) // EVERY >> (HOT + 2))
        out += [context[often], n[often]]
    return pack(np.array([len(chunk.ids)]), *out)


def hot_contexts(chunks: DataFrame, bits: int) -> Hot:
    """The frequent contexts of all chunks' samples, by their share of all tokens."""
    hot, total, found = Hot(bits), 0, {}
    for r in chunks.select("hot").toLocalIterator():
        (n,), *rest = unpack(r["hot"])
        total += int(n)
        for i, order in enumerate((ONE, TWO)):
            held = found.setdefault(order, [np.zeros(0, np.uint64), np.zeros(0)])
            context, back = np.unique(np.concatenate((held[0], rest[2 * i].astype(np.uint64))), return_inverse=True)
            found[order] = [context, np.bincount(back, np.concatenate((held[1], rest[2 * i + 1])))]
    for order, (context, n) in found.items():
        often = n * EVERY > total / (1 << HOT)
        hot.add(order, context[often], n[often] * EVERY / max(total, 1))
    return hot


# ---- counts

_REPLY_SQL = "chunk long, place long, ord int, counts binary"
_REPLY = pa.schema([("chunk", pa.int64()), ("place", pa.int64()), ("ord", pa.int32()), ("counts", pa.binary())])
#: Rows that belong to no chunk: an order's statistics, and the shares of hot contexts.
STATISTICS, SHARES = -1, -2


def _keys(orders: tuple[int, ...], bits: int, hot: Hot):
    """A chunk's pairs of some orders, a row for each range."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                for order in orders:
                    yield from asked(row["chunk"], chunk, order)

    def asked(number: int, chunk: Chunk, order: int):
        own = Entries(chunk, order, hot)
        training = np.bincount(chunk.ids, chunk.training(), len(chunk.hash))[own.order] if order == VOCABULARY else chunk.training()[own.order]
        n = np.add.reduceat(training.astype(np.int64), own.pair)
        places, edges = own.ranges(bits)
        within = own.within(bits)
        at = np.searchsorted(own.run, edges)
        sizes = np.diff(np.append(own.run, len(own.context)))
        blobs = []
        for i in range(len(places)):
            a, b, c, d = edges[i], edges[i + 1], at[i], at[i + 1]
            blobs.append(pack(np.diff(within[own.run[c:d]], prepend=np.uint64(0)), sizes[c:d], own.token[a:b], n[a:b]))
        for i in range(0, len(places), 64):
            m = len(places[i : i + 64])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.array(places[i : i + 64]), pa.array(np.full(m, order, np.int32)), pa.array(blobs[i : i + 64], pa.binary())], schema=_REPLY)

    return run


def _counted(bits: int, hot_keys: dict[int, np.ndarray]):
    """The counts of all pairs of an order's range, as replies to the chunks that asked."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, order, asked, parts = key[0].as_py(), key[1].as_py(), [], []
        for batch in batches:
            asked += batch.column("chunk").to_pylist()
            parts += [unpack(b.as_py()) for b in batch.column("counts")]
        sizes = [p[1].astype(np.int64) for p in parts]
        context = np.concatenate([np.repeat(np.cumsum(p[0].astype(np.uint64)), s) for p, s in zip(parts, sizes, strict=True)])
        both = (context << np.uint64(TOKEN_BITS)) | np.concatenate([p[2].astype(np.uint64) for p in parts])
        by = np.argsort(both)
        sorted_ = both[by]
        pair = runs(sorted_)
        n = np.add.reduceat(np.concatenate([p[3] for p in parts]).astype(np.int64)[by], pair)
        own = sorted_[pair] >> np.uint64(TOKEN_BITS)
        run_ = runs(own)
        tokens, distinct = np.add.reduceat(n, run_), np.add.reduceat((n > 0).astype(np.int64), run_)
        pair_of, of = np.empty(len(by), np.int64), spread(run_, len(own))
        pair_of[by] = spread(pair, len(by))
        out, a = [], 0
        for s in sizes:
            m = int(s.sum())
            mine = pair_of[a : a + m]
            at = of[mine[np.cumsum(s) - s]]
            out.append(pack(n[mine]) if order == VOCABULARY else pack(n[mine], tokens[at], distinct[at]))
            a += m
        asked.append(STATISTICS)
        out.append(pack(np.array([n.sum(), (n > 0).sum(), (n == 1).sum(), (n == 2).sum()])))
        if len(hot_keys.get(order, ())):
            whole = (np.uint64(place) << np.uint64(CONTEXT_BITS)) | own[run_] if bits else own[run_]
            mine = np.isin(whole, hot_keys[order])
            if mine.any():
                asked.append(SHARES)
                out.append(pack(whole[mine], tokens[mine], distinct[mine]))
        for i in range(0, len(asked), 64):
            m = len(asked[i : i + 64])
            yield pa.RecordBatch.from_arrays([pa.array(asked[i : i + 64], pa.int64()), pa.array(np.full(m, place)), pa.array(np.full(m, order, np.int32)), pa.array(out[i : i + 64], pa.binary())], schema=_REPLY)

    return run


def counts_of(chunks: DataFrame, orders: tuple[int, ...], bits: int, hot: Hot) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(replies to all chunks, by order its statistics: tokens, distinct pairs, pairs counted once, twice)."""
    keys = {o: np.sort(hot.key(hot.salts(o)[0])) for o in orders if o != VOCABULARY}
    asked = chunks.select("chunk", "docs", "ids", "sizes", "words").mapInArrow(_keys(orders, bits, hot), _REPLY_SQL)
    replies = written(asked.groupBy("place", "ord").applyInArrow(_counted(bits, keys), _REPLY_SQL), "counts", every_row=True)
    total = {o: np.zeros(4, dtype=np.int64) for o in orders}
    shares: dict[int, list] = {o: [[], [], []] for o in keys}
    for r in replies.where("chunk < 0").select("chunk", "ord", "counts").toLocalIterator():
        found = unpack(r["counts"])
        if r["chunk"] == STATISTICS:
            total[r["ord"]] += found[0].astype(np.int64)
        else:
            for held, v in zip(shares[r["ord"]], found, strict=True):
                held.append(v)
    for o, parts in shares.items():
        hot.sum(o, *(np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts))
    return replies, total


# ---- the chain's bits

_FEATURES = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("bits", pa.binary()), ("spelled", pa.binary()), ("words", pa.binary()), ("n_spelled", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
_FEATURES_SQL = "chunk long, docs binary, bits binary, spelled binary, words binary, n_spelled long, part int, counts binary"


def bucket(v: np.ndarray) -> np.ndarray:
    """Number of binary digits, 15 at most."""
    return np.minimum(np.frexp(v.astype(np.float64))[1], 15).astype(np.uint16)


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b in fifteenths, rounded down; 15 where b is 0."""
    return np.where(b > 0, 15 * a / np.maximum(b, 1), 15).astype(np.uint16)


def joined(*values: np.ndarray) -> np.ndarray:
    """Values below 16 as one number of 16 bits."""
    code = values[0].astype(np.uint16)
    for v in values[1:]:
        code = code * np.uint16(16) + v.astype(np.uint16)
    return code


def history(outcome: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The last four outcomes within the document before each."""
    out = np.zeros(len(outcome), dtype=np.uint8)
    seen = outcome.view(np.uint8)
    for k in range(1, 5):
        out[k:] |= (seen[:-k] & (owner[k:] == owner[:-k]).view(np.uint8)) << np.uint8(k - 1)
    return out


def followed(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last token that followed the same token in the document, or -1; length of the run of such hits before)."""
    n = len(chunk.ids)
    prev = np.empty(n, dtype=np.int64)
    prev[1:] = chunk.ids[:-1]
    prev[chunk.place == 0] = -1
    key = chunk.owner * np.int64(len(chunk.hash) + 1) + prev + 1
    order = order_of(key)
    last = np.full(n, -1, dtype=np.int64)
    last[order[1:]] = np.where(key[order][1:] == key[order][:-1], order[:-1], -1)
    last[prev < 0] = -1
    hit = (last >= 0) & (chunk.ids[last] == chunk.ids)
    stop = np.maximum.accumulate(np.where(hit & (chunk.place > 0), -1, np.arange(n)))
    before = np.zeros(n, dtype=np.int64)
    before[1:] = np.arange(n - 1) - stop[:-1]
    before[chunk.place == 0] = 0
    return last, before


class Others:
    """What the other documents say of a chunk's tokens in their contexts; equal ones of a document share an entry.

    entry: the entry of each token; n, tokens, distinct: of each entry the token's count in its context, all tokens of the
    context and its distinct tokens, all without the document's own.
    """

    def __init__(self, chunk: Chunk, order: int, hot: Hot, reply: list[np.ndarray], less: float):
        own = Entries(chunk, order, hot)
        n, tokens, distinct = (v.astype(np.int64) for v in reply)
        hot.whole(order, own.context[own.run], tokens, distinct)
        owner = chunk.owner[own.order]
        sub = runs(own.pair_of, owner)
        size = np.diff(np.append(sub, len(owner)))
        pair, doc = own.pair_of[sub], owner[sub]
        context = own.run_of[pair]
        same = context
        if len(hot.context[order]):  # the shares of a hot context are one
            same = np.unique(chunk.context(order, own.order[own.pair[own.run]]), return_inverse=True)[1][context]
        by = order_of(same * len(chunk.held) + doc)
        group = runs(same[by], doc[by])
        of = np.empty(len(by), dtype=np.int64)
        of[by] = spread(group, len(by))
        held, all_ = chunk.held[doc], n[pair]
        self.entry = np.empty(len(owner), dtype=np.int64)
        self.entry[own.order] = np.repeat(np.arange(len(sub)), size)
        self.n = all_ - np.where(held, 0, size)
        self.tokens = tokens[context] - np.where(held, 0, np.add.reduceat(size[by], group)[of])
        self.distinct = distinct[context] - np.where(held, 0, np.add.reduceat((all_ == size)[by].astype(np.int64), group)[of])
        self.less = less
        self.ratio = share(self.distinct, self.tokens)
        self.code = joined(bucket(self.tokens), self.ratio)
        self.heard, self.seen = self.tokens > 0, self.n > 0

    def choice(self, e: np.ndarray) -> np.ndarray:
        """The log10 probabilities of some entries' tokens among those seen in their contexts."""
        return np.log10((self.n[e] - self.less) / (self.tokens[e] - self.less * self.distinct[e]))


def discount(statistics: np.ndarray) -> float:
    """The absolute discount that counts of one and of two occurrences suggest."""
    _, _, once, twice = (float(v) for v in statistics)
    return min(max((once + 0.5) / (once + 2 * twice + 1), 0.1), 0.9)


def _features(hot: Hot, statistics: dict[int, np.ndarray]):
    """All that a chunk's bits are mixed from, and the log10 probabilities of its choices."""
    tokens, distinct = int(statistics[VOCABULARY][0]), int(statistics[VOCABULARY][1])
    less = {o: discount(s) for o, s in statistics.items()}

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = Chunk.of(row)
        got: dict[int, list] = {}
        for r in sorted(right.to_pylist(), key=lambda r: (r["ord"], r["place"])):
            got.setdefault(r["ord"], []).append(unpack(r["counts"]))
        reply = {o: [np.concatenate(v) for v in zip(*parts, strict=True)] for o, parts in got.items()}
        ids, owner, place, training = chunk.ids, chunk.owner, chunk.place, chunk.training()
        vocabulary = Entries(chunk, VOCABULARY, hot)
        c = np.empty(len(chunk.hash), dtype=np.int64)
        c[vocabulary.order] = reply[VOCABULARY][0].astype(np.int64)[vocabulary.pair_of]
        by = order_of(ids)
        sub = runs(ids[by], owner[by])
        size = np.diff(np.append(sub, len(by)))
        own = np.empty(len(ids), dtype=np.int64)
        own[by] = np.repeat(size, size)
        first_here = np.zeros(len(ids), dtype=bool)
        first_here[by[sub]] = True
        known = c[ids] - np.where(training, own, 0)
        docs = len(chunk.held)
        only_here = np.bincount(owner[by[sub]], (c[ids[by[sub]]] == size) & training[by[sub]], docs).astype(np.int64)
        n_tokens = np.diff(chunk.first)
        others, kinds = tokens - np.where(chunk.held, 0, n_tokens), distinct - only_here
        # unknown words that the document had before, the prior token's count
        unknown = known == 0
        new = unknown & first_here
        so_far = np.cumsum(new) - new
        so_far -= so_far[chunk.first[:-1]][owner]
        prior = np.zeros(len(ids), dtype=np.int64)
        prior[1:] = known[:-1]
        prior[place == 0] = 0
        last, before = followed(chunk)
        one, two = (Others(chunk, o, hot, reply[o], less[o]) for o in (ONE, TWO))
        choice = np.zeros(len(ids))
        told = np.full(len(ids), CHAIN, dtype=np.uint8)
        asked = np.zeros(len(ids), dtype=np.uint8)
        codes: list[list[np.ndarray]] = [[] for _ in range(CHAIN)]

        def tell(cut: slice) -> None:
            """The bits of some documents' tokens, few enough to stay in the processor's cache."""
            here, owner_, known_, prior_, place_, last_, before_, so_far_, first_ = (v[cut] for v in (ids, owner32, known, prior, place, last, before, so_far, first_here))
            entry = {ONE: one.entry[cut], TWO: two.entry[cut]}
            ratio = {ONE: one.ratio[entry[ONE]], TWO: two.ratio[entry[TWO]]}
            choice_, told_, asked_ = choice[cut], told[cut], asked[cut]
            pending = np.ones(len(here), dtype=bool)

            def ask(bit: int, use: np.ndarray, outcome: np.ndarray, code) -> np.ndarray:
                """Asks a bit of the tokens that are not told yet; returns the places where it is one."""
                at = np.flatnonzero(use & pending)
                yes = outcome[at]
                codes[bit].append(code(at, history(yes, owner_[at])))
                asked_[at] |= 1 << bit
                hit = at[yes]
                told_[hit] = bit
                pending[hit] = False
                return hit

            guess = last_ >= 0
            ask(REPEAT, guess, guess & (ids[last_] == here), lambda at, h: joined(np.minimum(before_[at], 15), h, bucket(prior_[at]), bucket(known[last_[at]])))
            for bit, seen, order, other in ((SEEN_TWO, two, TWO, ONE), (SEEN_ONE, one, ONE, TWO)):
                own, beside = entry[order], ratio[other]
                hit = ask(bit, seen.heard[own], seen.seen[own], lambda at, h, seen=seen, own=own, beside=beside: joined(seen.code[own[at]], h, beside[at]))
                choice_[hit] = seen.choice(own[hit])
            hit = ask(KNOWN, pending, known_ > 0, lambda at, h: joined(h, ratio[ONE][at], bucket(prior_[at]), share(so_far_[at], np.maximum(place_[at], 1))))
            choice_[hit] = np.log10((known_[hit] - less[VOCABULARY]) / (others[owner_[hit]] - less[VOCABULARY] * kinds[owner_[hit]]))
            hit = ask(AGAIN, so_far_ > 0, ~first_, lambda at, h: joined(bucket(so_far_[at]), h, bucket(place_[at]), bucket(prior_[at])))
            choice_[hit] = -np.log10(so_far_[hit])

        owner32 = owner.astype(np.int32)
        for a, b in tk.slices(n_tokens, TOLD):
            tell(slice(chunk.first[a], chunk.first[b]))
        base = np.log10((c + 1.0) / (tokens + distinct + 1.0))[ids]
        cut = chunk.first[:-1]
        sums = [np.add.reduceat(v, cut).astype(np.float64).view(np.uint64) for v in (choice, base)]
        rows = pack(chunk.doc_id, chunk.no_id, chunk.held, chunk.n_bytes, n_tokens, np.add.reduceat((c[ids] > 0).astype(np.int64), cut), *sums)
        every = [np.concatenate(own) for own in codes]
        spelled = np.flatnonzero(told == CHAIN)
        width = np.diff(chunk.offsets)[ids[spelled]]
        offsets = np.concatenate(([0], np.cumsum(width)))
        raw = chunk.raw[np.repeat(chunk.offsets[:-1][ids[spelled]] - offsets[:-1], width) + np.arange(int(offsets[-1]))]
        words = [pack(owner[spelled], width, chunk.short_codes(spelled)), pa.compress(raw.tobytes(), codec="zstd", asbytes=True)]
        n_spelled = int(training[spelled].sum())
        out = [{"chunk": row["chunk"], "docs": rows, "bits": pack(told, asked, *every), "spelled": words[0], "words": words[1], "n_spelled": n_spelled}]
        for bit, code in enumerate(every):
            at = np.flatnonzero(asked & (1 << bit))
            use = training[at]
            out.append({"part": bit, "counts": pack(*(np.bincount(v, minlength=JOINT) for v in (code[use], code[use & (told[at] == bit)])))})
        return pa.Table.from_pylist(out, schema=_FEATURES)

    return run


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of packed arrays of counts."""
    total: list[np.ndarray] = []
    for batch in batches:
        for p in batch.column(1):
            parts = [a.astype(np.int64) for a in unpack(p.as_py())]
            total = [a + b for a, b in zip(total, parts, strict=True)] if total else parts
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(*total)], pa.binary())], ["part", "counts"])


def refined(tried: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """A bit's probability in every joint context: three predictors mixed by gated weights, refined by the cell's counts."""
    grid_t, grid_h = tried.reshape(16, 16, 16, 16).astype(np.float64), hits.reshape(16, 16, 16, 16).astype(np.float64)
    inputs = []
    for axes in ((2, 3), (1, 3), (1, 2)):
        t, h = grid_t.sum(axes, keepdims=True), grid_h.sum(axes, keepdims=True)
        inputs.append(np.broadcast_to(stretch((h + 0.4) / (t + 0.8)), grid_t.shape).reshape(-1))
    x = np.stack(inputs)
    gate = np.arange(JOINT) >> 12
    w = np.full((16, 3), 0.4)
    mass = np.maximum(np.bincount(gate, tried, 16), 1)
    for _ in range(200):
        err = hits - tried * sigmoid((x * w[gate].T).sum(0))
        w += 0.02 * np.stack([np.bincount(gate, err * x[k], 16) for k in range(3)], axis=1) / mass[:, None]
    p = sigmoid((x * w[gate].T).sum(0))
    return np.clip((hits + 20 * p) / (tried + 20), 1e-5, 1 - 1e-5)


# ---- spelling


class Spelled:
    """The bits of some words and an ending space, and their addresses in the predictors' tables."""

    def __init__(self, raw: np.ndarray, size: np.ndarray, short: np.ndarray):
        offsets = np.concatenate(([0], np.cumsum(size)))
        self.first = offsets[:-1] + np.arange(len(size))
        self.owner = np.repeat(np.arange(len(size)), size + 1)
        self.code = np.full(len(raw) + len(size), 32, dtype=np.uint8)
        self.code[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
        place = np.arange(len(self.code)) - self.first[self.owner]
        h = np.zeros(len(self.code), dtype=np.uint64)
        found = {}
        for k in range(1, max(ORDERS) + 1):
            back = np.zeros(len(self.code), dtype=np.uint64)
            back[k:] = self.code[:-k]
            back[place < k] = 0
            if k == 1:
                self.before = back.astype(np.uint8)
            h = h + (back + np.uint64(1)) * _SALT[k - 1]
            if k == 2:
                found[0] = tk.mix(h + (short[self.owner].astype(np.uint64) + np.uint64(1)) * _C2)
            found[k] = tk.mix(h + np.uint64(k))
        self.context = [found[k] for k in ORDERS]

    def bits(self):
        """For each bit of a byte, most telling first: (number, values, addresses with a row per order)."""
        for b in range(8):
            node = ((self.code.astype(np.uint64) | np.uint64(256)) >> np.uint64(8 - b)) * _C1
            at = np.stack([(((h ^ node) * _C2) >> np.uint64(64 - bits)).view(np.int64) + base for h, bits, base in zip(self.context, SLOT_BITS, _ADDRESS[:-1].tolist(), strict=True)])
            yield b, (self.code >> np.uint8(7 - b)) & np.uint8(1), at


def _words(row: dict, chunk_held: np.ndarray, training: bool) -> tuple[np.ndarray, ...]:
    """(bytes, sizes, short words, document) of a chunk's spelled words; with training those of training documents alone."""
    owner, size, short = (v.astype(np.int64) for v in unpack(row["spelled"]))
    total = int(size.sum())
    raw = np.frombuffer(pa.decompress(memoryview(row["words"]), total, codec="zstd", asbytes=True), np.uint8) if total else np.zeros(0, np.uint8)
    if training:
        use = ~chunk_held[owner]
        raw, owner, size, short = raw[np.repeat(use, size)], owner[use], size[use], short[use]
    return raw, size, short, owner


def _steps(raw: np.ndarray, size: np.ndarray, short: np.ndarray):
    """(words, range) in steps; a step ends after STEP words or a piece's bytes."""
    offsets = np.concatenate(([0], np.cumsum(size)))
    for a, b in tk.slices(size + tk.PIECE // (4 * STEP), tk.PIECE // 4):
        yield Spelled(raw[offsets[a] : offsets[b]], size[a:b], short[a:b]), slice(a, b)


def _held(row: dict) -> np.ndarray:
    return unpack(row["docs"])[2].astype(bool)


def _count(batches):
    """The task's part of all tables: ones, then all, as counts of bits over the spelled words of training documents."""
    seen, any_row = np.zeros(2 * _TABLE, np.int64), False
    for batch in batches:
        for row in batch.to_pylist():
            raw, size, short, _ = _words(row, _held(row), True)
            for spelled, _ in _steps(raw, size, short):
                any_row = True
                places = np.concatenate([at * 2 + bit for _, bit, at in spelled.bits()], axis=1)
                for k, base in enumerate((2 * _ADDRESS[:-1]).tolist()):
                    n = 2 << SLOT_BITS[k]
                    seen[base : base + n] += np.bincount(places[k] - base, minlength=n)
    if any_row:
        # zeros and ones lie side by side
        both = np.concatenate((seen[1::2], seen[::2] + seen[1::2]))
        parts = [pack(both[i : i + _PART]) for i in range(0, len(both), _PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])


def bit_tables(features: DataFrame) -> np.ndarray:
    """Two rows (ones, all) of bit counts over the spelled words of all training documents."""
    out = np.zeros(2 * _TABLE, dtype=np.float32)
    parts = features.select("docs", "spelled", "words").mapInArrow(_count, "part int, counts binary")
    for r in summed_in_two(parts, "part", "counts", _add, "part int, counts binary").toLocalIterator():
        (own,) = unpack(r["counts"])
        out[r["part"] * _PART : r["part"] * _PART + len(own)] = own
    return out.reshape(2, _TABLE)


def predictions(tables: np.ndarray) -> np.ndarray:
    """Stretched predictions of all slots in three parts: without one occurrence of 0, without one of 1, and as counted."""
    out = np.empty((3, _TABLE), dtype=np.float32)
    for row, (less_one, less_all) in enumerate(((0, 1), (1, 1), (0, 0))):
        one, all_ = np.maximum(tables[0] - less_one, 0), np.maximum(tables[1] - less_all, 0)
        zero = np.maximum(all_ - one, 0)
        out[row] = np.log((one + np.float32(0.1)) / (zero + np.float32(0.1))) * (all_ / (all_ + np.float32(0.5)))
    return out.ravel()


def _inputs(slots: np.ndarray, at: np.ndarray, b: int, bit: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(predictions, one row per order; gate). Where own is true (None: everywhere), the bit's own occurrence is left out."""
    part = bit.astype(np.int64) if own is None else np.where(own, bit, np.int64(2))
    x = slots.take(at + part * _TABLE)
    return x, b * (len(ORDERS) + 1) + np.count_nonzero(x, axis=0)


def _mixed(x: np.ndarray, w: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The predictions mixed by the gates' weights, still stretched."""
    total = x[0] * w[:, 0].take(gate)
    for k in range(1, len(x)):
        total += x[k] * w[:, k].take(gate)
    return total


def _sharded(shards: int):
    """Spelled words of training documents by shards of their hashes."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, size, short, _ = _words(row, _held(row), True)
                if not len(size):
                    continue
                offsets = np.concatenate(([0], np.cumsum(size)))
                of = (tk.range_hashes(raw, offsets[:-1], offsets[1:]) % np.uint64(shards)).astype(np.int64)
                words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])
                by = np.argsort(of, kind="stable")
                starts = runs(of[by])
                for a, b in zip(starts, np.append(starts[1:], len(by)), strict=True):
                    mine = words.take(pa.array(by[a:b]))
                    joined_, edges = tk.utf8(mine)
                    yield pa.RecordBatch.from_arrays([pa.array([int(of[by[a]])], pa.int32()), pa.array([pack(np.diff(edges), short[by[a:b]])], pa.binary()), pa.array([joined_.tobytes()], pa.binary())], ["shard", "sizes", "words"])

    return run


def _learn(slots: np.ndarray):
    """Weights and map counts that are learned online from a shard's words, in the order of their bytes."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, shorts, raws = [], [], []
        for batch in batches:
            for s, r in zip(batch.column(1), batch.column(2), strict=True):
                size, short = unpack(s.as_py())
                sizes.append(size.astype(np.int64))
                shorts.append(short.astype(np.int64))
                raws.append(r.as_py())
        size, short, raw = np.concatenate(sizes), np.concatenate(shorts), b"".join(raws)
        offsets = np.concatenate(([0], np.cumsum(size)))
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        table = pa.table({"word": words, "short": short}).sort_by([("word", "ascending"), ("short", "ascending")])
        joined_, edges = tk.utf8(table.column("word"))
        w = np.full((GATES, len(ORDERS)), 0.3)
        seen = np.zeros((2, 256 * MAP), dtype=np.int64)
        for spelled, _ in _steps(joined_, np.diff(edges), table.column("short").to_numpy()):
            for b, bit, at in spelled.bits():
                x, gate = _inputs(slots, at, b, bit, None)
                mixed = np.empty(len(bit), dtype=np.float32)
                for i in range(0, len(bit), ONLINE * 8):
                    cut = slice(i, i + ONLINE * 8)
                    mixed[cut] = _mixed(x[:, cut], w, gate[cut])
                    err, mass = bit[cut] - sigmoid(mixed[cut]), np.bincount(gate[cut], minlength=GATES)
                    for k in range(len(ORDERS)):
                        w[:, k] += np.clip(RATE * 10 * np.bincount(gate[cut], err * x[k, cut], GATES) / np.maximum(mass, 1), -0.1, 0.1)
                place = spelled.before.astype(np.int64) * MAP + _map_bucket(mixed)
                seen += np.stack([np.bincount(place, bit, 256 * MAP).astype(np.int64), np.bincount(place, minlength=256 * MAP)])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([len(size)], pa.int64()), pa.array([w.tobytes()], pa.binary()), pa.array([pack(*seen)], pa.binary())], ["shard", "n", "weights", "seen"])

    return run


def _map_bucket(mixed: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(mixed * 2) + MAP // 2, 0, MAP - 1).astype(np.int64)


def mixer(features: DataFrame, slots: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights of every gate, refined probability per byte before and bucket) of the spelling."""
    shards = min(4096, max(1, -(-words // SHARD)))
    dealt = features.select("docs", "spelled", "words").mapInArrow(_sharded(shards), "shard int, sizes binary, words binary")
    rows = dealt.groupBy("shard").applyInArrow(_learn(slots), "shard int, n long, weights binary, seen binary")
    total, w, seen = 0, np.zeros((GATES, len(ORDERS))), np.zeros((2, 256 * MAP))
    for r in sorted(rows.collect(), key=lambda r: r["shard"]):
        total += r["n"]
        w += r["n"] * np.frombuffer(r["weights"]).reshape(w.shape)
        seen += np.stack(unpack(r["seen"]))
    middle = np.tile(sigmoid((np.arange(MAP) - MAP // 2) / 2), 256)
    return (w / total if total else np.full(w.shape, 0.3)), ((seen[0] + 20 * middle) / (seen[1] + 20)).reshape(256, MAP)


def spelling(raw: np.ndarray, size: np.ndarray, short: np.ndarray, own: np.ndarray, slots: np.ndarray, w: np.ndarray, map_: np.ndarray) -> np.ndarray:
    """The log10 probability of each word's spelling. own: whether the tables have counted the word."""
    out, narrow = np.zeros(len(size)), map_.ravel().astype(np.float32)
    for spelled, cut in _steps(raw, size, short):
        total, mine = np.zeros(len(spelled.code)), own[cut][spelled.owner]
        for b, bit, at in spelled.bits():
            x, gate = _inputs(slots, at, b, bit, mine)
            mixed = _mixed(x, w, gate)
            p = np.clip(0.5 * sigmoid(mixed) + 0.5 * narrow.take(spelled.before.astype(np.int64) * MAP + _map_bucket(mixed)), 1e-5, 1 - 1e-5)
            total += np.log10(np.where(bit, p, 1 - p), dtype=np.float32)
        out[cut] = np.add.reduceat(total, spelled.first)
    return out


# ---- scores


def read_online(x: np.ndarray, outcome: np.ndarray, owner: np.ndarray, block: np.ndarray, docs: int) -> np.ndarray:
    """The log10 probability of a bit's outcomes by document; x: stretched probabilities, all in the order of blocks. A
    document's bias is learned after every block of its tokens."""
    out, bias = np.zeros(docs), np.zeros(docs)
    edges = np.append(runs(block), len(block)).tolist() if len(block) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        who, y = owner[a:b], outcome[a:b]
        p = sigmoid(x[a:b] + bias[who])
        here = runs(who)
        docs_here = who[here]
        out[docs_here] += np.add.reduceat(np.log10(np.where(y, p, 1 - p)), here)
        bias[docs_here] = BIAS_HOLD * bias[docs_here] + BIAS_RATE * np.add.reduceat(y - p, here)
    return out


_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _scored(train_tokens: int, chain: list[np.ndarray], slots: np.ndarray, w: np.ndarray, map_: np.ndarray):
    chain = [stretch(p) for p in chain]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc_id, no_id, held, n_bytes, n_tokens, n_known, choice, base = unpack(row["docs"])
                told, asked, *codes = unpack(row["bits"])
                n_tokens, docs = n_tokens.astype(np.int64), len(held)
                owner = np.repeat(np.arange(docs), n_tokens)
                block = (np.arange(len(owner)) - np.repeat(np.cumsum(n_tokens) - n_tokens, n_tokens)) // BLOCK
                score = choice.astype("<u8").view(np.float64).copy()
                by = order_of(block)
                told, asked, owner, block = told[by], asked[by], owner[by], block[by]
                full = np.zeros(len(by))
                for bit, code in enumerate(codes):
                    at = np.flatnonzero(asked & (1 << bit))
                    full[np.sort(by[at])] = chain[bit][code]  # codes lie in the order of the text
                    score += read_online(full[by[at]], told[at] == bit, owner[at], block[at], docs)
                raw, size, short, of = _words(row, held.astype(bool), False)
                if len(size):
                    score += np.bincount(of, spelling(raw, size, short, held[of] == 0, slots, w, map_), docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_id.astype(np.uint64).view(np.int64), mask=no_id.astype(bool)), pa.array(held.astype(bool)), pa.array(n_tokens), pa.array(n_known.astype(np.int64)),
                        pa.array(np.full(docs, train_tokens)), pa.array(base.astype("<u8").view(np.float64)), pa.array(score), pa.array(n_bytes.astype(np.int64)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
                )

    return run


def score_documents(docs: DataFrame, held_out=None) -> DataFrame:
    """Every document's score, and the base score of smoothed counts. held_out: a boolean column; its rows teach nothing."""
    held_out = (id_text_crc() % 7 == 2) if held_out is None else held_out
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = (int(size) // RANGE).bit_length()
    chunks = written(source.mapInArrow(_chunks, _CHUNK_SQL), "chunks", every_row=True)
    hot = hot_contexts(chunks, bits)
    # an order at a time, so that fewer shuffled bytes lie on disks at once
    found = [counts_of(chunks, orders, bits, hot) for orders in ((VOCABULARY, ONE), (TWO,))]
    statistics = {o: s for _, by_order in found for o, s in by_order.items()}
    replies = found[0][0].unionByName(found[1][0])
    rows = chunks.select("chunk", "docs", "ids", "sizes", "words")
    asked = replies.where("chunk >= 0").select(F.col("chunk").alias("home"), "place", "ord", "counts")
    features = written(rows.groupBy("chunk").cogroup(asked.groupBy("home")).applyInArrow(_features(hot, statistics), _FEATURES_SQL), "features", every_row=True)
    drop_written(chunks, *(table for table, _ in found))
    chain = [refined(np.zeros(JOINT), np.zeros(JOINT))] * CHAIN
    for r in summed_in_two(features.where("part IS NOT NULL"), "part", "counts", _add, "part int, counts binary").collect():
        chain[r["part"]] = refined(*unpack(r["counts"]))
    read = features.where("chunk IS NOT NULL")
    slots = predictions(bit_tables(read))
    w, map_ = mixer(read, slots, read.agg(F.coalesce(F.sum("n_spelled"), F.lit(0))).first()[0])
    scored = read.select("docs", "bits", "spelled", "words").mapInArrow(_scored(int(statistics[VOCABULARY][0]), chain, slots, w, map_), _SCORED_SQL)
    bits_of = -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))
    return scored.withColumn("bits_per_byte", bits_of)
