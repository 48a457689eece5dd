"""Transfer of times to the true words in one pass: sections come with both sides' words as arrays, a row each, so that no
word is dealt out. alignment.transfer() and regroup_paragraphs() say the same over scripts that are tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.functions.similarity import jaro_winkler
from quire.operators.alignment import THRESHOLD, _bare, edits_between
from quire.operators.sequences import ANCHOR

#: Words of both sides that are aligned at once; a longer section is aligned alone.
WORDS = 100_000
EQUAL, FUZZY, DELETE, INSERT = range(4)
CONFIDENCE = pa.array(["exact", "fuzzy", "bracketed", "interpolated", "unsynced"])


@lru_cache(maxsize=1 << 17)
def _alike(a: str, b: str) -> bool:
    return jaro_winkler(a, b) >= THRESHOLD


def _script(heard: list[int], true: list[int], names: list[str], i0: int, j0: int, out: list[tuple[int, int, int, int]]) -> None:
    """Adds (op, first heard word, first true word, words) of alignment.word_diff() to out, kept words as runs; words are
    codes of names, and their indices begin at i0 and j0."""
    gone: list[int] = []
    come: list[int] = []

    def close():
        for i, j in zip(gone, come, strict=False):
            if _alike(names[heard[i]], names[true[j]]):
                out.append((FUZZY, i0 + i, j0 + j, 1))
            else:
                out.append((DELETE, i0 + i, -1, 1))
                out.append((INSERT, -1, j0 + j, 1))
        n = min(len(gone), len(come))
        out.extend((DELETE, i0 + i, -1, 1) for i in gone[n:])
        out.extend((INSERT, -1, j0 + j, 1) for j in come[n:])
        gone.clear()
        come.clear()

    i = j = 0
    for new, till, other in edits_between(heard, true):
        if till > i:
            if gone or come:
                close()
            out.append((EQUAL, i0 + i, j0 + j, till - i))
        if new:
            come.append(other)
            i, j = till, other + 1
        else:
            gone.append(till)
            i, j = till + 1, other
    close()
    if len(heard) > i:
        out.append((EQUAL, i0 + i, j0 + j, len(heard) - i))


def _starts(*changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of rows start, and each row's group."""
    first = np.logical_or.reduce(changes)
    first[0] = True
    return np.flatnonzero(first), np.cumsum(first) - 1


def _changed(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _or(values: np.ndarray, other) -> np.ndarray:
    return np.where(np.isnan(values), other, values)


def _timed(op: np.ndarray, heard: np.ndarray, true: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, audio_end: np.ndarray, length: np.ndarray, strategy: str) -> tuple[np.ndarray, ...]:
    """(true word, start, end, confidence) of the true words, by the rules of alignment.transfer(); NaN is null.

    op, heard, true and owner (its section): a script's steps, -1 where a side has no word; start and end by heard word,
    audio_end by section, length by true word.
    """
    n = len(op)
    place = np.arange(n)
    match, inserts = op <= FUZZY, op == INSERT
    w_start = np.where(heard >= 0, start[heard] if len(start) else np.nan, np.nan)
    w_end = np.where(heard >= 0, end[heard] if len(end) else np.nan, np.nan)
    new_section = _changed(owner)
    section_at, section = _starts(new_section)
    # regions: what lies before the first and behind the last run of matches that is an anchor
    run_at, run = _starts(new_section, _changed(match))
    anchored = match[run_at] & (np.diff(np.append(run_at, n)) >= ANCHOR)
    lead, trail = np.full(len(section_at), -1), np.full(len(section_at), n)
    of = section[run_at[anchored]]
    lead[of[::-1]] = run_at[anchored][::-1]
    trail[of] = np.append(run_at, n)[1:][anchored]
    leading, trailing = place < lead[section], place >= trail[section]
    region = leading + 2 * trailing
    boundary = leading | trailing
    core = match & ~boundary
    audio_end = audio_end[owner[section_at]]
    core_start = _or(np.fmin.reduceat(np.where(core, w_start, np.nan), section_at), 0.0)[section]
    core_end = _or(np.fmax.reduceat(np.where(core, w_end, np.nan), section_at), _or(audio_end, 0.0))[section]
    # runs: a match and what lies behind it, up to the next match or region
    new_region = _changed(region) | new_section
    run_at, run = _starts(new_region, match)
    first = np.minimum.reduceat(np.where(inserts, place, n), run_at)[run]
    pool = np.fmax.reduceat(np.where((op == DELETE) & (place > first), w_end, np.nan), run_at)[run]
    last = np.maximum.accumulate(np.where(match & ~np.isnan(w_end), place, -1))
    last = np.append(-1, last[:-1])
    before = np.where(last >= section_at[section], w_end[last], np.nan)
    before = _or(np.fmin.reduceat(before, run_at), 0.0)[run]
    weight = np.where(inserts, np.maximum(length[true], 1), 0)
    share_at, share = _starts(new_region, match & ~boundary)
    upto = np.cumsum(weight)
    upto = (upto - (upto - weight)[share_at][share]).astype(float)
    whole = np.add.reduceat(weight, share_at)[share].astype(float)
    a = np.where(leading, 0.0, np.where(trailing, core_end, before))
    b = np.where(leading, core_start, np.where(trailing, audio_end[section], _or(pool, before)))
    span = np.fmax(b - a, 0.0)
    free = boundary & ((strategy != "bracket") | (span <= 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        at = lambda s: np.where(free, 0.0, np.where(span > 0, a + s / whole * span, a))
        out_start, out_end = np.where(match, w_start, at(upto - weight)), np.where(match, w_end, at(upto))
    confidence = np.where(match, op, np.where(free, 4, np.where(boundary, 2, 3)))
    kept = (true >= 0) & ~((strategy == "drop") & boundary & inserts)
    out_start, out_end, confidence, true = out_start[kept], out_end[kept], confidence[kept], true[kept]
    if not len(true):
        return true, out_start, out_end, confidence
    # clamped: islands end at words that are not in sync
    free = confidence == 4
    island_at, island = _starts(_changed(owner[kept]), free, np.append(False, free[:-1]))
    most = np.fmax(out_start, out_end)
    most[island_at] = out_end[island_at]
    most = pd.Series(np.where(np.isnan(most), -np.inf, most)).groupby(island).cummax().to_numpy()
    most = np.where(np.isinf(most), np.nan, most)
    earlier = np.append(np.nan, most[:-1])
    earlier[island_at] = np.nan
    return true, np.where(free, out_start, np.fmax(out_start, earlier)), np.where(free, out_end, most), confidence


def words_of_sections(heard: pa.Array, true: pa.Array, sizes: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, strategy: str) -> tuple[np.ndarray, ...]:
    """(section, true word's index among all, start, end, confidence) of all true words of so many sections."""
    coded = pa.concat_arrays([heard, true]).dictionary_encode()
    known: dict[str, int] = {}
    code = np.array([known.setdefault(_bare(w), len(known)) for w in coded.dictionary.to_pylist()], np.int64)
    codes = code[coded.indices.to_numpy()].tolist()
    names, n = list(known), len(heard)
    i_ends, j_ends = (np.cumsum(s).tolist() for s in sizes)
    steps: list[tuple[int, int, int, int]] = []
    counts, i, j = [], 0, 0
    for i_end, j_end in zip(i_ends, j_ends, strict=True):
        before = len(steps)
        _script(codes[i:i_end], codes[n + j : n + j_end], names, i, j, steps)
        counts.append(len(steps) - before)
        i, j = i_end, j_end
    op, left, right, size = np.array(steps, np.int64).reshape(-1, 4).T
    owner = np.repeat(np.repeat(np.arange(len(counts)), counts), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    op, left, right = (np.repeat(x, size) for x in (op, left, right))
    left, right = np.where(left >= 0, left + within, -1), np.where(right >= 0, right + within, -1)
    audio_end = np.full(len(counts), np.nan)
    if n:
        audio_end[sizes[0] > 0] = np.fmax.reduceat(end, (np.cumsum(sizes[0]) - sizes[0])[sizes[0] > 0])
    if not len(op) or not len(true):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2 + (np.zeros(0, np.int64),)
    length = pc.utf8_length(true).to_numpy(zero_copy_only=False)
    word, begin, till, confidence = _timed(op, left, right, owner, start, end, audio_end, length, strategy)
    return np.repeat(np.arange(len(counts)), sizes[1])[word], word, begin, till, confidence


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int]]:
    """Rows of a batch that are aligned at once."""
    sizes = sum(pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy() for k in (at, at + 3))
    first = total = 0
    for k, size in enumerate(sizes.tolist()):
        if total and total + size > WORDS:
            yield first, k - first
            first, total = k, 0
        total += size
    yield first, batch.num_rows - first


def _aligned(batches: Iterator[pa.RecordBatch], at: int, strategy: str) -> Iterator[tuple]:
    """(rows, true words, index of each one's section, its words' places, start, end, confidence) of slices that have any;
    transcript, starts, ends and truth stand from column at on."""
    for batch in batches:
        for first, count in _slices(batch, at) if batch.num_rows else ():
            rows = batch.slice(first, count)
            sizes = tuple(pc.fill_null(pc.list_value_length(rows.column(k)), 0).to_numpy().astype(np.int64) for k in (at, at + 3))
            heard, true = rows.column(at).flatten(), rows.column(at + 3).flatten()
            start, end = (rows.column(k).flatten().to_numpy(zero_copy_only=False).astype(float) for k in (at + 1, at + 2))
            section, word, begin, till, confidence = words_of_sections(heard, true, sizes, start, end, strategy)
            if len(word):
                yield rows, true, section, word, np.cumsum(sizes[1]) - sizes[1], begin, till, confidence


def _fields(sections: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sections.select(*keys).schema)


def transfer_sections(sections: DataFrame, keys: list[str], strategy: str = "bracket") -> DataFrame:
    """alignment.transfer() of sections: keys, transcript (words), starts and ends (their times), truth (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, true, section, word, firsts, begin, till, confidence in _aligned(batches, len(keys), strategy):
            owner = pa.array(section)
            columns = [rows.column(k).take(owner) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(word - firsts[section], pa.int32()), true.take(pa.array(word)), pa.array(begin, from_pandas=True), pa.array(till, from_pandas=True), CONFIDENCE.take(pa.array(confidence))], [*keys, "gt_idx", "text", "start_s", "end_s", "confidence"])

    columns = sections.select(*keys, "transcript", "starts", "ends", "truth")
    return columns.mapInArrow(run, f"{_fields(sections, keys)}, gt_idx int, text string, start_s double, end_s double, confidence string")


def paragraphs_of_sections(sections: DataFrame, keys: list[str], strategy: str = "bracket", words: bool = True) -> DataFrame:
    """alignment.regroup_paragraphs() of transfer_sections(): sections have paras too, each true word's paragraph, in order.

    words: whether paragraphs have their words.
    """
    kind = dict(sections.dtypes)["paras"].removeprefix("array<").removesuffix(">")
    listed = ", words array<struct<gt_idx: int, text: string, start_s: double, end_s: double, confidence: string>>" if words else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, true, section, word, firsts, begin, till, confidence in _aligned(batches, len(keys), strategy):
            paras = rows.column(len(keys) + 4).flatten()
            para = paras.to_numpy(zero_copy_only=False)[word]
            at, group = _starts(_changed(section), _changed(para))
            ends = np.append(at, len(word)).astype(np.int32)
            place = np.arange(len(word))
            synced = confidence != 4
            first, last = np.minimum.reduceat(np.where(synced, place, len(word)), at), np.maximum.reduceat(np.where(synced, place, -1), at)
            bound = lambda times, k, there: pa.array(np.where(there, times[np.where(there, k, 0)], 0.0), from_pandas=True)
            there = last >= 0
            own = true.take(pa.array(word))
            owner = pa.array(section[at])
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), own), " ")
            columns = [*(rows.column(k).take(owner) for k in range(len(keys))), paras.take(pa.array(word[at])), bound(begin, first, there), bound(till, last, there), text]
            names = [*keys, "para_idx", "start_s", "end_s", "text"]
            if words:
                parts = [pa.array(word - firsts[section], pa.int32()), own, pa.array(begin, from_pandas=True), pa.array(till, from_pandas=True), CONFIDENCE.take(pa.array(confidence))]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["gt_idx", "text", "start_s", "end_s", "confidence"])))
                names.append("words")
            yield pa.RecordBatch.from_arrays(columns, names)

    columns = sections.select(*keys, "transcript", "starts", "ends", "truth", "paras")
    return columns.mapInArrow(run, f"{_fields(sections, keys)}, para_idx {kind}, start_s double, end_s double, text string{listed}")
