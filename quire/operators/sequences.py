"""Ordered scans: windows where a scan's state depends on its input alone, streaming kernels where it resets itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import ABBREVIATIONS, ATTACHING, CLOSERS, TERMINATORS

#: Matches in a row that make an anchor.
ANCHOR = 5
ENDS = frozenset(TERMINATORS)


def _with_anchors(rows: DataFrame, keys: list[str], order: list[str], match: Column) -> DataFrame:
    """rows with idx (from 0), lead_end and trail_start: where the key's first anchor starts and its last one ends.

    Windows over the keys alone, so rows are dealt once and never joined back; both bounds are null without an anchor.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumns({"_m": match, "idx": F.row_number().over(w) - 1})
    marked = marked.withColumn("_g", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.count_if(F.col("_m")).over(Window.partitionBy(*keys, "_g"))
    marked = marked.withColumn("_a", F.col("_m") & (run >= ANCHOR))
    whole = Window.partitionBy(*keys)
    inside = F.when(F.col("_a"), F.col("idx"))
    return marked.withColumns({"lead_end": F.min(inside).over(whole), "trail_start": F.max(inside).over(whole) + 1}).drop("_m", "_g", "_a")


def classify_regions(rows: DataFrame, keys: list[str], order: list[str], match: Column) -> DataFrame:
    """rows with their index and region; without a usable pair of anchors all is core."""
    placed = _with_anchors(rows, keys, order, match)
    usable = F.coalesce(F.col("lead_end") < F.col("trail_start"), F.lit(False))
    region = F.when(usable & (F.col("idx") < F.col("lead_end")), "leading").when(usable & (F.col("idx") >= F.col("trail_start")), "trailing").otherwise("core")
    return placed.withColumn("region", region).drop("lead_end", "trail_start")


def monotonic_clamp(rows: DataFrame, keys: list[str], order: list[str], start: str, end: str, unsynced: Column) -> DataFrame:
    """Starts no earlier than the end before, ends no earlier than their starts; islands end at unsynced rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_u", unsynced)
    marked = marked.withColumn("_g", F.sum(F.col("_u").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_g", "_u").orderBy(*order)
    first = F.row_number().over(inside) == 1
    marked = marked.withColumn("_e", F.when(first, F.col(end)).otherwise(F.greatest(start, end)))
    before = F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    upto = F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    clamped = marked.withColumn("new_start", F.when(F.col("_u"), F.col(start)).otherwise(F.greatest(F.col(start), before)))
    return clamped.withColumn("new_end", F.when(F.col("_u"), F.col(end)).otherwise(upto)).drop("_u", "_g", "_e")


def proportional_spread(rows: DataFrame, keys: list[str], order: str, text: str, start: Column, span: Column) -> DataFrame:
    """start_s and end_s of each row: the span shared out by the characters of its text, one at least."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.greatest(F.length(text), F.lit(1)).cast("long"))
    rows = rows.withColumns({"_sum": F.sum("_c").over(upto), "_all": F.sum("_c").over(w)})
    at = lambda c: start + c.cast("double") / F.col("_all") * span
    return rows.withColumns({"start_s": at(F.col("_sum") - F.col("_c")), "end_s": at(F.col("_sum"))}).drop("_c", "_sum", "_all")


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_ord, line of every line; a final line break adds none."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\n$", "")
    return docs.select(key, F.posexplode(F.split(body, "\n")).alias("line_ord", "line"))


def line_offsets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """text_lines with the byte offsets of each line's start and end, the line break counted."""
    w = Window.partitionBy(key).orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("line").cast("long") + 1
    lines = text_lines(docs, key, text).withColumn("line_end", F.sum(size).over(w))
    return lines.withColumn("line_start", F.col("line_end") - size)


def candidate_heading(line: Column, markdown: Column) -> Column:
    """The heading that a line may be: a # line's text in markdown, else any non-blank line of 120 bytes at most."""
    bare = F.regexp_replace(line, "(?U)^\\s+|\\s+$", "")
    marked = F.when(bare.startswith("#"), F.regexp_replace(bare, "(?U)^#+\\s*", ""))
    return F.nullif(F.when(markdown, marked).otherwise(F.when(F.octet_length(bare) <= 120, bare)), F.lit(""))


def sentence_ends(text: str) -> bool:
    """The scalar form of functions.text.ends_sentence, for the kernels below."""
    core = text.rstrip(CLOSERS)
    if not core or core[-1] not in TERMINATORS:
        return False
    if core[-1] != ".":
        return True
    body = core[:-1]
    if body and body[-1] in "0123456789":
        return False
    i = len(body)
    while i and (body[i - 1].isalpha() or body[i - 1] == "."):
        i -= 1
    return not body[i:].lower().endswith(tuple(ABBREVIATIONS))


def _capital(text: str) -> str:
    return text[0].upper() + text[1:] if text[:1].islower() else text


def paragraphs(segments, min_sentences: int = 3, max_sentences: int = 6, min_bytes: int = 300, max_bytes: int = 600) -> Iterator[tuple]:
    """Merges one section's (start, end, text, audio) in order into (start, end, text, audio, segments)."""
    text, size, sentences, start, end, audio, count = "", 0, 0, 0.0, 0.0, None, 0
    for s, e, t, a in segments:
        t = (t or "").strip()
        if not t:
            continue
        if text and a != audio:
            yield start, end, _capital(text), audio, count
            text, size, sentences, count = "", 0, 0, 0
        if not text:
            start, audio = s, a
        text = f"{text} {t}" if text else t
        size = len(text.encode())
        end, count = e, count + 1
        done = sentence_ends(text)
        sentences += done
        if (done and sentences >= min_sentences and size >= min_bytes) or sentences >= max_sentences or size >= max_bytes:
            yield start, end, _capital(text), audio, count
            text, size, sentences, count = "", 0, 0, 0
    if text:
        yield start, end, _capital(text), audio, count


def merge_paragraphs(segments: DataFrame, section: str, order: str) -> DataFrame:
    """section, para_ord, start_s, end_s, text, audio_src, segments.

    Rows stream through sorted by section and order: a task holds the open paragraph, never a section.
    """
    kind = dict(segments.dtypes)[section]
    columns = [section, "para_ord", "start_s", "end_s", "text", "audio_src", "segments"]

    def rows_of(frames):
        for frame in frames:
            yield from zip(frame[section], frame["start_s"], frame["end_s"], frame["text"], frame["audio_src"], strict=True)

    def run(frames):
        from itertools import groupby

        out = []
        for key, group in groupby(rows_of(frames), key=lambda r: r[0]):
            for k, p in enumerate(paragraphs(r[1:] for r in group)):
                out.append((key, k, *p))
                if len(out) == 2000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    sorted_rows = segments.select(section, order, "start_s", "end_s", "text", "audio_src").repartition(section).sortWithinPartitions(section, order)
    return sorted_rows.mapInPandas(run, f"`{section}` {kind}, para_ord int, start_s double, end_s double, text string, audio_src string, segments int")


def coalesce_tokens(tokens, low: int, high: int) -> list[tuple[float, float, str]]:
    """Words (start, end, text) of one segment's (text, t0, t1) in centiseconds, held within the segment's bounds."""
    words: list[list] = []
    for text, t0, t1 in tokens:
        if not text or text[0] in "[<":
            continue
        bare = text.lstrip(" ")
        if not bare:
            continue
        attached = not bare.strip(ATTACHING)
        fresh = not words or (not attached and (text[0] == " " or (bare[0].isalpha() and words[-1][2].rstrip(CLOSERS)[-1:] in ENDS)))
        if fresh:
            words.append([t0, t1, bare])
        else:
            words[-1][1] = max(words[-1][1], t1)
            words[-1][2] += bare
    lo, hi, out = low / 100, high / 100, []
    for t0, t1, text in words:
        start, end = max(t0 / 100, lo), min(t1 / 100, hi)
        if end <= start:
            end = min(start + 0.05, hi)
        out.append((start, end, text))
    return out


def lists_of(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column, null ones empty."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    start = 0
    for end in ends.tolist():
        yield values[start:end].tolist()
        start = end


def words_of_tokens(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word_ord, start_s, end_s, text: segments have tokens (array of text, t0_cs, t1_cs), t0_cs and t1_cs."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.select(*keys).schema)
    tokens = lambda c: F.transform("tokens", lambda t: t[c]).alias(c)

    def given(batch: pa.RecordBatch, rows: list[int], sizes: list[int], words: list[tuple]) -> pa.RecordBatch:
        owner = pa.array(np.repeat(np.array(rows, np.int64), sizes))
        order = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start, end, text = zip(*words, strict=True)
        columns = [batch.column(k).take(owner) for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(order, pa.int32()), pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.array(text, pa.string())], [*keys, "word_ord", "start_s", "end_s", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            sizes: list[int] = []
            words: list[tuple] = []
            low, high = (batch.column(len(keys) + k).to_pylist() for k in (3, 4))
            parts = [lists_of(batch.column(len(keys) + k)) for k in range(3)]
            for k in range(batch.num_rows):
                own = coalesce_tokens(zip(*(next(c) for c in parts), strict=True), low[k], high[k])
                if own:
                    rows.append(k)
                    sizes.append(len(own))
                    words += own
                if len(words) > 50_000:
                    yield given(batch, rows, sizes, words)
                    rows, sizes, words = [], [], []
            if words:
                yield given(batch, rows, sizes, words)

    flat = segments.select(*keys, tokens("text"), tokens("t0_cs"), tokens("t1_cs"), F.col("t0_cs").alias("_low"), F.col("t1_cs").alias("_high"))
    return flat.mapInArrow(run, f"{fields}, word_ord int, start_s double, end_s double, text string")
