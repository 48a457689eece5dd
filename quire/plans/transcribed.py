"""Sections with their spoken text: paragraphs from the true text or the transcript, and overlays word by word.

A section with a true text and spoken words is aligned; one with a transcript alone has its segments merged into
paragraphs; others stay as they are. A section whose words have no length keeps the overlay that it had. A section is a
row with all that belongs to it, so that its words are dealt out once, as a list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import aligned, alignment, sequences
from quire.plans import package
from quire.sources.books import BLANKS, BYTES, escape_attr, escape_text, smil_clock

KEYS = ["book_id", "section_idx"]
_SPACE = re.compile(f"[{BLANKS}]+")
#: A paragraph: its text, its audio file, and its words as (text, start, end).
Paragraph = tuple[str, str | None, list[tuple[str, float, float]]]


def true_words(text: str) -> list[tuple[int, str]]:
    """Paragraph and text of each word, as alignment.truth_words() has them."""
    out: list[tuple[int, str]] = []
    blocks = [p for p in text.replace("\r\n", "\n").split("\n\n") if p.strip(BLANKS)]
    for k, block in enumerate(blocks):
        for word in filter(None, _SPACE.split(block)):
            if not out or alignment._bare(word):
                out.append((k, word))
            else:
                out[-1] = (out[-1][0], out[-1][1] + word)
    return out


def merged_paragraphs(segments: list[dict], words: list[dict]) -> list[Paragraph]:
    """A section's paragraphs by its transcript alone; words go where their segments go."""
    said = [s for s in segments if (s["text"] or "").strip(BLANKS)]
    of: dict[int, list[tuple[str, float, float]]] = {}
    for w in words:
        of.setdefault(w["seg_ord"], []).append((w["text"], w["start_s"], w["end_s"]))
    out, at = [], 0
    for _, _, text, audio, count in sequences.paragraphs((s["start_s"], s["end_s"], s["text"], s["audio_src"]) for s in said):
        own = [w for s in said[at : at + count] for w in of.get(s["seg_ord"], ())]
        at += count
        out.append((text, audio, own))
    return out


def aligned_paragraphs(sections: list[tuple[list[dict], list[dict], list[tuple[int, str]]]], strategy: str) -> list[list[Paragraph]]:
    """The paragraphs of sections with segments, spoken words and true words: the true words with the times of those heard."""
    sizes = tuple(np.array([len(s[k]) for s in sections], np.int64) for k in (1, 2))
    flat = lambda name, kind: pa.array([w[name] for s in sections for w in s[1]], kind)
    times = [flat(name, pa.float64()).to_numpy(zero_copy_only=False) for name in ("start_s", "end_s")]
    true = [w for s in sections for w in s[2]]
    found = aligned.words_of_sections(flat("text", pa.string()), pa.array([t for _, t in true], pa.string()), sizes, *times, strategy)
    out: list[list[Paragraph]] = [[] for _ in sections]
    audio = [s[0][0]["audio_src"] if s[0] else None for s in sections]
    last = None
    for section, word, begin, end in zip(*(x.tolist() for x in found[:4]), strict=True):
        para, text = true[word]
        if (section, para) != last:
            out[section].append(("", audio[section], []))
            last = section, para
        out[section][-1][2].append((text, begin, end))
    return out


def section_xhtml(number: int, paragraphs: list[Paragraph]) -> str:
    """Paragraphs in order, a span for each word where words are known."""
    parts = []
    for p, (text, _, words) in enumerate(paragraphs, 1):
        inner = " ".join(f'<span id="w-{number:03d}-{p:03d}-{w:03d}">{escape_text(word)}</span>' for w, (word, _, _) in enumerate(words, 1)) if words else escape_text(text)
        parts.append(f'<p id="tx-{number:03d}-{p:03d}">{inner}</p>')
    return "".join(parts)


def _milliseconds(seconds: float) -> int:
    return int(np.floor(seconds * 1000 + 0.5))


def section_overlay(number: int, name: str, paragraphs: list[Paragraph]) -> tuple[str | None, float]:
    """An overlay by words and its seconds; none if no word has a length of whole milliseconds and an audio file."""
    groups, seconds = [], 0.0
    document = f"../content/{escape_attr(name)}.xhtml"
    for p, (_, audio, words) in enumerate(paragraphs, 1):
        source = None if audio is None else "../audio/" + escape_attr(audio.rpartition("/")[2])
        pars = []
        for w, (_, begin, end) in enumerate(words, 1):
            if source is None or begin is None or end is None or _milliseconds(end) <= _milliseconds(begin):
                continue
            ident = f"w-{number:03d}-{p:03d}-{w:03d}"
            pars.append(f'<par id="{ident}"><text src="{document}#{ident}"/><audio src="{source}" clipBegin="{smil_clock(begin)}" clipEnd="{smil_clock(end)}"/></par>')
            seconds += end - begin
        if pars:
            groups.append(f"<seq>{''.join(pars)}</seq>")
    return (package.SMIL_HEAD + "".join(groups) + package.SMIL_END, seconds) if groups else (None, 0.0)


def with_transcripts(parts: DataFrame, segments: DataFrame, words: DataFrame, truths: DataFrame, strategy: str = "bracket") -> DataFrame:
    """convert.sections() with the spoken paragraphs behind each body, and overlays by words where any word has a length.

    segments: KEYS, seg_ord, start_s, end_s, text, audio_src; words: KEYS, seg_ord, word_ord, start_s, end_s, text;
    truths: KEYS and text, a row a section.
    """
    listed = lambda rows, name, *columns: rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    heard = listed(words, "words", "seg_ord", "word_ord", "text", "start_s", "end_s")
    said = listed(segments, "segments", "seg_ord", "start_s", "end_s", "text", "audio_src")
    rows = parts.select(*KEYS, "name", "title", "body", "smil", "seconds")
    for part in (said, heard, truths.select(*KEYS, F.col("text").alias("truth"))):
        rows = rows.join(part, KEYS, "left")
    out_names = [*KEYS, "name", "title", "body", "smil", "seconds"]

    def spoken(batch: pa.RecordBatch, pending: list[tuple[int, tuple]], paragraphs: list[list[Paragraph]]) -> None:
        for (k, _), found in zip(pending, aligned_paragraphs([s for _, s in pending], strategy), strict=True):
            paragraphs[k] = found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                column = {n: batch.column(n).to_pylist() for n in ("section_idx", "name", "body", "smil", "seconds", "segments", "words", "truth")}
                paragraphs: list[list[Paragraph]] = [[] for _ in range(batch.num_rows)]
                pending: list[tuple[int, tuple]] = []
                size = 0
                for k, (segs, own, truth) in enumerate(zip(column["segments"], column["words"], column["truth"], strict=True)):
                    if own and truth and truth.strip(BLANKS):
                        pending.append((k, (segs or [], own, true_words(truth))))
                        size += len(own) + len(pending[-1][1][2])
                        if size > aligned.WORDS:
                            spoken(batch, pending, paragraphs)
                            pending, size = [], 0
                    elif segs:
                        paragraphs[k] = merged_paragraphs(segs, own or [])
                if pending:
                    spoken(batch, pending, paragraphs)
                for k, found in enumerate(paragraphs):
                    if found:
                        number = column["section_idx"][k]
                        column["body"][k] += section_xhtml(number, found)
                        smil, seconds = section_overlay(number, column["name"][k], found)
                        if smil is not None:
                            column["smil"][k], column["seconds"][k] = smil, seconds
                sizes = np.cumsum([len(b) + len(s or "") for b, s in zip(column["body"], column["smil"], strict=True)])
                made = pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*KEYS, "name", "title")), pa.array(column["body"], pa.string()), pa.array(column["smil"], pa.string()), pa.array(column["seconds"], pa.float64())], out_names)
                at = 0
                while at < made.num_rows:  # rows of many megabytes are given out one by one
                    till = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES)))
                    yield made.slice(at, till - at)
                    at = till

    return rows.mapInArrow(run, "book_id string, section_idx int, name string, title string, body string, smil string, seconds double")
