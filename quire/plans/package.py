"""Rendering and assembling publication packages."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import clock, text
from quire.operators.tree import nested_list

_XML = '<?xml version="1.0" encoding="utf-8"?>\n'
SMIL_HEAD, SMIL_END = _XML + '<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body>', "</body></smil>"
CONTAINER = _XML + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def numbered(prefix: str, *numbers: Column) -> Column:
    """An id of a prefix and numbers of three digits at least: w-001-002-003."""
    pad = lambda n: F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return F.concat_ws("-", F.lit(prefix), *[pad(n) for n in numbers])


def violations(identifier: Column, title: Column, lang: Column, sections: Column) -> Column:
    """What forbids a package: an array, empty if nothing does."""
    blank = lambda c, name: F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"{name} is empty")
    return F.array_compact(F.array(blank(identifier, "identifier"), blank(title, "title"), blank(lang, "language"), F.when(F.coalesce(sections, F.lit(0)) < 1, "no sections")))


def faults(identifier: str, title: str, lang: str, sections: int) -> list[str]:
    """violations() for kernels."""
    found = [f"{name} is empty" for name, value in (("identifier", identifier), ("title", title), ("language", lang)) if not value.strip(" ")]
    return found + ["no sections"] * (sections < 1)


def render_paragraphs(paragraphs: DataFrame, section: str) -> DataFrame:
    """section, para_ord, id and xhtml of a paragraph each; the text of a section is their join in order."""
    ident = numbered("tx", F.col(section), F.col("para_ord") + 1)
    body = F.concat(F.lit('<p id="'), ident, F.lit('">'), text.escape_text(F.col("text")), F.lit("</p>"))
    return paragraphs.select(section, "para_ord", ident.alias("id"), body.alias("xhtml"))


def overlay_pars(words: DataFrame, section: str, audio: str | Column, document: Column | None = None, ident: Column | None = None) -> DataFrame:
    """A par per word whose clip has a length of whole milliseconds; a paragraph that keeps no word has no wrapper.

    document: the content document that the words are in, and ident: their ids; by the section's number if not given.
    """
    ms = lambda c: F.round(F.col(c) * 1000)
    kept = words.where(ms("end_s") > ms("start_s"))
    ident = numbered("w", F.col(section), F.col("para_ord") + 1, F.col("word_ord") + 1) if ident is None else ident
    source = F.lit(audio) if isinstance(audio, str) else audio
    document = numbered("section", F.col(section)) if document is None else document
    return kept.select(section, "para_ord", "word_ord", ident.alias("par_id"), F.concat(F.lit("content/"), document, F.lit(".xhtml#"), ident).alias("text_src"), source.alias("audio_src"), clock.format_smil_clock(F.col("start_s")).alias("clip_begin"), clock.format_smil_clock(F.col("end_s")).alias("clip_end"))


def overlay_smil(pars: DataFrame, section: str) -> DataFrame:
    """section and smil: a seq per paragraph with its pars in order. Sections are files, so a file's pars bound a row."""
    par = F.concat(F.lit('<par id="'), F.col("par_id"), F.lit('"><text src="../'), F.col("text_src"), F.lit('"/><audio src="../'), F.col("audio_src"), F.lit('" clipBegin="'), F.col("clip_begin"), F.lit('" clipEnd="'), F.col("clip_end"), F.lit('"/></par>'))
    ordered = lambda order, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")
    inner = pars.withColumn("_x", par).groupBy(section, "para_ord").agg(ordered("word_ord", "_x").alias("_p"))
    inner = inner.withColumn("_p", F.concat(F.lit("<seq>"), "_p", F.lit("</seq>")))
    return inner.groupBy(section).agg(F.concat(F.lit(SMIL_HEAD), ordered("para_ord", "_p"), F.lit(SMIL_END)).alias("smil"))


def content_xhtml(title: str, body: str, lang: str) -> Column:
    """A content document; the body is trimmed on its right."""
    return F.concat(F.lit(_XML + '<html xmlns="http://www.w3.org/1999/xhtml" lang="'), F.col(lang), F.lit('"><head><title>'), text.escape_text(F.col(title)), F.lit("</title></head><body>"), F.rtrim(F.col(body)), F.lit("</body></html>"))


def content(title: str, body: str, lang: str) -> str:
    """content_xhtml() for kernels."""
    esc = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f'{_XML}<html xmlns="http://www.w3.org/1999/xhtml" lang="{lang}"><head><title>{esc}</title></head><body>{body.rstrip(" ")}</body></html>'


ACCESS = '<meta property="schema:accessibilityFeature">tableOfContents</meta><meta property="schema:accessibilityFeature">synchronizedAudioText</meta><meta property="schema:accessibilityHazard">none</meta><meta property="schema:accessibilitySummary">This audiobook is structured for accessible reading with synchronised audio and navigable headings.</meta>'


def cover_kind(cover: bytes) -> tuple[str, str]:
    """(media type, href) of a cover, by its first bytes."""
    if cover[:3] == b"\xff\xd8\xff":
        return "image/jpeg", "images/cover.jpg"
    if cover[:8] == b"\x89PNG\r\n\x1a\n":
        return "image/png", "images/cover.png"
    raise ValueError("the cover is neither JPEG nor PNG")


def document_name(section: dict, number: int) -> str:
    """The name of a section's documents in the package, without extension."""
    return section.get("name") or f"section-{number:03d}"


def opf(book: dict, sections: list[dict], audio: list[dict], cover: bytes | None = None) -> str:
    """The package document: metadata, manifest and spine in order, with durations where there are overlays.

    book has identifier, title and language, and where known modified, creator, publisher, date, source, rights,
    narrator, seconds (of all audio) and access_modes.
    """
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    meta = [f'<dc:identifier id="pub-id">{esc(book["identifier"])}</dc:identifier>', f'<dc:title>{esc(book["title"])}</dc:title>', f'<dc:language>{esc(book["language"])}</dc:language>']
    if book.get("modified"):
        meta.append(f'<meta property="dcterms:modified">{esc(book["modified"])}</meta>')
    meta += [f"<dc:{n}>{esc(book[n])}</dc:{n}>" for n in ("creator", "publisher", "date", "source", "rights") if book.get(n) is not None]
    if book.get("narrator") is not None:
        meta.append(f'<meta property="media:narrator">{esc(book["narrator"])}</meta>')
    items = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>']
    if cover:
        kind, href = cover_kind(cover)
        items.append(f'<item id="cover-image" href="{href}" media-type="{kind}" properties="cover-image"/>')
    spine, total = [], 0.0
    for k, s in enumerate(sections, 1):
        over = f' media-overlay="mo-{k:03d}"' if s.get("smil") else ""
        items.append(f'<item id="s-{k:03d}" href="content/{esc(document_name(s, k))}.xhtml" media-type="application/xhtml+xml"{over}/>')
        if s.get("smil"):
            items.append(f'<item id="mo-{k:03d}" href="overlays/{esc(document_name(s, k))}.smil" media-type="application/smil+xml"/>')
            meta.append(f'<meta property="media:duration" refines="#mo-{k:03d}">{s["seconds"]:.3f}s</meta>')
            total += s["seconds"]
        spine.append(f'<itemref idref="s-{k:03d}"/>')
    total = total if book.get("seconds") is None else book["seconds"]
    if total > 0:
        meta.append(f'<meta property="media:duration">{total:.3f}s</meta>')
    meta.append(ACCESS)
    meta += [f'<meta property="schema:accessMode">{m}</meta>' for m in book.get("access_modes") or ("auditory",)]
    items += [f'<item id="audio-{k:03d}" href="{esc(a["href"])}" media-type="{a["media_type"]}"/>' for k, a in enumerate(audio, 1)]
    return _XML + '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="pub-id" prefix="schema: http://schema.org/"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">' + "".join(meta) + "</metadata><manifest>" + "".join(items) + "</manifest><spine>" + "".join(spine) + "</spine></package>"


def nav_xhtml(headings: list[tuple[int, str, str]], pages: list[tuple[str, str]]) -> str:
    listed = "".join(f'<li><a href="{h}">{p}</a></li>' for p, h in pages)
    page_list = f'<nav epub:type="page-list"><ol>{listed}</ol></nav>' if pages else ""
    return _XML + f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc">{nested_list(headings)}</nav>{page_list}</body></html>'


def epub(book: dict, sections: list[dict], headings, pages, audio: list[dict], cover: bytes | None = None) -> bytes:
    """One package: the mimetype first and stored, documents deflated, audio and cover stored."""
    entries = [("mimetype", b"application/epub+zip", True), ("META-INF/container.xml", CONTAINER, False), ("OEBPS/package.opf", opf(book, sections, audio, cover), False), ("OEBPS/nav.xhtml", nav_xhtml(headings, pages), False)]
    entries += [(f"OEBPS/content/{document_name(s, k)}.xhtml", s["xhtml"], False) for k, s in enumerate(sections, 1)]
    entries += [(f"OEBPS/overlays/{document_name(s, k)}.smil", s["smil"], False) for k, s in enumerate(sections, 1) if s.get("smil")]
    entries += [(f"OEBPS/{a['href']}", a["content"], True) for a in audio if a.get("content") is not None]
    if cover:
        entries.append((f"OEBPS/{cover_kind(cover)[1]}", cover, True))
    return archive([(name, data.encode() if isinstance(data, str) else data, stored) for name, data, stored in entries])


#: Bytes and entries from which zipfile writes an archive, which then may need larger fields.
LARGE, MANY = 1 << 30, 50_000


def archive(entries: list[tuple[str, bytes, bool]]) -> bytes:
    """A ZIP archive of (name, content, whether stored) in order; others are deflated. Books have many small documents,
    for which zipfile and deflate's large windows cost more than the work itself."""
    if len(entries) > MANY or sum(len(data) for _, data, _ in entries) > LARGE:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data, stored in entries:
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
        return out.getvalue()
    parts: list[bytes] = []
    listed: list[bytes] = []
    at = 0
    for name, data, stored in entries:
        body = data
        if not stored:
            small = len(data) <= 4096
            packer = zlib.compressobj(6, zlib.DEFLATED, -12 if small else -15, 5 if small else 8)
            body = packer.compress(data) + packer.flush()
        label = name.encode()
        # version, flags (names in UTF-8), method, 1980-01-01, digest, sizes, length of the name, no extra fields
        fields = struct.pack("<HHHHHIIIHH", 20, 0 if name.isascii() else 0x800, 0 if stored else 8, 0, 33, zlib.crc32(data), len(body), len(data), len(label), 0)
        parts += (b"PK\3\4", fields, label, body)
        listed += (b"PK\1\2\x14\3", fields, struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at), label)
        at += 30 + len(label) + len(body)
    catalogue = b"".join(listed)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, len(entries), len(entries), len(catalogue), at, 0)
    return b"".join((*parts, catalogue, end))


def report_json(summary: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """key and json: a report's counters and its issues in order of severity, backend and message."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("fatal", "error", "warning", "info", "usage")]), F.col("severity"))
    listed = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "backend", "message", "severity", "issue_id", "location")))
    shown = F.transform(listed, lambda x: F.struct(x["severity"].alias("severity"), x["backend"].alias("backend"), x["issue_id"].alias("id"), x["message"].alias("message"), x["location"].alias("location")))
    rows = issues.groupBy(key).agg(shown.alias("issues"))
    counters = [F.col(c) for c in summary.columns if c != key]
    return summary.join(rows, key, "left").select(key, F.to_json(F.struct(*counters, F.coalesce("issues", F.array()).alias("issues"))).alias("json"))


def report_text() -> Column:
    """A line per issue: SEVERITY id message (location)."""
    place = F.when(F.col("location").isNotNull(), F.concat(F.lit(" ("), "location", F.lit(")"))).otherwise("")
    return F.concat(F.upper("severity"), F.lit(" "), F.coalesce("issue_id", F.lit("-")), F.lit(" "), "message", place)
