"""Whole catalogues to packages: one row per book, with its status; a failing book doesn't stop the others."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import aggregates, joins
from quire.operators.scratch import written
from quire.plans import package
from quire.sources import books, daisy


#: Before identifiers that are no URN.
PREFIX = "urn:daisy:"


def section_overlays(tables: dict[str, DataFrame]) -> DataFrame:
    """book_id, section_idx, k, anchor, src, clip_begin, clip_end: the k-th par of a section takes its k-th anchor.

    Pars are numbered before those without audio are dropped; a par's audio is its first source's whole span.
    """
    pars = tables["smil_nodes"].where("kind = 'par'").select("book_id", "section_idx", F.col("ord").alias("par_ord"))
    nav = tables["nav_items"].select("book_id", "ord", F.substring_index("href", "#", 1).alias("src"), F.regexp_extract("href", "#(.*)$", 1).alias("anchor"))
    anchors = nav.join(tables["section_refs"].select("book_id", "src", "section_idx"), ["book_id", "src"]).select("book_id", "section_idx", F.col("ord").alias("a"), "anchor")
    zipped = joins.zip_positions(pars, anchors, ["book_id", "section_idx"], [F.col("par_ord")], [F.col("a")])
    audio = aggregates.collapse_audio(tables["clips"].where("par_ord IS NOT NULL"), ["book_id", "section_idx", "par_ord"], "clip_ord")
    return zipped.join(audio, ["book_id", "section_idx", "par_ord"]).select("book_id", "section_idx", "k", F.coalesce("anchor", F.lit("")).alias("anchor"), "src", "clip_begin", "clip_end")


def _sections_of(book: books.Book) -> list[tuple]:
    return [(book.folder, *s.values()) for s in book.sections()]


def sections(files: DataFrame) -> DataFrame:
    """book_id, section_idx, name, title, body, smil, seconds of every section of the books whose files are given."""
    return books.each_book(files, _sections_of, "book_id string, section_idx int, name string, title string, body string, smil string, seconds double")


def _heard_files(spark: SparkSession, root: str, heard: DataFrame) -> DataFrame:
    """book_id, src and content of every heard source that is a file of its book's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    return heard.select("book_id", "src", F.concat_ws("/", "book_id", "src").alias("path")).join(files, "path").select("book_id", "src", "content")


def convert(spark: SparkSession, root: str, covers: DataFrame | None = None, rights: str | None = None, modified: str | None = None, prefix: str = PREFIX) -> DataFrame:
    """input, status, error, n_sections, seconds, epub (the package's bytes) and missing_audio of every book under root.

    Audio is stored as it is. Sources without a file are in the manifest and in missing_audio. covers: book_id and cover
    (JPEG or PNG bytes). rights: said instead of the books' own. modified: the packages' time, else that of the call.
    prefix: put before identifiers that are no URN. Files are parsed twice: what is heard must be known before its audio
    is read, and a second reading costs less than to keep what was read.
    """
    files = daisy.scan(spark, root)
    return packages(files, _heard_files(spark, root, heard_files(files)), covers, rights, modified, prefix)


def heard_files(files: DataFrame) -> DataFrame:
    """book_id and src of every source that is heard."""
    return books.each_book(files, lambda book: [(book.folder, src) for src in book.heard()], "book_id string, src string")


PACKAGES = "input string, status string, error string, n_sections int, seconds double, epub binary, missing_audio array<string>"
_MEDIA = {"mp3": "audio/mpeg", "m4a": "audio/mp4", "mp4": "audio/mp4", "opus": "audio/ogg", "ogg": "audio/ogg"}


def packages(files: DataFrame, audio: DataFrame, covers: DataFrame | None = None, rights: str | None = None, modified: str | None = None, prefix: str = PREFIX, then: Callable[[tuple], list[tuple]] | None = None, fields: str = PACKAGES) -> DataFrame:
    """convert() of books whose files are rows; audio: book_id, src and content, of which those that are heard are stored.

    Documents are named like their SMIL files, so that navigation and overlays point at what is there; navigation items
    of files that are no section are left out. then: what is made of each row, as rows of fields, in the task that has it,
    so that packages that are only looked at go no further.
    """
    modified = modified or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def one(book: books.Book) -> list[tuple]:
        if book.root is None:
            return []
        data, error, parts, missing, seconds = None, None, [], [], 0.0
        try:  # a book's failure is its row's error
            meta, error, parts = book.meta, book.error, book.sections()
            seconds = float(sum(p["seconds"] for p in parts))
            heard = book.heard()
            missing = [src for src in heard if book.audio.get(src) is None]
            named = meta.get("dc:identifier")
            urn = None if named is None else prefix + named
            identifier = named if named is not None and named.startswith("urn:") else urn if urn is not None else "urn:book:" + hashlib.sha1(book.folder.encode()).hexdigest()
            title, lang = meta.get("dc:title") or "Untitled", meta.get("dc:language") or "en"
            error = error or "; ".join(package.faults(identifier, title, lang, len(parts))) or None
            if not error:
                about = {"identifier": identifier, "title": title, "language": lang, "modified": modified, "seconds": book.seconds(), "access_modes": ("auditory", "textual") if meta.get("ncc:multimediatype") == "audioFullText" else ("auditory",)}
                about |= {"creator": meta.get("dc:creator"), "publisher": meta.get("dc:publisher"), "date": meta.get("dc:date"), "source": urn, "rights": rights if rights is not None else book.rights, "narrator": meta.get("ncc:narrator")}
                own = [p | {"xhtml": package.content(p["title"], p["body"], lang)} for p in parts]
                sounds = [{"href": f"audio/{src}", "media_type": _MEDIA.get(src.rpartition(".")[2].lower() if "." in src else "", "application/octet-stream"), "content": book.audio.get(src)} for src in heard]
                data = package.epub(about, own, book.headings(), book.pages(), sounds, book.cover)
        except Exception as e:
            data, error = None, f"{type(e).__name__}: {e}"
        row = (book.folder, "error" if error else "ok", error, len(parts), seconds, data, missing)
        return [row] if then is None else then(row)

    return books.each_book(files, one, fields, audio, covers)


def summary_lines(entries: DataFrame) -> DataFrame:
    """input and json: a row an entry, and one of the totals (without input), so that no row grows with the batch."""
    entries = written(entries.select("input", "status", "error"), "entries")  # read twice, and packages are made for it
    ok = F.col("status") == "ok"
    totals = entries.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
    lines = entries.select("input", F.to_json(F.struct("input", "status", "error")).alias("json"))
    return lines.unionByName(totals.select(F.lit("").alias("input"), F.to_json(F.struct("total", "ok", "failed")).alias("json")))


def summary(entries: DataFrame) -> DataFrame:
    """The batch's totals and entries as JSON, a row."""
    listed = F.sort_array(F.collect_list(F.struct("input", "status", "error", "seconds")))
    ok = F.col("status") == "ok"
    totals = entries.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), listed.alias("entries"))
    return totals.select(F.to_json(F.struct("total", "ok", "failed", "entries")).alias("json"))
