"""Whole books in one pass: the same as the tables say, and nothing is dealt out but files."""

import io
import os
import zipfile

from pyspark.sql import functions as F

from quire.functions import clock
from quire.plans import catalogue, convert, package, shelf
from quire.sources import books, daisy

BOOKS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "books")
CLOCKS = ["npt=1.5s", "1", " 2 ", "0:01:02.5", "1:02", "1:2:3:4", "5ms", "2min", "1.5h", "x", "", "-3", "-1:30", "npt=", ".5", "5.", "1:x", None, "npt=7", " 8 ", "3m", "1e3", "3 s"]


def test_clocks_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CLOCKS)], "i int, c string").select("i", clock.parse_clock_value(F.col("c")).alias("v")).orderBy("i").collect()
    assert [books.clock_value(c) for c in CLOCKS] == [r["v"] for r in rows]
    times = [0.0, 0.0004, 0.0005, 1.0005, 59.9996, 3599.5, 3600.25, 86399.999, 4e6, -1.0, 2.0015]
    shown = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t double").select("i", clock.format_smil_clock(F.col("t")).alias("v")).orderBy("i").collect()
    assert [books.smil_clock(t) for t in times] == [r["v"] for r in shown]


def test_overlays_are_those_of_the_tables(spark, sf_dir):
    pars = convert.section_overlays(shelf._tables(spark, sf_dir)).collect()
    found = {(r["book_id"], r["section_idx"]): r for r in convert.sections(shelf._files(spark, sf_dir)).collect()}
    assert sum((r["smil"] or "").count("<par ") for r in found.values()) == len(pars) > 100
    for p in pars:
        own = found[p["book_id"], p["section_idx"]]
        target = f"{own['name']}.xhtml" + (f"#{p['anchor']}" if p["anchor"] else "")
        assert f'<par id="p-{p["section_idx"]:03d}-{p["k"]:03d}"><text src="../content/{target}"/><audio src="../audio/{p["src"]}" clipBegin="{books.smil_clock(p["clip_begin"])}" clipEnd="{books.smil_clock(p["clip_end"])}"/></par>' in own["smil"]


def test_books_are_dealt_out_once(spark, sf_dir):
    plan = convert.packages(daisy.scan(spark, BOOKS), spark.createDataFrame([], "book_id string, src string, content binary"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert "Join" not in convert.sections(daisy.scan(spark, BOOKS))._jdf.queryExecution().executedPlan().toString()


def test_unheard_audio_is_left_out(spark):
    files = daisy.scan(spark, BOOKS)
    folder = files.where("dir LIKE '%harbour'").first()["dir"]
    audio = spark.createDataFrame([(folder, "a.mp3", bytearray(b"a")), (folder, "other.mp3", bytearray(b"o"))], "book_id string, src string, content binary")
    row = next(r for r in convert.packages(files, audio).collect() if r["input"] == folder)
    names = zipfile.ZipFile(io.BytesIO(bytes(row["epub"]))).namelist()
    assert "OEBPS/audio/a.mp3" in names and not any("other" in n for n in names) and row["missing_audio"] == ["b.mp3"]
    sizes = convert.packages(files, audio, then=lambda r: [(r[0], len(r[5]))] if r[5] else [], fields="input string, bytes int").collect()
    assert [(r["input"], r["bytes"]) for r in sizes] == [(folder, len(row["epub"]))]


def test_archives_are_read_by_others(monkeypatch):
    entries = [("mimetype", b"application/epub+zip", True), ("é.txt", b"", False), ("a/b.txt", os.urandom(5000) + b"x" * 70000, False), ("c", b"short" * 100, False), ("d", b"stored", True)]
    for many in (50_000, 1):
        monkeypatch.setattr(package, "MANY", many)
        with zipfile.ZipFile(io.BytesIO(package.archive(entries))) as z:
            assert z.testzip() is None and [(n, z.read(n), z.getinfo(n).compress_type == zipfile.ZIP_STORED) for n in z.namelist()] == entries


def test_a_batch_makes_its_packages_once(spark, sf_dir):
    plan = catalogue.QUERIES["batch_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
