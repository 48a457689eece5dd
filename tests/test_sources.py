"""Ingestion and packaging of our own small books."""

import io
import os
import zipfile

import pytest

from quire.plans import convert
from quire.sources import daisy, texts

BOOKS = os.path.join(os.path.dirname(__file__), "fixtures", "books")


@pytest.fixture(scope="module")
def tables(spark):
    return daisy.load(spark, BOOKS)


def _book(rows, name):
    return next(r for r in rows if r["book_id"].endswith(name))


def test_books(tables):
    rows = tables["books"].collect()
    good, bad = _book(rows, "harbour"), _book(rows, "broken")
    assert (good["title"], good["language"], good["toc_items"], good["page_normal"], good["error"]) == ("The Harbour", "en", 4, None, None)
    assert good["other"] == {"ncc:generator": "by hand"}
    assert bad["error"] == "master.smil is missing"


def test_navigation(tables):
    rows = sorted(r for r in tables["nav_items"].where("book_id LIKE '%harbour'").select("ord", "kind", "level", "text", "href").collect())
    assert [tuple(r) for r in rows] == [(0, "heading", 1, "The Harbour", "01.smil#t1"), (1, "page", None, "1", "01.smil#t2"), (2, "heading", 2, "Boats & Nets", "02.smil#t3"), (3, "heading", 1, "", "02.smil#t4")]


def test_clips(tables):
    rows = sorted(tuple(r) for r in tables["clips"].select("section_idx", "clip_ord", "par_ord", "src", "clip_begin", "clip_end").collect())
    assert [(a, bool(c is not None), d, e, f) for a, _, c, d, e, f in rows] == [(1, True, "a.mp3", 0.0, 1.5), (1, True, "a.mp3", 1.5, 2.0), (1, False, "a.mp3", 2.0, 4.0), (2, True, "b.mp3", 1.0, 2.5), (2, True, "b.mp3", 0.0, 1.0)]


def test_first_meta_wins(tables):
    assert daisy.smil_meta_value(tables["smil_meta"], "dc:title").first()["value"] == "The Harbour"


def test_book_info(tables):
    r = _book(daisy.book_info(tables).collect(), "harbour")
    assert (r["headings"], r["n_pages"], r["sections"], r["pars"], r["clips"], r["seconds"], r["files"], r["in_order"]) == ("h1: 2, h2: 1", 1, 2, 4, 5, 6.5, 2, "a.mp3,b.mp3")


def test_round_trip():
    with open(os.path.join(BOOKS, "harbour", "01.smil")) as f:
        nodes = daisy.parse_smil(f.read()).nodes
    assert daisy.parse_smil(daisy.write_smil(nodes)).nodes == nodes


def test_a_par_in_a_par_is_left_out():
    nodes = daisy.parse_smil('<smil><body><seq><par><text src="a"/><par><text src="b"/></par></par></seq></body></smil>').nodes
    assert [n["kind"] for n in nodes if n["kind"] == "par"] == ["par"]


def test_convert(spark):
    rows = {os.path.basename(r["input"]): r for r in convert.convert(spark, BOOKS).collect()}
    assert rows["broken"]["status"] == "error" and rows["broken"]["epub"] is None
    good = rows["harbour"]
    assert good["status"] == "ok", good["error"]
    z = zipfile.ZipFile(io.BytesIO(bytes(good["epub"])))
    first = z.infolist()[0]
    assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED
    assert {"META-INF/container.xml", "OEBPS/package.opf", "OEBPS/nav.xhtml", "OEBPS/content/01.xhtml", "OEBPS/overlays/02.smil"} <= set(z.namelist())
    opf = z.read("OEBPS/package.opf").decode()
    assert "<dc:title>The Harbour</dc:title>" in opf and 'media-type="audio/mpeg"' in opf
    nav = z.read("OEBPS/nav.xhtml").decode()
    assert "Boats &amp; Nets" in nav and "Heading h3" in nav and "page-list" in nav
    over = z.read("OEBPS/overlays/01.smil").decode()
    # the second par has no audio and gives none; bare audio gives none either
    assert over.count("<par ") == 1 and 'clipEnd="0:00:02"' in over


def test_batch_summary(spark):
    import json

    got = json.loads(convert.summary(convert.convert(spark, BOOKS)).first()["json"])
    assert (got["total"], got["ok"], got["failed"]) == (2, 1, 1)


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"content": [{"chapter-title": "One\\n two", "chapter-content": "a\\n\\nb"}, {"chapter-content": "c d"}]}', "# One two\n\na\n\nb\n\n# c d\n\nc d"),
        ('{"content": [{"chapter-content": "a\\nb"}]}', "a\n\nb"),
        ("{}", ""),
        ('{"content": 3}', '{"content": 3}'),
        ("plain\ntext", "plain\ntext"),
    ],
)
def test_json_book(spark, raw, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(raw,)], "v string").select(texts.json_book(F.col("v")).alias("x")).first()["x"] == want


def test_reports(spark):
    epub = '{"messages": [{"ID": "A-1", "severity": "WARNING", "message": "m", "locations": [{"path": "p", "line": 3, "column": 4}, {"path": "q", "line": 1, "column": 1}]}, {"ID": "A-2", "severity": "odd", "message": "n", "locations": []}]}'
    rows = texts.epubcheck_issues(spark.createDataFrame([("b", epub)], "book_id string, json string")).collect()
    assert [(r["severity"], r["location"]) for r in rows] == [("warning", "p:3:4"), ("error", None)]
    ace = '{"assertions": [{"earl:testSubject": {"url": "c.xhtml"}, "assertions": [{"earl:test": {"dct:title": "t"}, "earl:result": {"earl:outcome": "fail"}}, {"earl:test": {"dct:title": "u"}, "earl:result": {"earl:outcome": "cantTell"}}, {"earl:test": {"dct:title": "v"}, "earl:result": {"earl:outcome": "pass"}}]}]}'
    rows = texts.ace_issues(spark.createDataFrame([("b", ace)], "book_id string, json string")).collect()
    assert [(r["issue_id"], r["severity"]) for r in rows] == [("t", "error"), ("u", "warning")]


def test_cache(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": 1, "cache_key": "k", "audio_sha256": "x", "model_sha256": "y", "language": "en", "segments": []}')
    (tmp_path / "b.json").write_text('{"schema_version": 2, "cache_key": "l"}')
    (tmp_path / "c.json").write_text("{broken")
    cache = texts.transcript_cache(spark, str(tmp_path))
    wanted = spark.createDataFrame([("k",), ("l",), ("c",)], "cache_key string")
    assert sorted(r["cache_key"] for r in texts.cache_misses(wanted, cache).collect()) == ["c", "l"]


def test_cover_choice(spark):
    from pyspark.sql import functions as F

    rows = [("b", "title", 1, None, ["eng"], ["Ann Sea"]), ("b", "title", 2, 7, ["fre"], ["Ann Sea"]), ("b", "title", 3, 8, ["eng"], ["Bo Lake"]), ("b", "title", 4, 9, ["eng"], ["A. SEA"])]
    # what an ISBN finds needs neither language nor author
    rows += [("c", "isbn", 1, None, None, None), ("c", "isbn", 2, 5, ["fre"], ["Bo Lake"]), ("c", "title", 1, 6, ["eng"], ["Ann Sea"])]
    candidates = spark.createDataFrame(rows, "book_id string, by string, rank int, cover_id int, language array<string>, author_name array<string>")
    assert {r["book_id"]: r["cover_id"] for r in texts.cover_choice(candidates, F.lit("en"), F.lit("Ann Sea")).collect()} == {"b": 9, "c": 5}


def test_cache_grows(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "cache_key string, audio_sha256 string, model_sha256 string, language string, segments array<struct<start: double, end: double, text: string, words: array<struct<start: double, end: double, text: string>>>>"
    for key in ("k", "l"):
        texts.append_cache(spark.createDataFrame([(key, "x", "y", "en", [(0.0, 1.5, "a\nb", [(0.0, 1.5, "a")])])], schema), path)
    rows = {r["cache_key"]: r for r in texts.transcript_cache(spark, path).collect()}
    assert set(rows) == {"k", "l"} and rows["k"]["segments"][0]["text"] == "a\nb" and rows["l"]["segments"][0]["words"][0]["end"] == 1.5
