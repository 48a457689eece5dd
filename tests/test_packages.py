"""Packages hold their audio, cover and metadata; SMIL writers lose nothing."""

import io
import os
import shutil
import zipfile

from quire.plans import convert
from quire.sources import daisy

BOOKS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "books")
PNG = b"\x89PNG\r\n\x1a\n and more"
MORE = {"dc:creator": "A & B", "dc:publisher": "Quay", "dc:date": "2001-02-03", "dc:rights": "All kept", "ncc:narrator": "N. N.", "ncc:multimediaType": "audioFullText"}


def _library(tmp_path):
    for name in ("one", "two"):
        shutil.copytree(os.path.join(BOOKS, "harbour"), tmp_path / name)
    ncc = (tmp_path / "one" / "ncc.html").read_text()
    metas = "".join(f'<meta name="{n}" content="{c.replace("&", "&amp;")}" />' for n, c in MORE.items())
    (tmp_path / "one" / "ncc.html").write_text(ncc.replace("</head>", metas + "</head>"))
    (tmp_path / "one" / "a.mp3").write_bytes(b"first a" * 1000)
    (tmp_path / "one" / "b.mp3").write_bytes(b"first b")
    (tmp_path / "two" / "a.mp3").write_bytes(b"second a")
    (tmp_path / "two" / "unheard.mp3").write_bytes(b"unheard")
    return str(tmp_path)


def test_packages_hold_audio_cover_and_metadata(spark, tmp_path):
    root = _library(tmp_path)
    found = {os.path.basename(r["input"]): r for r in convert.convert(spark, root).collect()}
    covers = spark.createDataFrame([(found["one"]["input"], bytearray(PNG)), (found["two"]["input"], bytearray(b"GIF89a"))], "book_id string, cover binary")
    rows = {os.path.basename(r["input"]): r for r in convert.convert(spark, root, covers, modified="2020-01-01T00:00:00Z").collect()}
    one = rows["one"]
    assert one["status"] == "ok" and one["missing_audio"] == [], one["error"]
    z = zipfile.ZipFile(io.BytesIO(bytes(one["epub"])))
    assert z.read("OEBPS/audio/a.mp3") == b"first a" * 1000 and z.read("OEBPS/audio/b.mp3") == b"first b"
    assert z.getinfo("OEBPS/audio/a.mp3").compress_type == zipfile.ZIP_STORED
    assert z.read("OEBPS/images/cover.png") == PNG
    opf = z.read("OEBPS/package.opf").decode()
    for part in ("<dc:creator>A &amp; B</dc:creator>", "<dc:publisher>Quay</dc:publisher>", "<dc:date>2001-02-03</dc:date>", "<dc:rights>All kept</dc:rights>", 'media:narrator">N. N.<', ">urn:daisy:harbour-1</dc:identifier>", "<dc:source>urn:daisy:harbour-1</dc:source>", 'schema:accessMode">auditory<', 'schema:accessMode">textual<', 'dcterms:modified">2020-01-01T00:00:00Z<', 'href="images/cover.png" media-type="image/png" properties="cover-image"', '<meta property="media:duration">6.500s<'):
        assert part in opf, part
    # a cover of another kind fails its book alone; without it, the file that is not there is named
    assert rows["two"]["status"] == "error" and "JPEG" in rows["two"]["error"]
    two = found["two"]
    z = zipfile.ZipFile(io.BytesIO(bytes(two["epub"])))
    assert two["missing_audio"] == ["b.mp3"] and z.read("OEBPS/audio/a.mp3") == b"second a"
    assert not any("unheard" in n for n in z.namelist())
    opf = z.read("OEBPS/package.opf").decode()
    assert "textual" not in opf and "dc:creator" not in opf and "dc:rights" not in opf


def test_rights_can_be_said(spark, tmp_path):
    rows = convert.convert(spark, _library(tmp_path), rights="Mine").collect()
    assert all("<dc:rights>Mine</dc:rights>" in zipfile.ZipFile(io.BytesIO(bytes(r["epub"]))).read("OEBPS/package.opf").decode() for r in rows)


def test_master_and_metas_round_trip():
    for name in ("master.smil", "01.smil"):
        with open(os.path.join(BOOKS, "harbour", name)) as f:
            parsed = daisy.parse_smil(f.read())
        assert parsed.meta
        again = daisy.parse_smil(daisy.write_master(parsed.refs, parsed.meta) if parsed.refs else daisy.write_smil(parsed.nodes, parsed.meta))
        assert (again.meta, again.refs, again.nodes) == (parsed.meta, parsed.refs, parsed.nodes)
    odd = [("i&1", 'a "title" <x>', "é.smil")]
    assert daisy.parse_smil(daisy.write_master(odd, [("n", "a & 'b'")])).refs == odd


def test_every_reference_is_in_the_package(spark, tmp_path):
    import posixpath
    import re

    rows = convert.convert(spark, _library(tmp_path)).collect()
    for r in rows:
        z = zipfile.ZipFile(io.BytesIO(bytes(r["epub"])))
        names = set(z.namelist())
        lost = {f"OEBPS/audio/{a}" for a in r["missing_audio"]}
        opf = z.read("OEBPS/package.opf").decode()
        hrefs = re.findall(r'<item [^>]*href="([^"]*)"', opf)
        assert len(hrefs) > 5 and {f"OEBPS/{h}" for h in hrefs} - lost <= names
        for name in names:
            if name.endswith((".xhtml", ".smil")):
                for target in re.findall(r'(?:href|src)="([^"]*)"', z.read(name).decode()):
                    file, _, anchor = target.partition("#")
                    file = posixpath.normpath(posixpath.join(posixpath.dirname(name), file))
                    assert file in names | lost, (name, target)
                    assert not anchor or f'id="{anchor}"' in z.read(file).decode(), (name, target)
        assert re.search(r'dcterms:modified">\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ<', opf)
