"""Queries over sources and sinks: a library of books whose files are written from the driver's tables, read back as tables.

A customer is a book: a navigation file (UTF-8 or windows-1252), a master file and a SMIL file for each of the customer's
orders; an order's line items are its pars. Some books have an empty navigation file, a second one in another spelling,
no master file, or lack a section. The files are rows as scan() gives them, so that parsing, joining and packaging run as
on a folder; the SQL says what must come out of the same tables without any file.
"""

from __future__ import annotations

import hashlib
import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text
from quire.operators import aggregates, tree
from quire.plans import convert, package, transcribed
from quire.plans.catalogue import _PAD, _TRIM, _t, query
from quire.sources import daisy, texts


def _sections(spark, sf_dir) -> DataFrame:
    """c, o, k: a book's orders, numbered."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    return o.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("o")))


def _joined(rows: DataFrame, key: str, order: str, markup: Column) -> DataFrame:
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, markup.alias("x")))), lambda v: v["x"])
    return rows.groupBy(key).agg(F.array_join(listed, "").alias("inner"), F.count("*").alias("n"))


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _files(spark, sf_dir) -> DataFrame:
    """dir, name and content of all files."""
    c, k, o = F.col("c"), F.col("k"), F.col("o")
    own = _sections(spark, sf_dir)
    level = _s(k % 6 + 1)
    heading = F.concat(F.lit("<h"), level, F.lit(' class="section" id="h'), _s(o), F.lit('"><a href="'), _s(o), F.lit(".smil#t"), _s(o), F.lit('">  Part '), _s(k), F.lit(" &amp; more </a></h"), level, F.lit(">"))
    page = F.concat(F.lit('<span class="page-normal" id="p'), _s(o), F.lit('"><a href="'), _s(o), F.lit(".smil#q"), _s(o), F.lit('">'), _s(k), F.lit("</a></span>"))
    nav = _joined(own, "c", "k", F.concat(heading, F.when(o % 2 == 1, page).otherwise("")))
    books = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_name").join(nav, "c", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "inner": F.coalesce("inner", F.lit(""))})
    latin = c % 4 == 0
    meta = lambda name, value: F.concat(F.lit(f'<meta name="{name}" content="'), value, F.lit('"/>'))
    metas = F.concat(meta("dc:title", F.lit("draft")), meta("DC:Title", F.concat(F.lit("Café "), "c_name")), meta("dc:language", F.lit("en")), meta("dc:identifier", F.concat(F.lit("c-"), _s(c))), meta("ncc:tocItems", _s("n")), meta("ncc:pageNormal", F.when(c % 5 == 0, F.concat(F.lit("x"), _s("n"))).otherwise(_s("n"))), meta("prod:run", _s(c % 7)))
    head = F.concat(F.lit('<?xml version="1.0" encoding="'), F.when(latin, "windows-1252").otherwise("utf-8"), F.lit('"?><html><head>'))
    markup = F.when(c % 13 == 0, "<html><head></head><body></body></html>").otherwise(F.concat(head, metas, F.lit("</head><body>"), F.col("inner"), F.lit("</body></html>")))
    ncc = books.select("c", F.when(c % 11 == 5, "Ncc.html").otherwise("ncc.html").alias("name"), F.when(latin, F.encode(markup, "ISO-8859-1")).otherwise(F.encode(markup, "UTF-8")).alias("content"))
    other = books.where("c % 6 = 0 AND c % 11 <> 5").select("c", F.lit("NCC.HTML").alias("name"), F.encode(F.lit("<html><head><meta name='dc:title' content='Wrong'/></head></html>"), "UTF-8").alias("content"))
    ref = F.concat(F.lit('<ref title="Part '), _s(k), F.lit('" src="'), _s(o), F.lit('.smil" id="r'), _s(o), F.lit('"/>'))
    refs = books.select("c").join(_joined(own, "c", "k", ref), "c", "left").where("c % 17 <> 3")
    master = refs.select("c", F.lit("master.smil").alias("name"), F.encode(F.concat(F.lit('<smil><head><meta name="dc:title" content="M '), _s(c), F.lit('"/><meta name="dc:title" content="second"/></head><body>'), F.coalesce("inner", F.lit("")), F.lit("</body></smil>")), "UTF-8").alias("content"))
    lines = _t(spark, sf_dir, "lineitem").withColumn("j", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))).select(F.col("l_orderkey").alias("o"), "j", "l_returnflag")
    j = F.col("j")
    clip = lambda begin, end: F.concat(F.lit('<audio src="'), "l_returnflag", F.lit('.mp3" clip-begin="npt='), begin, F.lit('s" clip-end="npt='), end, F.lit('s"/>'))
    two = F.concat(F.lit("<seq>"), clip(F.concat(_s(j * 2), F.lit(".000")), F.concat(_s(j * 2), F.lit(".500"))), clip(F.concat(_s(j * 2), F.lit(".500")), F.concat(_s(j * 2 + 1), F.lit(".250"))), F.lit("</seq>"))
    par = F.concat(F.lit('<par id="p'), _s(j), F.lit('" endsync="last"><text src="c.html#x'), _s(j), F.lit('" id="t'), _s(j), F.lit('"/>'), F.when(j % 3 == 0, "").otherwise(two), F.lit("</par>"))
    body = own.where("o % 97 <> 0").join(_joined(lines, "o", "j", par), "o", "left")
    smil = body.select("c", F.concat(_s(o), F.lit(".smil")).alias("name"), F.encode(F.concat(F.lit('<smil><head><meta name="ncc:totalElapsedTime" content="'), _s(k), F.lit('"/></head><body><seq id="q'), _s(o), F.lit('" dur="'), _s(F.coalesce("n", F.lit(0))), F.lit('s">'), F.coalesce("inner", F.lit("")), F.lit('<audio src="bare.mp3" clip-begin="0:00:01" clip-end="0:00:02"/></seq></body></smil>')), "UTF-8").alias("content"))
    return ncc.unionByName(other).unionByName(master).unionByName(smil).select(F.concat(F.lit("lib/"), _s(c)).alias("dir"), "name", "content")


def library(spark, sf_dir) -> DataFrame:
    """path, dir, name and content of all files."""
    files = _files(spark, sf_dir)
    # parsing is what costs here, not bytes, so the files are spread over as many tasks as there may be
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dir", "name")
    return files.select(F.concat("dir", F.lit("/"), "name").alias("path"), "dir", "name", "content")


_SHELF = """WITH b AS (SELECT c_custkey AS c, c_name, 'lib/' || c_custkey AS book_id, c_custkey % 13 = 0 AS bare, c_custkey % 17 <> 3 AS has_master FROM customer),
s AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
i AS (SELECT l_orderkey AS o, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS j FROM lineitem),
z AS (SELECT c, count(*) AS n, count(*) FILTER (WHERE o % 2 = 1) AS pages, min(k) FILTER (WHERE o % 97 = 0) AS lost FROM s GROUP BY 1),
g AS (SELECT b.*, coalesce(n, 0) AS n, coalesce(pages, 0) AS pages, CASE WHEN bare THEN 'neither navigation nor title' WHEN NOT has_master THEN 'master.smil is missing' WHEN lost IS NOT NULL THEN (SELECT o FROM s WHERE s.c = b.c AND s.k = z.lost) || '.smil is missing' END AS error FROM b LEFT JOIN z USING (c)),
m AS (SELECT g.book_id, g.error, s.* FROM s JOIN g USING (c) WHERE has_master),
p AS (SELECT m.*, i.f, i.j, i.j % 3 = 0 AS mute, 1 + coalesce(sum(CASE WHEN i.j % 3 = 0 THEN 2 ELSE 5 END) OVER (PARTITION BY m.o ORDER BY i.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM m JOIN i USING (o) WHERE m.o % 97 <> 0),
clips AS (
  SELECT book_id, k AS section_idx, pos AS par_ord, pos + 3 AS clip_ord, f || '.mp3' AS src, j * 2::DOUBLE AS clip_begin, j * 2 + 0.5::DOUBLE AS clip_end FROM p WHERE NOT mute
  UNION ALL SELECT book_id, k, pos, pos + 4, f || '.mp3', j * 2 + 0.5::DOUBLE, j * 2 + 1.25::DOUBLE FROM p WHERE NOT mute
  UNION ALL SELECT m.book_id, m.k, NULL, 1 + coalesce((SELECT sum(CASE WHEN i.j % 3 = 0 THEN 2 ELSE 5 END) FROM i WHERE i.o = m.o), 0), 'bare.mp3', 1.0, 2.0 FROM m WHERE m.o % 97 <> 0
)
"""


def _tables(spark, sf_dir, stored: bool = False) -> dict[str, DataFrame]:
    return daisy.tables_of(library(spark, sf_dir), stored)


@query(
    f"""{_SHELF} SELECT book_id, CASE WHEN NOT bare THEN 'Café ' || c_name END AS title, CASE WHEN NOT bare THEN 'en' END AS language, CASE WHEN NOT bare THEN 'c-' || c END AS identifier, CASE WHEN NOT bare THEN n END AS toc_items,
  CASE WHEN NOT bare AND c % 5 <> 0 THEN n END AS page_normal, CASE WHEN NOT bare THEN (c % 7)::VARCHAR END AS run, CASE WHEN NOT bare AND n > 0 THEN n END AS n_headings, CASE WHEN NOT bare AND n > 0 THEN pages END AS n_pages, error, book_id || CASE WHEN c % 11 = 5 THEN '/Ncc.html' ELSE '/ncc.html' END AS root FROM g"""
)
def book_metadata(spark, sf_dir):
    """Books with their typed metadata, counts and errors, from navigation files in two charsets and several spellings."""
    b = _tables(spark, sf_dir)["books"]
    return b.select("book_id", "title", "language", "identifier", "toc_items", "page_normal", F.col("other")["prod:run"].alias("run"), F.when((F.col("n_headings") + F.col("n_pages")) > 0, F.col("n_headings")).alias("n_headings"), F.when((F.col("n_headings") + F.col("n_pages")) > 0, F.col("n_pages")).alias("n_pages"), "error", "root")


@query(
    f"""{_SHELF}, h AS (SELECT g.book_id, g.c, s.o, s.k FROM s JOIN g USING (c) WHERE NOT bare),
n AS (SELECT *, 'heading' AS kind, 0 AS x FROM h UNION ALL SELECT *, 'page', 1 FROM h WHERE o % 2 = 1)
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY k, x) - 1)::INT AS ord, kind, CASE WHEN x = 0 THEN k % 6 + 1 END::INT AS level, CASE WHEN x = 0 THEN 'section' ELSE 'page-normal' END AS class, CASE WHEN x = 0 THEN 'h' ELSE 'p' END || o AS item_id,
  CASE WHEN x = 0 THEN 'Part ' || k || ' & more' ELSE k::VARCHAR END AS text, o || '.smil#' || CASE WHEN x = 0 THEN 't' ELSE 'q' END || o AS href FROM n"""
)
def book_navigation(spark, sf_dir):
    """Headings and pages of every navigation file in document order."""
    return _tables(spark, sf_dir)["nav_items"].select("book_id", "ord", "kind", "level", "class", "item_id", "text", "href")


@query(f"{_SHELF} SELECT book_id, k::INT AS section_idx, 'r' || o AS ref_id, 'Part ' || k AS title, o || '.smil' AS src FROM m")
def book_sections(spark, sf_dir):
    """Sections in the order of the master files."""
    return _tables(spark, sf_dir)["section_refs"].select("book_id", "section_idx", "ref_id", "title", "src")


@query(f"{_SHELF} SELECT book_id, 'master.smil' AS name, 'dc:title' AS meta, 'M ' || c AS value FROM g WHERE has_master UNION ALL SELECT g.book_id, s.o || '.smil', 'ncc:totalElapsedTime', s.k::VARCHAR FROM s JOIN g USING (c) WHERE s.o % 97 <> 0")
def smil_metas(spark, sf_dir):
    """The first value of each file's metas."""
    meta = _tables(spark, sf_dir)["smil_meta"]
    one = lambda n: daisy.smil_meta_value(meta, n).withColumn("meta", F.lit(n))
    return one("dc:title").unionByName(one("ncc:totalElapsedTime")).select("book_id", "name", "meta", "value")


@query(
    f"""{_SHELF}, n AS (
  SELECT book_id, k, 0 AS node_id, NULL AS parent_id, 0 AS depth, 'seq' AS kind, 'q' || o AS id, (SELECT count(*) FROM i WHERE i.o = m.o)::DOUBLE AS dur FROM m WHERE o % 97 <> 0
  UNION ALL SELECT book_id, k, pos, 0, 1, 'par', 'p' || j, NULL FROM p UNION ALL SELECT book_id, k, pos + 1, pos, 2, 'text', 't' || j, NULL FROM p
  UNION ALL SELECT book_id, k, pos + 2, pos, 2, 'seq', NULL, NULL FROM p WHERE NOT mute UNION ALL SELECT book_id, k, pos + 3, pos + 2, 3, 'audio', NULL, NULL FROM p WHERE NOT mute UNION ALL SELECT book_id, k, pos + 4, pos + 2, 3, 'audio', NULL, NULL FROM p WHERE NOT mute
  UNION ALL SELECT book_id, section_idx, clip_ord, 0, 1, 'audio', NULL, NULL FROM clips WHERE par_ord IS NULL)
SELECT book_id, k::INT AS section_idx, node_id::INT AS node_id, parent_id::INT AS parent_id, depth::INT AS depth, kind, id, dur FROM n"""
)
def smil_tree(spark, sf_dir):
    """The elements of every section in document order with their parents."""
    return _tables(spark, sf_dir)["smil_nodes"].select("book_id", "section_idx", "node_id", "parent_id", "depth", "kind", "id", "dur")


@query(f"{_SHELF} SELECT book_id, section_idx::INT AS section_idx, par_ord::INT AS par_ord, clip_ord::INT AS clip_ord, src, clip_begin, clip_end FROM clips")
def book_clips(spark, sf_dir):
    """Clips with the par that each is in."""
    return _tables(spark, sf_dir)["clips"].select("book_id", "section_idx", "par_ord", "clip_ord", "src", "clip_begin", "clip_end")


@query(
    f"""{_SHELF}, t AS (SELECT book_id, count(*) AS clips, sum(greatest(clip_end - clip_begin, 0)) AS seconds, count(DISTINCT src) AS files FROM clips GROUP BY 1),
f AS (SELECT book_id, src, min(section_idx * 1000000000 + clip_ord) AS o FROM clips GROUP BY 1, 2), l AS (SELECT book_id, string_agg(src, ',' ORDER BY o) AS in_order FROM f GROUP BY 1),
h AS (SELECT g.book_id, k % 6 + 1 AS level, count(*) AS n FROM s JOIN g USING (c) WHERE NOT bare GROUP BY 1, 2), y AS (SELECT book_id, string_agg('h' || level || ': ' || n, ', ' ORDER BY level) AS headings FROM h GROUP BY 1),
q AS (SELECT book_id, count(*) FILTER (WHERE j IS NOT NULL) AS pars, count(DISTINCT k) AS sections FROM (SELECT m.book_id, m.k, p.j FROM m LEFT JOIN p ON p.o = m.o WHERE m.o % 97 <> 0) GROUP BY 1)
SELECT book_id, CASE WHEN NOT bare THEN 'Café ' || c_name END AS title, clips, round(seconds, 6) AS seconds, files, in_order, headings, pars, sections FROM g LEFT JOIN t USING (book_id) LEFT JOIN l USING (book_id) LEFT JOIN y USING (book_id) LEFT JOIN q USING (book_id)"""
)
def book_report(spark, sf_dir):
    """What there is to say about each book: clips, seconds, files as first heard, headings by level, pars, sections."""
    info = daisy.book_info(_tables(spark, sf_dir, stored=True))
    return info.select("book_id", "title", "clips", F.round("seconds", 6).alias("seconds"), "files", "in_order", "headings", "pars", "sections")


_OVERLAYS = f"""{_SHELF}, a AS (SELECT p.*, row_number() OVER (PARTITION BY book_id, o ORDER BY j) AS par FROM p),
v AS (SELECT g.book_id, s.o, s.k AS sk, x.t, x.y FROM s JOIN g USING (c), LATERAL (SELECT 't' || s.o AS t, 0 AS y UNION ALL SELECT 'q' || s.o, 1 WHERE s.o % 2 = 1) x WHERE NOT bare AND has_master),
e AS (SELECT *, row_number() OVER (PARTITION BY book_id, o ORDER BY y) AS par FROM v),
ov AS (SELECT a.book_id, a.k AS section_idx, a.o, a.par, coalesce(e.t, '') AS anchor, a.f || '.mp3' AS src, a.j * 2::DOUBLE AS clip_begin, a.j * 2 + 1.25::DOUBLE AS clip_end FROM a LEFT JOIN e USING (book_id, o, par) WHERE NOT mute)
"""


@query(f"{_OVERLAYS} SELECT book_id, section_idx::INT AS section_idx, par::INT AS k, anchor, src, clip_begin, clip_end FROM ov")
def section_overlays(spark, sf_dir):
    """The k-th par of a section with its k-th anchor and its first source's whole span."""
    return convert.section_overlays(_tables(spark, sf_dir, stored=True)).select("book_id", "section_idx", "k", "anchor", "src", "clip_begin", "clip_end")


_CLOCK = "(x{0} // 3600000)::VARCHAR || ':' || lpad((x{0} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((x{0} // 1000 % 60)::VARCHAR, 2, '0') || CASE WHEN x{0} % 1000 = 0 THEN '' ELSE '.' || lpad((x{0} % 1000)::VARCHAR, 3, '0') END"
_DOCUMENTS = f"""{_OVERLAYS},
w AS (SELECT *, round(clip_begin * 1000)::BIGINT AS x0, round(clip_end * 1000)::BIGINT AS x1 FROM ov),
sm AS (SELECT book_id, section_idx, sum(clip_end - clip_begin) AS seconds, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body><seq>' || string_agg('<par id="p-' || {_PAD.format('section_idx')} || '-' || {_PAD.format('par')} || '"><text src="../content/' || o || '.xhtml' || CASE WHEN anchor = '' THEN '' ELSE '#' || anchor END || '"/><audio src="../audio/' || src || '" clipBegin="' || {_CLOCK.format(0)} || '" clipEnd="' || {_CLOCK.format(1)} || '"/></par>', '' ORDER BY par) || '</seq></body></smil>' AS smil FROM w GROUP BY 1, 2),
bd AS (SELECT book_id, o, string_agg(CASE WHEN y = 0 THEN '<h' || sk % 6 + 1 || ' id="' || t || '">Part ' || sk || ' &amp; more</h' || sk % 6 + 1 || '>' ELSE '<span id="' || t || '">' || sk || '</span>' END, '' ORDER BY y) AS body FROM v GROUP BY 1, 2),
dc AS (SELECT m.book_id, m.k AS section_idx, m.o, m.error, coalesce(bd.body, '<h1>Part ' || m.k || '</h1>') AS body, sm.smil, coalesce(sm.seconds, 0.0) AS seconds FROM m LEFT JOIN bd USING (book_id, o) LEFT JOIN sm ON sm.book_id = m.book_id AND sm.section_idx = m.k)
"""


@query(f"{_DOCUMENTS} SELECT book_id, section_idx::INT AS section_idx, o::VARCHAR AS name, 'Part ' || section_idx AS title, body, smil, round(seconds, 6) AS seconds FROM dc")
def section_documents(spark, sf_dir):
    """Every section's document name, body and overlay."""
    return convert.sections(_files(spark, sf_dir)).select("book_id", "section_idx", "name", "title", "body", "smil", F.round("seconds", 6).alias("seconds"))


_STATUS = "input string, status string, error string, n_sections int, seconds double, missing_audio array<string>"


def _packages(spark, sf_dir, then=lambda row: [(*row[:5], row[6])], fields: str = _STATUS) -> DataFrame:
    """All books packaged; a file of every source but bare.mp3 lies in each folder, heard or not, with its name as content."""
    customers = _t(spark, sf_dir, "customer").select(F.concat(F.lit("lib/"), _s("c_custkey")).alias("book_id"))
    names = _t(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit(".mp3")).alias("src")).distinct()
    sounds = customers.join(F.broadcast(names)).select("book_id", "src", F.encode("src", "UTF-8").alias("content"))
    covers = customers.where("book_id LIKE '%7'").select("book_id", F.lit(b"\x89PNG\r\n\x1a\n cover").alias("cover"))
    return convert.packages(_files(spark, sf_dir), sounds, covers, modified="2024-01-02T03:04:05Z", then=then, fields=fields)


def _entries(spark, sf_dir, only: str | None = None) -> DataFrame:
    """book_id, place, entry, method and md5 of all that is in each package, or of one entry."""

    def read(row: tuple) -> list[tuple]:
        book, status, data = row[0], row[1], row[5]
        if status != "ok":
            return []
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(book, k, e.filename, e.compress_type == zipfile.ZIP_STORED, hashlib.md5(z.read(e)).hexdigest()) for k, e in enumerate(z.infolist()) if only in (None, e.filename)]

    return _packages(spark, sf_dir, read, "book_id string, place int, entry string, stored boolean, md5 string")


# Books that have metadata, a master file with sections, and all of these; other books are errors.
_PACKAGED = f"""{_DOCUMENTS}, fine AS (SELECT * FROM g WHERE error IS NULL AND n > 0),
au AS (SELECT book_id, src, row_number() OVER (PARTITION BY book_id ORDER BY min(section_idx * 1000000000 + clip_ord)) AS r FROM clips GROUP BY 1, 2),
en AS (
  SELECT book_id, 1 AS a, 0 AS b, 'mimetype' AS entry, true AS stored, 'application/epub+zip' AS body FROM fine
  UNION ALL SELECT book_id, 2, 0, 'META-INF/container.xml', false, '{package.CONTAINER}' FROM fine
  UNION ALL SELECT book_id, 3, 0, 'OEBPS/package.opf', false, NULL FROM fine UNION ALL SELECT book_id, 4, 0, 'OEBPS/nav.xhtml', false, NULL FROM fine
  UNION ALL SELECT book_id, 5, section_idx, 'OEBPS/content/' || o || '.xhtml', false, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" lang="en"><head><title>Part ' || section_idx || '</title></head><body>' || body || '</body></html>' FROM dc JOIN fine USING (book_id)
  UNION ALL SELECT book_id, 6, section_idx, 'OEBPS/overlays/' || o || '.smil', false, smil FROM dc JOIN fine USING (book_id) WHERE smil IS NOT NULL
  UNION ALL SELECT book_id, 7, r, 'OEBPS/audio/' || src, true, src FROM au JOIN fine USING (book_id) WHERE src <> 'bare.mp3'
  UNION ALL SELECT book_id, 8, 0, 'OEBPS/images/cover.png', true, NULL FROM fine WHERE c % 10 = 7)
"""
_KNOWN = "entry NOT IN ('OEBPS/package.opf', 'OEBPS/nav.xhtml', 'OEBPS/images/cover.png')"


@query(f"{_PACKAGED} SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY a, b) - 1)::INT AS place, entry, stored, CASE WHEN {_KNOWN} THEN md5(body) END AS md5 FROM en")
def package_entries(spark, sf_dir):
    """What every package holds, in order: names, whether stored, and digests of all but the package document and navigation."""
    known = ~F.col("entry").isin("OEBPS/package.opf", "OEBPS/nav.xhtml", "OEBPS/images/cover.png")
    return _entries(spark, sf_dir).select("book_id", "place", "entry", "stored", F.when(known, F.col("md5")).alias("md5"))


_FIXED = {"access": package.ACCESS.replace("'", "''")}


@query(
    f"""{_PACKAGED}, du AS (SELECT book_id, sum(greatest(clip_end - clip_begin, 0)) AS total FROM clips GROUP BY 1),
it AS (SELECT book_id, string_agg('<item id="s-' || {_PAD.format('section_idx')} || '" href="content/' || o || '.xhtml" media-type="application/xhtml+xml"' || CASE WHEN smil IS NULL THEN '/>' ELSE ' media-overlay="mo-' || {_PAD.format('section_idx')} || '"/><item id="mo-' || {_PAD.format('section_idx')} || '" href="overlays/' || o || '.smil" media-type="application/smil+xml"/>' END, '' ORDER BY section_idx) AS items,
  coalesce(string_agg('<meta property="media:duration" refines="#mo-' || {_PAD.format('section_idx')} || '">' || printf('%.3f', seconds) || 's</meta>', '' ORDER BY section_idx) FILTER (WHERE smil IS NOT NULL), '') AS lengths,
  string_agg('<itemref idref="s-' || {_PAD.format('section_idx')} || '"/>', '' ORDER BY section_idx) AS spine FROM dc GROUP BY 1),
so AS (SELECT book_id, string_agg('<item id="audio-' || {_PAD.format('r')} || '" href="audio/' || src || '" media-type="audio/mpeg"/>', '' ORDER BY r) AS sounds FROM au GROUP BY 1)
SELECT f.book_id, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="pub-id" prefix="schema: http://schema.org/"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="pub-id">urn:daisy:c-' || c || '</dc:identifier><dc:title>Café ' || c_name || '</dc:title><dc:language>en</dc:language><meta property="dcterms:modified">2024-01-02T03:04:05Z</meta><dc:source>urn:daisy:c-' || c || '</dc:source>' || lengths
  || '<meta property="media:duration">' || printf('%.3f', total) || 's</meta>{_FIXED["access"]}<meta property="schema:accessMode">auditory</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' || CASE WHEN c % 10 = 7 THEN '<item id="cover-image" href="images/cover.png" media-type="image/png" properties="cover-image"/>' ELSE '' END || items || sounds || '</manifest><spine>' || spine || '</spine></package>') AS opf_md5
FROM fine f JOIN it USING (book_id) JOIN so USING (book_id) JOIN du USING (book_id)"""
)
def package_document(spark, sf_dir):
    """The digest of every package document: metadata, manifest and spine."""
    return _entries(spark, sf_dir, "OEBPS/package.opf").select("book_id", F.col("md5").alias("opf_md5"))


@query(
    f"""{_PACKAGED} SELECT r.book_id AS input, CASE WHEN f.book_id IS NOT NULL THEN 'ok' ELSE 'error' END AS status, (SELECT count(*) FROM dc WHERE dc.book_id = r.book_id)::INT AS n_sections, round(coalesce((SELECT sum(seconds) FROM dc WHERE dc.book_id = r.book_id), 0.0), 6) AS seconds,
  CASE WHEN EXISTS (SELECT 1 FROM clips WHERE clips.book_id = r.book_id) THEN 'bare.mp3' ELSE '' END AS missing FROM g r LEFT JOIN fine f USING (book_id)"""
)
def package_status(spark, sf_dir):
    """A row a book: whether it became a package, its sections and seconds, and the audio that it lacks."""
    p = _packages(spark, sf_dir)
    return p.select("input", "status", "n_sections", F.round("seconds", 6).alias("seconds"), F.array_join("missing_audio", ",").alias("missing"))


# ---- spoken sections


def _spoken(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transcripts of two sections in three, a segment for each par with audio; one in three has its true text too."""
    lines = _t(spark, sf_dir, "lineitem").withColumn("j", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))).select(F.col("l_orderkey").alias("o"), "j", F.col("l_returnflag").alias("f"))
    own = _sections(spark, sf_dir).where("o % 3 <> 2 AND o % 97 <> 0").select(F.concat(F.lit("lib/"), _s("c")).alias("book_id"), F.col("k").alias("section_idx"), "o")
    said = F.concat(F.lit("Word"), _s("j"), F.lit(" of "), "f", F.lit("."))
    rows = own.join(lines.where("j % 3 <> 0"), "o").withColumn("said", said)
    segments = rows.select("book_id", "section_idx", F.col("j").alias("seg_ord"), (F.col("j") * 2.0).alias("start_s"), (F.col("j") * 2 + 1.25).alias("end_s"), F.col("said").alias("text"), F.lit("spoken.mp3").alias("audio_src"))
    words = rows.select("book_id", "section_idx", "o", F.col("j").alias("seg_ord"), F.posexplode(F.split("said", " ")).alias("word_ord", "text"))
    begin = F.col("seg_ord") * 2 + F.when((F.col("o") % 15) == 10, 0.0).otherwise(F.col("word_ord") * 0.5)
    words = words.select("book_id", "section_idx", "seg_ord", "word_ord", begin.alias("start_s"), F.when((F.col("o") % 15) == 10, begin).otherwise(begin + 0.25).alias("end_s"), "text")
    n = F.row_number().over(Window.partitionBy("o").orderBy("j"))
    truths = _joined(rows.where("o % 3 = 0").withColumn("_n", n), "o", "_n", F.concat(F.when(F.col("_n") == 1, "").when(F.col("_n") % 2 == 1, "\n\n").otherwise(" "), "said"))
    return segments, words, truths.join(own, "o").select("book_id", "section_idx", F.col("inner").alias("text"))


_SPOKEN = f"""{_DOCUMENTS},
sg AS (SELECT p.book_id, p.k AS section_idx, p.o, p.j, 'Word' || j || ' of ' || f || '.' AS said, row_number() OVER (PARTITION BY p.book_id, p.o ORDER BY j) - 1 AS n FROM p WHERE NOT mute AND o % 3 <> 2),
sw AS (SELECT *, unnest(string_split(said, ' ')) AS w, generate_subscripts(string_split(said, ' '), 1) - 1 AS i, CASE WHEN o % 3 = 0 THEN n // 2 ELSE n // 6 END AS pp FROM sg),
st AS (SELECT *, j * 2 + CASE WHEN o % 15 = 10 THEN 0.0 ELSE i * 0.5 END::DOUBLE AS a, j * 2 + CASE WHEN o % 15 = 10 THEN 0.0 ELSE i * 0.5 + 0.25 END::DOUBLE AS b, row_number() OVER (PARTITION BY book_id, o, pp ORDER BY j, i) AS q FROM sw),
si AS (SELECT *, 'w-' || {_PAD.format('section_idx')} || '-' || {_PAD.format('pp + 1')} || '-' || {_PAD.format('q')} AS wid, round(a * 1000)::BIGINT AS x0, round(b * 1000)::BIGINT AS x1 FROM st),
sp AS (SELECT book_id, section_idx, o, pp, '<p id="tx-' || {_PAD.format('section_idx')} || '-' || {_PAD.format('pp + 1')} || '">' || string_agg('<span id="' || wid || '">' || w || '</span>', ' ' ORDER BY q) || '</p>' AS x,
  '<seq>' || string_agg('<par id="' || wid || '"><text src="../content/' || o || '.xhtml#' || wid || '"/><audio src="../audio/spoken.mp3" clipBegin="' || {_CLOCK.format(0)} || '" clipEnd="' || {_CLOCK.format(1)} || '"/></par>', '' ORDER BY q) FILTER (WHERE x1 > x0) || '</seq>' AS y, sum(b - a) AS t FROM si GROUP BY 1, 2, 3, 4),
ss AS (SELECT book_id, section_idx, string_agg(x, '' ORDER BY pp) AS x, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body>' || string_agg(y, '' ORDER BY pp) || '</body></smil>' AS y, sum(t) AS t FROM sp GROUP BY 1, 2)
"""


@query(f"{_SPOKEN} SELECT dc.book_id, dc.section_idx::INT AS section_idx, body || coalesce(x, '') AS body, coalesce(y, smil) AS smil, round(CASE WHEN y IS NULL THEN seconds ELSE t END, 6) AS seconds FROM dc LEFT JOIN ss USING (book_id, section_idx)")
def spoken_sections(spark, sf_dir):
    """Sections with their spoken text: by the true text, by merged segments, or as they were."""
    parts = convert.sections(_files(spark, sf_dir))
    out = transcribed.with_transcripts(parts, *_spoken(spark, sf_dir))
    return out.select("book_id", "section_idx", "body", "smil", F.round("seconds", 6).alias("seconds"))


# ---- trees, writers and reports of the library


@query(
    f"""{_PACKAGED}, x AS (SELECT m.book_id, m.k, m.o, CASE WHEN m.k < 6 THEN m.k ELSE m.k % 6 + 1 END AS d FROM m JOIN fine USING (book_id)),
y AS (SELECT *, lag(d) OVER (PARTITION BY book_id ORDER BY k) AS before, lead(k) OVER (PARTITION BY book_id ORDER BY k) IS NULL AS last FROM x),
li AS (SELECT book_id, string_agg(CASE WHEN before IS NULL OR d > before THEN '<ol>' ELSE '</li>' || repeat('</ol></li>', (before - d)::INT) END || '<li><a href="content/' || o || '.xhtml#t' || o || '">Part ' || k || ' &amp; more</a>' || CASE WHEN last THEN repeat('</li></ol>', d::INT) ELSE '' END, '' ORDER BY k) AS toc,
  string_agg('<li><a href="content/' || o || '.xhtml#q' || o || '">' || k || '</a></li>', '' ORDER BY k) FILTER (WHERE o % 2 = 1) AS pages FROM y GROUP BY 1)
SELECT book_id, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc">' || toc || '</nav>' || CASE WHEN pages IS NULL THEN '' ELSE '<nav epub:type="page-list"><ol>' || pages || '</ol></nav>' END || '</body></html>') AS nav_md5 FROM li"""
)
def package_navigation(spark, sf_dir):
    """The digest of every package's nested table of contents and page list."""
    return _entries(spark, sf_dir, "OEBPS/nav.xhtml").select("book_id", F.col("md5").alias("nav_md5"))


@query(
    f"""{_SHELF}, r AS (SELECT 'lib/' || s.c AS dir, s.o || '.smil' AS name, s.k, s.o, (SELECT count(*) FROM i WHERE i.o = s.o) AS n, coalesce((SELECT string_agg('<par id="p' || j || '" endsync="last"><text id="t' || j || '" src="c.html#x' || j || '"/>' || CASE WHEN j % 3 = 0 THEN '' ELSE '<seq><audio src="' || f || '.mp3" clip-begin="npt=' || j * 2 || '.000s" clip-end="npt=' || j * 2 || '.500s"/><audio src="' || f || '.mp3" clip-begin="npt=' || j * 2 || '.500s" clip-end="npt=' || j * 2 + 1 || '.250s"/></seq>' END || '</par>', '' ORDER BY j) FROM i WHERE i.o = s.o), '') AS pars FROM s JOIN b USING (c) WHERE s.o % 97 <> 0),
h AS (SELECT '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<smil><head>' AS head)
SELECT dir, name, md5(head || '<meta name="ncc:totalElapsedTime" content="' || k || '"/></head><body><seq id="q' || o || '" dur="' || n || 's">' || pars || '<audio src="bare.mp3" clip-begin="0:00:01" clip-end="0:00:02"/></seq></body></smil>') AS md5 FROM r, h
UNION ALL SELECT book_id, 'master.smil', md5(head || '<meta name="dc:title" content="M ' || c || '"/><meta name="dc:title" content="second"/></head><body>' || coalesce((SELECT string_agg('<ref title="Part ' || k || '" src="' || o || '.smil" id="r' || o || '"/>', '' ORDER BY k) FROM s WHERE s.c = b.c), '') || '</body></smil>') FROM b, h WHERE has_master"""
)
def smil_written(spark, sf_dir):
    """Master and section files written from their parsed rows."""
    return daisy.written_smil(daisy.smil_rows(library(spark, sf_dir))).select("dir", "name", F.md5("content").alias("md5"))


@query(
    """WITH RECURSIVE p AS (SELECT p_brand, p_size % 6 + 1 AS level, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ord FROM part),
t AS (SELECT p.*, (SELECT max(q.ord) FROM p q WHERE q.p_brand = p.p_brand AND q.ord < p.ord AND q.level < p.level) AS up FROM p),
r AS (SELECT p_brand, ord, ord::VARCHAR AS path, 1 AS depth FROM t WHERE up IS NULL UNION ALL SELECT t.p_brand, t.ord, r.path || '/' || t.ord, r.depth + 1 FROM r JOIN t ON t.p_brand = r.p_brand AND t.up = r.ord)
SELECT p_brand, ord::INT AS ord, path, depth FROM r"""
)
def heading_paths(spark, sf_dir):
    """The way from the root to every heading."""
    parts = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 6 + 1).alias("level"))
    return tree.with_paths(tree.heading_parents(parts, ["p_brand"], "p_partkey", "level"), "p_brand").select("p_brand", "ord", "path", "depth")


@query(
    f"""{_SHELF}, t AS (SELECT g.book_id, CASE WHEN c % 3 = 0 THEN c % 9 * 1.0::DOUBLE END AS said, coalesce((SELECT sum(greatest(clip_end - clip_begin, 0)) FROM clips WHERE clips.book_id = g.book_id), 0.0) AS own FROM g WHERE has_master AND n > 0)
SELECT book_id, CASE WHEN coalesce(said, own) > 0 THEN round(coalesce(said, own), 6) END AS seconds FROM t"""
)
def overlay_durations(spark, sf_dir):
    """A package's length: the one that is said, else that of its parts, nothing unless it is above 0."""
    tables = _tables(spark, sf_dir)
    books = tables["section_refs"].select("book_id").distinct()
    own = tables["clips"].groupBy("book_id").agg(F.sum(aggregates.clip_seconds(F.col("clip_begin"), F.col("clip_end"))).alias("own"))
    parts = books.join(own, "book_id", "left").withColumn("c", F.substring("book_id", 5, 20).cast("long"))
    said = F.max(F.when(F.col("c") % 3 == 0, (F.col("c") % 9).cast("double")))
    own = F.coalesce("own", F.lit(0.0))
    return parts.groupBy("book_id").agg(F.round(aggregates.overlay_duration(said, own), 6).alias("seconds"))


@query(
    f"""{_PACKAGED}, bl AS (SELECT g.book_id AS input, f.book_id IS NOT NULL AS ok, g.error FROM g LEFT JOIN fine f USING (book_id))
SELECT '' AS input, '{{"total":' || count(*) || ',"ok":' || count(*) FILTER (WHERE ok) || ',"failed":' || count(*) FILTER (WHERE NOT ok) || '}}' AS json FROM bl
UNION ALL SELECT input, '{{"input":"' || input || '","status":"' || CASE WHEN ok THEN 'ok"' ELSE 'error","error":"' || coalesce(error, 'no sections') || '"' END || '}}' FROM bl"""
)
def batch_lines(spark, sf_dir):
    """A batch's totals and a line for each of its entries, as JSON."""
    return convert.summary_lines(_packages(spark, sf_dir))


# ---- texts and reports


_BOOK_TEXT = "CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') WHEN doc_id % 7 = 1 THEN '{\"content\": [' || doc_id END"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents WHERE doc_id % 7 > 1),
c AS (SELECT doc_id, i, CASE WHEN doc_id % 3 = 0 THEN '' WHEN i % 2 = 0 THEN ' Chapter ' || chr(10) || i ELSE '' END AS t, {_TRIM.format("translate(line, chr(160) || chr(8201) || chr(8202), '   ')")} AS b FROM l),
n AS (SELECT doc_id, bool_or(t <> '') AS named, string_agg('# ' || CASE WHEN t = '' THEN left(b, 80) ELSE 'Chapter ' || i END || chr(10) || chr(10) || b, chr(10) || chr(10) ORDER BY i) AS a, string_agg(b, chr(10) || chr(10) ORDER BY i) FILTER (WHERE b <> '') AS p FROM c GROUP BY 1)
SELECT doc_id, md5(CASE WHEN doc_id % 7 <= 1 THEN {_BOOK_TEXT} WHEN named THEN a ELSE coalesce(p, '') END) AS markdown_md5 FROM documents LEFT JOIN n USING (doc_id)"""
)
def json_books(spark, sf_dir):
    """JSON books as markdown: chapters with titles, with some, or with none; plain texts and broken JSON as they are."""
    d = _t(spark, sf_dir, "documents")
    k = F.col("doc_id")
    chapters = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(F.when((k % 3 == 0) | (i % 2 == 0), F.lit(None)).otherwise(F.concat(F.lit(" Chapter \n"), (i + 1).cast("string"))).alias("chapter-title"), x.alias("chapter-content")))
    raw = F.when(k % 7 == 0, F.coalesce("text", F.lit(""))).when(k % 7 == 1, F.concat(F.lit('{"content": ['), k.cast("string"))).otherwise(F.to_json(F.struct(chapters.alias("content"))))
    return d.select("doc_id", F.md5(texts.json_book(raw)).alias("markdown_md5"))


@query(
    """WITH t AS (SELECT conv_id, string_agg(text, '|' ORDER BY turn, role, text) AS body, count(*) AS n FROM conversations GROUP BY 1)
SELECT 'k' || conv_id AS cache_key, conv_id % 5 <> 0 AND conv_id % 7 <> 0 AS hit, CASE WHEN conv_id % 5 <> 0 AND conv_id % 7 <> 0 THEN n END::INT AS segments, CASE WHEN conv_id % 5 <> 0 AND conv_id % 7 <> 0 THEN md5(body) END AS text_md5 FROM t"""
)
def cached_transcripts(spark, sf_dir):
    """Transcripts that a cache knows, and those that must be made: its entries are of this version, of another, or broken."""
    c = _t(spark, sf_dir, "conversations").where("text IS NOT NULL")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["turn"].cast("double").alias("start"), (x["turn"] + 1).cast("double").alias("end"), x["text"].alias("text"), F.array().cast("array<struct<start: double, end: double, text: string>>").alias("words")))
    rows = c.groupBy("conv_id").agg(listed.alias("segments")).select("conv_id", F.concat(F.lit("k"), _s("conv_id")).alias("cache_key"), F.lit("a").alias("audio_sha256"), F.lit("m").alias("model_sha256"), F.lit("en").alias("language"), "segments")
    entries = texts.cache_json(rows).withColumn("i", F.substring("cache_key", 2, 20).cast("long"))
    stored = F.when(F.col("i") % 7 == 0, F.substring(F.col("json"), 1, 40)).when(F.col("i") % 5 == 0, F.replace("json", F.lit('"schema_version":1'), F.lit('"schema_version":2'))).otherwise(F.col("json"))
    cache = texts.cached(entries.select(stored.alias("json")))
    hits = cache.select("cache_key", F.lit(True).alias("hit"), F.size("segments").alias("segments"), F.md5(F.array_join(F.transform("segments", lambda s: s["text"]), "|")).alias("text_md5"))
    missing = texts.cache_misses(rows.select("cache_key"), cache).select("cache_key", F.lit(False).alias("hit"), F.lit(None).cast("int").alias("segments"), F.lit(None).cast("string").alias("text_md5"))
    return hits.unionByName(missing)


def _checker_reports(spark, sf_dir) -> DataFrame:
    """book_id and json: a checker's report for each user, an issue an event."""
    e = _t(spark, sf_dir, "events").where("event_id % 4 <> 3")
    place = F.when(F.col("event_id") % 4 == 0, F.array(F.struct(F.lit("p.xhtml").alias("path"), F.col("event_id").alias("line"), F.lit(2).alias("column")), F.struct(F.lit("q").alias("path"), F.lit(1).cast("long").alias("line"), F.lit(1).alias("column")))).when(F.col("event_id") % 4 == 1, F.array(F.struct(F.lit("r.opf").alias("path"), F.lit(-1).cast("long").alias("line"), F.lit(-1).alias("column"))))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "Warning").when(F.col("event_type") == "purchase", "FATAL").when(F.col("event_type") == "view", "INFO").otherwise("odd")
    messages = F.sort_array(F.collect_list(F.struct(F.concat(F.lit("E-"), _s(F.col("event_id"))).alias("ID"), level.alias("severity"), F.concat(F.lit('says "'), "event_type", F.lit('"')).alias("message"), place.alias("locations"))))
    return e.groupBy(F.col("user_id").alias("book_id")).agg(F.to_json(F.struct(messages.alias("messages"))).alias("json"))


_ISSUES = """WITH n AS (SELECT user_id AS book_id, 'epubcheck' AS backend, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'purchase' THEN 'fatal' WHEN 'view' THEN 'info' ELSE 'error' END AS severity, 'E-' || event_id AS issue_id,
  'says "' || event_type || '"' AS message, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id > 0 THEN 'p.xhtml:' || event_id || ':2' ELSE 'p.xhtml' END WHEN 1 THEN 'r.opf' END AS location FROM events WHERE event_id % 4 <> 3)"""


@query(f"{_ISSUES} SELECT *, upper(severity) || ' ' || issue_id || ' ' || message || CASE WHEN location IS NULL THEN '' ELSE ' (' || location || ')' END AS line FROM n")
def checker_issues(spark, sf_dir):
    """Issues of checker reports with the first place of each, and as lines of text."""
    return texts.epubcheck_issues(_checker_reports(spark, sf_dir)).withColumn("line", package.report_text())


@query(
    f"""{_ISSUES}, s AS (SELECT book_id, count(*) FILTER (WHERE severity = 'fatal') AS fatals, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos,
  string_agg('{{"severity":"' || severity || '","backend":"epubcheck","id":"' || issue_id || '","message":"' || replace(message, '"', chr(92) || '"') || '"' || CASE WHEN location IS NULL THEN '' ELSE ',"location":"' || location || '"' END || '}}', ',' ORDER BY list_position(['fatal', 'error', 'warning', 'info', 'usage'], severity), message, issue_id) AS issues FROM n GROUP BY 1)
SELECT book_id, '{{"fatals":' || fatals || ',"errors":' || errors || ',"warnings":' || warnings || ',"infos":' || infos || ',"clean":' || (fatals + errors = 0) || ',"issues":[' || issues || ']}}' AS json FROM s"""
)
def checker_reports(spark, sf_dir):
    """Whole reports as JSON: counters, whether clean, and the issues by severity."""
    issues = texts.epubcheck_issues(_checker_reports(spark, sf_dir))
    return package.report_json(aggregates.issue_summary(issues, ["book_id"], F.col("severity")), issues, "book_id")


@query(
    """WITH e AS (SELECT *, event_id % 5 AS m FROM events)
SELECT user_id AS book_id, 'ace' AS backend, CASE WHEN m IN (0, 1) THEN 'error' ELSE 'warning' END AS severity, 'rule-' || event_type AS issue_id, 'event ' || event_id AS message, 'c' || event_id % 3 || '.xhtml' AS location FROM e WHERE m < 3"""
)
def accessibility_issues(spark, sf_dir):
    """Failed and undecided checks of accessibility reports."""
    e = _t(spark, sf_dir, "events")
    i = F.col("event_id")
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("fail", "earl:failed", "earl:cantTell", "pass", "inapplicable")]), (i % 5 + 1).cast("int"))
    check = F.struct(F.struct(F.concat(F.lit("rule-"), "event_type").alias("dct:title")).alias("earl:test"), F.struct(outcome.alias("earl:outcome"), F.concat(F.lit("event "), _s(i)).alias("dct:description")).alias("earl:result"))
    subject = F.struct(F.concat(F.lit("c"), _s(i % 3), F.lit(".xhtml")).alias("url"))
    grouped = e.groupBy("user_id", (i % 3).alias("s")).agg(F.min(subject).alias("earl:testSubject"), F.collect_list(check).alias("assertions"))
    reports = grouped.groupBy(F.col("user_id").alias("book_id")).agg(F.collect_list(F.struct("earl:testSubject", "assertions")).alias("assertions"))
    return texts.ace_issues(reports.select("book_id", F.to_json(F.struct("assertions")).alias("json")))


@query(
    """WITH k AS (SELECT s_nationkey AS book_id, s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'isbn' ELSE 'title' END AS way, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 6 = 0 ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier),
u AS (SELECT *, CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey END AS cover_id FROM k),
f AS (SELECT * FROM u WHERE cover_id IS NOT NULL AND (way = 'isbn' OR (s_suppkey % 3 <> 2 AND s_suppkey % 2 = 0)))
SELECT book_id, arg_min(cover_id, (way <> 'isbn', rank)) AS cover_id FROM f GROUP BY 1"""
)
def cover_pick(spark, sf_dir):
    """The cover that a book's ISBN finds, else the first by title with the language and the author's last name."""
    s = _t(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    by = F.when(k % 6 == 0, "isbn").otherwise("title")
    w = Window.partitionBy("s_nationkey", by).orderBy(F.desc("s_acctbal"), "s_suppkey")
    language = F.when(k % 3 == 0, F.array(F.lit("fre"), F.lit("eng"))).when(k % 3 == 1, F.array(F.lit("en"))).otherwise(F.array(F.lit("ger")))
    author = F.when(k % 2 == 0, F.array(F.lit("X. Y."), F.lit("Ann LAKE"))).otherwise(F.array(F.lit("Bo Sea")))
    rows = s.select(F.col("s_nationkey").alias("book_id"), by.alias("by"), F.row_number().over(w).alias("rank"), F.when(k % 4 != 1, k).alias("cover_id"), language.alias("language"), author.alias("author_name"))
    return texts.cover_choice(rows, F.lit("eng"), F.lit("Ann Lake"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' END AS kind, c_custkey % 4 < 2 AS usable FROM customer")
def cover_kinds(spark, sf_dir):
    """Kinds of images by their first bytes."""
    k = F.col("c_custkey")
    body = F.encode("c_name", "UTF-8")
    head = F.when(k % 4 == 0, F.lit(b"\xff\xd8\xff")).when(k % 4 == 1, F.lit(b"\x89PNG\r\n\x1a\n")).when(k % 4 == 2, F.lit(b"\x89PNG\r\n")).otherwise(F.lit(b""))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", text.image_kind(F.concat(head, body)).alias("kind"))
    return rows.withColumn("usable", F.col("kind").isNotNull())
