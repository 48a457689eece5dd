"""Talking books as tables: navigation files, master and section SMIL files found under a folder.

Files are read by Spark's binaryFile source and parsed side by side, a file per row; a book whose files are missing or
broken becomes a row with an error, and the others go on.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text
from quire.operators import aggregates
from quire.operators.scratch import written

_TYPED = {"dc:title": "title", "dc:creator": "creator", "dc:publisher": "publisher", "dc:date": "date", "dc:language": "language", "dc:identifier": "identifier", "dc:format": "format", "dc:source": "source", "dc:subject": "subject", "ncc:charset": "charset", "ncc:multimediatype": "multimedia_type", "ncc:narrator": "narrator", "ncc:totaltime": "total_time"}
_NUMBERS = {"ncc:depth": "depth", "ncc:tocitems": "toc_items", "ncc:pagenormal": "page_normal", "ncc:files": "files", "ncc:kbytesize": "kbyte_size"}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, dir, name, content of every navigation and SMIL file under root; files that can't be read are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    files = reader.option("pathGlobFilter", "*.{[hH][tT][mM][lL],[sS][mM][iI][lL]}").load(root)
    return files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), text.file_basename(F.col("path")).alias("name"), "content")


def navigation_files(files: DataFrame) -> DataFrame:
    """One ncc.html per folder, the lower-case name preferred over other spellings."""
    found = files.where(F.lower("name") == "ncc.html")
    w = Window.partitionBy("dir").orderBy((F.col("name") != "ncc.html").cast("int"), "name")
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(F.col("dir").alias("book_id"), F.col("path").alias("root"), text.decode_declared(F.col("content")).alias("markup"))


_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))


class _Ncc(HTMLParser):
    def __init__(self):
        super().__init__()
        self.meta: list[tuple[str, str]] = []
        self.nav: list[dict] = []
        self.head = self.anchor = False
        self.open: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "head":
            self.head = True
        elif tag == "meta" and self.head and a.get("name") is not None and a.get("content") is not None:
            self.meta.append((a["name"], a["content"]))
        elif tag in _HEADINGS:
            self.open = {"kind": "heading", "level": int(tag[1]), "class": a.get("class"), "item_id": a.get("id") or "", "text": "", "href": ""}
        elif tag == "span" and (a.get("class") or "").startswith("page-"):
            self.open = {"kind": "page", "level": None, "class": a["class"], "item_id": a.get("id") or "", "text": "", "href": ""}
        elif tag == "a":
            self.anchor = True
            if self.open is not None:
                self.open["href"] = a.get("href") or ""

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif tag == "a":
            self.anchor = False
        elif self.open is not None and (tag == "span") == (self.open["kind"] == "page") and (tag == "span" or tag in _HEADINGS):
            self.open["text"] = self.open["text"].strip()
            self.nav.append(self.open)
            self.open = None

    def handle_data(self, data):
        if self.anchor and self.open is not None:
            self.open["text"] += data


def parse_ncc(markup: str) -> _Ncc:
    parser = _Ncc()
    tags = plain_tags(markup or "")
    if tags is None:
        parser.feed(markup or "")
        parser.close()
        return parser
    for end, name, attributes, empty, behind in tags:
        if end:
            parser.handle_endtag(name)
        elif name:
            parser.handle_starttag(name, attributes)
            if empty:
                parser.handle_endtag(name)
        if behind and parser.anchor and parser.open is not None:
            parser.handle_data(unescape(behind))
    return parser


_NCC_ROWS = "book_id string, ord int, kind string, level int, class string, item_id string, text string, href string"


def ncc_rows(ncc: DataFrame) -> DataFrame:
    """Metas (kind meta: item_id the name, text the content) and navigation items in document order."""

    def run(batches):
        schema = _arrow_schema(_NCC_ROWS)
        for batch in batches:
            out: list[tuple] = []
            for book, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parsed = parse_ncc(markup)
                out += [(book, k, "meta", None, None, n, c, None) for k, (n, c) in enumerate(parsed.meta)]
                out += [(book, k, *item.values()) for k, item in enumerate(parsed.nav)]
                if len(out) > _OUT:
                    yield _arrow_rows(out, schema)
                    out = []
            if out:
                yield _arrow_rows(out, schema)

    return ncc.select("book_id", "markup").mapInArrow(run, _NCC_ROWS)


def books(ncc: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per book: typed metadata (the last of a name wins, numbers that don't parse are null), the rest as a map."""
    meta = rows.where("kind = 'meta'").select("book_id", "ord", F.lower("item_id").alias("name"), F.col("item_id").alias("own"), F.col("text").alias("value"))
    one = lambda n: F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("ord")))
    typed = [one(n).alias(c) for n, c in _TYPED.items()]
    typed += [F.when(one(n).rlike("^[+]?[0-9]+$"), one(n).try_cast("long")).alias(c) for n, c in _NUMBERS.items()]
    rest = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("_last"), F.struct("own", "value"))))).alias("other")
    unknown = ~F.col("name").isin(*_TYPED, *_NUMBERS)
    last = F.row_number().over(Window.partitionBy("book_id", "own").orderBy(F.desc("ord"))) == 1
    grouped = meta.withColumn("_last", unknown & last).groupBy("book_id").agg(*typed, rest)
    counts = rows.groupBy("book_id").agg(F.count_if(F.col("kind") == "heading").alias("n_headings"), F.count_if(F.col("kind") == "page").alias("n_pages"))
    joined = ncc.select("book_id", "root").join(grouped, "book_id", "left").join(counts, "book_id", "left")
    empty = (F.coalesce("n_headings", F.lit(0)) + F.coalesce("n_pages", F.lit(0)) == 0) & F.col("title").isNull()
    return joined.withColumn("error", F.when(empty, "neither navigation nor title"))


#: Elements that the patterns below may tell; what HTMLParser reads otherwise (scripts, titles, comments) is left to it.
_PLAIN = frozenset("smil head body meta ref seq par text audio img layout region html h1 h2 h3 h4 h5 h6 span a div p".split())
_BLANK = "[ \\t\\n\\r\\f]"
_TAG = re.compile(f"(?:(/?)([a-zA-Z][a-zA-Z0-9]*)((?:{_BLANK}+[a-zA-Z][a-zA-Z0-9:_.-]*=(?:\"[^\"<>&]*\"|'[^'<>&]*'))*){_BLANK}*(/?)>|[?][^<>]*>|![dD][oO][cC][tT][yY][pP][eE]{_BLANK}[^<>]*>)([^<]*)")
_ATTRIBUTE = re.compile("([a-zA-Z][a-zA-Z0-9:_.-]*)=(?:\"([^\"]*)\"|'([^']*)')")


@lru_cache(maxsize=1 << 14)
def _tag(piece: str) -> tuple[str, str, dict[str, str], str, str] | None:
    """A tag without its first sign and the text behind it, as plain_tags() gives it; not to be changed."""
    m = _TAG.fullmatch(piece)
    if m is None:
        return None
    end, name, raw, empty, behind = m.groups("")
    if name and name.lower() not in _PLAIN or end and (raw or empty):
        return None
    return end, name.lower(), {n.lower(): x or y for n, x, y in _ATTRIBUTE.findall(raw)}, empty, behind


def plain_tags(markup: str) -> list[tuple[str, str, dict[str, str], str, str]] | None:
    """(/ of an end tag, name, attributes, / of an empty element, text behind) of every tag, as HTMLParser has them; None
    if there is anything that a pattern may read in another way."""
    pieces = markup.split("<")
    tags = list(map(_tag, pieces[1:]))
    return None if None in tags else tags


class _Events(HTMLParser):
    """Tags of any markup, as plain_tags() gives them, without text."""

    def __init__(self):
        super().__init__()
        self.events: list[tuple[str, str, dict, str, str]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("", tag, dict(attrs), "", ""))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("", tag, dict(attrs), "/", ""))

    def handle_endtag(self, tag):
        self.events.append(("/", tag, {}, "", ""))


def _smil_events(markup: str) -> list[tuple[str, str, dict, str, str]]:
    tags = plain_tags(markup)
    if tags is not None:
        return tags
    parser = _Events()
    parser.feed(markup)
    parser.close()
    return parser.events


_NODE = "node_id parent_id depth kind id src dur endsync clip_begin clip_end".split()


def clip_of(a: dict) -> tuple[str | None, str | None]:
    """Begin and end of a clip, by its attributes."""
    return a.get("clip-begin", a.get("clipbegin")), a.get("clip-end", a.get("clipend"))


class _Smil:
    """Elements of a SMIL file in document order; a par in a par is left out, elements may be closed either way.

    found: nodes as (node, parent, depth, tag, attributes, the par that an audio is in: the last par before it, if no node
    since is as high).
    """

    def __init__(self, markup: str):
        self.meta: list[tuple[str, str]] = []
        self.refs: list[tuple[str, str, str]] = []
        self.found: list[tuple] = []
        rows, stack, parents, body = self.found, [], [], False  # stack: (tag, whether it is a node); parents: open nodes
        last = depth_of_last = out = -1
        for end, tag, a, empty, _ in _smil_events(markup):
            if end:
                if tag == "body":
                    body = False
                elif stack and stack[-1][0] == tag and stack.pop()[1]:
                    parents.pop()
                continue
            if tag == "body":
                body = True
            elif tag == "meta":
                if not body and a.get("name") is not None:
                    self.meta.append((a["name"], a.get("content") or ""))
            elif tag == "ref":
                self.refs.append((a.get("id") or "", a.get("title") or "", a.get("src") or ""))
            elif body and (tag in ("seq", "par") or stack and (tag == "audio" or tag == "text" and stack[-1][0] == "par")):
                group = tag in ("seq", "par")
                kept = not (tag == "par" and stack and stack[-1][0] == "par")
                if kept:
                    k, depth = len(rows), len(parents)
                    if tag == "par":
                        last, depth_of_last = k, depth
                    elif last >= 0 and depth <= depth_of_last:
                        out = k
                    inside = last if tag == "audio" and last > out else None
                    rows.append((k, parents[-1] if parents else None, depth, tag, a, inside))
                if group:
                    stack.append((tag, kept))
                    if kept:
                        parents.append(k)
            if empty and tag in ("seq", "par") and stack and stack[-1][0] == tag and stack.pop()[1]:
                parents.pop()

    @property
    def rows(self) -> list[tuple]:
        """Nodes as tuples of _NODE and the par that an audio is in."""
        return [(k, parent, depth, tag, a.get("id"), a.get("src"), a.get("dur"), a.get("endsync"), *clip_of(a), inside) for k, parent, depth, tag, a, inside in self.found]

    @property
    def nodes(self) -> list[dict]:
        return [dict(zip(_NODE, r, strict=False)) for r in self.rows]


def parse_smil(markup: str) -> _Smil:
    return _Smil(markup or "")


_SMIL_ROWS = "dir string, name string, ord int, kind string, parent_id int, depth int, id string, src string, title string, dur string, endsync string, clip_begin string, clip_end string"
_SMIL_PLACES = "section_idx int, par_ord int"
#: Rows that a parser's task gives out at once.
_OUT = 50_000


def _arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow_schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in fields.split(", "))])


def smil_rows(files: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Nodes (seq, par, text, audio), refs and metas (id the name, title the content) of every SMIL file.

    places: dir, name and sections, an array of the sections that a file is; then rows also have section_idx, a node for
    each of its sections, and par_ord, the par that an audio is in.
    """
    placed = places is not None
    fields = f"{_SMIL_ROWS}, {_SMIL_PLACES}" if placed else _SMIL_ROWS

    def run(batches):
        schema = _arrow_schema(fields)
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for folder, name, markup, *own in zip(*columns, strict=True):
                parsed = parse_smil(markup)
                end = (None, None) if placed else ()
                for k, (n, c) in enumerate(parsed.meta):
                    out.append((folder, name, k, "meta", None, None, n, None, c, None, None, None, None, *end))
                for k, (i, t, s) in enumerate(parsed.refs):
                    out.append((folder, name, k, "ref", None, None, i, s, t, None, None, None, None, *end))
                for section in (own[0] or (None,)) if own else (None,):
                    for k, parent, depth, kind, ident, src, dur, sync, begin, till, par in parsed.rows:
                        end = (section, par) if placed else ()
                        out.append((folder, name, k, kind, parent, depth, ident, src, None, dur, sync, begin, till, *end))
                if len(out) > _OUT:
                    yield _arrow_rows(out, schema)
                    out = []
            if out:
                yield _arrow_rows(out, schema)

    smil = files.where(F.lower("name").endswith(".smil")).select("dir", "name", text.decode_declared(F.col("content")).alias("markup"))
    if placed:
        smil = smil.join(places, ["dir", "name"], "left").select("dir", "name", "markup", "sections")
    return smil.mapInArrow(run, fields)


_CLIP_ROWS = "book_id string, section_idx int, par_ord int, clip_ord int, src string, clip_begin string, clip_end string"


def _clip_rows(files: DataFrame, places: DataFrame) -> DataFrame:
    """The clips of smil_rows() alone, for plans that read them alone."""

    def run(batches):
        schema = _arrow_schema(_CLIP_ROWS)
        for batch in batches:
            out: list[tuple] = []
            for folder, markup, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = [r for r in parse_smil(markup).rows if r[3] == "audio"]
                out += [(folder, section, r[10], r[0], r[5], r[8], r[9]) for section in own for r in rows]
                if len(out) > _OUT:
                    yield _arrow_rows(out, schema)
                    out = []
            if out:
                yield _arrow_rows(out, schema)

    smil = files.where(F.lower("name").endswith(".smil")).select("dir", "name", text.decode_declared(F.col("content")).alias("markup"))
    return smil.join(places, ["dir", "name"]).select("dir", "markup", "sections").mapInArrow(run, _CLIP_ROWS)


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of all books under root: books, nav_items, section_refs, smil_nodes, smil_meta, clips."""
    return tables_of(scan(spark, root))


def tables_of(files: DataFrame, stored: bool = False) -> dict[str, DataFrame]:
    """load() for files that are rows: path, dir, name, content.

    stored: parses every file once, now, into tables of the shared folder; for plans that read many of the tables.
    """
    from quire.functions.clock import parse_clock_value

    ncc = navigation_files(files)
    rows, masters = ncc_rows(ncc), smil_rows(files.where("lower(name) = 'master.smil'"))
    if stored:
        rows, masters = written(rows, "navigation"), written(masters, "masters")
    refs = masters.where("kind = 'ref'").select(F.col("dir").alias("book_id"), (F.col("ord") + 1).alias("section_idx"), F.col("id").alias("ref_id"), "title", "src")
    # files are told their sections before they are parsed, so that no node is dealt out for it
    places = refs.groupBy(F.col("book_id").alias("dir"), F.col("src").alias("name")).agg(F.sort_array(F.collect_list("section_idx")).alias("sections"))
    parsed = smil_rows(files, places)
    if stored:
        parsed = written(parsed, "smil")
    present = files.select(F.col("dir").alias("book_id"), F.col("name").alias("src"), F.lit(True).alias("_there"))
    missing = refs.join(present, ["book_id", "src"], "left").groupBy("book_id").agg(F.min_by("src", F.when(F.col("_there").isNull(), F.col("section_idx"))).alias("_gone"), F.count_if(F.col("_there").isNull()).alias("_n"))
    master = files.where(F.lower("name") == "master.smil").select(F.col("dir").alias("book_id"), F.lit(True).alias("_master")).distinct()
    book = books(ncc, rows).join(missing, "book_id", "left").join(master, "book_id", "left")
    error = F.coalesce("error", F.when(F.col("_master").isNull(), "master.smil is missing"), F.when(F.col("_n") > 0, F.concat("_gone", F.lit(" is missing"))))
    book = book.withColumn("error", error).drop("_gone", "_n", "_master")
    seconds = lambda c: F.coalesce(parse_clock_value(F.col(c)), F.lit(0.0))
    nodes = parsed.where("section_idx IS NOT NULL").withColumn("book_id", F.col("dir"))
    clips = nodes.where("kind = 'audio'").withColumn("clip_ord", F.col("ord")) if stored else _clip_rows(files, places)
    clips = clips.select("book_id", "section_idx", "par_ord", "clip_ord", "src", seconds("clip_begin").alias("clip_begin"), seconds("clip_end").alias("clip_end"))
    nodes = nodes.select("book_id", "section_idx", F.col("ord").alias("node_id"), "parent_id", "depth", "ord", "kind", "id", "src", parse_clock_value(F.col("dur")).alias("dur"), "endsync", seconds("clip_begin").alias("clip_begin"), seconds("clip_end").alias("clip_end"))
    meta = parsed.where("kind = 'meta'").select(F.col("dir").alias("book_id"), "name", "ord", F.col("id").alias("meta"), F.col("title").alias("content"))
    return {"books": book, "nav_items": rows.where("kind <> 'meta'"), "section_refs": refs, "smil_nodes": nodes, "smil_meta": meta, "clips": clips}


def smil_meta_value(meta: DataFrame, name: str) -> DataFrame:
    """The first content of a meta in each file."""
    return meta.where(F.col("meta") == name).groupBy("book_id", "name").agg(F.min_by("content", "ord").alias("value"))


def book_info(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per book: title, headings by level, pages, sections, pars, clips, seconds and audio files as first heard."""
    clips = tables["clips"]
    place = clips.withColumn("place", F.col("section_idx").cast("long") * 1_000_000_000 + F.col("clip_ord"))
    totals = aggregates.clip_totals(clips.withColumnsRenamed({"clip_begin": "b", "clip_end": "e"}), ["book_id"], "b", "e")
    order = aggregates.first_seen_list(place, ["book_id"], "src", "place")
    levels = aggregates.level_histogram(tables["nav_items"].where("kind = 'heading'"), ["book_id"], "level")
    pars = tables["smil_nodes"].groupBy("book_id").agg(F.count_if(F.col("kind") == "par").alias("pars"), F.count_distinct("section_idx").alias("sections"))
    out = tables["books"].select("book_id", "title", "language", "n_pages", "error")
    for part in (totals, order, levels, pars):
        out = out.join(part, "book_id", "left")
    return out


def _head(metas: list[tuple[str, str]]) -> str:
    from html import escape

    return "<head>" + "".join(f'<meta name="{escape(n)}" content="{escape(c)}"/>' for n, c in metas) + "</head>"


def write_master(refs: list[tuple[str, str, str]], metas: list[tuple[str, str]] = ()) -> str:
    """A master file of refs (id, title, src) and metas; parsing it gives the same refs and metas."""
    from html import escape

    body = "".join(f'<ref title="{escape(title)}" src="{escape(src)}" id="{escape(ident)}"/>' for ident, title, src in refs)
    return f'<?xml version="1.0" encoding="utf-8"?>\n<smil>{_head(metas)}<body>{body}</body></smil>'


def write_smil(nodes: list[dict], metas: list[tuple[str, str]] = ()) -> str:
    """A section's nodes and metas as SMIL; parsing it gives the same nodes and metas."""
    from html import escape

    children: dict = {}
    for n in nodes:
        children.setdefault(n["parent_id"], []).append(n)

    def one(n: dict) -> str:
        names = {"clip_begin": "clip-begin", "clip_end": "clip-end"}
        attrs = "".join(f' {names.get(k, k)}="{escape(str(n[k]))}"' for k in ("id", "src", "dur", "endsync", "clip_begin", "clip_end") if n.get(k) is not None)
        inner = "".join(map(one, children.get(n["node_id"], [])))
        return f"<{n['kind']}{attrs}>{inner}</{n['kind']}>" if n["kind"] in ("seq", "par") else f"<{n['kind']}{attrs}/>"

    return '<?xml version="1.0" encoding="utf-8"?>\n<smil>' + _head(metas) + "<body>" + "".join(map(one, children.get(None, []))) + "</body></smil>"


def written_smil(rows: DataFrame) -> DataFrame:
    """dir, name and content of every SMIL file whose rows (smil_rows) are given: master files by their refs.

    Rows stream through sorted by file, so a task holds one file's.
    """

    def content(name: str, own: list[dict]) -> str:
        metas = [(r["id"], r["title"]) for r in own if r["kind"] == "meta"]
        if name.lower() == "master.smil":
            return write_master([(r["id"], r["title"], r["src"]) for r in own if r["kind"] == "ref"], metas)
        return write_smil([r | {"node_id": r["ord"]} for r in own if r["kind"] not in ("meta", "ref")], metas)

    def run(batches):
        held: list[dict] = []
        key, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["dir"], r["name"]):
                    if held:
                        out.append((*key, content(key[1], held)))
                    key, held = (r["dir"], r["name"]), []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], ["dir", "name", "content"])
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (*key, content(key[1], held))], ["dir", "name", "content"])

    return rows.repartition("dir", "name").sortWithinPartitions("dir", "name", "ord").mapInArrow(run, "dir string, name string, content string")
