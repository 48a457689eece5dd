"""Media columns: interleaved sequences of text and media references, with payloads resolved by digest.

HTML is parsed into an ordered array of structs: text blocks and media references, each with its position; a figure's
caption goes with its media. Payloads live in a store of (digest, media) rows, addressed by the SHA-256 of the stored
form, so copies share one entry. Resolving explodes the references with their positions, joins them to the store by
digest, and nests them again in order: positions and captions stay aligned, and a reference without a payload stays
with nulls.

Texts become media as 8-bit greyscale images (binary PGM) of 192 samples a row, losslessly; the store's columns are
compressed by Parquet.

Defined results: null html or text is empty; a null or empty text is stored as one row of padding; equal texts have
equal media; a store may hold a digest more than once (tasks don't see each other's) and is made distinct when read;
rows without an id or with equal ids are kept apart; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textkernel as tk
from quire.llm.common import shuffle_partitions, written

#: Samples in a row of an image.
ROW = 192
PAD = 32
_MEDIA = {"img": "src", "audio": "src", "video": "src", "source": "src", "embed": "src"}
_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "tr", "td", "table", "article", "section", "figure", "figcaption", "blockquote", "pre", "nav", "header", "footer"}
_SILENT = {"script", "style", "head", "title", "template", "noscript"}


def padded(data: bytes) -> bytes:
    """data and as many bytes 32 as make a positive multiple of ROW."""
    return data + bytes([PAD]) * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def encode_image(payload: bytes) -> bytes:
    """8-bit greyscale samples as binary PGM, ROW in a row."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def decode_image(media: bytes) -> tuple[int, int, bytes]:
    """(width, height, samples) of a binary PGM of 8-bit samples without comments."""
    magic, size, top, payload = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(payload) != width * height:
        raise ValueError("not a whole 8-bit PGM")
    return width, height, payload


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCK:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        if tag in _MEDIA:
            named = dict(attrs)
            if ref := named.get(_MEDIA[tag]):
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"pos": len(self.items), "kind": "media", "text": None, "ref": ref, "caption": named.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure or ():
                self.items[i]["caption"] = text or self.items[i]["caption"]
            if text and not self.figure:
                self.words.append(text)
            self.caption = None
        if tag == "figure":
            self.figure = None
        if tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.caption if self.caption is not None else self.words).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """The ordered items of a page. A caption before its media in the figure counts too, if it ends after it."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    if parser.caption:
        parser.words.extend(parser.caption)
    parser.flush()
    return parser.items


_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
_ITEM_SQL = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


def interleave(pages: DataFrame, html: str, keep: tuple[str, ...]) -> DataFrame:
    """keep and items, the page's ordered sequence."""

    def parsed(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                items = [parse_sequence(h) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(items, pa.list_(_ITEM))], [*keep, "items"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema], f"items {_ITEM_SQL}"])
    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(parsed, schema)


def digest_of(ref: Column) -> Column:
    """The digest in a reference like media:sha256:<hex>; null for any other."""
    return F.nullif(F.regexp_extract(ref, "^media:sha256:([0-9a-f]{64})$", 1), F.lit(""))


def resolve(sequences: DataFrame, store: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """sequences with items of (pos, kind, text, ref, caption, media); store has digest and other columns, digest once."""
    media = [c for c in store.columns if c != "digest"]
    rows = sequences.withColumn("_row", F.monotonically_increasing_id())
    flat = rows.select(*keep, "_row", F.explode_outer("items").alias("item")).withColumn("digest", digest_of(F.col("item.ref")))
    joined = flat.join(store.select("digest", F.struct(*media).alias("media")), "digest", "left")
    item = F.when(F.col("item").isNotNull(), F.struct("item.pos", "item.kind", "item.text", "item.ref", "item.caption", "media"))
    nested = joined.groupBy("_row", *keep).agg(F.array_sort(F.array_compact(F.collect_list(item)), lambda a, b: a["pos"] - b["pos"]).alias("items"))
    return nested.drop("_row")


def _store(batches):
    """doc_id, n_bytes, a page that shows the document's image, its digest, and the image where the task first meets it."""
    seen: set[bytes] = set()
    for rows, raw, offsets in tk.pieces(batches, "text", 4_000_000):
        data = raw.tobytes()
        ids = rows.column(0).to_pylist()
        out = []
        for k, i in enumerate(ids):
            text = data[offsets[k] : offsets[k + 1]]
            media = encode_image(padded(text))
            digest = hashlib.sha256(media)
            html = f'<article><h1>Document {i}</h1><figure><img src="media:sha256:{digest.hexdigest()}"><figcaption>{len(text)} bytes</figcaption></figure></article>'
            new = digest.digest() not in seen
            if len(seen) > 200_000:
                seen.clear()
            seen.add(digest.digest())
            out.append((i, len(text), html, digest.hexdigest() if new else None, media if new else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))], ["doc_id", "n_bytes", "html", "digest", "media"])


def _features(batches):
    """What is computed from the stored bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            out = []
            for digest, media in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                media = media.as_py()
                width, height, payload = decode_image(media)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                level = int((counts * np.arange(256)).sum())
                feature = f"gray8 {width}x{height} sum {level} kinds {int((counts > 0).sum())} spaces {int(counts[32])} digits {int(counts[48:58].sum())} high {int(counts[128:].sum())}"
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def document_media(docs: DataFrame) -> DataFrame:
    """Stores each document's text as an image, reads the store back, and joins features through interleaved pages."""
    stored = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, html string, digest string, media binary"), "media")
    seen = stored.where("media is not null").select("digest", "media").mapInArrow(_features, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    # a table of its own, so that the join below meets plain shuffles of both sides and may split a digest of many rows
    store = written(seen.dropDuplicates(["digest"]).coalesce(max(1, shuffle_partitions(docs.sparkSession) // 8)), "media-store")
    pages = resolve(interleave(stored, "html", ("doc_id", "n_bytes")), store, ("doc_id", "n_bytes"))
    image = F.expr("filter(items, x -> x.kind = 'media')[0].media")
    return pages.withColumn("image", image).select("doc_id", "n_bytes", "image.payload_bytes", "image.payload_sha256", "image.tail_crc32", "image.media_bytes", "image.media_sha256", "image.feature")
