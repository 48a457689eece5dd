"""Scalar text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that are cut from both ends of a word.
STRIPPED = ".,;:!?…\"“”'‘’()[]{}«»‹›—–"
# Signs that stay with the word before them.
ATTACHING = ".,!?;:…)]}\"'»“”‘’"
# Ends of sentences, and signs that may follow them.
TERMINATORS, CLOSERS = ".!?…", "\"')]"
# Abbreviations; a full stop after a run of letters that ends in one doesn't end a sentence.
ABBREVIATIONS = "dr mr mrs ms drs ir ing prof dhr mw jr sr st nr blz bv bijv enz etc i.e e.g o.a nl vs incl excl tel".split()


def char_class(signs: str) -> str:
    return "".join("\\" + s if s in "[]\\^-&" else s for s in signs)


_EDGE = f"[{char_class(STRIPPED)}\\s\\x{{A0}}]"
_SPACE = "(?U)\\s"


def unicode_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"{_SPACE}+$|(?U)^\\s+", "")


def words_of(c: Column) -> Column:
    """Whitespace-separated words, blank ones dropped; null text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "(?U)\\s+"), lambda w: w != "")


def normalise_word(c: Column) -> Column:
    """A word without the signs and blanks around it, in lower case."""
    return F.lower(F.regexp_replace(c, f"(?U)^{_EDGE}+|{_EDGE}+$", ""))


def normalise_heading(c: Column) -> Column:
    """A heading without leading numbering, its words normalised."""
    body = unicode_trim(F.regexp_replace(unicode_trim(c), "^[0-9.)]+", ""))
    return F.array_join(F.filter(F.transform(words_of(body), normalise_word), lambda w: w != ""), " ")


def normalise_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\n\\r\\t\\x{A0} ]+", " "))


def body_lines(c: Column) -> Column:
    """The non-blank lines of a body, odd blanks made plain."""
    plain = F.translate(F.coalesce(c, F.lit("")), "\u00a0\u2009\u200a", "   ")
    return F.filter(F.transform(F.split(plain, "\\r?\\n"), unicode_trim), lambda x: x != "")


def normalise_body(c: Column, separator: str = "\n\n") -> Column:
    """Each non-blank line as a paragraph of its own."""
    return F.array_join(body_lines(c), separator)


def ends_sentence(c: Column) -> Column:
    """Whether a text ends a sentence: not after a digit, nor after a known abbreviation."""
    core = F.regexp_replace(c, f"[{char_class(CLOSERS)}]+$", "")
    tail = F.lower(F.regexp_extract(core, "([\\p{L}.]*)\\.$", 1))
    short = F.lit(False)
    for a in ABBREVIATIONS:
        short = short | tail.endswith(a)
    stop = core.rlike("\\.$") & ~core.rlike("[0-9]\\.$") & ~short
    return F.coalesce(core.rlike("[!?…]$") | stop, F.lit(False))


def capitalise_first(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    return F.when(first.rlike("^\\p{Ll}"), F.concat(F.upper(first), F.substring(c, 2, 1 << 30))).otherwise(c)


def is_attaching(c: Column) -> Column:
    return c.rlike(f"^[{char_class(ATTACHING)}]+$")


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attr(c: Column) -> Column:
    return F.replace(escape_text(c), F.lit('"'), F.lit("&quot;"))


def file_basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def rewrite_href(c: Column) -> Column:
    """x.smil#a becomes content/x.xhtml#a, split at the first #."""
    file = F.regexp_replace(F.substring_index(c, "#", 1), "\\.[sS][mM][iI][lL]$", "")
    anchor = F.regexp_extract(c, "^[^#]*(#.*)$", 1)
    return F.concat(F.lit("content/"), file, F.lit(".xhtml"), anchor)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "\\.([^./]*)$", 1))


def media_type(c: Column) -> Column:
    e = extension(c)
    return F.when(e == "mp3", "audio/mpeg").when(e.isin("m4a", "mp4"), "audio/mp4").when(e.isin("opus", "ogg"), "audio/ogg").otherwise("application/octet-stream")


def swap_extension(c: Column, new: str) -> Column:
    """a.mp3 becomes a.<new>; any extension is replaced, none is added to."""
    return F.when(c.rlike("\\.[^./]+$"), F.regexp_replace(c, "\\.[^./]+$", f".{new}")).otherwise(F.concat(c, F.lit(f".{new}")))


def overlay_text_source(document: Column, anchor: Column) -> Column:
    return F.when(F.coalesce(anchor, F.lit("")) == "", document).otherwise(F.concat(document, F.lit("#"), anchor))


def section_id(c: Column, number: Column) -> Column:
    """An id that XML accepts: section-001 for none, s- before a digit."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.concat(F.lit("section-"), F.lpad(number.cast("string"), 3, "0"))).when(c.rlike("^[0-9]"), F.concat(F.lit("s-"), c)).otherwise(c)


def heading_label(text: Column, identifier: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("Heading "), identifier)).otherwise(text)


def extract_isbn(c: Column) -> Column:
    """The ISBN of 10 or 13 signs in an identifier, hyphens and blanks dropped; null for others. No checksum."""
    bare = F.regexp_replace(c, "(?U)[\\s-]", "")
    return F.when(bare.rlike("^([0-9]{9}|[0-9]{12})[0-9X]$"), bare)


def last_name(c: Column) -> Column:
    words = words_of(c)
    return F.when(F.size(words) > 0, F.element_at(words, -1))


def declared_encoding(head: Column) -> Column:
    """The quoted value after encoding=."""
    return F.nullif(F.lower(F.regexp_extract(head, "encoding=[\"']([^\"']*)[\"']", 1)), F.lit(""))


def decode_declared(content: Column) -> Column:
    """Bytes as text: Latin-1 where the first 256 bytes declare windows-1252 or latin1, else UTF-8."""
    name = declared_encoding(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    legacy = F.coalesce(name.isin("windows-1252", "cp1252", "iso-8859-1", "latin1"), F.lit(False))
    return F.when(legacy, F.decode(content, "ISO-8859-1")).otherwise(F.decode(content, "UTF-8"))


def cache_key(audio: Column, model: Column, language: Column, version: int = 1) -> Column:
    """32 hex letters of the SHA-256 over audio, model, language (each with a zero byte) and the version's four bytes."""
    zero = F.lit(b"\x00")
    data = F.concat(audio.cast("binary"), zero, model.cast("binary"), zero, language.cast("binary"), zero, F.lit(version.to_bytes(4, "little")))
    return F.substring(F.sha2(data, 256), 1, 32)


def image_kind(content: Column) -> Column:
    """jpeg or png by the first bytes, else null."""
    return F.when(F.substring(content, 1, 3) == F.lit(b"\xff\xd8\xff"), "jpeg").when(F.substring(content, 1, 8) == F.lit(b"\x89PNG\r\n\x1a\n"), "png")


def format_bytes(c: Column) -> Column:
    """Bytes for people: whole bytes, else one decimal of KiB, MiB or GiB."""
    parts = F.lit(None).cast("string")
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        tenths = F.floor(c * 10 / float(1024**power) + 0.5)
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        parts = F.coalesce(parts, F.when(c >= 1024**power, text))
    return F.coalesce(parts, F.concat(c.cast("string"), F.lit(" B")))


def severity(c: Column) -> Column:
    """fatal, error, warning, info or usage; what isn't known is an error."""
    low = F.lower(c)
    return F.when(low.isin("fatal", "error", "warning", "info", "usage"), low).otherwise("error")
