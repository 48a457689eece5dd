"""True texts, transcripts and reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text

_BOOK = "content array<struct<`chapter-title`: string, `chapter-content`: string>>, _bad string"
VERSION = 1
_CACHE = "schema_version int, cache_key string, audio_sha256 string, model_sha256 string, language string, segments array<struct<start: double, end: double, text: string, words: array<struct<start: double, end: double, text: string>>>>"
_EPUBCHECK = "messages array<struct<ID: string, severity: string, message: string, locations: array<struct<path: string, line: int, column: int>>>>, checker struct<nFatal: long, nError: long, nWarning: long, nUsage: long>"
_ACE = "assertions array<struct<`earl:testSubject`: struct<url: string>, assertions: array<struct<`earl:test`: struct<`dct:title`: string>, `earl:result`: struct<`earl:outcome`: string, `dct:description`: string>>>>>"


def true_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and markdown of whole text files; JSON books become chapters with headings, line ends are \\n."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value")
    return files.withColumn("markdown", json_book(F.replace("value", F.lit("\r\n"), F.lit("\n")))).drop("value")


def json_book(c):
    """A JSON book's chapters as markdown; other text, and JSON that isn't well formed, stays as it is.

    A chapter is a # heading and its paragraphs; one without a title takes up to 80 letters of its first line. If no
    chapter has a title, all are joined without headings. A book without content is empty.
    """
    parsed = F.from_json(c, _BOOK, {"columnNameOfCorruptRecord": "_bad"})
    chapters = F.coalesce(parsed["content"], F.array())
    title = lambda x: text.normalise_title(F.coalesce(x["chapter-title"], F.lit("")))
    body = lambda x: text.normalise_body(x["chapter-content"])
    first = lambda x: F.substring(F.substring_index(body(x), "\n", 1), 1, 80)
    named = F.transform(chapters, lambda x: F.concat(F.lit("# "), F.when(title(x) == "", first(x)).otherwise(title(x)), F.lit("\n\n"), body(x)))
    plain = F.filter(F.transform(chapters, body), lambda b: b != "")
    whole = F.when(F.exists(chapters, lambda x: title(x) != ""), F.array_join(named, "\n\n")).otherwise(F.array_join(plain, "\n\n"))
    return F.when(F.ltrim(c).startswith("{") & parsed["_bad"].isNull(), whole).otherwise(c)


def transcript_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached transcripts of this version under path; broken entries and other versions are misses."""
    return cached(spark.read.option("wholetext", True).text(path).select(F.col("value").alias("json")))


def cached(files: DataFrame) -> DataFrame:
    """transcript_cache() of files that are rows: json, one entry or an entry a line."""
    whole = F.from_json("json", _CACHE)["cache_key"].isNotNull()
    entry = files.select(F.explode(F.when(whole, F.array("json")).otherwise(F.split("json", "\n"))).alias("json"))
    return entry.select(F.from_json("json", _CACHE).alias("e")).select("e.*").where((F.col("schema_version") == VERSION) & F.col("cache_key").isNotNull())


def cache_json(transcripts: DataFrame) -> DataFrame:
    """cache_key and json, the entry of each transcript: cache_key, audio_sha256, model_sha256, language, segments."""
    fields = ["cache_key", "audio_sha256", "model_sha256", "language", "segments"]
    return transcripts.select("cache_key", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), *fields)).alias("json"))


def append_cache(transcripts: DataFrame, path: str) -> None:
    """Adds entries to a cache, a line each; a task's entries appear when its file is whole."""
    cache_json(transcripts).select("json").write.mode("append").text(path)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.select("cache_key"), "cache_key", "left_anti")


def epubcheck_issues(reports: DataFrame) -> DataFrame:
    """book_id, backend, severity, issue_id, message, location (of the first place alone) from EPUBCheck's JSON."""
    rows = reports.select("book_id", F.explode(F.from_json("json", _EPUBCHECK)["messages"]).alias("m"))
    place = F.get("m.locations", F.lit(0))
    where = F.when(place["line"] > 0, F.concat(place["path"], F.lit(":"), place["line"].cast("string"), F.lit(":"), place["column"].cast("string"))).otherwise(place["path"])
    return rows.select("book_id", F.lit("epubcheck").alias("backend"), text.severity(F.col("m.severity")).alias("severity"), F.col("m.ID").alias("issue_id"), F.col("m.message").alias("message"), where.alias("location"))


def ace_issues(reports: DataFrame) -> DataFrame:
    """Failed checks are errors, those that can't tell are warnings, others are none."""
    outer = reports.select("book_id", F.explode(F.from_json("json", _ACE)["assertions"]).alias("a"))
    rows = outer.select("book_id", F.col("a")["earl:testSubject"]["url"].alias("location"), F.explode("a.assertions").alias("x"))
    outcome = F.lower(F.regexp_replace(F.col("x")["earl:result"]["earl:outcome"], "^earl:", ""))
    level = F.when(outcome.isin("fail", "failed"), "error").when(outcome == "canttell", "warning")
    return rows.select("book_id", F.lit("ace").alias("backend"), level.alias("severity"), F.col("x")["earl:test"]["dct:title"].alias("issue_id"), F.col("x")["earl:result"]["dct:description"].alias("message"), "location").where("severity IS NOT NULL")


def cover_choice(candidates: DataFrame, want_language, author):
    """The cover of each book: the first that its ISBN finds, else the first by title that has the language and the
    author's last name. candidates: book_id, by (isbn or title), rank, cover_id, language and author_name (arrays).
    """
    from quire.functions.language import language_matches

    name = F.lower(text.last_name(author))
    fits = language_matches(F.col("language"), want_language) & F.exists("author_name", lambda a: F.lower(a).contains(name))
    by_isbn = F.col("by") == "isbn"
    usable = candidates.where(F.col("cover_id").isNotNull() & (by_isbn | fits))
    return usable.groupBy("book_id").agg(F.min_by("cover_id", F.struct(~by_isbn, "rank")).alias("cover_id"))
