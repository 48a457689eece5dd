"""Scalar functions and kernels on cases of our own."""

import math

import pytest
from pyspark.sql import functions as F

from quire.functions import clock, language, similarity, text
from quire.operators import alignment, joins, sequences, tree
from quire.plans import package


def value(spark, f, v, kind="string"):
    return spark.createDataFrame([(v,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, v, want",
    [
        (text.normalise_word, "«Don't!»", "don't"),
        (text.normalise_word, " (Well-Known).", "well-known"),
        (text.normalise_word, "...", ""),
        (text.normalise_heading, "  12) The  (Old) HOUSE: ", "the old house"),
        (text.normalise_heading, "Chapter 3", "chapter 3"),
        (text.normalise_title, " a\n\tb  c ", "a b c"),
        (text.normalise_body, "a\n\n  \nb c", "a\n\nb c"),
        (text.ends_sentence, "It ends.", True),
        (text.ends_sentence, 'It ends!")', True),
        (text.ends_sentence, "It costs 3.", False),
        (text.ends_sentence, "Ask Dr.", False),
        (text.ends_sentence, "They had walked.", True),
        (text.ends_sentence, "They were running.", False),
        (text.ends_sentence, "at the king.", False),
        (text.ends_sentence, "no end", False),
        (text.ends_sentence, "typographic.”", False),
        (text.capitalise_first, "élan", "Élan"),
        (text.capitalise_first, "1st", "1st"),
        (text.escape_attr, '<a b="c">&', "&lt;a b=&quot;c&quot;&gt;&amp;"),
        (text.file_basename, "a/b/c.mp3", "c.mp3"),
        (text.rewrite_href, "x.SMIL#a#b", "content/x.xhtml#a#b"),
        (text.media_type, "a.M4A", "audio/mp4"),
        (text.media_type, "a.wav", "application/octet-stream"),
        (text.extract_isbn, "978-90-123 4567-X", "978901234567X"),
        (text.extract_isbn, "12345", None),
        (text.last_name, "Ann  Sea", "Sea"),
        (text.declared_encoding, '<?xml encoding="Windows-1252"?>', "windows-1252"),
        (text.severity, "Odd", "error"),
        (clock.parse_clock_value, "npt=1.5s", 1.5),
        (clock.parse_clock_value, "0:01:02.5", 62.5),
        (clock.parse_clock_value, "2:03", 123.0),
        (clock.parse_clock_value, "250ms", 0.25),
        (clock.parse_clock_value, "-2min", -120.0),
        (clock.parse_clock_value, "1.5h", 5400.0),
        (clock.parse_clock_value, " 7 ", 7.0),
        (clock.parse_clock_value, "5f", None),
        (clock.parse_clock_value, "1:x", None),
        (clock.parse_clock_value, "", None),
        (language.to_part1, " DUT ", "nl"),
        (language.to_part1, "zz", None),
    ],
)
def test_strings(spark, f, v, want):
    assert value(spark, f, v) == want


@pytest.mark.parametrize(
    "f, v, want",
    [
        (clock.format_clock_value, 1.2345, "npt=1.235s"),
        (clock.format_clock_value, -0.5, "npt=-0.500s"),
        (clock.format_smil_clock, 3661.0, "1:01:01"),
        (clock.format_smil_clock, 0.05, "0:00:00.050"),
        (clock.format_smil_clock, -3.0, "0:00:00"),
        (clock.format_duration, 3599.6, "01:00:00"),
        (text.format_bytes, 1536.0, "1.5 KiB"),
    ],
)
def test_numbers(spark, f, v, want):
    assert value(spark, f, v, "double") == want


def test_latin1_is_decoded_where_declared(spark):
    assert value(spark, text.decode_declared, b'<?xml encoding="windows-1252"?>\xe9', "binary").endswith("é")
    assert value(spark, text.decode_declared, "é".encode(), "binary") == "é"


def test_cache_key(spark):
    import hashlib

    got = spark.range(1).select(text.cache_key(F.lit("a"), F.lit("m"), F.lit("en")).alias("k")).first()["k"]
    assert got == hashlib.sha256(b"a\0m\0en\0\x01\0\0\0").hexdigest()[:32]


def test_image_kind(spark):
    assert value(spark, text.image_kind, b"\x89PNG\r\n\x1a\nxx", "binary") == "png"
    assert value(spark, text.image_kind, b"\xff\xd8\xff\xe0", "binary") == "jpeg"


@pytest.mark.parametrize("a, b, want", [("antwerpe", "antwerpen", 0.9777777), ("table", "elephant", 0.55), ("same", "same", 1.0), ("", "x", 0.0)])
def test_jaro_winkler(a, b, want):
    assert math.isclose(similarity.jaro_winkler(a, b), want, abs_tol=1e-6)


def test_sentence_ends_agrees_with_the_column(spark):
    cases = ["It ends.", "Dr.", "3.14.", "what?)", "i.e.", "…", "", "x", "St. Ing.", 'so."', "eh.”"]
    got = [r["x"] for r in spark.createDataFrame([(c,) for c in cases], "v string").select(text.ends_sentence(F.col("v")).alias("x")).collect()]
    assert got == [sequences.sentence_ends(c) for c in cases]


def test_paragraphs():
    long = "word " * 30
    segments = [(0.0, 1.0, "first one.", "a"), (1.0, 2.0, " ", "a"), (2.0, 3.0, "second.", "b"), *[(k, k + 1.0, long + "end.", "b") for k in range(3, 9)]]
    got = list(sequences.paragraphs(segments))
    assert got[0] == (0.0, 1.0, "First one.", "a", 1)
    assert got[1][3] == "b" and got[1][4] == 3 and got[1][2].startswith("Second. word")
    assert sum(p[4] for p in got) == 8


def test_coalescing_tokens():
    tokens = [("[_BEG_]", 0, 0), (" Hel", 0, 10), ("lo", 10, 20), (",", 20, 20), (" wor", 20, 30), ("ld", 30, 40), (".", 40, 40), ("Next", 40, 60), (" ", 60, 60), (" !", 60, 70)]
    assert sequences.coalesce_tokens(tokens, 5, 65) == [(0.05, 0.2, "Hello,"), (0.2, 0.4, "world."), (0.4, 0.65, "Next!")]
    # a word without length gets 50 ms, within the segment
    assert sequences.coalesce_tokens([(" a", 10, 10)], 0, 12) == [(0.1, 0.12, "a")]


def test_regions(spark):
    flags = [0, 1, 0, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 1]
    rows = spark.createDataFrame([("s", i, bool(f)) for i, f in enumerate(flags)], "k string, i int, m boolean")
    got = [r["region"] for r in sequences.classify_regions(rows, ["k"], ["i"], F.col("m")).orderBy("i").collect()]
    assert got == ["leading"] * 3 + ["core"] * 11 + ["trailing"] * 2
    none = [r["region"] for r in sequences.classify_regions(rows.where("i < 5"), ["k"], ["i"], F.col("m")).collect()]
    assert set(none) == {"core"}


def test_clamping_matches_the_loop(spark):
    import random

    rng = random.Random(1)
    rows = [(g, i, rng.random() * 10, rng.random() * 10, rng.random() < 0.2) for g in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "g int, i int, s double, e double, u boolean")
    got = {(r["g"], r["i"]): (r["new_start"], r["new_end"]) for r in sequences.monotonic_clamp(df, ["g"], ["i"], "s", "e", F.col("u")).collect()}
    for g in range(20):
        own = [list(r[2:]) for r in rows if r[0] == g]
        for a, b in zip(own, own[1:], strict=False):
            if not a[2] and not b[2]:
                b[0] = max(b[0], a[1])
                b[1] = max(b[1], b[0])
        assert [got[(g, i)] for i in range(15)] == [(s, e) for s, e, _ in own]


def test_tree(spark):
    levels = [1, 2, 3, 2, 1, 4, 3]
    rows = spark.createDataFrame([("b", i, x) for i, x in enumerate(levels)], "k string, i int, level int")
    got = tree.with_paths(tree.heading_parents(rows, ["k"], "i", "level"), "k").orderBy("ord").collect()
    assert [r["parent_ord"] for r in got] == [None, 1, 2, 1, None, 5, 5]
    assert [r["path"] for r in got] == ["1", "1/2", "1/2/3", "1/4", "5", "5/6", "5/7"]
    assert tree.nested_list([(1, "a", "x"), (3, "b", "y"), (1, "c", "z")]) == '<ol><li><a href="x">a</a><ol><li><a href="y">b</a></li></ol></li><li><a href="z">c</a></li></ol>'


def test_midpoint_on_a_boundary_is_in_both(spark):
    segments = spark.createDataFrame([("a", 10.0, 20.0), ("a", 0.0, 4.0)], "key string, start double, end double")
    ranges = spark.createDataFrame([("a", 0.0, 15.0, 1), ("a", 15.0, 30.0, 2), ("b", 0.0, 99.0, 3)], "key string, t0 double, t1 double, n int")
    got = sorted((r["mid"], r["n"]) for r in joins.midpoint_join(segments, ranges, "key", 15.0).collect())
    assert got == [(2.0, 1), (15.0, 1), (15.0, 2)]


def test_sections_are_found_in_order():
    body = "# One\nalpha\n# Two\nbeta\n# One\ngamma\n"
    assert alignment.match_sections([(4, "1. One"), (5, "Twoo"), (6, "One")], body) == [(4, "alpha"), (5, "beta"), (6, "gamma")]
    assert alignment.match_sections([(0, "Nowhere at all")], body) == []
    assert alignment.match_sections([(0, "Intro")], "Intro\r\ntext") == [(0, "text")]


def test_word_diff_pairs_replacements():
    got = alignment.word_diff("in Antwerpe we saw a cat".split(), "In Antwerpen we met a cat today".split())
    assert [o[0] for o in got] == ["equal", "fuzzy", "equal", "delete", "insert", "equal", "equal", "insert"]


def _transfer(spark, heard, truth, strategy="bracket"):
    sections = spark.createDataFrame([("b", heard.split(), truth.split())], "k string, transcript array<string>, truth array<string>")
    script = alignment.diff_sections(sections, ["k"])
    transcript = sections.select("k", F.posexplode("transcript").alias("whisper_idx", "text")).withColumns({"start_s": F.col("whisper_idx") * 1.0, "end_s": F.col("whisper_idx") + 0.8})
    words = sections.select("k", F.posexplode("truth").alias("gt_idx", "text"))
    return alignment.transfer(script, transcript, words, ["k"], strategy).orderBy("gt_idx").collect(), alignment.trim_log(script, transcript, words, ["k"]).collect()


def test_transfer(spark):
    core = "one two three four five six seven eight nine ten"
    rows, log = _transfer(spark, f"noise noise {core} bye", f"Title {core} the end")
    by = {r["text"]: r for r in rows}
    assert by["one"]["start_s"] == 2.0 and by["ten"]["confidence"] == "exact"
    # one word replaces two at the front: the leading gap ends where the first match begins
    assert by["Title"]["confidence"] == "bracketed" and (by["Title"]["start_s"], by["Title"]["end_s"]) == (0.0, 2.0)
    assert (by["the"]["start_s"], by["end"]["end_s"]) == (11.8, 12.8)
    assert {(r["kind"], r["word_count"], r["preview"]) for r in log} == {("leading_whisper", 2, "noise noise"), ("leading_ground_truth", 1, "Title"), ("trailing_whisper", 1, "bye"), ("trailing_ground_truth", 2, "the end")}
    dropped, _ = _transfer(spark, f"noise {core}", f"Title {core}", "drop")
    assert [r["text"] for r in dropped] == core.split()
    free, _ = _transfer(spark, f"noise {core}", f"Title {core}", "nosync")
    assert free[0]["confidence"] == "unsynced" and free[0]["end_s"] == 0.0


def test_insertions_share_the_deleted_span(spark):
    left, right = "a b c d e", "f g h i j"
    rows, _ = _transfer(spark, f"{left} xxxx yyyy {right}", f"{left} mmmm nnnn oooo {right}")
    got = {r["text"]: (r["start_s"], r["end_s"], r["confidence"]) for r in rows}
    # delete, insert, delete, insert, insert: the run begins at the first insertion and ends with the second deletion
    assert got["mmmm"][0] == 4.8 and got["oooo"][1] == pytest.approx(6.8) and got["nnnn"][2] == "interpolated"
    lone, _ = _transfer(spark, f"{left} xxxx {right}", f"{left} mmmm {right}")
    lone = {r["text"]: r for r in lone}
    assert lone["mmmm"]["start_s"] == lone["mmmm"]["end_s"] == 4.8


def test_preview(spark):
    words = [f"w{i}" for i in range(20)]
    assert value(spark, alignment.preview, words, "array<string>") == " ".join(words[:15]) + " …"
    assert value(spark, alignment.preview, ["x" * 81, "y"], "array<string>") == "x" * 81


def test_violations(spark):
    got = spark.range(1).select(package.violations(F.lit("i"), F.lit(" "), F.lit(None).cast("string"), F.lit(0)).alias("v")).first()["v"]
    assert got == ["title is empty", "language is empty", "no sections"]


def test_tiers(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    candidates = spark.createDataFrame([(1, 2, 9.0, 10), (1, 1, 1.0, 11), (2, 2, 5.0, 12), (2, 2, 7.0, 13)], "k int, t int, score double, id int")
    got = {r["k"]: r["id"] for r in joins.tier_pick(keys, candidates, "k", F.col("t"), "id", F.desc("score")).collect()}
    assert got == {1: 11, 2: 13, 3: None}


def test_truth_words_and_paragraphs(spark):
    docs = spark.createDataFrame([("d", "- One two ! ...\n\n \n\n?\n\nThree -- four")], "k string, body string")
    got = [(r["gt_idx"], r["para_idx"], r["text"], r["key"]) for r in alignment.truth_words(docs, ["k"], "body").orderBy("gt_idx").collect()]
    assert got == [(0, 0, "-", "-"), (1, 0, "One", "one"), (2, 0, "two!...?", "two"), (3, 2, "Three", "three"), (4, 2, "--", "--"), (5, 2, "four", "four")]


def test_paragraphs_keep_their_words_when_some_are_dropped(spark):
    truth = spark.createDataFrame([("s", i, i // 2, f"w{i}") for i in range(6)], "k string, gt_idx int, para_idx int, text string")
    aligned = spark.createDataFrame([("s", 1, "w1", 1.0, 2.0, "exact"), ("s", 2, "w2", 0.0, 0.0, "unsynced"), ("s", 4, "w4", 4.0, 5.0, "exact"), ("s", 5, "w5", 0.0, 0.0, "unsynced")], "k string, gt_idx int, text string, start_s double, end_s double, confidence string")
    got = [(r["para_idx"], r["start_s"], r["end_s"], r["text"]) for r in alignment.regroup_paragraphs(aligned, truth, ["k"]).orderBy("para_idx").collect()]
    assert got == [(0, 1.0, 2.0, "w1"), (1, 0.0, 0.0, "w2"), (2, 4.0, 5.0, "w4 w5")]


def test_reports(spark):
    import json

    issues = spark.createDataFrame([("b", "ace", "warning", "x", "m", None), ("b", "ace", "fatal", None, "n", "p:1:2")], "book_id string, backend string, severity string, issue_id string, message string, location string")
    summary = spark.createDataFrame([("b", 1), ("c", 0)], "book_id string, fatals int")
    got = {r["book_id"]: json.loads(r["json"]) for r in package.report_json(summary, issues, "book_id").collect()}
    assert [i["severity"] for i in got["b"]["issues"]] == ["fatal", "warning"] and got["c"] == {"fatals": 0, "issues": []}
    assert sorted(r[0] for r in issues.select(package.report_text()).collect()) == ["FATAL - n (p:1:2)", "WARNING x m"]


def plain_edits(a: list, b: list) -> list:
    """The greedy script with a copy of the whole frontier kept for every step."""
    trace, reach, d = [], {1: 0}, 0
    while True:
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while i < len(a) and i - k < len(b) and a[i] == b[i - k]:
                i += 1
            reach[k] = i
            if i >= len(a) and i - k >= len(b):
                break
        else:
            d += 1
            continue
        break
    out, i, j = [], len(a), len(b)
    for step in range(d, -1, -1):
        before, k = trace[step], i - j
        down = k == -step or (k != step and before[k - 1] < before[k + 1])
        i0 = before[k + 1 if down else k - 1] if step else 0
        j0 = i0 - (k + 1 if down else k - 1) if step else 0
        while i > i0 + (step > 0 and not down) and j > j0 + (step > 0 and down):
            i, j = i - 1, j - 1
            out.append(("keep", i, j))
        if step:
            out.append(("insert" if down else "delete", i0, j0))
            i, j = i0, j0
    return out[::-1]


def test_scripts_are_shortest_whatever_is_kept(monkeypatch):
    import random

    def least(a, b):  # edits without replacement
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(5)
    for kept in (1, 2, 7, 256):
        monkeypatch.setattr(alignment, "KEPT", kept)
        for _ in range(120):
            a, b = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
            script = alignment.shortest_edits(a, b)
            assert sum(op != "keep" for op, *_ in script) == least(a, b)
            assert [a[i] for op, i, _ in script if op != "insert"] == a and [b[j] for op, _, j in script if op != "delete"] == b
            assert all(a[i] == b[j] for op, i, j in script if op == "keep")
            if (not a or not b or a[0] != b[0]) and (not a or not b or a[-1] != b[-1]):
                assert script == plain_edits(a, b)


def test_long_sections_take_little_memory():
    import random
    import tracemalloc

    rng = random.Random(6)
    a = [rng.randrange(1000) for _ in range(2500)]
    b = [x if rng.random() > 0.25 else rng.randrange(1000) for x in a]
    tracemalloc.start()
    alignment.shortest_edits(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000
