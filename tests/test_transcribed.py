"""Spoken sections: a section is a row, its words are dealt out once."""

from quire.operators import alignment
from quire.plans import transcribed

TEXTS = ["- One two ! ...\n\n \n\n?\n\nThree -- four", "", "a b c\r\n\r\nd", "…\n\n…\n\nx", "\n\n\n\ny  z", "　"]


def test_true_words_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, body string")
    plain = sorted((r["k"], r["gt_idx"], r["para_idx"], r["text"]) for r in alignment.truth_words(rows, ["k"], "body").collect())
    assert plain == [(k, i, p, w) for k, t in enumerate(TEXTS) for i, (p, w) in enumerate(transcribed.true_words(t))]


def _case(spark):
    parts = spark.createDataFrame([("b", k, f"n{k}", "T", "<h1>T</h1>", "old", 9.0) for k in (1, 2, 3, 4)], "book_id string, section_idx int, name string, title string, body string, smil string, seconds double")
    segments = spark.createDataFrame([("b", 1, 2, 2.0, 3.0, "c d.", "x/a&b.mp3"), ("b", 1, 1, 0.0, 1.0, "a b", "x/a&b.mp3"), ("b", 2, 1, 0.0, 1.0, "a", "a.mp3"), ("b", 3, 1, 0.0, 1.0, "lone <x>", "a.mp3"), ("b", 3, 2, 1.0, 2.0, " ", "a.mp3")], "book_id string, section_idx int, seg_ord int, start_s double, end_s double, text string, audio_src string")
    words = spark.createDataFrame([("b", 1, 2, 0, 2.0, 2.5, "c"), ("b", 1, 1, 1, 0.5, 1.0, "b"), ("b", 1, 1, 0, 0.0, 0.5, "a"), ("b", 1, 2, 1, 2.5, 2.5, "d."), ("b", 2, 1, 0, 0.0, 0.5, "a"), ("b", 3, 2, 0, 0.0, 0.5, "lost")], "book_id string, section_idx int, seg_ord int, word_ord int, start_s double, end_s double, text string")
    truths = spark.createDataFrame([("b", 2, "A\n\nend"), ("b", 1, " "), ("b", 4, "unheard")], "book_id string, section_idx int, text string")
    return transcribed.with_transcripts(parts, segments, words, truths)


def test_sections_are_merged_aligned_or_left(spark):
    rows = {r["section_idx"]: r for r in _case(spark).collect()}
    assert rows[1]["body"] == '<h1>T</h1><p id="tx-001-001"><span id="w-001-001-001">a</span> <span id="w-001-001-002">b</span> <span id="w-001-001-003">c</span> <span id="w-001-001-004">d.</span></p>'
    assert rows[1]["smil"].count("<par ") == 3 and 'src="../audio/a&amp;b.mp3"' in rows[1]["smil"] and rows[1]["seconds"] == 1.5
    assert rows[2]["body"].endswith('<p id="tx-002-001"><span id="w-002-001-001">A</span></p><p id="tx-002-002"><span id="w-002-002-001">end</span></p>')
    assert rows[2]["smil"].count("<seq>") == 1 and rows[2]["seconds"] == 0.5
    assert rows[3]["body"].endswith('<p id="tx-003-001">Lone &lt;x&gt;</p>') and (rows[3]["smil"], rows[3]["seconds"]) == ("old", 9.0)
    assert (rows[4]["body"], rows[4]["smil"]) == ("<h1>T</h1>", "old")


def test_words_are_dealt_out_once(spark):
    plan = _case(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1 and plan.count("Generate") == 0
