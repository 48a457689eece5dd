"""Sections aligned in one pass get the rows of the plans over words, and no word is dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import aligned, alignment
from quire.plans import catalogue


@pytest.fixture(scope="module")
def sections(spark):
    rng = random.Random(3)
    rows = [("none", [], "a b".split()), ("mute", "a b".split(), []), ("null", None, ["a"]), ("both", [], [])]
    for k in range(150):
        true = [rng.choice(["alpha", "Beta,", "gamma", "delta.", "…", "x", "ypsilon"]) for _ in range(rng.randrange(60))]
        heard = [w for w in true if rng.random() > 0.1]
        heard = [w if rng.random() > 0.15 else rng.choice([w + "a", "zzz", w.upper()]) for w in heard]
        rows.append((f"s{k}", ["noise"] * rng.randrange(3) + heard + ["bye"] * rng.randrange(3), ["Title"] * rng.randrange(3) + true))
    made = spark.createDataFrame(rows, "k string, transcript array<string>, truth array<string>")
    late = F.lit(0.4)
    timed = {"starts": F.transform("transcript", lambda w, i: i * 0.5), "ends": F.transform("transcript", lambda w, i: i * 0.5 + F.when(i % 9 == 4, 0.75).otherwise(late))}
    return made.withColumns(timed | {"paras": F.transform("truth", lambda w, i: F.floor(i / 7).cast("int"))}).cache()


@pytest.mark.parametrize("strategy", ["bracket", "drop", "nosync"])
@pytest.mark.parametrize("words", [40, 100_000])
def test_one_pass_gives_the_rows_of_the_windows(spark, sections, strategy, words, monkeypatch):
    monkeypatch.setattr(aligned, "WORDS", words)
    script = alignment.diff_sections(sections, ["k"])
    transcript = sections.select("k", F.posexplode("transcript").alias("whisper_idx", "text"), "starts", "ends").select("k", "whisper_idx", F.get("starts", "whisper_idx").alias("start_s"), F.get("ends", "whisper_idx").alias("end_s"))
    truth = sections.select("k", F.posexplode("truth").alias("gt_idx", "text"), "paras").select("k", "gt_idx", "text", F.get("paras", "gt_idx").alias("para_idx"))
    plain = alignment.transfer(script, transcript, truth, ["k"], strategy)
    whole = lambda rows: sorted(map(str, rows.collect()))
    found = aligned.transfer_sections(sections, ["k"], strategy)
    assert whole(found) == whole(plain) and found.dtypes == plain.dtypes
    regrouped = alignment.regroup_paragraphs(plain, truth, ["k"])
    assert whole(aligned.paragraphs_of_sections(sections, ["k"], strategy)) == whole(regrouped)


def test_no_word_is_dealt_out(spark, sf_dir):
    for name in ("align_transfer", "aligned_paragraphs"):
        assert "Exchange" not in catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
