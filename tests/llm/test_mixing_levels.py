"""Languages and sources outside the fixed lists survive the mixing."""

import random

from pyspark.sql import functions as F

from quire.llm import mixing


def test_other_languages_and_found_sources(spark):
    rng = random.Random(7)
    rows = []
    for k in range(600):
        lang = rng.choice(["en", "fr", "de", "es", "it", None])
        rows.append((k, " ".join(["word"] * rng.randint(20, 400)), lang, "big" if k % 4 else rng.choice(["small", "tiny"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(docs, mixing.production(docs), 0.3).cache()
    assert mixed.where("(lang IS NULL OR lang = 'it') AND probability = 0").isEmpty()
    assert mixed.where("lang = 'it' AND selected").count() > 0
    share = lambda c: {r[0]: r[1] for r in mixed.groupBy(c).agg(F.sum(F.col("tokens") * F.col("weight"))).collect()}
    by_source, by_lang = share("source"), share("lang")
    assert max(by_source.values()) - min(by_source.values()) < 1e-3 * sum(by_source.values())
    raw = {r[0]: r[1] for r in mixed.groupBy("lang").agg(F.sum("tokens")).collect()}
    kept = (by_lang["it"] + by_lang[None]) / sum(by_lang.values())
    assert abs(kept - (raw["it"] + raw[None]) / sum(raw.values())) < 1e-3
    assert abs(by_lang["en"] / by_lang["fr"] - 0.55 / 0.17) < 1e-2
    mixed.unpersist()
