"""A training corpus from raw documents: quality, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents. Rows without an id go through the filters like others; a null id joins no duplicate component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, ngram_join, packing, quality, toxicity
from quire.llm.common import table, written

#: A document stays if it is this likely at least to be of a good grade, and less likely than that to be toxic.
GOOD, TOXIC = 0.5, 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.quality_filter(docs, model, GOOD)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxic_filter(docs, model, TOXIC)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each component of the n-gram Jaccard join.

    Rows without an id, and those of texts without words, stay. Of rows that share the kept id the one with the smallest
    text hash stays.
    """
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their targets."""
    mixed = mixing.mix(docs.select("doc_id", "text", "lang", "source", "n_chars"), mixing.production(docs), mixing.SHARE)
    return mixed.where("selected").select("doc_id", "text", "lang", "source", "n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in bins."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned stages. Those are tested by held-out accuracy, near duplicates against brute force,
#: mixing against plain raking, and packing by a plain search for each piece's bin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
