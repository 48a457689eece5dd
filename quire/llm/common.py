"""Session helpers that the operators share: the shared folder, written tables, column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.scratch import drop_written, scratch_path, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text_crc(column: str = "doc_id"):
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def set_aside(docs: DataFrame, reserved: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of reserved names (in any case) renamed to names of their own, and the new name of each column."""
    taken, names = {c.lower() for c in docs.columns} | set(reserved), {}
    for c in docs.columns:
        names[c] = c
        if c.lower() in reserved:
            k = 0
            while f"_kept_{k}" in taken:
                k += 1
            names[c] = f"_kept_{k}"
            taken.add(names[c])
    return docs.withColumnsRenamed({c: n for c, n in names.items() if c != n}), names


def summed_in_two(rows: DataFrame, key: str, value: str, function, schema: str, first: int = 32) -> DataFrame:
    """rows (key, value) summed per key by an Arrow function, first in shares, then the shares: no task reads all parts."""
    shares = rows.select(key, value, (F.spark_partition_id() % first).alias("_share"))
    return shares.groupBy(key, "_share").applyInArrow(function, schema).groupBy(key).applyInArrow(function, schema)
