"""Joins: bucketed navigation, midpoint ranges, positions, anti joins, ranked and tiered picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket_items(items: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The items of each key as one ordered array. Keys are files of a book, so an array is bounded by a file."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return items.groupBy(key).agg(rows.alias("items"))


def with_bucket(sections: DataFrame, buckets: DataFrame, key: str) -> DataFrame:
    """Every section with its items, an empty array where it has none."""
    return sections.join(buckets, key, "left").withColumn("items", F.coalesce("items", F.array()))


def midpoint_join(segments: DataFrame, ranges: DataFrame, key: str, width: float) -> DataFrame:
    """Segments (key, start, end) with the ranges (key, t0, t1) that hold their midpoint, both ends included.

    Both sides are cut into slots of width seconds, so it is an equi-join on key and slot even for a key of many
    segments; a midpoint on a shared boundary matches both ranges.
    """
    slot = lambda c: F.floor(c / F.lit(float(width)))
    placed = segments.withColumn("mid", (F.col("start") + F.col("end")) / 2).withColumn("slot", slot(F.col("mid")))
    spread = ranges.where("t0 <= t1").withColumn("slot", F.explode(F.sequence(slot(F.col("t0")), slot(F.col("t1")))))
    return placed.join(spread, [key, "slot"]).where((F.col("t0") <= F.col("mid")) & (F.col("mid") <= F.col("t1"))).drop("slot")


def zip_positions(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The k-th left row of each key with the k-th right row; left rows that have none get nulls."""
    number = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return left.withColumn("k", number(left_order)).join(right.withColumn("k", number(right_order)), [*keys, "k"], "left")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def lookup_once(wanted: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """Each distinct key is looked up once, then its result goes to all rows that want it."""
    found = wanted.select(key).distinct().join(source, key)
    return wanted.join(found, key, "left")


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def tier_pick(keys: DataFrame, candidates: DataFrame, key: str, tier: Column, value: str, *order: Column) -> DataFrame:
    """For every key the best candidate of its lowest tier: a later tier counts only where earlier ones are empty."""
    best = first_by(candidates.withColumn("tier", tier), [key], F.col("tier"), *order)
    return keys.join(best.select(key, "tier", value), key, "left")
