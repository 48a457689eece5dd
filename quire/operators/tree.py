"""Trees from ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def heading_parents(rows: DataFrame, keys: list[str], order: str, level: str, levels: int = 6) -> DataFrame:
    """rows with ord (from 1) and parent_ord: the nearest row before of a strictly lower level, null at the root.

    One window finds the last row of each level; the parent is the latest of the lower ones.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("ord", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = {f"_l{k}": F.max(F.when(F.col(level) == k, F.col("ord"))).over(before) for k in range(1, levels)}
    numbered = numbered.withColumns(last)
    parent = F.greatest(F.lit(None).cast("int"), *[F.when(F.col(level) > k, F.col(f"_l{k}")) for k in range(1, levels)])
    return numbered.withColumn("parent_ord", parent).drop(*last)


def with_paths(rows: DataFrame, key: str, depth: int = 6) -> DataFrame:
    """rows of heading_parents with their depth and path of ords; a level is passed once at most, so depth is bounded."""
    parents = rows.select(key, F.col("ord").alias("_p"), F.col("parent_ord").alias("_up"))
    out = rows.withColumns({"_at": F.col("parent_ord"), "path": F.array("ord")})
    for _ in range(depth - 1):
        out = out.join(parents.withColumnRenamed("_p", "_at"), [key, "_at"], "left")
        out = out.withColumn("path", F.when(F.col("_at").isNull(), F.col("path")).otherwise(F.concat(F.array("_at"), "path")))
        out = out.withColumn("_at", F.col("_up")).drop("_up")
    return out.withColumn("depth", F.size("path")).withColumn("path", F.array_join("path", "/")).drop("_at")


def nested_list(items: list[tuple[int, str, str]]) -> str:
    """Nested <ol> of (level, label, href) in order; label and href are escaped already."""
    root: list = []
    stack = [(0, root)]
    for level, label, href in items:
        while stack[-1][0] >= max(level, 1):
            stack.pop()
        children: list = []
        stack[-1][1].append((label, href, children))
        stack.append((max(level, 1), children))

    def render(nodes: list) -> str:
        body = "".join(f'<li><a href="{href}">{label}</a>{render(children)}</li>' for label, href, children in nodes)
        return f"<ol>{body}</ol>" if nodes else ""

    return render(root)
