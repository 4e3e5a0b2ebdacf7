"""Connected components of links between nodes, by contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.llm.store import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that occurs in ``links`` (x, y); root is its component's least node.

    Each round every root points to the least root it is linked with (itself included), chains of
    pointers are shortened, and links move up to the roots. Links inside a component go, so the
    tables shrink; rounds end when none are left. Nothing is collected but whether links remain.
    """
    links = stored(links.select("x", "y").filter("x <> y").distinct(), name)
    nodes = links.select(F.col("x").alias("node")).unionByName(links.select(F.col("y").alias("node"))).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("y"))
        up = stored(least.select(F.col("x").alias("at"), F.least("x", "y").alias("to")), f"{name}-up")
        for _ in range(2):  # pointers only go down in order, so there is no circle
            further = up.select(F.col("at").alias("to"), F.col("to").alias("beyond"))
            up = up.join(further, "to", "left").select("at", F.coalesce("beyond", "to").alias("to"))
        up = stored(up, f"{name}-up")
        roots = stored(
            roots.join(up.withColumnRenamed("at", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")),
            f"{name}-roots",
        )
        moved = (
            links.join(up.select(F.col("at").alias("x"), F.col("to").alias("x2")), "x")
            .join(up.select(F.col("at").alias("y"), F.col("to").alias("y2")), "y")
            .filter("x2 <> y2")
            .select(F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y"))
            .distinct()
        )
        links = stored(moved, name)
    return roots
