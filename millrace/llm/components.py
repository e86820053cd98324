"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is a partial aggregation (the smallest neighbour of a node) and a join that adaptive execution can
split where a node has many edges; nothing is gathered on the driver but one count a round. Every round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _smallest(edges)
    linked = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`edges` (u, v, any order) -> node, component: the smallest node that it reaches. Only nodes with edges."""
    current = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        # The rows are a forest of stars once no node is both an end and a root, and none has two roots.
        shape = current.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if not current.join(shape.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() and not shape.filter("n > 1").limit(1).count():
            break
        current = written(_small_star(_large_star(current).distinct()).distinct(), "edges")
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
