"""Connected components by alternating star contraction, as DataFrame joins.

Each round points every node at the smallest neighbour it or its neighbours know (large star), then
links what is below a node with its smallest one (small star). The number of edges doesn't grow, and the number of rounds
grows with the logarithm of the longest path. A round's edges are written to the shared folder, so lineage stays short, and so
are the smallest neighbours: beside a written table, the edges of a hub come to their join by an exchange that adaptive execution
splits over tasks, where a join on the aggregate's own partitioning would keep them in one. The last round's tables go.

Null or odd input: rows with a null end and loops are dropped, repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_staged, stage_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stage_table(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "low")
    out = stage_table(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), "edges")
    drop_staged(low)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = stage_table(down.groupBy("a").agg(F.min("b").alias("low")), "low")
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    out = stage_table(moved.union(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
    drop_staged(low)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns node, root for every node of an edge; root is the component's smallest node."""
    edges = stage_table(edges.where("a <> b"), "edges")
    seen = None
    for _ in range(most_rounds):
        large = _large_star(edges)
        small = _small_star(large)
        drop_staged(edges, large)
        edges = small
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if (now["n"], now["h"]) == seen:
            break
        seen = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
