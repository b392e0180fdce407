"""Connected components by alternating star operations, for the near-duplicate operators.

Every round is two aggregates and two joins on DataFrames, cut by checkpoint(); nothing but a count and a checksum comes to
the driver. Rounds grow with the logarithm of a component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges for each task of a round, beyond the first few tasks: rounds are many, and small ones needn't be dealt widely.
IN_TASK, FEWEST = 200_000, 8


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) for every end of an edge (a, b); component: the smallest id reachable. No edges: no rows."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    state = None
    for _ in range(most_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state, tasks = now, FEWEST + int(now[0]) // IN_TASK
        # large star: larger neighbours of u link to the smallest one
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        # small star: smaller neighbours of u and u itself link to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
