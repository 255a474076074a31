"""Connected components of a graph given as edges, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.batches import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that can be reached, for every node that has an edge and isn't its own root.

    In each round every node points to its smallest neighbour, pointers are followed to their ends by doubling, and
    the graph is contracted to the ends. Each step is a join or a partial aggregation of stored tables, so a node with
    very many edges is spread: Spark splits its rows. Nulls and loops are ignored, repeated edges count once."""
    cur = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    cur = stored(cur.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "edges")
    levels = []
    while not cur.isEmpty():
        pointer = stored(cur.groupBy("hi").agg(F.min("lo").alias("to")).withColumnRenamed("hi", "node"), "pointers")
        while True:  # a pointer's end is a node without pointer
            jump = pointer.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = stored(pointer.join(jump, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "pointers")
            pointer = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        levels.append(pointer)
        lo, hi = pointer.select(F.col("node").alias("lo"), F.col("to").alias("lo_to")), pointer.select(F.col("node").alias("hi"), F.col("to").alias("hi_to"))
        moved = cur.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo_to", "lo").alias("x"), F.coalesce("hi_to", "hi").alias("y")).where("x <> y")
        cur = stored(moved.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "edges")
    if not levels:
        return cur.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    out = levels[-1].select("node", F.col("to").alias("root"))
    for level in reversed(levels[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("root"))
        out = stored(level.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")).unionByName(out), "components")
    return out
