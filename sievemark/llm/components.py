"""Connected components by randomised contraction, all in DataFrames.

Each round maps every vertex to the vertex of least seeded hash among itself and its neighbours and
replaces edges by their images, which at least quarters the vertices in expectation. Maps are written
before they are joined, so both sides of every join are shuffled by Spark itself and it can split a
hub's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import materialize, release


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every vertex of ``edges`` (a, b): root is the least vertex of its component."""
    now = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    seed = 0
    while not now.isEmpty():
        seed += 1
        both = now.union(now.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min_by("b", F.xxhash64(F.lit(seed), "b")).alias("b"))
        own = F.xxhash64(F.lit(seed), "a") <= F.xxhash64(F.lit(seed), "b")
        step = materialize(nearest.select(F.col("a").alias("node"), F.when(own, F.col("a")).otherwise(F.col("b")).alias("to")), "step")
        maps.append(step)
        left, right = step.toDF("a", "a2"), step.toDF("b", "b2")
        image = now.join(left, "a").select("a2", "b").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct()
        later = materialize(image, "edges")
        release(now)
        now = later
    release(now)
    if not maps:
        return edges.select(F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("root")).limit(0)
    # From the last round back: where a vertex's image ends up is where the vertex does.
    ends = maps[-1].toDF("node", "end")
    for step in reversed(maps[:-1]):
        ends = step.join(ends.toDF("to", "end"), "to", "left").select("node", F.coalesce("end", "to").alias("end"))
        ends = materialize(ends, "ends")
    least = materialize(ends.groupBy("end").agg(F.min("node").alias("root")), "roots")
    return materialize(ends.join(least, "end").select("node", "root"), "components")
