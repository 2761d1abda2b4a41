"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    In each round a node points to the neighbour (or itself) of least hash, the hash changing by round,
    and edges are drawn again between the nodes pointed to. The number of nodes falls by a constant
    factor a round whatever the shape; hubs are summed before the shuffle. Each round is a written
    table. Null nodes and loops are ignored; repeated edges do no harm.
    """
    left = cut(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "edges")
    nodes = cut(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), "nodes")
    steps = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = cut(least.select("a", F.least("m", rank("a"))["n"].alias("to")), "step")
        steps.append(step)
        x = left.join(step.withColumnRenamed("to", "ta"), "a")
        y = x.join(step.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        left = cut(y.filter("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "edges")
    root = nodes.withColumn("root", F.col("node"))
    for step in steps:
        root = root.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    root = cut(root, "roots")
    least = cut(root.groupBy("root").agg(F.min("node").alias("component")), "least")
    return cut(root.join(least, "root").select("node", "component"), "components")


def merged(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, component) of ``found`` after more ``edges`` (a, b): only their ends' components are joined anew."""
    place = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    both = edges.select("a", "b").join(place("a"), "a", "left").join(place("b"), "b", "left")
    both = cut(both.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")), "more_edges")
    up = components(both.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    up = up.select(F.col("node").alias("component"), F.col("component").alias("least"))
    ends = both.select(F.col("a").alias("node"), F.col("of_a").alias("component")).union(both.select("b", "of_b"))
    every = found.union(ends).distinct()
    return cut(every.join(up, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "merged")
