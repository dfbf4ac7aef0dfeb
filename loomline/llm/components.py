"""Connected components of a table of links, by contraction: no task and no driver ever holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for the nodes of edges (a, b), longs; repeated links and loops do no harm.

    Each round maps every node to its best neighbour or itself and contracts the links along that map,
    until none is left. Rounds in order of ids empty stars at once; rounds in a hashed order, which
    follow by turns, shorten chains of any numbering by a constant factor. Every round's tables are
    written, so lineage stays short. A node with very many links is met by partial minima and
    by joins whose large partitions Spark may split.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    hops: list[DataFrame] = []
    rounds = 0
    while not edges.isEmpty():
        by_hash = rounds >= 2 and rounds % 2 == 0
        rank = (lambda c: F.xxhash64(F.lit(rounds), c)) if by_hash else (lambda c: c)
        ways = edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("v"), F.struct(rank(F.col(y)).alias("r"), F.col(y).alias("to")).alias("w")) for x, y in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))])).alias("e"))
        hop = written(ways.groupBy("e.v").agg(F.min("e.w").alias("w")).select("v", F.col("w.to").alias("to")), "hops")
        hops.append(hop)
        edges = edges.join(hop.withColumnsRenamed({"v": "a", "to": "x"}), "a").join(hop.withColumnsRenamed({"v": "b", "to": "y"}), "b")
        edges = written(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
        rounds += 1
    found = nodes.withColumn("root", F.col("node"))
    for hop in hops:
        found = found.join(hop, F.col("root") == F.col("v"), "left").select("node", F.coalesce("to", "root").alias("root"))
    if len(hops) < 3:  # rounds by id alone: the root is the least node
        return found.select("node", F.col("root").alias("component"))
    found = written(found, "roots")
    return found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
