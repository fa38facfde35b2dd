"""Connected components of a set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paracorpus.llm.common import pin


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (a, b); root is the same for connected nodes.

    Each round lets every node point to its smallest neighbour, follows two such steps, and
    contracts the links to where they lead; links inside a contracted node go. Pointers only go to
    smaller nodes, so they never form a cycle. All steps are aggregates and equi-joins: the links
    of a node with very many neighbours are combined in the tasks, and no neighbourhood is gathered.
    Repeated links, either direction and links of a node to itself are allowed; none give no rows.
    """
    edges = pin(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    roots = pin(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        smallest = pin(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "pointers")
        after = smallest.select(F.col("node").alias("to"), F.col("to").alias("after"))
        pointers = pin(smallest.join(after, "to", "left").select("node", F.coalesce("after", "to").alias("to")), "pointers")
        of_a = pointers.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        of_b = pointers.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        moved = edges.join(of_a, "a", "left").select(F.coalesce("_a", "a").alias("a"), "b").join(of_b, "b", "left")
        moved = moved.select("a", F.coalesce("_b", "b").alias("b")).where("a <> b")
        edges = pin(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        step = pointers.withColumnRenamed("node", "root")
        roots = pin(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return roots
