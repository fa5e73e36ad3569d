"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; edges: (a, b) in one direction or both.

    Each round every node moves to its neighbour (or itself) of least hash, with a new hash each
    round, and links are redrawn between the places moved to. That shrinks the links by a factor
    on average whatever the shape, so rounds grow with the logarithm of the largest component.
    The driver learns only whether links are left. Each round's tables are written to the shared
    folder. root is some node of the component; take a minimum over it for a chosen name.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a != b").distinct(), "links")
    roots = None
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        least = edges.groupBy("a").agg(F.min(order("b")).alias("n"))
        moves = materialize(least.select("a", F.least(order("a"), F.col("n"))["v"].alias("to")), "moves")
        if roots is None:
            roots = moves.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            hop = moves.select(F.col("a").alias("root"), "to")
            roots = materialize(roots.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        ma, mb = moves.withColumnRenamed("to", "ta"), moves.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(ma, "a").join(mb, "b").where("ta != tb")
        edges = materialize(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
