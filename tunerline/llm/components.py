"""Connected components of a graph by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunerline.llm.common import Settled


def components(edges: DataFrame) -> Settled:
    """node, comp for each node of edges (a, b: long): nodes have equal comp if and only if edges connect them.

    In each round every node goes to the least of itself and its neighbours, in an order hashed anew, and edges between
    the nodes that are left go on; their number falls by a constant factor on average, chains and stars alike. Each
    round's tables are written, so no lineage grows. Loops and repeated edges don't matter; no edges give no rows.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = Settled(edges.select("a", "b").distinct(), "edges", few=True)
    found, turn = None, 0
    while True:
        turn += 1
        near = both(left.df).unionByName(left.df.select("a", F.col("a").alias("b"))).unionByName(left.df.select(F.col("b").alias("a"), "b"))
        to = Settled(near.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), "b")).alias("m")).select(F.col("a").alias("node"), F.col("m.b").alias("comp")), "moves", few=True)
        side = to.side()
        x = left.df.join(side.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a")
        x = x.join(side.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b").where("x <> y")
        rest = Settled(x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", few=True)
        if found is None:
            found = to
        else:
            moved = found.df.join(side.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
            old, found = found, Settled(moved, "components", few=True)
            old.drop()
            to.drop()
        left.drop()
        left = rest
        if left.df.isEmpty():
            left.drop()
            return found
