"""Connected components of an undirected edge list by randomized contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of edges(a, b) with one node of its component: rows (node, root).

    Each round sends every node to the neighbour (or itself) of least hash, which contracts
    the graph by a constant factor on any shape, long chains included; the edges between the
    chosen nodes form the next round's graph. Minima are combined map-side and every join is
    a plain equi-join whose skewed side adaptive execution can split, so a hub with any number
    of neighbours is never gathered in one task. Rows with a null end and loops are ignored;
    an empty input gives no rows. The order of nodes has no meaning in root: callers that need
    the smallest member take the minimum over the component.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    pairs = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for step in range(max_rounds):
        if pairs.isEmpty():
            break
        # The two ends of an edge see each other; a fresh salt each round keeps chains short.
        both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("n"))
        chosen = checkpointed(
            both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("next"))
        )
        moved = chosen.where("node <> next")
        if labels is None:
            labels = chosen.select("node", F.col("next").alias("root"))
        else:
            old, new = labels.alias("l"), moved.alias("m")
            labels = old.join(new, F.col("l.root") == F.col("m.node"), "left").select(
                F.col("l.node").alias("node"), F.coalesce("m.next", "l.root").alias("root")
            )
        labels = checkpointed(labels)
        left = pairs.join(moved.select(F.col("node").alias("a"), F.col("next").alias("na")), "a", "left")
        ends = left.join(moved.select(F.col("node").alias("b"), F.col("next").alias("nb")), "b", "left")
        ends = ends.select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")).where("a <> b")
        pairs = checkpointed(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("components did not converge")
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
