"""Graphs and hierarchies: reachability, lineage, topological levels, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import checkpointed


#: Rows of a frontier up to which it is broadcast; larger joins are shuffled, so that what the driver gets does not grow with the graph.
FRONTIER = 5_000


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(seed, node, hops): what each of seeds(seed) reaches along edges(src, dst), with the fewest hops; the seed itself only round a cycle.

    A frontier join a round, cut by checkpoints; nodes met before are left out, so cycles end. Paths
    longer than max_rounds raise.
    """
    e = checkpointed(edges.select("src", "dst").distinct())
    frontier = checkpointed(seeds.select("seed", F.col("seed").alias("node")).distinct())
    size, seen = frontier.count(), None
    ahead = lambda: (F.broadcast(frontier) if size <= FRONTIER else frontier.hint("merge")).join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"))
    unseen = lambda new: new if seen is None else new.join(seen.hint("merge"), ["seed", "node"], "left_anti")
    for hop in range(1, max_rounds + 1):
        frontier = checkpointed(unseen(ahead().distinct()))
        size = frontier.count()
        if not size:
            break
        marked = frontier.withColumn("hops", F.lit(hop).cast("long"))
        seen = marked if seen is None else checkpointed(seen.unionAll(marked))
    else:
        if seen is not None and not unseen(ahead()).isEmpty():
            raise RuntimeError(f"paths of more than {max_rounds} hops")
    return seen if seen is not None else frontier.withColumn("hops", F.lit(0).cast("long"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that no edge enters."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def tips(edges: DataFrame) -> DataFrame:
    """Nodes that no edge leaves."""
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def topological_levels(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, level) by peeling: roots have level 0, others one more than the last of their sources; nodes on or behind a cycle are left out.

    More than max_rounds levels raise.
    """
    left = checkpointed(edges.select("src", "dst").distinct())
    nodes = checkpointed(left.select(F.col("src").alias("node")).unionAll(left.select(F.col("dst").alias("node"))).distinct())
    out = None
    for level in range(max_rounds):
        free = nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti")
        free = checkpointed(free)
        if free.isEmpty():
            break
        marked = free.withColumn("level", F.lit(level).cast("long"))
        out = marked if out is None else out.unionAll(marked)
        nodes = checkpointed(nodes.join(free, "node", "left_anti"))
        left = checkpointed(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
    else:
        if not nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti").isEmpty():
            raise RuntimeError(f"more than {max_rounds} levels")
    return out if out is not None else nodes.where("1 = 0").withColumn("level", F.lit(0).cast("long"))


def replay(nodes: DataFrame, edges: DataFrame, duration: int) -> DataFrame:
    """(node, stage, start, skipped): when each of nodes(node) runs if every stage takes duration; nodes without edges are skipped."""
    level = topological_levels(edges)
    rows = nodes.select("node").distinct().join(level, "node", "left")
    return rows.select("node", F.col("level").alias("stage"), (F.col("level") * duration).alias("start"), F.col("level").isNull().alias("skipped"))


def has_cycle(edges: DataFrame) -> bool:
    """Whether peeling leaves nodes over."""
    nodes = edges.select("src").unionAll(edges.select("dst")).distinct().count()
    return topological_levels(edges).count() < nodes


def ready(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """Pending jobs(job, state) whose needs(job, on) are all completed."""
    done = jobs.where("state = 'completed'").select(F.col("job").alias("on"))
    open_ = needs.join(done, "on", "left_anti").select("job")
    return jobs.where("state = 'pending'").join(open_, "job", "left_anti").select("job")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(node); neither side is broadcast."""
    inside = edges.join(nodes.select(F.col("node").alias("src")).hint("merge"), "src", "left_semi")
    return inside.join(nodes.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, line): targets of each node, sorted, as text."""
    return edges.groupBy("src").agg(F.concat_ws(",", F.sort_array(F.collect_set(F.col("dst").cast("string")))).alias("line"))


def simple_paths(edges: DataFrame, source: object, target: object, max_hops: int) -> DataFrame:
    """(path, hops): all paths without repeats from source to target of at most max_hops edges."""
    e = checkpointed(edges.select("src", "dst").distinct())
    walk = e.where(F.col("src") == source).select(F.array("src", "dst").alias("path"))
    found = None
    for hop in range(1, max_hops + 1):
        walk = checkpointed(walk)
        hit = walk.where(F.element_at("path", -1) == target).withColumn("hops", F.lit(hop).cast("long"))
        found = hit if found is None else found.unionAll(hit)
        if hop < max_hops:
            on = walk.where(F.element_at("path", -1) != target).withColumn("src", F.element_at("path", -1)).join(e, "src")
            walk = on.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return found


def subtree_heights(parents: DataFrame) -> DataFrame:
    """(node, height) of parents(node, parent): 0 for a leaf, else one more than the highest child."""
    edges = parents.where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    tall = topological_levels(edges).withColumnRenamed("level", "height")
    return parents.select("node").distinct().join(tall, "node", "left").select("node", F.coalesce("height", F.lit(0).cast("long")).alias("height"))


def hot_path(calls: DataFrame, start: object, max_hops: int = 1_000) -> DataFrame:
    """(hop, node): from start on, always to the callee of most time in calls(caller, callee, time); ties go to the smaller callee.

    The path ends before a node that is on it already; one of more than max_hops raises.
    """
    best = calls.groupBy("caller", "callee").agg(F.sum("time").alias("time"))
    best = checkpointed(best.groupBy("caller").agg(F.min_by("callee", F.struct(-F.col("time"), "callee")).alias("callee")))
    at = best.where(F.col("caller") == start).select(F.lit(0).cast("long").alias("hop"), F.col("caller").alias("node"), F.array("caller").alias("path"))
    out = at
    for hop in range(1, max_hops + 1):
        step = at.join(best, F.col("node") == F.col("caller")).where(~F.array_contains("path", F.col("callee")))
        at = checkpointed(step.select(F.lit(hop).cast("long").alias("hop"), F.col("callee").alias("node"), F.concat("path", F.array("callee")).alias("path")))
        if at.isEmpty():
            break
        out = checkpointed(out.unionAll(at)) if hop % 50 == 0 else out.unionAll(at)
    else:
        if not at.join(best, F.col("node") == F.col("caller")).where(~F.array_contains("path", F.col("callee"))).isEmpty():
            raise RuntimeError(f"a path of more than {max_hops} hops")
    return out.select("hop", "node")
