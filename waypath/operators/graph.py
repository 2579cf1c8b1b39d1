"""Bounded path search, closures and neighbourhoods over edge tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 40
MAX_VISITS = 2


def _settled(df: DataFrame) -> DataFrame:
    """Cuts lineage between levels in the folder of spark.checkpoint.dir, which all executors share; one machine may do without."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="waypath-ckpt-")
        sc.setCheckpointDir(folder)
    return _sized_anew(df.checkpoint(eager=True))


def _sized_anew(df: DataFrame) -> DataFrame:
    """The same rows without the size that the optimiser derived for them: it multiplies sizes join by join, and from level
    to level of a loop that product would grow to numbers of millions of digits. The size counts as unknown instead."""
    spark = df.sparkSession
    rows = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    return DataFrame(rows, spark)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (family, node) without incoming edges of others."""
    into = edges.where("src <> dst").select("family", F.col("dst").alias("node"))
    return nodes.join(into, ["family", "node"], "left_anti")


def bounded_paths(seeds: DataFrame, edges: DataFrame, success: DataFrame, max_depth: int = MAX_DEPTH, max_visits: int = MAX_VISITS) -> DataFrame:
    """Breadth-first paths of all families at once, one frontier a level.

    seeds: family, node. edges: family, edge, src, dst, outcome (neutral, success, error, cancel), operation (the src
    is an operation of the family), nav_only, and guard (null or 'path=value'). success: family, node.

    Returns every path that ended: family, nodes, edges, guards, state. witness: its last edge has outcome success,
    leaves an operation and reaches a success node; depth: longer than max_depth; visit: a node would be visited more
    than max_visits times. Paths that go on, or that nothing follows, are not returned.
    Error and cancel edges are not followed; a navigation-only edge does not re-enter a visited node; guards that
    contradict one another on one path end the path silently.
    """
    e = edges.join(success.select("family", F.col("node").alias("dst"), F.lit(True).alias("goal")), ["family", "dst"], "left")
    e = e.where(~F.col("outcome").isin("error", "cancel")).withColumn("goal", F.coalesce("goal", F.lit(False)))
    e = _settled(e)  # read at every level
    empty = F.array().cast("array<string>")
    frontier = seeds.select("family", F.array("node").alias("nodes"), empty.alias("edges"), empty.alias("guards"), F.lit("live").alias("state"))
    ended: list[DataFrame] = []
    for _ in range(max_depth + 1):
        step = frontier.withColumn("src", F.element_at("nodes", -1)).join(e, ["family", "src"])
        visits = F.size(F.filter("nodes", lambda n: n == F.col("dst")))
        step = step.where(~(F.col("nav_only") & (visits > 0) & (F.col("outcome") != "success")))
        name = F.substring_index("guard", "=", 1)
        clash = F.exists("guards", lambda g: (F.substring_index(g, "=", 1) == name) & (g != F.col("guard")))
        over = visits + 1 > max_visits
        step = step.where(over | F.col("guard").isNull() | ~clash)
        longer = F.size("nodes") + 1
        state = (
            F.when(over, "visit").when(longer > max_depth, "depth").when((F.col("outcome") == "success") & F.col("operation") & F.col("goal"), "witness").otherwise("live")
        )
        step = step.select(
            "family",
            F.array_append("nodes", F.col("dst")).alias("nodes"),
            F.array_append("edges", F.col("edge")).alias("edges"),
            F.when(F.col("guard").isNull(), F.col("guards")).otherwise(F.array_append("guards", F.col("guard"))).alias("guards"),
            state.alias("state"),
        )
        step = _settled(step)
        ended.append(step.where("state <> 'live'"))
        frontier = step.where("state = 'live'")
        if frontier.isEmpty():
            break
    out = ended[0]
    for x in ended[1:]:
        out = out.unionByName(x)
    return out


def truncations(paths: DataFrame) -> DataFrame:
    """Per family, state and last node: number of paths cut there, shortest, longest and smallest path."""
    cut = paths.where(F.col("state").isin("depth", "visit"))
    size, path = F.size("nodes"), F.array_join("nodes", ">")
    return cut.groupBy("family", "state", F.element_at("nodes", -1).alias("node")).agg(
        F.count("*").alias("n"), F.min(size).cast("long").alias("shortest"), F.max(size).cast("long").alias("longest"), F.min(path).alias("sample")
    )


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, node): everything reachable from a seed over edges (src, dst), each pair once.

    One hop a level while few levels follow; the edges that new nodes can take double in length every level, so a chain
    of n edges needs about 2 * log2(n) levels.
    """
    seen = _settled(seeds.select("origin", "node").distinct())
    jumps = _settled(edges.select("src", "dst").where("src <> dst").distinct())
    while True:
        reached = seen.join(jumps, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"))
        new = _settled(reached.distinct().join(seen, ["origin", "node"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = _settled(seen.unionByName(new))
        # only what some origin has reached can be gone on from
        onward = jumps.join(seen.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
        longer = onward.select("src", F.col("dst").alias("mid")).join(jumps.withColumnRenamed("src", "mid"), "mid").where("src <> dst").select("src", "dst")
        jumps = _settled(jumps.unionByName(longer).distinct())


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int = 2, limit: int = 80) -> DataFrame:
    """(origin, node, hop) around each origin, edges taken both ways: level by level the smallest nodes, `limit` in all.

    The limit holds at each level before the next is reached, so a hub's neighbours are never all expanded.
    """
    from waypath.operators.joins import top_of_each

    both = _settled(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    found = _settled(seeds.select("origin", "node", F.lit(0).alias("hop")).distinct())
    for h in range(1, hops + 1):
        last = found.where(F.col("hop") == h - 1)
        step = last.join(both, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct().join(found, ["origin", "node"], "left_anti")
        room = found.groupBy("origin").agg((F.lit(limit) - F.count("*")).alias("room"))
        kept = top_of_each(step, ["origin"], [F.col("node")], limit).join(room, "origin").where("rank <= room")
        found = _settled(found.unionByName(kept.select("origin", "node", F.lit(h).alias("hop"))))
    return found


def render_tree(roots: DataFrame, children: DataFrame, max_depth: int = 12, max_nodes: int = 5000) -> DataFrame:
    """(root, node, path, guards, state): components that each root renders, with the guards on the way.

    roots: root. children: parent, child, guard (null for none). state: rendered; cycle, where a component would render
    itself again; depth, beyond max_depth; limit, beyond max_nodes of one root (the rows that stand for these are not gone
    on from). The first max_nodes by level and path are kept.
    """
    from waypath.operators.joins import top_of_each

    none = F.array().cast("array<string>")
    e = _settled(children.select("parent", "child", "guard"))
    front = _settled(roots.select("root", F.col("root").alias("node"), F.array("root").alias("path"), none.alias("guards"), F.lit("rendered").alias("state")))
    out = front
    for depth in range(1, max_depth + 2):
        step = front.where("state = 'rendered'").join(e, F.col("node") == F.col("parent"))
        guards = F.when(F.col("guard").isNull(), F.col("guards")).otherwise(F.array_append("guards", F.col("guard")))
        state = F.when(F.array_contains("path", F.col("child")), "cycle").when(F.lit(depth > max_depth), "depth").otherwise("rendered")
        step = step.select("root", F.col("child").alias("node"), F.array_append("path", F.col("child")).alias("path"), guards.alias("guards"), state.alias("state"))
        room = out.where("state = 'rendered'").groupBy("root").agg((F.lit(max_nodes) - F.count("*")).alias("room"))
        ranked = top_of_each(step, ["root"], [F.col("path"), F.array_join("guards", ",")], 1 << 30).join(room, "root")
        front = _settled(ranked.withColumn("state", F.when((F.col("rank") > F.col("room")) & (F.col("state") == "rendered"), "limit").otherwise(F.col("state"))).select(out.columns))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def guard(path: Column, value: Column) -> Column:
    return F.concat_ws("=", path, value)
