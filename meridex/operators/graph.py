"""Hierarchies and reference graphs: paths, subtrees, closures, cycles and staleness, level by level.

A level is a join of the frontier with the edges and an anti-join with what was reached before (set semantics, so that
cycles end). Each level is written to the checkpoint folder; the frontier, not the closure, is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def closure(edges: DataFrame, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """src, dst, distance: all that each start reaches over edges (src, dst), by fewest hops; a start itself only if a cycle
    leads back to it. Ends where nothing new is reached; more levels than max_depth, if given, are an error."""
    edges = edges.select("src", "dst").distinct()
    first = edges if starts is None else edges.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    frontier = _cut(first.withColumn("distance", F.lit(1)))
    # levels are merged two by two (1, 2, 4 ... of them to a table), so that each row is written anew a few times only
    levels: list[tuple[int, DataFrame]] = [(1, frontier)]
    depth = 1
    while True:
        depth += 1
        step = frontier.select("src", F.col("dst").alias("via")).join(edges.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()
        for _, known in levels:
            step = step.join(known, ["src", "dst"], "left_anti")
        frontier = _cut(step.withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"paths of more than {max_depth} hops")
        size, top = 1, frontier
        while levels and levels[-1][0] == size:
            top, size = levels.pop()[1].unionByName(top), 2 * size
        levels.append((size, top if size == 1 else _cut(top)))
    out = levels[0][1]
    for _, more in levels[1:]:
        out = out.unionByName(more)
    return out


#: Fixed value: the ancestors that a path has at most.
PATH_DEPTH = 50


def ancestor_paths(nodes: DataFrame, max_depth: int = PATH_DEPTH) -> DataFrame:
    """label, path of nodes (label, parent): the ancestors, root first, a dangling parent included, self excluded. A cycle
    ends a path before the label that would come again; a path has the max_depth nearest ancestors at most."""
    open_ = _cut(nodes.select("label", F.col("parent").alias("at"), F.array().cast("array<string>").alias("path")))
    done, parents = None, nodes.select(F.col("label").alias("at"), F.col("parent").alias("above"))
    seen = (F.col("at") == F.col("label")) | F.array_contains("path", F.col("at"))
    for _ in range(max_depth):
        ended = open_.where(F.col("at").isNull() | seen).select("label", "path")
        done = ended if done is None else done.unionByName(ended)
        going = open_.where(F.col("at").isNotNull() & ~seen)
        open_ = _cut(going.join(parents, "at", "left").select("label", F.col("above").alias("next"), F.array_insert("path", 1, F.col("at")).alias("path")).withColumnRenamed("next", "at"))
        if open_.isEmpty():
            return done
    return done.unionByName(open_.select("label", "path"))


def on_cycle(edges: DataFrame) -> DataFrame:
    """node: those that reach themselves. Nodes that nothing leads to or that lead nowhere are peeled off, level by level;
    only among what is left, the cycles and what lies between them, is the closure formed."""
    core = _cut(edges.select("src", "dst").distinct())
    left = core.count()
    while left:
        core_next = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core_next = _cut(core_next.select("src", "dst"))
        now = core_next.count()
        core = core_next
        if now == left:
            break
        left = now
    return closure(core).where("src = dst").select(F.col("src").alias("node"))


def stale_cascade(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """node, distance: what depends, directly or not, on changed (node) over edges (src depends on dst)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back, changed).groupBy(F.col("dst").alias("node")).agg(F.min("distance").alias("distance"))


def tree_of(spark: SparkSession, region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    label = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return (
        region.select(label("R", "r_regionkey").alias("label"), F.lit(None).cast("string").alias("parent"))
        .unionByName(nation.select(label("N", "n_nationkey").alias("label"), label("R", "n_regionkey").alias("parent")))
        .unionByName(customer.select(label("C", "c_custkey").alias("label"), label("N", "c_nationkey").alias("parent")))
    )
