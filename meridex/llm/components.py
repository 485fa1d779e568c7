"""Connected components over a table of links, by alternating large-star and small-star steps, or in one task where there are few.

Every step is a join and a grouped minimum, so a node with very many links is met by partial aggregation and by skew
handling in the join. Each round is written to the shared folder: lineage stays short and lost executors cost one step.
Every round also costs the driver several plans, whatever the number of links, and their threads, compiled code and
broadcast tables; so one task of an executor unites up to ONE_TASK_LINKS links at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, giving_back, written

#: Up to so many different links are united by one task, in some 100 MB; more of them by rounds.
ONE_TASK_LINKS = 1 << 19


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), ascending, and of each the smallest node reachable."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    at, to = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:  # every root with a link to a smaller one goes below the smallest of these
        high, low = np.maximum(root[at], root[to]), np.minimum(root[at], root[to])
        apart = high != low
        if not apart.any():
            return nodes, nodes[root]
        at, to = at[apart], to[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = pa.Table.from_batches(found) if (found := list(batches)) else None
    if links is not None and len(links):
        kind = links.schema.field("u").type
        node, root = (pa.array(x, kind) for x in roots_of(links["u"].to_numpy(), links["v"].to_numpy()))
        yield from pa.table([node, root], ["node", "root"]).to_batches(10_000)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """node, root (the smallest node reachable) of every node with a link to another; links in either direction, repeated
    links and links to oneself are allowed; no links give an empty result."""
    ends = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, before = written(ends.distinct(), "edges"), None
    if edges.count() <= one_task:
        kind = edges.schema["u"].dataType.simpleString()
        found = written(edges.coalesce(1).mapInArrow(giving_back(_in_one_task), f"node {kind}, root {kind}"), "components")
        dropped(edges)
        return found
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a pair is ordered, larger end first: v is always below u
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "edges")
        dropped(edges, large)
        edges = after
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
