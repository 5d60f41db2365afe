"""Traversal of a service dependency graph kept as an edge table (src depends on dst)."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import check_range
from ..session import materialise, within_rows

MERGE_EVERY = 12  # levels after which all levels become one table
LANE = 64  # roots that share a row, one bit each


def _hops(edges: DataFrame, forward: bool) -> DataFrame:
    """(node, next): one step along the edges, or against them. An edge without one of its ends is none."""
    src, dst = ("src", "dst") if forward else ("dst", "src")
    return edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).dropna().distinct()


def _levels(max_depth: int | None) -> Iterable[int]:
    if max_depth is None:
        return count(1)
    return range(1, check_range("max_depth", max_depth, 1) + 1)


def reach(edges: DataFrame, start: DataFrame, *, forward: bool = True, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from `start` (root, node) with their smallest depth, roots excluded.

    One join per level until no new node is found; a node is expanded once per root, so cycles end by
    themselves. `max_depth` asks for the nodes within that many hops only. Each level is written to the
    shared folder, and so are all levels together now and then, which keeps the plan of the next one short.
    """
    hops = _hops(edges, forward)
    frontier = start.select("root", "node").distinct().withColumn("depth", F.lit(0))
    visited = frontier
    for depth in _levels(max_depth):
        found = frontier.join(hops, "node").select("root", F.col("next").alias("node")).distinct()
        fresh = found.join(visited.select("root", "node"), ["root", "node"], "left_anti")
        frontier = materialise(fresh.withColumn("depth", F.lit(depth)), f"reach-{depth}")
        if within_rows(frontier, 0):
            break
        visited = visited.unionByName(frontier)
        if depth % MERGE_EVERY == 0:
            visited = materialise(visited, f"reached-{depth}")
    return visited.filter(F.col("depth") > 0)


def _roots(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("root"), "node")


def upstream(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What the nodes depend on."""
    return reach(edges, _roots(nodes), forward=True, max_depth=max_depth)


def downstream(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What depends on the nodes."""
    return reach(edges, _roots(nodes), forward=False, max_depth=max_depth)


def blast_radius(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """How many services a failure of each node touches, and how far away the last one is.

    All nodes are walked from at once, `LANE` of them to a row: the bits of a row's mask are the roots that have
    reached its node. A level is one join with the edges and one `bit_or` per (lane, node), which has a map side, so
    neither pairs of root and node nor their lists are ever built. Roots that touch nothing have no row.
    """
    hops = _hops(edges, forward=False)
    # written, so that a root keeps its number when a task runs again
    roots = materialise(nodes.select("node").dropna().distinct().withColumn("number", F.monotonically_increasing_id()), "roots")
    own_bit = F.expr(f"shiftleft(1L, cast(number % {LANE} as int))")
    frontier = roots.select(F.expr(f"number div {LANE}").alias("lane"), "node", own_bit.alias("mask"), F.lit(0).alias("depth"))
    visited = frontier
    nothing = F.lit(0).cast("long")
    for depth in _levels(max_depth):
        arriving = frontier.join(hops, "node").select("lane", F.col("next").alias("node"), F.col("mask").alias("new"), nothing.alias("old"))
        known = visited.select("lane", "node", nothing.alias("new"), F.col("mask").alias("old"))
        met = arriving.unionByName(known).groupBy("lane", "node").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        fresh = met.select("lane", "node", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("mask")).filter("mask <> 0")
        frontier = materialise(fresh.withColumn("depth", F.lit(depth)), f"spread-{depth}")
        if within_rows(frontier, 0):
            break
        visited = visited.unionByName(frontier)
        if depth % MERGE_EVERY == 0:
            visited = materialise(visited, f"spread-until-{depth}")
    bits = [F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1))).alias(f"bit{i}") for i in range(LANE)]
    per_level = visited.filter("depth > 0").groupBy("lane", "depth").agg(*bits)
    reached = per_level.select("lane", "depth", F.posexplode(F.array(*[f"bit{i}" for i in range(LANE)])).alias("bit", "n")).filter("n > 0")
    per_root = reached.groupBy((F.col("lane") * LANE + F.col("bit")).alias("number")).agg(F.sum("n").alias("affected"), F.max("depth").alias("farthest"))
    return per_root.join(roots, "number").select(F.col("node").alias("root"), "affected", "farthest")


def common_ancestors(edges: DataFrame, affected: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes that all affected nodes depend on, nearest first by the sum of depths."""
    n = affected.select("node").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        upstream(edges, affected, max_depth)
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("roots"), F.sum("depth").alias("distance"))
        .filter(F.col("roots") == n)
        .select("node", "distance")
    )
