"""Connected components of an undirected graph, by rounds of hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b: long); component is the smallest node reachable.

    Each round gives every node, and the label it points to, the smallest label among its neighbours, then
    lets labels point to their own label. Labels only fall, and depth shrinks by a constant factor, so the
    rounds grow with the logarithm of the longest path. Minima are pre-aggregated before each shuffle and
    joins may be split by adaptive execution, so a hub is no single task. Lineage is cut once per round.
    An empty table of links gives an empty result; self links and repeats change nothing.
    """
    # worked out once: both directions are read from it
    links = cut(links.select("a", "b"))
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    edges = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    own = links.select(F.col("a").alias("u"), F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("b").alias("v")))
    labels = cut(edges.unionByName(own).groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    total = _total(labels)
    while True:
        seen = labels.select(F.col("node").alias("v"), "label")
        near = edges.join(seen, "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("low"))
        both = labels.join(near, "node", "left").select("node", "label", F.least("label", "low").alias("low"))
        offers = both.select(F.explode(F.array(F.struct("node", F.col("low").alias("label")), F.struct(F.col("label").alias("node"), F.col("low").alias("label")))).alias("o")).select("o.*")
        hooked = offers.groupBy("node").agg(F.min("label").alias("label"))
        parents = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = cut(hooked.join(parents, "label", "left").select("node", F.least("label", "up").alias("label")))
        now = _total(labels)
        if now == total:
            return labels.select("node", F.col("label").alias("component"))
        total = now


def _total(labels: DataFrame):
    """Labels only ever fall, so an unchanged sum means that no label has changed."""
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
