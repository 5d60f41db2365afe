"""Merkle manifest of a table by nested-struct rollup.

Method. A row's leaf is the digest of its fields. Leaves are ranked in their group, and the rank is written in
digits of base `FAN`, one column a digit. Within a block of FAN^DIGITS leaves the digit columns are grouped away
one after the other, lowest first: the nodes of a run become the children of one struct, next to the digest of
their run. What remains is one nested struct a block. Block digests are ranked leaves again, of the next tier, so
no group ever holds more than a block, whatever the size of a source. Two higher-order functions then walk each
nested struct from the top, carrying the siblings met on the way, and an explode emits a row with its proof for
every leaf; blocks meet the path above them by a union and a group, so no proof needs a join.

A tree: while a group has more than one node, every FAN consecutive ones (the last run may be shorter) become
the digest of their digests. What remains is the group's subroot; the subroots, ordered by group, make the root.

Nulls: a null field counts as `-`, any other as its length in bytes, a colon and its value, so null and empty
differ. A null group is a group of its own, the first. Rows with a null key come first in their group, ties are
ordered by leaf; equal rows are leaves each, with equal digests and proofs of their own places. An empty table
has no rows, and no root. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import stored

FAN, DIGITS = 3, 6
BLOCK = FAN**DIGITS


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, columns: tuple[str, ...], changed: dict[str, Column] | None = None) -> Column:
    """Digest of the named columns, some of them replaced."""
    return digest(*[field((changed or {}).get(c, docs[c])) for c in columns])


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`rows` with r, the place in their group from 0, and n, the rows of the group.

    Rows are range-partitioned, ranked inside their partition, and moved up by the partitions before it, so a
    group that holds most rows is spread over many tasks.
    """
    dealt = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    parts = dealt.groupBy(group, "_part").agg(F.count("*").alias("held"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("_offset"),
        F.sum("held").over(Window.partitionBy(group)).alias("n"),
    )
    here = Window.partitionBy(group, "_part").orderBy(*order)
    local = dealt.withColumn("_at", F.row_number().over(here) - 1)
    met = local.join(offsets, local[group].eqNullSafe(offsets["_g"]) & (local["_part"] == offsets["_p"]))
    return met.withColumn("r", F.col("_offset") + F.col("_at")).drop("_part", "_at", "_g", "_p", "_offset")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """From (g, r, n, node), node being (h, item), one nested struct a block: (g, b, n, node)."""
    digits = [f"d{j}" for j in range(1, DIGITS + 1)]
    at = nodes.select("g", (F.floor(F.col("r") / BLOCK)).cast("long").alias("b"), "n", "node", *[(F.floor(F.col("r") / FAN ** (j - 1)) % FAN).cast("int").alias(f"d{j}") for j in range(1, DIGITS + 1)])
    # blocks are dealt once; every grouping below has their key in its own
    at = at.repartition("g", "b")
    for j, digit in enumerate(digits):
        rest = ["g", "b", "n", *digits[j + 1 :]]
        run = at.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(F.col(digit).alias("d"), "node"))).alias("kids"))
        on = F.ceil(F.col("n") / FAN**j) > 1
        own = F.when(on, digest(F.array_join(F.transform("kids", lambda k: k["node"]["h"]), ""))).otherwise(F.col("kids")[0]["node"]["h"])
        at = run.select(*rest, F.struct(own.alias("h"), on.alias("on"), "kids").alias("node"))
    return at


def _walk(node: str, above: str, level: int) -> str:
    """SQL: array of (item, path) of all leaves below `node`; path has a (left, right) for each level, lowest first."""
    if not level:
        return f"array(named_struct('item', {node}.item, 'path', {above}))"
    k, i, p = f"k{level}", f"i{level}", f"p{level}"
    side = lambda part: f"array_join(transform(slice({node}.kids, {part}), s -> s.node.h), '')"
    step = f"named_struct('left', {side(f'1, {i}')}, 'right', {side(f'{i} + 2, {FAN}')})"
    path = f"if({node}.on, concat(array({step}), {above}), {above})"
    # bound by a list of one, so that it is worked out once a node
    inner = f"transform(array({path}), {p} -> {_walk(f'{k}.node', p, level - 1)})[0]"
    return f"flatten(transform({node}.kids, ({k}, {i}) -> {inner}))"


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nested blocks of (g, r, n, h, item), and of their digests in turn, until each group is one block."""
    out = []
    at = nodes.select("g", "r", "n", F.struct("h", "item").alias("node"))
    while True:
        blocks = stored(rolled_up(at), "blocks")
        out.append(blocks)
        most = blocks.agg(F.max("n")).first()[0] or 0
        if most <= BLOCK:
            return out
        at = blocks.select("g", F.col("b").alias("r"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.struct(F.col("node.h").alias("h"), F.struct(F.col("b").alias("r")).alias("item")).alias("node"))


def unfolded(blocks: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, item, path, top) of all leaves, given (g, path, top) of each group."""
    at = above.select("g", F.lit(0).cast("long").alias("b"), "path", "top")
    for tier in reversed(blocks):
        none = lambda of, c: F.lit(None).cast(of.schema[c].dataType).alias(c)
        both = tier.select("g", "b", "node", none(at, "path"), none(at, "top")).unionByName(at.select("g", "b", none(tier, "node"), "path", "top"))
        met = both.groupBy("g", "b").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("node", "path", "top")])
        out = met.select("g", "top", F.explode(F.expr(_walk("node", "path", DIGITS))).alias("leaf")).select("g", "leaf.item", "leaf.path", "top")
        at = out.select("g", F.col("item.r").alias("b"), "path", "top") if tier is not blocks[0] else out
    return at


def proofs(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", key: str = "doc_id", presented: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of `docs`: (key, leaf, presented, subroot, root, path).

    path is an array of (left, right): the digests of the siblings before and after the node, level by level
    from the leaf to the root. `presented` names columns as they are shown for verification, if they differ
    from the stored ones; the column of that name is the digest of the row with them.
    """
    own = leaf(docs, columns)
    rows = docs.select(
        docs[group].cast("string").alias("g"), docs[key].alias("key"), own.alias("h"),
        (leaf(docs, columns, presented) if presented else own).alias("shown"),
    )
    leaves = ranked(rows, "g", [F.col("key").asc_nulls_first(), F.col("h")])
    shown = F.when(F.col("shown") != F.col("h"), F.col("shown"))
    below = tiers(leaves.select("g", "r", "n", "h", F.struct("key", F.col("h").alias("leaf"), shown.alias("shown")).alias("item")))
    subroots = below[-1].select(F.lit(0).alias("all"), F.col("g").alias("source"), F.col("node.h").alias("h"))
    places = ranked(subroots, "all", [F.col("source").asc_nulls_first()])
    upper = tiers(places.select(F.col("all").alias("g"), "r", "n", "h", F.struct("source", F.col("h").alias("subroot")).alias("item")))
    nowhere = F.array().cast("array<struct<left:string,right:string>>")
    sources = unfolded(upper, upper[-1].select("g", nowhere.alias("path"), F.struct(F.col("node.h").alias("root")).alias("top")))
    found = unfolded(below, sources.select(F.col("item.source").alias("g"), "path", F.struct("item.subroot", "top.root").alias("top")))
    return found.select(
        F.col("item.key").alias("key"), "item.leaf", F.coalesce("item.shown", "item.leaf").alias("presented"), "top.subroot", "top.root", "path",
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_text(path: Column) -> Column:
    """The siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
