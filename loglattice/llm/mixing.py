"""Mixing sources to target weights by weighted fair queueing.

Method. Within a source the documents stand in a queue, in an order drawn from their ids. The virtual
finish time of a document is the number of source tokens up to and including it, divided by the weight of
the source; the queue is repeated up to `max_repeats` times. All copies are range-sorted by finish time and
cut where the running size reaches the budget. Sources that run dry leave their share to the others, so
the cut gives each source its water-filled target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import cut, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    """Number of words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def queue_key(doc_id: Column, seed: str) -> Column:
    """Place of a document in the queue of its source; the same in every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources in code-point order, null last, take the weights in turn. The budget is `share` times all sizes;
    a target stops at `max_repeats` times the size and the excess goes to the others by weight. Sources are
    filled in the order in which they would run dry, so one pass settles all of them. One row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    in_order = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    ranked = sources.select("source", "source_size", weight.cast("long").alias("weight")).withColumn("limit", F.col("source_size") * max_repeats)
    fill = everything.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * share
    full = F.coalesce(F.sum("limit").over(before), F.lit(0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the level reached if this source and all later ones share what the earlier, dry ones leave
    levels = ranked.withColumn("level", (budget - full) / rest).withColumn("turn", F.row_number().over(fill))
    dry = F.col("limit") <= F.col("level") * F.col("weight")
    last = F.min(F.when(~dry, F.struct("turn", "level"))).over(everything)["level"]
    return levels.withColumn("last", last).select(
        "source", "source_size", "weight", F.when(F.col("last").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("last") * F.col("weight"))).alias("target")
    )


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: str = "mix") -> DataFrame:
    """From (doc_id, source, size), one row per source: (source, source_size, weight, target, last_keys).

    last_keys[i] is the greatest queue key that pass i + 1 over the source takes, or null where it takes
    none. A document is taken once for each pass whose last key is not below its own, so a reader needs
    only this small table, and reruns agree.
    """
    slim = sizes.select("source", queue_key(F.col("doc_id"), seed).alias("key"), "size")
    # one row per place in a queue; rows of the same id stand at the same place
    places = slim.groupBy("source", "key").agg(F.sum("size").alias("size"))
    queued = stored(places.repartitionByRange("source", "key").withColumn("part", F.spark_partition_id()), "queues")
    parts = queued.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sources = cut(targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, max_repeats))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"))
    here = Window.partitionBy("source", "part").orderBy("key")
    local = queued.withColumn("upto", F.sum("size").over(here))
    at = local.join(offsets, local["source"].eqNullSafe(offsets["s"]) & (local["part"] == offsets["p"])).select("source", "key", "size", (F.col("upto") + F.col("offset")).alias("upto"))
    weigh = sources.select(F.col("source").alias("s"), "weight", "source_size")
    passes = at.join(weigh, at["source"].eqNullSafe(weigh["s"])).select("source", "key", "size", "upto", "weight", "source_size", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("pass"))
    copies = passes.select("source", "key", "size", "pass", ((F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("weight")).alias("finish"))
    order = ["finish", F.col("source").asc_nulls_last(), "key", "pass"]
    ranged = stored(copies.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "finish-times")
    total = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.sum("size").alias("n")).select("part", "n", F.coalesce(F.sum("n").over(total), F.lit(0)).alias("offset"))
    budget = sources.agg(F.sum("source_size") * share).first()[0] or 0
    # whole partitions before the cut are taken, whole ones after it are not; only the one it runs through is sorted
    sides = before.select(F.col("part").alias("p"), "offset", (F.col("offset") + F.col("n") <= budget).alias("whole")).where(F.col("offset") <= budget)
    near = ranged.join(sides, ranged["part"] == sides["p"])
    running = Window.partitionBy("part").orderBy(*order)
    edge = near.where("not whole").withColumn("upto", F.col("offset") + F.sum("size").over(running)).where(F.col("upto") <= budget)
    taken = near.where("whole").select("source", "key", "pass").unionByName(edge.select("source", "key", "pass"))
    last = taken.groupBy("source", "pass").agg(F.max("key").alias("last"))
    per_pass = [F.max(F.when(F.col("pass") == i, F.col("last"))).alias(f"k{i}") for i in range(max_repeats)]
    keys = last.groupBy(F.col("source").alias("s")).agg(*per_pass)
    return sources.join(keys, sources["source"].eqNullSafe(keys["s"]), "left").select("source", "source_size", "weight", "target", F.array(*[F.col(f"k{i}") for i in range(max_repeats)]).alias("last_keys"))


def _with_copies(rows: DataFrame, chosen: DataFrame, seed: str) -> DataFrame:
    """Rows (_row, _source, _id) joined with their source's plan and the number of times they are taken."""
    chosen = stored(chosen, "mix").withColumnRenamed("source", "_s")
    key = queue_key(F.col("_id"), seed)
    copies = F.aggregate("last_keys", F.lit(0), lambda n, k: n + F.coalesce((k >= F.col("_key")).cast("int"), F.lit(0)))
    joined = rows.withColumn("_key", key).join(chosen, rows["_source"].eqNullSafe(F.col("_s")))
    return joined.withColumn("_copies", copies)


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of `docs`.

    Null text has size 0; a null source is a source of its own. Rows that share source and doc_id are taken
    together. An empty table gives an empty result.
    """
    sizes = stored(sized(docs), "sizes")
    chosen = plan(sizes, weights, share, max_repeats, seed)
    rows = sizes.select("doc_id", "size", F.col("source").alias("_source"), F.col("doc_id").alias("_id"))
    out = _with_copies(rows, chosen, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each row of `docs`, with all its columns, as often as the mix takes it."""
    chosen = plan(sized(docs), weights, share, max_repeats, seed)
    rows = docs.select(F.struct("*").alias("_row"), F.col("source").cast("string").alias("_source"), F.col("doc_id").alias("_id"))
    out = _with_copies(rows, chosen, seed)
    return out.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_n")).select("_row.*")
