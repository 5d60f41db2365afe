"""Embedding near-duplicates with randomised-rotation binary codes.

Method. Unit vectors are rotated at random and reduced to their signs. With each code goes its correction
factor, the inner product a of the code (as a unit vector) and the vector it stands for. For another vector q,
<q, code> / a is an unbiased estimate of <q, vector>, with an error of about
sqrt((1 - a^2) / a^2) * sqrt(1 - <q, code>^2) / sqrt(dims - 1). The upper end of its confidence interval
decides which pairs are recomputed exactly; only the exact cosine links.

Candidates. Rows of a label meet when the first bits of a code agree. The number of bits follows the rows of
the label, so that a bucket holds about `bucket` rows, and the number of codes (tables) follows from the bits,
so that a pair at the threshold misses all of them with probability below `miss`. Buckets are compared in
tiles of bounded size, and a pair is counted in the first table where it meets, so no pair list is shuffled.
Equal vectors are one row with a count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import cut, stored
from loglattice.llm.components import components
from loglattice.llm.vectors import matrix, rotation, unit, usable

SEED = 20
TILE = 512


def n_tables(bits: int, threshold: float, miss: float) -> int:
    """Tables of `bits` sign bits for which a pair at the threshold agrees nowhere with probability `miss`."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if bits == 0 else math.ceil(math.log(miss) / math.log1p(-agree))


def bucket_keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): the sign bits of each table, from as many rotations as it takes."""
    rows, dims = vectors.shape
    need = bits * tables
    turns = [vectors @ rotation(dims, 1 + i, SEED) > 0 for i in range(-(-need // dims))] if need else []
    if not turns:
        return np.zeros((rows, tables), dtype=np.int64)
    signs = np.concatenate(turns, axis=1)[:, :need].reshape(rows, tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def linked(left: np.ndarray, right: np.ndarray, threshold: float, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows with cosine >= threshold: estimated from codes, recomputed where it may matter."""
    dims = left.shape[1]
    turn = rotation(dims, 0, SEED)
    spun, coded = left @ turn, right @ turn
    code = np.where(coded > 0, 1.0, -1.0) / math.sqrt(dims)
    factor = (coded * code).sum(axis=1)
    raw = spun @ code.T
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dims - 1))
    upper = raw / factor + confidence * spread * np.sqrt(np.maximum(0, 1 - raw**2))
    i, j = np.nonzero(upper >= threshold)
    sure = (left[i] * right[j]).sum(axis=1) >= threshold
    return i[sure], j[sure]


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, bucket: int = 256, miss: float = 1e-4, confidence: float = 5.0,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Rows link when their labels are equal and not null and their cosine is at least `threshold`. Null,
    zero and non-finite vectors, vectors of other dimensions, and rows without a label link with nothing:
    0 links, a component of their own. Equal vectors always link. Repeated rows count as rows; different
    vectors under one id are vectors each. An empty table gives an empty result; other columns play no part.
    """
    rows = stored(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")), "vectors")
    valid = rows.where(usable(F.col("v")) & F.col("label").isNotNull())
    # a number for each different vector of a label, fixed once it is written: ids may repeat
    distinct = cut(valid.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")).withColumn("rep", F.monotonically_increasing_id()))
    # bits and tables follow the rows of the label
    sizes = distinct.groupBy("label").agg(F.count("*").alias("rows")).select("label", F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / bucket))).cast("int").alias("bits"))
    keyed = distinct.join(sizes, "label")
    kind = dict(distinct.dtypes)["label"]
    spec = f"bucket string, label {kind}, tab int, keys array<int>, rep long, n long, v array<double>"

    def spread(batches):
        for batch in batches:
            frame = {n: batch.column(n) for n in ("label", "v", "n", "rep", "bits")}
            dims = np.diff(frame["v"].offsets.to_numpy())
            bits = frame["bits"].to_numpy()
            for d, b in sorted(set(zip(dims.tolist(), bits.tolist(), strict=True))):
                at = np.flatnonzero((dims == d) & (bits == b))
                own = unit(matrix(frame["v"].take(pa.array(at)), d))
                tables = n_tables(b, threshold, miss)
                keys = bucket_keys(own, b, tables)
                labels, reps, ns = (frame[c].take(pa.array(at)) for c in ("label", "rep", "n"))
                names = labels.cast(pa.string()).to_pylist()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel(), pa.int32()))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, d), pa.int32()), pa.array(own.ravel()))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{n}/{d}/{t}/{k}" for n, k in zip(names, keys[:, t].tolist(), strict=True)]), labels, pa.array([t] * len(at), pa.int32()), lists, reps, ns, flat],
                        names=["bucket", "label", "tab", "keys", "rep", "n", "v"],
                    )

    placed = stored(keyed.mapInArrow(spread, spec), "buckets")
    counts = placed.groupBy("bucket").agg(F.count("*").alias("rows")).select("bucket", F.ceil(F.col("rows") / TILE).cast("int").alias("parts"))
    # a bucket of p parts is compared in p * (p + 1) / 2 tiles, each in a task of its own
    tiled = placed.join(counts, "bucket").withColumn("part", F.pmod(F.hash("rep", "v"), F.col("parts")))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    sent = tiled.withColumn("with", F.explode(others)).select("bucket", "tab", "keys", "rep", "n", "v", "part", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"))

    def compare(batch: pa.Table) -> pa.Table:
        part, x, y = (batch.column(c).to_numpy() for c in ("part", "x", "y"))
        tab = batch.column("tab")[0].as_py()
        first, second = np.flatnonzero(part == x), np.flatnonzero(part == y)
        same = x[0] == y[0]
        v = matrix(batch.column("v"), len(batch.column("v")[0]))
        keys = np.asarray(batch.column("keys").combine_chunks().flatten()).reshape(len(v), -1)
        rep, n = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
        i, j = linked(v[first], v[second], threshold, confidence)
        i, j = first[i], second[j]
        if same:
            i, j = i[i < j], j[i < j]
        if tab:  # met before
            new = ~(keys[i, :tab] == keys[j, :tab]).any(axis=1)
            i, j = i[new], j[new]
        count = np.zeros(len(v), dtype=np.int64)
        np.add.at(count, i, n[j])
        np.add.at(count, j, n[i])
        low = rep.copy()
        while len(i):  # the smallest row reachable inside the tile stands for all its links
            before = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            if (before == low).all():
                break
        at = np.flatnonzero(count)
        return pa.table({"rep": rep[at], "low": low[at], "links": count[at]})

    found = stored(sent.groupBy("bucket", "x", "y").applyInArrow(compare, "rep long, low long, links long"), "links")
    n_links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
    least = comps.join(distinct.select(F.col("rep").alias("node"), "low"), "node").groupBy("component").agg(F.min("low").alias("component_id"))
    placed_in = comps.join(least, "component").select(F.col("node").alias("rep"), "component_id")
    groups = distinct.select("label", "v", "n", "low", "rep").join(n_links, "rep", "left").join(placed_in, "rep", "left")
    members = groups.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    joined = rows.join(members, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
