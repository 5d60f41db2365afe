"""Approximate nearest neighbours with a forest of hash prefixes.

Method. Every tree has its own random rotation; the signs of a rotated vector are its hash string, and a
tree is the sorted array of the strings of all rows. A query descends in every tree to the longest prefix
that it shares with any row, and then ascends in all trees at the same time: at each level the rows that
share that many leading bits in at least one tree become candidates and are compared exactly. The ascent
ends when a row as near as the k-th best so far would have been met by then with probability
1 - `miss`: it shares x bits with the query in one tree with probability (1 - angle / pi)^x. Queries with
close neighbours stop early; on data without any structure the ascent goes on as far as it takes, so the
promised recall holds there too and there is no cap on candidates.

Rows are dealt to shards of about `shard` rows, each with its own forest, and queries to blocks; a task
searches one shard for one block, and the best of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.vectors import matrix, rotation, unit, usable

SEED = 31
BITS = 63


def hash_strings(vectors: np.ndarray, trees: int) -> np.ndarray:
    """(trees, rows): the first 63 sign bits per tree, most significant first; more rotations if dims are few."""
    dims = vectors.shape[1]
    turns = -(-BITS // dims)
    out = np.zeros((trees, len(vectors)), dtype=np.int64)
    for t in range(trees):
        signs = np.concatenate([vectors @ rotation(dims, t * turns + i, SEED) > 0 for i in range(turns)], axis=1)[:, :BITS]
        out[t] = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
    return out


class Forest:
    """Sorted arrays of the hash strings of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int):
        self.ids, self.raw, self.unit = ids, vectors, unit(vectors)
        strings = hash_strings(self.unit, trees)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, miss: float):
        """(query, row, score) of the k best rows met, without the row of the query's own id."""
        trees = len(self.sorted)
        directions = unit(queries)
        strings = hash_strings(directions, trees)
        levels = np.arange(BITS + 1)
        low = strings[:, :, None] >> (BITS - levels) << (BITS - levels)
        size = np.int64(1) << (BITS - levels[1:])
        start, end = np.zeros(low.shape, dtype=np.int64), np.full(low.shape, len(self.ids))
        for t in range(trees):  # a whole tree at level 0
            start[t, :, 1:] = np.searchsorted(self.sorted[t], low[t, :, 1:], "left")
            end[t, :, 1:] = np.searchsorted(self.sorted[t], low[t, :, 1:] + (size - 1), "right")
        held = (end - start).sum(axis=0)
        out = []
        for q in range(len(query_ids)):
            seen = self.ids == query_ids[q]
            best_score, best_row = np.zeros(0), np.zeros(0, dtype=np.int64)
            # descend: the longest prefixes that k rows share; then up, all trees together
            level = int(np.flatnonzero(held[q] > min(k, len(self.ids) - 1))[-1])
            while True:
                new = np.zeros(len(self.ids), dtype=bool)
                for t in range(trees if level else 1):
                    new[self.order[t, start[t, q, level] : end[t, q, level]]] = True
                new &= ~seen
                seen |= new
                rows = np.flatnonzero(new)
                scores = self.unit[rows] @ directions[q]
                best_score, best_row = np.concatenate([best_score, scores]), np.concatenate([best_row, rows])
                if len(best_row) > k:
                    # ties at the edge stay until the exact comparison
                    edge = np.partition(best_score, -k)[-k] - 1e-9
                    near = best_score >= edge
                    best_score, best_row = best_score[near], best_row[near]
                if level == 0:
                    break
                if len(best_row) >= k:
                    kth = np.partition(best_score, -k)[-k]
                    share = (1 - np.arccos(np.clip(kth, -1, 1)) / np.pi) ** level
                    if (1 - share) ** trees <= miss:
                        break
                level -= 1
            exact = cosine(queries[q], self.raw[best_row])
            for i in np.lexsort((self.ids[best_row], -exact))[:k]:
                out.append((query_ids[q], self.ids[best_row[i]], exact[i]))
        return out


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row in a fixed order of additions, so that equal vectors score equally."""
    top = (rows * query).sum(axis=1)
    if np.isfinite(top).all() and (norm := np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())).all() and np.isfinite(norm).all():
        return top / norm
    return (unit(rows) * unit(query[None])).sum(axis=1)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = 16, miss: float = 0.05, shard: int = 16_384, query_block: int = 4_096,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows found by cosine, nearest first.

    Ties go to the smaller vec_id. The row of the query's own id is no candidate. Null, zero and non-finite
    vectors take no part on either side; a query meets only vectors of its own dimensions. With fewer
    than k candidates all are returned. Repeated rows are candidates each; a repeated query is answered once.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    asked = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).dropDuplicates(["id"])
    # two numbers decide the layout: how many shards, how many blocks
    n_rows, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, -(-n_rows // shard)), max(1, -(-n_asked // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # keys of one type on both sides: a cogroup sends an int and a long of the same value to different tasks
    own = lambda purpose, n: F.pmod(F.xxhash64("id", F.lit(purpose)), F.lit(n)).cast("int")
    left = rows.select("id", "v", F.size("v").alias("dims"), own("shard", shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("id", "v", F.size("v").alias("dims"), own("block", blocks).alias("block"), every(shards).alias("shard"))

    def search(own: pa.Table, wanted: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and wanted.num_rows:
            dims = own.column("dims")[0].as_py()
            forest = Forest(own.column("id").to_numpy(), matrix(own.column("v"), dims), trees)
            found = forest.search(wanted.column("id").to_numpy(), matrix(wanted.column("v"), dims), k, miss)
        q, r, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(r, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["shard", "block", "dims"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
