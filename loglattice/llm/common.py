"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where that is unset, one beside the warehouse, which is shared as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends in files of the shared folder, which Spark removes when unused."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """A table written to the shared folder and read again: ends the lineage, prunes columns, and has a known size."""
    path = f"{shared_folder(df.sparkSession)}/{purpose}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash01(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the values, the same on every run and at every size."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def id_hash(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod `modulus`; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def over_budget(n_bytes: Column, budget: int) -> Column:
    return F.when(n_bytes > 0, F.least(F.lit(1.0), F.lit(float(budget)) / n_bytes)).otherwise(F.lit(1.0))


def pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of consecutive rows of at most `limit` bytes in all, or of one longer row."""
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)
