"""Dead-letter records: JSON lines, each holding an array of rejected events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEAD_LETTER

_ELEMENT = DEAD_LETTER["logs"].dataType.elementType


def to_records(rejected: DataFrame) -> DataFrame:
    """One record per rejected event: nothing has to be gathered into a group to be spooled."""
    present = set(rejected.columns)
    event = F.struct(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in _ELEMENT
        ]
    )
    return rejected.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(1).alias("count"),
        F.array(event).alias("logs"),
    )


def spool(rejected: DataFrame, path: str, mode: str = "append") -> None:
    to_records(rejected).write.mode(mode).option("compression", "gzip").json(path)


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEAD_LETTER).json(path)


def unpack(records: DataFrame) -> DataFrame:
    """Events back out of the records, of any batch size, in the event schema again."""
    event = records.select(F.explode("logs").alias("log")).select("log.*")
    return event.withColumn("timestamp", F.col("timestamp").try_cast("timestamp")).drop("errors")
