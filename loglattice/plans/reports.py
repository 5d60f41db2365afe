"""Volume, level, gap, noise and growth reports over log events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.noise import NoiseConfig, drop_reason, first_match
from ..schemas import LEVELS, check_range
from .query import latest

MICROS = 1_000_000

# Our definition: message patterns that make a record worth reading, first match wins.
SIGNAL_CATEGORIES = (
    ("firewall_block", r"\[UFW BLOCK\]"),
    ("auth_failure", r"Failed password|authentication failure"),
    ("ssh_login", r"Accepted (password|publickey)"),
    ("session", r"session (opened|closed)|session-\d+\.scope"),
    ("cron", r"CRON\[\d+\]"),
    ("service_state", r"Started |Stopped |Starting "),
)


def rows() -> Column:
    return F.count(F.lit(1))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def noisiest_services(events: DataFrame, n: int = 20) -> DataFrame:
    check_range("n", n, 1)
    return events.groupBy("service").agg(rows().alias("n")).orderBy(F.col("n").desc(), "service").limit(n)


def level_distribution(events: DataFrame) -> DataFrame:
    counts = events.groupBy("level").agg(rows().alias("n"))
    # at most one row per level here
    return counts.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def latest_logs(events: DataFrame, n: int = 10) -> DataFrame:
    return latest(events, n)


def daily_volume(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("timestamp").alias("day")).agg(rows().alias("n"))


def daily_average(events: DataFrame) -> DataFrame:
    return daily_volume(events).agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("logs"), F.round(F.avg("n"), 2).alias("avg_per_day")
    )


def hourly_volume(events: DataFrame) -> DataFrame:
    """Average, minimum and maximum rows per hour, for each day."""
    hours = events.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(rows().alias("n"))
    return hours.groupBy(F.to_date("hour").alias("day")).agg(
        F.round(F.avg("n"), 2).alias("avg_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n")
    )


def service_share(events: DataFrame, top: int = 4) -> DataFrame:
    """The `top` busiest services by name, all others as one row."""
    counts = events.groupBy("service").agg(rows().alias("n"))
    # `top` rows
    leaders = counts.orderBy(F.col("n").desc(), "service").limit(top).select("service", F.col("service").alias("label"))
    labelled = counts.join(F.broadcast(leaders), "service", "left")
    grouped = labelled.groupBy(F.coalesce("label", F.lit("Other")).alias("service")).agg(F.sum("n").alias("n"))
    # top + 1 rows
    return grouped.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def message_lengths(events: DataFrame) -> DataFrame:
    return events.agg(
        F.round(F.avg(F.length("message")), 2).alias("avg_message"),
        F.max(F.length("message")).alias("max_message"),
        F.round(F.avg(F.length("meta_json")), 2).alias("avg_meta"),
        F.max(F.length("meta_json")).alias("max_meta"),
    )


def floor_div(value: Column, width: int) -> Column:
    """Integer bucket number, exact for values before the epoch too."""
    return ((value - F.pmod(value, F.lit(width))) / width).cast("bigint")


def data_gaps(events: DataFrame, threshold: timedelta, by: str | None = None, chunk: int = 4096) -> DataFrame:
    """Intervals longer than `threshold` without a record, overall or per value of `by`.

    Cut time into buckets as wide as the threshold: two records of one bucket are never further
    apart than it, so every gap runs from the last record of a bucket to the first of the next
    bucket in use. One pre-aggregated row per bucket is enough; the ordering works on those rows,
    in chunks of buckets whose ends are then joined up.
    """
    width = int(threshold.total_seconds() * MICROS)
    check_range("threshold in microseconds", width, 1)
    key = [by] if by else []
    us = F.unix_micros("timestamp")
    buckets = (
        events.filter(F.col("timestamp").isNotNull())
        .groupBy(*key, floor_div(us, width).alias("bucket"))
        .agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
        .withColumn("chunk", floor_div(F.col("bucket"), chunk))
    )
    inner = Window.partitionBy(*key, "chunk").orderBy("bucket")
    within = buckets.select(*key, F.lag("hi").over(inner).alias("before"), F.col("lo").alias("after"))
    edges = buckets.groupBy(*key, "chunk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    outer = Window.partitionBy(*key).orderBy("chunk")
    across = edges.select(*key, F.lag("hi").over(outer).alias("before"), F.col("lo").alias("after"))
    return (
        within.unionByName(across)
        .filter(F.col("after") - F.col("before") > width)
        .select(
            *key,
            F.timestamp_micros("before").alias("gap_start"),
            F.timestamp_micros("after").alias("gap_end"),
            (F.col("after") - F.col("before")).alias("gap_us"),
        )
    )


def compression_ratio(templates: DataFrame) -> DataFrame:
    """Events per template, from the dimension alone."""
    return templates.agg(F.sum("event_count").alias("events"), rows().alias("templates")).withColumn(
        "ratio", F.round(F.try_divide(F.col("events") * F.lit(1.0), F.col("templates")), 2)
    )


def signal_category(message: Column) -> Column:
    return first_match(message, SIGNAL_CATEGORIES)


def signal_class(config: NoiseConfig) -> Column:
    """Our definition: noise if a rule drops it, signal if severe or of a known category, else ambiguous."""
    severe = F.col("level").isin(*LEVELS[LEVELS.index("WARN"):])
    return (
        F.when(drop_reason(config).isNotNull(), "noise")
        .when(severe | signal_category(F.col("message")).isNotNull(), "signal")
        .otherwise("ambiguous")
    )


def noise_breakdown(events: DataFrame, config: NoiseConfig) -> DataFrame:
    """Rows per rule and their share of all rows; kept rows appear as `(kept)`."""
    counts = events.groupBy(F.coalesce(drop_reason(config), F.lit("(kept)")).alias("rule")).agg(rows().alias("n"))
    # one row per rule
    return counts.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def signal_to_noise(events: DataFrame, config: NoiseConfig) -> DataFrame:
    """One row: class counts and the signal share before and after the filter."""
    counts = events.select(signal_class(config).alias("c")).agg(
        *[F.count_if(F.col("c") == c).alias(c) for c in ("noise", "signal", "ambiguous")]
    )
    everything = F.col("noise") + F.col("signal") + F.col("ambiguous")
    return counts.withColumns(
        {
            "signal_pct_before": percent(F.col("signal"), everything),
            "signal_pct_after": percent(F.col("signal"), F.col("signal") + F.col("ambiguous")),
        }
    )


def signal_breakdown(events: DataFrame) -> DataFrame:
    return (
        events.select(signal_category(F.col("message")).alias("category"))
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(rows().alias("n"))
    )


def what_if(events: DataFrame, config: NoiseConfig, samples: int = 3) -> DataFrame:
    """What a rule set would do to stored records: counts per outcome with the newest examples."""
    check_range("samples", samples, 1, 20)
    tagged = events.select(
        F.coalesce(drop_reason(config), F.lit("(kept)")).alias("outcome"), "id", "timestamp", "service", "message"
    )
    counts = tagged.groupBy("outcome").agg(rows().alias("n"))
    newest = Window.partitionBy("outcome").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    examples = tagged.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= samples)
    return examples.join(counts, "outcome").select("outcome", "n", "rank", "id", "service", "message")


def growth_projection(
    events: DataFrame, bytes_per_row: int, horizons: tuple[int, ...] = (1, 7, 30, 90), nodes: int = 1
) -> DataFrame:
    """Mean rows per day, times bytes per row, over each horizon in days."""
    daily = daily_volume(events).agg(F.avg("n").alias("rows_per_day"))
    horizon = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days")
    return daily.select("rows_per_day", horizon).select(
        "horizon_days",
        F.round(F.col("rows_per_day") * F.col("horizon_days") * nodes, 0).cast("bigint").alias("rows"),
        F.round(F.col("rows_per_day") * F.col("horizon_days") * bytes_per_row * nodes / 1e6, 3).alias("megabytes"),
    )


def logs_per_host(events: DataFrame) -> DataFrame:
    return events.groupBy("host").agg(rows().alias("n"))


def embedding_coverage(df: DataFrame, column: str = "embedding_vector") -> DataFrame:
    return df.agg(
        rows().alias("total"), F.count(column).alias("embedded"), F.count_if(F.col(column).isNull()).alias("missing")
    ).withColumn("pct", percent(F.col("embedded"), F.col("total")))
