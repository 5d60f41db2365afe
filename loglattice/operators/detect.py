"""Anomaly detectors over log events.

The thresholds and windows here are our own definitions. Every detector first shrinks the events
to counts on a time grid (one row per key and hour, minute or day), so its windows run over a
number of rows set by the time range and not by the volume.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EVENT_COLUMNS, LEVELS, check_range
from .noise import first_match
from .predicates import TimeLike, conjunction, event_predicate, instant

SEVERE = LEVELS[LEVELS.index("ERROR"):]

# Our definition: message patterns of failures that need no baseline, first match wins.
CATASTROPHES = (
    ("out_of_memory", r"[Oo]ut of memory|OOM"),
    ("disk_full", r"No space left on device|disk full"),
    ("connection_refused", r"[Cc]onnection refused"),
)


def rows() -> Column:
    return F.count(F.lit(1))


def _grid(unit: str) -> Column:
    return F.date_trunc(unit, "timestamp")


def _minute(ts: Column) -> Column:
    """Minutes since the epoch."""
    return F.floor(F.unix_seconds(ts) / 60).cast("bigint")


def _window_sums(value: str, frame) -> dict[str, Column]:
    """Count, sum and sum of squares of whole numbers over a frame: exact, so thresholds never wobble."""
    x = F.col(value)
    return {
        "seen": F.count(x).over(frame),
        "s1": F.coalesce(F.sum(x).over(frame), F.lit(0)),
        "s2": F.coalesce(F.sum(x * x).over(frame), F.lit(0)),
    }


def _spread2() -> Column:
    """seen^2 * variance, a whole number."""
    return F.col("seen") * F.col("s2") - F.col("s1") * F.col("s1")


def _sigma() -> Column:
    return F.try_divide(F.sqrt(_spread2().cast("double")), F.col("seen"))


def error_spikes(events: DataFrame, *, alpha: float = 0.3, history: int = 12, sigmas: float = 2.0,
                 min_history: int = 6) -> DataFrame:
    """Service-hours whose error count exceeds the moving average by `sigmas` deviations.

    The average weighs the previous `history` observed hours by (1 - alpha)^age.
    """
    hours = events.groupBy("service", _grid("hour").alias("hour")).agg(
        F.count_if(F.col("level").isin(*SEVERE)).alias("errors")
    )
    by_time = Window.partitionBy("service").orderBy("hour")
    frame = by_time.rowsBetween(-history, -1)
    lags = [F.lag("errors", k).over(by_time) for k in range(1, history + 1)]
    weights = [(1 - alpha) ** (k - 1) for k in range(1, history + 1)]
    weighted = sum((F.coalesce(x * F.lit(w), F.lit(0.0)) for x, w in zip(lags, weights, strict=True)), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for x, w in zip(lags, weights, strict=True)),
                 F.lit(0.0))
    scored = hours.select(
        "service", "hour", "errors",
        F.try_divide(weighted, weight).alias("ewma"),
        *[c.alias(n) for n, c in _window_sums("errors", frame).items()],
    ).withColumn("sigma", _sigma())
    return scored.filter(
        (F.col("seen") >= min_history) & (F.col("errors") > F.col("ewma") + F.lit(sigmas) * F.col("sigma"))
    ).drop("seen", "s1", "s2")


def new_error_templates(templates: DataFrame, since: TimeLike) -> DataFrame:
    """Severe templates first seen in the window."""
    return templates.filter((F.col("first_seen") >= instant(since)) & F.col("level").isin(*SEVERE))


def template_anomalies(templated: DataFrame, *, history: int = 7, sigmas: float = 2.0,
                       min_history: int = 3) -> DataFrame:
    """Template-days whose count leaves the band of mean +- `sigmas` over the previous observed days."""
    days = templated.groupBy("template_hash", F.to_date("timestamp").alias("day")).agg(rows().alias("n"))
    frame = Window.partitionBy("template_hash").orderBy("day").rowsBetween(-history, -1)
    scored = days.withColumns(_window_sums("n", frame)).filter(F.col("seen") >= min_history)
    # |n - mean| > k sigma, multiplied out by seen^2
    off = F.col("seen") * F.col("n") - F.col("s1")
    return scored.filter(off * off > F.lit(sigmas * sigmas) * _spread2()).select(
        "template_hash", "day", "n", F.try_divide(F.col("s1"), F.col("seen")).alias("mean"), _sigma().alias("sigma")
    )


def silences(events: DataFrame, as_of: TimeLike) -> DataFrame:
    """Hours up to `as_of` in which a service known by then logged nothing."""
    hours = events.filter(F.col("timestamp") <= instant(as_of)).select("service", _grid("hour").alias("hour")).distinct()
    last = F.date_trunc("hour", instant(as_of))
    spine = (
        hours.groupBy("service")
        .agg(F.min("hour").alias("first"))
        .select("service", F.explode(F.sequence("first", last, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    )
    return spine.join(hours, ["service", "hour"], "left_anti")


def catastrophe(text: Column) -> Column:
    return first_match(text, CATASTROPHES)


def catastrophes(templates: DataFrame) -> DataFrame:
    """Templates naming a catastrophic failure: the patterns run once per template, not per event."""
    return templates.withColumn("kind", catastrophe(F.col("canonical_text"))).filter(F.col("kind").isNotNull())


def correlations(events: DataFrame, a: Column, b: Column, *, by: str = "host", minutes: int = 5) -> DataFrame:
    """Minutes with an A event that B events follow, on the same key, in the same or next `minutes` minutes.

    Counts per key and minute meet, never single events, so a busy minute costs one row.
    """
    grid = (
        events.filter(a | b)
        .groupBy(by, _minute(F.col("timestamp")).alias("minute"))
        .agg(F.count_if(a).alias("a_count"), F.count_if(b).alias("b_count"))
    )
    ahead = Window.partitionBy(by).orderBy("minute").rangeBetween(0, minutes)
    return (
        grid.withColumn("b_following", F.sum("b_count").over(ahead))
        .filter((F.col("a_count") > 0) & (F.col("b_following") > 0))
        .select(by, "minute", "a_count", "b_following")
    )


def fires(slots: np.ndarray, minutes: int, last: int | None = None) -> list[int]:
    """Of ascending minutes those that fire, each silencing the next `minutes`; one search per alert that fires."""
    out: list[int] = []
    at = 0 if last is None else int(np.searchsorted(slots, last + minutes))
    while at < len(slots):
        out.append(int(slots[at]))
        at = int(np.searchsorted(slots, out[-1] + minutes))
    return out


def cooldown(alerts: DataFrame, *, key: str, minutes: int) -> DataFrame:
    """Alerts that fire when each one silences its key for `minutes` minutes.

    Whether an alert fires depends on the one fired before it, so a key is folded in time order. After a pause
    of `minutes` the next alert fires whatever was before, so a key is cut there and its stretches are folded
    apart. A stretch is a list of distinct minutes, as long as its time range, however many alerts.
    """
    check_range("minutes", minutes, 1)
    slots = alerts.groupBy(key, _minute(F.col("timestamp")).alias("minute")).agg(rows().alias("n"))
    order = Window.partitionBy(key).orderBy("minute")
    pause = F.coalesce(F.col("minute") - F.lag("minute").over(order) >= minutes, F.lit(True))
    cut = slots.withColumn("stretch", F.sum(pause.cast("long")).over(order)).select(key, "stretch", "minute")

    def fold(stretch: pa.Table) -> pa.Table:
        fired = fires(np.sort(stretch.column("minute").to_numpy()), minutes)
        return pa.table({key: stretch.column(key).slice(0, 1).combine_chunks().take(pa.array([0] * len(fired), pa.int32())), "minute": pa.array(fired, pa.int64())})

    kind = alerts.schema[key].dataType.simpleString()
    folded = cut.groupBy(key, "stretch").applyInArrow(fold, f"{key} {kind}, minute long")
    return folded.withColumn("fired_at", F.timestamp_seconds(F.col("minute") * 60))


def cooldown_stream(alerts: DataFrame, *, key: str, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """`cooldown` on a stream: the state of a key is the minute that fired last, dropped once it silences nothing.

    Alerts may come up to `delay` out of order across batches, and are put in order within a batch; one that is
    older than the last alert fired never fires, and one older than the watermark is ignored.
    """
    check_range("minutes", minutes, 1)

    def fold(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        slots = np.unique(np.concatenate([f["minute"].to_numpy() for f in frames]))
        fired = fires(slots, minutes, state.get[0] if state.exists else None)
        if fired:
            state.update((fired[-1],))
        if state.exists:
            silent_until = (state.get[0] + minutes) * 60_000
            state.setTimeoutTimestamp(max(silent_until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]] * len(fired), "minute": np.array(fired, dtype=np.int64)})

    kind = alerts.schema[key].dataType.simpleString()
    slots = alerts.withWatermark("timestamp", delay).select(key, "timestamp", _minute(F.col("timestamp")).alias("minute"))
    fired = slots.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, minute long", "last long", "append", "EventTimeTimeout")
    return fired.withColumn("fired_at", F.timestamp_seconds(F.col("minute") * 60))


def template_stats(templated: DataFrame, key: str = "template_hash") -> DataFrame:
    """Count, span, hosts and trend of each template: events a day over its active days, and the busiest of them."""
    days = templated.groupBy(key, "host", F.to_date("timestamp").alias("day")).agg(
        rows().alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )
    # a template's hosts and days are counted apart: each is a plain sum of what is left of the events
    per_day = days.groupBy(key, "day").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    span = per_day.groupBy(key).agg(
        F.sum("n").alias("event_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.count(F.lit(1)).alias("active_days"), F.max(F.struct("n", "day")).alias("peak"),
    )
    hosts = days.select(key, "host").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("hosts"))
    return span.join(hosts, key).select(
        key, "event_count", "first_seen", "last_seen", "hosts", "active_days",
        F.round(F.col("event_count") / F.col("active_days"), 4).alias("per_active_day"), F.col("peak.n").alias("peak_n"), F.col("peak.day").alias("peak_day"),
    )


def context_bundle(incidents: DataFrame, templated: DataFrame, *, minutes: int = 30, top: int = 5) -> DataFrame:
    """Most frequent templates of the incident's service in the `minutes` before and after it, and the number
    of all events there.

    `incidents` holds incident_id, service and minute. Events are counted per template and minute
    first. Time is cut into slots as wide as the window, an incident looks at three of them.
    """
    check_range("top", top, 1, 100)
    slot = lambda m: F.floor(m / minutes).cast("bigint")
    counts = (
        templated.groupBy("service", "template_hash", _minute(F.col("timestamp")).alias("minute"))
        .agg(rows().alias("n"))
        .withColumn("slot", slot(F.col("minute")))
    )
    # incidents of one service and minute share their surroundings, which are worked out once
    asked = incidents.select("service", F.col("minute").alias("at")).distinct().select(
        "service", "at", F.explode(F.sequence(slot(F.col("at")) - 1, slot(F.col("at")) + 1)).alias("slot")
    )
    near = counts.join(asked, ["service", "slot"]).filter(F.abs(F.col("minute") - F.col("at")) <= minutes)
    totals = near.groupBy("service", "at", "template_hash").agg(F.sum("n").alias("n"))
    here = Window.partitionBy("service", "at")
    rank = F.row_number().over(here.orderBy(F.col("n").desc(), "template_hash"))
    best = totals.withColumn("rank", rank).withColumn("all", F.sum("n").over(here)).filter(F.col("rank") <= top)
    bundles = best.groupBy("service", F.col("at").alias("minute")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "template_hash", "n"))).alias("templates"),
        F.max("all").alias("events"),
    )
    return incidents.select("incident_id", "service", "minute").join(bundles, ["service", "minute"])


def service_overview(templated: DataFrame, as_of: TimeLike, hours: int = 24) -> DataFrame:
    """Per service over the last hours: volume, severities, hosts and distinct templates."""
    check_range("hours", hours, 1)
    end = instant(as_of)
    recent = templated.filter((F.col("timestamp") > end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("timestamp") <= end))
    # one row per service, host and template: the distinct counts below then see few rows
    grid = recent.groupBy("service", "host", "template_hash", "level").agg(rows().alias("n"), F.max("timestamp").alias("last"))
    return grid.groupBy("service").agg(
        F.sum("n").alias("events"),
        F.coalesce(F.sum(F.when(F.col("level").isin(*SEVERE), F.col("n"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("level").isin("WARN", "WARNING"), F.col("n"))), F.lit(0)).alias("warnings"),
        F.countDistinct("host").alias("hosts"),
        F.countDistinct("template_hash").alias("templates"),
        F.max("last").alias("last_seen"),
    )


def log_context(events: DataFrame, timestamp: TimeLike, event_id: int, *, around: int = 5, **filters) -> DataFrame:
    """The event and its neighbours in time: two top-k scans, no global ordering."""
    check_range("around", around, 1, 1000)
    at, same = instant(timestamp), events.filter(conjunction(event_predicate(**filters)))
    older = (F.col("timestamp") < at) | ((F.col("timestamp") == at) & (F.col("id") <= event_id))
    before = same.filter(older).orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(around + 1)
    after = same.filter(~older).orderBy("timestamp", "id").limit(around)
    return before.unionByName(after).select(*EVENT_COLUMNS)
