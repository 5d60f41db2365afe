"""Per-record validation: every violated rule is named, nothing fails the batch."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.journald import normalise_meta
from ..schemas import EVENT_COLUMNS, LEVELS, LOG_EVENTS, MAX_BATCH_EVENTS, MAX_LENGTHS, REQUIRED_FIELDS, check_range

_TYPES = {f.name: f.dataType for f in LOG_EVENTS}


def with_all_fields(df: DataFrame) -> DataFrame:
    """Add absent event columns as typed nulls, so a producer may leave optional fields out."""
    missing = [c for c in EVENT_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(_TYPES[c]) for c in missing}) if missing else df


def _rules() -> list[tuple[Column, str]]:
    rules = [(F.col(f).isNull(), f"{f}:required") for f in REQUIRED_FIELDS]
    rules += [(F.length(f) > n, f"{f}:max_length") for f, n in MAX_LENGTHS.items()]
    rules.append((~F.col("level").isin(*LEVELS), "level:enum"))
    not_an_object = F.from_json("meta_json", "map<string,string>").isNull()
    rules.append((F.col("meta_json").isNotNull() & not_an_object, "meta_json:object"))
    return rules


def error_codes() -> Column:
    """Array of `<field>:<rule>` codes, empty for a valid record.

    Valid records, nearly all, are recognised by one compiled condition; codes are only put
    together for the others.
    """
    rules = _rules()
    violated = reduce(or_, [F.coalesce(broken, F.lit(False)) for broken, _ in rules])
    codes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]))
    return F.when(violated, codes).otherwise(F.array().cast("array<string>"))


def validate(df: DataFrame) -> DataFrame:
    """Add `errors`; an empty metadata object becomes null."""
    return (
        with_all_fields(df)
        .withColumn("errors", error_codes())
        .withColumn("meta_json", normalise_meta(F.col("meta_json")))
    )


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def check_batch(df: DataFrame, max_events: int = MAX_BATCH_EVENTS) -> DataFrame:
    """Bounds of one interactive batch: not empty, not above the cap. Bulk loads do not pass here."""
    check_range("max_events", max_events, 1)
    seen = df.limit(max_events + 1).count()
    if seen == 0:
        raise ValueError("batch holds no events")
    if seen > max_events:
        raise ValueError(f"batch holds more than {max_events} events")
    return df
