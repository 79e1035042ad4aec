"""Ratios, cost, day buckets and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def day_of(ms: Column, tz: str = "UTC") -> Column:
    """Calendar date of an epoch-millisecond value in a zone, whatever the session zone is."""
    if tz.upper() in ("UTC", "Z"):
        return F.date_from_unix_date(F.floor(ms / F.lit(DAY_MS)).cast("int"))
    utc = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.floor(ms / F.lit(DAY_MS)).cast("int"), F.lit(0), F.lit(0),
        (F.pmod(ms, F.lit(DAY_MS)) / F.lit(1000)).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc).cast("date")


def day_text(ms: Column, tz: str = "UTC") -> Column:
    return day_of(ms, tz).cast("string")


def millis_of(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def ratio(part: Column, base: Column) -> Column:
    """part / base, and 0 where the base is 0 or missing."""
    return F.when(base > 0, part / base).otherwise(F.lit(0.0))


def ratio_or_null(part: Column, base: Column) -> Column:
    return F.when(base > 0, part / base)


def mean(total: Column, n: Column) -> Column:
    """Mean from a sum and a count, 0 when nothing was counted."""
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def uncached(input_tokens: Column, cached: Column) -> Column:
    return F.greatest(F.lit(0), input_tokens - cached)


def cost(fresh_input: Column, cached: Column, output: Column) -> Column:
    """Cost from token sums and the price columns; null where the model has no price.

    ``fresh_input`` is input not served from cache, ``output`` includes reasoning.
    """
    return (fresh_input * F.col("input_price") + cached * F.col("cache_price")
            + output * F.col("output_price"))


def trend(delta: Column) -> Column:
    """Direction of a change: -1, 0, 1, or null when there is nothing to compare."""
    return F.signum(delta).cast("int")


def call_ok() -> Column:
    """Success as the tool reports count it: unknown status is not a failure."""
    return F.col("status").isin("ok", "unknown") | F.coalesce(F.col("exit_code") == 0, F.lit(False))


def call_failed() -> Column:
    return (F.col("status") == "failed") | F.coalesce(F.col("exit_code") != 0, F.lit(False))


def count_if(test: Column) -> Column:
    return or_zero(F.sum(F.when(test, 1).otherwise(0))).cast("bigint")


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON of the given fields in key order, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]),
                     {"ignoreNullFields": "false"})


def short_hash(text: Column, n: int = 24) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def payload_hash(fields: dict[str, Column], n: int = 24) -> Column:
    return short_hash(canonical_json(fields), n)


def dedup_key(file: Column, line: Column, fields: dict[str, Column], n: int = 24) -> Column:
    """Identity of a record: where it stood and what it said."""
    return short_hash(F.concat_ws(":", file, line.cast("string"), payload_hash(fields, n)), n)
