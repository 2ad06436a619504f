"""Timestamps, intervals and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column, const

unix_timestamp, from_unixtime, to_timestamp, now = F.unix_timestamp, F.from_unixtime, F.to_timestamp, F.now
timestamp_seconds, timestamp_millis, timestamp_micros = F.timestamp_seconds, F.timestamp_millis, F.timestamp_micros
make_timestamp, make_dt_interval, make_ym_interval = F.make_timestamp, F.make_dt_interval, F.make_ym_interval
hour, minute, second = F.hour, F.minute, F.second
timestamp_add, timestamp_diff = F.timestamp_add, F.timestamp_diff
from_utc_timestamp, to_utc_timestamp = F.from_utc_timestamp, F.to_utc_timestamp


def convert_timezone(c, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), column(c))


def time_bucket(bucket_micros: int, c, origin=None) -> Column:
    """The start of the bucket, of a positive number of microseconds counted from ``origin``, that a timestamp lies in."""
    if bucket_micros <= 0:
        raise ValueError("a time bucket is longer than nothing")
    ts = F.unix_micros(column(c).cast("timestamp"))
    at = F.lit(0) if origin is None else F.unix_micros(const(origin).cast("timestamp"))
    return F.timestamp_micros(at + F.floor((ts - at) / F.lit(bucket_micros)) * bucket_micros)


# A time of day is a TIME where spark.sql.timeType.enabled is set. Its conversions are made of the TIME functions of this version.
MIDNIGHT = "TIME'00:00:00'"


def time_to_micros(c) -> Column:
    return F.call_function("time_diff", F.lit("MICROSECOND"), F.expr(MIDNIGHT), column(c))


def time_to_millis(c) -> Column:
    return F.call_function("div", time_to_micros(c), F.lit(1000))


def time_to_seconds(c) -> Column:
    return (time_to_micros(c).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(14,6)")


def time_from_micros(c) -> Column:
    m = column(c).cast("bigint")
    hours = F.call_function("div", m, F.lit(3_600_000_000)).cast("int")
    minutes = (F.call_function("div", m, F.lit(60_000_000)) % 60).cast("int")
    seconds = ((m % 60_000_000).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(16,6)")
    return F.call_function("make_time", hours, minutes, seconds)


def time_from_millis(c) -> Column:
    return time_from_micros(column(c).cast("bigint") * 1000)


def time_from_seconds(c) -> Column:
    return time_from_micros(F.round(column(c).cast("double") * 1_000_000))
