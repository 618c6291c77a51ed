"""Time and rating functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_timestamp(iso: Column) -> Column:
    """ISO-8601 text as a timestamp; a time without an offset is UTC, and what is no time becomes null."""
    text = F.trim(iso)
    clock = text.rlike(r"[T ]\d")
    zoned = F.when(clock & text.rlike(r"(?i)(z|[+-]\d{2}(:?\d{2})?)$"), text).otherwise(F.concat(text, F.when(clock, F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.try_to_timestamp(zoned)


def clock(seconds: Column) -> Column:
    """Seconds as 'HH:MM:SS'."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def padded_clock(hms: Column) -> Column:
    """'H:MM:SS' with two-digit hours; other strings stay."""
    p = F.split(hms, ":")
    return F.when(hms.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), F.format_string("%02d:%s:%s", p[0].cast("int"), p[1], p[2])).otherwise(hms)


def spoken_duration(seconds: Column) -> Column:
    """'h:mm:ss' of a length; negative lengths count as 0."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def feedback_factor(score: Column) -> Column:
    """0.6 for one star to 1.4 for five, 1 without a score."""
    return F.coalesce(F.lit(0.6) + (score - 1) * F.lit(0.2), F.lit(1.0))


def recency_factor(created_at: Column, as_of: Column, scale_days: float = 180.0) -> Column:
    """From 1 for new to 0.5 for old, with the given e-folding time; 1 where the time can't be read."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(utc_timestamp(created_at))) / F.lit(86_400_000_000.0))
    return F.coalesce(F.lit(0.5) + F.lit(0.5) * F.exp(-age / F.lit(scale_days)), F.lit(1.0))
