"""Arithmetic behind the flow features; every division is guarded."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_seconds(first_seen: Column, last_seen: Column) -> Column:
    """Seconds with microsecond resolution; negative if time ran backwards."""
    return (F.unix_micros(last_seen) - F.unix_micros(first_seen)) / F.lit(1e6)


def average_packet_size(total_bytes: Column, packets: Column) -> Column:
    return F.when(packets > 0, total_bytes / packets).otherwise(F.lit(0.0))


def per_second(amount: Column, duration: Column) -> Column:
    """``amount / duration``; 0.0 for an instantaneous flow."""
    return F.when(duration > 0, amount / duration).otherwise(F.lit(0.0))
