"""Identifiers, formats and safe values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cluster_id(key: Column, members: Column) -> Column:
    """'NRX-' and 20 hex digits of sha256 over key|station:id|...; members is an array of 'station:id' in receiver order."""
    return F.concat(F.lit("NRX-"), F.substring(F.sha2(F.concat(key, F.lit("|"), F.array_join(members, "|")), 256), 1, 20))


def iso_utc(utc_ns: Column) -> Column:
    """2024-01-02T03:04:05.123456Z from epoch nanoseconds, cut to microseconds."""
    return F.date_format(F.timestamp_micros(F.floor(utc_ns / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def tick_to_ns(tick: Column, anchor_tick: Column, anchor_ns: Column, ticks_per_us: int = 12) -> Column:
    """Epoch nanoseconds of a tick by an anchor, in whole-number arithmetic."""
    return anchor_ns + F.floor((tick - anchor_tick) * 1000 / ticks_per_us).cast("long")


def number_vi(value: Column, digits: int = 1) -> Column:
    """Decimal comma; a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.replace(F.format_string(f"%.{digits}f", value.cast("double")), F.lit("."), F.lit(",")))


def pairs_to_map(text: Column) -> Column:
    """'a__b:1.5;...' as a map of doubles."""
    return F.transform_values(F.str_to_map(text, F.lit(";"), F.lit(":")), lambda _, v: v.cast("double"))


def map_to_pairs(values: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")
