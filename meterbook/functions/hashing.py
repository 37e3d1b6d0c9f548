"""The hash that identifies a usage event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_text(ts: Column) -> Column:
    """A UTC timestamp with as few fraction digits (0, 3 or 6) as it needs."""
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(ts, ".SSS")).otherwise(F.date_format(ts, ".SSSSSS"))
    return F.concat(whole, part, F.lit("+00:00"))


def little_endian(n: Column) -> Column:
    """The eight bytes of a long, lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), ""))


def plain_type(event_type: Column) -> Column:
    return F.when(event_type == "step-finish", "step.finish").otherwise(event_type)


def event_hash(timestamp: Column, provider: Column, model: Column, session: Column, event_type: Column, total: Column, input_: Column, output: Column) -> Column:
    """SHA-256 of the identifying fields; null texts count as empty."""
    bar = F.lit("|").cast("binary")
    text = lambda c: F.coalesce(c, F.lit("")).cast("binary")
    parts = [text(utc_text(timestamp)), text(provider), text(model), text(session), text(plain_type(event_type)), *[little_endian(F.coalesce(n, F.lit(0))) for n in (total, input_, output)]]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, bar, p)
    return F.sha2(joined, 256)
