"""How numbers are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACTNESS_LABELS = {"exact": "Exact", "estimated": "Estimated", "mixed": "Mixed", "unknown": "Unknown"}


def day_label(date: Column) -> Column:
    """Month and day of a date or of the text of a time."""
    return F.substring(date.cast("string"), 6, 5)


def delta_label(now: Column, before: Column) -> Column:
    """The change in percent: null if both are 0, "new" from 0, else signed with one decimal."""
    change = (now - before) / before * 100
    shown = F.concat(F.when(change >= 0, "+").otherwise(""), F.format_string("%.1f%%", change))
    return F.when((before == 0) & (now == 0), F.lit(None)).when(before == 0, "new").when(now == 0, "-100%").otherwise(shown)


def number_label(n: Column) -> Column:
    x = n.cast("double")
    return F.when(F.abs(x) >= 1e6, F.format_string("%.2fM", x / 1e6)).when(F.abs(x) >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(F.format_string("%.0f", x))


def usd_label(amount: Column) -> Column:
    return F.when((amount > 0) & (amount < 0.01), "<$0.01").otherwise(F.format_string("$%.2f", amount))


def percent_label(share: Column) -> Column:
    return F.format_string("%.1f%%", share)


def exactness_label(exactness: Column) -> Column:
    found = F.lit(EXACTNESS_LABELS["unknown"])
    for value, label in EXACTNESS_LABELS.items():
        found = F.when(exactness == value, label).otherwise(found)
    return found
