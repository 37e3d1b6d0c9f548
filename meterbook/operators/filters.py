"""Query parameters and the predicates made from them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("project_id", "provider", "model", "source_id", "exactness")
SESSION_SEARCH = ("title", "source_session_id", "model", "provider")
EVENT_SEARCH = ("event_type", "model", "provider", "message_role", "event_hash")
RANGES = {"1d": 1, "7d": 7, "30d": 30, "90d": 90}


@dataclass(frozen=True)
class QueryFilter:
    """Optional equalities and an inclusive range of UTC days."""

    start_date: dt.date | None = None
    end_date: dt.date | None = None
    local_date: dt.date | None = None
    project_id: int | None = None
    provider: str | None = None
    model: str | None = None
    source_id: int | None = None
    exactness: str | None = None
    limit: int | None = None
    offset: int | None = None

    def without_dates(self) -> QueryFilter:
        return replace(self, start_date=None, end_date=None)

    def previous(self, strict_compat: bool = False) -> QueryFilter:
        """The range of equal length that ends the day before; strict_compat shortens it by a day."""
        if self.start_date is None or self.end_date is None:
            raise ValueError("a previous period needs both dates")
        days = (self.end_date - self.start_date).days + (0 if strict_compat else 1)
        end = self.start_date - dt.timedelta(days=1)
        return replace(self, start_date=self.start_date - dt.timedelta(days=days), end_date=end)


def range_dates(name: str, today: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a named range; all days for "all"."""
    if name == "all":
        return None, None
    if name not in RANGES:
        raise ValueError(f"unknown range {name!r}")
    return today - dt.timedelta(days=RANGES[name] - 1), today


def _day(d: dt.date) -> Column:
    return F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz")


def predicates(f: QueryFilter, columns: list[str], dates: bool = True, day: str | None = None) -> list[Column]:
    """Conjuncts of f. Timestamps are compared with half-open bounds, so that the scan can skip row groups; day names a date column instead."""
    found = [~F.coalesce(F.col("ignored"), F.lit(False))] if "ignored" in columns else []
    found += [F.col(c) == F.lit(getattr(f, c)) for c in DIMENSIONS if getattr(f, c) is not None]
    if dates and f.start_date:
        found.append(F.col(day) >= F.lit(f.start_date) if day else F.col("timestamp") >= _day(f.start_date))
    if dates and f.end_date:
        found.append(F.col(day) <= F.lit(f.end_date) if day else F.col("timestamp") < _day(f.end_date + dt.timedelta(days=1)))
    return found


def apply_filter(events: DataFrame, f: QueryFilter, dates: bool = True, day: str | None = None) -> DataFrame:
    """Rows that aren't ignored and meet the filter."""
    conjuncts = predicates(f, events.columns, dates, day)
    return events.where(reduce(lambda a, b: a & b, conjuncts)) if conjuncts else events


def search(df: DataFrame, text: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows in which one of the columns holds the text, in any case."""
    if not text.strip():
        return df
    needle = text.strip().lower()
    return df.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle) for c in columns if c in df.columns]))


def page(df: DataFrame, f: QueryFilter, default: int | None = 500) -> DataFrame:
    """The filter's offset and limit; without a limit, the default one, if any."""
    if f.offset:
        df = df.offset(f.offset)
    limit = f.limit if f.limit is not None else default
    return df if limit is None else df.limit(limit)
