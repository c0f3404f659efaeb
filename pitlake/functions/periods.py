"""Quarter and instant arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_index(d: Column) -> Column:
    return F.year(d) * 4 + F.quarter(d) - 1


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def is_quarter_end(d: Column) -> Column:
    return (d == F.last_day(d)) & (F.month(d) % 3 == 0)


def year_before(d: Column, years: int = 1) -> Column:
    """The same date `years` earlier; 29 February gives the 28th."""
    return F.add_months(d, -12 * years)


def exclusive_bound(d: Column, zone: str = "Asia/Shanghai") -> Column:
    """The instant at which local date d is over."""
    return F.to_utc_timestamp(F.date_add(d, 1), zone)


def available_at(published: Column, is_date: Column, retrieved: Column, proven: Column, zone: str = "Asia/Shanghai") -> Column:
    """The earliest instant from which a document may be used: a proven publication instant; the end of a proven
    publication date; else when it was retrieved."""
    return F.when(proven & published.isNotNull() & is_date, exclusive_bound(F.to_date(published), zone)).when(proven & published.isNotNull(), published).otherwise(retrieved)
