"""Quarters, trailing twelve months and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.functions.periods import quarter_index, year_before


def single_quarters(ytd: DataFrame, keys: list[str], end: str = "period_end", value: str = "value") -> DataFrame:
    """Quarter values from year-to-date ones: the first as it is, others less the one before, which must be there."""
    w = Window.partitionBy(*keys, F.year(end)).orderBy(end)
    q, before = F.quarter(end), F.lag(F.quarter(end)).over(w)
    made = F.when(q == 1, F.col(value)).when(before == q - 1, F.col(value) - F.lag(value).over(w))
    return ytd.withColumn(value, made).where(F.col(value).isNotNull())


def trailing_year(quarters: DataFrame, keys: list[str], end: str = "period_end", value: str = "value") -> DataFrame:
    """ttm: the sum of exactly four consecutive quarters, else null."""
    w = Window.partitionBy(*keys).orderBy(end).rowsBetween(-3, 0)
    i = quarter_index(F.col(end))
    whole = (F.count(value).over(w) == 4) & (F.max(i).over(w) - F.min(i).over(w) == 3)
    return quarters.withColumn("ttm", F.when(whole, F.sum(value).over(w)))


def year_on_year(df: DataFrame, keys: list[str], end: str = "period_end", value: str = "value") -> DataFrame:
    """yoy: growth over the same period a year earlier; null if that is absent or zero."""
    prior = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(end).alias("_end"), F.col(value).alias("_prior"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [year_before(F.col(end)) == F.col("_end")]
    joined = df.join(prior, on, "left").select(*df.columns, "_prior")
    return joined.withColumn("yoy", F.try_divide(F.col(value) - F.col("_prior"), F.abs("_prior"))).drop("_prior")


def keep_last(df: DataFrame, keys: list[str], n: int = 12, end: str = "period_end") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(end))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def ttm_from_annual(ytd: DataFrame, keys: list[str], end: str = "period_end", value: str = "value") -> DataFrame:
    """ttm: this year to date, plus the whole last year, less the last year to the same date."""
    old = ytd.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(end).alias("_end"), F.col(value).alias("_value"))
    a, b = old.alias("a"), old.alias("b")
    same = lambda s: [F.col(k) == F.col(f"{s}._{k}") for k in keys]
    joined = ytd.join(a, [*same("a"), F.col("a._end") == F.make_date(F.year(end) - 1, F.lit(12), F.lit(31))], "left").join(b, [*same("b"), F.col("b._end") == year_before(F.col(end))], "left")
    ttm = F.when(F.quarter(end) == 4, F.col(value)).otherwise(F.col(value) + F.col("a._value") - F.col("b._value"))
    return joined.select(*ytd.columns, ttm.alias("ttm"))
