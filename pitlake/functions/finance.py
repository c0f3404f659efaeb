"""Financial formulas as columns. A null or zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CNY in one unit of each name.
CNY_UNITS = {"元": 1, "千元": 1_000, "万元": 10_000, "百万元": 1_000_000, "亿元": 100_000_000}


def ratio(a, b) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def to_cny(value: Column, unit: Column) -> Column:
    """Value in yuan; null for an unknown unit, which is never guessed."""
    scale = F.create_map(*[F.lit(x) for kv in CNY_UNITS.items() for x in kv])
    return value * F.try_element_at(scale, unit)


def cagr(begin: Column, end: Column, years: Column) -> Column:
    return F.when((begin > 0) & (end >= 0) & (years > 0), F.pow(end / begin, F.lit(1.0) / years) - 1)


def gross_margin(revenue: Column, cost: Column) -> Column:
    return F.try_divide(revenue - cost, revenue)


def free_cash_flow(operating: Column, capex: Column) -> Column:
    return operating - F.abs(capex)


def dupont(profit: Column, revenue: Column, assets: Column, equity: Column) -> Column:
    margin, turnover, leverage = F.try_divide(profit, revenue), F.try_divide(revenue, assets), F.try_divide(assets, equity)
    return F.struct(margin.alias("net_margin"), turnover.alias("asset_turnover"), leverage.alias("equity_multiplier"), (margin * turnover * leverage).alias("roe"))


def derived(operation: Column, a: Column, b: Column, alike: Column) -> Column:
    """struct<failure, value> of `ratio`, `one_minus_ratio` or `difference` of two operands that are defined alike."""
    q = F.try_divide(a, b)
    value = F.when(operation == "ratio", q).when(operation == "one_minus_ratio", 1 - q).otherwise(a - b)
    failure = F.when(a.isNull() | b.isNull(), "missing_operand").when(~alike, "definition_mismatch").when(value.isNull(), "zero_denominator")
    return F.struct(failure.alias("failure"), F.when(failure.isNull(), value).alias("value"))


def roic(operating_profit: Column, tax: Column, capital: Column) -> Column:
    return F.when(tax.between(0, 1), F.try_divide(operating_profit * (1 - tax), capital))


def wacc(equity: Column, debt: Column, cost_equity: Column, cost_debt: Column, tax: Column) -> Column:
    total = equity + debt
    return F.when((total > 0) & tax.between(0, 1), equity / total * cost_equity + debt / total * cost_debt * (1 - tax))


def balances(assets: Column, liabilities: Column, equity: Column) -> Column:
    """Whether assets equal liabilities and equity, within 0.1 % of assets or 1."""
    return F.abs(assets - liabilities - equity) <= F.greatest(F.abs(assets) * 0.001, F.lit(1.0))


def projected(base: Column, growth: Column) -> Column:
    """Cash flows that follow base along an array of growth rates."""
    start = F.struct(base.cast("double").alias("last"), F.array().cast("array<double>").alias("flows"))
    step = lambda acc, g: F.struct((acc["last"] * (1 + g)).alias("last"), F.concat(acc["flows"], F.array(acc["last"] * (1 + g))).alias("flows"))
    return F.aggregate(growth, start, step)["flows"]


def present_value(flows: Column, rate: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("by"))
    return F.aggregate(flows, start, lambda a, c: F.struct((a["sum"] + c / (a["by"] * (1 + rate))).alias("sum"), (a["by"] * (1 + rate)).alias("by")))["sum"]


def discounted_value(flows: Column, rate: Column, growth: Column) -> Column:
    """Present value with a Gordon terminal value; null unless rate > growth, rate > 0 and the last flow > 0."""
    last = F.element_at(flows, -1)
    terminal = last * (1 + growth) / (rate - growth) / F.pow(1 + rate, F.size(flows))
    return F.when((rate > growth) & (rate > 0) & (last > 0), present_value(flows, rate) + terminal)


def residual_income(book: Column, roe: Column, payout: Column, cost: Column, years: int) -> Column:
    start = F.struct(book.cast("double").alias("book"), F.lit(0.0).alias("sum"), F.lit(1.0).alias("by"))

    def step(a: Column, _: Column) -> Column:
        by = a["by"] * (1 + cost)
        return F.struct((a["book"] * (1 + roe * (1 - payout))).alias("book"), (a["sum"] + a["book"] * (roe - cost) / by).alias("sum"), by.alias("by"))

    return book + F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, step)["sum"]


def implied_growth(price: Column, base: Column, rate: Column, terminal: Column, years: int = 5, low: float = -0.5, high: float = 1.0, steps: int = 50) -> Column:
    """The constant growth at which the discounted value equals price, by bisection on [low, high]; 50 halvings reach
    double precision."""

    def value(g: Column) -> Column:
        q = (1 + g) / (1 + rate)
        ahead = F.when(F.abs(q - 1) < 1e-12, base * years).otherwise(base * q * (1 - F.pow(q, F.lit(years))) / (1 - q))
        return ahead + base * F.pow(1 + g, F.lit(years)) * (1 + terminal) / (rate - terminal) / F.pow(1 + rate, F.lit(years))

    def step(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        up = value(mid) < price
        return F.struct(F.when(up, mid).otherwise(a["lo"]).alias("lo"), F.when(up, a["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")), step)
    return F.when((rate > terminal) & (base > 0) & price.between(value(F.lit(low)), value(F.lit(high))), (found["lo"] + found["hi"]) / 2)
