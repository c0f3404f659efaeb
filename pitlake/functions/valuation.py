"""Metric blocks, valuation models and scenarios as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlake.functions import finance

Values = dict[str, Column]

#: block, metric, the inputs that must be there, and its value. An absent input gives no metric; a zero denominator
#: gives a metric that is null.
METRICS: list[tuple[str, str, tuple[str, ...], Callable[[Values], Column]]] = [
    ("income", "gross_margin", ("revenue", "cost_of_revenue"), lambda v: finance.gross_margin(v["revenue"], v["cost_of_revenue"])),
    *[("income", m, ("revenue", i), lambda v, i=i: F.try_divide(v[i], v["revenue"])) for i, m in (
        ("net_income", "net_margin"), ("net_income_parent", "parent_net_margin"), ("net_income_excl", "adjusted_net_margin"), ("selling_expense", "selling_expense_ratio"),
        ("administrative_expense", "administrative_expense_ratio"), ("rd_expense", "rd_ratio"), ("finance_expense", "finance_expense_ratio"))],
    ("balance", "current_ratio", ("current_assets", "current_liabilities"), lambda v: F.try_divide(v["current_assets"], v["current_liabilities"])),
    ("balance", "net_debt", ("cash", "interest_bearing_debt"), lambda v: v["interest_bearing_debt"] - v["cash"]),
    ("balance", "interest_bearing_debt_ratio", ("interest_bearing_debt", "total_assets"), lambda v: F.try_divide(v["interest_bearing_debt"], v["total_assets"])),
    ("balance", "goodwill_to_equity", ("goodwill", "total_equity"), lambda v: F.try_divide(v["goodwill"], v["total_equity"])),
    ("balance", "receivable_to_revenue", ("accounts_receivable", "revenue"), lambda v: F.try_divide(v["accounts_receivable"], v["revenue"])),
    ("balance", "inventory_to_cost", ("inventory", "cost_of_revenue"), lambda v: F.try_divide(v["inventory"], v["cost_of_revenue"])),
    ("cash", "free_cash_flow", ("operating_cash_flow", "capital_expenditure"), lambda v: finance.free_cash_flow(v["operating_cash_flow"], v["capital_expenditure"])),
    ("cash", "cash_profit_ratio", ("operating_cash_flow", "net_income"), lambda v: F.try_divide(v["operating_cash_flow"], v["net_income"])),
    ("cash", "operating_cash_flow_margin", ("operating_cash_flow", "revenue"), lambda v: F.try_divide(v["operating_cash_flow"], v["revenue"])),
    ("cash", "capex_to_revenue", ("operating_cash_flow", "revenue", "capital_expenditure"), lambda v: F.try_divide(F.abs(v["capital_expenditure"]), v["revenue"])),
    ("working_capital", "net_working_capital", ("current_assets", "current_liabilities"), lambda v: v["current_assets"] - v["current_liabilities"]),
    ("working_capital", "operating_working_capital", ("accounts_receivable", "inventory", "accounts_payable"), lambda v: v["accounts_receivable"] + v["inventory"] - v["accounts_payable"]),
    ("earnings_quality", "accrual_ratio", ("net_income", "operating_cash_flow", "average_assets"), lambda v: F.try_divide(v["net_income"] - v["operating_cash_flow"], v["average_assets"])),
    ("earnings_quality", "adjusted_profit_share", ("net_income_excl", "net_income_parent"), lambda v: F.try_divide(v["net_income_excl"], v["net_income_parent"])),
    ("earnings_quality", "impairment_to_revenue", ("asset_impairment_loss", "revenue"), lambda v: F.try_divide(v["asset_impairment_loss"], v["revenue"])),
    *[("dupont", f"dupont_{p}", ("net_income", "revenue", "average_assets", "average_equity"), lambda v, p=p: finance.dupont(v["net_income"], v["revenue"], v["average_assets"], v["average_equity"])[p])
      for p in ("net_margin", "asset_turnover", "equity_multiplier", "roe")],
    ("return", "roic", ("ebit", "tax_rate", "invested_capital"), lambda v: finance.roic(v["ebit"], v["tax_rate"], v["invested_capital"])),
]


def metric_rows(values: Values) -> Column:
    """array<struct<block, metric, value>> of the metrics whose inputs are all there."""

    def one(block: str, name: str, needs: tuple[str, ...], make: Callable[[Values], Column]) -> Column:
        there = F.lit(True)
        for n in needs:
            there &= values[n].isNotNull() if n in values else F.lit(False)
        return F.when(there, F.struct(F.lit(block).alias("block"), F.lit(name).alias("metric"), make(values).alias("value")))

    return F.array_compact(F.array(*[one(*m) for m in METRICS if all(n in values for n in m[2])]))


def cash_rolls_forward(opening: Column, flows: list[Column], closing: Column) -> Column:
    """Whether opening cash and all flows give closing cash, within 0.1 % of it or 1; the difference beside it."""
    off = sum(flows, opening) - closing
    return F.struct((F.abs(off) <= F.greatest(F.abs(closing) * 0.001, F.lit(1.0))).alias("passed"), off.alias("difference"))


def _total(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + value(x))


def models(v: Values) -> dict[str, tuple[tuple[str, ...], Column, Column, Column]]:
    """method: the inputs that must be positive, value, low and high of each valuation model."""
    none = F.lit(None).cast("double")
    dcf = lambda base, rate: finance.discounted_value(finance.projected(v[base], v["growth_rates"]), v[rate], v["terminal_growth"])
    low, high = F.coalesce(v["low_multiple"], v["target_multiple"]), F.coalesce(v["high_multiple"], v["target_multiple"])
    debt, shares = F.coalesce(v["net_debt"], F.lit(0.0)), v["shares_outstanding"]
    cycle = lambda x: F.coalesce(v[f"{x}_eps"], v["normalized_eps"]) * F.coalesce(v[f"{x}_pe"], v["target_pe"])
    some = lambda items, x: F.when(F.size(items) > 0, x)
    return {
        "relative": (("metric_per_share", "target_multiple"), F.when((low > 0) & (high > 0), v["metric_per_share"] * v["target_multiple"]), v["metric_per_share"] * low, v["metric_per_share"] * high),
        "fcff_dcf": (("base_fcff", "wacc", "shares_outstanding"), F.try_divide(dcf("base_fcff", "wacc") - debt, shares), none, none),
        "fcfe_dcf": (("base_fcfe", "cost_of_equity", "shares_outstanding"), F.try_divide(dcf("base_fcfe", "cost_of_equity"), shares), none, none),
        "ddm": (("dividend_per_share", "cost_of_equity"), dcf("dividend_per_share", "cost_of_equity"), none, none),
        "sotp": (("shares_outstanding",), some(v["segments"], F.try_divide(_total(v["segments"], lambda x: x["value"]) - debt, shares)), none, none),
        "nav": (("shares_outstanding",), some(v["assets"], F.try_divide(_total(v["assets"], lambda x: x["value"] * F.coalesce(x["adjustment"], F.lit(1.0))) - F.coalesce(v["liabilities"], F.lit(0.0)), shares)), none, none),
        "cycle_normalized": (("normalized_eps", "target_pe"), v["normalized_eps"] * v["target_pe"], cycle("low"), cycle("high")),
        "embedded_value": (("embedded_value_per_share", "target_pev"), v["embedded_value_per_share"] * v["target_pev"], none, none),
    }


def _judged(r: Column) -> Column:
    v = r["value"]
    failure = F.when(r["bad"], "input_not_positive").when(v.isNull(), "no_value").when(v <= 0, "value_not_positive")
    return F.struct(F.when(failure.isNull(), "success").otherwise("failed").alias("status"), *[F.when(failure.isNull(), F.round(r[x], 4)).alias(x) for x in ("value", "low", "high")], failure.alias("failure"))


def execute(method: Column, version: Column, values: Values, known: str = "1.0.0") -> Column:
    """struct<status, value, low, high, failure> of the model that method and version name, rounded to 4 digits:
    not_applicable without such a model, failed where an input that must be positive isn't, the model gives nothing or
    a value that isn't positive."""
    out = F.struct(F.lit("not_applicable").alias("status"), *[F.lit(None).cast("double").alias(x) for x in ("value", "low", "high")], F.lit("no_model").alias("failure"))
    for name, (positive, value, low, high) in models(values).items():
        bad = F.lit(False)
        for p in positive:
            bad |= ~F.coalesce(values[p] > 0, F.lit(False))
        raw = F.struct(value.alias("value"), F.coalesce(low, value).alias("low"), F.coalesce(high, value).alias("high"), bad.alias("bad"))
        run = F.element_at(F.transform(F.array(raw), _judged), 1)  # the value is computed once
        out = F.when((method == name) & (version == known), run).otherwise(out)
    return out


SCENARIO_INPUTS = (
    "base_revenue", "volume_growth", "price_growth", "gross_margin", "expense_ratio", "tax_rate", "depreciation_ratio", "capex_ratio", "working_capital_ratio",
    "minority_interest_ratio", "non_recurring_after_tax", "net_debt", "shares_outstanding", "wacc", "terminal_growth", "years",
)
SHARES = ("gross_margin", "expense_ratio", "tax_rate", "depreciation_ratio", "capex_ratio", "working_capital_ratio", "minority_interest_ratio")


def scenario(v: Values) -> Column:
    """struct<failure, revenue_growth, last_eps, fair_value> of one scenario's inputs: revenue grows by volume and
    price, free cash flow is what margins, tax, investment and working capital leave of it, and its discounted value
    less net debt is shared by all shares."""
    n, growth = v["years"].cast("int"), (1 + v["volume_growth"]) * (1 + v["price_growth"]) - 1
    after_tax = (v["gross_margin"] - v["expense_ratio"]) * (1 - v["tax_rate"])

    def step(a: Column, _: Column) -> Column:
        revenue = a["revenue"] * (1 + growth)
        flow = revenue * (after_tax + v["depreciation_ratio"] - v["capex_ratio"]) - (revenue - a["revenue"]) * v["working_capital_ratio"]
        by = a["by"] * (1 + v["wacc"])
        return F.struct(revenue.alias("revenue"), flow.alias("flow"), by.alias("by"), (a["pv"] + flow / by).alias("pv"))

    start = F.struct(v["base_revenue"].alias("revenue"), F.lit(0.0).alias("flow"), F.lit(1.0).alias("by"), F.lit(0.0).alias("pv"))
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(20)), F.lit(1))), start, step)
    fair = (end["pv"] + end["flow"] * (1 + v["terminal_growth"]) / (v["wacc"] - v["terminal_growth"]) / end["by"] - v["net_debt"]) / v["shares_outstanding"]
    eps = (end["revenue"] * after_tax * (1 - v["minority_interest_ratio"]) - v["non_recurring_after_tax"]) / v["shares_outstanding"]
    outside = F.lit(False)
    for s in SHARES:
        outside |= ~v[s].between(0, 1)
    failure = (
        F.when(~n.between(1, 20), "years").when(outside, "share_outside_0_1").when(v["wacc"] <= v["terminal_growth"], "wacc_below_growth")
        .when((v["shares_outstanding"] <= 0) | (v["base_revenue"] <= 0), "revenue_or_shares").when(end["flow"] <= 0, "last_flow_not_positive").when(fair <= 0, "value_not_positive")
    )
    good = lambda x, d: F.when(failure.isNull(), F.round(x, d))
    return F.struct(failure.alias("failure"), good(growth, 6).alias("revenue_growth"), good(eps, 4).alias("last_eps"), good(fair, 4).alias("fair_value"))
