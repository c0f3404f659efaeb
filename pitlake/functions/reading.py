"""Rules that say which sections of a report must be read, as columns over one wide row of figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlake.functions import rules

Values = dict[str, Column]


def growth(now: Column, before: Column) -> Column:
    """Change against a positive base; null without one."""
    return F.when(before > 0, now / before - 1)


def triggers(v: Values) -> list[tuple[str, str, Column]]:
    """(rule, reason, whether it holds) in the rules' order."""
    out: list[tuple[str, str, Column]] = []
    for m in ("revenue", "profit", "adjusted_profit"):
        now, before = v[m], v[f"{m}_before"]
        switch = F.lit(False) if m == "revenue" else F.coalesce(((before <= 0) & (now > 0)) | ((before >= 0) & (now < 0)), F.lit(False))
        change = growth(now, before)
        if m != "revenue":
            out.append(("R01", f"{m}:profit_loss_switch", switch))
        out += [("R01", f"{m}:growth", ~switch & (F.abs(change) >= 0.2)), ("R01", f"{m}:growth_change", ~switch & (F.abs(change - v[f"{m}_growth_before"]) >= 0.15))]
    for m, least in (("gross_margin", 0.03), ("sales_expense_ratio", 0.02), ("management_expense_ratio", 0.02), ("research_expense_ratio", 0.02)):
        out.append(("R02", f"{m}:change", F.abs(v[m] - v[f"{m}_before"]) >= least))
    ratio = F.when(v["profit"] > 0, v["cash_flow"] / v["profit"])
    out += [("R03", "cash_flow_negative", (v["profit"] > 0) & (v["cash_flow"] < 0)), ("R03", "cash_ratio_down", (ratio < 0.8) & (v["cash_ratio_before"] - ratio >= 0.2))]
    for m in ("receivables", "inventory"):
        days, before = v[f"{m}_days"], v[f"{m}_days_before"]
        out += [("R04", f"{m}:outgrow_revenue", v[f"{m}_growth"] - growth(v["revenue"], v["revenue_before"]) >= 0.2), ("R04", f"{m}:days", (before > 0) & (days - before >= 30) & (days / before - 1 >= 0.2))]
    equity = F.when(v["equity_before"] > 0, v["equity_before"])
    out += [
        ("R05", "contract_liability_down", growth(v["contract_liability"], v["contract_liability_before"]) <= -0.2), ("R05", "debt_ratio_up", F.when(v["assets"] > 0, v["debt"] / v["assets"]) - v["debt_ratio_before"] >= 0.05),
        ("R06", "goodwill_impairment", v["goodwill_impairment"] > 0), ("R06", "impairment_share", v["impairment"] / equity >= 0.01), ("R07", "people_changed", v["people_changed"]),
        ("R08", "major_capital_event", v["capital_event_major"]), ("R08", "capital_event_share", v["capital_event"] / equity >= 0.05), ("R09", "key_regulatory_event", v["risk_event_key"]), ("R09", "risk_event_share", v["risk_event"] / equity >= 0.01),
        ("R10", "dividend_down", growth(v["dividend"], v["dividend_before"]) <= -0.2), ("R10", "return_cancelled", v["return_cancelled"]), ("R10", "repurchase_share", F.when(v["shares"] > 0, v["repurchase"] / v["shares"]) >= 0.01),
    ]
    return out


def missing(v: Values) -> list[tuple[str, str, Column]]:
    """(rule, what is missing, whether it is)."""
    absent = lambda *names: F.greatest(*[v[n].isNull().cast("int") for n in names], F.lit(0)) == 1
    no_equity = F.coalesce(v["equity_before"] <= 0, F.lit(True))
    return [
        *[("R01", f"{m}:same_period", absent(m, f"{m}_before")) for m in ("revenue", "profit", "adjusted_profit")], *[("R02", f"{m}:same_period", absent(m, f"{m}_before")) for m in ("gross_margin", "sales_expense_ratio", "management_expense_ratio", "research_expense_ratio")],
        ("R03", "profit_and_cash_flow", absent("profit", "cash_flow")), *[("R04", f"{m}:comparison", absent(f"{m}_growth", f"{m}_days", f"{m}_days_before")) for m in ("receivables", "inventory")], ("R05", "debt_ratio", absent("debt", "assets", "debt_ratio_before")),
        ("R06", "impairment_and_equity", absent("impairment") | no_equity), ("R08", "capital_event_and_equity", absent("capital_event") | no_equity), ("R09", "risk_event_and_equity", absent("risk_event") | no_equity), ("R10", "two_dividends", absent("dividend", "dividend_before")),
    ]


def codes(checks: list[tuple[str, str, Column]]) -> Column:
    """rule/reason of each check that holds, in order, joined by commas."""
    return F.array_join(rules.reasons(*[(f"{r}/{c}", F.coalesce(x, F.lit(False))) for r, c, x in checks]), ",")
