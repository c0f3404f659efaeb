"""Registered queries of metric blocks, valuation models, scenarios and conclusions, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions import finance, valuation
from pitlake.operators import periods
from pitlake.plans.queries import YTD, flows, query, to_date_flows
from pitlake.sources.tables import read

#: Synthetic statements of each customer: name, and its value in SQL that Spark and DuckDB read alike.
STATEMENT = {
    "revenue": "CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal * 10 END", "cost_of_revenue": "CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal * 6 END", "net_income": "CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal - 500 END",
    "net_income_parent": "c_acctbal - 700", "net_income_excl": "CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal - 900 END", "selling_expense": "c_acctbal * 0.5e0", "administrative_expense": "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal * 0.3e0 END",
    "rd_expense": "c_nationkey * 20e0", "finance_expense": "CASE WHEN c_custkey % 2 = 0 THEN c_nationkey * 3e0 END", "current_assets": "c_nationkey * 1000e0", "current_liabilities": "c_nationkey * 600e0", "cash": "c_nationkey * 150e0",
    "interest_bearing_debt": "CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey * 400e0 END", "total_assets": "c_nationkey * 2500.531e0", "goodwill": "c_nationkey * 7e0", "total_equity": "c_nationkey * 1200.177e0 - 6000e0",
    "accounts_receivable": "c_nationkey * 90e0", "inventory": "CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey * 80e0 END", "accounts_payable": "c_nationkey * 70e0", "operating_cash_flow": "CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal - 200 END",
    "capital_expenditure": "-1 * c_nationkey * 33e0", "average_assets": "c_nationkey * 2400.713e0", "average_equity": "c_nationkey * 1100.377e0", "asset_impairment_loss": "CASE WHEN c_custkey % 10 = 0 THEN 12e0 END", "ebit": "c_acctbal * 1.5e0",
    "tax_rate": "CASE WHEN c_custkey % 13 = 0 THEN 1.5e0 ELSE 0.25e0 END", "invested_capital": "c_nationkey * 1300.291e0",
}
WIDE = "s AS (SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in STATEMENT.items()) + " FROM customer)"


def _over(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN ({a}) / ({b}) END"


METRIC_SQL = [
    ("income", "gross_margin", "revenue cost_of_revenue", _over("revenue - cost_of_revenue", "revenue")), *[("income", m, f"revenue {i}", _over(i, "revenue")) for i, m in (("net_income", "net_margin"), ("net_income_parent", "parent_net_margin"), ("net_income_excl", "adjusted_net_margin"), ("selling_expense", "selling_expense_ratio"), ("administrative_expense", "administrative_expense_ratio"), ("rd_expense", "rd_ratio"), ("finance_expense", "finance_expense_ratio"))],
    ("balance", "current_ratio", "current_assets current_liabilities", _over("current_assets", "current_liabilities")), ("balance", "net_debt", "cash interest_bearing_debt", "interest_bearing_debt - cash"), ("balance", "interest_bearing_debt_ratio", "interest_bearing_debt total_assets", _over("interest_bearing_debt", "total_assets")),
    ("balance", "goodwill_to_equity", "goodwill total_equity", _over("goodwill", "total_equity")), ("balance", "receivable_to_revenue", "accounts_receivable revenue", _over("accounts_receivable", "revenue")), ("balance", "inventory_to_cost", "inventory cost_of_revenue", _over("inventory", "cost_of_revenue")),
    ("cash", "free_cash_flow", "operating_cash_flow capital_expenditure", "operating_cash_flow - abs(capital_expenditure)"), ("cash", "cash_profit_ratio", "operating_cash_flow net_income", _over("operating_cash_flow", "net_income")), ("cash", "operating_cash_flow_margin", "operating_cash_flow revenue", _over("operating_cash_flow", "revenue")),
    ("cash", "capex_to_revenue", "operating_cash_flow revenue capital_expenditure", _over("abs(capital_expenditure)", "revenue")), ("working_capital", "net_working_capital", "current_assets current_liabilities", "current_assets - current_liabilities"),
    ("working_capital", "operating_working_capital", "accounts_receivable inventory accounts_payable", "accounts_receivable + inventory - accounts_payable"), ("earnings_quality", "accrual_ratio", "net_income operating_cash_flow average_assets", _over("net_income - operating_cash_flow", "average_assets")),
    ("earnings_quality", "adjusted_profit_share", "net_income_excl net_income_parent", _over("net_income_excl", "net_income_parent")), ("earnings_quality", "impairment_to_revenue", "asset_impairment_loss revenue", _over("asset_impairment_loss", "revenue")),
    ("dupont", "dupont_net_margin", "net_income revenue average_assets average_equity", _over("net_income", "revenue")), ("dupont", "dupont_asset_turnover", "net_income revenue average_assets average_equity", _over("revenue", "average_assets")), ("dupont", "dupont_equity_multiplier", "net_income revenue average_assets average_equity", _over("average_assets", "average_equity")),
    ("dupont", "dupont_roe", "net_income revenue average_assets average_equity", "CASE WHEN revenue <> 0 AND average_assets <> 0 AND average_equity <> 0 THEN net_income / average_equity END"), ("return", "roic", "ebit tax_rate invested_capital", "CASE WHEN tax_rate BETWEEN 0 AND 1 AND invested_capital <> 0 THEN ebit * (1 - tax_rate) / invested_capital END"),
]


@query(f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT c_custkey, '{b}' AS block, '{m}' AS metric, round({e}, 8) AS value FROM s WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in needs.split()) for b, m, needs, e in METRIC_SQL))
def metric_blocks(spark, sf_dir):
    """Income, balance, cash, working-capital and earnings-quality blocks, DuPont and ROIC."""
    s = read(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{e} AS {n}" for n, e in STATEMENT.items()])
    rows = s.select("c_custkey", F.explode(valuation.metric_rows({n: F.col(n) for n in STATEMENT})).alias("m"))
    return rows.select("c_custkey", "m.block", "m.metric", F.round("m.value", 8).alias("value"))


@query("""WITH c AS (SELECT o_orderkey, o_totalprice AS opening, o_totalprice * 0.4e0 AS a, -o_totalprice * 0.1e0 AS b, -o_totalprice * 0.2e0 AS f, 5e0 AS x, o_totalprice * 1.1e0 + CASE WHEN o_orderkey % 3 = 0 THEN 500e0 ELSE 4.5e0 END AS closing FROM orders)
SELECT o_orderkey, abs(opening + a + b + f + x - closing) <= greatest(abs(closing) * 0.001e0, 1) AS passed, round(opening + a + b + f + x - closing, 4) AS difference FROM c""")
def cash_reconciliation(spark, sf_dir):
    """Opening cash and the flows of the period against closing cash."""
    p = F.col("o_totalprice")
    closing = p * 1.1 + F.when(F.col("o_orderkey") % 3 == 0, 500.0).otherwise(4.5)
    c = valuation.cash_rolls_forward(p, [p * 0.4, -p * 0.1, -p * 0.2, F.lit(5.0)], closing)
    return read(spark, sf_dir, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.passed", F.round("c.difference", 4).alias("difference"))


#: Inputs of the models for each customer, in SQL for both.
MODEL_INPUTS = {
    "metric_per_share": "c_acctbal / 100", "target_multiple": "8e0 + c_nationkey", "low_multiple": "CASE WHEN c_custkey % 2 = 0 THEN 6e0 END", "high_multiple": "CASE WHEN c_custkey % 17 = 0 THEN -1e0 WHEN c_custkey % 3 = 0 THEN 40e0 END",
    "base_fcff": "c_acctbal * 3.0137e0", "base_fcfe": "c_acctbal * 2.0171e0", "wacc": "0.07e0 + c_nationkey * 0.001e0", "cost_of_equity": "0.09e0", "terminal_growth": "CASE WHEN c_custkey % 19 = 0 THEN 0.2e0 ELSE 0.02e0 END", "dividend_per_share": "c_acctbal / 500",
    "shares_outstanding": "CASE WHEN c_custkey % 23 = 0 THEN 0e0 ELSE 10.7183e0 + c_nationkey END", "net_debt": "CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END", "liabilities": "c_nationkey * 50e0", "normalized_eps": "c_acctbal / 200", "target_pe": "12e0", "low_eps": "CASE WHEN c_custkey % 5 = 0 THEN 1e0 END",
    "low_pe": "8e0", "high_eps": "c_acctbal / 100", "high_pe": "CASE WHEN c_custkey % 4 = 0 THEN 20e0 END", "embedded_value_per_share": "c_acctbal / 50", "target_pev": "0.9e0",
}
_G = (0.08, 0.06, 0.05)


def _dcf_sql(base: str, rate: str) -> str:
    grown, parts = base, []
    for i, g in enumerate(_G, 1):
        grown += f" * {1 + g}::DOUBLE"
        parts.append(f"{grown} / power(1 + {rate}, {i})")
    return f"CASE WHEN {rate} > terminal_growth AND {rate} > 0 AND {base} > 0 THEN {' + '.join(parts)} + {grown} * (1 + terminal_growth) / ({rate} - terminal_growth) / power(1 + {rate}, 3) END"


_MODEL_SQL = {
    "relative": ("metric_per_share > 0 AND target_multiple > 0", "CASE WHEN coalesce(low_multiple, target_multiple) > 0 AND coalesce(high_multiple, target_multiple) > 0 THEN metric_per_share * target_multiple END", "metric_per_share * coalesce(low_multiple, target_multiple)", "metric_per_share * coalesce(high_multiple, target_multiple)"),
    "fcff_dcf": ("base_fcff > 0 AND wacc > 0 AND shares_outstanding > 0", f"(({_dcf_sql('base_fcff', 'wacc')}) - coalesce(net_debt, 0)) / nullif(shares_outstanding, 0)", None, None),
    "fcfe_dcf": ("base_fcfe > 0 AND cost_of_equity > 0 AND shares_outstanding > 0", f"({_dcf_sql('base_fcfe', 'cost_of_equity')}) / nullif(shares_outstanding, 0)", None, None),
    "ddm": ("dividend_per_share > 0 AND cost_of_equity > 0", _dcf_sql("dividend_per_share", "cost_of_equity"), None, None),
    "sotp": ("shares_outstanding > 0", "CASE WHEN c_custkey % 6 <> 0 THEN (c_acctbal * 2 + 100 - coalesce(net_debt, 0)) / nullif(shares_outstanding, 0) END", None, None),
    "nav": ("shares_outstanding > 0", "(c_acctbal * 0.8e0 + 300 - liabilities) / nullif(shares_outstanding, 0)", None, None),
    "cycle_normalized": ("normalized_eps > 0 AND target_pe > 0", "normalized_eps * target_pe", "coalesce(low_eps, normalized_eps) * coalesce(low_pe, target_pe)", "coalesce(high_eps, normalized_eps) * coalesce(high_pe, target_pe)"),
    "embedded_value": ("embedded_value_per_share > 0 AND target_pev > 0", "embedded_value_per_share * target_pev", None, None),
}
_RUNS = " UNION ALL ".join(f"SELECT c_custkey, '{m}' AS method, coalesce({ok}, false) AS ok, {v} AS v, {lo or 'NULL'} AS lo, {hi or 'NULL'} AS hi FROM m" for m, (ok, v, lo, hi) in _MODEL_SQL.items())


@query("WITH m AS (SELECT c_custkey, c_acctbal, " + ", ".join(f"{e} AS {n}" for n, e in MODEL_INPUTS.items()) + f" FROM customer), r AS ({_RUNS}), f AS (SELECT *, CASE WHEN NOT ok THEN 'input_not_positive' WHEN v IS NULL THEN 'no_value' WHEN v <= 0 THEN 'value_not_positive' END AS failure FROM r)" + """
SELECT c_custkey, method, CASE WHEN failure IS NULL THEN 'success' ELSE 'failed' END AS status, CASE WHEN failure IS NULL THEN round(v, 4) END AS value, CASE WHEN failure IS NULL THEN round(coalesce(lo, v), 4) END AS low, CASE WHEN failure IS NULL THEN round(coalesce(hi, v), 4) END AS high, failure FROM f
UNION ALL SELECT c_custkey, m, 'not_applicable', NULL, NULL, NULL, 'no_model' FROM customer, (VALUES ('relative@2'), ('unknown')) x(m)""")
def valuation_models(spark, sf_dir):
    """Each model by its name and version, with what failed and why."""
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal", *[f"{e} AS {n}" for n, e in MODEL_INPUTS.items()])
    v = {n: F.col(n) for n in MODEL_INPUTS} | {"growth_rates": F.array(*map(F.lit, _G))}
    item = lambda value, adjustment=None: F.struct(F.lit(value).alias("value") if isinstance(value, float) else value.alias("value"), F.lit(adjustment).cast("double").alias("adjustment"))
    v["segments"] = F.when(F.col("c_custkey") % 6 != 0, F.array(item(F.col("c_acctbal") * 2), item(100.0))).otherwise(F.slice(F.array(item(1.0)), 1, 0))
    v["assets"] = F.array(item(F.col("c_acctbal"), 0.8), item(300.0))
    names = [*_MODEL_SQL, "relative@2", "unknown"]
    # A small file is one or two partitions, its models are most of the work: rows are dealt to all cores first.
    rows = c.repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").withColumn("method", F.explode(F.array(*map(F.lit, names))))
    run = valuation.execute(F.split_part("method", F.lit("@"), F.lit(1)), F.when(F.col("method").contains("@"), "2.0.0").otherwise("1.0.0"), v)
    return rows.select("c_custkey", "method", run.alias("r")).select("c_custkey", "method", "r.*")


#: A scenario's inputs in SQL for both, from s_suppkey (k), s_acctbal (b) and the scenario's number (i).
ASSUMED = {
    "base_revenue": "b * 10", "volume_growth": "0.02e0 * i", "price_growth": "0.01e0 * i", "gross_margin": "0.45e0", "expense_ratio": "0.2e0", "tax_rate": "0.25e0", "depreciation_ratio": "0.03e0", "capex_ratio": "CASE WHEN k % 5 = 0 THEN 0.5e0 ELSE 0.05e0 END",
    "working_capital_ratio": "0.1e0", "minority_interest_ratio": "CASE WHEN k % 7 = 0 THEN 1.2e0 ELSE 0.05e0 END", "non_recurring_after_tax": "3e0", "net_debt": "b", "shares_outstanding": "50e0", "wacc": "CASE WHEN k % 11 = 0 THEN 0.01e0 ELSE 0.09e0 END", "terminal_growth": "0.02e0", "years": "3e0 + k % 3",
}
_LONG = " UNION ALL ".join(f"SELECT k, i, '{n}' AS name, CAST({e} AS DOUBLE) AS value FROM q" for n, e in ASSUMED.items())


@query(f"""WITH q AS (SELECT s_suppkey AS k, s_acctbal AS b, i FROM supplier, (VALUES (-1), (0), (1)) t(i)), a AS (SELECT * FROM ({_LONG}) WHERE NOT (name = 'wacc' AND k % 4 = 1 AND i = 1)), g AS (SELECT k, i, count(*) AS n FROM a GROUP BY 1, 2),
w AS (SELECT q.k, i, {", ".join(f"{e} AS {n}" for n, e in ASSUMED.items())} FROM q), y AS (SELECT *, (1 + volume_growth) * (1 + price_growth) - 1 AS gr, (gross_margin - expense_ratio) * (1 - tax_rate) AS af FROM w),
t AS (SELECT k, i, j, base_revenue * power(1 + gr, j) * (af + depreciation_ratio - capex_ratio) - (base_revenue * power(1 + gr, j) - base_revenue * power(1 + gr, j - 1)) * working_capital_ratio AS flow FROM y, range(1, 6) r(j) WHERE j <= years),
p AS (SELECT y.*, sum(flow / power(1 + wacc, j)) AS pv, arg_max(flow, j) AS last FROM y JOIN t USING (k, i) GROUP BY ALL),
v AS (SELECT *, (pv + last * (1 + terminal_growth) / (wacc - terminal_growth) / power(1 + wacc, years) - net_debt) / shares_outstanding AS fair, (base_revenue * power(1 + gr, years) * af * (1 - minority_interest_ratio) - non_recurring_after_tax) / shares_outstanding AS eps FROM p),
f AS (SELECT v.*, n, CASE WHEN n < 16 THEN 'missing' WHEN k % 6 = 2 THEN 'expired' WHEN minority_interest_ratio > 1 THEN 'share_outside_0_1' WHEN wacc <= terminal_growth THEN 'wacc_below_growth' WHEN base_revenue <= 0 THEN 'revenue_or_shares' WHEN last <= 0 THEN 'last_flow_not_positive' WHEN fair <= 0 THEN 'value_not_positive' END AS failure FROM v JOIN g USING (k, i))
SELECT k AS s_suppkey, CASE i WHEN -1 THEN 'bear' WHEN 0 THEN 'base' ELSE 'bull' END AS scenario, failure, CASE WHEN n < 16 THEN 'wacc' WHEN k % 6 = 2 THEN 'gross_margin' END AS names, CASE WHEN failure IS NULL THEN round(gr, 6) END AS revenue_growth, CASE WHEN failure IS NULL THEN round(eps, 4) END AS last_eps, CASE WHEN failure IS NULL THEN round(fair, 4) END AS fair_value, CASE WHEN failure IS NULL THEN k % 3 <> 0 END AS confirmed FROM f""")
def scenario_projections(spark, sf_dir):
    """Bear, base and bull cases from assumption rows: missing and expired ones first, then the projection."""
    q = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("i"))
    item = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(f"CAST({e} AS DOUBLE)").alias("value")) for n, e in ASSUMED.items()]))
    rows = q.select("k", "i", item.alias("x")).select("k", "i", "x.*").where("not (name = 'wacc' and k % 4 = 1 and i = 1)")
    until = F.when((F.col("k") % 6 == 2) & (F.col("name") == "gross_margin"), "2020-01-01").otherwise("2030-01-01").cast("date")
    rows = rows.withColumns({"valid_until": until, "confirmed": (F.col("k") % 3 != 0) | (F.col("name") != "wacc")})
    return scenarios(rows, "2026-01-01").select(F.col("k").alias("s_suppkey"), F.when(F.col("i") == -1, "bear").when(F.col("i") == 0, "base").otherwise("bull").alias("scenario"), "failure", "names", "revenue_growth", "last_eps", "fair_value", "confirmed")


def scenarios(assumptions: DataFrame, as_of: str) -> DataFrame:
    """One row for each (k, i) of assumption rows (k, i, name, value, valid_until, confirmed)."""
    late = F.col("valid_until") < F.lit(as_of).cast("date")
    wide = assumptions.groupBy("k", "i").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in valuation.SCENARIO_INPUTS], F.sort_array(F.collect_set(F.when(late, F.col("name")))).alias("expired"), F.every("confirmed").alias("confirmed"))
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in sorted(valuation.SCENARIO_INPUTS)]))
    wide = wide.select("*", missing.alias("missing"), valuation.scenario({n: F.col(n) for n in valuation.SCENARIO_INPUTS}).alias("r"))
    early = F.when(F.size("missing") > 0, "missing").when(F.size("expired") > 0, "expired")
    good = lambda x: F.when(early.isNull() & F.col("r.failure").isNull(), F.col(x))
    names = F.when(F.size("missing") > 0, F.array_join("missing", ",")).when(F.size("expired") > 0, F.array_join("expired", ","))
    return wide.select("k", "i", F.coalesce(early, "r.failure").alias("failure"), names.alias("names"), *[good(f"r.{x}").alias(x) for x in ("revenue_growth", "last_eps", "fair_value")], good("confirmed").alias("confirmed"))


@query("""WITH v AS (SELECT p_brand AS g, p_partkey AS i, p_retailprice AS value, p_size > 25 AS is_scenario, p_size % 7 > 0 AS ok FROM part), a AS (SELECT g, min(value) FILTER (WHERE is_scenario AND ok) AS slow, max(value) FILTER (WHERE is_scenario AND ok) AS shigh, arg_min(value, i) FILTER (WHERE is_scenario AND ok) AS sbase,
  min(value) FILTER (WHERE NOT is_scenario AND ok) AS mlow, max(value) FILTER (WHERE NOT is_scenario AND ok) AS mhigh, count(*) FILTER (WHERE NOT is_scenario AND ok) AS n, arg_min(value, i) FILTER (WHERE NOT is_scenario AND ok) AS mbase, avg(value) * 0.9e0 AS price, bool_or(i % 97 = 0) AS conflict FROM v GROUP BY 1),
w AS (SELECT *, coalesce(n > 1 AND mhigh / mlow > 1.05e0, false) AS spread, coalesce(sbase, mbase) AS base FROM a)
SELECT g AS p_brand, round(CASE WHEN spread THEN least(mlow, slow) ELSE coalesce(slow, mbase) END, 4) AS low, round(base, 4) AS base, round(CASE WHEN spread THEN greatest(mhigh, shigh) ELSE coalesce(shigh, mbase) END, 4) AS high, spread, round(1 - price / base, 6) AS margin_of_safety,
  CASE WHEN conflict OR spread THEN 'unrated' WHEN base / price - 1 >= 0.2e0 THEN 'positive' WHEN base / price - 1 <= -0.1e0 THEN 'cautious' ELSE 'neutral' END AS rating FROM w""")
def valuation_conclusion(spark, sf_dir):
    """Range of scenarios and models, spread between models, margin of safety and rating."""
    p = read(spark, sf_dir, "part")
    ok, is_scenario = F.col("p_size") % 7 > 0, F.col("p_size") > 25
    s, m = F.when(is_scenario & ok, F.col("p_retailprice")), F.when(~is_scenario & ok, F.col("p_retailprice"))
    first = lambda x: F.min_by(x, F.when(x.isNotNull(), F.col("p_partkey")))
    a = p.groupBy("p_brand").agg(
        F.min(s).alias("slow"), F.max(s).alias("shigh"), first(s).alias("sbase"), F.min(m).alias("mlow"), F.max(m).alias("mhigh"), F.count(m).alias("n"), first(m).alias("mbase"),
        (F.avg("p_retailprice") * 0.9).alias("price"), F.bool_or(F.col("p_partkey") % 97 == 0).alias("conflict"),
    ).withColumns({"spread": F.coalesce((F.col("n") > 1) & (F.col("mhigh") / F.col("mlow") > 1.05), F.lit(False)), "base": F.coalesce("sbase", "mbase")})
    up = F.col("base") / F.col("price") - 1
    rating = F.when(F.col("conflict") | F.col("spread"), "unrated").when(up >= 0.2, "positive").when(up <= -0.1, "cautious").otherwise("neutral")
    wide = lambda f, x, y: F.round(F.when(F.col("spread"), f(x, y)).otherwise(F.coalesce(y, "mbase")), 4)
    return a.select("p_brand", wide(F.least, "mlow", "slow").alias("low"), F.round("base", 4).alias("base"), wide(F.greatest, "mhigh", "shigh").alias("high"), "spread", F.round(1 - F.col("price") / F.col("base"), 6).alias("margin_of_safety"), rating.alias("rating"))


@query(f"""WITH {YTD}, t AS (SELECT a.ticker, a.period_end, CASE WHEN quarter(a.period_end) = 4 THEN a.value ELSE a.value + b.value - c.value END AS ttm FROM ytd a LEFT JOIN ytd b ON a.ticker = b.ticker AND b.period_end = make_date(year(a.period_end) - 1, 12, 31)
  LEFT JOIN ytd c ON a.ticker = c.ticker AND c.period_end = last_day(a.period_end - INTERVAL 1 YEAR)), l AS (SELECT ticker, max(period_end) FILTER (WHERE ttm IS NOT NULL) AS anchor, arg_max(ttm, period_end) FILTER (WHERE ttm IS NOT NULL) AS ttm FROM t GROUP BY 1),
s AS (SELECT n_name AS ticker, count(*) AS shares, avg(s_acctbal) AS price, CASE WHEN n_nationkey % 6 <> 0 THEN sum(s_acctbal) END AS equity FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey)
SELECT ticker, strftime(anchor, '%Y-%m-%d') AS anchor, CASE WHEN price <= 0 THEN 'price' WHEN ttm IS NULL OR ttm <= 0 THEN 'ttm_not_positive' END AS pe_warning, CASE WHEN price > 0 AND ttm > 0 THEN round(price * shares / ttm, 8) END AS pe_ttm,
  CASE WHEN price <= 0 THEN 'price' WHEN equity IS NULL OR equity <= 0 THEN 'equity_not_positive' END AS pb_warning, CASE WHEN price > 0 AND equity > 0 THEN round(price * shares / equity, 8) END AS pb FROM s LEFT JOIN l USING (ticker)""")
def market_multiples(spark, sf_dir):
    """Price over trailing profit and over book, with the period each rests on or the reason there is none."""
    t = periods.ttm_from_annual(to_date_flows(spark, sf_dir), ["ticker"]).where("ttm is not null").groupBy("ticker").agg(F.max("period_end").alias("anchor"), F.max_by("ttm", "period_end").alias("ttm"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("ticker"))
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("shares"), F.avg("s_acctbal").alias("price"), F.sum("s_acctbal").alias("equity")).join(n, "s_nationkey")
    s = s.withColumn("equity", F.when(F.col("s_nationkey") % 6 != 0, F.col("equity")))
    price, value = F.col("price"), F.col("price") * F.col("shares")
    over = lambda x: F.when((price > 0) & (F.col(x) > 0), F.round(value / F.col(x), 8))
    warn = lambda x, code: F.when(price <= 0, "price").when(F.col(x).isNull() | (F.col(x) <= 0), code)
    return s.join(t, "ticker", "left").select("ticker", F.date_format("anchor", "yyyy-MM-dd").alias("anchor"), warn("ttm", "ttm_not_positive").alias("pe_warning"), over("ttm").alias("pe_ttm"), warn("equity", "equity_not_positive").alias("pb_warning"), over("equity").alias("pb"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN '元' WHEN 1 THEN '千元' WHEN 2 THEN '万元' WHEN 3 THEN '百万元' WHEN 4 THEN '亿元' ELSE '美元' END AS unit, l_quantity AS v FROM lineitem), s AS (SELECT *, CASE unit WHEN '元' THEN 1 WHEN '千元' THEN 1000 WHEN '万元' THEN 10000 WHEN '百万元' THEN 1000000 WHEN '亿元' THEN 100000000 END AS f FROM x)
SELECT l_orderkey, l_linenumber, unit, round(v * f, 2) AS cny, round(v * f / 10000, 6) AS wan, f IS NULL AS unknown_unit FROM s""")
def unit_conversion(spark, sf_dir):
    """Amounts to yuan and on to another unit; an unknown unit gives null and is never guessed."""
    units = F.array(*[F.lit(u) for u in (*finance.CNY_UNITS, "美元")])
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(units, F.col("l_linenumber") % 6 + 1).alias("unit"), "l_quantity")
    cny = finance.to_cny(F.col("l_quantity"), F.col("unit"))
    return x.select("l_orderkey", "l_linenumber", "unit", F.round(cny, 2).alias("cny"), F.round(cny / finance.CNY_UNITS["万元"], 6).alias("wan"), cny.isNull().alias("unknown_unit"))


@query("""WITH q AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice AS value, CASE WHEN o_orderstatus = 'P' THEN 'USD' ELSE 'CNY' END AS unit FROM orders), l AS (SELECT *, lag(value) OVER w AS prev, lag(unit) OVER w AS prev_unit FROM q WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, op, CASE WHEN prev IS NULL THEN 'missing_operand' WHEN unit <> prev_unit THEN 'definition_mismatch' WHEN op <> 'difference' AND prev = 0 THEN 'zero_denominator' END AS failure, CASE WHEN unit = prev_unit THEN round(CASE op WHEN 'ratio' THEN value / prev WHEN 'one_minus_ratio' THEN 1 - value / prev ELSE value - prev END, 6) END AS value FROM l, (VALUES ('ratio'), ('one_minus_ratio'), ('difference')) o(op)""")
def derived_values(spark, sf_dir):
    """Ratios, one minus ratios and differences of operands that are defined alike."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    q = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("a"), F.when(F.col("o_orderstatus") == "P", "USD").otherwise("CNY").alias("unit"))
    q = q.select("o_orderkey", "a", "unit", F.lag("a").over(w).alias("b"), F.lag("unit").over(w).alias("other"))
    q = q.select("*", F.explode(F.array(*map(F.lit, ("ratio", "one_minus_ratio", "difference")))).alias("op"))
    return q.select("o_orderkey", "op", finance.derived(F.col("op"), F.col("a"), F.col("b"), F.col("unit") == F.col("other")).alias("d")).select("o_orderkey", "op", "d.failure", F.round("d.value", 6).alias("value"))


@query("""SELECT p_partkey, round(p_retailprice / (p_retailprice - p_size) - 1, 8) AS price_change, round(p_size / nullif(p_retailprice - 900, 0), 8) AS payout_ratio, round(p_size / p_retailprice, 8) AS dividend_yield, round(p_size * (1 + 0.1e0) / p_retailprice, 8) AS forecast_yield FROM part""")
def distribution_yields(spark, sf_dir):
    """Price change, payout ratio, dividend yield and the yield of a forecast dividend."""
    p, d = F.col("p_retailprice"), F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", *[F.round(x, 8).alias(n) for n, x in (("price_change", F.try_divide(p, p - d) - 1), ("payout_ratio", F.try_divide(d, p - 900)), ("dividend_yield", F.try_divide(d, p)), ("forecast_yield", F.try_divide(d * 1.1, p)))])


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS a, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(a) OVER (PARTITION BY l_suppkey) AS total FROM s)
SELECT l_suppkey, l_returnflag, CAST(round(CAST(a AS DOUBLE) / CAST(total AS DOUBLE) * 100, 2) AS DOUBLE) AS share_pct, round(CAST(a AS DOUBLE) / CAST(q AS DOUBLE), 2) AS blended_unit_revenue, abs(CAST(total AS DOUBLE) * 1.0005e0 - CAST(total AS DOUBLE)) <= greatest(CAST(total AS DOUBLE) * 0.001e0, 1) AS total_agrees FROM t""")
def composition_shares(spark, sf_dir):
    """Shares of a total that agrees with the printed one, and blended unit revenue, rounded half up."""
    from pyspark.sql.window import Window

    s = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(*[F.sum(F.col(c).cast("decimal(18,2)")).alias(n) for c, n in (("l_extendedprice", "a"), ("l_quantity", "q"))])
    s = s.withColumn("t", F.sum("a").over(Window.partitionBy("l_suppkey")).cast("double")).withColumns({"a": F.col("a").cast("double"), "q": F.col("q").cast("double")})
    t = F.col("t")
    return s.select("l_suppkey", "l_returnflag", F.round(F.col("a") / t * 100, 2).alias("share_pct"), F.round(F.col("a") / F.col("q"), 2).alias("blended_unit_revenue"), (F.abs(t * 1.0005 - t) <= F.greatest(t * 0.001, F.lit(1.0))).alias("total_agrees"))


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS yr, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS revenue, count(*)::DOUBLE * 1000 AS assets FROM orders GROUP BY 1, 2), p AS (SELECT a.*, b.revenue AS before, b.assets AS opening FROM y a LEFT JOIN y b ON a.o_custkey = b.o_custkey AND a.yr = b.yr + 1)
SELECT o_custkey, yr, round(revenue / nullif((assets + opening) / 2, 0), 8) AS asset_turnover, round(CASE WHEN before > 0 THEN power(revenue / before, 1e0) - 1 END, 8) AS growth, CASE WHEN opening IS NULL THEN 'no_opening_balance' END AS missing FROM p""")
def average_balance_ratios(spark, sf_dir):
    """Ratios to the average of opening and closing balances, and growth over the prior year."""
    y = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"), (F.count("*").cast("double") * 1000).alias("assets"))
    before = y.select("o_custkey", (F.col("yr") + 1).alias("yr"), F.col("revenue").alias("before"), F.col("assets").alias("opening"))
    p = y.join(before, ["o_custkey", "yr"], "left")
    return p.select(
        "o_custkey", "yr", F.round(F.try_divide(F.col("revenue"), (F.col("assets") + F.col("opening")) / 2), 8).alias("asset_turnover"), F.round(finance.cagr(F.col("before"), F.col("revenue"), F.lit(1)), 8).alias("growth"),
        F.when(F.col("opening").isNull(), "no_opening_balance").alias("missing"),
    )


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS b, 6 + c_nationkey AS pe FROM customer WHERE c_acctbal > 0)
SELECT c_custkey, s AS scenario, g AS growth, m AS multiple, round(b * (1 + g) * m, 6) AS value FROM (SELECT *, unnest([0.8e0, 1e0, 1.2e0]) AS f FROM c) JOIN (VALUES ('bear', 0.8e0), ('base', 1e0), ('bull', 1.2e0)) x(s, f2) ON f = f2, LATERAL (SELECT pe * f AS m), (VALUES (0e0), (0.1e0)) y(g)""")
def earnings_multiple_grid(spark, sf_dir):
    """Bear, base and bull multiples over a grid of earnings growth."""
    case = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("f")) for n, f in (("bear", 0.8), ("base", 1.0), ("bull", 1.2))]))
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal", (6 + F.col("c_nationkey")).alias("pe"), case.alias("s")).select("*", "s.*", F.explode(F.array(F.lit(0.0), F.lit(0.1))).alias("growth"))
    m = F.col("pe") * F.col("f")
    return c.select("c_custkey", "scenario", "growth", m.alias("multiple"), F.round(F.col("c_acctbal") * (1 + F.col("growth")) * m, 6).alias("value"))


@query("""WITH o AS (SELECT *, o_totalprice IS NULL OR o_totalprice <= 0 AS bad FROM orders)
SELECT 'orders_have_a_positive_total' AS check_name, count(*) FILTER (WHERE bad) AS n_bad, count(*) AS n, count(*) FILTER (WHERE bad) = 0 AS passed FROM o
UNION ALL SELECT 'items_ship_after_the_order', count(*) FILTER (WHERE l_shipdate < o_orderdate), count(*), count(*) FILTER (WHERE l_shipdate < o_orderdate) = 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'customers_are_solvent', count(*) FILTER (WHERE c_acctbal < 0), count(*), count(*) FILTER (WHERE c_acctbal < 0) = 0 FROM customer
UNION ALL SELECT 'parts_are_priced_once', count(*) - count(DISTINCT p_partkey), count(*), count(*) = count(DISTINCT p_partkey) FROM part""")
def data_quality_checks(spark, sf_dir):
    """A table of checks, each with how many rows fail it."""
    def check(df: DataFrame, name: str, bad) -> DataFrame:
        return df.agg(F.coalesce(bad, F.lit(0)).cast("long").alias("n_bad"), F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n_bad", "n", (F.col("n_bad") == 0).alias("passed"))

    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    dates = li.select("l_orderkey", "l_shipdate").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return reduce(DataFrame.union, [
        check(o, "orders_have_a_positive_total", F.count_if(F.col("o_totalprice").isNull() | (F.col("o_totalprice") <= 0))),
        check(dates, "items_ship_after_the_order", F.count_if(F.col("l_shipdate") < F.col("o_orderdate"))),
        check(read(spark, sf_dir, "customer"), "customers_are_solvent", F.count_if(F.col("c_acctbal") < 0)),
        check(read(spark, sf_dir, "part"), "parts_are_priced_once", F.count("*") - F.countDistinct("p_partkey")),
    ])
