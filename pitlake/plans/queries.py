"""Registered queries: operators applied to the driver's tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.functions import finance, periods as when, text
from pitlake.operators import analytics, periods, versions
from pitlake.sources.tables import read
from pitlake.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly revenue and cost of each nation (as company), summed in decimals."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    money = lambda e: F.sum(e.cast("decimal(18,4)"))
    # summed by nation key first: the name is joined to the few sums
    sums = joined.groupBy("c_nationkey", when.quarter_end(F.col("d")).alias("period_end")).agg(
        money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), money(F.col("l_extendedprice") * 0.6).alias("cost"), money(F.col("l_extendedprice") * F.col("l_tax")).alias("tax")
    )
    return sums.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("ticker", "period_end", *[F.col(x).cast("double").alias(x) for x in ("revenue", "cost", "tax")])


FLOWS = """flows AS (SELECT n_name AS ticker, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
  CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, CAST(sum(CAST(l_extendedprice * 0.6::DOUBLE AS DECIMAL(18,4))) AS DOUBLE) AS cost,
  CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def to_date_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-to-date revenue, with the quarter's own revenue and cost."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("ticker", F.year("period_end")).orderBy("period_end")
    return flows(spark, sf_dir).select("ticker", "period_end", "revenue", "cost", F.sum(F.col("revenue").cast("decimal(28,4)")).over(w).cast("double").alias("value"))


YTD = FLOWS + """, ytd AS (SELECT ticker, period_end, CAST(sum(CAST(revenue AS DECIMAL(28,4))) OVER (PARTITION BY ticker, year(period_end) ORDER BY period_end) AS DOUBLE) AS value FROM flows)"""


@query(f"""WITH {FLOWS}, t AS (SELECT *, lag(revenue, 4) OVER w AS p, lag(period_end, 4) OVER w AS pe, sum(CAST(revenue AS DECIMAL(28,4))) OVER (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING) AS s,
  count(*) OVER (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING) AS c, min(year(period_end) * 4 + quarter(period_end)) OVER (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING) AS lo
  FROM flows WINDOW w AS (PARTITION BY ticker ORDER BY period_end))
SELECT ticker, period_end, round(revenue, 2) AS revenue, round(CASE WHEN c = 4 AND year(period_end) * 4 + quarter(period_end) - lo = 3 THEN CAST(s AS DOUBLE) END, 2) AS ttm, round((revenue - cost) / revenue, 8) AS gross_margin,
  round(CASE WHEN year(pe) = year(period_end) - 1 AND month(pe) = month(period_end) THEN (revenue - p) / p END, 8) AS yoy FROM t""")
def metrics_quarterly(spark, sf_dir):
    """Single quarters out of year-to-date values, TTM, margin, growth."""
    quarters = periods.single_quarters(to_date_flows(spark, sf_dir), ["ticker"])
    out = periods.year_on_year(periods.trailing_year(quarters, ["ticker"]), ["ticker"])
    margin = finance.gross_margin(F.col("revenue"), F.col("cost"))
    return out.select("ticker", "period_end", F.round("value", 2).alias("revenue"), F.round("ttm", 2).alias("ttm"), F.round(margin, 8).alias("gross_margin"), F.round("yoy", 8).alias("yoy"))


@query(f"""WITH {YTD} SELECT a.ticker, a.period_end, round(CASE WHEN quarter(a.period_end) = 4 THEN a.value ELSE a.value + b.value - c.value END, 2) AS ttm FROM ytd a
  LEFT JOIN ytd b ON a.ticker = b.ticker AND b.period_end = make_date(year(a.period_end) - 1, 12, 31) LEFT JOIN ytd c ON a.ticker = c.ticker AND c.period_end = last_day(a.period_end - INTERVAL 1 YEAR)""")
def ttm_from_annual(spark, sf_dir):
    """Year to date, plus last year, less last year to date."""
    return periods.ttm_from_annual(to_date_flows(spark, sf_dir), ["ticker"]).select("ticker", "period_end", F.round("ttm", 2).alias("ttm"))


@query(f"WITH {FLOWS} SELECT ticker, period_end, round(revenue, 2) AS revenue FROM flows QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) <= 12")
def last_quarters(spark, sf_dir):
    """The last twelve quarters."""
    return periods.keep_last(flows(spark, sf_dir), ["ticker"]).select("ticker", "period_end", F.round("revenue", 2).alias("revenue"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) = 1""")
def latest_restated(spark, sf_dir):
    """What was known at a cutoff, one version a key."""
    o = versions.known_at(read(spark, sf_dir, "orders"), F.lit("1998-06-30").cast("timestamp_ntz"), "o_orderdate")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return versions.latest(o, ["o_custkey"], [rank, F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, year(o_orderdate) DESC) = 1")
def active_versions(spark, sf_dir):
    """All rows that tie for the best rank."""
    return versions.active_versions(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.year("o_orderdate").desc()]).select("o_custkey", "o_orderkey")


@query("WITH v AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS old FROM events) SELECT id FROM v WHERE id NOT IN (SELECT old FROM v WHERE old IS NOT NULL)")
def version_heads(spark, sf_dir):
    """Leaves of supersession."""
    v = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 1).alias("old"))
    return versions.heads(v, "id", "old").select("id")


@query("""WITH v AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_id - 1 WHEN event_id % 50 = 1 THEN event_id - 2 END AS old, ts FROM events), l AS (SELECT v.*, o.id AS was, o.ts AS was_at FROM v LEFT JOIN v o ON v.old = o.id WHERE v.old IS NOT NULL)
SELECT id, 'dangling' AS fault FROM l WHERE was IS NULL UNION ALL SELECT id, 'time_reversal' FROM l WHERE ts < was_at UNION ALL SELECT old, 'branch' FROM l GROUP BY old HAVING count(*) > 1""")
def version_faults(spark, sf_dir):
    """Dangling, branched and time-reversed versions as rows."""
    e = F.col("event_id")
    v = read(spark, sf_dir, "events").select(e.alias("id"), F.when(e % 3 == 0, e - 1).when(e % 50 == 1, e - 2).alias("old"), "ts")
    return versions.version_faults(v, "id", "old", "ts")


@query("SELECT user_id, event_type, count(DISTINCT props) AS n_payloads FROM events GROUP BY 1, 2 HAVING count(DISTINCT props) > 1")
def payload_conflicts(spark, sf_dir):
    """Keys with more than one payload."""
    return versions.conflicts(read(spark, sf_dir, "events"), ["user_id", "event_type"], "props")


@query("""WITH t AS (SELECT event_id, event_type AS payload FROM events WHERE event_type <> 'view'), i AS (SELECT event_id, CASE WHEN value > 50 THEN 'changed' ELSE event_type END AS payload FROM events)
SELECT event_id, payload FROM i WHERE event_id NOT IN (SELECT event_id FROM t)""")
def immutable_append(spark, sf_dir):
    """What an append adds; rows known already and conflicts stay out."""
    e = read(spark, sf_dir, "events")
    table = e.where("event_type <> 'view'").select("event_id", F.col("event_type").alias("payload"))
    new = e.select("event_id", F.when(F.col("value") > 50, "changed").otherwise(F.col("event_type")).alias("payload"))
    return versions.immutable_append(table, new, "event_id", "payload")[0]


@query("""WITH t AS (SELECT event_id, event_type AS payload FROM events WHERE event_id % 2 = 0), i AS (SELECT DISTINCT event_id, CASE WHEN event_id % 10 = 0 THEN 'changed' ELSE event_type END AS payload FROM events)
SELECT event_id, payload FROM i WHERE event_id NOT IN (SELECT event_id FROM t)""")
def whole_append(spark, sf_dir):
    """immutable_append of every event onto the even ones."""
    e = read(spark, sf_dir, "events")
    table = e.where("event_id % 2 = 0").select("event_id", F.col("event_type").alias("payload"))
    new = e.select("event_id", F.when(F.col("event_id") % 10 == 0, "changed").otherwise(F.col("event_type")).alias("payload"))
    return versions.immutable_append(table, new, "event_id", "payload")[0]


@query("""SELECT e.event_id, e.user_id, p.value AS last_purchase FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') e
  ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of_join(spark, sf_dir):
    """The last purchase before each error of a user."""
    e = read(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("last_purchase"))
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return versions.as_of(left, right, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "user_id", "last_purchase")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1998-01-15' AND l_shipdate > TIMESTAMP '1998-01-15'")
def interval_join(spark, sf_dir):
    """Items open at an instant: from <= t < to."""
    at = F.lit("1998-01-15").cast("timestamp_ntz")
    o = read(spark, sf_dir, "orders").where(F.col("o_orderdate") <= at).select("o_orderkey")
    return read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > at).join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query(f"WITH {FLOWS} SELECT period_end FROM flows GROUP BY 1 HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM flows)")
def complete_dates(spark, sf_dir):
    """Dates that all companies have."""
    return analytics.complete_dates(flows(spark, sf_dir), "ticker", "period_end")


VERSIONED = """f AS (SELECT l_partkey AS part, l_orderkey * 10 + l_linenumber AS fact_id, l_extendedprice / l_quantity AS value, CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS authority, l_suppkey AS upstream, l_shipdate AS available_at FROM lineitem)"""


@query(f"""WITH {VERSIONED}, b AS (SELECT *, first_value(value) OVER w AS best, first_value(upstream) OVER w AS up, row_number() OVER w AS rn FROM f WINDOW w AS (PARTITION BY part ORDER BY authority, available_at DESC, fact_id)),
x AS (SELECT *, abs(value - best) / greatest(abs(value), abs(best), 1) AS off FROM b)
SELECT part, min(best) AS value, arg_min(fact_id, rn) AS fact_id, count(*) AS n_versions, CASE WHEN bool_or(rn > 1 AND off > 0.001) THEN 'pending' WHEN bool_or(rn > 1 AND up <> upstream AND off <= 0.001) THEN 'dual' ELSE 'single' END AS status FROM x GROUP BY part""")
def consolidate(spark, sf_dir):
    """A1 K1-K4: preferred value and verification status."""
    li = read(spark, sf_dir, "lineitem")
    f = li.select(F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"), F.when(F.col("l_linenumber") == 1, 1).otherwise(2).alias("authority"), F.col("l_suppkey").alias("upstream"), F.col("l_shipdate").alias("available_at"))
    return analytics.consolidate(f, ["part"])


@query("""WITH s AS (SELECT p_brand, p_retailprice - 1000 AS v, p_partkey AS seq FROM part), a AS (SELECT p_brand, count(*) FILTER (WHERE v > 0) AS n, count(*) FILTER (WHERE NOT coalesce(v > 0, false)) AS n_excluded, quantile_cont(v, 0.1) FILTER (WHERE v > 0) AS p10, quantile_cont(v, 0.5) FILTER (WHERE v > 0) AS p50, quantile_cont(v, 0.9) FILTER (WHERE v > 0) AS p90, arg_max(v, seq) AS latest FROM s GROUP BY 1)
SELECT a.p_brand, n, n_excluded, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(latest, 6) AS latest, round(m, 8) AS mid_rank FROM a LEFT JOIN (SELECT s.p_brand, (count(*) FILTER (WHERE v < latest) + 0.5 * count(*) FILTER (WHERE v = latest)) / count(*) AS m FROM s JOIN a ON s.p_brand = a.p_brand WHERE v > 0 GROUP BY 1) r ON a.p_brand = r.p_brand""")
def distribution(spark, sf_dir):
    """Type-7 quantiles, latest value and mid-rank."""
    p = read(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") - 1000).alias("v"), F.col("p_partkey").alias("at"))
    d = analytics.distribution(p, ["p_brand"], "v", "at")
    return d.select("p_brand", "n", "n_excluded", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90", "latest")], F.round("mid_rank", 8).alias("mid_rank"))


@query("""WITH r AS (SELECT o_custkey AS unit, o_orderpriority AS group_id, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'any_of' ELSE 'all_of' END AS m, CAST(o_orderkey AS VARCHAR) AS rid, o_orderstatus <> 'P' AS ready FROM orders),
g AS (SELECT unit, group_id, CASE WHEN max(m) = 'any_of' THEN bool_or(ready) ELSE bool_and(ready) END AS ok, list(DISTINCT rid) FILTER (WHERE NOT ready) AS missing FROM r GROUP BY 1, 2)
SELECT unit, bool_and(ok) AS ready, round(avg(ok::INT), 8) AS share, coalesce(array_to_string(list_sort(flatten(list(missing) FILTER (WHERE NOT ok))), ','), '') AS missing FROM g GROUP BY 1""")
def coverage(spark, sf_dir):
    """A3 A4: readiness of all-of and any-of groups."""
    o = read(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("group_id"), F.when(F.col("o_orderpriority").contains("URGENT"), "any_of").otherwise("all_of").alias("group_mode"), F.col("o_orderkey").cast("string").alias("requirement_id"), (F.col("o_orderstatus") != "P").alias("ready"))
    return analytics.coverage(r, ["unit"]).select("unit", "ready", F.round("share", 8).alias("share"), F.array_join("missing", ",").alias("missing"))


@query("WITH s AS (SELECT p_brand, p_partkey AS code, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey - p_partkey % 4 END AS parent FROM part) SELECT p_brand, code FROM s WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.parent = s.code AND c.p_brand = s.p_brand)")
def segment_leaves(spark, sf_dir):
    """Segments that are nobody's parent."""
    k = F.col("p_partkey")
    s = read(spark, sf_dir, "part").select("p_brand", k.alias("code"), F.when(k % 4 != 0, k - k % 4).alias("parent"))
    return analytics.leaves(s, ["p_brand"], "code", "parent").select("p_brand", "code")


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS g, s_acctbal AS v FROM supplier WHERE s_acctbal > 0), p AS (SELECT a.g, a.k, b.k AS peer, abs(b.v / a.v - 1) AS distance FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k)
SELECT g AS s_nationkey, k AS s_suppkey, peer, round(distance, 8) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY distance, peer) AS rank FROM p) WHERE rank <= 6""")
def nearest_peers(spark, sf_dir):
    """Six nearest peers by size."""
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return analytics.nearest_peers(s, "s_suppkey", "s_acctbal", ["s_nationkey"]).select("s_nationkey", "s_suppkey", "peer", F.round("distance", 8).alias("distance"), "rank")


@query("""WITH d AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN CAST(value AS DECIMAL(18,4)) WHEN 'error' THEN -CAST(value AS DECIMAL(18,4)) WHEN 'signup' THEN CASE WHEN event_id % 40 <> 0 THEN 0 END ELSE 0 END AS a FROM events),
r AS (SELECT *, bool_or(a IS NULL) OVER w AS bad, sum(a) OVER w AS s FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, CASE WHEN NOT bad THEN s END AS balance FROM r)
SELECT event_id, user_id, CAST(balance AS DOUBLE) AS balance, coalesce(min(balance) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 0, true) AS integrity FROM b""")
def running_balance(spark, sf_dir):
    """Ordered balance, unknown once and for all, negative is an integrity fault."""
    v, kind = F.col("value").cast("decimal(18,4)"), F.col("event_type")
    zero = F.lit(0).cast("decimal(18,4)")
    a = F.when(kind == "purchase", v).when(kind == "error", -v).when(kind == "signup", F.when(F.col("event_id") % 40 != 0, zero)).otherwise(zero)
    return analytics.running_balance(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], a).select("event_id", "user_id", F.col("balance").cast("double").alias("balance"), "integrity")


@query("SELECT DISTINCT n AS node, n - n % 7 AS root FROM (SELECT l_suppkey AS n FROM lineitem UNION ALL SELECT l_suppkey - l_suppkey % 7 FROM lineitem)")
def linked_groups(spark, sf_dir):
    """Groups of linked nodes: each supplier with the head of its seven."""
    s = F.col("l_suppkey")
    return analytics.linked_groups(read(spark, sf_dir, "lineitem").select(s.alias("a"), (s - s % 7).alias("b")).distinct(), "a", "b")


@query()
def all_linked_groups(spark, sf_dir):
    """linked_groups over every supplier of a line item, one long chain; a recursive CTE is too slow for it."""
    s = F.col("l_suppkey")
    return analytics.linked_groups(read(spark, sf_dir, "lineitem").select(s.alias("a"), (s + 1).alias("b")).distinct(), "a", "b")


@query("""SELECT conv_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_rows, max(turn) % 5 AS declared_total, count(DISTINCT turn % 5) > 1 AS total_drift, count(DISTINCT turn) < count(*) AS duplicate_page, max(turn) > count(DISTINCT turn) AS page_gap, bool_or(role = 'assistant') AS has_terminal FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY 1""".replace("max(turn) % 5 AS", "max(turn % 5) AS"))
def page_audit(spark, sf_dir):
    """Closure of pages."""
    c = read(spark, sf_dir, "conversations").where("text is not null and role is not null")
    p = c.select("conv_id", F.col("turn").alias("page_number"), F.length("text").cast("long").alias("n_rows"), (F.col("turn") % 5).alias("declared_total"), (F.col("role") == "assistant").alias("terminal"))
    return analytics.page_audit(p, ["conv_id"]).drop("complete")


SLICES = "s AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) FILTER (WHERE event_type = 'error') < 2 AS ok FROM events GROUP BY 1, 2)"


@query(f"""WITH {SLICES}, x AS (SELECT *, NOT ok OR d > coalesce(max(d + 1) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d) AS b FROM s), y AS (SELECT *, bool_or(b) OVER (PARTITION BY user_id ORDER BY d) AS stop FROM x)
SELECT user_id, max(d + 1) FILTER (WHERE NOT stop) AS safe_through, count(*) FILTER (WHERE stop) AS n_blocked FROM y GROUP BY 1""")
def safe_through(spark, sf_dir):
    """How far complete slices reach without a gap."""
    e = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("start")).agg((F.count_if(F.col("event_type") == "error") < 2).alias("complete"))
    return analytics.safe_through(e.withColumn("end", F.date_add("start", 1)), ["user_id"])


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 75 AS e FROM orders), t AS (SELECT o_orderkey, e, s + CAST(i * 30 AS INT) AS tile_start FROM o, range(3) r(i))
SELECT o_orderkey, tile_start, least(tile_start + 30, e) AS tile_end FROM t""")
def time_tiles(spark, sf_dir):
    """Half-open tiles, the last one clipped."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s")).withColumn("e", F.date_add("s", 75))
    return analytics.tiles(o, "s", "e", 30).select("o_orderkey", F.col("tile_start").cast("date").alias("tile_start"), F.col("tile_end").cast("date").alias("tile_end"))


@query("""SELECT c_custkey, round(100 * power(1.05, 1) / 1.1 + 100 * 1.05 * 1.04 / power(1.1, 2) + 100 * 1.05 * 1.04 * 1.03 / power(1.1, 3) + 100 * 1.05 * 1.04 * 1.03 * 1.02 / (0.1 - 0.02) / power(1.1, 3), 6) * 1.0 AS unit_value,
  CASE WHEN c_acctbal > 0 THEN round(c_acctbal * (1.05 / 1.1 + 1.05 * 1.04 / power(1.1, 2) + 1.05 * 1.04 * 1.03 / power(1.1, 3) + 1.05 * 1.04 * 1.03 * 1.02 / 0.08 / power(1.1, 3)), 4) END AS value FROM customer""")
def discounted_value(spark, sf_dir):
    """Projected flows, present value and Gordon terminal value."""
    g = F.array(F.lit(0.05), F.lit(0.04), F.lit(0.03))
    v = lambda base: finance.discounted_value(finance.projected(base, g), F.lit(0.1), F.lit(0.02))
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(v(F.lit(100.0)), 6).alias("unit_value"), F.round(v(F.col("c_acctbal")), 4).alias("value"))


def _ahead(g: str) -> str:
    years = " + ".join(f"c_acctbal * power(1 + {g}, {j}) / power(1.1e0, {j})" for j in range(1, 6))
    return f"({years} + c_acctbal * power(1 + {g}, 5) * 1.02e0 / 0.08e0 / power(1.1e0, 5))"


@query(f"""WITH RECURSIVE r(k, c_acctbal, i, lo, hi) AS (SELECT c_custkey, c_acctbal, 0, -0.5e0, 1e0 FROM customer WHERE c_acctbal > 0 AND 5000 BETWEEN {_ahead("(-0.5e0)")} AND {_ahead("1e0")}
  UNION ALL SELECT k, c_acctbal, i + 1, CASE WHEN {_ahead("((lo + hi) / 2)")} < 5000 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_ahead("((lo + hi) / 2)")} < 5000 THEN hi ELSE (lo + hi) / 2 END FROM r WHERE i < 50)
SELECT c_custkey, round((lo + hi) / 2, 8) AS growth FROM customer LEFT JOIN (SELECT * FROM r WHERE i = 50) ON k = c_custkey""")
def implied_growth(spark, sf_dir):
    """Reverse DCF by bisection."""
    g = finance.implied_growth(F.lit(5000.0), F.col("c_acctbal"), F.lit(0.1), F.lit(0.02))
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(g, 8).alias("growth"))


@query("SELECT c_custkey, round(b + b * 0.05 / 1.1 + b * 1.09 * 0.05 / power(1.1, 2) + b * power(1.09, 2) * 0.05 / power(1.1, 3), 6) AS value FROM (SELECT c_custkey, c_acctbal AS b FROM customer)")
def residual_income(spark, sf_dir):
    """Book value and discounted residual income."""
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(finance.residual_income(F.col("c_acctbal"), F.lit(0.15), F.lit(0.4), F.lit(0.1), 3), 6).alias("value"))


@query(f"""WITH {FLOWS}, y AS (SELECT ticker, year(period_end) AS yr, sum(CAST(revenue AS DECIMAL(28,4)))::DOUBLE AS revenue, sum(CAST(cost AS DECIMAL(28,4)))::DOUBLE AS cost, sum(CAST(tax AS DECIMAL(28,4)))::DOUBLE AS tax FROM flows GROUP BY 1, 2)
SELECT ticker, yr, round((revenue - cost - tax) / revenue, 8) AS net_margin, round(revenue / (cost * 2), 8) AS asset_turnover, round((cost * 2) / (cost + tax), 8) AS equity_multiplier, round((revenue - cost - tax) / (cost + tax), 8) AS roe FROM y""")
def dupont(spark, sf_dir):
    """Ratio blocks and the three-factor identity."""
    y = flows(spark, sf_dir).groupBy("ticker", F.year("period_end").alias("yr")).agg(*[F.sum(F.col(c).cast("decimal(28,4)")).cast("double").alias(c) for c in ("revenue", "cost", "tax")])
    d = finance.dupont(F.col("revenue") - F.col("cost") - F.col("tax"), F.col("revenue"), F.col("cost") * 2, F.col("cost") + F.col("tax"))
    return y.select("ticker", "yr", d.alias("d")).select("ticker", "yr", *[F.round(f"d.{c}", 8).alias(c) for c in ("net_margin", "asset_turnover", "equity_multiplier", "roe")])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(power(5000 / c_acctbal, 1.0 / 3) - 1, 8) END AS cagr, abs(c_acctbal - c_acctbal * 0.6 - 400) <= greatest(abs(c_acctbal) * 0.001, 1) AS balanced, round(0.6::DOUBLE * 0.08 + 0.4::DOUBLE * 0.05 * 0.75, 8) AS wacc FROM customer")
def scalar_checks(spark, sf_dir):
    """CAGR, balance identity, WACC."""
    a = F.col("c_acctbal")
    w = finance.wacc(F.lit(60.0), F.lit(40.0), F.lit(0.08), F.lit(0.05), F.lit(0.25))
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(finance.cagr(a, F.lit(5000.0), F.lit(3)), 8).alias("cagr"), finance.balances(a, a * 0.6, F.lit(400.0)).alias("balanced"), F.round(w, 8).alias("wacc"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script\\s*>', ' ', 'gis'), '<style\\b.*?</style\\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, sf_dir):
    """Page text."""
    return read(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, substr(sha256(concat_ws('|', coalesce(strlen(CAST(page_id AS VARCHAR)) || ':' || page_id, 'n'), coalesce(strlen(url) || ':' || url, 'n'))), 1, 20) AS content_id FROM pages")
def content_ids(spark, sf_dir):
    """Content-addressed ids."""
    return read(spark, sf_dir, "pages").select("page_id", text.content_id("page_id", "url", digits=20).alias("content_id"))


RULES = [("query", 3, [r"\?"], [r"\bthe\b"], ["zzz"]), ("long", 2, ["^.{200,}"], [r"\band\b"], []), ("digits", 1, [r"[0-9]{3}"], [], [r"\?"])]


@query("""WITH s AS (SELECT conv_id, turn, split_part(text, chr(10), 1) AS t, text AS b FROM conversations), n AS (SELECT *, 1000 * regexp_matches(t, '\\?')::INT + 10 * regexp_matches(b, '\\bthe\\b')::INT AS q, 1000 * regexp_matches(t, '^.{200,}')::INT + 10 * regexp_matches(b, '\\band\\b')::INT AS l, 1000 * regexp_matches(t, '[0-9]{3}')::INT AS d, regexp_matches(t, '\\?') AS veto, regexp_matches(t, 'zzz') AS zzz FROM s WHERE t IS NOT NULL),
m AS (SELECT *, CASE WHEN q > 0 AND NOT zzz THEN q + 3 ELSE -1 END AS sq, CASE WHEN l > 0 THEN l + 2 ELSE -1 END AS sl, CASE WHEN d > 0 AND NOT veto THEN d + 1 ELSE -1 END AS sd FROM n)
SELECT conv_id, turn, CASE greatest(sq, sl, sd) WHEN -1 THEN NULL WHEN sq THEN 'query' WHEN sl THEN 'long' ELSE 'digits' END AS type, CASE WHEN greatest(sq, sl, sd) > 0 THEN greatest(sq, sl, sd) END AS score FROM m""")
def rule_classification(spark, sf_dir):
    """Rules with patterns of the title (the first line), body and veto."""
    c = read(spark, sf_dir, "conversations").where("text is not null")
    best = text.best_rule(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"), RULES)
    return c.select("conv_id", "turn", best.alias("b")).select("conv_id", "turn", F.col("b.type").alias("type"), F.col("b.score").alias("score"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    """Tumbling event-time windows."""
    e = read(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    return streams.windowed(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    """Session windows."""
    return streams.sessions(read(spark, sf_dir, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_revisions(spark, sf_dir):
    """The newest revision wins, whatever order batches come in."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    got = streams.latest_revisions(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), "user_id", ["ts", "event_id"])
    return got.select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


@query()
def series_links(spark, sf_dir):
    """Event chains."""
    e = read(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')")
    e = e.select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("i"), (F.col("event_id") % 3).cast("string"))).alias("identity"), F.col("ts").alias("available_at"), (F.col("event_type") == "purchase").alias("closes"))
    return analytics.series_links(e, ["user_id"])
