"""Registered queries that choose among versions, candidates and records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.functions import periods as when, rules
from pitlake.operators import materialize, selection
from pitlake.plans.queries import query
from pitlake.sources.tables import read


def cutoff():
    return F.lit("1998-06-30").cast("timestamp_ntz")


@query("""SELECT 'order' AS record_type, CAST(o_orderkey AS VARCHAR) AS key, o_orderdate AS at_, o_totalprice AS value, o_orderstatus AS state FROM orders UNION ALL SELECT 'item', l_orderkey || '-' || l_linenumber, l_shipdate, l_extendedprice, l_linestatus FROM lineitem
UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), ts, value, event_type FROM events UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), NULL, p_retailprice, NULL FROM part UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), NULL, s_acctbal, NULL FROM supplier""")
def uniform_index(spark, sf_dir):
    """S3: five kinds of records in one index."""
    t = lambda n: read(spark, sf_dir, n)
    c = F.col
    return selection.uniform([
        ("order", t("orders"), {"key": c("o_orderkey"), "at_": c("o_orderdate"), "value": c("o_totalprice"), "state": c("o_orderstatus")}),
        ("item", t("lineitem"), {"key": F.concat_ws("-", "l_orderkey", "l_linenumber"), "at_": c("l_shipdate"), "value": c("l_extendedprice"), "state": c("l_linestatus")}),
        ("event", t("events"), {"key": c("event_id"), "at_": c("ts"), "value": c("value"), "state": c("event_type")}),
        ("part", t("part"), {"key": c("p_partkey"), "value": c("p_retailprice")}),
        ("supplier", t("supplier"), {"key": c("s_suppkey"), "value": c("s_acctbal")}),
    ], {"key": "string", "at_": "timestamp_ntz", "value": "double", "state": "string"})


@query("""WITH outcome AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1), proof AS (SELECT c_custkey AS k, list_contains(list(o_orderstatus), 'F') AS complete FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT l_orderkey, l_linenumber, o_custkey, last FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN outcome ON outcome.k = c_custkey JOIN proof ON proof.k = c_custkey WHERE last <> 'error' AND complete""")
def committed_records(spark, sf_dir):
    """Records of committed pages whose job ended well and whose completion is proven."""
    last = selection.newest(read(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), "ts", "event_id", "event_type"), ["o_custkey"], ["ts", "event_id"]).where("event_type <> 'error'")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    proof = o.groupBy("o_custkey").agg(F.array_contains(F.collect_set("o_orderstatus"), "F").alias("complete")).where("complete")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    jobs = last.join(proof, "o_custkey").join(c, "o_custkey").select("o_custkey", F.col("event_type").alias("last"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(o.drop("o_orderstatus"), "o_orderkey").join(jobs, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_custkey", "last")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def point_reads(spark, sf_dir):
    """Rows of a set of ids, as a semi-join whatever the set's size."""
    ids = read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(ids, "o_orderkey", "left_semi")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 80")
def record_page(spark, sf_dir):
    """The third page of forty records."""
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(80).limit(40)


@query("SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS INT)) AS latest, max(ts) AS at_ FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def latest_in_payload(spark, sf_dir):
    """The largest value of a JSON field under a cutoff."""
    e = read(spark, sf_dir, "events").where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")).select("user_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k is not null")
    return e.groupBy("user_id").agg(F.max("k").alias("latest"), F.max("ts").alias("at_"))


@query("SELECT DISTINCT o_orderstatus AS dataset, strftime(o_orderdate, '%Y-%m') AS period FROM orders WHERE o_orderpriority <> '1-URGENT'")
def report_periods(spark, sf_dir):
    """Report periods committed by other runs."""
    o = read(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'")
    return o.select(F.col("o_orderstatus").alias("dataset"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).distinct()


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, unnest([l_suppkey, l_suppkey + 7, NULL]) AS source_id FROM lineitem)
SELECT l_orderkey, l_linenumber, count(s_suppkey) AS n_found, count(source_id) - count(s_suppkey) AS n_missing, round(max(s_acctbal), 2) AS best FROM f LEFT JOIN supplier ON s_suppkey = source_id GROUP BY 1, 2""")
def fact_sources(spark, sf_dir):
    """Facts with the sources that they name, and how many are not there."""
    k = F.col("l_suppkey")
    f = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array_compact(F.array(k, k + 7))).alias("s_suppkey"))
    j = f.join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.lit(1).alias("there")), "s_suppkey", "left")
    return j.groupBy("l_orderkey", "l_linenumber").agg(F.count("there").alias("n_found"), F.count_if(F.col("there").isNull()).alias("n_missing"), F.round(F.max("s_acctbal"), 2).alias("best"))


@query("""WITH l AS (SELECT * FROM events e WHERE NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND (n.ts > e.ts OR (n.ts = e.ts AND n.event_id > e.event_id)))), p AS (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY 1)
SELECT c_custkey, event_id AS coverage_id, list_contains(types, 'purchase') AND event_type <> 'error' AS complete FROM customer LEFT JOIN l ON l.user_id = c_custkey LEFT JOIN p ON p.user_id = c_custkey""")
def job_completion(spark, sf_dir):
    """The latest coverage row of each job, and whether it proves completion."""
    e = read(spark, sf_dir, "events")
    last = selection.newest(e.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    types = e.groupBy("user_id").agg(F.array_contains(F.collect_set("event_type"), "purchase").alias("has"))
    j = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(last, "user_id", "left").join(types, "user_id", "left")
    return j.select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("coverage_id"), (F.col("has") & (F.col("event_type") != "error")).alias("complete"))


_YTD = """q AS (SELECT o_custkey AS k, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v, max(CASE WHEN o_orderstatus = 'P' THEN 'USD' ELSE 'CNY' END) AS unit FROM orders GROUP BY 1, 2),
y AS (SELECT k, period_end, unit, CAST(sum(v) OVER (PARTITION BY k, year(period_end) ORDER BY period_end) AS DOUBLE) AS value FROM q)"""


def _ytd(spark, sf_dir):
    q = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), when.quarter_end(F.to_date("o_orderdate")).alias("period_end")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.max(F.when(F.col("o_orderstatus") == "P", "USD").otherwise("CNY")).alias("unit"))
    return q.select("k", "period_end", "unit", F.sum("v").over(Window.partitionBy("k", F.year("period_end")).orderBy("period_end")).cast("double").alias("value"), F.col("v").cast("double").alias("direct"))


@query(f"""WITH {_YTD} SELECT a.k AS o_custkey, a.period_end, CASE WHEN quarter(a.period_end) = 1 THEN NULL WHEN b.value IS NULL THEN 'missing_quarter_before' WHEN a.unit <> b.unit THEN 'unit_mismatch' END AS failure,
  round(CASE WHEN quarter(a.period_end) = 1 THEN a.value WHEN a.unit = b.unit THEN a.value - b.value END, 2) AS value FROM y a LEFT JOIN y b ON a.k = b.k AND year(a.period_end) = year(b.period_end) AND quarter(a.period_end) = quarter(b.period_end) + 1""")
def adjacent_quarters(spark, sf_dir):
    """Single quarters by a join with the quarter before."""
    out = selection.single_quarters_by_join(_ytd(spark, sf_dir).select("k", "period_end", "unit", "value"), ["k"])
    return out.select(F.col("k").alias("o_custkey"), "period_end", "failure", F.round("value", 2).alias("value"))


@query(f"""WITH {_YTD}, d AS (SELECT q.k, q.period_end, CAST(v AS DOUBLE) + CASE WHEN CAST(v AS BIGINT) % 10 = 3 THEN 100 ELSE 0 END AS direct FROM q),
j AS (SELECT a.k, a.period_end, d.direct, a.value - coalesce(b.value, 0) AS derived, quarter(a.period_end) = 1 OR b.value IS NOT NULL AS usable FROM y a JOIN d ON a.k = d.k AND a.period_end = d.period_end LEFT JOIN y b ON a.k = b.k AND year(a.period_end) = year(b.period_end) AND quarter(a.period_end) = quarter(b.period_end) + 1)
SELECT k AS o_custkey, period_end, CASE WHEN usable AND abs(direct - derived) > greatest(abs(direct) * 0.000001e0, 0.01e0) THEN 'inconsistent' ELSE 'direct' END AS state, round(CASE WHEN NOT (usable AND abs(direct - derived) > greatest(abs(direct) * 0.000001e0, 0.01e0)) THEN direct END, 2) AS value FROM j""")
def consistent_quarters(spark, sf_dir):
    """Direct quarters against those derived from year-to-date values; inconsistent ones go as a whole."""
    y = _ytd(spark, sf_dir)
    derived = selection.single_quarters_by_join(y.select("k", "period_end", F.lit("CNY").alias("unit"), "value"), ["k"]).select("k", "period_end", F.col("value").alias("derived"))
    direct = F.col("direct") + F.when(F.col("direct").cast("decimal(18,0)").cast("long") % 10 == 3, 100).otherwise(0)
    j = y.select("k", "period_end", direct.alias("direct")).join(derived, ["k", "period_end"])
    off = F.coalesce(F.abs(F.col("direct") - F.col("derived")) > F.greatest(F.abs("direct") * 0.000001, F.lit(0.01)), F.lit(False))
    return j.select(F.col("k").alias("o_custkey"), "period_end", F.when(off, "inconsistent").otherwise("direct").alias("state"), F.round(F.when(~off, F.col("direct")), 2).alias("value"))


@query("""WITH q AS (SELECT event_id AS query_id, user_id AS k, ts AS state_at, ts + INTERVAL 12 HOUR AS known_at FROM events WHERE event_type = 'error'), a AS (SELECT user_id AS k, event_id AS anchor_id, ts AS reference_at, ts + to_hours(CAST(event_id % 48 AS INT)) AS available_at, value, event_id % 5 <> 0 AS complete FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT query_id, arg_max(anchor_id, (reference_at, available_at, anchor_id)) AS anchor_id, round(arg_max(value, (reference_at, available_at, anchor_id)), 4) AS value FROM q LEFT JOIN a ON a.k = q.k AND complete AND reference_at <= state_at AND available_at <= known_at GROUP BY 1""")
def anchor_as_of(spark, sf_dir):
    """The latest complete anchor on two time axes: effective by the state's instant, known by the other."""
    e, day = read(spark, sf_dir, "events"), lambda n: F.expr(f"make_dt_interval(0, {n})")
    q = e.where("event_type = 'error'").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("k"), F.col("ts").alias("state_at"), (F.col("ts") + day("12")).alias("known_at"))
    a = e.where("event_type in ('purchase', 'signup')").select(F.col("user_id").alias("k"), F.col("event_id").alias("anchor_id"), F.col("ts").alias("reference_at"), (F.col("ts") + day("int(event_id % 48)")).alias("available_at"), "value", (F.col("event_id") % 5 != 0).alias("complete"))
    return selection.anchor_as_of(q, a, ["k"], "value").select("query_id", "anchor_id", F.round("value", 4).alias("value"))


@query("""WITH i AS (SELECT event_id AS interval_id, user_id, ts AS valid_from, CASE WHEN event_id % 4 <> 0 THEN ts + to_hours(CAST(event_id % 72 AS INT)) END AS valid_to FROM events WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT event_id, interval_id FROM p JOIN i ON p.user_id = i.user_id AND valid_from <= ts AND (valid_to IS NULL OR ts < valid_to)""")
def validity_join(spark, sf_dir):
    """Points in the half-open intervals of their key."""
    e = read(spark, sf_dir, "events")
    to = F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.expr("make_dt_interval(0, int(event_id % 72))"))
    i = e.where("event_type = 'signup'").select(F.col("event_id").alias("interval_id"), "user_id", F.col("ts").alias("valid_from"), to.alias("valid_to"))
    return selection.interval_matches(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), i, ["user_id"], "ts").select("event_id", "interval_id")


@query("""WITH p AS (SELECT count(*) AS n_jobs, max(o_orderkey) AS last_key FROM orders), c AS (SELECT count(DISTINCT l_orderkey) AS n_jobs, max(l_orderkey) AS last_key FROM lineitem) SELECT p.n_jobs AS planned, c.n_jobs AS covered, p.last_key = c.last_key AS same_run, p.n_jobs = c.n_jobs AS all_covered FROM p, c""")
def plan_coverage_link(spark, sf_dir):
    """One plan row against one coverage row, with the identities that must agree."""
    p = read(spark, sf_dir, "orders").agg(F.count("*").alias("planned"), F.max("o_orderkey").alias("a"))
    c = read(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey").alias("covered"), F.max("l_orderkey").alias("b"))
    return p.crossJoin(c).select("planned", "covered", (F.col("a") == F.col("b")).alias("same_run"), (F.col("planned") == F.col("covered")).alias("all_covered"))  # one row each


@query("""WITH r AS (SELECT event_id, user_id, event_id * 3 AS order_id, CASE WHEN event_id % 2 = 0 THEN 'k' ELSE 'z' END AS path, props FROM events)
SELECT event_id, CASE WHEN o_orderkey IS NULL THEN 'missing_page' WHEN c_custkey IS NULL THEN 'missing_job' WHEN n_nationkey IS NULL THEN 'missing_snapshot' ELSE 'located' END AS locator, CASE WHEN n_nationkey IS NOT NULL THEN json_extract_string(props, '$.' || path) END AS field
FROM r LEFT JOIN orders ON o_orderkey = order_id LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def located_evidence(spark, sf_dir):
    """Record to page to job to snapshot and its field by path; what is missing is named."""
    r = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 3).alias("o_orderkey"), F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).otherwise(F.get_json_object("props", "$.z")).alias("field"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("page"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.lit(1).alias("job"))
    j = r.join(o, "o_orderkey", "left").join(c, "c_custkey", "left").join(read(spark, sf_dir, "nation").select("n_nationkey", F.lit(1).alias("snapshot")), "n_nationkey", "left")
    missing = rules.first_reason(*[(f"missing_{x}", F.col(x).isNull()) for x in ("page", "job", "snapshot")])
    return j.select("event_id", F.coalesce(missing, F.lit("located")).alias("locator"), F.when(missing.isNull(), F.col("field")).alias("field"))


@query("""WITH v AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS old, user_id, event_type, ts, props FROM events WHERE ts <= TIMESTAMP '2024-01-15'), h AS (SELECT * FROM v WHERE id NOT IN (SELECT old FROM v WHERE old IS NOT NULL)), g AS (SELECT user_id, event_type, count(DISTINCT props) AS n, max(id) AS id, count(*) AS heads FROM h GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN n = 1 THEN id END AS selected_id, n > 1 AS conflict, heads FROM g""")
def selected_records(spark, sf_dir):
    """Heads of the versions known at a cutoff; a key whose heads differ is a conflict and selects none."""
    e = F.col("event_id")
    v = read(spark, sf_dir, "events").select(e.alias("id"), F.when(e % 3 == 0, e - 1).alias("old"), "user_id", "event_type", "ts", "props")
    h = selection.visible_heads(v, "id", "old", F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz"))
    g = h.groupBy("user_id", "event_type").agg((F.min("props") != F.max("props")).alias("conflict"), F.max("id").alias("id"), F.count("*").alias("heads"))
    return g.select("user_id", "event_type", F.when(~F.col("conflict"), F.col("id")).alias("selected_id"), "conflict", "heads")


@query("SELECT p_brand, p_type, p_partkey AS snapshot_id, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey DESC) AS r FROM part) WHERE r = 1")
def latest_by_canonical_key(spark, sf_dir):
    """The latest snapshot of each canonical key, by date and then by ingest sequence."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", F.col("p_partkey").alias("snapshot_id"), "p_name")
    return selection.newest(p, ["p_brand", "p_type"], ["p_size", "snapshot_id"]).drop("p_size")


@query("SELECT event_id - event_id % 7 AS root_id, arg_max(event_id, (ts, value, event_id)) AS event_id, arg_max(event_type, (ts, value, event_id)) AS state FROM events GROUP BY 1")
def current_events(spark, sf_dir):
    """The current event of each root: available, updated, id."""
    e = read(spark, sf_dir, "events").select((F.col("event_id") - F.col("event_id") % 7).alias("root_id"), "ts", "value", "event_id", F.col("event_type").alias("state"))
    return selection.newest(e, ["root_id"], ["ts", "value", "event_id"]).select("root_id", "event_id", "state")


@query("""WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey - 1 END AS old, o_custkey, year(o_orderdate) AS fiscal_year, o_orderstatus FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30'), h AS (SELECT * FROM v WHERE id NOT IN (SELECT old FROM v WHERE old IS NOT NULL))
SELECT id, o_custkey, fiscal_year, o_orderstatus, count(*) OVER (PARTITION BY o_custkey, fiscal_year) > 1 AS natural_key_conflict FROM h""")
def annual_projection(spark, sf_dir):
    """Record heads by fiscal year, with conflicts of their natural key."""
    k = F.col("o_orderkey")
    v = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 1, k - 1).alias("old"), "o_custkey", F.year("o_orderdate").alias("fiscal_year"), "o_orderstatus", "o_orderdate")
    h = selection.visible_heads(v, "id", "old", F.col("o_orderdate") <= cutoff())
    return h.select("id", "o_custkey", "fiscal_year", "o_orderstatus", (F.count("*").over(Window.partitionBy("o_custkey", "fiscal_year")) > 1).alias("natural_key_conflict"))


@query("""WITH v AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 2 THEN event_id - 1 END AS old, user_id AS candidate, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'withdrawn' ELSE 'approved' END AS decision, ts FROM events WHERE ts <= TIMESTAMP '2024-01-18'), h AS (SELECT * FROM v WHERE id NOT IN (SELECT old FROM v WHERE old IS NOT NULL)), l AS (SELECT candidate, arg_max(decision, (ts, id)) AS decision, max((ts, id))[2] AS id FROM h GROUP BY 1)
SELECT candidate, id AS decision_id FROM l WHERE decision = 'approved'""".replace("max((ts, id))[2]", "arg_max(id, (ts, id))"))
def approved_links(spark, sf_dir):
    """The head of each candidate's decisions, where it is an approval."""
    e = F.col("event_id")
    decision = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "view", "withdrawn").otherwise("approved")
    v = read(spark, sf_dir, "events").select(e.alias("id"), F.when(e % 5 == 2, e - 1).alias("old"), F.col("user_id").alias("candidate"), decision.alias("decision"), "ts")
    h = selection.visible_heads(v, "id", "old", F.col("ts") <= F.lit("2024-01-18").cast("timestamp_ntz"))
    return selection.newest(h.drop("old"), ["candidate"], ["ts", "id"]).where("decision = 'approved'").select("candidate", F.col("id").alias("decision_id"))


@query("""SELECT o_custkey, o_orderkey AS tenure_id, o_orderstatus AS role, CASE WHEN o_orderpriority = '1-URGENT' THEN 'candidate' ELSE 'confirmed' END AS standing FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' AND (o_orderstatus = 'O' OR TIMESTAMP '1998-06-30' < o_orderdate + INTERVAL 200 DAY)""")
def current_roles(spark, sf_dir):
    """Tenures active at an instant; confirmed only with complete coverage."""
    o = read(spark, sf_dir, "orders")
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("interval 200 days"))
    live = o.where((F.col("o_orderdate") <= cutoff()) & (end.isNull() | (cutoff() < end)))
    return live.select("o_custkey", F.col("o_orderkey").alias("tenure_id"), F.col("o_orderstatus").alias("role"), F.when(F.col("o_orderpriority") == "1-URGENT", "candidate").otherwise("confirmed").alias("standing"))


@query("""WITH b AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS VARCHAR) AS v FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey, CAST(l_shipdate AS DATE), CAST(l_quantity AS VARCHAR) FROM lineitem WHERE l_linenumber = 2)
SELECT k AS l_partkey, d AS day, CASE WHEN min(v) = max(v) THEN CAST(min(v) AS DOUBLE) END AS value, min(v) <> max(v) AS conflict FROM b GROUP BY 1, 2""")
def merged_series(spark, sf_dir):
    """Lists of immutable items by key; equal payloads are one item, different ones a conflict."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("value"), "l_linenumber")
    return selection.merged_items([li.where("l_linenumber = 1"), li.where("l_linenumber = 2")], ["l_partkey", "day"], "value")


@query("""WITH l AS (SELECT l_partkey AS part, l_orderkey * 10 + l_linenumber AS fact_id, l_extendedprice / l_quantity AS value, CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber < 4 THEN 3 ELSE 4 END AS authority, l_suppkey AS upstream, l_shipdate AS available_at, CASE WHEN l_linenumber % 5 = 0 THEN 'USD' ELSE 'CNY' END AS unit, l_returnflag = 'R' AS critical, l_linestatus AS scope FROM lineitem),
b AS (SELECT *, first_value(fact_id) OVER w AS best, first_value(value) OVER w AS bv, first_value(upstream) OVER w AS bu, first_value(authority) OVER w AS ba, first_value(unit) OVER w AS bn, first_value(scope) OVER w AS bs FROM l WINDOW w AS (PARTITION BY part ORDER BY authority, available_at DESC, fact_id))
SELECT part, fact_id, best AS best_fact_id, CASE WHEN unit <> bn OR scope <> bs THEN 'not_comparable' WHEN abs(value - bv) / greatest(abs(value), abs(bv), 1) > 0.02e0 THEN 'pending' WHEN critical AND authority > 2 AND ba > 2 THEN 'needs_official' WHEN upstream <> bu THEN 'dual' ELSE 'single' END AS status FROM b WHERE fact_id <> best""")
def verified_pairs(spark, sf_dir):
    """K2 K3: pairs that can be compared, agree within the tolerance, and have an official side where it is critical."""
    n, c = F.col("l_linenumber"), F.col
    li = read(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("part"), (c("l_orderkey") * 10 + n).alias("fact_id"), (c("l_extendedprice") / c("l_quantity")).alias("value"), F.when(n == 1, 1).when(n < 4, 3).otherwise(4).alias("authority"), c("l_suppkey").alias("upstream"),
        c("l_shipdate").alias("available_at"), F.when(n % 5 == 0, "USD").otherwise("CNY").alias("unit"), (c("l_returnflag") == "R").alias("critical"), c("l_linestatus").alias("scope"),
    )
    return selection.verified_pairs(li, ["part"], ["unit", "scope"], 0.02).drop("difference")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 10 > 0 THEN p_partkey - 1 END AS p FROM part), r(n, d) AS (SELECT n, 0 FROM e WHERE p IS NULL UNION ALL SELECT e.n, d + 1 FROM r JOIN e ON e.p = r.n) SELECT n AS p_partkey, d AS depth, row_number() OVER (ORDER BY d, n) AS position FROM r""")
def ordered_plans(spark, sf_dir):
    """T5: plans in the order of what they depend on."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey")
    d = selection.depths(p.where(k % 10 > 0).withColumn("p", k - 1), "p_partkey", "p")
    all_ = p.join(d.withColumnRenamed("node", "p_partkey"), "p_partkey", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    counts = all_.groupBy("depth").agg(F.count("*").alias("n"))
    before = counts.select("depth", (F.sum("n").over(Window.orderBy("depth")) - F.col("n")).alias("before"))  # one row a depth
    return all_.join(F.broadcast(before), "depth").select("p_partkey", "depth", (F.col("before") + F.row_number().over(Window.partitionBy("depth").orderBy("p_partkey"))).alias("position"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'P' THEN 2 WHEN o_totalprice > 200000 THEN 3 ELSE 4 END, o_orderdate, o_orderkey)) AS target, min(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'P' THEN 2 WHEN o_totalprice > 200000 THEN 3 ELSE 4 END) AS tier FROM orders GROUP BY 1""")
def reconcile_target(spark, sf_dir):
    """T4: the earliest target by tier, date and id."""
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderstatus") == "P", 2).when(F.col("o_totalprice") > 200000, 3).otherwise(4)
    best = F.min(F.struct(tier.alias("tier"), F.col("o_orderdate"), F.col("o_orderkey").alias("target")))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.target", "b.tier")


@query("""WITH a AS (SELECT p_partkey AS k, unnest(['price', 'size', 'brand']) AS path, unnest([CAST(p_retailprice AS VARCHAR), CAST(p_size AS VARCHAR), p_brand]) AS v FROM part), b AS (SELECT p_partkey AS k, unnest(['price', 'size', 'brand']) AS path, unnest([CAST(p_retailprice * CASE WHEN p_partkey % 3 = 0 THEN 1.01e0 ELSE 1.0000001e0 END AS VARCHAR), CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS VARCHAR) END, CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE p_brand END]) AS v FROM part)
SELECT a.k AS p_partkey, a.path, CASE WHEN b.v IS NULL THEN 'missing' ELSE 'different' END AS difference FROM a JOIN b ON a.k = b.k AND a.path = b.path WHERE b.v IS NULL OR (TRY_CAST(a.v AS DOUBLE) IS NULL AND a.v <> b.v) OR abs(TRY_CAST(a.v AS DOUBLE) - TRY_CAST(b.v AS DOUBLE)) > greatest(0.000001e0 * abs(TRY_CAST(a.v AS DOUBLE)), 0.000000001e0)""")
def tree_comparison(spark, sf_dir):
    """JSON trees flattened to paths and compared, numbers within a relative and an absolute tolerance."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    p = read(spark, sf_dir, "part")
    tree = lambda a, b, c: F.to_json(F.struct(a.alias("price"), b.alias("size"), c.alias("brand")))
    both = p.select("p_partkey", tree(price, F.col("p_size"), F.col("p_brand")).alias("a"), tree(price * F.when(k % 3 == 0, 1.01).otherwise(1.0000001), F.when(k % 5 > 0, F.col("p_size")), F.when(k % 7 == 0, "other").otherwise(F.col("p_brand"))).alias("b"))
    flat = both.select("p_partkey", F.explode(F.from_json("a", "map<string,string>")).alias("path", "x"), F.from_json("b", "map<string,string>").alias("b")).withColumn("y", F.try_element_at("b", F.col("path")))
    x, y = F.expr("try_cast(x as double)"), F.expr("try_cast(y as double)")
    off = F.when(F.col("y").isNull(), "missing").when(x.isNull() & (F.col("x") != F.col("y")), "different").when(F.abs(x - y) > F.greatest(F.abs(x) * 0.000001, F.lit(0.000000001)), "different")
    return flat.select("p_partkey", "path", off.alias("difference")).where("difference is not null")


@query("""WITH f AS (SELECT l_orderkey AS k, l_returnflag AS src, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS id, l_linestatus AS rk, CAST(l_shipdate AS DATE) AS av, CAST(floor(l_quantity / 30) AS BIGINT) AS value, CASE WHEN l_tax < 0.075 THEN 'CNY' ELSE 'USD' END AS unit, l_discount < 0.045 AS corrects FROM lineitem),
  x AS (SELECT *, CASE WHEN corrects THEN id - 1 END AS sup FROM f), l AS (SELECT p.*, c.rk AS by_rk, c.av AS by_av, c.id IS NULL AS leaf FROM x p LEFT JOIN x c ON c.k = p.k AND c.src = p.src AND c.sup = p.id),
  s AS (SELECT k, src, bool_or(coalesce(by_rk <> rk, false)) AS another, bool_or(coalesce(av >= by_av, false)) AS disorder, count(*) FILTER (leaf) AS n, count(DISTINCT (value, unit)) FILTER (leaf) AS said, arg_max((value, unit, id), (av, id)) FILTER (leaf) AS best FROM l GROUP BY 1, 2),
  o AS (SELECT k, CASE WHEN bool_or(another) THEN 'revision_of_another_row' WHEN bool_or(disorder) THEN 'revision_out_of_order' WHEN min(n) = 0 THEN 'no_leaf' WHEN max(said) > 1 THEN 'conflict_within_source' WHEN count(DISTINCT (best[1], best[2])) > 1 THEN 'conflict_across_sources' ELSE 'selected' END AS outcome, arg_min(best, (src <> 'R', best[3])) AS b, count(*) AS n_sources FROM s GROUP BY 1)
SELECT k AS l_orderkey, outcome, CASE WHEN outcome = 'selected' THEN b[3] END AS fact_id, CASE WHEN outcome = 'selected' THEN b[1] END AS value, CASE WHEN outcome = 'selected' THEN b[2] END AS unit, n_sources FROM o""")
def materialized_facts(spark, sf_dir):
    """Versions within a source, agreement of its leaves, agreement of sources, then the preferred one; or the reason."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    f = read(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 100 + F.row_number().over(w))
    f = f.select(
        "l_orderkey", F.col("l_returnflag").alias("source"), F.col("id").alias("fact_id"), F.col("id").alias("record_id"), F.col("l_linestatus").alias("row_key"), F.when(F.col("l_discount") < 0.045, F.col("id") - 1).alias("supersedes"),
        F.col("l_shipdate").cast("date").alias("available_at"), F.floor(F.col("l_quantity") / 30).cast("long").alias("value"), F.when(F.col("l_tax") < 0.075, "CNY").otherwise("USD").alias("unit"),
    )
    return materialize.materialized(f, ["l_orderkey"], ["source"], F.col("source") == "R")


@query("""SELECT o_custkey, arg_min(o_orderkey, (pr, n, -d, o_orderkey)) AS fact_id, round(arg_min(v, (pr, n, -d, o_orderkey)), 2) AS value, arg_min(o_orderstatus, (pr, n, -d, o_orderkey)) AS unit, count(*) AS n_candidates, count(DISTINCT (v, o_orderstatus)) AS n_values
FROM (SELECT *, CAST(o_orderpriority[1] AS INT) AS pr, CASE o_orderstatus WHEN 'P' THEN 2 ELSE 0 END AS n, epoch_us(o_orderdate) AS d, floor(o_totalprice / 100000) AS v FROM orders) GROUP BY 1""")
def chosen_candidates(spark, sf_dir):
    """The first of a key's candidates by priority, parents, newest, id, and how many values there were."""
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("fact_id"), F.floor(F.col("o_totalprice") / 100000).cast("double").alias("value"), F.col("o_orderstatus").alias("unit"), F.substring("o_orderpriority", 1, 1).cast("int").alias("pr"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("n"), day.alias("d"))
    return materialize.chosen(o, ["o_custkey"], [F.col("pr"), F.col("n"), -F.col("d"), F.col("fact_id")])
