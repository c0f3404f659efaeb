"""Registered queries of intake: attempts, windows, calendars, titles, names and identities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.functions import intake, rules
from pitlake.plans.queries import query
from pitlake.sources.tables import read

_STATUS = "CASE event_id % 12 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 402 WHEN 3 THEN 403 WHEN 4 THEN 408 WHEN 5 THEN 503 WHEN 6 THEN 404 ELSE 200 END"
_MARK = "CASE event_id % 35 WHEN 7 THEN 'paywall' WHEN 8 THEN 'login' WHEN 9 THEN 'challenge' ELSE '' END"


@query(f"""WITH a AS (SELECT event_id, {_STATUS} AS st, {_MARK} AS mark, event_id % 17 = 8 AS denied, event_id % 5 <> 0 AS mime, event_id % 7 <> 0 AS sch, event_id % 19 = 0 AS done, CASE WHEN event_id % 23 = 0 THEN 'robots' END AS pol FROM events),
r AS (SELECT *, CASE WHEN pol IS NOT NULL THEN pol WHEN st = 429 THEN 'upstream_rate_limited' WHEN st >= 400 THEN 'http_' || st WHEN denied THEN 'upstream_bot_challenge' WHEN mark = 'paywall' THEN 'paywall_detected' WHEN mark = 'login' THEN 'login_page_detected' WHEN mark = 'challenge' THEN 'challenge_page_detected' WHEN NOT mime THEN 'unexpected_mime' WHEN NOT sch THEN 'schema_validation_failed' ELSE 'protocol_success' END AS reason FROM a)
SELECT event_id, reason, CASE WHEN reason = 'protocol_success' THEN 'success' WHEN done THEN 'partial' WHEN pol IS NOT NULL THEN 'policy_skipped' WHEN st = 429 THEN 'rate_limited' WHEN st = 401 OR reason = 'login_page_detected' THEN 'login_required' WHEN st = 402 OR reason = 'paywall_detected' THEN 'paywalled'
  WHEN st = 403 OR reason IN ('upstream_bot_challenge', 'challenge_page_detected') THEN 'restricted' WHEN st = 408 THEN 'timeout' WHEN st >= 400 THEN 'network_failed' ELSE 'parse_failed' END AS outcome, pol IS NULL AND st IN (429, 408, 503) AS retryable FROM r""")
def attempt_outcomes(spark, sf_dir):
    """What each response was, first match wins."""
    e = read(spark, sf_dir, "events").selectExpr("event_id", f"{_STATUS} AS st", f"{_MARK} AS mark", "CASE WHEN event_id % 23 = 0 THEN 'robots' END AS pol")
    k = F.col("event_id")
    out = intake.attempt_outcome(F.col("st"), F.col("pol"), k % 17 == 8, F.col("mark"), k % 5 != 0, k % 7 != 0, k % 19 == 0)
    return e.select("event_id", out.alias("o")).select("event_id", "o.reason", "o.outcome", "o.retryable")


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) - CASE WHEN o_orderkey % 31 = 0 THEN 9 ELSE 0 END AS n, o_orderkey % 7 <> 0 AS sch, o_orderkey % 11 <> 0 AS proven, o_orderkey % 3 <> 0 AS terminal, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 5 AS INT) END AS declared, o_orderkey % 41 = 0 AS same FROM orders)
SELECT o_orderkey, CASE WHEN same THEN 'valid_discovery_anchor' WHEN NOT sch THEN 'schema_validation_failed' WHEN NOT (proven AND terminal AND (declared IS NULL OR declared = n)) THEN 'discovery_terminal_proof_missing' WHEN n < 0 THEN 'negative_discovery_count' WHEN n = 0 AND coalesce(declared, -1) <> 0 THEN 'discovery_terminal_proof_missing' WHEN n = 0 THEN 'validated_empty_result' ELSE 'validated_nonempty_result' END AS reason FROM d""")
def discovery_outcomes(spark, sf_dir):
    """Whether a discovery is complete, and whether it proves that there is nothing."""
    k = F.col("o_orderkey")
    n = (k % 5).cast("int") - F.when(k % 31 == 0, 9).otherwise(0)
    out = intake.discovery_outcome(n, k % 7 != 0, k % 11 != 0, k % 3 != 0, F.when(k % 2 == 0, (k % 5).cast("int")), n, k % 41 == 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", out.alias("reason"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN dayofweek(l_shipdate) IN (0, 6) THEN 'non_trading_day' WHEN l_linenumber % 4 = 0 THEN 'suspended' WHEN l_quantity < 5 THEN 'source_empty' ELSE 'traded' END AS state, CASE WHEN l_quantity >= 5 THEN l_extendedprice END AS close,
  CASE WHEN l_orderkey % 9 > 0 THEN greatest(l_shipdate + to_days(CAST(l_linenumber AS INT)), l_shipdate + INTERVAL 3 DAY) END AS available_at FROM lineitem""")
def market_rows(spark, sf_dir):
    """States of market rows, and when an outcome after an event may be used."""
    li, at, n = read(spark, sf_dir, "lineitem"), F.col("l_shipdate"), F.col("l_linenumber")
    close = F.when(F.col("l_quantity") >= 5, F.col("l_extendedprice").cast("string")).otherwise("  ")
    state = intake.market_state(~F.dayofweek(at).isin(1, 7), F.when(n % 4 == 0, " 0").otherwise("1"), close)
    horizon = F.when(F.col("l_orderkey") % 9 > 0, at + F.expr("make_dt_interval(l_linenumber)")).otherwise(at - F.expr("interval 1 day"))
    return li.select("l_orderkey", "l_linenumber", state.alias("state"), F.expr("CASE WHEN l_quantity >= 5 THEN l_extendedprice END").alias("close"), intake.post_event_available(at, horizon, at + F.expr("interval 3 days")).alias("available_at"))


@query("""WITH s AS (SELECT user_id, CASE WHEN user_id % 6 > 0 THEN max(CAST(ts AS DATE)) END AS safe FROM events GROUP BY 1), w AS (SELECT *, CAST(safe - INTERVAL 10 DAY AS DATE) AS start FROM s)
SELECT user_id, CASE WHEN safe IS NULL THEN 'no_watermark' WHEN DATE '2024-01-20' <= start THEN 'as_of_before_overlap' END AS refused, CASE WHEN DATE '2024-01-20' > start THEN start END AS start_, CASE WHEN user_id % 4 = 0 THEN coalesce(safe, DATE '2024-01-20') ELSE least(coalesce(safe, DATE '2023-12-21'), DATE '2023-12-21') END AS event_start, (SELECT CASE WHEN count(safe) = count(*) THEN min(safe) END FROM s) AS global_bound, (SELECT min(safe) FROM s) AS known_bound FROM w""")
def incremental_windows(spark, sf_dir):
    """Windows from watermarks, and the bound that is safe for all partitions (none if one is missing)."""
    s = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("safe")).withColumn("safe", F.when(F.col("user_id") % 6 > 0, F.col("safe")))
    at = F.lit("2024-01-20").cast("date")
    bound = s.agg(F.when(F.count("safe") == F.count("*"), F.min("safe")).alias("global_bound"), F.min("safe").alias("known_bound"))  # one row
    w, ev = intake.incremental_window(F.col("safe"), 10, at), intake.event_window(F.col("safe"), F.col("user_id") % 4 == 0, at)
    return s.select("user_id", w.alias("w"), ev.alias("e")).crossJoin(F.broadcast(bound)).select("user_id", "w.refused", F.col("w.start").alias("start_"), F.col("e.start").alias("event_start"), "global_bound", "known_bound")


@query("""WITH b AS (SELECT event_id, user_id, ts, event_type FROM events), o AS (SELECT user_id, max(ts) AS done FROM b WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id AS barrier_id, b.user_id, done IS NULL OR done <= ts AS open_ FROM b LEFT JOIN o USING (user_id) WHERE event_type = 'error'""")
def barriers(spark, sf_dir):
    """Barriers that failed attempts open, and whether a later success resolved them."""
    e = read(spark, sf_dir, "events")
    done = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("done"))
    return e.where("event_type = 'error'").join(done, "user_id", "left").select(F.col("event_id").alias("barrier_id"), "user_id", (F.col("done").isNull() | (F.col("done") <= F.col("ts"))).alias("open_"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders), x AS (SELECT as_of, year(as_of) - CASE WHEN as_of >= make_date(year(as_of), 4, 30) THEN 1 ELSE 2 END AS top, CASE WHEN as_of >= make_date(year(as_of), 10, 31) THEN make_date(year(as_of), 9, 30) WHEN as_of >= make_date(year(as_of), 8, 31) THEN make_date(year(as_of), 6, 30) WHEN as_of >= make_date(year(as_of), 4, 30) THEN make_date(year(as_of), 3, 31) ELSE make_date(year(as_of) - 1, 9, 30) END AS latest FROM d),
a AS (SELECT as_of, 'annual' AS kind, make_date(top - i, 12, 31) AS period_end FROM x, range(3) r(i)), q AS (SELECT as_of, 'quarter' AS kind, last_day(CAST(latest - to_months(CAST(3 * i AS INT)) AS DATE)) AS period_end FROM x, range(4) r(i)),
n AS (SELECT DISTINCT as_of, 'dependency' AS kind, CAST(period_end - INTERVAL 1 YEAR AS DATE) AS period_end FROM (SELECT * FROM a UNION ALL SELECT * FROM q UNION ALL SELECT as_of, 'x', make_date(top - 2, 12, 31) FROM x)) SELECT * FROM a UNION ALL SELECT * FROM q UNION ALL SELECT * FROM n""")
def disclosure_windows(spark, sf_dir):
    """What must have been reported by a date: years, quarters, and the periods they are compared with."""
    d = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct().select("as_of", intake.report_windows(F.col("as_of"), 3, 4).alias("w"))
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("period_end"))
    rows = F.concat(*[F.transform(F.col(f"w.{c}"), named(k)) for c, k in (("annual", "annual"), ("quarters", "quarter"), ("dependencies", "dependency"))])
    return d.select("as_of", F.explode(rows).alias("r")).select("as_of", "r.*")


@query("""WITH p AS (SELECT o_orderkey, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS e, CASE o_orderkey % 5 WHEN 0 THEN 'cumulative' WHEN 1 THEN 'single_quarter' WHEN 2 THEN 'ttm' WHEN 3 THEN 'annual' ELSE 'instant' END AS kind, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, kind, CASE WHEN kind IN ('cumulative', 'annual') THEN make_date(year(e), 1, 1) WHEN kind = 'single_quarter' THEN make_date(year(e), month(e) - 2, 1) WHEN kind = 'ttm' THEN CAST(CAST(e - INTERVAL 1 YEAR AS DATE) + 1 AS DATE) END AS period_start, year(e) * 4 + quarter(e) - 1 AS quarter_index, d = e AS is_quarter_end, CASE WHEN o_orderkey % 3 > 0 THEN e END AS agreed_end, last_day(CAST(e - INTERVAL 6 MONTH AS DATE)) AS two_before FROM p""")
def period_arithmetic(spark, sf_dir):
    """Quarter index, starts by kind, ends that field and row agree on, shifts by quarters."""
    from pitlake.functions import periods as when

    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    kind = F.element_at(F.array(*map(F.lit, ("cumulative", "single_quarter", "ttm", "annual", "instant"))), (k % 5 + 1).cast("int"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", when.quarter_end(d).alias("e"), kind.alias("kind"), d.alias("d"))
    agreed = F.when(F.when(k % 3 > 0, F.col("e")).otherwise(F.date_add("e", 1)) == F.col("e"), F.col("e"))
    return o.select("o_orderkey", "kind", intake.period_start(F.col("e"), F.col("kind")).alias("period_start"), when.quarter_index(F.col("e")).alias("quarter_index"), (F.col("d") == F.when(when.is_quarter_end(F.col("d")), F.col("d"))).eqNullSafe(True).alias("is_quarter_end"), agreed.alias("agreed_end"), F.last_day(F.add_months("e", -6)).alias("two_before"))


@query("""WITH q AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS raw, ts FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'date' WHEN 3 THEN 'naive_rejected' ELSE 'instant' END AS precision, CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) + INTERVAL 16 HOUR WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 8 HOUR END AS bound FROM q""")
def query_instants(spark, sf_dir):
    """Dates end at the local day's end, instants need a zone, naive ones are rejected."""
    k = F.col("event_id") % 4
    f = lambda p: F.date_format("ts", p)
    raw = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))).otherwise(f("yyyy-MM-dd'T'HH:mm:ss"))
    e = read(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    precision = F.when(F.col("raw").rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(F.col("raw").rlike(r"(Z|[+-]\d{2}:\d{2})$"), "instant").otherwise("naive_rejected")
    day = F.to_utc_timestamp(F.date_add(F.to_date(F.when(precision == "date", F.col("raw"))), 1), "Asia/Shanghai").cast("timestamp_ntz")
    return e.select("event_id", precision.alias("precision"), F.when(precision == "date", day).when(precision == "instant", F.expr("try_cast(raw as timestamp)").cast("timestamp_ntz")).alias("bound"))


_TITLE = "concat(CASE WHEN p_partkey % 13 = 0 THEN '公司' ELSE concat('公司 ', CAST(2010 + p_partkey % 12 AS STRING), ' 年') END, CASE p_partkey % 7 WHEN 0 THEN '第一季度报告' WHEN 1 THEN '半年度报告' WHEN 2 THEN '第三季度 报告' WHEN 3 THEN '年度报告' WHEN 4 THEN '年度报告摘要' WHEN 5 THEN '年报（修订）' ELSE '公告' END)"


@query(f"""WITH t AS (SELECT p_partkey, {_TITLE.replace("STRING", "VARCHAR")} AS title, 2010 + p_partkey % 12 AS y FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CASE p_partkey % 7 WHEN 0 THEN 'q1' WHEN 1 THEN 'h1' WHEN 2 THEN 'q3' WHEN 3 THEN 'annual' WHEN 5 THEN 'annual' END END AS kind, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CASE p_partkey % 7 WHEN 0 THEN make_date(y, 3, 31) WHEN 1 THEN make_date(y, 6, 30) WHEN 2 THEN make_date(y, 9, 30) WHEN 3 THEN make_date(y, 12, 31) WHEN 5 THEN make_date(y, 12, 31) END END AS period_end FROM t""")
def filing_periods(spark, sf_dir):
    """Kind and end of the period that a report's title names."""
    t = read(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLE).alias("title"))
    return t.select("p_partkey", intake.filing_period(F.col("title")).alias("f")).select("p_partkey", "f.kind", "f.period_end")


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE p_partkey % 4 WHEN 0 THEN 10000 WHEN 1 THEN 100000000 WHEN 2 THEN 1 END AS amount, CASE WHEN p_partkey % 5 > 0 THEN round(p_size / 100.0::DOUBLE, 6) END AS ratio, CASE WHEN p_partkey % 3 > 0 THEN make_date(2020, 1 + p_partkey % 12, 1 + p_partkey % 28) END AS day, CASE WHEN p_partkey % 4 < 3 THEN 4 END AS starts_at FROM part""")
def text_fields(spark, sf_dir):
    """Amounts, ratios and dates out of running text, and where the amount stands."""
    k = F.col("p_partkey")
    unit = F.element_at(F.array(*map(F.lit, ("万元", "亿股", "元", "个"))), (k % 4 + 1).cast("int"))
    date = F.when(k % 3 > 0, F.concat(F.lit("2020年 "), (1 + k % 12).cast("string"), F.lit("月"), (1 + k % 28).cast("string"), F.lit("日"))).otherwise("某日")
    ratio = F.when(k % 5 > 0, F.concat(F.col("p_size").cast("string"), F.lit(" %"))).otherwise("若干")
    t = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("合计 "), F.col("p_size").cast("string"), F.lit(" "), unit, F.lit("，占比 "), ratio, F.lit("，于 "), date).alias("t"))
    at = F.regexp_instr("t", F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?\s*(亿元|万元|元|亿股|万股|股)"))
    return t.select("p_partkey", intake.text_amount(F.col("t")).alias("amount"), F.round(intake.text_ratio(F.col("t")), 6).alias("ratio"), intake.text_date(F.col("t")).alias("day"), F.when(at > 0, at).alias("starts_at"))


_QUERY = "CASE c_custkey % 6 WHEN 0 THEN lpad(CAST(c_custkey AS {s}), 6, '0') WHEN 1 THEN concat(' sh', lpad(CAST(c_custkey AS {s}), 6, '0')) WHEN 2 THEN concat(lpad(CAST(c_custkey AS {s}), 6, '0'), '.sz') WHEN 3 THEN concat(lpad(CAST(c_custkey AS {s}), 6, '0'), '-XSHG') WHEN 4 THEN c_name ELSE '12345' END"


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS code, CASE c_custkey % 6 WHEN 1 THEN 'SH' WHEN 2 THEN 'SZ' WHEN 3 THEN 'SH' END AS market,
  CASE WHEN c_custkey % 5 = 0 THEN 'source_code' WHEN c_custkey % 5 = 1 THEN 'anonymous' WHEN c_custkey % 5 = 2 THEN 'anonymous' ELSE 'name_only' END AS party, CASE WHEN c_custkey % 5 = 0 THEN 'source-code:' || c_nationkey END AS party_key FROM customer""")
def identities(spark, sf_dir):
    """Securities and counterparties that a text names."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", intake.security_query(F.expr(_QUERY.format(s="STRING"))).alias("q"), intake.counterparty(F.when(k % 5 == 0, F.col("c_nationkey").cast("string")).otherwise(" "), F.when(k % 5 == 1, "未披露").when(k % 5 != 2, F.col("c_name"))).alias("p"))
    return c.select("c_custkey", "q.code", "q.market", F.col("p.kind").alias("party"), F.col("p.key").alias("party_key"))


@query("""WITH a AS (SELECT lower(c_mktsegment) AS name, c_nationkey AS company, 'SH' AS market, c_custkey % 3 > 0 AS listed FROM customer WHERE c_acctbal > 9000), q AS (SELECT s_suppkey, lower(CASE s_suppkey % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'Machinery' WHEN 2 THEN 'nothing' ELSE 'AUTOMOBILE' END) AS name FROM supplier),
m AS (SELECT s_suppkey, count(DISTINCT company) AS n, count(DISTINCT company) FILTER (WHERE listed) AS n_listed, min(company) FILTER (WHERE listed) AS company FROM q LEFT JOIN a USING (name) GROUP BY 1)
SELECT s_suppkey, CASE WHEN n = 0 THEN 'prerequisite' WHEN n_listed = 0 THEN 'unsupported' WHEN n_listed > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN n_listed = 1 THEN company END AS company FROM m""")
def company_resolution(spark, sf_dir):
    """Names to companies: resolved, ambiguous, unsupported, or unknown."""
    a = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.lower("c_mktsegment").alias("name"), F.col("c_nationkey").alias("company"), (F.col("c_custkey") % 3 > 0).alias("listed")).distinct()
    k = F.col("s_suppkey") % 4
    q = read(spark, sf_dir, "supplier").select("s_suppkey", F.lower(F.when(k == 0, "BUILDING").when(k == 1, "Machinery").when(k == 2, "nothing").otherwise("AUTOMOBILE")).alias("name"))
    names = a.groupBy("name").agg(F.countDistinct("company").alias("n"), F.countDistinct(F.when(F.col("listed"), F.col("company"))).alias("n_listed"), F.min(F.when(F.col("listed"), F.col("company"))).alias("company"))
    j = q.join(names, "name", "left")
    return j.select("s_suppkey", F.when(F.col("n").isNull(), "prerequisite").when(F.col("n_listed") == 0, "unsupported").when(F.col("n_listed") > 1, "ambiguous").otherwise("resolved").alias("status"), F.when(F.col("n_listed") == 1, F.col("company")).alias("company"))


@query("""WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(CASE o_orderpriority WHEN '1-URGENT' THEN 'original_readable' WHEN '2-HIGH' THEN 'alternative' WHEN '3-MEDIUM' THEN 'processing' WHEN '5-LOW' THEN 'missing' ELSE 'unavailable' END))) AS st FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN st IS NULL THEN 'unavailable' WHEN len(st) = 1 THEN st[1] WHEN list_contains(st, 'original_readable') THEN 'original_readable' WHEN list_contains(st, 'alternative') THEN 'alternative' WHEN list_contains(st, 'processing') THEN 'processing' ELSE 'unavailable' END AS status FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def material_status(spark, sf_dir):
    """One status of a company's materials."""
    p = F.col("o_orderpriority")
    state = F.when(p == "1-URGENT", "original_readable").when(p == "2-HIGH", "alternative").when(p == "3-MEDIUM", "processing").when(p == "5-LOW", "missing").otherwise("unavailable")
    s = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(state).alias("st"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(s, "c_custkey", "left").select("c_custkey", intake.combined_status(F.coalesce("st", F.array().cast("array<string>"))).alias("status"))


@query("""SELECT l_suppkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_linenumber > 6) THEN 'incomplete' WHEN bool_and(l_quantity < 3) THEN 'source_returned_empty' ELSE 'query_completed' END AS coverage, count(*) AS receipts FROM lineitem GROUP BY 1""")
def acquisition_coverage(spark, sf_dir):
    """Coverage of a dataset by its receipts."""
    bad, empty = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 6), F.col("l_quantity") < 3
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.when(F.bool_or(bad), "incomplete").when(F.every(empty), "source_returned_empty").otherwise("query_completed").alias("coverage"), F.count("*").alias("receipts"))


@query("""SELECT page_id, sha256(concat_ws('|', page_id, strftime(TIMESTAMP '2024-01-01 18:00:00' + to_hours(CAST(page_id AS INT)) + INTERVAL 8 HOUR, '%Y-%m-%d'), substr(sha256(lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')))), 1, 20)))[1:20] AS canonical_key, lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'))) AS title FROM pages""")
def announcement_keys(spark, sf_dir):
    """Normalised titles and the canonical key of an announcement: id, local date, hash of the title."""
    title = F.lower(F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " ")))
    at = F.lit("2024-01-01 18:00:00").cast("timestamp") + F.expr("make_dt_interval(0, int(page_id))")
    p = read(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.date_format(F.from_utc_timestamp(at, "Asia/Shanghai"), "yyyy-MM-dd").alias("day"))
    key = F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), "day", F.substring(F.sha2("title", 256), 1, 20)), 256)
    return p.select("page_id", F.substring(key, 1, 20).alias("canonical_key"), "title")


@query("""WITH p AS (SELECT conv_id, turn, contains(lower(text), 'the') AND contains(lower(text), 'and') OR regexp_matches(text, '^Er') AS hit FROM conversations WHERE text IS NOT NULL) SELECT DISTINCT a.conv_id, a.turn FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.hit AND abs(a.turn - b.turn) <= 1""")
def page_routing(spark, sf_dir):
    """Pages of a topic by section pattern or all of its terms, and their neighbours."""
    t = F.lower("text")
    p = read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", ((t.contains("the") & t.contains("and")) | F.col("text").rlike("^Er")).alias("hit")).dropDuplicates(["conv_id", "turn", "hit"])
    near = p.where("hit").select("conv_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn")).distinct()
    return p.select("conv_id", "turn").distinct().join(near, ["conv_id", "turn"], "left_semi")


@query("""SELECT p_partkey, list_extract(list_filter(['code:' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey END, 'plan:' || CASE WHEN p_partkey % 5 = 0 THEN p_size END, 'period:' || CASE WHEN p_partkey % 2 = 0 THEN '2020' END], lambda x: x IS NOT NULL), 1) AS identity, CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN contains(p_name, 'ring') THEN 'active' WHEN contains(p_name, 'widget') THEN 'planned' ELSE 'unknown' END AS phase FROM part""")
def event_identities(spark, sf_dir):
    """The identity of an event from its first known key, and its phase from the supplier's words."""
    k = F.col("p_partkey")
    terms = [("code", F.when(k % 3 == 0, k)), ("plan", F.when(k % 5 == 0, F.col("p_size"))), ("period", F.when(k % 2 == 0, F.lit("2020")))]
    identity = F.coalesce(*[F.concat(F.lit(f"{n}:"), v.cast("string")) for n, v in terms])
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", identity.alias("identity"), F.when(F.col("p_type") == "PROMO", "promo").when(name.contains("ring"), "active").when(name.contains("widget"), "planned").otherwise("unknown").alias("phase"))


@query("""WITH l AS (SELECT *, lag(event_type) OVER w AS prev, lag(event_id) OVER w AS previous_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t(a, b) AS (VALUES ('view', 'click'), ('click', 'signup'), ('click', 'view'), ('signup', 'purchase'), ('view', 'error'))
SELECT event_id, previous_id, prev IS NULL OR prev = event_type OR t.a IS NOT NULL AS allowed, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS root_id FROM l LEFT JOIN t ON t.a = prev AND t.b = event_type""")
def lifecycle_transitions(spark, sf_dir):
    """Updates linked to the event before, their root, and whether the taxonomy allows the transition."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    taxonomy = spark.createDataFrame([("view", "click"), ("click", "signup"), ("click", "view"), ("signup", "purchase"), ("view", "error")], "prev string, event_type string").withColumn("ok", F.lit(True))
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.lag("event_type").over(w).alias("prev"), F.lag("event_id").over(w).alias("previous_id"), F.first("event_id").over(w).alias("root_id"))
    j = e.join(F.broadcast(taxonomy), ["prev", "event_type"], "left")  # the taxonomy: a few dozen rows
    return j.select("event_id", "previous_id", (F.col("prev").isNull() | (F.col("prev") == F.col("event_type")) | F.coalesce("ok", F.lit(False))).alias("allowed"), "root_id")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'not_visible' END, CASE WHEN ts > TIMESTAMP '2024-01-25' THEN 'not_effective' END, CASE WHEN ts <= TIMESTAMP '2024-01-05' THEN 'before_anchor' END, CASE WHEN value < 5 THEN 'not_eligible' END], lambda x: x IS NOT NULL), ',') AS excluded,
  CASE WHEN event_type <> 'error' AND ts <= TIMESTAMP '2024-01-25' AND ts > TIMESTAMP '2024-01-05' AND NOT coalesce(value < 5, false) THEN row_number() OVER (PARTITION BY user_id, event_type <> 'error' AND ts <= TIMESTAMP '2024-01-25' AND ts > TIMESTAMP '2024-01-05' AND NOT coalesce(value < 5, false) ORDER BY ts, event_id) END AS sequence FROM events""")
def delta_selection(spark, sf_dir):
    """Deltas after an anchor in their order, and every reason against the others."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    why = rules.reasons(("not_visible", F.col("event_type") == "error"), ("not_effective", F.col("ts") > at("2024-01-25")), ("before_anchor", F.col("ts") <= at("2024-01-05")), ("not_eligible", F.col("value") < 5))
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", why.alias("why")).withColumn("in", F.size("why") == 0)
    n = F.row_number().over(Window.partitionBy("user_id", "in").orderBy("ts", "event_id"))
    return e.select("event_id", F.array_join("why", ",").alias("excluded"), F.when(F.col("in"), n).alias("sequence"))


@query("""WITH f AS (SELECT user_id AS job, list_sort(list_distinct(list(event_type))) AS reasons, count(*) FILTER (WHERE event_type = 'error') > 8 AS failed FROM events GROUP BY 1) SELECT job, failed AND len(list_intersect(reasons, ['purchase', 'signup'])) > 0 AND job % 3 <> 0 AS repair FROM f""")
def repair_plan(spark, sf_dir):
    """Failed jobs of the wanted datasets whose reasons meet the wanted ones."""
    f = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.collect_set("event_type").alias("reasons"), (F.count_if(F.col("event_type") == "error") > 8).alias("failed"))
    return f.select("job", (F.col("failed") & F.arrays_overlap("reasons", F.array(F.lit("purchase"), F.lit("signup"))) & (F.col("job") % 3 != 0)).alias("repair"))


@query("""SELECT c_custkey, n_name AS dataset, CASE WHEN n_nationkey % 5 = 0 THEN 'unselected' WHEN c_nationkey <> n_nationkey AND n_nationkey % 3 = 0 THEN 'not_applicable' WHEN c_acctbal < 0 THEN 'unsupported' WHEN n_nationkey % 7 = 1 THEN 'inactive_on_demand' ELSE 'planned' END AS disposition FROM customer, nation WHERE c_mktsegment = 'BUILDING'""")
def plan_expansion(spark, sf_dir):
    """Every selected company with every dataset, and what becomes of each."""
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # the list of datasets: a small configuration
    c = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").crossJoin(n)
    k = F.col("n_nationkey")
    what = rules.first_reason(("unselected", k % 5 == 0), ("not_applicable", (F.col("c_nationkey") != k) & (k % 3 == 0)), ("unsupported", F.col("c_acctbal") < 0), ("inactive_on_demand", k % 7 == 1), ("planned", F.lit(True)))
    return c.select("c_custkey", F.col("n_name").alias("dataset"), what.alias("disposition"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), t AS (SELECT day, dayofweek(day) BETWEEN 1 AND 5 AS is_open FROM d), w AS (SELECT day, is_open, max(CASE WHEN is_open THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_open FROM t), c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_quantity > 49)
SELECT w.day, last_open AS due_day, CASE WHEN NOT is_open THEN 'closed' WHEN last_open IS NULL THEN 'no_trading_day' WHEN c.day IS NOT NULL THEN 'completed' ELSE 'due' END AS decision FROM w LEFT JOIN c ON c.day = w.last_open""")
def due_work(spark, sf_dir):
    """What is due on each day of a trading calendar, and what is done already."""
    d = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("is_open", F.dayofweek("day").between(2, 6))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a calendar: one row a day
    w = d.withColumn("due_day", F.max(F.when(F.col("is_open"), F.col("day"))).over(before))
    c = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.to_date("l_shipdate").alias("due_day")).distinct().withColumn("done", F.lit(True))
    j = w.join(c, "due_day", "left")
    return j.select("day", "due_day", rules.first_reason(("closed", ~F.col("is_open")), ("no_trading_day", F.col("due_day").isNull()), ("completed", F.col("done")), ("due", F.lit(True))).alias("decision"))


@query("""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)(token|secret|password|api[_-]?key)\\s*[=:]\\s*[^\\s&"]+', '\\1=[redacted]', 'g'), '/(?:home|Users)/[^\\s"]+', '[path]', 'g'), '(https?://[^\\s?"]+)\\?[^\\s"]*', '\\1?[query]', 'g') AS t
FROM (SELECT event_id, 'at /home/u' || user_id || '/x token=' || event_id || ' see https://h.example/' || event_type || '?id=' || event_id || ' ' || props AS t FROM events)""")
def redacted_text(spark, sf_dir):
    """P25: text without secrets, paths and the queries of addresses."""
    t = F.concat(F.lit("at /home/u"), F.col("user_id").cast("string"), F.lit("/x token="), F.col("event_id").cast("string"), F.lit(" see https://h.example/"), F.col("event_type"), F.lit("?id="), F.col("event_id").cast("string"), F.lit(" "), F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", intake.redacted(t).alias("t"))


@query("""WITH h AS (SELECT user_id, sha256(string_agg(event_id || ':' || event_type, ',' ORDER BY event_id)) AS digest FROM events GROUP BY 1) SELECT user_id, digest, 'ds-' || substr(sha256('run|' || digest), 1, 20) AS snapshot_id FROM h""")
def run_digests(spark, sf_dir):
    """H3 H4: a digest over the sorted rows of a group, and the snapshot id made of it."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    h = read(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("r")).select("user_id", F.sha2(F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["event_id"].cast("string"), x["event_type"])), ","), 256).alias("digest"))
    return h.select("user_id", "digest", F.concat(F.lit("ds-"), F.substring(F.sha2(F.concat(F.lit("run|"), F.col("digest")), 256), 1, 20)).alias("snapshot_id"))


@query("""WITH x AS (SELECT p_partkey, unnest(['brand', 'type', 'size']) AS name, unnest([p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE '' END, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END]) AS value, unnest([1, 2, 3]) AS i FROM part)
SELECT p_partkey, string_agg(name || '=' || value, ';' ORDER BY i) AS dimensions, string_agg(name, ',' ORDER BY i) AS date_roles FROM x WHERE value <> '' GROUP BY 1""")
def record_dimensions(spark, sf_dir):
    """The named values of a record in their order, blanks dropped."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("brand", F.col("p_brand")), ("type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise("")), ("size", F.when(F.col("p_size") > 10, F.col("p_size").cast("string"))))])
    p = read(spark, sf_dir, "part").select("p_partkey", F.filter(pairs, lambda x: x["value"] != "").alias("d"))
    return p.select("p_partkey", F.array_join(F.transform("d", lambda x: F.concat_ws("=", x["name"], x["value"])), ";").alias("dimensions"), F.array_join("d.name", ",").alias("date_roles"))


@query("""WITH p AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'E100' WHEN 1 THEN 'NODATA' ELSE 'OK' END AS code, CASE WHEN o_orderkey % 5 > 0 THEN n END AS total, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN code = 'NODATA' AND n = 0 THEN 'empty' WHEN code <> 'OK' THEN 'failure' WHEN total IS NULL THEN 'total_missing' WHEN total <> n THEN 'total_mismatch' ELSE 'ok' END AS status, n FROM p""")
def parsed_pages(spark, sf_dir):
    """A page by its business code, and its rows against the total that it must declare."""
    k = F.col("o_orderkey")
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("rows"))
    p = read(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("rows", F.lit(0).cast("long")))
    code = F.when(k % 9 == 0, "E100").when(k % 9 == 1, "NODATA").otherwise("OK")
    total = F.when(k % 5 > 0, F.col("rows"))
    status = rules.first_reason(("empty", (code == "NODATA") & (F.col("n") == 0)), ("failure", code != "OK"), ("total_missing", total.isNull()), ("total_mismatch", total != F.col("n")), ("ok", F.lit(True)))
    return p.select("o_orderkey", status.alias("status"), "n")


@query("""WITH r AS (SELECT o_custkey AS run, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total, bool_and(o_orderstatus <> 'P') AS finalized, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1) SELECT run, n, total, digest FROM r WHERE finalized""")
def retained_inventory(spark, sf_dir):
    """What finalised runs retain: rows, total and a digest over their ids."""
    o = read(spark, sf_dir, "orders")
    r = o.groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.every(F.col("o_orderstatus") != "P").alias("finalized"), F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return r.where("finalized").select("run", "n", "total", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("digest"))
