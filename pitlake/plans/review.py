"""Registered queries of admission, reading and governance, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.functions import reading, review, rules
from pitlake.operators import analytics, evidence, selection
from pitlake.plans.queries import query
from pitlake.sources.tables import read

#: A field of each line item and its rule, in SQL for both.
_FIELD = {
    "known": "l_linenumber <> 7", "rejection": "CASE WHEN l_suppkey % 5 = 0 THEN 'rejected_by_contract' END", "definition_version": "CASE WHEN l_partkey % 29 = 0 THEN 'v0' ELSE 'v1' END", "registry_version": "'v1'",
    "standard_field": "CASE WHEN l_partkey % 31 = 0 THEN 'other' ELSE 'price' END", "dataset": "'items'", "job_dataset": "CASE WHEN l_suppkey % 3 = 0 THEN 'dividend' ELSE 'items' END", "row_key": "CASE WHEN l_partkey % 37 <> 0 THEN l_orderkey END",
    "path": "CASE WHEN l_partkey % 41 = 0 THEN '$.x' ELSE '$.price' END", "raw_name": "'price'", "row_value": "l_extendedprice", "value": "CASE WHEN l_partkey % 43 = 0 THEN 0e0 ELSE l_extendedprice END", "unit": "CASE WHEN l_partkey % 47 = 0 THEN 'USD' WHEN l_partkey % 53 = 0 THEN NULL ELSE 'CNY' END",
    "quality": "CASE WHEN l_returnflag = 'A' THEN 'partial' ELSE 'passed' END", "nature": "CASE l_suppkey % 4 WHEN 0 THEN 'forecast' WHEN 1 THEN 'announced_plan' ELSE 'observed' END",
}
_RULE = {"standard_field": "CASE WHEN l_linenumber <> 6 THEN 'price' END", "unit": "'CNY'", "nature": "CASE l_suppkey % 4 WHEN 0 THEN 'forecast' WHEN 1 THEN 'announced_plan' ELSE 'observed' END"}


@query("WITH f AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, " + ", ".join(f"{e} AS {n}" for n, e in _FIELD.items()) + ", " + ", ".join(f"{e} AS rule_{n}" for n, e in _RULE.items()) + " FROM lineitem)" + """,
g AS (SELECT *, CASE WHEN rule_standard_field IS NULL THEN CASE WHEN nature IN ('forecast', 'provider_estimate', 'platform_label', 'source_text') THEN 'nature_not_actual_fact' WHEN NOT known THEN 'unknown_field' ELSE coalesce(rejection, 'standard_mapping_missing') END WHEN definition_version <> registry_version THEN 'definition_version_missing_or_mismatched'
  WHEN NOT known OR standard_field <> rule_standard_field OR dataset <> job_dataset THEN 'field_mapping_or_identity_mismatch' WHEN row_key IS NULL OR path <> '$.' || raw_name THEN 'field_locator_missing_or_mismatched' WHEN row_value IS DISTINCT FROM value THEN 'original_value_mismatch' WHEN unit IS NULL OR unit <> rule_unit THEN 'unit_missing_or_conflicting'
  WHEN quality <> 'passed' OR nature <> rule_nature THEN 'quality_or_nature_not_admissible' WHEN rule_nature NOT IN ('observed', 'deterministic', 'announced_plan') THEN 'nature_not_actual_fact' WHEN rule_nature = 'announced_plan' AND job_dataset <> 'dividend' THEN 'event_definition_missing' END AS failure FROM f)
SELECT l_orderkey, l_linenumber, coalesce(failure, CASE WHEN l_quantity = 13 THEN 'value_missing_or_non_numeric' WHEN l_shipdate > TIMESTAMP '2001-06-30' THEN 'not_available_at_cutoff' WHEN month(l_shipdate) = 2 THEN 'non_calendar_quarter' END) AS gap FROM g""")
def field_admission(spark, sf_dir):
    """The first reason against a field, by name and in order, then the gates on its value and period."""
    f = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", *[f"{e} AS {n}" for n, e in _FIELD.items()], *[f"{e} AS rule_{n}" for n, e in _RULE.items()])
    failure = review.field_failure({n: F.col(n) for n in _FIELD}, {n: F.col(f"rule_{n}") for n in _RULE})
    gates = rules.first_reason(("value_missing_or_non_numeric", F.col("l_quantity") == 13), ("not_available_at_cutoff", F.col("l_shipdate") > F.lit("2001-06-30").cast("timestamp_ntz")), ("non_calendar_quarter", F.month("l_shipdate") == 2))
    return f.select("l_orderkey", "l_linenumber", F.coalesce(failure, gates).alias("gap"))


_WORDS = ("召开股东大会的通知", "2020年年度报告摘要", "2020年半年度报告", "关于经营情况的公告", "董事会第三次会议决议", "关于股份回购的公告", "更正公告", "法律意见书")


@query("""WITH t AS (SELECT p_partkey, p_partkey % 8 AS i, CASE p_partkey % 3 WHEN 0 THEN 'periodic_report' WHEN 1 THEN 'other_announcement' ELSE 'prospectus' END AS tt, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'periodic_report' WHEN 2 THEN 'other_announcement' ELSE 'prospectus' END AS bt FROM part)
SELECT p_partkey, CASE i WHEN 2 THEN 'statements' WHEN 3 THEN 'business' WHEN 4 THEN 'governance' WHEN 5 THEN 'capital' END AS category, CASE WHEN i IN (0, 7) THEN 'procedural_or_duplicate_language' WHEN i = 1 THEN 'summary_duplicates_full_filing' WHEN i = 6 THEN 'no_default_use_identified' ELSE 'research_relevant_filing' END AS reason,
  CASE WHEN bt IS NOT NULL AND bt <> tt AND tt = 'other_announcement' THEN bt ELSE tt END AS material_type, CASE WHEN bt IS NULL THEN 'title_only' WHEN tt = bt THEN CASE WHEN tt = 'other_announcement' THEN 'unclassified' ELSE 'title_body_agree' END WHEN tt = 'other_announcement' THEN 'content_heading' ELSE 'requires_review' END AS status FROM t""")
def filing_uses(spark, sf_dir):
    """What a filing is for, and its type from title and heading."""
    k = F.col("p_partkey")
    title = F.element_at(F.array(*map(F.lit, _WORDS)), (k % 8 + 1).cast("int"))
    tt = F.element_at(F.array(*map(F.lit, ("periodic_report", "other_announcement", "prospectus"))), (k % 3 + 1).cast("int"))
    bt = F.element_at(F.array(F.lit(None), *map(F.lit, ("periodic_report", "other_announcement", "prospectus"))), F.col("p_size") % 4 + 1)
    t = read(spark, sf_dir, "part").select("p_partkey", review.filing_use(title).alias("u"), review.material_type(tt, bt).alias("m"))
    return t.select("p_partkey", "u.category", "u.reason", F.col("m.type").alias("material_type"), "m.status")


@query("""SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'LOW') THEN 'excluded' WHEN o_orderkey % 10 = 0 THEN 'summary' WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'missing_subject' WHEN o_orderdate > TIMESTAMP '2000-01-01' THEN 'after_cutoff' WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'baseline' WHEN o_totalprice > 300000 THEN 'triggered' ELSE 'no_trigger' END AS decision FROM orders""")
def document_selection(spark, sf_dir):
    """Exclusions, summaries, missing subjects, cutoff, the window of full reports, then triggers."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    out = rules.first_reason(
        ("excluded", F.col("o_orderpriority").contains("LOW")), ("summary", k % 10 == 0), ("missing_subject", (F.col("o_orderstatus") == "P") & (k % 3 == 0)), ("after_cutoff", d > at("2000-01-01")), ("baseline", d >= at("1997-01-01")),
        ("triggered", F.col("o_totalprice") > 300000), ("no_trigger", F.lit(True)),
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", out.alias("decision"))


@query("""WITH e AS (SELECT user_id, event_type, event_type <> 'error' AND event_id % 3 > 0 AS valid, CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'same' END AS value, event_id % 7 = 0 AS parsed, event_type = 'signup' AS absent, event_id % 2 = 0 AS bounded FROM events), g AS (SELECT user_id, event_type, count(*) FILTER (WHERE valid) AS n, count(DISTINCT value) FILTER (WHERE valid) AS v, bool_or(parsed) AS parsed, bool_or(absent) AS absent, bool_and(bounded) AS bounded FROM e GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN n = 0 AND parsed THEN 'parsed_but_requirement_unanswered' WHEN n = 0 THEN 'reading_material_or_answer_missing' WHEN v <> 1 THEN 'conflicting_located_answers' WHEN absent AND NOT bounded THEN 'negative_fact_period_unbounded' END AS reason, n AS n_valid FROM g""")
def reading_requirements(spark, sf_dir):
    """K6: a requirement is ready with located answers that agree; a bounded absence is one."""
    k = F.col("event_id")
    valid, value = (F.col("event_type") != "error") & (k % 3 > 0), F.when(k % 11 == 0, "other").otherwise("same")
    g = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count_if(valid).alias("n"), F.countDistinct(F.when(valid, value)).alias("v"), F.bool_or(k % 7 == 0).alias("parsed"), F.every(k % 2 == 0).alias("bounded")
    )
    reason = review.answer_state(F.col("n"), F.col("v"), F.col("parsed"), F.col("event_type") == "signup", F.col("bounded"))
    return g.select("user_id", "event_type", reason.alias("reason"), F.col("n").alias("n_valid"))


@query("""WITH s AS (SELECT l_suppkey AS company, l_returnflag AS profile, year(l_shipdate) AS yr, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, q / sum(q) OVER (PARTITION BY company, yr) AS share FROM s), p AS (SELECT company, profile FROM r GROUP BY 1, 2 HAVING count(*) FILTER (WHERE share > 0.5e0) >= 2),
c AS (SELECT company, profile, true AS stable FROM p UNION SELECT s_suppkey, 'N', false FROM supplier WHERE s_suppkey % 3 = 0), g AS (SELECT s_suppkey AS company, count(DISTINCT profile) AS n, count(*) FILTER (WHERE stable) AS n_stable, string_agg(DISTINCT profile, ',' ORDER BY profile) AS profiles FROM supplier LEFT JOIN c ON company = s_suppkey GROUP BY 1)
SELECT company AS s_suppkey, CASE WHEN n = 0 THEN 'pending' WHEN n > 1 AND n_stable <= 1 THEN 'conflict' WHEN n > 1 THEN 'mixed' ELSE 'resolved' END AS status, CASE WHEN n > 0 AND NOT (n > 1 AND n_stable <= 1) THEN profiles END AS profiles FROM g""")
def industry_profiles(spark, sf_dir):
    """K8: profiles that hold most of the revenue in two periods or more, against the declared one."""
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("profile"), F.year("l_shipdate").alias("yr")).agg(F.sum("l_quantity").alias("q"))
    share = F.col("q") / F.sum("q").over(Window.partitionBy("s_suppkey", "yr"))
    stable = s.withColumn("share", share).groupBy("s_suppkey", "profile").agg(F.count_if(F.col("share") > 0.5).alias("n")).where("n >= 2").select("s_suppkey", "profile", F.lit(True).alias("stable"))
    all_ = read(spark, sf_dir, "supplier").select("s_suppkey")
    declared = all_.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("N").alias("profile"), F.lit(False).alias("stable"))
    c = all_.join(stable.union(declared), "s_suppkey", "left").groupBy("s_suppkey").agg(F.countDistinct("profile").alias("n"), F.count_if("stable").alias("m"), F.array_join(F.sort_array(F.collect_set("profile")), ",").alias("profiles"))
    status = F.when(F.col("n") == 0, "pending").when((F.col("n") > 1) & (F.col("m") <= 1), "conflict").when(F.col("n") > 1, "mixed").otherwise("resolved")
    return c.select("s_suppkey", status.alias("status"), F.when(status.isin("mixed", "resolved"), F.col("profiles")).alias("profiles"))


_CONTROL = "CASE WHEN p_partkey % 100 = 99 THEN p_partkey - 99 ELSE p_partkey + 1 END"


@query(f"""WITH r AS (SELECT p_partkey AS id, p_partkey AS a, {_CONTROL} AS b, CASE WHEN p_partkey % 9 = 0 THEN 'indirect' ELSE 'direct' END AS dir, CASE WHEN p_size % 2 = 0 AND p_partkey % 100 = 99 THEN true ELSE false END AS off FROM part UNION ALL SELECT p_partkey + 1000000, p_partkey, {_CONTROL}, 'direct', false FROM part WHERE p_partkey % 50 = 1), v AS (SELECT * FROM r WHERE NOT off),
d AS (SELECT a, b, dir, min(id) AS id FROM v GROUP BY 1, 2, 3 HAVING count(*) > 1), u AS (SELECT id FROM v WHERE dir = 'indirect' AND NOT EXISTS (SELECT 1 FROM v w WHERE w.dir = 'direct' AND w.a = v.a AND w.b = v.b)), c AS (SELECT DISTINCT a - a % 100 AS ring FROM v WHERE a % 100 = 99)
SELECT id AS record_id, 'duplicate' AS fault FROM d UNION ALL SELECT id, 'unproven_segment' FROM u UNION ALL SELECT ring, 'cycle' FROM c WHERE (SELECT count(DISTINCT a) FROM v WHERE v.a - v.a % 100 = ring) = 100""")
def control_graph(spark, sf_dir):
    """Faults of a control graph: duplicates, indirect chains without direct segments, cycles (by the smallest
    node on each)."""
    k, to = F.col("p_partkey"), F.expr(_CONTROL)
    p = read(spark, sf_dir, "part")
    r = p.where("not (p_size % 2 = 0 and p_partkey % 100 = 99)").select(k.alias("id"), k.alias("a"), to.alias("b"), F.when(k % 9 == 0, "indirect").otherwise("direct").alias("dir"))
    r = r.union(p.where("p_partkey % 50 = 1").select(k + 1000000, k, to, F.lit("direct")))
    twice = r.groupBy("a", "b", "dir").agg(F.min("id").alias("record_id"), F.count("*").alias("n")).where("n > 1").select("record_id", F.lit("duplicate").alias("fault"))
    direct = r.where("dir = 'direct'").select("a", "b").distinct()
    unproven = r.where("dir = 'indirect'").join(direct, ["a", "b"], "left_anti").select(F.col("id").alias("record_id"), F.lit("unproven_segment").alias("fault"))
    return twice.union(unproven).union(evidence.cycles(r.select("a", "b").distinct(), "a", "b").select(F.col("node").alias("record_id"), F.lit("cycle").alias("fault")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'valid_to precedes valid_from' WHEN o_orderkey % 11 = 0 THEN 'period_end precedes period_start' WHEN o_orderkey % 13 = 0 THEN 'responded_at precedes issued_at' END AS disorder FROM orders""")
def period_order(spark, sf_dir):
    """The first pair of start and end in disorder; open ends are in order."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    late = d + F.expr("interval 5 days")
    ends = {"valid_to": F.when(k % 7 == 0, d - F.expr("interval 1 day")).when(k % 2 == 0, late), "period_end": F.when(k % 11 == 0, d - F.expr("interval 1 day")).otherwise(late), "responded_at": F.when(k % 13 == 0, d - F.expr("interval 1 day"))}
    none = F.lit(None).cast("timestamp_ntz")
    return read(spark, sf_dir, "orders").select("o_orderkey", review.period_disorder([(a, d, b, ends.get(b, none)) for a, b in review.PERIOD_PAIRS]).alias("disorder"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity = 50 THEN 'value_typed' END, CASE WHEN l_linenumber = 7 THEN 'required_fields' END, CASE WHEN l_tax = 0 THEN 'unit' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1 THEN 'currency' END, CASE WHEN o_orderdate > l_shipdate - INTERVAL 2 DAY THEN 'time_order' END, CASE WHEN n > 6 THEN 'key_unique' END) AS failed
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, l_linenumber, failed, failed = '' AS passed FROM c""")
def claim_assessment(spark, sf_dir):
    """The checks of a claim that fail, in order; it passes without any."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    li = read(spark, sf_dir, "lineitem").withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).join(o, "l_orderkey")
    failed = rules.reasons(
        ("value_typed", F.col("l_quantity") == 50), ("required_fields", F.col("l_linenumber") == 7), ("unit", F.col("l_tax") == 0), ("currency", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)),
        ("time_order", F.col("o_orderdate") > F.col("l_shipdate") - F.expr("interval 2 days")), ("key_unique", F.col("n") > 6),
    )
    return li.select("l_orderkey", "l_linenumber", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passed"))


@query("""WITH c AS (SELECT list_sort(list_distinct(list(c_nationkey))) AS have FROM customer), e AS (SELECT list_sort(list_distinct(list(n_nationkey))) AS want FROM nation), m AS (SELECT count(*) FILTER (WHERE sha256(p_name) IS NULL) AS bad, count(DISTINCT p_brand) AS brands FROM part)
SELECT 'coverage_equals_expectation' AS check_name, have = want AS passed FROM c, e UNION ALL SELECT 'hashes_present', bad = 0 FROM m UNION ALL SELECT 'enough_samples', brands >= 20 FROM m UNION ALL SELECT 'passed', have = want AND bad = 0 AND brands >= 20 FROM c, e, m""")
def release_gate(spark, sf_dir):
    """Checks of a release and whether all pass; sets must be equal both ways."""
    c = read(spark, sf_dir, "customer").agg(F.collect_set("c_nationkey").alias("have"))
    e = read(spark, sf_dir, "nation").agg(F.collect_set("n_nationkey").alias("want"))  # nations: a small dimension
    m = read(spark, sf_dir, "part").agg(F.count_if(F.sha2("p_name", 256).isNull()).alias("bad"), F.countDistinct("p_brand").alias("brands"))
    one = c.crossJoin(e).crossJoin(m)  # one row each
    equal = (F.size(F.array_except("have", "want")) == 0) & (F.size(F.array_except("want", "have")) == 0)
    checks = {"coverage_equals_expectation": equal, "hashes_present": F.col("bad") == 0, "enough_samples": F.col("brands") >= 20}
    checks["passed"] = checks["coverage_equals_expectation"] & checks["hashes_present"] & checks["enough_samples"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), x.alias("passed")) for n, x in checks.items()])).alias("c")).select("c.*")


@query("""WITH r AS (SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000), n AS (SELECT count(*) AS n FROM r) SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 20 AND (s_suppkey IN (SELECT id FROM r) OR (SELECT n FROM n) = 0)""")
def pruned_sources(spark, sf_dir):
    """Sources in scope that something refers to; all of them when nothing refers to any."""
    s = read(spark, sf_dir, "supplier").where("s_nationkey < 20")
    refs = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")).union(read(spark, sf_dir, "supplier").where("s_acctbal > 9000").select("s_suppkey"))
    return evidence.referenced(s, refs, "s_suppkey").select("s_suppkey", "s_name")


@query("""WITH v AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_type = 'ECONOMY') SELECT p_partkey, CAST((r - 1) // 20 AS BIGINT) AS page, CAST((r - 1) % 20 AS BIGINT) AS position FROM v""")
def topic_pages(spark, sf_dir):
    """A topic's rows in pages of twenty: the position in the whole order, from range partitions numbered within."""
    p = read(spark, sf_dir, "part").where("p_type = 'ECONOMY'").select("p_partkey", "p_retailprice")
    n = selection.numbered(p, [F.desc("p_retailprice"), F.col("p_partkey")], "r")
    return n.select("p_partkey", F.expr("(r - 1) div 20").alias("page"), ((F.col("r") - 1) % 20).alias("position"))


@query("""WITH q(q) AS (VALUES ('Brand#10x'), ('Brad#3'), ('BRAND#21')), b AS (SELECT DISTINCT p_brand FROM part), s AS (SELECT q, p_brand, levenshtein(q, p_brand) AS d, row_number() OVER (PARTITION BY q ORDER BY levenshtein(q, p_brand), p_brand) AS r FROM q, b) SELECT q AS unknown, p_brand AS suggestion, d AS distance FROM s WHERE r <= 3""")
def metric_suggestions(spark, sf_dir):
    """The three nearest names of an unknown one."""
    q = spark.createDataFrame([("Brand#10x",), ("Brad#3",), ("BRAND#21",)], "unknown string")
    b = read(spark, sf_dir, "part").select("p_brand").distinct()
    j = b.crossJoin(F.broadcast(q)).withColumn("distance", F.levenshtein("unknown", "p_brand").cast("long"))  # q: the names asked for
    top = F.row_number().over(Window.partitionBy("unknown").orderBy("distance", "p_brand"))
    return j.withColumn("r", top).where("r <= 3").select("unknown", F.col("p_brand").alias("suggestion"), "distance")


@query("""WITH d AS (SELECT event_id, user_id, event_type AS cls, ts, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 3 = 0 THEN -CAST(value AS DECIMAL(18,4)) ELSE CAST(value AS DECIMAL(18,4)) END AS a, CASE WHEN event_id % 151 = 0 THEN 'lots' ELSE 'shares' END AS unit FROM events),
r AS (SELECT *, bool_or(a IS NULL OR unit <> 'shares') OVER w AS bad, sum(a) OVER w AS s FROM d WINDOW w AS (PARTITION BY user_id, cls ORDER BY ts, event_id)) SELECT user_id, cls, bool_or(bad) AS unknown, CASE WHEN NOT bool_or(bad) THEN CAST(arg_max(s, (ts, event_id)) AS DOUBLE) END AS position, coalesce(min(CASE WHEN NOT bad THEN s END) < 0, false) AS negative FROM r GROUP BY 1, 2""")
def holder_positions(spark, sf_dir):
    """Positions of each holder and class; a missing quantity or another unit makes them unknown for good."""
    v, k = F.col("value").cast("decimal(18,4)"), F.col("event_id")
    a = F.when(k % 97 == 0, None).when(k % 151 == 0, None).when(k % 3 == 0, -v).otherwise(v)
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("cls"), "ts", "value")
    r = analytics.running_balance(e, ["user_id", "cls"], ["ts", "event_id"], a)
    return r.groupBy("user_id", "cls").agg(F.bool_or(F.col("balance").isNull()).alias("unknown"), F.max_by("balance", F.struct("ts", "event_id")).alias("b"), F.coalesce(F.min("balance") < 0, F.lit(False)).alias("negative")).select(
        "user_id", "cls", "unknown", F.when(~F.col("unknown"), F.col("b").cast("double")).alias("position"), "negative")


@query("""WITH p AS (SELECT DISTINCT strftime(ts, '%m-%d') AS period FROM events), s AS (SELECT DISTINCT user_id, event_type FROM events), f AS (SELECT user_id, event_type, strftime(ts, '%m-%d') AS period, min(props) AS lo, max(props) AS hi, bool_and(event_id % 3 = 0) AS old FROM events GROUP BY 1, 2, 3)
SELECT s.user_id, s.event_type, p.period, CASE WHEN f.lo IS NULL THEN 'missing' WHEN old THEN 'superseded' WHEN lo <> hi THEN 'conflict' ELSE 'current' END AS state FROM s CROSS JOIN p LEFT JOIN f ON f.user_id = s.user_id AND f.event_type = s.event_type AND f.period = p.period""")
def profile_cells(spark, sf_dir):
    """Every series by every period: current, conflicting, superseded or missing."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.date_format("ts", "MM-dd").alias("period"), "props", (F.col("event_id") % 3 == 0).alias("old"))
    f = e.groupBy("user_id", "event_type", "period").agg(F.min("props").alias("lo"), F.max("props").alias("hi"), F.every("old").alias("old"))
    periods = F.broadcast(e.select("period").distinct())  # the calendar's periods
    grid = f.select("user_id", "event_type").distinct().crossJoin(periods)
    state = F.when(F.col("lo").isNull(), "missing").when(F.col("old"), "superseded").when(F.col("lo") != F.col("hi"), "conflict").otherwise("current")
    return grid.join(f, ["user_id", "event_type", "period"], "left").select("user_id", "event_type", "period", state.alias("state"))


@query("""SELECT event_id, list_contains(regexp_extract_all(quote, '[0-9]+(\\.[0-9]+)?'), CAST(v AS VARCHAR)) AS value_in_quote FROM (SELECT event_id, CAST(event_id % 50 AS INT) AS v, 'about ' || CASE WHEN event_id % 4 = 0 THEN event_id % 7 ELSE event_id % 50 END || ' units of ' || event_type || ' 2.5' AS quote FROM events)""")
def quoted_values(spark, sf_dir):
    """Whether a value stands in its quote as a whole number, not within a longer one."""
    k = F.col("event_id")
    quote = F.concat(F.lit("about "), F.when(k % 4 == 0, k % 7).otherwise(k % 50).cast("string"), F.lit(" units of "), F.col("event_type"), F.lit(" 2.5"))
    return read(spark, sf_dir, "events").select("event_id", F.array_contains(F.regexp_extract_all(quote, F.lit(r"([0-9]+(?:\.[0-9]+)?)")), (k % 50).cast("string")).alias("value_in_quote"))


@query("""WITH v AS (SELECT s_suppkey, s_nationkey, s_acctbal, CASE WHEN s_acctbal > 8000 THEN 'R01' END AS r1, CASE WHEN s_acctbal < 0 THEN 'R02' END AS r2, CASE WHEN s_nationkey % 4 > 0 AND s_acctbal / (s_nationkey % 4) > 4000 THEN 'R03' END AS r3 FROM supplier)
SELECT s_suppkey, concat_ws(',', r1, r2, r3) AS triggers, CASE WHEN s_nationkey % 4 = 0 THEN 'R03' ELSE '' END AS not_evaluated FROM v""")
def reading_triggers(spark, sf_dir):
    """K5: rules over thresholds: those that trigger, and those whose inputs are missing."""
    b, d = F.col("s_acctbal"), F.when(F.col("s_nationkey") % 4 > 0, F.col("s_nationkey") % 4)
    tests = [("R01", b > 8000), ("R02", b < 0), ("R03", b / d > 4000)]
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(rules.reasons(*tests), ",").alias("triggers"), F.array_join(rules.reasons(*[(c, t.isNull()) for c, t in tests]), ",").alias("not_evaluated"))


@query("""WITH f AS (SELECT n_name AS k, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), c AS (SELECT n_name AS k, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'FURNITURE' OR n_nationkey % 2 = 0 GROUP BY 1)
SELECT f.k AS metric, CAST(f.v AS DOUBLE) AS full_value, CAST(c.v AS DOUBLE) AS core_value FROM f JOIN c USING (k) WHERE f.v <> c.v""")
def pack_mismatches(spark, sf_dir):
    """Metrics on which the core and the full pack disagree."""
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("b"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("metric"))
    core = F.when((F.col("c_mktsegment") != "FURNITURE") | (F.col("c_nationkey") % 2 == 0), F.col("b"))
    both = c.groupBy("c_nationkey").agg(F.sum("b").alias("full_value"), F.sum(core).alias("core_value")).where("full_value <> core_value").join(n, "c_nationkey")
    return both.select("metric", F.col("full_value").cast("double").alias("full_value"), F.col("core_value").cast("double").alias("core_value"))


@query("""WITH a AS (SELECT DISTINCT year(o_orderdate) AS yr FROM orders WHERE month(o_orderdate) = 12 AND o_totalprice > 450000) SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'revenue' WHEN 'O' THEN 'net_income' ELSE o_orderstatus END AS metric, CASE WHEN a.yr IS NOT NULL THEN 'annual' ELSE 'cumulative' END AS period_type, sha256(concat_ws('|', o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'revenue' WHEN 'O' THEN 'net_income' ELSE o_orderstatus END))[1:16] AS fact_id, o_orderkey AS derived_from FROM orders LEFT JOIN a ON a.yr = year(o_orderdate)""")
def alias_facts(spark, sf_dir):
    """Facts under the report's names, cumulative ones of reported years as annual, with what they derive from."""
    o = read(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate"))
    years = o.where((F.month("o_orderdate") == 12) & (F.col("o_totalprice") > 450000)).select("yr", F.lit(1).alias("there")).distinct()
    names = F.create_map(F.lit("F"), F.lit("revenue"), F.lit("O"), F.lit("net_income"))
    j = o.join(F.broadcast(years), "yr", "left").withColumn("metric", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.col("o_orderstatus")))  # years: a handful
    return j.select("o_orderkey", "metric", F.when(F.col("there") == 1, "annual").otherwise("cumulative").alias("period_type"), F.substring(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "metric"), 256), 1, 16).alias("fact_id"), F.col("o_orderkey").alias("derived_from"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'excluded' WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'LARGE') THEN 'not_applicable' WHEN p_size % 5 = 0 THEN 'needs_context' ELSE 'applicable' END AS applicability, 10 * 5 // 5 + p_partkey - p_partkey % 10 AS original FROM part""".replace("10 * 5 // 5 + p_partkey - p_partkey % 10", "p_partkey - p_partkey % 10"))
def method_applicability(spark, sf_dir):
    """Whether a method applies (exclusion, inclusion, required context), and its original source over any number
    of steps."""
    k, t = F.col("p_partkey"), F.col("p_type")
    p = read(spark, sf_dir, "part")
    roots = selection.roots(p.where("p_partkey % 10 > 0").select("p_partkey", (k - 1).alias("p")), "p_partkey", "p").withColumnRenamed("node", "p_partkey")
    state = rules.first_reason(("excluded", t == "PROMO"), ("not_applicable", ~t.isin("ECONOMY", "STANDARD", "LARGE")), ("needs_context", F.col("p_size") % 5 == 0), ("applicable", F.lit(True)))
    return p.join(roots, "p_partkey", "left").select("p_partkey", state.alias("applicability"), F.coalesce("root", "p_partkey").alias("original"))


@query("""WITH n AS (SELECT c_custkey AS person_id, c_nationkey AS company, regexp_replace(lower(c_mktsegment), '[\\s._-]+', '', 'g') AS key, DATE '1996-01-01' + CAST(c_custkey AS INT) AS known FROM customer), q AS (SELECT s_suppkey, s_nationkey AS company, CASE WHEN s_suppkey % 2 = 0 THEN 'Build_ing' ELSE 'MACHI NERY' END AS raw FROM supplier)
SELECT s_suppkey, count(person_id) AS n_candidates, CASE count(person_id) WHEN 0 THEN 'new' WHEN 1 THEN 'bound' ELSE 'ambiguous' END AS status, min(person_id) AS first_candidate FROM q LEFT JOIN n ON n.company = q.company AND key = regexp_replace(lower(raw), '[\\s._-]+', '', 'g') AND known <= DATE '1997-06-30' GROUP BY 1""")
def person_candidates(spark, sf_dir):
    """People of a company by normalised name, as known at a date; several stay several."""
    c = read(spark, sf_dir, "customer").where(F.date_add(F.lit("1996-01-01").cast("date"), F.col("c_custkey").cast("int")) <= F.lit("1997-06-30").cast("date"))
    n = c.select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("company"), evidence.person_key("c_mktsegment").alias("key"))
    q = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("company"), F.when(F.col("s_suppkey") % 2 == 0, "Build_ing").otherwise("MACHI NERY").alias("raw")).withColumn("key", evidence.person_key("raw"))
    g = q.join(n, ["company", "key"], "left").groupBy("s_suppkey").agg(F.count("person_id").alias("n_candidates"), F.min("person_id").alias("first_candidate"))
    return g.select("s_suppkey", "n_candidates", F.when(F.col("n_candidates") == 0, "new").when(F.col("n_candidates") == 1, "bound").otherwise("ambiguous").alias("status"), "first_candidate")


@query("""WITH m AS (SELECT s_nationkey AS peer, 'a' AS metric, s_acctbal AS v, s_suppkey AS id FROM supplier UNION ALL SELECT s_nationkey, 'b', s_suppkey, s_suppkey FROM supplier UNION ALL SELECT c_nationkey, 'c', c_acctbal, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), g AS (SELECT peer, metric, arg_max(v, id) AS v, count(*) > 3 AND metric = 'a' AS conflict FROM m GROUP BY 1, 2)
SELECT peer, round(max(v) FILTER (WHERE metric = 'a' AND NOT conflict), 4) AS a, round(max(v) FILTER (WHERE metric = 'b' AND NOT conflict), 4) AS b, round(max(v) FILTER (WHERE metric = 'c' AND NOT conflict), 4) AS c FROM g GROUP BY 1""")
def peer_payload(spark, sf_dir):
    """Each peer's metrics side by side; one whose selection conflicts is left out."""
    s = read(spark, sf_dir, "supplier")
    part = lambda df, peer, metric, v, i: df.select(F.col(peer).alias("peer"), F.lit(metric).alias("metric"), F.col(v).cast("double").alias("v"), F.col(i).alias("id"))
    m = reduce(DataFrame.union, [part(s, "s_nationkey", "a", "s_acctbal", "s_suppkey"), part(s, "s_nationkey", "b", "s_suppkey", "s_suppkey"), part(read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "c_nationkey", "c", "c_acctbal", "c_custkey")])
    g = m.groupBy("peer", "metric").agg(F.max_by("v", "id").alias("v"), (F.count("*") > 3).alias("many")).where("not (many and metric = 'a')")
    peers = m.select("peer").distinct().join(g.groupBy("peer").pivot("metric", ["a", "b", "c"]).agg(F.max("v")), "peer", "left")
    return peers.select("peer", *[F.round(x, 4).alias(x) for x in "abc"])


@query("""SELECT page_id, strlen(html) AS payload_bytes, CASE WHEN page_id % 10 = 3 THEN 'hash_mismatch' WHEN page_id % 10 = 4 THEN 'length_mismatch' WHEN page_id % 10 = 5 THEN 'lineage_missing' END AS issue FROM pages""")
def snapshot_integrity(spark, sf_dir):
    """Archived content against its manifest: hash, length and lineage, first issue first."""
    p, k = read(spark, sf_dir, "pages"), F.col("page_id")
    raw = F.col("html").cast("binary")
    stored = p.select("page_id", "html", F.sha2(raw, 256).alias("sha"), F.octet_length("html").alias("n"))
    manifest = stored.select("page_id", F.when(k % 10 == 3, "0").otherwise(F.col("sha")).alias("want_sha"), (F.col("n") + F.when(k % 10 == 4, 1).otherwise(0)).alias("want_n"), F.when(k % 10 != 5, k).alias("parent"))
    j = stored.join(manifest, "page_id", "left")
    return j.select("page_id", F.col("n").cast("long").alias("payload_bytes"), rules.first_reason(("missing", F.col("want_sha").isNull()), ("hash_mismatch", F.col("sha") != F.col("want_sha")), ("length_mismatch", F.col("n") != F.col("want_n")), ("lineage_missing", F.col("parent").isNull())).alias("issue"))


@query("""WITH t AS (SELECT event_id, event_type AS payload FROM events WHERE event_type <> 'view'), i AS (SELECT event_id, CASE WHEN value > 80 THEN 'changed' ELSE event_type END AS payload FROM events) SELECT i.event_id, CASE WHEN t.event_id IS NULL THEN 'inserted' WHEN t.payload = i.payload THEN 'verified' ELSE 'rejected' END AS outcome FROM i LEFT JOIN t USING (event_id)""")
def upsert_outcomes(spark, sf_dir):
    """Insert or verify: a known id with the same payload is verified, with another it is rejected."""
    e = read(spark, sf_dir, "events")
    t = e.where("event_type <> 'view'").select("event_id", F.col("event_type").alias("old"))
    i = e.select("event_id", F.when(F.col("value") > 80, "changed").otherwise(F.col("event_type")).alias("payload"))
    return i.join(t, "event_id", "left").select("event_id", F.when(F.col("old").isNull(), "inserted").when(F.col("old") == F.col("payload"), "verified").otherwise("rejected").alias("outcome"))


#: Figures of each customer, in SQL for both.
_FIGURES = {
    "revenue": "c_acctbal", "revenue_before": "CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal * (0.7e0 + c_nationkey * 0.02e0) END", "revenue_growth_before": "0.05e0", "profit": "c_acctbal - 2000", "profit_before": "c_acctbal - 2500", "profit_growth_before": "CASE WHEN c_custkey % 2 = 0 THEN 0.1e0 END",
    "adjusted_profit": "CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal - 2100 END", "adjusted_profit_before": "c_acctbal - 2600", "adjusted_profit_growth_before": "0.2e0", "gross_margin": "0.3e0 + c_nationkey * 0.0013e0", "gross_margin_before": "0.3071e0", "sales_expense_ratio": "0.1e0", "sales_expense_ratio_before": "0.1e0 + c_nationkey * 0.0011e0",
    "management_expense_ratio": "CASE WHEN c_custkey % 3 = 0 THEN 0.08e0 END", "management_expense_ratio_before": "0.05e0", "research_expense_ratio": "0.04e0", "research_expense_ratio_before": "0.0413e0", "cash_flow": "c_acctbal * 0.6e0 - 1500", "cash_ratio_before": "CASE WHEN c_custkey % 5 <> 0 THEN 0.9e0 END",
    "receivables_growth": "c_nationkey * 0.03e0", "receivables_days": "40e0 + c_nationkey * 3", "receivables_days_before": "50e0", "inventory_growth": "CASE WHEN c_custkey % 6 <> 0 THEN 0.1e0 END", "inventory_days": "100e0", "inventory_days_before": "c_nationkey * 5e0", "contract_liability": "c_acctbal * 0.3e0", "contract_liability_before": "c_acctbal * 0.2e0 + 900",
    "assets": "c_acctbal * 4", "debt": "c_acctbal + c_nationkey * 70", "debt_ratio_before": "0.23e0", "goodwill_impairment": "CASE WHEN c_custkey % 10 = 1 THEN 5e0 ELSE 0e0 END", "impairment": "c_nationkey * 3e0", "equity_before": "c_acctbal * 0.9e0 - 100", "people_changed": "c_custkey % 12 = 0", "capital_event": "CASE WHEN c_custkey % 7 = 0 THEN 300e0 END",
    "capital_event_major": "c_custkey % 50 = 0", "risk_event": "c_nationkey * 7e0", "risk_event_key": "c_custkey % 40 = 3", "dividend": "CASE WHEN c_custkey % 8 <> 0 THEN 1e0 END", "dividend_before": "1e0 + c_nationkey * 0.017e0", "return_cancelled": "c_custkey % 60 = 7", "repurchase": "c_nationkey * 1e0", "shares": "1013e0",
}


def _g(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} - 1 END"


def _reading_sql() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    hit: list[tuple[str, str]] = []
    for m in ("revenue", "profit", "adjusted_profit"):
        switch = "false" if m == "revenue" else f"coalesce(({m}_before <= 0 AND {m} > 0) OR ({m}_before >= 0 AND {m} < 0), false)"
        if m != "revenue":
            hit.append((f"R01/{m}:profit_loss_switch", switch))
        hit += [(f"R01/{m}:growth", f"NOT {switch} AND abs({_g(m, m + '_before')}) >= 0.2e0"), (f"R01/{m}:growth_change", f"NOT {switch} AND abs({_g(m, m + '_before')} - {m}_growth_before) >= 0.15e0")]
    hit += [(f"R02/{m}:change", f"abs({m} - {m}_before) >= {x}e0") for m, x in (("gross_margin", "0.03"), ("sales_expense_ratio", "0.02"), ("management_expense_ratio", "0.02"), ("research_expense_ratio", "0.02"))]
    hit += [("R03/cash_flow_negative", "profit > 0 AND cash_flow < 0"), ("R03/cash_ratio_down", "profit > 0 AND cash_flow / nullif(profit, 0) < 0.8e0 AND cash_ratio_before - cash_flow / nullif(profit, 0) >= 0.2e0")]
    for m in ("receivables", "inventory"):
        hit += [(f"R04/{m}:outgrow_revenue", f"{m}_growth - ({_g('revenue', 'revenue_before')}) >= 0.2e0"), (f"R04/{m}:days", f"{m}_days_before > 0 AND {m}_days - {m}_days_before >= 30 AND {m}_days / nullif({m}_days_before, 0) - 1 >= 0.2e0")]
    hit += [
        ("R05/contract_liability_down", f"({_g('contract_liability', 'contract_liability_before')}) <= -0.2e0"), ("R05/debt_ratio_up", "assets > 0 AND debt / nullif(assets, 0) - debt_ratio_before >= 0.05e0"), ("R06/goodwill_impairment", "goodwill_impairment > 0"), ("R06/impairment_share", "equity_before > 0 AND impairment / nullif(equity_before, 0) >= 0.01e0"),
        ("R07/people_changed", "people_changed"), ("R08/major_capital_event", "capital_event_major"), ("R08/capital_event_share", "equity_before > 0 AND capital_event / nullif(equity_before, 0) >= 0.05e0"), ("R09/key_regulatory_event", "risk_event_key"), ("R09/risk_event_share", "equity_before > 0 AND risk_event / nullif(equity_before, 0) >= 0.01e0"),
        ("R10/dividend_down", f"({_g('dividend', 'dividend_before')}) <= -0.2e0"), ("R10/return_cancelled", "return_cancelled"), ("R10/repurchase_share", "repurchase / shares >= 0.01e0"),
    ]
    no_equity = "coalesce(equity_before <= 0, true)"
    gone = [(f"R01/{m}:same_period", f"{m} IS NULL OR {m}_before IS NULL") for m in ("revenue", "profit", "adjusted_profit")] + [(f"R02/{m}:same_period", f"{m} IS NULL OR {m}_before IS NULL") for m in ("gross_margin", "sales_expense_ratio", "management_expense_ratio", "research_expense_ratio")]
    gone += [("R03/profit_and_cash_flow", "profit IS NULL OR cash_flow IS NULL"), *[(f"R04/{m}:comparison", f"{m}_growth IS NULL OR {m}_days IS NULL OR {m}_days_before IS NULL") for m in ("receivables", "inventory")], ("R05/debt_ratio", "debt IS NULL OR assets IS NULL OR debt_ratio_before IS NULL")]
    gone += [("R06/impairment_and_equity", f"impairment IS NULL OR {no_equity}"), ("R08/capital_event_and_equity", f"capital_event IS NULL OR {no_equity}"), ("R09/risk_event_and_equity", f"risk_event IS NULL OR {no_equity}"), ("R10/two_dividends", "dividend IS NULL OR dividend_before IS NULL")]
    return hit, gone


def _joined(checks: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {x} THEN '{c}' END" for c, x in checks) + ")"


@query("WITH f AS (SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in _FIGURES.items()) + f" FROM customer) SELECT c_custkey, {_joined(_reading_sql()[0])} AS triggers, {_joined(_reading_sql()[1])} AS missing FROM f")
def reading_rules(spark, sf_dir):
    """K5: rules over a company's figures: why its report must be read, and what is missing to say so."""
    f = read(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{e} AS {n}" for n, e in _FIGURES.items()])
    v = {n: F.col(n) for n in _FIGURES}
    return f.select("c_custkey", reading.codes(reading.triggers(v)).alias("triggers"), reading.codes(reading.missing(v)).alias("missing"))
