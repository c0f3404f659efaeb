"""Registered queries of the evidence operators, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.functions import finance, periods as when, rules, text
from pitlake.operators import evidence
from pitlake.plans.queries import query
from pitlake.sources.tables import read

LATE = "2001-01-01"


def checks():
    return ("quantity", F.col("l_quantity") > 45), ("discount", F.col("l_discount") == 0), ("late", F.col("l_shipdate") > F.lit(LATE).cast("timestamp_ntz")), ("tax", F.col("l_tax") >= 0.07)


@query(f"""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount = 0 THEN 'discount' END, CASE WHEN l_shipdate > TIMESTAMP '{LATE}' THEN 'late' END, CASE WHEN l_tax >= 0.07::DOUBLE THEN 'tax' END) AS reasons,
  NOT (l_quantity > 45 OR l_discount = 0 OR l_shipdate > TIMESTAMP '{LATE}' OR l_tax >= 0.07::DOUBLE) AS eligible FROM lineitem""")
def admission_reasons(spark, sf_dir):
    """All reasons against a row, in order; eligible without any."""
    li = read(spark, sf_dir, "lineitem").withColumn("r", rules.reasons(*checks()))
    return li.select("l_orderkey", "l_linenumber", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("eligible"))


@query(f"""WITH r AS (SELECT *, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_discount = 0 THEN 'discount' WHEN l_shipdate > TIMESTAMP '{LATE}' THEN 'late' WHEN l_tax >= 0.07::DOUBLE THEN 'tax' END AS reason FROM lineitem)
SELECT l_returnflag, reason, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines FROM r WHERE reason IS NOT NULL GROUP BY 1, 2""")
def admission_gaps(spark, sf_dir):
    """The first reason against each row, counted, with what it touches."""
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", rules.first_reason(*checks()).alias("reason")).where("reason is not null")
    return li.groupBy("l_returnflag", "reason").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("lines"))


@query("""SELECT c_custkey, field, value, CASE field WHEN 'c_mktsegment' THEN 'dimension' WHEN 'c_nationkey' THEN 'key' ELSE 'unclassified' END AS nature FROM (
  SELECT c_custkey, 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)""")
def mapped_fields(spark, sf_dir):
    """Rows as long fields with their nature."""
    return evidence.mapped_fields(read(spark, sf_dir, "customer"), ["c_custkey"], ["c_name", "c_mktsegment", "c_nationkey"], {"c_mktsegment": "dimension", "c_nationkey": "key"})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 16 HOUR WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 3 DAY END AS available_at FROM orders""")
def public_availability(spark, sf_dir):
    """The earliest instant that is safe to use."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    a = when.available_at(at, k % 3 == 0, at + F.expr("interval 3 days"), k % 2 == 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", a.cast("timestamp_ntz").alias("available_at"))


@query("""WITH a AS (SELECT lower(n_name) AS alias, n_nationkey, DATE '1995-01-01' + n_nationkey * 30 AS valid_from, CASE WHEN n_nationkey % 2 = 1 THEN DATE '1995-01-01' + n_nationkey * 30 + 900 END AS valid_to FROM nation),
q AS (SELECT s_suppkey, upper(n_name) AS name, DATE '1995-01-01' + CAST(s_suppkey * 37 % 2000 AS INT) AS at_ FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, n_nationkey FROM q JOIN a ON lower(name) = alias WHERE valid_from <= at_ AND (valid_to IS NULL OR at_ <= valid_to)""")
def alias_matches(spark, sf_dir):
    """Names that were valid at a date."""
    n, base = read(spark, sf_dir, "nation"), F.lit("1995-01-01").cast("date")
    start = F.date_add(base, F.col("n_nationkey") * 30)
    a = n.select(F.lower("n_name").alias("alias"), "n_nationkey", start.alias("valid_from"), F.when(F.col("n_nationkey") % 2 == 1, F.date_add(start, 900)).alias("valid_to"))
    s = read(spark, sf_dir, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    q = s.select("s_suppkey", F.upper("n_name").alias("name"), F.date_add(base, (F.col("s_suppkey") * 37 % 2000).cast("int")).alias("at"))
    return evidence.alias_matches(q, a).select("s_suppkey", "n_nationkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice / l_quantity - p_retailprice) / greatest(abs(l_extendedprice / l_quantity), abs(p_retailprice), 1) <= 0.05::DOUBLE""")
def price_matches(spark, sf_dir):
    """Values that agree within a relative tolerance."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return evidence.near_matches(li, p, ["l_partkey"], F.col("unit"), F.col("p_retailprice"), 0.05).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS c, p_partkey // 2 AS p FROM part WHERE p_partkey > 1), r(c, a) AS (SELECT c, p FROM e UNION SELECT r.c, e.p FROM r JOIN e ON r.a = e.c) SELECT c AS p_partkey, a AS ancestor FROM r""")
def lineage_closure(spark, sf_dir):
    """All facts that a derived fact rests on."""
    e = read(spark, sf_dir, "part").where("p_partkey > 1").select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    return evidence.lineage(e, "p_partkey", "parent")


@query("SELECT event_id, event_id * 3 + 1 AS ref FROM events WHERE event_id * 3 + 1 NOT IN (SELECT event_id FROM events)")
def dangling_references(spark, sf_dir):
    """Claims on what isn't there."""
    e = read(spark, sf_dir, "events").select("event_id")
    return evidence.dangling(e.withColumn("ref", F.col("event_id") * 3 + 1), "ref", e, "event_id").select("event_id", "ref")


@query("SELECT e.event_id, e.event_id * 2 AS ref FROM events e LEFT JOIN events t ON t.event_id = e.event_id * 2 WHERE t.event_id IS NULL AND e.event_id IS NOT NULL")
def all_dangling_references(spark, sf_dir):
    """dangling_references over every event."""
    e = read(spark, sf_dir, "events").select("event_id")
    return evidence.dangling(e.withColumn("ref", F.col("event_id") * 2), "ref", e, "event_id").select("event_id", "ref")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE AS completeness, sum(CASE event_type WHEN 'purchase' THEN 10 WHEN 'signup' THEN 8 WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 0 END)::DOUBLE / (10 * count(*)) AS confidence FROM events GROUP BY 1""")
def evidence_scores(spark, sf_dir):
    """A2: completeness and weighted confidence."""
    tenths = F.create_map(*[F.lit(x) for kv in {"purchase": 10, "signup": 8, "click": 5, "view": 3}.items() for x in kv])
    w = F.coalesce(F.try_element_at(tenths, F.col("event_type")), F.lit(0))
    return read(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") != "error") / F.count("*")).alias("completeness"), (F.sum(w) / (10 * F.count("*"))).alias("confidence"))


@query("""WITH w AS (SELECT user_id, d AS days, value FROM events, (VALUES (5), (15)) t(d) WHERE ts > (SELECT max(ts) FROM events) - to_days(d) AND value > 0) SELECT user_id, days, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50 FROM w GROUP BY 1, 2""")
def window_sensitivity(spark, sf_dir):
    """A distribution over a short and a long window."""
    e = read(spark, sf_dir, "events")
    end = e.agg(F.max("ts").alias("_end"))
    w = e.where("value > 0").join(F.broadcast(end)).withColumn("days", F.explode(F.array(F.lit(5), F.lit(15))))  # end: one row
    w = w.where(F.col("ts") > F.col("_end") - F.make_dt_interval(F.col("days")))
    return w.groupBy("user_id", "days").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"))


@query("""WITH o AS (SELECT l_partkey, l_extendedprice / l_quantity AS v FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-01-01') SELECT p_partkey, count(*) FILTER (WHERE v <= p_retailprice * 2)::DOUBLE / nullif(count(v), 0) AS share FROM part LEFT JOIN o ON l_partkey = p_partkey GROUP BY 1""")
def historic_percentile(spark, sf_dir):
    """A10: share of what was known by a date that isn't above the current value; null without any."""
    o = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1999-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 2).alias("now"))
    return p.join(o, "p_partkey", "left").groupBy("p_partkey").agg(F.try_divide(F.count_if(F.col("v") <= F.col("now")).cast("double"), F.count("v")).alias("share"))


@query("SELECT n_name, count(c_custkey) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS n_debtors FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey  GROUP BY 1")
def dataset_counts(spark, sf_dir):
    """Counters by group, groups without rows included."""
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("d"))
    zero = F.lit(0).cast("long")
    return read(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_name", F.coalesce("n", zero).alias("n"), F.coalesce("d", zero).alias("n_debtors"))


@query("""SELECT n_name, s.segment, count(c_custkey) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS n_debtors FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer UNION ALL SELECT 'NONE') s
LEFT JOIN customer ON n_nationkey = c_nationkey AND c_mktsegment = s.segment GROUP BY 1, 2""")
def all_dataset_counts(spark, sf_dir):
    """dataset_counts over every customer, by nation and segment; segment NONE has no rows anywhere."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    every = c.select("segment").distinct().union(spark.sql("SELECT 'NONE'"))
    n = c.groupBy("n_nationkey", "segment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("d"))
    zero = F.lit(0).cast("long")
    groups = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").crossJoin(every)
    return groups.join(n, ["n_nationkey", "segment"], "left").select("n_name", "segment", F.coalesce("n", zero).alias("n"), F.coalesce("d", zero).alias("n_debtors"))


@query("""SELECT o_orderkey, count(*) AS n_parts, abs(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE - o_totalprice) <= 0.5::DOUBLE * greatest(abs(o_totalprice), 1) AS reconciled FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice""")
def total_reconciliation(spark, sf_dir):
    """Parts against the printed total."""
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_parts"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("s"))
    t = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").join(s, "o_orderkey").select("o_orderkey", "n_parts", (F.abs(F.col("s") - t) <= 0.5 * F.greatest(F.abs(t), F.lit(1.0))).alias("reconciled"))


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def merged_candidates(spark, sf_dir):
    """Lists united by key, independent sources counted."""
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("suppliers"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("""SELECT e.event_id, c AS conflict FROM events e JOIN (SELECT user_id, CAST(ts AS DATE) AS d, event_type, min(props) <> max(props) AS c FROM events GROUP BY 1, 2, 3) k ON e.user_id = k.user_id AND CAST(e.ts AS DATE) = d AND e.event_type = k.event_type""")
def claim_conflicts(spark, sf_dir):
    """All claims of a key that holds several values."""
    return evidence.conflicting(read(spark, sf_dir, "events").withColumn("d", F.to_date("ts")), ["user_id", "d", "event_type"], "props").select("event_id", "conflict")


@query("""SELECT user_id, CAST(ts AS DATE) AS d, {} FROM events GROUP BY 1, 2""".format(", ".join(f"CASE WHEN min(props) FILTER (WHERE event_type = '{t}') <> max(props) FILTER (WHERE event_type = '{t}') THEN 'conflict' ELSE min(props) FILTER (WHERE event_type = '{t}') END AS \"{t}\"" for t in ("click", "error", "view"))))
def label_matrix(spark, sf_dir):
    """Labels by periods, with conflicts and gaps."""
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "event_type", "props")
    return evidence.matrix(e, ["user_id", "d"], "event_type", "props", ["click", "error", "view"])


@query("""WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS v FROM part WHERE p_partkey % 17 <> 0), b AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_partkey % 13 <> 0)
SELECT coalesce(a.k, b.k) AS p_partkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def snapshot_difference(spark, sf_dir):
    """What two snapshots differ in."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    now = p.where("p_partkey % 17 <> 0").withColumn("p_retailprice", F.when(F.col("p_partkey") % 10 == 0, F.col("p_retailprice") * 2).otherwise(F.col("p_retailprice")))
    return evidence.difference(now, p.where("p_partkey % 13 <> 0"), "p_partkey", ["p_retailprice"])


@query("""WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders), r AS (SELECT o_custkey, CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM m GROUP BY 1)
SELECT r.o_custkey, count(*) AS n_missing, min(r.m) AS first_missing FROM r ANTI JOIN m ON r.o_custkey = m.o_custkey AND r.m = m.m GROUP BY 1""")
def period_gaps(spark, sf_dir):
    """Required periods that aren't there."""
    m = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.trunc("o_orderdate", "month")).alias("m"))
    gap = F.array_except(F.sequence(F.array_min("m"), F.array_max("m"), F.expr("interval 1 month")), "m")
    return m.select("o_custkey", gap.alias("g")).where(F.size("g") > 0).select("o_custkey", F.size("g").cast("long").alias("n_missing"), F.array_min("g").alias("first_missing"))


@query("""WITH l AS (SELECT *, coalesce(lag(event_type) OVER w = event_type, false) AS unchanged FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, unchanged, CAST(sum((NOT unchanged)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version FROM l""")
def content_versions(spark, sf_dir):
    """Versions of changing content, repeats are observations of the same one."""
    return evidence.content_versions(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "unchanged", "version")


@query("""SELECT l_orderkey, arg_min(l_extendedprice, (l_returnflag, l_linenumber, l_partkey, l_extendedprice)) FILTER (WHERE l_discount > 0.03::DOUBLE) AS l_extendedprice, count(*) FILTER (WHERE l_discount > 0.03::DOUBLE) AS n_valid FROM lineitem GROUP BY 1""")
def field_resolution(spark, sf_dir):
    """The first valid candidate of several routes."""
    order = [F.col(c) for c in ("l_returnflag", "l_linenumber", "l_partkey", "l_extendedprice")]
    return evidence.resolve_fields(read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_discount") > 0.03, order, "l_extendedprice")


@query("""WITH f AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS old FROM events WHERE value IS NOT NULL), g AS (SELECT f.*, event_id IN (SELECT old FROM f WHERE old IS NOT NULL) AS gone FROM f)
SELECT event_id, CASE WHEN gone THEN 'superseded' WHEN count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY user_id, event_type) > 1 THEN 'conflict' ELSE 'current' END AS status FROM g""")
def fact_lifecycle(spark, sf_dir):
    """Superseded, conflicting and current facts."""
    e = F.col("event_id")
    f = read(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", "event_type", F.when(e % 3 == 0, e - 1).alias("old"))
    return evidence.lifecycle(f, "event_id", "old", ["user_id", "event_type"]).select("event_id", "status")


@query("""WITH f AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS old FROM events), g AS (SELECT f.*, event_id IN (SELECT old FROM f WHERE old IS NOT NULL) AS gone FROM f)
SELECT event_id, CASE WHEN gone THEN 'superseded' WHEN count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY user_id, event_type) > 1 THEN 'conflict' ELSE 'current' END AS status FROM g""")
def all_fact_lifecycles(spark, sf_dir):
    """fact_lifecycle over every event."""
    e = F.col("event_id")
    f = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(e % 3 == 0, e - 1).alias("old"))
    return evidence.lifecycle(f, "event_id", "old", ["user_id", "event_type"]).select("event_id", "status")


@query("""WITH d AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts DESC, event_id) = 1) SELECT user_id, event_id FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3""")
def latest_distinct(spark, sf_dir):
    """The newest distinct records."""
    return evidence.latest_distinct(read(spark, sf_dir, "events"), ["user_id"], ["event_type", "props"], [F.desc("ts"), F.col("event_id")], 3).select("user_id", "event_id")


@query("""SELECT c_custkey, w AS rate, g AS growth, round(c_acctbal * (1.05::DOUBLE / (1 + w) + 1.05::DOUBLE * 1.04::DOUBLE / power(1 + w, 2) + 1.05::DOUBLE * 1.04::DOUBLE * (1 + g) / (w - g) / power(1 + w, 2)), 8) AS value
FROM customer, (VALUES (0.08::DOUBLE), (0.1::DOUBLE), (0.12::DOUBLE)) a(w), (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.03::DOUBLE)) b(g) WHERE c_acctbal > 0""")
def sensitivity_grid(spark, sf_dir):
    """Value over a grid of rates and growth."""
    grid = lambda name, xs: F.explode(F.array(*[F.lit(x) for x in xs])).alias(name)
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal", grid("rate", (0.08, 0.1, 0.12))).select("*", grid("growth", (0.01, 0.02, 0.03)))
    v = finance.discounted_value(finance.projected(F.col("c_acctbal"), F.array(F.lit(0.05), F.lit(0.04))), F.col("rate"), F.col("growth"))
    return c.select("c_custkey", "rate", "growth", F.round(v, 8).alias("value"))


@query("""SELECT conv_id, turn, substr(text, greatest(instr(lower(text), 'the') - 150, 1), 303) AS snippet, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS hits FROM conversations WHERE contains(lower(text), 'the')""")
def text_search(spark, sf_dir):
    """Texts that hold a word, with how often and what stands around its first place."""
    low = F.lower("text")
    hits = F.expr("(length(lower(text)) - length(replace(lower(text), 'the', ''))) div 3").cast("long")
    return read(spark, sf_dir, "conversations").where(low.contains("the")).select("conv_id", "turn", text.snippet(F.col("text"), "the").alias("snippet"), hits.alias("hits"))


@query("SELECT o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_records(spark, sf_dir):
    """The newest records known at a cutoff."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.lit("1999-06-30").cast("timestamp_ntz"))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("o_totalprice"))
