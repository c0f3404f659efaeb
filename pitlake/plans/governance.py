"""Registered queries of control graphs and of states rebuilt from anchors and deltas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.operators import graphs, reconstruction
from pitlake.operators.analytics import shared_dir
from pitlake.plans.queries import ORACLES, query
from pitlake.sources.tables import read
from pitlake.streaming import folds


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The suppliers of an order as a chain of control, forwards or backwards, in the nation of its customer; an urgent order
    replaces the customer's one before; two states a year for each nation, known ever later."""
    s = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("p")).where("size(p) between 2 and 3")
    o = read(spark, sf_dir, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    path = F.when(F.col("o_orderstatus") == "F", F.reverse("p")).otherwise(F.col("p"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    d = F.col("o_orderdate").cast("date")
    relations = o.select(
        F.col("o_orderkey").alias("record_id"), F.col("c_nationkey").alias("nation"), F.element_at(path, 1).alias("controller"), F.element_at(path, -1).alias("controlled"), F.lit("holding").alias("kind"), F.when(F.size("p") > 2, "indirect").otherwise("direct").alias("direction"),
        path.alias("path"), d.alias("valid_from"), F.date_add(d, 90).alias("valid_to"), F.date_add(d, 20).alias("available_at"), F.when(F.col("o_orderpriority").startswith("1"), before).alias("supersedes"),
    )
    times = F.posexplode(F.expr("sequence(date'1995-06-30', date'2001-06-30', interval 6 months)")).alias("i", "state_at")
    states = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), times)
    return relations, states.select((F.col("nation") * 100 + F.col("i")).cast("long").alias("state_id"), "nation", "state_at", F.date_add("state_at", 5 * F.col("i")).alias("known_at"))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS p FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS id, c_nationkey AS nation, CASE WHEN o_orderstatus = 'F' THEN list_reverse(p) ELSE p END AS path, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS pr, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev
    FROM orders JOIN s ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE len(p) BETWEEN 2 AND 3),
  t AS (SELECT n_nationkey * 100 + i AS state_id, n_nationkey AS nation, CAST(last_day(DATE '1995-06-30' + to_months(CAST(6 * i AS INT))) - CASE WHEN i % 2 = 1 THEN 1 ELSE 0 END AS DATE) AS state_at, i FROM nation, LATERAL (SELECT unnest(range(13)) AS i)),
  seen AS (SELECT state_id, state_at, o.*, CASE WHEN pr LIKE '1%' THEN prev END AS gone FROM t JOIN o USING (nation) WHERE d + 20 <= state_at + CAST(5 * i AS INT)),
  held AS (SELECT * FROM seen x WHERE d <= state_at AND state_at < d + 90 AND NOT EXISTS (SELECT 1 FROM seen y WHERE y.state_id = x.state_id AND y.gone = x.id)),
  one AS (SELECT state_id, path[1] AS a, path[-1] AS b, count(DISTINCT path) AS n, min(path) AS path FROM held GROUP BY ALL), good AS (SELECT * FROM one WHERE n = 1),
  un AS (SELECT state_id, count(*) AS n FROM good g WHERE len(path) = 3 AND NOT (EXISTS (SELECT 1 FROM good x WHERE x.state_id = g.state_id AND len(x.path) = 2 AND x.a = g.path[1] AND x.b = g.path[2]) AND EXISTS (SELECT 1 FROM good x WHERE x.state_id = g.state_id AND len(x.path) = 2 AND x.a = g.path[2] AND x.b = g.path[3])) GROUP BY 1),
  r AS (SELECT state_id, a, b FROM good UNION SELECT r.state_id, r.a, g.b FROM r JOIN good g ON r.state_id = g.state_id AND r.b = g.a), cy AS (SELECT state_id, count(*) AS n FROM r WHERE a = b GROUP BY 1),
  c AS (SELECT state_id, count(*) FILTER (n = 1) AS n_relations, count(*) FILTER (n > 1) AS n_conflicts FROM one GROUP BY 1)
SELECT t.state_id, CASE WHEN coalesce(cy.n, 0) > 0 THEN 'cyclic' WHEN coalesce(un.n, 0) > 0 THEN 'unproven' WHEN coalesce(n_conflicts, 0) > 0 THEN 'conflicted' ELSE 'complete' END AS outcome, coalesce(n_relations, 0) AS n_relations, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(un.n, 0) AS n_unproven, coalesce(cy.n, 0) AS n_cyclic
FROM t LEFT JOIN c USING (state_id) LEFT JOIN un USING (state_id) LEFT JOIN cy USING (state_id)""")
def control_states(spark, sf_dir):
    """Control graphs as known and valid at a time: versions, conflicts, unproven segments, nodes on cycles."""
    relations, states = _relations(spark, sf_dir)
    return graphs.control_state(relations, states, "nation")


#: What each kind takes from the events as deltas, and what it says about a position, in SQL for both.
_KINDS = {
    "ownership": (("purchase", "click"), "subject", "cast({balance} as {s})"),
    "pledge": (("purchase", "click"), "concat(subject, '/', other, '/', {basis_key})", "cast({balance} as {s})"),
    "roster": (("view", "error"), "concat(subject, '/', other, coalesce(':' || problem, ''))", "cast({since} as {s})"),
    "control": (("purchase", "click", "view", "error"), "concat(subject, '/', other)", "cast(delta_id as {s})"),
    "annual": (("purchase", "click", "view", "error"), "concat(subject, '/', basis)", "cast(delta_id as {s})"),
    "interval": (("purchase", "click", "view", "error"), "concat(subject, '/', other, '/', basis)", "cast(delta_id as {s})"),
}
_DELTA = [
    "CASE k % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS subject",
    "CASE WHEN k % 2 = 0 THEN 'chair' ELSE 'ceo' END AS other",
    "CASE event_type WHEN 'purchase' THEN 'increase' WHEN 'click' THEN 'decrease' WHEN 'view' THEN 'appoint' ELSE 'dismiss' END AS action",
    "CASE WHEN value >= 0.3 THEN CAST(floor(value) AS BIGINT) END AS quantity",
    "CASE WHEN value BETWEEN 19 AND 19.3 THEN 'lots' ELSE 'shares' END AS unit",
]


def _history(spark: SparkSession, sf_dir: str, kind: str) -> reconstruction.Inputs:
    """The events of each user as a company's history: signups are anchors of three positions, other events deltas; some
    replace the delta before, some are withdrawn or out of unit; three states a user, known a day before to a day after."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    later = F.expr("ts + make_dt_interval(0, int(k / 10))")
    states = e.select(F.col("user_id").alias("company")).distinct().select("company", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    at = lambda days: F.expr(f"to_timestamp_ntz('2024-01-10 00:00:00') + make_dt_interval({days})")
    states = states.select((F.col("company") * 10 + F.col("i")).alias("state_id"), "company", at("8 * i").alias("state_at"), at("9 * i - 1").alias("known_at"))
    up = e.where("event_type = 'signup'")
    never = F.lit(None).cast("long")
    anchors = up.select(F.col("user_id").alias("company"), F.col("event_id").alias("anchor_id"), F.col("ts").alias("reference_at"), later.alias("available_at"), F.expr("value >= 2").alias("complete"), never.alias("supersedes"), F.expr("k = 7").alias("withdrawn"))
    three = F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(o).alias("other")) for s, o in (("a", "chair"), ("b", "ceo"), ("c", "ceo"))])
    items = up.select(F.col("event_id").alias("anchor_id"), F.inline(three), (F.col("k") * 3).cast("long").alias("quantity"), F.lit("shares").alias("unit"), F.lit("total").alias("basis")).select("anchor_id", "subject", "other", "quantity", "unit", "basis")
    basis = "concat('Y', int(day(ts) / 10))" if kind in ("annual", "interval") else "CASE WHEN value > 60 THEN 'free' ELSE 'total' END"
    d = e.where(F.col("event_type").isin(*_KINDS[kind][0])).withColumn("before", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    deltas = d.selectExpr(
        "user_id AS company", "event_id AS delta_id", "ts AS effective_at", "ts AS announced_at", "ts + make_dt_interval(0, int(k / 10)) AS available_at", "CASE WHEN k = 50 THEN before END AS supersedes", "k = 8 AS withdrawn",
        *_DELTA, f"{basis} AS basis", "CASE WHEN k >= 20 THEN ts + make_dt_interval(0, 6 * k) END AS valid_to",
    )
    sides = e.where("k in (33, 44)").select(F.col("user_id").alias("company"), F.when(F.col("k") == 33, "conflict").otherwise("gap").alias("side"), F.col("ts").alias("available_at"), F.when(F.col("event_type") == "click", later).alias("closed_at"))
    return reconstruction.Inputs(states, anchors, items, deltas, sides)


def _rebuilt(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = reconstruction.reconstruct(kind, _history(spark, sf_dir, kind))
    says = [x.format(s="string", balance="balance", since="since", basis_key="basis_key") for x in _KINDS[kind][1:]]
    positions = found.positions.select("state_id", F.expr(says[0]).alias("position"), F.expr(says[1]).alias("value"))
    return found.summary.join(positions, "state_id", "left")


def _rebuilt_sql(kind: str) -> str:
    basis = "concat('Y', day(ts) // 10)" if kind in ("annual", "interval") else "CASE WHEN value > 60 THEN 'free' ELSE 'total' END"
    types, position, value = _KINDS[kind]
    key = {"ownership": "subject", "pledge": "subject, other, basis"}.get(kind, "subject, other")
    balance = f"""s0 AS (SELECT state_id, subject, other, 'total' AS basis, CAST(q AS BIGINT) AS start FROM best JOIN e ON event_id = anchor_id, LATERAL (SELECT unnest(['a', 'b', 'c']) AS subject, unnest(['chair', 'ceo', 'ceo']) AS other, k * 3 AS q)),
      s1 AS (SELECT state_id, {key}, start FROM s0), run AS (SELECT x.*, s1.start, s1.start IS NULL OR bool_or(quantity IS NULL OR (s1.start IS NOT NULL AND (unit <> 'shares' OR basis <> 'total'))) OVER w AS bad FROM sel x LEFT JOIN s1 USING (state_id, {key}) WINDOW w AS (PARTITION BY state_id, {key} ORDER BY eff, delta_id)),
      sums AS (SELECT *, CASE WHEN NOT bad THEN start + sum(CASE WHEN bad THEN 0 WHEN action = 'increase' THEN quantity ELSE -quantity END) OVER (PARTITION BY state_id, {key} ORDER BY eff, delta_id) END AS now FROM run),
      per AS (SELECT state_id, {key}, sum(CASE WHEN bad THEN 0 WHEN action = 'increase' THEN quantity ELSE -quantity END) AS total, count(*) FILTER (bad) AS n_issues, coalesce(min(now) < 0, false) AS neg FROM sums GROUP BY ALL),
      pos AS (SELECT state_id, {key}, CASE WHEN start IS NOT NULL AND coalesce(n_issues, 0) = 0 THEN CAST(start + coalesce(total, 0) AS BIGINT) END AS balance, coalesce(n_issues, 0) AS n, coalesce(neg, false) AS neg FROM s1 FULL JOIN per USING (state_id, {key})),
      status AS (SELECT state_id, CAST(sum(n) AS BIGINT) AS n_issues, CASE WHEN bool_or(neg) THEN 'invalid' WHEN sum(n) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM pos GROUP BY 1)"""
    roster = """al AS (SELECT state_id, 0 AS f, ref AS t, 0 AS delta_id, unnest(['a', 'b', 'c']) AS subject, unnest(['chair', 'ceo', 'ceo']) AS other, 'appoint' AS action FROM best UNION ALL SELECT state_id, 1, eff, delta_id, subject, other, action FROM sel),
      o AS (SELECT *, lag(action) OVER w AS before, lead(action) OVER w AS after FROM al WINDOW w AS (PARTITION BY state_id, subject, other ORDER BY f, t, delta_id)), op AS (SELECT state_id, subject, other, t AS since FROM o WHERE action = 'appoint' AND after IS NULL),
      pos AS (SELECT state_id, subject, other, since, CASE WHEN other = 'chair' AND count(*) OVER (PARTITION BY state_id, other) > 1 THEN 'overlap' END AS problem FROM op UNION ALL SELECT state_id, subject, other, t, 'close_without_open' FROM o WHERE action = 'dismiss' AND before IS DISTINCT FROM 'appoint'),
      status AS (SELECT state_id, count(problem) AS n_issues, CASE WHEN bool_or(coalesce(problem = 'overlap', false)) THEN 'conflicted' WHEN count(problem) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM pos GROUP BY 1)"""
    cols = {"control": "subject, other", "annual": "subject, basis", "interval": "subject, other, basis"}.get(kind, "subject")
    holds = "sel" if kind != "annual" else "(SELECT * FROM sel QUALIFY basis = max(basis) OVER (PARTITION BY state_id, subject))"
    where = "" if kind == "annual" else "WHERE valid_to IS NULL OR state_at < valid_to"
    record = f"""same AS (SELECT state_id, {cols}, count(DISTINCT (action, quantity, unit)) AS n, min(delta_id) AS delta_id FROM {holds} {where} GROUP BY ALL), pos AS (SELECT * FROM same WHERE n = 1),
      status AS (SELECT state_id, count(*) FILTER (n > 1) AS n_issues, CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'conflicted' ELSE 'complete' END AS status FROM same GROUP BY 1)"""
    body = balance if kind in ("ownership", "pledge") else roster if kind == "roster" else record
    lacks = "WHEN best.anchor_id IS NULL THEN 'incomplete'" if kind in reconstruction.ANCHORED else ""
    said = [x.format(s="VARCHAR", balance="balance", since="since", basis_key="basis") for x in (position, value)]
    return f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
      st AS (SELECT company, company * 10 + i AS state_id, TIMESTAMP '2024-01-10' + to_days(CAST(8 * i AS INT)) AS state_at, TIMESTAMP '2024-01-10' + to_days(CAST(9 * i - 1 AS INT)) AS known_at FROM (SELECT DISTINCT user_id AS company FROM e), (SELECT unnest(range(3)) AS i)),
      best AS (SELECT state_id, arg_max(event_id, (ts, ts + to_hours(k // 10), event_id)) AS anchor_id, max(ts) AS ref FROM st JOIN e ON user_id = company WHERE event_type = 'signup' AND ts + to_hours(k // 10) <= known_at AND k <> 7 AND value >= 2 AND ts <= state_at GROUP BY 1),
      d AS (SELECT user_id AS company, event_id AS delta_id, ts AS eff, ts + to_hours(k // 10) AS av, CASE WHEN k = 50 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS sup, k = 8 AS wd, {', '.join(_DELTA)}, {basis} AS basis, CASE WHEN k >= 20 THEN ts + to_hours(6 * k) END AS valid_to FROM e WHERE event_type IN {types}),
      m AS (SELECT st.*, d.* EXCLUDE (company), av <= known_at AS vis FROM st JOIN d USING (company)), v AS (SELECT * FROM m WHERE vis), rep AS (SELECT DISTINCT state_id, sup AS delta_id, true AS replaced FROM v WHERE sup IS NOT NULL),
      fault AS (SELECT DISTINCT x.state_id FROM v x LEFT JOIN v y ON y.state_id = x.state_id AND y.delta_id = x.sup WHERE x.sup IS NOT NULL AND (y.delta_id IS NULL OR x.av < y.av)),
      sel AS (SELECT v.* FROM v LEFT JOIN rep USING (state_id, delta_id) LEFT JOIN best USING (state_id) WHERE replaced IS NULL AND NOT wd AND eff <= state_at AND (ref IS NULL OR eff > ref)), {body},
      side AS (SELECT state_id, bool_or(k = 33) AS conflict, bool_or(k = 44) AS gap FROM st JOIN e ON user_id = company WHERE k IN (33, 44) AND ts <= known_at AND (event_type <> 'click' OR ts + to_hours(k // 10) > known_at) GROUP BY 1),
      n AS (SELECT state_id, count(*) AS n FROM m GROUP BY 1), ns AS (SELECT state_id, count(*) AS n FROM sel GROUP BY 1)
    SELECT st.state_id, best.anchor_id, coalesce(ns.n, 0) AS n_selected, coalesce(n.n, 0) - coalesce(ns.n, 0) AS n_excluded, coalesce(n_issues, 0) AS n_issues, CASE WHEN fault.state_id IS NOT NULL OR status = 'invalid' THEN 'invalid' WHEN status = 'conflicted' OR conflict THEN 'conflicted' WHEN status = 'incomplete' OR gap THEN 'incomplete' {lacks} ELSE 'complete' END AS completeness,
      p.position, p.value FROM st LEFT JOIN best USING (state_id) LEFT JOIN ns USING (state_id) LEFT JOIN n USING (state_id) LEFT JOIN status USING (state_id) LEFT JOIN side USING (state_id) LEFT JOIN fault USING (state_id) LEFT JOIN (SELECT state_id, {said[0]} AS position, {said[1]} AS value FROM pos) p USING (state_id)"""


@query(_rebuilt_sql("ownership"))
def rebuilt_ownership(spark, sf_dir):
    """Holdings from an anchor and signed deltas, unknown for good after a mismatch."""
    return _rebuilt(spark, sf_dir, "ownership")


@query(_rebuilt_sql("pledge"))
def rebuilt_pledges(spark, sf_dir):
    """Pledges by pledgor, pledgee and basis."""
    return _rebuilt(spark, sf_dir, "pledge")


@query(_rebuilt_sql("roster"))
def rebuilt_rosters(spark, sf_dir):
    """Who holds which role: a fold over a state's appointments and dismissals."""
    return _rebuilt(spark, sf_dir, "roster")


@query(_rebuilt_sql("control"))
def rebuilt_control(spark, sf_dir):
    """Control relations that hold, by their natural key."""
    return _rebuilt(spark, sf_dir, "control")


@query(_rebuilt_sql("annual"))
def rebuilt_annual(spark, sf_dir):
    """Records of each subject's last year."""
    return _rebuilt(spark, sf_dir, "annual")


@query(_rebuilt_sql("interval"))
def rebuilt_intervals(spark, sf_dir):
    """Records whose interval holds the state's instant."""
    return _rebuilt(spark, sf_dir, "interval")


@query(ORACLES["running_balance"])
def streamed_balances(spark, sf_dir):
    """R18 over unbounded input: the running balances of all users by a stateful stream; a last row of no user, far ahead,
    lets the watermark pass all others."""
    amount = "CASE event_type WHEN 'purchase' THEN cast(value as decimal(18,4)) WHEN 'error' THEN -cast(value as decimal(18,4)) WHEN 'signup' THEN CASE WHEN event_id % 40 <> 0 THEN cast(0 as decimal(18,4)) END ELSE cast(0 as decimal(18,4)) END"
    rows = read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "cast(ts as timestamp) AS ts", f"cast({amount} as decimal(18,4)) AS amount")
    last = rows.selectExpr("cast(-1 as long) AS user_id", "cast(-1 as long) AS event_id", "ts").groupBy("user_id", "event_id").agg(F.max("ts").alias("ts"))
    last = last.select("user_id", "event_id", (F.col("ts") + F.expr("interval 9 days")).alias("ts"), F.lit(None).cast("decimal(18,4)").alias("amount"))
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.union(last).write.parquet(f"{path}/in")
    spark.conf.set(folds.STORE, folds.ROCKS)
    found = folds.running_balance(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), ["user_id"])
    found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").select("event_id", "user_id", "balance", "integrity")
