"""Registered queries of releases, corrections, analysis scopes, report versions and merged materials."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import reports
from pitlake.plans.queries import query
from pitlake.sources.tables import read

# A supplier's lines are a release: parts are methods, return flags its questions, line numbers its steps.
_HEX = "sha2(p_name, 256)"


@query("""WITH l AS (SELECT l_suppkey AS r, l_partkey AS m, l_orderkey, l_linenumber AS n, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, sha256(p_name) AS h FROM lineitem JOIN part ON p_partkey = l_partkey),
  rel AS (SELECT s_suppkey AS r, s_acctbal > -900 AS same, s_nationkey % 5 > 0 AS named, s_acctbal < 9000 AS equal FROM supplier),
  q AS (SELECT DISTINCT r, l_returnflag || n AS q, n FROM l WHERE l_linestatus = 'O'), rd AS (SELECT r, l_returnflag || n AS q, count(*) FILTER (WHERE l_quantity > 45) AS extra FROM l WHERE l_linestatus = 'O' AND l_quantity > 2 GROUP BY 1, 2),
  cov AS (SELECT q.r, bool_and(rd.q IS NOT NULL) AS ok FROM q LEFT JOIN rd ON rd.r = q.r AND rd.q = q.q GROUP BY 1),
  meth AS (SELECT r, m, count(*) AS n, min(h) AS h FROM l WHERE l_returnflag = 'A' AND l_quantity > 40 GROUP BY 1, 2), val AS (SELECT r, bool_and(n = 1) AS ok FROM meth GROUP BY 1),
  ck AS (SELECT r, m, CASE WHEN l_linestatus = 'O' THEN 'source' ELSE 'case' END AS kind, l_tax < 0.08::DOUBLE AS good FROM l WHERE l_returnflag = 'A' AND l_quantity > 40),
  ok2 AS (SELECT r, kind, bool_and(ok) AS ok FROM (SELECT k.kind, mm.r, mm.m, coalesce(bool_and(c.good), false) AS ok FROM meth mm CROSS JOIN (VALUES ('source'), ('case')) k(kind) LEFT JOIN ck c ON c.r = mm.r AND c.m = mm.m AND c.kind = k.kind GROUP BY ALL) GROUP BY 1, 2),
  smp AS (SELECT l.r, l_orderkey, l.n AS step, bool_and(l_discount < 0.09::DOUBLE AND meth.m IS NOT NULL) AS ok FROM l LEFT JOIN meth ON meth.r = l.r AND meth.m = l.m GROUP BY 1, 2, 3),
  st AS (SELECT DISTINCT r, n AS step FROM q), smo AS (SELECT st.r, bool_and(EXISTS (SELECT 1 FROM smp WHERE smp.r = st.r AND smp.step = st.step AND ok)) AS ok FROM st GROUP BY 1),
  rv AS (SELECT l.r, l_returnflag AS rv, count(DISTINCT n) AS n, bool_and(l_tax < 0.08::DOUBLE OR l_quantity < 45) AS ok FROM l JOIN st ON st.r = l.r AND st.step = l.n GROUP BY 1, 2), hum AS (SELECT r, bool_or(ok AND n = (SELECT count(*) FROM st WHERE st.r = rv.r)) AS ok FROM rv GROUP BY 1),
  a AS (SELECT rel.r, same AS c1, NOT named OR equal AS c2, coalesce(cov.ok, false) AND NOT EXISTS (SELECT 1 FROM rd x WHERE x.r = rel.r AND x.extra > 1) AS c3, coalesce(val.ok, false) AS c4, coalesce(val.ok AND s.ok, false) AS c5, coalesce(val.ok AND c.ok, false) AS c6, coalesce(smo.ok, false) AS c7, coalesce(hum.ok, false) AS c8
    FROM rel LEFT JOIN cov USING (r) LEFT JOIN val USING (r) LEFT JOIN ok2 s ON s.r = rel.r AND s.kind = 'source' LEFT JOIN ok2 c ON c.r = rel.r AND c.kind = 'case' LEFT JOIN smo ON smo.r = rel.r LEFT JOIN hum ON hum.r = rel.r)
SELECT r AS release_id, unnest(['bundle_identity', 'candidate_content_identity', 'question_coverage', 'method_identities', 'source_checks', 'case_checks', 'agent_samples', 'human_review']) AS check_name, unnest([c1, c2, c3, c4, c5, c6, c7, c8]) AS passed FROM a""")
def release_checks(spark, sf_dir):
    """The eight checks of each supplier's release, over its lines."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(_HEX).alias("content_sha256"))
    li = read(spark, sf_dir, "lineitem").join(p, "l_partkey")
    key = F.col("l_suppkey").alias("release_id")
    rel = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("release_id"), F.col("s_name").alias("bundle_id"), F.when(F.col("s_acctbal") > -900, F.col("s_name")).otherwise("").alias("evidence_bundle_id"), F.sha2("s_name", 256).alias("content_sha256"),
        F.when(F.col("s_acctbal") < 9000, F.sha2("s_name", 256)).otherwise(F.sha2(F.concat("s_name", F.lit("x")), 256)).alias("recorded_sha256"), (F.col("s_nationkey") % 5 > 0).alias("recorded"),
    )
    question, step = F.concat("l_returnflag", F.col("l_linenumber").cast("string")), F.col("l_linenumber").alias("step_id")
    asked = li.where("l_linestatus = 'O'").select(key, question.alias("question_id"), step).distinct()
    answered = li.where("l_linestatus = 'O' and l_quantity > 2").groupBy(key, question.alias("question_id")).agg(F.count_if(F.col("l_quantity") > 45).alias("n"))
    ready = answered.withColumn("i", F.explode(F.when(F.col("n") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("n", "i")  # told twice
    method = F.col("l_partkey").cast("string").alias("method_id")
    one = li.where("l_returnflag = 'A' and l_quantity > 40").select(key, method, "content_sha256", "l_linestatus", "l_tax")
    checks = one.select("release_id", F.when(F.col("l_linestatus") == "O", "source").otherwise("case").alias("kind"), "method_id", "content_sha256", (F.col("l_tax") < 0.08).alias("accepted"))
    named = li.join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("bundle_id")), "l_suppkey")
    samples = named.select(key, F.col("l_orderkey").alias("sample_id"), "bundle_id", step, method, (F.col("l_discount") < 0.09).alias("accepted"))
    views = named.select(key, F.col("l_returnflag").alias("review_id"), "bundle_id", step, ((F.col("l_tax") < 0.08) | (F.col("l_quantity") < 45)).alias("accepted"))
    return reports.release_checks(rel, asked, ready, one.select("release_id", "method_id", "content_sha256"), checks, samples, views)


_ORDERS = """o AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS p, o_orderstatus AS s, o_orderpriority AS pr FROM orders)"""


@query(f"""WITH RECURSIVE {_ORDERS}, w AS (SELECT *, lead(id) OVER v AS nx, lead(d) OVER v AS nd, lead(id, 2) OVER v AS nx2, lag(id) OVER v AS pv FROM o WINDOW v AS (PARTITION BY k ORDER BY p, id)),
  c AS (SELECT 2 * id AS cid, id AS prev, CASE WHEN pr LIKE '2%' AND pv IS NOT NULL THEN pv WHEN pr LIKE '3%' THEN coalesce(nx, id) ELSE nx END AS rep, s <> 'P' AS notice, pr FROM w UNION ALL SELECT 2 * id + 1, id, nx2, true, pr FROM w WHERE s = 'F'),
  j AS (SELECT c.*, b.id AS got, a.d AS d0, b.d AS d1, CASE WHEN b.id IS NULL THEN 'correction_replacement_missing' WHEN NOT notice THEN 'correction_requires_explicit_notice' WHEN a.id = b.id THEN 'correction_identity_or_version_mismatch' WHEN b.d + 1500 < a.d THEN 'correction_predates_original_evidence' WHEN c.pr LIKE '5%' AND b.id % 2 = 1 THEN 'correction_not_cited_by_replacement' END AS reason FROM c JOIN o a ON a.id = c.prev LEFT JOIN o b ON b.id = c.rep),
  g AS (SELECT *, first_value(rep) OVER (PARTITION BY prev ORDER BY cid) AS taken FROM j WHERE reason IS NULL), e AS (SELECT prev, min(taken) AS rep, min(cid) AS cid FROM g GROUP BY 1),
  walk AS (SELECT prev AS start, rep AS here, cid AS last, 1 AS n FROM e UNION ALL SELECT start, e.rep, greatest(last, e.cid), n + 1 FROM walk JOIN e ON e.prev = walk.here WHERE walk.here <> start AND n < 200),
  ring AS (SELECT DISTINCT last AS cid FROM walk WHERE here = start)
SELECT j.cid AS change_id, coalesce(j.reason, CASE WHEN g.rep <> g.taken THEN 'correction_branch_conflict' END, CASE WHEN ring.cid IS NOT NULL THEN 'correction_cycle' END) AS reason
FROM j LEFT JOIN g ON g.cid = j.cid LEFT JOIN e ON e.prev = j.prev AND e.rep = j.rep LEFT JOIN ring ON ring.cid = e.cid""")
def correction_reasons(spark, sf_dir):
    """Corrections of a customer's orders by others, dearer or cheaper: why each is refused, if it is."""
    return reports.corrections(*_corrections(spark, sf_dir))[0]


@query(f"""WITH RECURSIVE {_ORDERS}, w AS (SELECT *, lead(id) OVER v AS nx, lead(id, 2) OVER v AS nx2, lag(id) OVER v AS pv FROM o WINDOW v AS (PARTITION BY k ORDER BY p, id)),
  c AS (SELECT 2 * id AS cid, id AS prev, CASE WHEN pr LIKE '2%' AND pv IS NOT NULL THEN pv WHEN pr LIKE '3%' THEN coalesce(nx, id) ELSE nx END AS rep, s <> 'P' AS notice, pr FROM w UNION ALL SELECT 2 * id + 1, id, nx2, true, pr FROM w WHERE s = 'F'),
  j AS (SELECT c.* FROM c JOIN o a ON a.id = c.prev JOIN o b ON b.id = c.rep WHERE notice AND a.id <> b.id AND b.d + 1500 >= a.d AND NOT (c.pr LIKE '5%' AND b.id % 2 = 1)),
  e AS (SELECT prev, arg_min(rep, cid) AS rep, min(cid) AS cid FROM j GROUP BY 1),
  walk AS (SELECT prev AS start, rep AS here, cid AS last, 1 AS n FROM e UNION ALL SELECT start, e.rep, greatest(last, e.cid), n + 1 FROM walk JOIN e ON e.prev = walk.here WHERE walk.here <> start AND n < 200),
  open AS (SELECT prev, rep FROM e WHERE cid NOT IN (SELECT last FROM walk WHERE here = start)),
  path AS (SELECT id AS fact_id, id AS here, 0 AS n FROM o UNION ALL SELECT fact_id, rep, n + 1 FROM path JOIN open ON prev = path.here)
SELECT fact_id, arg_max(here, n) AS current_id, CAST(max(n) AS BIGINT) AS n_steps FROM path GROUP BY 1""")
def corrected_facts(spark, sf_dir):
    """What stands for each order after all accepted corrections, and over how many."""
    return reports.corrections(*_corrections(spark, sf_dir))[1]


def _corrections(spark, sf_dir):
    """A customer's orders as facts of one key, each corrected by the next dearer one, some by the cheaper one before or by
    themselves; filled ones by a second one as well."""
    from pyspark.sql.window import Window

    v = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    d = F.to_date("o_orderdate")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("pr"), d.alias("d"))
    nx, nx2, pv = F.lead("o_orderkey").over(v), F.lead("o_orderkey", 2).over(v), F.lag("o_orderkey").over(v)
    w = o.select("*", nx.alias("nx"), nx2.alias("nx2"), pv.alias("pv"))
    target = F.when((F.col("pr") == "2") & F.col("pv").isNotNull(), F.col("pv")).when(F.col("pr") == "3", F.coalesce("nx", "o_orderkey")).otherwise(F.col("nx"))
    cid, prev = F.col("o_orderkey") * 2, F.col("o_orderkey").alias("previous_id")
    one = w.select(cid.alias("change_id"), prev, target.alias("replacement_id"), (F.col("o_orderstatus") != "P").alias("notice"), "pr")
    two = w.where("o_orderstatus = 'F'").select((cid + 1).alias("change_id"), prev, F.col("nx2").alias("replacement_id"), F.lit(True).alias("notice"), "pr")
    shown = o.select(F.col("o_orderkey").alias("replacement_id"), F.date_add("d", 1500).alias("available_at"))
    changes = one.union(two).join(shown, "replacement_id", "left").withColumn("citation_id", F.when(F.col("pr") == "5", F.col("replacement_id") * 2).otherwise(F.col("replacement_id") * 2 + F.col("replacement_id") % 2))
    cited = o.select(F.col("o_orderkey").alias("fact_id"), (F.col("o_orderkey") * 2 + F.col("o_orderkey") % 2).alias("citation_id"), F.col("d").alias("available_at"))
    return o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("fact_key")), cited, changes.drop("pr")


@query("""WITH c AS (SELECT c_custkey AS company, DATE '2001-06-30' AS until, CASE WHEN c_acctbal > 0 THEN (SELECT CAST(min(o_orderdate) AS DATE) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') END AS listed, CASE WHEN c_mktsegment = 'BUILDING' THEN DATE '1996-01-01' END AS since FROM customer),
  od AS (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT DISTINCT company, 'M' AS kind, last_day(d) AS e FROM od UNION SELECT DISTINCT company, 'Q', last_day(CAST(date_trunc('quarter', d) AS DATE) + INTERVAL 2 MONTH) FROM od UNION SELECT DISTINCT company, 'Y', make_date(year(d), 12, 31) FROM od),
  own AS (SELECT p.*, until, listed, since, coalesce(e < listed, false) AS early FROM p JOIN c USING (company) WHERE e <= until), fit AS (SELECT *, row_number() OVER (PARTITION BY company, kind ORDER BY e DESC) AS i FROM own WHERE NOT early AND coalesce(e >= since, true)),
  ch AS (SELECT company, CASE kind WHEN 'Y' THEN 'annual' WHEN 'Q' THEN 'quarterly' ELSE 'monthly' END AS role, kind, e FROM fit WHERE i <= CASE kind WHEN 'Y' THEN 5 WHEN 'Q' THEN 12 ELSE 60 END),
  hm AS (SELECT company, max(e) AS top FROM fit WHERE kind = 'Q' AND month(e) = 6 GROUP BY 1), half AS (SELECT company, 'business' AS role, kind, e FROM fit JOIN hm USING (company) WHERE kind = 'Q' AND (e = top OR (month(e) = 6 AND year(e) = year(top) - 1))),
  dep AS (SELECT DISTINCT company, kind, last_day(e - to_months(b)) AS e FROM ch, (VALUES (3), (6), (9), (12)) v(b) WHERE kind = 'Q' OR (kind = 'Y' AND b = 12)),
  a AS (SELECT * FROM ch UNION ALL SELECT company, 'business', kind, e FROM ch WHERE kind = 'Y' UNION ALL SELECT * FROM half UNION ALL SELECT company, 'dependency', kind, e FROM dep UNION ALL SELECT company, 'missing', kind, e FROM dep ANTI JOIN p USING (company, kind, e) UNION ALL SELECT company, 'before_listing', kind, e FROM own WHERE early)
SELECT company, role, kind || CASE kind WHEN 'Y' THEN CAST(year(e) AS VARCHAR) WHEN 'Q' THEN year(e) || 'Q' || quarter(e) ELSE strftime(e, '%Y-%m') END AS period FROM a""")
def analysis_scope(spark, sf_dir):
    """Five years, twelve quarters, sixty months, the half-year pair, dependencies and what is missing of them, for each
    customer from its months, quarters and years with orders; listed with its first urgent order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.to_date("o_orderdate").alias("d"), "o_orderpriority").repartition("company")  # all that follows is by company
    listed = o.where("o_orderpriority like '1%'").groupBy("company").agg(F.min("d").alias("first"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"), "c_acctbal", "c_mktsegment").join(listed, "company", "left")
    c = c.select("company", F.expr("date'2001-06-30'").alias("until"), F.when(F.col("c_acctbal") > 0, F.col("first")).alias("listed"), F.when(F.col("c_mktsegment") == "BUILDING", F.expr("date'1996-01-01'")).alias("since"))
    months = o.select("company", F.last_day("d").alias("end")).distinct()
    ends = F.explode(F.expr("array(struct('M' as kind, end), struct('Q' as kind, last_day(add_months(trunc(end, 'quarter'), 2)) as end), struct('Y' as kind, make_date(year(end), 12, 31) as end))")).alias("p")
    return reports.analysis_scope(c, months.select("company", ends).select("company", "p.*"))


@query("""WITH r AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS prev, o_orderstatus <> lag(o_orderstatus) OVER w AS c1, year(o_orderdate) <> year(lag(o_orderdate) OVER w) AS c2, o_orderpriority <> lag(o_orderpriority) OVER w AS c3, floor(o_totalprice / 100000) <> floor(lag(o_totalprice) OVER w / 100000) AS c4, floor(o_totalprice / 50000) <> floor(lag(o_totalprice) OVER w / 50000) AS c5, floor(o_totalprice / 20000) <> floor(lag(o_totalprice) OVER w / 20000) AS c6 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  f AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS facts, list_sort(list(DISTINCT l_linenumber * 10 + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END)) AS assumed FROM lineitem GROUP BY 1)
SELECT r.id AS report_id, prev AS parent_report_id, CASE WHEN prev IS NULL THEN 'initial' ELSE coalesce(nullif(concat_ws(',', CASE WHEN c1 THEN 'snapshot' END, CASE WHEN c2 THEN 'methods' END, CASE WHEN c3 THEN 'rating' END, CASE WHEN c4 THEN 'fair_value_low' END, CASE WHEN c5 THEN 'fair_value_base' END, CASE WHEN c6 THEN 'fair_value_high' END,
  CASE WHEN coalesce(a.facts, []) <> coalesce(b.facts, []) THEN 'facts' END, CASE WHEN coalesce(a.assumed, []) <> coalesce(b.assumed, []) THEN 'assumptions' END), ''), 'unchanged') END AS changes
FROM r LEFT JOIN f a ON a.id = r.id LEFT JOIN f b ON b.id = r.prev""")
def report_changes(spark, sf_dir):
    """What each version of a report changes: snapshot, methods, rating, three values, facts and assumptions."""
    price = lambda step, name: F.floor(F.col("o_totalprice") / step).alias(name)
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), "o_custkey", "o_orderdate", F.col("o_orderstatus").alias("snapshot"), F.year("o_orderdate").alias("methods"), F.col("o_orderpriority").alias("rating"), price(100000, "low"), price(50000, "base"), price(20000, "high"))
    li = read(spark, sf_dir, "lineitem")
    fact = F.concat("l_returnflag", "l_linestatus")
    facts = li.select(F.col("l_orderkey").alias("report_id"), fact.alias("fact_id"), fact.alias("content")).distinct()
    assumed = li.select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("position"), (F.col("l_linenumber") > 3).cast("string").alias("content")).distinct()
    plain = {"snapshot": "snapshot", "methods": "methods", "rating": "rating", "fair_value_low": "low", "fair_value_base": "base", "fair_value_high": "high"}
    return reports.report_changes(o, facts, assumed, "o_custkey", ["o_orderdate", "report_id"], plain)


_FIELDS = {"supplemental_evidence": ["evidence_id"], "processing_attachments": ["path", "digest"], "organized_disclosures": ["kind", "evidence_id", "period"], "statements": ["evidence_id"], "financial_cell_resolutions": ["metric", "period", "evidence_id"]}


@query("""WITH m AS (SELECT ['supplemental_evidence', 'processing_attachments', 'organized_disclosures', 'statements', 'financial_cell_resolutions'][l_linenumber % 5 + 1] AS field, nullif(CAST(l_orderkey // 4 AS VARCHAR), '0') AS ev, CASE WHEN l_quantity > 5 THEN l_returnflag END AS kind, CAST(year(l_shipdate) AS VARCHAR) AS period, CASE WHEN l_quantity > 10 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END AS path, CASE WHEN l_quantity > 15 THEN CAST(l_partkey AS VARCHAR) END AS dg, l_linestatus AS st FROM lineitem),
  k AS (SELECT field, st, CASE WHEN field IN ('supplemental_evidence', 'statements') THEN CASE WHEN ev IS NOT NULL THEN [ev] END WHEN field = 'processing_attachments' THEN CASE WHEN path <> '' OR dg IS NOT NULL THEN [path, dg] END WHEN field = 'organized_disclosures' THEN [kind, ev, period] ELSE [st, period, ev] END AS key FROM m)
SELECT field, outcome, CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT field, key, count(*) AS n, CASE WHEN key IS NULL THEN 'identity_missing' WHEN min(st) <> max(st) THEN 'conflicting_material' ELSE 'kept' END AS outcome FROM k GROUP BY 1, 2) GROUP BY 1, 2""")
def merged_materials(spark, sf_dir):
    """U4: materials of an older and a newer list by the key of their field: kept, in conflict, or without identity."""
    text = lambda c: F.col(c).cast("string")
    li = read(spark, sf_dir, "lineitem")
    names = F.array(*map(F.lit, _FIELDS))
    m = li.select(
        F.element_at(names, F.col("l_linenumber") % 5 + 1).alias("field"), F.nullif(F.expr("cast(l_orderkey div 4 as string)"), F.lit("0")).alias("evidence_id"), F.when(F.col("l_quantity") > 5, F.col("l_returnflag")).alias("kind"), F.year("l_shipdate").cast("string").alias("period"),
        F.when(F.col("l_quantity") > 10, text("l_suppkey")).otherwise("").alias("path"), F.when(F.col("l_quantity") > 15, text("l_partkey")).alias("digest"), F.col("l_linestatus").alias("metric"), F.col("l_linestatus").alias("status"), "l_linenumber",
    )
    out = reports.merged_by_field(m.where("status = 'F'").drop("l_linenumber"), m.where("status <> 'F'").drop("l_linenumber"), _FIELDS, ["status"])
    return out.groupBy("field", "outcome").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))


@query("""WITH l AS (SELECT l_partkey AS metric, CAST(l_shipdate AS DATE) AS day, l_quantity AS value, CASE WHEN l_returnflag = 'R' THEN 'CNY' ELSE 'USD' END AS unit, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS definition, l_orderkey * 10 + l_linenumber AS fact FROM lineitem),
  g AS (SELECT metric, day, count(DISTINCT value) + CASE WHEN count(value) < count(*) AND count(value) > 0 THEN 1 ELSE 0 END > 1 OR count(DISTINCT unit) > 1 OR count(DISTINCT definition) + CASE WHEN count(definition) < count(*) AND count(definition) > 0 THEN 1 ELSE 0 END > 1 AS conflict, any_value(value) AS value, any_value(unit) AS unit, any_value(definition) AS definition, count(DISTINCT fact) AS n_facts, min(fact) AS first_fact, max(fact) AS last_fact FROM l GROUP BY 1, 2)
SELECT metric, day, CASE WHEN NOT conflict THEN value END AS value, CASE WHEN NOT conflict THEN unit END AS unit, CASE WHEN NOT conflict THEN definition END AS definition, conflict, n_facts, first_fact, last_fact FROM g""")
def united_series(spark, sf_dir):
    """Values of a metric and day out of all lines: one where value, unit and definition agree, with its facts united."""
    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("metric"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("value"), F.when(F.col("l_returnflag") == "R", "CNY").otherwise("USD").alias("unit"), F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("definition"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"),
    )
    return reports.merged_facts(li, ["metric", "day"], ["value", "unit", "definition"], "fact")
