"""Registered queries of filings: their tables, statements and dimension tables. The filings are rendered by Spark from
whole tables, with the layouts that make parsing hard; the SQL takes the same values from the tables and parses nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.operators import grids, notes, statements
from pitlake.plans.queries import query
from pitlake.sources.tables import read


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note of each order as HTML: one, two or three header rows with merged cells, groups, numbered and inner items,
    a second table without a header from line 5 on; blank labels, a short row, dashes and words among numbers."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_discount").cast("decimal(4,2)").alias("disc"), F.col("l_tax").cast("decimal(4,2)").alias("tax"), F.col("l_quantity").cast("int").alias("qty")).alias("x"),
    )
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("ls"))
    line = """concat(CASE WHEN i = 0 OR ls[i - 1].flag <> x.flag THEN concat('<tr><td>一、', x.flag, '</td><td></td><td></td><td></td></tr>') ELSE '' END,
      '<tr><td>', CASE WHEN x.tax = 0 THEN '' WHEN (i + 1) % 2 = 1 THEN concat(i + 1, '.商品', x.part) ELSE concat('（', i + 1, '）商品', x.part) END, '</td><td>', format_number(x.price, 2),
      '</td><td>', CASE WHEN x.disc = 0 THEN '—' ELSE cast(cast(100 * x.disc as int) as string) END, '</td>', CASE WHEN i = 6 THEN '' ELSE concat('<td> ', CASE WHEN x.qty = 50 THEN '售&#32602;' ELSE cast(x.qty as string) END, '</td>') END, '</tr>')"""
    head = """CASE o_orderstatus WHEN 'O' THEN '<tr><th>项目</th><th>期末金额</th><th>计提比例(%)</th><th>数量</th></tr>'
      WHEN 'F' THEN '<tr><th rowspan="2">项目</th><th colspan="2">期末余额</th><th rowspan=2>数量</th></tr><tr><th>金额</th><th>比例(%)</th></tr>'
      ELSE '<tr><th rowspan="3">类别</th><th colspan="2">期末余额</th><th>期初余额</th></tr><tr><th colspan="2">账面余额</th><th rowspan="2">数量</th></tr><tr><th>金额</th><th>比例(%)</th></tr>' END"""
    said = "concat('<p>', CASE o_orderstatus WHEN 'O' THEN '(1)按商品列示：' WHEN 'F' THEN '项目列示' ELSE '' END, '</p>单位：', CASE WHEN o_orderpriority < '3' THEN '万元' ELSE '元' END, ' 币种：', CASE WHEN o_orderpriority LIKE '%SPEC%' THEN '美元' ELSE '人民币' END)"
    some = lambda where: f"array_join(transform(filter(transform(ls, (x, i) -> struct(x, i)), y -> {where}), y -> {line.replace('x.', 'y.x.').replace('i =', 'y.i =').replace('i + 1', 'y.i + 1').replace('[i - 1]', '[y.i - 1]')}), '')"
    page = f"concat({said}, '<table>', {head}, {some('y.i < 4')}, '</table>', CASE WHEN size(ls) > 4 THEN concat('<p>续表</p><table>', {some('y.i >= 4')}, '</table>') ELSE '' END)"
    return o.join(rows, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.expr(page).alias("html"))


_NOTES = """l AS (SELECT o_orderkey, o_orderstatus AS st, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)), l_discount, l_tax, l_quantity) AS n, l_returnflag AS flag, '商品' || l_partkey AS part, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax, CAST(l_quantity AS INT) AS qty,
    CASE WHEN o_orderpriority < '3' THEN '万元' ELSE '元' END AS unit, CASE WHEN o_orderpriority LIKE '%SPEC%' THEN 'USD' ELSE 'CNY' END AS currency FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  c AS (SELECT *, CASE WHEN coalesce(lag(flag) OVER (PARTITION BY o_orderkey ORDER BY n) = flag, false) THEN 0 ELSE 1 END AS change, CASE WHEN n <= 4 THEN 1 ELSE 2 END AS table_no FROM l),
  g AS (SELECT *, sum(change) OVER (PARTITION BY o_orderkey ORDER BY n) AS run, CASE WHEN table_no = 2 THEN 0 WHEN st = 'O' THEN 1 WHEN st = 'F' THEN 2 ELSE 3 END + sum(change + 1) OVER (PARTITION BY o_orderkey, table_no ORDER BY n) - 1 AS row_no FROM c),
  i AS (SELECT *, last_value(CASE WHEN n % 2 = 1 AND n <> 7 AND tax <> 0 THEN part END IGNORE NULLS) OVER (PARTITION BY o_orderkey, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS item FROM g),
  r AS (SELECT *, flag || ' / ' || CASE WHEN n % 2 = 1 THEN part WHEN item IS NOT NULL THEN item || ' / ' || part ELSE '（' || n || '）' || part END AS label FROM i)"""


@query(f"""WITH {_NOTES}, v AS (SELECT *, unnest([2, 3, 4]) AS column_no FROM r WHERE tax <> 0 AND n <> 7)
SELECT o_orderkey, table_no, CAST(row_no AS INTEGER) AS row_no, column_no, CASE st WHEN 'O' THEN '按商品列示' WHEN 'F' THEN '项目列示' ELSE '存货' END AS section, label,
  CASE column_no WHEN 2 THEN CASE st WHEN 'O' THEN '期末金额' WHEN 'F' THEN '期末余额 / 金额' ELSE '期末余额 / 账面余额 / 金额' END WHEN 3 THEN CASE st WHEN 'O' THEN '计提比例(%)' WHEN 'F' THEN '期末余额 / 比例(%)' ELSE '期末余额 / 账面余额 / 比例(%)' END ELSE CASE WHEN st IN ('O', 'F') THEN '数量' ELSE '期初余额 / 数量' END END AS header,
  CASE column_no WHEN 2 THEN CAST(price AS VARCHAR) WHEN 3 THEN CASE WHEN disc <> 0 THEN CAST(CAST(100 * disc AS INT) AS VARCHAR) END ELSE CASE WHEN qty = 50 THEN '售罚' ELSE CAST(qty AS VARCHAR) END END AS value,
  CASE WHEN column_no = 3 AND disc = 0 THEN 'not_applicable_or_dash' WHEN column_no = 4 AND qty = 50 THEN 'disclosed_text' ELSE 'ready' END AS state,
  CASE column_no WHEN 2 THEN unit WHEN 3 THEN '%' ELSE CASE WHEN qty = 50 THEN '原文文字' ELSE '原表列单位' END END AS unit, CASE WHEN column_no = 2 THEN currency END AS currency,
  CASE column_no WHEN 2 THEN true WHEN 3 THEN st <> 'O' ELSE st = 'P' END AS at_date FROM v""")
def note_table_cells(spark, sf_dir):
    """Every cell of the notes' HTML tables with its header path, row context, state, unit and currency."""
    return notes.html_cells(_notes(spark, sf_dir), "o_orderkey", "html", "存货")


@query(f"""WITH {_NOTES}, p AS (SELECT o_orderkey, table_no, CASE WHEN n = 7 THEN 'column_count_mismatch' WHEN tax = 0 THEN 'row_label_missing' WHEN row_number() OVER (PARTITION BY o_orderkey, table_no, n = 7, CASE WHEN tax = 0 THEN NULL ELSE label END ORDER BY n) > 1 THEN 'repeated_row_label' END AS issue FROM r)
SELECT o_orderkey, table_no, coalesce(string_agg(DISTINCT issue, ',' ORDER BY issue), '') AS issues FROM p GROUP BY ALL""")
def note_table_issues(spark, sf_dir):
    """What is wrong with each of the notes' tables."""
    found = notes.html_issues(_notes(spark, sf_dir), "o_orderkey", "html", "存货")
    return found.select("o_orderkey", "table_no", F.array_join("issues", ",").alias("issues"))


@query("""WITH l AS (SELECT doc_id, ls[i] AS line, i FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
  f AS (SELECT *, contains(line, '|') AS is_row, contains(line, '|') AND NOT coalesce(contains(lag(line) OVER (PARTITION BY doc_id ORDER BY i), '|'), false) AS first FROM l),
  t AS (SELECT *, CAST(sum(CAST(first AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS table_no FROM f),
  r AS (SELECT doc_id, table_no, CAST(row_number() OVER (PARTITION BY doc_id, table_no ORDER BY i) - 1 AS INTEGER) AS row_no, string_split(regexp_replace(line, '^[ \\t]*\\|(.*)\\|[ \\t]*$', '\\1'), '|') AS cells FROM t WHERE is_row)
SELECT doc_id, table_no, row_no, CAST(c AS INTEGER) AS column_no, nullif(trim(cells[c]), '') AS text FROM r, LATERAL (SELECT unnest(range(1, len(cells) + 1)) AS c)""")
def document_table_cells(spark, sf_dir):
    """The cells of tables drawn with bars in the documents' own texts."""
    rows = grids.text_rows(read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "table_no", "row_no", F.posexplode("texts").alias("i", "text")).select("doc_id", "table_no", "row_no", (F.col("i") + 1).alias("column_no"), "text")


#: A report of each customer with the statements of its orders, in SQL: another company's first page, no or another period,
#: totals and statements left out, notes and signatures in between, a second statement of a kind behind the third.
_STATEMENTS = """concat(CASE WHEN c_mktsegment = 'MACHINERY' THEN 'X' ELSE 'C' END, c_custkey, ' 公司', chr(10), CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE concat(y, ' 年 ', element_at(array('第一季度报告', '半年度报告', '第三季度报告', '年度报告'), q)) END, chr(10), '目录', chr(12),
  '合并资产负债表', chr(10), '单位：', CASE WHEN q <= 2 THEN '万元' ELSE '元' END, chr(10), '应收账款 七、', q, ' ', format_number(total, 2), ' ', c_acctbal, chr(10), '合同', chr(10), '资产', chr(10), ' ', n, ' 30', chr(10), '其中', chr(10), '商誉附注12 ', CASE WHEN n > 12 THEN '' ELSE concat('-', n) END, chr(10),
  CASE WHEN n = 3 THEN '' ELSE concat('资产总计 ', c_custkey, '%', ' 5', chr(10)) END, '负债合计', chr(10), CASE WHEN c_nationkey < 12 THEN concat('公司负责人：某', chr(10), '商誉 88', chr(10)) ELSE '' END, '母公司资产负债表', chr(10), '应收账款 1', chr(10),
  '合并利润表', chr(10), '净利润 ', n, ',000.5', chr(10), CASE WHEN c_nationkey = 5 THEN '' ELSE concat('合并现金流量表', chr(10)) END, '经营活动 1', chr(10), '投资活动 2', chr(10), '筹资活动 3', chr(10), '合并资产负债表', chr(10), '应收账款 666', chr(10), '商誉 7')"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.max(F.col("o_orderdate").cast("date")).alias("d"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"))
    t = c.join(o, F.col("c_custkey") == F.col("k")).withColumns({"y": F.year("d"), "q": F.quarter("d")})
    period = "concat(CASE WHEN c_mktsegment = 'FURNITURE' THEN y - 1 ELSE y END, element_at(array('-03-31', '-06-30', '-09-30', '-12-31'), q))"
    return t.select("c_custkey", F.expr(_STATEMENTS).alias("text"), F.expr("concat('C', c_custkey)").alias("ticker"), F.expr(period).alias("period"))


_ORDERS_OF = "o AS (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS nk, CAST(c_acctbal AS DECIMAL(18,2)) AS bal, count(*) AS n, year(max(CAST(o_orderdate AS DATE))) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CASE WHEN quarter(max(CAST(o_orderdate AS DATE))) <= 2 THEN 10000e0 ELSE 1e0 END AS f FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"


@query(f"""WITH {_ORDERS_OF} SELECT c_custkey, CASE WHEN seg = 'MACHINERY' THEN 'statement_company_mismatch' WHEN seg = 'HOUSEHOLD' OR y < 2000 THEN 'filing_period_not_identified' WHEN seg = 'FURNITURE' THEN 'statement_period_mismatch' WHEN n = 3 THEN 'incomplete_statement:balance_sheet'
  WHEN nk = 5 THEN 'three_statements_not_identified' ELSE 'ok' END AS outcome, CASE WHEN nk = 5 THEN 2 ELSE 3 END::BIGINT AS n_statements FROM o""")
def statement_outcomes(spark, sf_dir):
    """Company, period, first consolidated statements, their totals: three good ones or the first thing wrong."""
    return statements.statement_outcomes(_statements(spark, sf_dir), "c_custkey", "text", "ticker", "period")


@query(f"""WITH {_ORDERS_OF}, v AS (SELECT c_custkey, unnest([{{'kind': 'balance_sheet', 'label': '应收账款', 'value': total * f, 'prior': bal::DOUBLE * f}}, {{'kind': 'balance_sheet', 'label': '合同资产', 'value': n * f, 'prior': 30 * f}},
  {{'kind': 'balance_sheet', 'label': '商誉', 'value': CASE WHEN n <= 12 THEN -n * f END, 'prior': NULL}}, {{'kind': 'balance_sheet', 'label': '资产总计', 'value': CASE WHEN n <> 3 THEN 5 * f END, 'prior': NULL}}, {{'kind': 'income_statement', 'label': '净利润', 'value': n * 1000 + 0.5e0, 'prior': CASE WHEN nk = 5 THEN 1e0 END}}]) AS x FROM o)
SELECT c_custkey, x.kind AS kind, x.label AS label, round(x.value, 4) AS value, round(x.prior, 4) AS prior FROM v WHERE x.value IS NOT NULL""")
def statement_values(spark, sf_dir):
    """The numbers between consecutive labels of the first statement of each kind, in units of one; labels over
    several lines, references to notes, numbers behind the signature left out."""
    found = statements.sections(_statements(spark, sf_dir), "c_custkey", "text")
    return statements.statement_values(found, "c_custkey", ["应收账款", "合同资产", "商誉", "资产总计", "负债合计", "净利润"]).drop("line_no")


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each supplier: what it sold by maker of the part and by way of shipping, its capacity and volumes by
    brand, its largest numbers in a sentence; names over two lines, numbers over one to three, changes in words."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("mode"), "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_tax").cast("decimal(4,2)").alias("tax"))
    t = li.join(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rev, cost, qty = F.sum("price"), F.sum((F.col("price") * F.col("tax")).cast("decimal(18,2)")), F.sum(F.col("l_quantity").cast("long"))
    pick = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("name"), "rev", "cost", "qty")))
    by = lambda c, name: t.groupBy("l_suppkey", c).agg(rev.alias("rev"), cost.alias("cost"), qty.alias("qty")).groupBy("l_suppkey").agg(pick(c).alias(name))
    j = by("p_type", "mfgr").join(by("mode", "modes"), "l_suppkey").join(by("p_brand", "brands"), "l_suppkey")
    margin = "format_number(100 * (x.rev - x.cost) / x.rev, 2)"
    products = f"array_join(transform(mfgr, x -> concat('厂', chr(10), '名 ', x.name, chr(10), format_number(x.rev, 2), ' ', format_number(x.cost, 2), chr(10), {margin}, '% 1 2', chr(10), '3')), chr(10))"
    modes = f"array_join(transform(modes, x -> concat('方式', x.name, '  ', chr(10), x.rev, '  ', x.cost, '  ', CASE WHEN x.qty > 100 THEN {margin} ELSE '7.5' END, ' 1 2 减少 1.5 个百分点')), chr(10))"
    capacity = "array_join(transform(brands, x -> concat('牌', x.name, '（件）', chr(10), x.qty, ' ', size(brands), ' ', 50, '% 0')), chr(10))"
    volumes = "array_join(transform(mfgr, x -> concat('厂', x.name, chr(10), '销售量', chr(10), '件', chr(10), format_number(x.qty, 0), chr(10), '5', chr(10), '库存量', chr(10), -x.qty)), chr(10))"
    text = f"""concat('单位：千元', chr(10), '{statements.SEGMENT_HEADING}', chr(10), '√适用 □不适用', chr(10), '营业收入 营业成本 毛利率', chr(10), '分产品', chr(10), {products}, chr(10), '分销售模式', chr(10), {modes}, chr(10), '孤', chr(10), '1 2', chr(10), '{statements.SEGMENT_ENDS[0]}', chr(10),
      '{statements.CAPACITY_HEADING}', chr(10), {capacity}, chr(10), '{statements.VOLUME_HEADING}', chr(10), '行业分类', chr(10), {volumes}, chr(10), '{statements.VOLUME_ENDS[0]}', chr(10), '前五名客户合计销售', chr(10), '金额 ', format_number(aggregate(mfgr, cast(0 as decimal(18,2)), (a, x) -> cast(a + x.rev as decimal(18,2))), 2), ' 元，占年度销售总额', size(brands), '.5%。')"""
    return j.select("l_suppkey", F.expr(text).alias("text"))


_SOLD = """li AS (SELECT l_suppkey, p_type, p_brand, l_returnflag || l_linestatus AS mode, CAST(l_quantity AS BIGINT) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey),
  d AS (SELECT l_suppkey, 'product' AS dimension, '厂名' || p_type AS name, sum(price) AS rev, sum(cost) AS cost, sum(qty) AS qty FROM li GROUP BY ALL UNION ALL SELECT l_suppkey, 'channel', '方式' || mode, sum(price), sum(cost), sum(qty) FROM li GROUP BY ALL),
  m AS (SELECT *, CASE WHEN dimension = 'channel' AND qty <= 100 THEN 7.5e0 ELSE CAST(round(100 * (rev - cost) / rev, 2) AS DOUBLE) END AS pct FROM d)"""


@query(f"""WITH {_SOLD} SELECT l_suppkey, dimension, name, round(CAST(rev AS DOUBLE) * 1000, 2) AS revenue, round(CAST(cost AS DOUBLE) * 1000, 2) AS cost, round(pct / 100, 6) AS margin, CASE WHEN abs(pct / 100 - CAST(rev - cost AS DOUBLE) / CAST(rev AS DOUBLE)) <= 0.0002 THEN 'consistent' ELSE 'conflict' END AS status FROM m""")
def segment_facts(spark, sf_dir):
    """Segments by product and channel out of reports, margins compared with revenue and cost."""
    return statements.segment_facts(_dimensions(spark, sf_dir), "l_suppkey", "text")


@query("""WITH li AS (SELECT l_suppkey, '牌' || replace(p_brand, ' ', '') AS name, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_suppkey, name, '件' AS unit, CAST(qty AS DOUBLE) AS capacity, CAST(count(*) OVER (PARTITION BY l_suppkey) AS DOUBLE) AS building, 0.5e0 AS utilization FROM li""")
def capacity_facts(spark, sf_dir):
    """Capacities with the unit in brackets behind the name."""
    return statements.capacity_facts(_dimensions(spark, sf_dir), "l_suppkey", "text")


@query("""WITH li AS (SELECT l_suppkey, '厂' || replace(p_type, ' ', '') AS name, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_suppkey, name, 'sales_volume' AS metric, '件' AS unit, qty AS value FROM li UNION ALL SELECT l_suppkey, name, 'ending_inventory_volume', NULL, -qty FROM li""")
def volume_facts(spark, sf_dir):
    """Volumes by name, metric and unit."""
    return statements.volume_facts(_dimensions(spark, sf_dir), "l_suppkey", "text")


@query("""SELECT l_suppkey, 'customers' AS side, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS amount, round((count(DISTINCT p_brand) + 0.5e0) / 100, 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def concentration_facts(spark, sf_dir):
    """What the five largest customers make up, out of a sentence that breaks over lines."""
    return statements.concentration_facts(_dimensions(spark, sf_dir), "l_suppkey", "text")
