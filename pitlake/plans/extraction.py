"""Registered queries of documents, tables in texts, chunks, exports and folds, with their SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.functions import text
from pitlake.operators import extraction
from pitlake.operators.analytics import shared_dir
from pitlake.plans.queries import ORACLES, query
from pitlake.sources import tables
from pitlake.sources.tables import read

#: A report of each customer as text, in SQL for both ({s}: the string type).
_REPORT = """concat('cover of ', c_name, chr(10), CASE WHEN c_custkey % 9 = 0 THEN 'no tables here' ELSE concat('合并资产负债表 单位：', CASE WHEN c_custkey % 3 = 0 THEN '万元' ELSE '元' END, chr(10), '货币资金 ', CAST(c_nationkey * 1000 AS {s}), ' ', CAST(c_nationkey AS {s}), chr(10), '  ', chr(10), '资产总计 ', CAST(c_custkey * 11 AS {s}), ',000', chr(10), '法定代表人', chr(10), 'signed 5', chr(10)) END,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('合并利润表', chr(10), '营业收入 ', CAST(c_custkey AS {s}), '.50 -', CAST(c_nationkey AS {s}), chr(10), '法定代表人', chr(10)) END, '合并现金流量表 单位：亿元', chr(10), '现金净增加 -', CAST(c_custkey AS {s}), chr(10), '占比 50%')"""
_LINES = f"""d AS (SELECT c_custkey, string_split({_REPORT.format(s="VARCHAR")}, chr(10)) AS ls FROM customer), l AS (SELECT c_custkey, CAST(i - 1 AS INT) AS line_no, trim(ls[i]) AS line FROM d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)), k AS (SELECT *, regexp_matches(line, '^合并.*表') AS h, line = '法定代表人' AS e, CASE WHEN contains(line, '单位：') THEN CASE regexp_extract(line, '单位：(百万元|千元|万元|亿元|元)', 1) WHEN '万元' THEN 10000e0 WHEN '亿元' THEN 100000000e0 ELSE 1e0 END END AS sc FROM l WHERE line <> ''),
s AS (SELECT *, last_value(CASE WHEN h THEN line WHEN e THEN '' END IGNORE NULLS) OVER w AS section, last_value(sc IGNORE NULLS) OVER w AS scale FROM k WINDOW w AS (PARTITION BY c_custkey ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
r AS (SELECT c_custkey, line_no, section, trim(regexp_extract(line, '^([^0-9-]+)', 1)) AS label, regexp_extract_all(line, '-?[0-9][0-9,]*(\\.[0-9]+)?') AS ns, coalesce(scale, 1) AS scale FROM s WHERE section <> '' AND NOT h AND NOT e AND NOT contains(line, '%'))"""


def _reports(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.expr(_REPORT.format(s="STRING")).alias("t"))


@query(f"""WITH {_LINES} SELECT c_custkey, line_no, section, label, round(CAST(replace(ns[1], ',', '') AS DOUBLE) * scale, 4) AS value, len(ns) AS n_numbers FROM r WHERE label <> '' AND len(ns) > 0""")
def report_tables(spark, sf_dir):
    """Rows of the tables in a report by section, label and scaled numbers."""
    rows = extraction.table_rows(extraction.text_lines(_reports(spark, sf_dir), "c_custkey", "t"), "c_custkey", "^合并.*表", "^法定代表人$")
    return rows.select("c_custkey", "line_no", "section", "label", F.round(F.col("numbers")[0] * F.col("scale"), 4).alias("value"), F.size("numbers").cast("long").alias("n_numbers"))


@query(f"""WITH {_LINES}, k3 AS (SELECT c_custkey, CASE WHEN section LIKE '%资产负债表%' THEN 'balance' WHEN section LIKE '%利润表%' THEN 'income' ELSE 'cash' END AS kind, bool_or(label IN ('资产总计', '营业收入', '现金净增加')) AS total FROM r WHERE label <> '' AND len(ns) > 0 GROUP BY 1, 2)
SELECT customer.c_custkey, count(kind) AS n_statements, coalesce(bool_and(total), false) AND count(kind) = 3 AS accepted FROM customer LEFT JOIN k3 ON k3.c_custkey = customer.c_custkey GROUP BY 1""")
def statements(spark, sf_dir):
    """Exactly three statements with their totals, or none."""
    rows = extraction.table_rows(extraction.text_lines(_reports(spark, sf_dir), "c_custkey", "t"), "c_custkey", "^合并.*表", "^法定代表人$")
    kind = F.when(F.col("section").contains("资产负债表"), "balance").when(F.col("section").contains("利润表"), "income").otherwise("cash")
    k = rows.groupBy("c_custkey", kind.alias("kind")).agg(F.bool_or(F.col("label").isin("资产总计", "营业收入", "现金净增加")).alias("total")).groupBy("c_custkey").agg(F.count("*").alias("n"), F.every("total").alias("total"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(k, "c_custkey", "left").select("c_custkey", n.alias("n_statements"), (F.coalesce("total", F.lit(False)) & (n == 3)).alias("accepted"))


@query("""WITH h AS (SELECT p_partkey, ['item', 'year', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'prior' END, ''] AS hs, ['a', CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR), CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE '7' END] AS cs FROM part), c AS (SELECT p_partkey, i, cs[i] AS cell, CASE WHEN hs[i] <> '' THEN hs[i] WHEN hs[i - 1] <> '' THEN hs[i - 1] ELSE hs[i - 2] END AS header FROM h, (SELECT unnest([2, 3, 4]) AS i))
SELECT p_partkey, i AS column_no, header, CAST(cell AS DOUBLE) AS value, CASE WHEN cell IS NULL THEN 'missing_cell' END AS issue FROM c""")
def note_cells(spark, sf_dir):
    """Cells of a note's table with merged headers filled, and what is wrong with them."""
    k = F.col("p_partkey")
    headers = F.array(F.lit("item"), F.lit("year"), F.when(k % 2 == 0, "").otherwise("prior"), F.lit(""))
    cells = F.array(F.lit("a"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.when(k % 5 != 0, "7"))
    t = read(spark, sf_dir, "part").select("p_partkey", extraction.filled_headers(headers).alias("h"), cells.alias("c"))
    out = t.select("p_partkey", F.posexplode(F.arrays_zip("h", "c")).alias("i", "x")).where("i > 0")
    return out.select("p_partkey", (F.col("i") + 1).alias("column_no"), F.col("x.h").alias("header"), F.col("x.c").cast("double").alias("value"), F.when(F.col("x.c").isNull(), "missing_cell").alias("issue"))


@query("SELECT page_id, sha256(text) AS text_sha256, length(text) AS n_chars, CASE WHEN text = '' THEN 'empty' ELSE 'parsed' END AS status FROM (" + ORACLES["html_text"] + ")")
def ingested_documents(spark, sf_dir):
    """Documents as text, with its hash and length."""
    p = read(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n_chars"), F.when(F.col("t") == "", "empty").otherwise("parsed").alias("status"))


@query("SELECT page_id, html AS text FROM pages")
def decoded_pages(spark, sf_dir):
    """Bytes in several declared charsets as text."""
    k, html = F.col("page_id"), F.col("html")
    raw = F.when(k % 3 == 0, F.encode(html, "UTF-16LE")).when(k % 3 == 1, F.encode(html, "UTF-8")).otherwise(F.encode(html, "UTF-8"))
    names = F.when(k % 3 == 0, "utf-16-le").when(k % 3 == 1, "UTF-8").otherwise("no-such-charset")
    return extraction.decoded(read(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), names.alias("charset")), "page_id", "raw", "charset").select("page_id", "text")


@query("""SELECT conv_id, turn, CAST(greatest(1, ceil(strlen(text) / 400.0)) AS BIGINT) <= count_ AS at_least, bytes = strlen(text) AS whole FROM (SELECT conv_id, turn, text, strlen(text) AS bytes, CAST(greatest(1, ceil(strlen(text) / 400.0)) AS BIGINT) AS count_ FROM conversations WHERE text IS NOT NULL)""")
def text_chunks(spark, sf_dir):
    """Texts in chunks of at most 400 bytes: as many as it takes, and together the whole text."""
    c = read(spark, sf_dir, "conversations").where("text is not null").select(F.struct("conv_id", "turn", F.octet_length("text").alias("n")).alias("k"), "text")
    chunks = extraction.utf8_chunks(c, "k", "text", 400)
    g = chunks.groupBy("k").agg(F.count("*").alias("m"), F.sum(F.octet_length("chunk")).alias("bytes"), F.max(F.octet_length("chunk")).alias("most"))
    return g.select("k.conv_id", "k.turn", ((F.greatest(F.lit(1), F.ceil(F.col("k.n") / 400)) <= F.col("m")) & (F.col("most") <= 400)).alias("at_least"), (F.col("bytes") == F.col("k.n")).alias("whole"))


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def manifested_export(spark, sf_dir):
    """A snapshot of exactly a manifest's rows, written as a whole and read back."""
    import uuid

    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    manifest = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    tables.write_manifested(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), manifest, "o_orderkey", path)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""SELECT l_orderkey, count(*) AS n_spans, string_agg(span, ',' ORDER BY span) AS spans FROM (SELECT DISTINCT l_orderkey, l_suppkey % 5 || ':' || l_returnflag AS span FROM lineitem) GROUP BY 1""")
def evidence_spans(spark, sf_dir):
    """Evidence spans of a fact, each once."""
    span = F.concat((F.col("l_suppkey") % 5).cast("string"), F.lit(":"), F.col("l_returnflag"))
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(span)).alias("s"))
    return g.select("l_orderkey", F.size("s").cast("long").alias("n_spans"), F.array_join("s", ",").alias("spans"))


@query("""WITH t(term, topic) AS (VALUES ('ring', 'jewels'), ('widget', 'tools'), ('red', 'colour'), ('small', 'size')) SELECT p_partkey, topic FROM part JOIN t ON contains(p_name, term)""")
def recalled_topics(spark, sf_dir):
    """Topics whose terms a title holds."""
    terms = {"ring": "jewels", "widget": "tools", "red": "colour", "small": "size"}
    topics = F.array_compact(F.array(*[F.when(F.col("p_name").contains(t), F.lit(topic)) for t, topic in terms.items()]))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(topics).alias("topic"))


@query("""WITH w AS (SELECT o_custkey AS company, 1 AS stage, 'price' AS item FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_custkey, 2, 'price' FROM orders UNION ALL SELECT o_custkey, 3, 'status' FROM orders WHERE o_orderstatus = 'P'), d AS (SELECT company, item, min(stage) AS stage FROM w GROUP BY 1, 2)
SELECT company, item, stage, row_number() OVER (PARTITION BY company ORDER BY stage, item) AS position FROM d""")
def work_queue(spark, sf_dir):
    """A company's next work, each item once at its earliest stage."""
    o = read(spark, sf_dir, "orders")
    part = lambda df, stage, item: df.select(F.col("o_custkey").alias("company"), F.lit(stage).alias("stage"), F.lit(item).alias("item"))
    w = reduce(DataFrame.union, [part(o.where("o_totalprice > 400000"), 1, "price"), part(o, 2, "price"), part(o.where("o_orderstatus = 'P'"), 3, "status")])
    d = w.groupBy("company", "item").agg(F.min("stage").alias("stage"))
    return d.withColumn("position", F.row_number().over(Window.partitionBy("company").orderBy("stage", "item")))


@query("""WITH s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, coalesce(value, 0), event_id) AS seq FROM events) SELECT user_id, count(*) AS n, sha256(string_agg(seq || ':' || event_id, ',' ORDER BY seq)) AS semantic_hash, count(DISTINCT event_id) = count(*) AS ids_unique, min(seq) = 1 AND max(seq) = count(*) AS sequence_closed FROM s GROUP BY 1""")
def governance_snapshots(spark, sf_dir):
    """Deltas in one sequence, a semantic hash that makes equal snapshots one, and the invariants."""
    w = Window.partitionBy("user_id").orderBy("ts", F.coalesce("value", F.lit(0.0)), "event_id")
    s = read(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("seq"))
    g = s.groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "event_id"))).alias("r"), F.countDistinct("event_id").alias("d"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    text_ = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["event_id"].cast("string"))), ",")
    return g.select("user_id", "n", F.sha2(text_, 256).alias("semantic_hash"), (F.col("d") == F.col("n")).alias("ids_unique"), ((F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("sequence_closed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'total_shares' WHEN l_returnflag = 'R' THEN 'float_shares' WHEN l_returnflag = 'A' THEN 'holder_position' END AS basis FROM lineitem""")
def ratio_bases(spark, sf_dir):
    """The denominator of a holding ratio by data set and field; unknown ones stay unnamed."""
    names = F.create_map(*[F.lit(x) for kv in {"R|F": "total_shares", "R|O": "float_shares", "A|F": "holder_position", "A|O": "holder_position"}.items() for x in kv])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.try_element_at(names, F.concat_ws("|", "l_returnflag", "l_linestatus")).alias("basis"))


@query()
def role_tenures(spark, sf_dir):
    """Tenures of a company's people out of appointments, acting roles, resignations and dismissals; tested
    against a plain loop."""
    return extraction.role_tenures(role_deltas(spark, sf_dir))


def role_deltas(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    e = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "appoint").when(F.col("event_type") == "purchase", "acting").when(F.col("event_type") == "error", "dismiss").otherwise("resign")
    role = F.when(action != "resign", F.when(k % 3 == 0, "chair").otherwise("director"))
    return e.select((F.col("user_id") % 40).alias("company"), (F.col("user_id") % 7).alias("person"), role.alias("role"), action.alias("action"), F.col("ts").alias("at"), "event_id")
