"""Statements and dimension tables out of the texts of filings: sections, labels that wrap, numbers between labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.operators.grids import compact

#: Titles of the consolidated statements and what each must hold, in the order they are judged.
STATEMENTS = {
    "balance_sheet": ("合并资产负债表", ["资产总计", "负债合计"]),
    "income_statement": ("合并利润表", ["净利润"]),
    "cash_flow_statement": ("合并现金流量表", ["经营活动", "投资活动", "筹资活动"]),
}
HEADING = "^(合并|母公司)(资产负债表|利润表|现金流量表|所有者权益变动表)$"
SIGNATURE = "公司负责人[：:]"
REPORTS = {"年度报告": "-12-31", "半年度报告": "-06-30", "第一季度报告": "-03-31", "第三季度报告": "-09-30"}
#: Units that money is printed in.
SCALES = {"亿元": 100_000_000.0, "百万元": 1_000_000.0, "万元": 10_000.0, "千元": 1_000.0, "元": 1.0}
NUMBER = r"[-+]?[0-9][0-9,，]*(?:\.[0-9]+)?"


def numbered_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line_no, line) of every line; a form feed ends a page and a line."""
    return docs.select(id_col, F.posexplode(F.split(text, "\r?\n|\f")).alias("line_no", "line"))


def filing_period(first_page: Column) -> Column:
    """The period that a filing's first page names (in its first 180 characters without blanks); null if it names none."""
    found = F.regexp_extract(F.substring(compact(first_page), 1, 180), r"(20[0-9]{2})年(年度报告|半年度报告|第一季度报告|第三季度报告)", 0)
    ends = F.create_map(*[F.lit(x) for kv in REPORTS.items() for x in kv])
    return F.when(found != "", F.concat(F.substring(found, 1, 4), F.try_element_at(ends, F.substring(found, 6, 10))))


def sections(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, kind, line_no, line): the lines of the first consolidated statement of each kind, from its heading to the next
    heading of any statement, the signature or the end, whichever is first. Later statements of a kind are
    restatements and don't count."""
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    squeezed = compact(F.col("line"))
    lines = numbered_lines(docs, id_col, text).withColumn("squeezed", squeezed)
    title = F.when(F.col("squeezed").rlike(HEADING), F.col("squeezed"))
    lines = lines.withColumn("at", F.last(F.when(title.isNotNull(), F.struct(F.col("line_no").alias("start"), title.alias("title"))), ignorenulls=True).over(w))
    kinds = F.create_map(*[F.lit(x) for k, (t, _) in STATEMENTS.items() for x in (t, k)])
    lines = lines.where("at is not null").select(id_col, "line_no", "line", "squeezed", F.col("at.start").alias("start"), F.try_element_at(kinds, F.col("at.title")).alias("kind"))
    own = Window.partitionBy(id_col, "kind")
    here = Window.partitionBy(id_col, "kind", "start").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.where("kind is not null").withColumn("first", F.min("start").over(own)).where("start = first")
    return lines.withColumn("signed", F.max(F.col("line").rlike(SIGNATURE)).over(here)).where("not signed").select(id_col, "kind", "line_no", "line", "squeezed")


def statement_outcomes(docs: DataFrame, id_col: str, text: str, ticker: str, period: str) -> DataFrame:
    """(id, outcome, n_statements): `ok` for three complete statements of the right company and period, else the first
    thing that is wrong. A null text is a filing of another company."""
    found = sections(docs, id_col, text).groupBy(id_col, "kind").agg(*[F.max(F.col("squeezed").contains(w)).alias(w) for _, need in STATEMENTS.values() for w in need])
    whole = F.coalesce(*[F.when(F.col("kind") == k, F.least(F.lit(True), *[F.col(w) for w in need])) for k, (_, need) in STATEMENTS.items()])
    judged = found.select(id_col, "kind", whole.alias("whole")).groupBy(id_col).agg(F.count("*").alias("n"), *[F.max((F.col("kind") == k) & ~F.col("whole")).alias(k) for k in STATEMENTS])
    page = F.split(text, "\f")[0]
    printed = filing_period(page)
    out = docs.select(id_col, F.coalesce(F.contains(compact(page), F.col(ticker)), F.lit(False)).alias("same"), printed.alias("printed"), F.col(period).cast("string").alias("wanted")).join(judged, id_col, "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    outcome = F.when(~F.col("same"), "statement_company_mismatch").when(F.col("printed").isNull(), "filing_period_not_identified").when(~F.coalesce(F.col("printed") == F.col("wanted"), F.lit(False)), "statement_period_mismatch")
    for k in STATEMENTS:
        outcome = outcome.when(F.coalesce(k, F.lit(False)), f"incomplete_statement:{k}")
    return out.select(id_col, outcome.when(n != 3, "three_statements_not_identified").otherwise("ok").alias("outcome"), n.alias("n_statements"))


def numbers_of(line: Column) -> Column:
    """The numbers of a line as doubles; references to notes (七、5 or 附注5) and percentages aren't values."""
    bare = F.regexp_replace(line, r"[一二三四五六七八九十]+[、.]\s*[0-9]+(?![0-9.,])|附注\s*[0-9]+|[0-9.]+\s*[%％]", " ")
    return F.transform(F.regexp_extract_all(bare, F.lit(f"({NUMBER})")), lambda x: F.regexp_replace(x, "[,，+]", "").cast("double"))


def statement_values(found: DataFrame, id_col: str, labels: list[str]) -> DataFrame:
    """(id, kind, label, line_no, value, prior): for each label in a section the first two numbers between it and the
    next label, in the section's unit. A label is printed on one to four lines, of which only the last has numbers;
    it is the shortest run of lines that makes a label. Its first place in a section counts; a label without a number has
    no value."""
    w = Window.partitionBy(id_col, "kind").orderBy("line_no")
    said = F.regexp_replace(F.regexp_replace(compact(F.col("line")), r"(附注|[一二三四五六七八九十]+[、.])?[0-9,，.%％+\-]+.*$", ""), "[：:]$", "")
    lines = found.withColumn("words", said).withColumn("numbers", numbers_of(F.col("line"))).where("words <> '' or size(numbers) > 0")
    joined, hit, alone = F.col("words"), F.lit(None).cast("string"), F.lit(True)
    for k in range(4):
        if k:
            alone = alone & (F.coalesce(F.size(F.lag("numbers", -(k - 1)).over(w)) if k > 1 else F.size("numbers"), F.lit(1)) == 0)
            joined = F.concat(joined, F.coalesce(F.lead("words", k).over(w), F.lit("\0")))
        hit = F.coalesce(hit, F.when(alone & (F.col("words") != "") & joined.isin(labels), joined))
    lines = lines.withColumn("label", hit)
    lines = lines.withColumn("of", F.sum(F.col("label").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("of > 0")
    unit = F.regexp_extract("line", "单位\\s*[：:]?\\s*(亿元|百万元|万元|千元|元)", 1)
    scales = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    scale = found.groupBy(id_col, "kind").agg(F.min(F.when(unit != "", F.struct("line_no", unit.alias("unit"))))["unit"].alias("unit"))
    runs = lines.groupBy(id_col, "kind", "of").agg(F.max("label").alias("label"), F.min("line_no").alias("line_no"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "numbers"))), lambda x: x["numbers"])).alias("numbers"))
    first = F.row_number().over(Window.partitionBy(id_col, "kind", "label").orderBy("line_no"))
    runs = runs.withColumn("nth", first).where("nth = 1 and size(numbers) > 0").join(scale, [id_col, "kind"])
    by = F.coalesce(F.try_element_at(scales, F.when(F.col("unit").isNotNull(), F.col("unit"))), F.lit(1.0))
    value = lambda i: F.round(F.try_element_at("numbers", F.lit(i)) * by, 4)
    return runs.select(id_col, "kind", "label", "line_no", value(1).alias("value"), value(2).alias("prior"))


def aligned_cells(lines: DataFrame, id_col: str, gap: int = 2) -> DataFrame:
    """(id, line_no, column_no, text): cells of fixed-width tables (one for each id). Cells of a line are apart by `gap`
    blanks or more; cells of several lines are in one column as far as their places overlap, through other cells
    too. Numbers are aligned right and words left, so that no single edge would do."""
    pieces = F.filter(F.split("line", f"(?<=\\s{{{gap}}})(?=\\S)"), lambda x: F.trim(x) != "")
    starts = F.transform(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)))
    cells = lines.withColumn("line", F.regexp_replace("line", r"\s+$", "")).where("line <> ''").withColumn("pieces", pieces).withColumn("starts", starts)
    cells = cells.select(id_col, "line_no", F.explode(F.arrays_zip("pieces", "starts")).alias("x"))
    text = F.regexp_replace("x.pieces", r"\s+$", "")
    lead = F.length("x.pieces") - F.length(F.ltrim("x.pieces"))
    cells = cells.select(id_col, "line_no", F.trim("x.pieces").alias("text"), (F.col("x.starts") + lead).alias("first"), (F.col("x.starts") + F.length(text) - 1).alias("last"))
    w = Window.partitionBy(id_col).orderBy("first", "last", "line_no")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("opens", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    return cells.select(id_col, "line_no", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("column_no"), "text")


#: What dimension tables are headed by and end with, their groups, fragments of their header lines.
SEGMENT_HEADING = "占公司营业收入或营业利润10%以上的行业、产品、地区、销售模式的情况"
SEGMENT_ENDS = ["公司主营业务数据统计口径", "公司实物销售收入是否大于劳务收入"]
CAPACITY_HEADING = "不同产品或业务的产销情况"
VOLUME_HEADING = "公司实物销售收入是否大于劳务收入"
VOLUME_ENDS = ["相关数据同比发生变动", "公司已签订的重大销售合同"]
GROUPS = {"分业务": "business", "分行业": "business", "分客户所处行业": "business", "分产品": "product", "分地区": "region", "分销售模式": "channel"}
VOLUMES = {"生产量": "production_volume", "销售量": "sales_volume", "库存量": "ending_inventory_volume"}
RESETS = "营业收入|营业成本|毛利率|比上年|同期增减|设计产能|在建产能|产能利用率|投资建设|^---page|^[0-9]+/[0-9]+$"


def line_values(line: Column) -> Column:
    """The numbers of a line that holds nothing else, percent signs aside, a change in words last (增加 is plus, 减少 minus);
    null for any other line."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"\s+", " "), "[％%]", ""), "−", "-"))
    change = F.regexp_extract(flat, rf"(增加|减少)\s*({NUMBER})\s*个?百?(分点)?$", 0)
    signed = F.regexp_extract(change, f"({NUMBER})", 1)
    rest = F.when(change != "", F.substring(flat, F.lit(1), F.length(flat) - F.length(change))).otherwise(flat)
    plain = lambda x: F.transform(F.regexp_extract_all(x, F.lit(f"({NUMBER})")), lambda v: F.regexp_replace(v, "[,，+]", "").cast("double"))
    last = F.regexp_replace(signed, "[,，+]", "").try_cast("double") * F.when(change.startswith("减少"), -1.0).otherwise(1.0)
    found = F.concat(plain(rest), F.when(change != "", F.array(last)).otherwise(F.array().cast("array<double>")))
    return F.when(rest.rlike(r"^[-+0-9,，.\s]*$") & (F.size(found) > 0), found)


def table_region(lines: DataFrame, id_col: str, heading: str, ends: list[str]) -> DataFrame:
    """The lines between the first that holds the heading and the next that holds one of the ends, with `heading_no`."""
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("squeezed", compact(F.col("line")))
    marked = lines.withColumn("heading_no", F.min(F.when(F.col("squeezed").contains(heading), F.col("line_no"))).over(w)).where("line_no > heading_no")
    ended = F.max(F.greatest(*[F.col("squeezed").contains(e) for e in [*ends, "\0"]])).over(w)
    return marked.withColumn("ended", ended).where("not ended").drop("ended")


def dimension_rows(region: DataFrame, id_col: str, expected: int) -> DataFrame:
    """(id, dimension, name, line_no, values): rows of a table in which a name may wrap over lines and its `expected`
    numbers may be spread over others. A name line after numbers starts a row, a group or header line ends one; a row
    that gets too few numbers, or no name, is none."""
    groups = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    values = line_values(F.col("line"))
    ignored = (F.col("squeezed") == "") | F.col("squeezed").rlike("[√□]适用|^不适用$|^(单位|币种)[：:]|^(吨|元|万元|亿元|单位|币种：人民币|币种:人民币)$")
    kind = F.when(F.try_element_at(groups, F.col("squeezed")).isNotNull(), "group").when(values.isNotNull(), "numbers").when(ignored, "ignored").when(F.col("squeezed").rlike(RESETS), "reset").when(F.col("squeezed").rlike("[一-鿿]") & (F.length("squeezed") <= 60) & ~F.col("squeezed").rlike("^(注|说明)[：:]"), "name").otherwise("ignored")
    w = Window.partitionBy(id_col).orderBy("line_no")
    kept = region.withColumn("values", values).withColumn("what", kind).where("what <> 'ignored'").withColumn("before", F.lag("what").over(w))
    opens = F.col("what").isin("group", "reset") | ((F.col("what") == "name") & (F.coalesce(F.col("before"), F.lit("")) != "name"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("run", F.sum(opens.cast("int")).over(so_far)).withColumn("dimension", F.last(F.when(F.col("what") == "group", F.try_element_at(groups, F.col("squeezed"))), ignorenulls=True).over(so_far))
    ordered = lambda what, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("line_no", F.col(c).alias("x"))))), lambda s: s["x"])
    rows = kept.groupBy(id_col, "dimension", "run").agg(F.min("line_no").alias("line_no"), F.array_join(ordered("name", "squeezed"), "").alias("name"), F.flatten(ordered("numbers", "values")).alias("values"))
    return rows.where((F.col("name") != "") & (F.size("values") >= expected)).select(id_col, "dimension", "name", "line_no", F.slice("values", 1, expected).alias("values"))


def money_scale(lines: DataFrame, id_col: str, heading: str) -> DataFrame:
    """(id, scale): the unit of money named within three lines above the first heading and seven below, the largest if
    several; 1 if none."""
    at = lines.where(compact(F.col("line")).contains(heading)).groupBy(id_col).agg(F.min("line_no").alias("at"))
    near = lines.join(at, id_col).where("line_no between at - 3 and at + 7")
    unit = F.regexp_extract("line", "单位\\s*[：:]?\\s*(亿元|百万元|万元|千元|元)", 1)
    scales = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return near.groupBy(id_col).agg(F.coalesce(F.max(F.try_element_at(scales, F.when(unit != "", unit))), F.lit(1.0)).alias("scale"))


def segment_facts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, dimension, name, revenue, cost, margin, status): segments of revenue, in units of one, the margin as a share.
    The status compares the printed margin with that of revenue and cost: `consistent` within 0.0002, else `conflict`;
    null without revenue."""
    lines = numbered_lines(docs, id_col, text)
    rows = dimension_rows(table_region(lines, id_col, SEGMENT_HEADING, SEGMENT_ENDS), id_col, 6).where("dimension is not null").join(money_scale(lines, id_col, SEGMENT_HEADING), id_col)
    v = lambda i: F.col("values")[i]
    gap = F.abs(v(2) / 100 - (v(0) - v(1)) / v(0))
    status = F.when(v(0) != 0, F.when(gap <= 0.0002, "consistent").otherwise("conflict"))
    return rows.select(id_col, "dimension", "name", F.round(v(0) * F.col("scale"), 2).alias("revenue"), F.round(v(1) * F.col("scale"), 2).alias("cost"), F.round(v(2) / 100, 6).alias("margin"), status.alias("status"))


def capacity_facts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, name, unit, capacity, building, utilization): the unit stands in brackets behind the name."""
    rows = dimension_rows(table_region(numbered_lines(docs, id_col, text), id_col, CAPACITY_HEADING, [VOLUME_HEADING]), id_col, 4)
    bracket = r"[（(]([^（）()]+)[)）]$"
    unit = F.regexp_extract("name", bracket, 1)
    return rows.select(id_col, F.regexp_replace("name", bracket, "").alias("name"), F.when(unit != "", unit).alias("unit"), F.col("values")[0].alias("capacity"), F.col("values")[1].alias("building"), F.round(F.col("values")[2] / 100, 6).alias("utilization"))


def volume_facts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, name, metric, unit, value): volumes made, sold and kept; a name line holds for the metrics below it, the line
    between a metric and its numbers is the unit."""
    region = table_region(numbered_lines(docs, id_col, text), id_col, VOLUME_HEADING, VOLUME_ENDS).where("squeezed <> '' and squeezed not rlike '[√□]适用|^(行业分类|项目|单位|同比增减)$'")
    metrics = F.create_map(*[F.lit(x) for kv in VOLUMES.items() for x in kv])
    w = Window.partitionBy(id_col).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    metric, values = F.try_element_at(metrics, F.col("squeezed")), line_values(F.col("line"))
    kept = region.withColumn("metric", metric).withColumn("values", values)
    kept = kept.withColumn("after", F.lag("metric").over(w)).withColumn("is_unit", F.col("metric").isNull() & F.col("values").isNull() & F.col("after").isNotNull())
    name = F.when(F.col("metric").isNull() & F.col("values").isNull() & ~F.col("is_unit"), F.col("squeezed"))
    kept = kept.withColumn("name", F.last(name, ignorenulls=True).over(so_far)).withColumn("run", F.sum(F.col("metric").isNotNull().cast("int")).over(so_far)).where("run > 0 and name is not null")
    own = Window.partitionBy(id_col, "run")
    rows = kept.withColumn("unit", F.max(F.when(F.col("is_unit"), F.col("squeezed"))).over(own)).withColumn("of", F.max("metric").over(own)).where("values is not null")
    first = F.row_number().over(Window.partitionBy(id_col, "run").orderBy("line_no"))
    return rows.withColumn("nth", first).where("nth = 1").select(id_col, "name", F.col("of").alias("metric"), "unit", F.col("values")[0].alias("value"))


def concentration_facts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, side, amount, share): what the five largest customers and suppliers make up, each from its first sentence."""
    flat, out = compact(F.col(text)), []
    scales = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    for side, who, total in (("customers", "客户", "销售"), ("suppliers", "供应商", "采购")):
        said = rf"前五名{who}(?:合计)?{total}(?:金?额)?({NUMBER})(亿元|百万元|万元|千元|元)[，,]?占年度{total}总额(?:的)?(?:比例)?([0-9.]+)[%％]"
        amount = F.regexp_replace(F.regexp_extract(flat, said, 1), "[,，+]", "").try_cast("double") * F.try_element_at(scales, F.regexp_extract(flat, said, 2))
        out.append(F.struct(F.lit(side).alias("side"), F.round(amount, 2).alias("amount"), F.round(F.regexp_extract(flat, said, 3).try_cast("double") / 100, 6).alias("share")))
    return docs.select(id_col, F.inline(F.array(*out))).where("amount is not null")
