"""Tables of unknown shape: spans, header depth, merged parents, context, captions, units, issues."""

import pytest
from pyspark.sql import functions as F

from pitlake.operators import grids


def rows_of(spark, tables, before=""):
    """Grids as rows: None is a place that a merged cell may cover."""
    data = [(1, t, before if t == 1 else "", i, r) for t, rows in enumerate(tables, 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc long, table_no int, before string, row_no int, texts array<string>")


def read(spark, tables, before="", title=""):
    rows = rows_of(spark, tables, before)
    t = grids.note_tables(rows, "doc", title)
    found = grids.note_rows(rows, t, "doc")
    cells = {(r.table_no, r.row_no, r.column_no): r for r in grids.note_cells(found, "doc").collect()}
    return {r.table_no: r for r in t.collect()}, cells, {r.table_no: r.issues for r in grids.note_issues(found, t, "doc").collect()}


def test_three_header_rows(spark):
    grid = [
        ["类别", "期末余额", None, None, None, None, "期初余额", None, None, None, None],
        [None, "账面余额", None, "坏账准备", None, "账面价值", "账面余额", None, "坏账准备", None, "账面价值"],
        [None, "金额", "比例(%)", "金额", "计提比例(%)", None, "金额", "比例(%)", "金额", "计提比例(%)", None],
        ["组合", "10", "100", "1", "10", "9", "8", "100", "0", "0", "8"],
    ]
    t, cells, issues = read(spark, [grid], "单位：元 币种：人民币")
    assert t[1].depth == 3 and t[1].headers[0] == "类别" and issues == {1: []}
    assert t[1].headers[1:6] == ["期末余额 / 账面余额 / 金额", "期末余额 / 账面余额 / 比例(%)", "期末余额 / 坏账准备 / 金额", "期末余额 / 坏账准备 / 计提比例(%)", "期末余额 / 账面价值"]
    assert t[1].headers[10] == "期初余额 / 账面价值"
    assert (cells[1, 3, 3].unit, cells[1, 3, 3].currency) == ("%", None) and (cells[1, 3, 6].value, cells[1, 3, 6].unit, cells[1, 3, 6].currency) == ("9", "元", "CNY")


def test_context_and_continuation(spark):
    first = [["项目", "房屋", "合计"], ["一、账面原值", None, None], ["2.本期增加金额", "5", "5"], ["（1）外币折算", "1", "1"], ["3.本期减少金额", "3", "3"], ["（1）外币折算", "2", "2"]]
    t, cells, issues = read(spark, [first, [["4.期末余额", "20", "1,020.50"]], [["", "", ""], ["其他", "-", "正在办理"]], [["x", "1"]], [["y", "1", "2"]]])
    labels = {k[:2]: r.label for k, r in cells.items()}
    assert labels[1, 3] == "账面原值 / 本期增加金额 / 外币折算" and labels[1, 5] == "账面原值 / 本期减少金额 / 外币折算"
    assert labels[2, 0] == "账面原值 / 期末余额" and cells[2, 0, 2].at_date and cells[2, 0, 3].value == "1020.50"
    assert [t[i].chain for i in range(1, 6)] == [1] * 5 and labels[3, 1] == "账面原值 / 其他"
    assert (cells[3, 1, 2].state, cells[3, 1, 3].state, cells[3, 1, 3].value, cells[3, 1, 3].unit) == ("not_applicable_or_dash", "disclosed_text", "正在办理", "原文文字")
    assert issues == {1: [], 2: [], 3: [], 4: ["continuation_without_matching_header"], 5: ["continuation_without_matching_header"]}


def test_issues(spark):
    _, cells, issues = read(spark, [[["项目", "期末余额", ""], ["a", "1", "2"], ["a", "3", "4"], ["", "5", "6"], ["b", "7"], ["", "", ""]]])
    assert issues == {1: ["column_count_mismatch", "column_header_missing", "repeated_row_label", "row_label_missing"]}
    assert {k[1:]: r.value for k, r in cells.items()} == {(1, 2): "1", (2, 2): "3"}


@pytest.mark.parametrize(("before", "want"), [
    ("(1)\n收到其他与经营活动有关的现金\n√适用□不适用\n单位：元", "收到其他与经营活动有关的现金"), ("(2)支付其他与经营活动有关的现金\n单位：元", "支付其他与经营活动有关的现金"),
    ("其他应付款\n项目列示\n单位：元", "项目列示"), ("1、固定资产：\n支付 1,234.00 元", "固定资产"), ("3.\n单位：元", "title"), ("", "title"),
])
def test_captions(spark, before, want):
    assert spark.createDataFrame([(before,)], "b string").select(grids.caption(F.col("b"), F.lit("title"))).first()[0] == want


def test_html(spark):
    page = """<p>1. A &amp; B</p><TABLE class=x><tr><th rowspan="2">项目</th><th colspan=2>期末余额</th></tr><tr><td>金额</td><td>比例&#40;%&#x29;</td></tr>
    <tr><td>甲&nbsp;&#39;&amp;lt;</td><td> 1,000 </td><td>5</td></tr></table> 单位：万元<table><tr><td>乙</td><td>2</td><td>3</td></tr>"""
    df = spark.createDataFrame([(7, page, "clash"), (8, None, ""), (9, "", ""), (10, "<p>none</p>", ""), (11, "<table></table><table><tr></tr></table>", "")], "doc long, html string, texts string")
    rows = {(r.doc, r.table_no, r.row_no): (r.before.strip(), r.texts) for r in grids.html_rows(df, "doc", "html").collect()}
    assert rows == {
        (7, 1, 0): ("1. A & B", ["项目", "期末余额", "期末余额"]), (7, 1, 1): ("1. A & B", ["项目", "金额", "比例(%)"]), (7, 1, 2): ("1. A & B", ["甲 '&lt;", "1,000", "5"]),
        (7, 2, 0): ("单位：万元", ["乙", "2", "3"]), (11, 2, 0): ("", []),
    }
    grid = grids.html_rows(df, "doc", "html")
    t = grids.note_tables(grid, "doc")
    cells = {(r.table_no, r.label, r.header): (r.value, r.unit) for r in grids.note_cells(grids.note_rows(grid, t, "doc"), "doc").collect()}
    assert cells == {(1, "甲'&lt;", "期末余额 / 金额"): ("1000", "原文未标单位"), (1, "甲'&lt;", "期末余额 / 比例(%)"): ("5", "%"), (2, "乙", "期末余额 / 金额"): ("2", "万元"), (2, "乙", "期末余额 / 比例(%)"): ("3", "%")}


def test_html_parts_and_plan(spark):
    """Odd tags as before the parser was rewritten: spans out of range, unclosed cells and tables, entities that make
    entities, blanks of other kinds; and no table is taken apart by interpreted array functions any more."""
    page = """a<br>b</p>&amp;lt;<table><tr><td COLSPAN='2000'>x</td></tr></TABLE >c&#0;&#xD800;&#x110000;<table class=y><tr><TH rowspan=0>\u00a0 p \n<td
    colspan=2>&#38;#65;<b>q</b><td<tr ><td>&#65;&#38;#65;</table>d<table><td>none</td></table>"""
    got = grids.html_rows(spark.createDataFrame([(1, page), (2, None)], "doc long, html string"), "doc", "html")
    rows = [(r.table_no, r.before, r.row_no, r.texts) for r in got.collect()]
    assert rows == [(1, "a\nb\n&lt;", 0, ["x"] * 1000), (2, "c\ufffd\ufffd&#x110000;", 0, ["\u00a0 p", "&#65;q<td", "&#65;q<td"]), (2, "c\ufffd\ufffd&#x110000;", 1, ["A&#65;"])]
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_text_tables(spark):
    text = "intro\n项目 | 期末余额 | \n | 金额 | 比例\na | 1 | 2\nbetween\n单位：元\n| b | 3 | 4 |\n"
    grid = grids.text_rows(spark.createDataFrame([(1, text), (2, None), (3, "no table")], "doc long, text string"), "doc", "text")
    t = grids.note_tables(grid, "doc")
    cells = {(r.table_no, r.label, r.header): r.value for r in grids.note_cells(grids.note_rows(grid, t, "doc"), "doc").collect()}
    assert cells == {(1, "a", "期末余额 / 金额"): "1", (1, "a", "期末余额 / 比例"): "2", (2, "b", "期末余额 / 金额"): "3", (2, "b", "期末余额 / 比例"): "4"}
    assert {r.table_no: r.before for r in grid.collect()} == {1: "intro", 2: "between\n单位：元"}


def test_empty(spark):
    rows = rows_of(spark, [[["项目", "金额"]]]).limit(0)
    t = grids.note_tables(rows, "doc")
    assert t.count() == grids.note_rows(rows, t, "doc").count() == 0
