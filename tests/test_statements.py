"""Statements and dimension tables in texts: sections, wrapped labels, note references, groups, changes in words."""

from pitlake.operators import statements as st

PAGE = "C7 某公司\n2024 年 半年度报告\n目录\f"
BODY = """合并资产负债表
单位：万元
应收账款 七、5 1,000.50 900
合同
资产
 20 30
其他 5
商誉附注12 7
资产总计 9,999
负债合计 -1
公司负责人：张三
应收账款 77
母公司资产负债表
应收账款 1
合并利润表
净利润 3.5 4
合并现金流量表
经营活动 1
投资活动 2
筹资活动 3
合并资产负债表
应收账款 666
"""


def test_outcomes(spark):
    good = PAGE + BODY
    cases = [
        (1, good, "C7", "2024-06-30", "ok", 3), (2, good, "C8", "2024-06-30", "statement_company_mismatch", 3), (3, good, "C7", "2024-12-31", "statement_period_mismatch", 3),
        (4, good.replace("半年度报告", ""), "C7", "2024-06-30", "filing_period_not_identified", 3), (5, good.replace("净利润", "利润"), "C7", "2024-06-30", "incomplete_statement:income_statement", 3),
        (6, good.replace("合并现金流量表", "现金"), "C7", "2024-06-30", "three_statements_not_identified", 2), (7, None, "C7", "2024-06-30", "statement_company_mismatch", 0), (8, good, "C7", None, "statement_period_mismatch", 3),
        (9, good.replace("公司负责人：张三\n", "").replace("负债合计 -1\n", ""), "C7", "2024-06-30", "incomplete_statement:balance_sheet", 3), (10, "", "C7", "2024-06-30", "statement_company_mismatch", 0),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "doc long, text string, ticker string, period string")
    assert {(r.doc, r.outcome, r.n_statements) for r in st.statement_outcomes(df, "doc", "text", "ticker", "period").collect()} == {(c[0], c[4], c[5]) for c in cases}


def test_values(spark):
    df = spark.createDataFrame([(1, PAGE + BODY)], "doc long, text string")
    got = {(r.kind, r.label): (r.value, r.prior) for r in st.statement_values(st.sections(df, "doc", "text"), "doc", ["应收账款", "合同资产", "商誉", "资产总计", "负债合计", "净利润", "其他"]).collect()}
    assert got == {
        ("balance_sheet", "应收账款"): (10005000.0, 9000000.0), ("balance_sheet", "合同资产"): (200000.0, 300000.0), ("balance_sheet", "其他"): (50000.0, None), ("balance_sheet", "商誉"): (70000.0, None),
        ("balance_sheet", "资产总计"): (99990000.0, None), ("balance_sheet", "负债合计"): (-10000.0, None), ("income_statement", "净利润"): (3.5, 4.0),
    }


def test_aligned_cells(spark):
    rows = [("名称", "金额", "比例(%)"), ("甲乙丙", "1.5", "10"), ("丁", "12,000.25", "5"), ("", "", ""), ("戊 己", "3", "100.00")]
    lines = [f"{a:<8}{b:>12}{c:>10}" for a, b, c in rows]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "a  b")], "doc long, line_no int, line string")
    got = {(r.doc, r.line_no, r.column_no): r.text for r in st.aligned_cells(df, "doc").collect()}
    assert {k[2]: v for k, v in got.items() if k[:2] == (1, 2)} == {1: "丁", 2: "12,000.25", 3: "5"} and got[1, 0, 3] == "比例(%)" and got[1, 4, 1] == "戊 己"
    assert got[2, 0, 1] == "a" and got[2, 0, 2] == "b"


def test_line_values(spark):
    lines = {"1,000.5 -2 +3": [1000.5, -2.0, 3.0], "12.5% 3％": [12.5, 3.0], "5 6 减少1.5个百分点": [5.0, 6.0, -1.5], "增加 2 个百分点": [2.0], "名称 5": None, "": None, "五": None}
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.v for r in df.select("line", st.line_values(df.line).alias("v")).collect()} == lines


def test_dimensions(spark):
    text = f"""{st.SEGMENT_HEADING}
√适用 □不适用
单位：万元
营业收入 营业成本 毛利率
分产品
高端
白酒
100 40
60% 1 2 增加3个百分点
中端 酒
200 50 70 1 2 3
孤行
1 2
分地区
国内
10 5 50 1 2 减少3个百分点
注：说明
公司主营业务数据统计口径
不同产品或业务的产销情况
甲厂（万吨）
10 2 80% 1
{st.VOLUME_HEADING}
行业分类
白酒
销售量
吨
1,200
5
生产量
1,300
相关数据同比发生变动
前五名客户合计销售金额1,234.5万元，占年度销售总额12.34%。前五名供应商采购额 5 亿元，占年度采购总额比例 50 ％"""
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc long, text string")
    rows = lambda x: {tuple(r)[1:] for r in x.collect()}
    assert rows(st.segment_facts(df, "doc", "text")) == {("product", "高端白酒", 1e6, 4e5, 0.6, "consistent"), ("product", "中端酒", 2e6, 5e5, 0.7, "conflict"), ("region", "国内", 1e5, 5e4, 0.5, "consistent")}
    assert rows(st.capacity_facts(df, "doc", "text")) == {("甲厂", "万吨", 10.0, 2.0, 0.8)}
    assert rows(st.volume_facts(df, "doc", "text")) == {("白酒", "sales_volume", "吨", 1200.0), ("白酒", "production_volume", None, 1300.0)}
    assert rows(st.concentration_facts(df, "doc", "text")) == {("customers", 12345000.0, 0.1234), ("suppliers", 5e8, 0.5)}
