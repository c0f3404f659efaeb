"""Notes read page by page against the windows over rows of any source."""

import random
from collections import Counter

from pitlake.operators import grids, notes
from pitlake.plans import filings

HEADS = ["项目", "类别", "期末余额", "期初余额", "金额", "比例(%)", "数量", "股数", "", "  ", "　", "甲", "利率％", "合计", "1,0"]
LABELS = ["一、原值", "二.甲", "十、", "其中：", "其中:", "按账龄分类", "按分类", "1.增加", "2．减少", "3、其他", "（1）甲", "(2)乙", "（3）", "", "  ", "甲", "乙", "末 期", "1.", "一、甲： "]
VALUES = ["1,000", "-", "—", "/", "不适用", " 5 ", "1，0.5", "+3", "1e5", ".5", "售&#32602;", "", " \t", "文字", "-2", "+", "a\x85", "3  "]
BEFORE = ["单位：万元", "单位 ： 股", "单位:元 币种：美元", "(1)按商品列示：", "（2）\n收到现金", "3.\n单位：元", "<p>项目列示</p>", "<br>1、固定资产：\n支付 1,234.00 元", "工程物资", "取得投资", "√适用", "5、", "1. A &amp; B。 ", "x "]


def pages(seed, n):
    r = random.Random(seed)

    def cell(x):
        t = r.choice(["td", "td", "th", "TD"])
        return f"<{t}{r.choice(['', '', '', ' colspan=2', ' rowspan="2"'])}>{x}{r.choice([f'</{t}>'] * 6 + ['', '</td >'])}"

    def table():
        w, rows = r.choice([1, 2, 3, 4, 4, 5]), []
        for _ in range(r.choice([0, 0, 1, 1, 1, 2, 3, 5])):
            rows.append("".join(cell(r.choice(HEADS)) for _ in range(r.choice([w, w, w - 1]))))
        for _ in range(r.randrange(7)):
            blank, plain = r.random() < 0.25, r.random() < 0.7
            texts = [r.choice(LABELS) if i == 0 else "" if blank else r.choice(VALUES) for i in range(r.choice([w] * 8 + [w - 1, w + 1, 0]))]
            rows.append("".join(f"<td>{x}</td>" if plain else cell(x) for x in texts))
        return r.choice(["<table>", "<TABLE class=x>"]) + "".join(r.choice(["<tr>", "<TR a=b>"]) + x + r.choice(["</tr>", "</tr>", "", "</tr>\n"]) for x in rows) + r.choice(["</table>"] * 5 + ["</TABLE >", ""])

    same = [table() for _ in range(5)]
    return ["".join("".join(r.sample(BEFORE, r.randrange(4))) + (r.choice(same) if r.random() < 0.3 else table()) for _ in range(r.randrange(5))) + r.choice(["", "</table>x"]) for _ in range(n)]


def test_pages_are_read_as_rows_are(spark):
    """Odd pages: the same cells and issues as by windows over the rows of their tables."""
    df = spark.createDataFrame([*enumerate(pages(4, 1500)), (9001, None), (9002, ""), (9003, "a</table>b<table><tr><td>x</td></tr>")], "doc long, html string").repartition(4)
    grid = grids.html_rows(df, "doc", "html").cache()
    tables = grids.note_tables(grid, "doc", "存货")
    found = grids.note_rows(grid, tables, "doc")
    for old, new in ((grids.note_cells(found, "doc"), notes.html_cells(df, "doc", "html", "存货")), (grids.note_issues(found, tables, "doc"), notes.html_issues(df, "doc", "html", "存货"))):
        assert old.schema.simpleString() == new.schema.simpleString()
        old, new = (Counter(map(repr, x.collect())) for x in (old, new))
        assert old == new and old.total() > 1000
    assert notes.html_cells(df.limit(0), "doc", "html").count() == notes.html_issues(df.where("doc >= 9001 and doc < 9003"), "doc", "html").count() == 0


def test_notes_are_not_shuffled(spark):
    """Once pages are rendered, no window, sort or shuffle of their rows follows."""
    for query in (filings.note_table_cells, filings.note_table_issues):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan.partition("MapInArrow")[0] and "Window" not in plan
