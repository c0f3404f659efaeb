"""Operators that SQL cannot express or whose edges the driver's tables do not have, against plain loops."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pitlake.functions import intake, text, valuation
from pitlake.operators import analytics, evidence, extraction, selection
from pitlake.plans import extraction as extraction_plans
from pitlake.sources import tables
from tests.oracle import DATA


def test_series_links(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").where("event_type in ('signup', 'purchase', 'view')")
    k = F.col("event_id")
    identity = F.when(k % 4 == 0, F.concat(F.lit("i"), (k % 3).cast("string")))
    rows = events.select("user_id", "event_id", identity.alias("identity"), "ts", (F.col("event_type") == "purchase").alias("closes")).withColumnRenamed("ts", "available_at")
    got = {r.event_id: (r.user_id, r.root_event_id, r.ambiguous) for r in analytics.series_links(rows, ["user_id"], max_days=3).collect()}
    by = defaultdict(list)
    for r in rows.collect():
        by[r.user_id].append(r)
    want = {}
    for user, rs in by.items():
        roots, known = {}, {}
        for r in sorted(rs, key=lambda r: (r.available_at, r.event_id)):
            fit = [e for e, (last, open_) in roots.items() if open_ and r.available_at - last <= dt.timedelta(days=3)]
            own = known.get(r.identity) if r.identity is not None else None
            root = own if own is not None else fit[0] if len(fit) == 1 and r.identity is None else r.event_id
            roots[root] = (r.available_at, not r.closes)
            if r.identity is not None:
                known[r.identity] = root
            want[r.event_id] = (user, root, own is None and r.identity is None and len(fit) > 1)
    assert got == want and any(a for *_, a in want.values())
    assert analytics.series_links(rows.limit(0), ["user_id"]).count() == 0


def test_role_tenures(spark):
    deltas = extraction_plans.role_deltas(spark, str(DATA))
    got = {(r.company, r.person, r.role, r.start_event): (r.end_at, r.status) for r in extraction.role_tenures(deltas).collect()}
    by = defaultdict(list)
    for r in deltas.collect():
        by[r.company].append(r)
    want = {}
    for company, rs in by.items():
        tenures = []  # person, role, event, end, status
        for r in sorted(rs, key=lambda r: (r["at"], r.event_id)):
            open_ = [t for t in tenures if t[3] is None]
            if r.action in ("appoint", "acting"):
                for t in open_:
                    if (t[0], t[1]) == (r.person, r.role):
                        t[3] = r["at"]
                status = "acting" if r.action == "acting" else "held"
                others = [t for t in tenures if t[3] is None and t[1] == r.role == "chair"]
                for t in others:
                    t[4] = "overlap"
                tenures.append([r.person, r.role, r.event_id, None, "overlap" if others else status])
            else:
                mine = [t for t in open_ if t[0] == r.person and r.role in (None, t[1])]
                if len(mine) == 1:
                    mine[0][3] = r["at"]
                for t in mine if len(mine) > 1 else ():
                    t[4] = "ambiguous"
        want |= {(company, p, role, e): (end, s) for p, role, e, end, s in tenures}
    assert got == want and {"ambiguous", "overlap", "acting", "held"} == {s for _, s in want.values()}


def test_chunks_and_charsets(spark):
    long = "日本語é" * 50
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, long), (5, "😀😀")], "id long, t string")
    got = defaultdict(list)
    for r in sorted(extraction.utf8_chunks(df, "id", "t", 7).collect(), key=lambda r: r.chunk_no):
        got[r.id].append(r.chunk)
    assert dict(got)[1] == ["abc"] and got[2] == [""] and 3 not in got and "".join(got[4]) == long and got[5] == ["😀", "😀"]
    assert all(len(c.encode()) <= 7 for c in got[4]) and extraction.utf8_chunks(df, "id", "t", 2).where("id = 5").count() == 2
    raw = spark.createDataFrame([(1, "年报".encode("gbk"), "GBK"), (2, "é".encode("latin-1"), "latin-1"), (3, b"\xff\xfe", "utf-8"), (4, None, "utf-8"), (5, b"ok", None)], "id long, c binary, s string")
    assert {r.id: r.text for r in extraction.decoded(raw, "id", "c", "s").collect()} == {1: "年报", 2: "é", 3: "��", 4: None, 5: "ok"}


def test_paths_and_places(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 7)], "a long, b long")
    assert [r.node for r in evidence.cycles(edges, "a", "b").collect()] == [1]
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "c long, p long")
    assert {r.node: r.root for r in selection.roots(chain, "c", "p").collect()} == {i: 0 for i in range(1, 40)}
    assert {r.node: r.depth for r in selection.depths(chain, "c", "p").collect()} == {i: i for i in range(1, 40)}
    with pytest.raises(RuntimeError):
        selection.depths(edges.where("a < 4"), "a", "b", most=5)
    rows = spark.range(500).selectExpr("id % 50 v", "id")
    got = selection.numbered(rows, [F.desc("v"), F.col("id")], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (-r.v, r.id))] == list(range(1, 501))


def test_ids_do_not_read_alike(spark):
    df = spark.createDataFrame([("a|1:b", "c"), ("a", "1:b|c"), ("", None), (None, ""), ("n", "n")], "x string, y string")
    assert df.select(text.content_id("x", "y").alias("i")).distinct().count() == 5


def test_text_fields(spark):
    df = spark.createDataFrame([("共 1,234.5 万元",), ("3 亿股",), ("无",), (None,), ("2020/13/40",), ("2021年 2月 3日",), ("12.5%",)], "t string")
    got = df.select(intake.text_amount(F.col("t")).alias("a"), intake.text_date(F.col("t")).alias("d"), intake.text_ratio(F.col("t")).alias("r")).collect()
    assert [r.a for r in got][:4] == [12345000.0, 300000000.0, None, None]
    assert [r.d for r in got][4:6] == [None, dt.date(2021, 2, 3)] and got[6].r == 0.125
    people = spark.createDataFrame([("Ａｂ c·d",), ("AB_c-D",)], "n string").select(evidence.person_key("n").alias("k")).distinct().collect()
    assert [r.k for r in people] == ["abcd"]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\nnot json\n\n{"a": "x"}\n{"a": 2}\n')
    good, bad = tables.read_json(spark, str(p), "a long")
    assert sorted(r.a for r in good.collect()) == [1, 2] and {r.line for r in bad.collect()} == {"not json", '{"a": "x"}'}


def test_scenario_failures(spark):
    base = dict(base_revenue=100.0, volume_growth=0.05, price_growth=0.02, gross_margin=0.4, expense_ratio=0.1, tax_rate=0.25, depreciation_ratio=0.03, capex_ratio=0.05, working_capital_ratio=0.1, minority_interest_ratio=0.0, non_recurring_after_tax=0.0, net_debt=10.0, shares_outstanding=10.0, wacc=0.1, terminal_growth=0.02, years=5.0)
    cases = {None: {}, "years": {"years": 21.0}, "share_outside_0_1": {"tax_rate": 1.1}, "wacc_below_growth": {"wacc": 0.02}, "revenue_or_shares": {"base_revenue": 0.0}, "last_flow_not_positive": {"capex_ratio": 0.9}, "value_not_positive": {"net_debt": 1e6}}
    df = spark.createDataFrame([{"k": str(k), **base, **v} for k, v in cases.items()])
    got = {r.k: r.s for r in df.select("k", valuation.scenario({n: F.col(n) for n in base}).alias("s")).collect()}
    assert {k: s.failure for k, s in got.items()} == {str(k): k for k in cases}
    flow, pv, revenue = 0.0, 0.0, 100.0
    for y in range(1, 6):
        new = revenue * 1.05 * 1.02
        flow = new * (0.3 * 0.75 - 0.02) - (new - revenue) * 0.1
        pv, revenue = pv + flow / 1.1**y, new
    assert abs(got["None"].fair_value - round((pv + flow * 1.02 / 0.08 / 1.1**5 - 10) / 10, 4)) < 1e-9


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)
