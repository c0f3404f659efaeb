import re

import pytest
from pyspark.sql import functions as F

from pitlake.operators import slots


def test_spans(spark):
    texts = {1: "12万元 and 3.5亿元\f7元", 2: "", 3: None, 4: "é日1,000股", 5: "5%x5%\f\f5%", 6: "none"}
    fields = {"amount": "[0-9][0-9,.]*[万亿]?元", "shares": "[0-9][0-9,]*[万亿]?股", "ratio": "[0-9.]+%"}
    df = spark.createDataFrame(list(texts.items()), "doc long, text string")
    got = {(r.doc, r.field, r.nth, r.start, r.end, r.page, r.value) for r in slots.spans(df, "doc", "text", fields).collect()}
    assert got == {(i, f, n, m.start(), m.end(), 1 + t[: m.start()].count("\f"), m[0]) for i, t in texts.items() for f, p in fields.items() for n, m in enumerate(re.finditer(p, t or ""))}


def test_scaled(spark):
    want = {"12万元": 120000.0, "3.5 亿元": 350000000.0, "1,000股": 1000.0, "12.5%": 0.125, "7": None, "万元": None, "-2元": -2.0}
    df = spark.createDataFrame([(x,) for x in want], "v string")
    assert {r.v: r.n for r in df.select("v", slots.scaled(df.v).alias("n")).collect()} == want


def test_identity(spark):
    rows = [
        (1, "lawsuit", {"plan_id": "P 1", "case_number": ""}, None, "lawsuit:plan_id:p1"), (2, "x", {"bond_code": "B", "case_number": "C"}, "2020年", "x:case_number:c"), (3, "dividend", {}, "公司2021年半年度分红", "dividend:2021:中期"),
        (4, "dividend", None, "2021年分红", "dividend:2021:年度"), (5, "dividend", {}, "分红", None), (6, "pledge", {}, "2021年", None), (7, "dividend", {"other": "z"}, "2022年第一季度", "dividend:2022:第一季度"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "i long, kind string, terms map<string,string>, summary string")
    assert {r.i: r.x for r in df.select("i", slots.event_identity(F.col("kind"), F.col("terms"), F.col("summary")).alias("x")).collect()} == {r[0]: r[4] for r in rows}


def test_filled(spark):
    plan = {"margin": ("divide", "profit", "revenue"), "profit": ("subtract", "revenue", "cost"), "revenue": ("fact", "rev"), "cost": ("fact", "cost"), "twice": ("add", "margin", "margin")}
    facts = spark.createDataFrame([(1, "rev", 10.0), (1, "cost", 4.0), (2, "rev", 5.0), (2, "cost", None), (3, "rev", 0.0), (3, "cost", 1.0), (4, "rev", 1.0), (4, "rev", 2.0), (4, "cost", 0.0)], "e long, metric string, value double")
    got = {(r.e, r.slot): (r.state, r.value, r.lacks) for r in slots.filled_slots(facts, "e", plan).collect()}
    assert got[1, "margin"] == ("derived", 0.6, []) and got[1, "revenue"] == ("present", 10.0, []) and got[1, "twice"] == ("derived", 1.2, [])
    assert got[2, "cost"] == ("missing", None, ["cost"]) and got[2, "twice"] == ("missing", None, ["cost"]) and got[2, "revenue"][0] == "present"
    assert got[3, "margin"] == ("undefined", None, []) and got[3, "twice"][0] == "undefined" and got[4, "margin"] == ("derived", 1.0, [])
    for bad in ({"a": ("add", "a", "a")}, {"a": ("add", "b", "c")}, {"a": ("power", "a", "a")}):
        with pytest.raises(ValueError, match="slot"):
            slots.filled_slots(facts, "e", bad)
