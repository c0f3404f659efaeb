"""Nulls, ties, repeated rows, empty tables and streams."""

import pytest
from pyspark.sql import functions as F

from pitlake.functions import finance, rules, text
from pitlake.operators import analytics, evidence, versions
from pitlake.sources import tables
from pitlake.streaming import events as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reasons(spark):
    df = spark.createDataFrame([(1, 5), (9, None), (None, None)], "a int, b int")
    checks = (("big", F.col("a") > 4), ("none", F.col("b").isNull()))
    got = df.select(rules.reasons(*checks).alias("r"), rules.first_reason(*checks).alias("f")).collect()
    assert [(r.r, r.f) for r in got] == [([], None), (["big", "none"], "big"), (["none"], "none")]


def test_versions(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 9), (4, None)], "id long, old long")
    assert rows(versions.heads(df, "id", "old").select("id")) == [(2,), (3,), (4,)]
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (3, "c"), (4, "d"), (4, "e")], "k long, p string")
    add, clash = versions.immutable_append(table, new, "k", "p")
    assert rows(add.select("k", "p")) == [(3, "c")] and rows(clash.select("k")) == [(2,), (4,)]
    left = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), ("b", 5, 3)], "k string, t int, i int")
    right = spark.createDataFrame([("a", 5, 7.0), ("a", 3, 6.0), ("a", 6, 8.0)], "k string, since int, v double")
    assert rows(versions.as_of(left, right, ["k"], "t", "since", ["v"]).select("i", "v")) == [(1, 7.0), (2, None), (3, None)]


def test_lineage(spark):
    e = spark.createDataFrame([(3, 2), (2, 1), (2, 1), (5, 5), (6, 7), (7, 6), (8, None)], "c long, p long")
    assert rows(evidence.lineage(e, "c", "p")) == [(2, 1), (3, 1), (3, 2), (5, 5), (6, 6), (6, 7), (7, 6), (7, 7)]
    assert rows(evidence.lineage(e.limit(0), "c", "p")) == []


def test_conflicts_and_differences(spark):
    c = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, "k", "x"), (4, "k", None)], "id long, k string, v string")
    assert rows(evidence.conflicting(c, ["k"], "v").select("id", "conflict")) == [(1, True), (2, True), (3, False), (4, False)]
    a = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k long, v long")
    b = spark.createDataFrame([(1, None), (2, None), (4, 1)], "k long, v long")
    assert rows(evidence.difference(a, b, "k", ["v"])) == [(2, "changed"), (3, "added"), (4, "removed")]


def test_peers_with_many_ties(spark):
    data = [(i, 10.0, "g") for i in range(1, 30)] + [(50, 11.0, "g"), (51, None, "g"), (52, -1.0, "g"), (53, 1.0, "h")]
    got = analytics.nearest_peers(spark.createDataFrame(data, "k long, s double, w string"), "k", "s", ["w"], 3)
    by = {k: [r.peer for r in sorted(got.where(F.col("k") == k).collect(), key=lambda r: r["rank"])] for k in (1, 20, 50, 51, 53)}
    assert by == {1: [2, 3, 4], 20: [1, 2, 3], 50: [1, 2, 3], 51: [], 53: []}


def test_groups(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8)], "a long, b long")
    assert rows(analytics.linked_groups(e, "a", "b")) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]


def test_finance(spark):
    one = spark.range(1)
    flows = finance.projected(F.lit(100.0), F.array(F.lit(0.1)))
    got = one.select(finance.discounted_value(flows, F.lit(0.1), F.lit(0.0)).alias("v"), finance.discounted_value(flows, F.lit(0.1), F.lit(0.2)).alias("n"), finance.to_cny(F.lit(2.0), F.lit("亿元")).alias("c"), finance.to_cny(F.lit(2.0), F.lit("?")).alias("u")).first()
    assert got.v == pytest.approx(100 + 1000) and got.n is None and got.c == 2e8 and got.u is None


def test_html(spark):
    df = spark.createDataFrame([("<p>a&amp;b<script>x</script>  c</p>",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(text.html_text(F.col("h"))).collect()] == ["a&b c", None, ""]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    tables.write_manifested(df, df.where("id < 3").select("id"), "id", str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    with pytest.raises(ValueError):
        tables.write_manifested(df, spark.createDataFrame([(9,)], "id long"), "id", str(tmp_path / "n"))
    with pytest.raises(Exception):  # noqa: B017
        tables.write_snapshot(df, str(tmp_path / "m"))
    (tmp_path / "j.json").write_text('{"id": 1}\nnot json\n')
    good, bad = tables.read_json(spark, str(tmp_path / "j.json"), "id long")
    assert (good.count(), bad.count()) == (1, 1)


def test_stream_equals_batch(spark, tmp_path):
    data = [(f"2024-01-01 0{h}:{m:02d}:00", k, 1.0) for h in range(4) for m in (1, 30, 59) for k in ("x", "y")]
    df = spark.createDataFrame(data, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = streams.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("windows")) == rows(streams.windowed(df))
