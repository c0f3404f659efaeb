"""Folds over streams give what the batch folds give, rows out of order and in several batches; late rows, idle keys."""

import datetime as dt
import json
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pitlake.operators import analytics, extraction
from pitlake.streaming import folds

T0 = dt.datetime(2020, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set(folds.STORE, folds.ROCKS)


def streamed(spark, path, batches, schema, run):
    """All rows that come out of run over a stream of one file a batch; a last row far ahead lets all others pass."""
    name = "out"
    (path / "in").mkdir()
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        q = run(src).writeStream.format("parquet").option("path", str(path / name)).option("checkpointLocation", str(path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(str(path / name)).collect()]


def shuffled(rows, time, batches, r):
    """Batches in order of time, but for rows that come up to half a day later than others."""
    rows = sorted(rows, key=lambda x: x[time] + dt.timedelta(hours=r.random() * 12))
    size = -(-len(rows) // batches)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_series(spark, tmp_path):
    r = random.Random(1)
    schema = "k long, event_id long, identity string, available_at timestamp, closes boolean"
    rows = [(r.randrange(4), i, r.choice([None, None, "x", "y"]), day(r.random() * 600), r.random() < 0.3) for i in range(150)]
    end = [(99, 9999, None, day(3000), False)]
    got = streamed(spark, tmp_path, [*shuffled(rows, 3, 3, r), end], schema, lambda s: folds.series_links(s, ["k"]))
    want = [tuple(x) for x in analytics.series_links(spark.createDataFrame(rows, schema), ["k"]).collect()]
    assert Counter(got) == Counter(want) and any(x[3] for x in want)


def test_balance(spark, tmp_path):
    r = random.Random(2)
    schema = "k long, event_id long, ts timestamp, amount decimal(18,4)"
    rows = [(r.randrange(5), i, day(r.random() * 90), None if r.random() < 0.01 else round(r.uniform(-3, 6), 3)) for i in range(200)]
    rows = [(*x[:3], None if x[3] is None else Decimal(str(x[3]))) for x in rows]
    got = streamed(spark, tmp_path, [*shuffled(rows, 2, 3, r), [(99, 9999, day(4000), None)]], schema, lambda s: folds.running_balance(s, ["k"]))
    df = analytics.running_balance(spark.createDataFrame(rows, schema), ["k"], ["ts", "event_id"], F.col("amount"))
    want = [tuple(x) for x in df.select("k", "event_id", F.col("balance").cast("double"), "integrity").collect()]
    assert Counter(got) == Counter(want)


def test_tenures(spark, tmp_path):
    r = random.Random(3)
    schema = "company long, person long, role string, action string, at timestamp, event_id long"
    rows = []
    for i in range(160):
        action = r.choice(["appoint", "appoint", "acting", "dismiss", "resign"])
        rows.append((r.randrange(4), r.randrange(3), None if action == "resign" else r.choice(["chair", "ceo"]), action, day(r.random() * 400), i))
    got = streamed(spark, tmp_path, [*shuffled(rows, 4, 3, r), [(99, 1, "ceo", "appoint", day(4000), 9999)]], schema, folds.ended_tenures)
    batch = spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp_ntz"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    want = extraction.role_tenures(batch).where("end_at is not null").select("company", "person", "role", "start_event", us("start_at"), us("end_at"), "status")
    assert Counter(got) == Counter(tuple(x) for x in want.collect()) and got


def test_late_and_idle(spark, tmp_path):
    """A row behind the watermark is no row; after max_days without events a key starts afresh; null times and keys aside."""
    schema = "k long, event_id long, identity string, available_at timestamp, closes boolean"
    batches = [[(1, 1, "x", day(0), False), (1, 2, None, None, False), (None, 3, None, day(0), False)], [(1, 4, "x", day(100), False)], [(1, 5, "x", day(50), False)], [(1, 6, "x", day(2000), False)], [(99, 7, None, day(5000), False)]]
    got = streamed(spark, tmp_path, batches, schema, lambda s: folds.series_links(s, ["k"]))
    assert sorted(got) == [(1, 1, 1, False), (1, 4, 1, False), (1, 6, 6, False)]


def test_batch_is_no_stream(spark):
    df = spark.createDataFrame([], "k long, event_id long, ts timestamp, amount decimal(18,4)")
    with pytest.raises(ValueError, match="stream"):
        folds.running_balance(df, ["k"])


def test_rows_wait_together():
    """A batch's rows of a key are few values of its state and few rows that come out, however many they are."""

    class Held:
        def __init__(self):
            self.rows = []

        appendList = lambda self, x: self.rows.extend(x)
        put = update = lambda self, x: setattr(self, "rows", x)
        get = lambda self: self.rows or None
        exists = lambda self: bool(self.rows)
        clear = lambda self: self.rows.clear()

    class Handle:
        waiting, state, woken = Held(), Held(), []
        getListState = lambda self, *_: self.waiting
        getValueState = lambda self, *_: self.state
        registerTimer = lambda self, at: self.woken.append(at)

    class Now:
        getCurrentWatermarkInMs = lambda self: 2400

    def step(state, row):
        state["n"] += 1
        return [(row["id"], f"{state['n']}\n")]

    fold = folds.OrderedFold(step, {"n": 0}, ["k", "_made"], 10)
    fold.init(Handle())
    utc = dt.timezone.utc
    one = lambda i: Row(k=1, _time=dt.datetime.fromtimestamp(i / 1000, utc), _row=json.dumps({"_at": i * 1000, "_tie": i, "id": i}))
    assert list(fold.handleInputRows((1,), (one(i) for i in reversed(range(2500))), Now())) == []
    assert len(Handle.waiting.rows) == 3 and Handle.woken == [1]
    out = list(fold.handleExpiredTimer((1,), Now(), None))
    made = [json.loads(x) for r in out for x in r["_made"].split("\n")]
    assert len(out) == 3 and made == [[i, f"{i + 1}\n"] for i in range(2400)]
    assert len(Handle.waiting.rows) == 1 and Handle.woken[1] == 2401
