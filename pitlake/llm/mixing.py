"""Operator 1: mixing sources to target weights by a Pfair schedule."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pitlake.llm.common import table

NULL = "\x00"  # the group of rows without a source
EPOCHS = 4096  # repeats of a row that one task makes


def whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights, as the decimals that they are written as, as whole numbers in exactly the same proportion."""
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    exact = {s: Fraction(repr(w)) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


def schedule(shares: dict[str, int], last: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, j) in slot 0, 1, ... until each source has had its block last[source]: block j of a
    source with share w of all slots is released at floor(j / w) and due at ceil((j + 1) / w); of the released blocks
    that with the earliest deadline goes first, ties by release and name. One processor and full use: every deadline
    is met, so at each slot every source is less than one block from its share of all slots so far. Shares are whole
    numbers, so nothing is rounded. Holds one block of each source at a time."""
    n = sum(shares.values())
    waiting = [(0, s, 0) for s in shares]
    heapq.heapify(waiting)
    ready: list = []
    slot, left = 0, len(shares)
    while left:
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * n // shares[s]), release, s, j))
        due, _, s, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        yield s, j
        left -= j == last[s]
        heapq.heappush(waiting, ((j + 1) * n // shares[s], s, j + 1))
        slot += 1


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", block: int = 16, frame: int = 1024, temperature: float = 0.7, max_sources: int = 100_000, rows_per_bucket: int = 20_000, period: int = 1 << 24, keep: list[str] | None = None
) -> DataFrame:
    """Rows of docs in a mix whose every prefix has the target weights, each source within one block of its share.

    Each source's rows, in the order of a hash of the whole row, are cut into blocks of `block` rows. A Pfair schedule (see schedule)
    against the weights says which source supplies each slot. The mix ends with the slot in which the last
    source has given all its rows: every row is in it, and sources that ran out before start again (epoch 1, 2,
    ...). Adds slot, block, epoch and place (position in the mix; all long). weights: for each source, kept exactly, as
    decimals; None: (row count) ** temperature in whole shares of `period`, one at least.

    After as many slots as there are shares every source has had exactly its share, so the schedule repeats: one task
    makes that first stretch at most, slot by slot with one block of each source in memory, and it is written as a
    table; blocks of later stretches take their slots from it. With weights=None the task is bounded by `period` and
    one slot for each source at any size of docs; with given weights by the sum of their whole shares, if that is less than the mix.
    frame: slots that the task hands on at a time, without effect on the mix. keep: columns that the result has, so that no others are
    shuffled (None: all); the order is that of the whole row in any case.

    A null source is a source of its own (name it \\x00 in weights). A source that has rows must have a weight, one
    without rows is ignored; more than max_sources sources are an error, so that the counts (driver and broadcast)
    are bounded. Repeated rows are rows like others (equal ones share a bucket); rows with null ids or texts too. An empty table gives an empty
    mix. Input columns named slot, block, epoch or place are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("slot", "block", "epoch", "place")
    group = F.coalesce(F.col(source_col), F.lit(NULL)).alias("s")
    counts = {r["s"]: r["n"] for r in docs.groupBy(group).agg(F.count("*").alias("n")).limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    kept = [f for f in docs.schema.fields if keep is None or f.name in keep]
    extra = [T.StructField(n, T.LongType()) for n in ("epoch", "block", "slot", "place")]
    if not counts:
        return spark.createDataFrame([], T.StructType([*kept, *extra]))
    if weights is not None and (missing := sorted(set(counts) - set(weights))):
        raise ValueError(f"no weight for {missing[:5]}")
    if weights:
        shares = whole_shares({s: weights[s] for s in counts})
    else:
        whole = math.fsum(float(n) ** temperature for n in counts.values())
        shares = {s: max(1, round(float(n) ** temperature / whole * period)) for s, n in counts.items()}
    last, stretch = {s: (n - 1) // block for s, n in counts.items()}, sum(shares.values())

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slots, at = islice(schedule(shares, last), min(stretch, 1 << 62)), 0
                while some := list(islice(slots, frame)):
                    s, j = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(j, pa.int64()), pa.array(range(at, at + len(some)), pa.int64())], names=["s", "block", "slot"])
                    at += len(some)

    slots = table(spark.range(0, 1, 1, 1).mapInArrow(plan, "s string, block long, slot long"), "mix-slots")
    ends = spark.createDataFrame([(s, j % shares[s]) for s, j in last.items()], "s string, block long")
    total = 1 + max(last[r["s"]] // shares[r["s"]] * stretch + r["slot"] for r in slots.join(F.broadcast(ends), ["s", "block"]).collect())  # one row of each source
    if total * block >= 1 << 62:
        raise ValueError("the mix would be too long")
    turns, rest = divmod(total, stretch)
    part = {r["s"]: r["n"] for r in slots.where(F.col("slot") < rest).groupBy("s").agg(F.count("*").alias("n")).collect()}
    rows = {s: (turns * shares[s] + part.get(s, 0)) * block for s in counts}
    per_source = spark.createDataFrame([(s, n, rows[s], min(shares[s], 1 << 62)) for s, n in counts.items()], "s string, n long, rows long, share long")

    # Number the rows of each source: hash-range buckets are counted, summed up, and numbered within.
    buckets = 1 << max(0, math.ceil(math.log2(max(1, sum(counts.values()) / rows_per_bucket))))
    plain = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else F.col(f.name) for f in docs.schema.fields]
    keyed = docs.select(F.struct(*[f.name for f in kept]).alias("row"), group, F.xxhash64(*plain).alias("h"), F.xxhash64(F.lit(1), *plain).alias("t"))
    keyed = keyed.withColumn("b", F.floor((F.shiftrightunsigned("h", 33).cast("double")) / (1 << 31) * buckets).cast("int"))
    sizes = table(keyed.groupBy("s", "b").agg(F.count("*").alias("c")), "mix-buckets")
    before = sizes.withColumn("before", F.sum("c").over(Window.partitionBy("s").orderBy("b")) - F.col("c")).drop("c")
    numbered = keyed.withColumn("i", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "t")) - 1)
    numbered = numbered.join(before, ["s", "b"]).withColumn("i", F.col("i") + F.col("before"))
    joined = numbered.join(F.broadcast(per_source), "s").where(F.col("i") < F.col("rows"))  # at most max_sources rows
    joined = joined.withColumn("last", F.expr("(rows - 1 - i) div n"))
    out = joined.where(F.col("last") < EPOCHS).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    if any(rows[s] > n * EPOCHS for s, n in counts.items()):  # few rows that stand for much of the mix: repeated by many tasks
        dealt = joined.where(F.col("last") >= EPOCHS).withColumn("e", F.explode(F.expr(f"sequence(0L, last div {EPOCHS})"))).repartition("h", "t", "e")
        out = out.union(dealt.withColumn("epoch", F.explode(F.expr(f"sequence(e * {EPOCHS}, least(last, e * {EPOCHS} + {EPOCHS - 1}))"))).drop("e"))
    nth = F.col("epoch") * F.col("n") + F.col("i")  # of all rows that the source gives
    out = out.withColumn("whole", F.floor(nth / block)).withColumns({"at": nth % block, "block": F.expr("whole % share"), "turn": F.expr("whole div share")}).join(slots, ["s", "block"])
    out = out.withColumn("slot", F.col("turn") * F.lit(min(stretch, 1 << 62)) + F.col("slot"))
    return out.select("row.*", "epoch", F.col("whole").alias("block"), "slot", (F.col("slot") * block + F.col("at")).alias("place"))
