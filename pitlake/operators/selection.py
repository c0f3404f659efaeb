"""Choosing among versions, candidates and records; joins on two time axes and on intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.operators.analytics import _cut as cut


def uniform(parts: list[tuple[str, DataFrame, dict[str, Column]]], schema: dict[str, str]) -> DataFrame:
    """Records of several kinds in one schema; a column that a kind doesn't have is null."""
    make = lambda kind, df, cols: df.select(F.lit(kind).alias("record_type"), *[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in schema.items()])
    return reduce(DataFrame.unionByName, [make(*p) for p in parts])


def anchor_as_of(queries: DataFrame, anchors: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each query (keys, state_at, known_at) the latest complete anchor (keys, reference_at, available_at, anchor_id,
    complete) with reference_at <= state_at that was known: available_at <= known_at; ties by availability and id.

    Two time axes leave no order to merge by, so a key's queries meet its anchors; what is kept of each pair is one
    struct, combined on the map side."""
    a = anchors.where("complete").select(*keys, "reference_at", "available_at", "anchor_id", value)
    q = queries.join(a, keys, "left")
    seen = (F.col("reference_at") <= F.col("state_at")) & (F.col("available_at") <= F.col("known_at"))
    best = F.max(F.when(seen, F.struct("reference_at", "available_at", "anchor_id", value)))
    return q.groupBy("query_id").agg(best.alias("a")).select("query_id", "a.anchor_id", F.col(f"a.{value}").alias(value))


def interval_matches(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, bucket: str = "1 day") -> DataFrame:
    """Points with the half-open intervals [valid_from, valid_to) of their key that hold them; a null end is open.

    Both sides meet in time buckets of a key, so that a long history isn't compared point by point; open intervals end
    at the latest point."""
    end = points.agg(F.max(at).alias("_end"))
    unit = F.expr(f"interval {bucket}")
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    spread = intervals.crossJoin(F.broadcast(end)).withColumn("_to", F.least(F.coalesce("valid_to", "_end"), "_end"))  # end: one row
    spread = spread.where("valid_from <= _to").withColumn("_b", F.explode(F.sequence(day(F.col("valid_from")), day(F.col("_to")), unit))).drop("_end", "_to")
    hit = points.withColumn("_b", day(F.col(at))).join(spread, [*keys, "_b"]).drop("_b")
    return hit.where((F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))))


def single_quarters_by_join(ytd: DataFrame, keys: list[str]) -> DataFrame:
    """Single quarters of year-to-date values by a join with the quarter before: the first is itself, a later one needs
    its predecessor in the same year, unit and scope."""
    q = ytd.withColumns({"year": F.year("period_end"), "quarter": F.quarter("period_end")})
    before = q.select(*keys, "year", (F.col("quarter") + 1).alias("quarter"), F.col("value").alias("before"), F.col("unit").alias("unit_before"))
    j = q.join(before, [*keys, "year", "quarter"], "left")
    failure = F.when(F.col("quarter") == 1, None).when(F.col("before").isNull(), "missing_quarter_before").when(F.col("unit") != F.col("unit_before"), "unit_mismatch")
    value = F.when(failure.isNull(), F.col("value") - F.when(F.col("quarter") == 1, 0.0).otherwise(F.col("before")))
    return j.select(*keys, "period_end", value.alias("value"), failure.alias("failure"))


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns: one struct a key, combined on the map side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*")


def visible_heads(df: DataFrame, id_col: str, old_col: str, known: Column) -> DataFrame:
    """Versions known at the cutoff that no known version supersedes."""
    seen = df.where(known)
    gone = seen.where(F.col(old_col).isNotNull()).select(F.col(old_col).alias(id_col)).distinct()
    return seen.join(gone, id_col, "left_anti")


def merged_items(parts: list[DataFrame], keys: list[str], payload: str) -> DataFrame:
    """(keys, payload, conflict) of several lists of immutable items: equal payloads are one item, different ones a
    conflict that keeps no payload."""
    both = reduce(DataFrame.union, [p.select(*keys, payload) for p in parts])
    return both.groupBy(*keys).agg(F.min(payload).alias("_a"), F.max(payload).alias("_b")).select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias(payload), (F.col("_a") != F.col("_b")).alias("conflict"))


def verified_pairs(facts: DataFrame, keys: list[str], comparable: list[str], tolerance: float = 0.001) -> DataFrame:
    """Each fact of a key against the preferred one (authority, newest, id), never averaged: `pending` where a column of
    `comparable` differs, the values are too far apart, or a critical fact has no official side; else `dual` from
    different upstreams, `single` from one."""
    w = Window.partitionBy(*keys).orderBy("authority", F.desc("available_at"), "fact_id")
    best = {c: F.first(c).over(w) for c in ("fact_id", "value", "upstream", "authority", *comparable)}
    f = facts.select("*", *[v.alias(f"best_{c}") for c, v in best.items()]).where(F.col("fact_id") != F.col("best_fact_id"))
    off = F.abs(F.col("value") - F.col("best_value")) / F.greatest(F.abs("value"), F.abs("best_value"), F.lit(1.0))
    unlike = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"best_{c}")) for c in comparable])
    official = (F.col("authority") <= 2) | (F.col("best_authority") <= 2)
    status = F.when(unlike, "not_comparable").when(off > tolerance, "pending").when(F.col("critical") & ~official, "needs_official").when(F.col("upstream") != F.col("best_upstream"), "dual").otherwise("single")
    return f.select(*keys, "fact_id", "best_fact_id", status.alias("status"), off.alias("difference"))


def roots(edges: DataFrame, child: str, parent: str, most: int = 40) -> DataFrame:
    """(node, root): the node that a chain of parents ends at, by path doubling (log2 of the longest chain's rounds)."""
    up = edges.select(F.col(child).alias("node"), F.col(parent).alias("to"))
    for _ in range(most):
        longer = cut(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.col("to"), "next"))
        if longer.where("next is not null").isEmpty():
            return longer.select("node", F.col("to").alias("root"))
        up = longer.select("node", F.coalesce("next", "to").alias("to"))
    raise RuntimeError("a node is its own ancestor")


def ends(edges: DataFrame, child: str, parent: str, most: int = 40) -> DataFrame:
    """(node, root, depth): what `roots` and `depths` give, by one doubling. Nodes that have come to the end of their chain
    are written once and leave the rounds; their ends are still there for those that pass them."""
    up = edges.select(F.col(child).alias("node"), F.col(parent).alias("to"), F.lit(1).cast("long").alias("depth"))
    done = None
    for _ in range(most):
        step = up if done is None else up.union(done.select("node", F.col("root").alias("to"), "depth"))
        step = step.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        longer = cut(up.join(step.hint("merge"), "to", "left").select("node", F.coalesce("next", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNull().alias("ended")))
        found = longer.where("ended").select("node", F.col("to").alias("root"), "depth")
        done, up = found if done is None else done.union(found), longer.where("not ended").drop("ended")
        if up.isEmpty():
            return done
    raise RuntimeError("a node is its own ancestor")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in the whole order: range partitions are counted, and rows numbered within each,
    so that no task sees all of them."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row a partition
    within = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return within.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def depths(edges: DataFrame, child: str, parent: str, most: int = 40) -> DataFrame:
    """(node, depth): how many plans a plan waits for in a row, by path doubling: each round doubles the length of the
    pointers, so a chain of n needs log2(n) rounds. A node has one parent; a cycle is an error."""
    up = edges.select(F.col(child).alias("node"), F.col(parent).alias("to"), F.lit(1).cast("long").alias("depth"))
    for _ in range(most):
        step = up.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        longer = up.join(step, "to", "left").select("node", F.col("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if longer.where("next is not null").isEmpty():
            return longer.select("node", "depth")
        up = cut(longer.select("node", F.col("next").alias("to"), "depth"))
    raise RuntimeError("a plan depends on itself")
