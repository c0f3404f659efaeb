"""Verification, distributions, coverage, matrices, peers, balances and graphs."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def consolidate(facts: DataFrame, keys: list[str], tolerance: float = 0.001) -> DataFrame:
    """One row a key: the preferred value (authority, newest, id) and whether the others agree with it within the
    tolerance. Disagreement is `pending` and never averaged away; one source is `single`, agreeing ones `dual`."""
    w = Window.partitionBy(*keys).orderBy("authority", F.desc("available_at"), "fact_id")
    best = F.first("value").over(w)
    off = F.abs(F.col("value") - best) / F.greatest(F.abs("value"), F.abs(best), F.lit(1.0))
    other = F.row_number().over(w) > 1
    upstream = F.col("upstream") != F.first("upstream").over(w)
    marked = facts.select(*keys, "fact_id", best.alias("value"), (other & (off > tolerance)).alias("_off"), (other & upstream & (off <= tolerance)).alias("_dual"), F.row_number().over(w).alias("_n"))
    status = F.when(F.max("_off"), "pending").when(F.max("_dual"), "dual").otherwise("single")
    return marked.groupBy(*keys).agg(F.min("value").alias("value"), F.min_by("fact_id", "_n").alias("fact_id"), F.count("*").alias("n_versions"), status.alias("status"))


def distribution(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Positive observations: count, exact type-7 quantiles, the latest value and its mid-rank; what was left out is
    counted. Two passes over a key's rows, joined on it."""
    ok = F.col(value) > 0
    agg = df.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), F.count_if(~ok | F.col(value).isNull()).alias("n_excluded"), *[F.percentile(F.when(ok, F.col(value)), p).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)],
        F.max_by(value, F.struct(at, value)).alias("latest"),
    )
    v, latest = F.col(value), F.col("latest")
    rank = df.where(ok).join(agg.select(*keys, "latest"), keys).groupBy(*keys).agg(((F.count_if(v < latest) + 0.5 * F.count_if(v == latest)) / F.count("*")).alias("mid_rank"))
    return agg.join(rank, keys, "left")


def complete_dates(df: DataFrame, member: str, at: str) -> DataFrame:
    """Dates at which every member has a row."""
    n = df.select(F.countDistinct(member).alias("_all"))
    return df.groupBy(at).agg(F.countDistinct(member).alias("_n")).join(n, F.col("_n") == F.col("_all")).select(at)


def coverage(requirements: DataFrame, unit: list[str]) -> DataFrame:
    """Whether each unit's groups are ready (all_of: every one, any_of: one), the share of ready groups, and the
    missing requirements of groups that aren't."""
    g = requirements.groupBy(*unit, "group_id").agg(F.max("group_mode").alias("m"), F.every("ready").alias("all"), F.some("ready").alias("any"), F.collect_set(F.when(~F.col("ready"), F.col("requirement_id"))).alias("missing"))
    g = g.withColumn("ok", F.when(F.col("m") == "any_of", F.col("any")).otherwise(F.col("all")))
    none = F.array().cast("array<string>")
    return g.groupBy(*unit).agg(F.every("ok").alias("ready"), F.avg(F.col("ok").cast("double")).alias("share"), F.array_sort(F.flatten(F.collect_list(F.when(F.col("ok"), none).otherwise(F.col("missing"))))).alias("missing"))


def leaves(segments: DataFrame, keys: list[str], code: str, parent: str) -> DataFrame:
    """Segments that are nobody's parent."""
    parents = segments.where(F.col(parent).isNotNull()).select(*keys, F.col(parent).alias(code)).distinct()
    return segments.join(parents, [*keys, code], "left_anti")


def nearest_peers(companies: DataFrame, key: str, size: str, within: list[str], k: int = 6) -> DataFrame:
    """Up to k peers of each company by |size ratio - 1| (ties by id) within a group. Only the k sizes to each side
    in order, and of each size the k + 1 smallest ids, can be nearest: these are looked at, not all pairs."""
    some = companies.where(F.col(size) > 0).select(*within, key, size)
    same = Window.partitionBy(*within, size).orderBy(key)
    sizes = some.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).groupBy(*within, size).agg(F.collect_list(key).alias("_ids"))
    w, entry = Window.partitionBy(*within).orderBy(size), F.struct(F.col(size).alias("peer_size"), F.col("_ids").alias("ids"))
    around = [entry, *[f(entry, i).over(w) for f in (F.lag, F.lead) for i in range(1, k + 1)]]
    near = sizes.withColumn("_near", F.array_compact(F.array(*around))).drop("_ids")
    pairs = some.join(near, [*within, size]).withColumn("_s", F.explode("_near")).withColumn("peer", F.explode("_s.ids")).where(F.col("peer") != F.col(key))
    pairs = pairs.select(*within, key, "peer", F.abs(F.col("_s.peer_size") / F.col(size) - 1).alias("distance"))
    best = Window.partitionBy(*within, key).orderBy("distance", "peer")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def running_balance(deltas: DataFrame, keys: list[str], order: list[str], amount: Column) -> DataFrame:
    """balance after each delta; null from the first unknown amount on; integrity: no balance below zero so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = deltas.withColumn("_a", amount)
    unknown = F.max(F.col("_a").isNull()).over(w)
    df = df.withColumn("balance", F.when(~unknown, F.sum("_a").over(w)))
    return df.withColumn("integrity", F.coalesce(F.min("balance").over(w) >= 0, F.lit(True))).drop("_a")


def linked_groups(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node reachable. Labels spread to neighbours and jump over their own label until
    none changes; each round is checkpointed."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct()
    labels = both.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("root"))
    both, labels = _cut(both), _cut(labels)
    for _ in range(rounds):
        near = both.join(labels.select(F.col("x").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
        up = labels.select(F.col("x").alias("root"), F.col("root").alias("up"))
        new = _cut(labels.join(near, "x").join(up, "root").select("x", F.least("root", "near", "up").alias("new"), F.col("root").alias("old")))
        moved = new.where("new <> old").isEmpty()
        labels = new.select("x", F.col("new").alias("root"))
        if moved:
            return labels.select(F.col("x").alias("node"), "root")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def shared_dir(spark) -> str:
    """The checkpoint folder that the driver and all executors see; in local mode only, a temporary one if none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pitlake-"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its plan runs once, and what follows starts from the files."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def page_audit(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Whether pages (page_number, n_rows, declared_total, terminal) close their declared total without gaps."""
    return pages.groupBy(*keys).agg(
        F.count("*").alias("n_pages"), F.sum("n_rows").alias("n_rows"), F.max("declared_total").alias("declared_total"), (F.countDistinct("declared_total") > 1).alias("total_drift"),
        (F.countDistinct("page_number") < F.count("*")).alias("duplicate_page"), (F.max("page_number") > F.countDistinct("page_number")).alias("page_gap"), F.coalesce(F.max("terminal"), F.lit(False)).alias("has_terminal"),
    ).withColumn("complete", ~F.col("total_drift") & ~F.col("duplicate_page") & ~F.col("page_gap") & F.col("has_terminal") & (F.col("n_rows") == F.col("declared_total")))


def safe_through(slices: DataFrame, keys: list[str]) -> DataFrame:
    """How far complete slices (start, end, complete) reach without a gap, before the first incomplete one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    broken = ~F.col("complete") | (F.col("start") > F.coalesce(F.max("end").over(before), F.col("start")))
    df = slices.withColumn("_b", broken).withColumn("_stop", F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys).agg(F.max(F.when(~F.col("_stop"), F.col("end"))).alias("safe_through"), F.count_if("_stop").alias("n_blocked"))


def tiles(df: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Half-open tiles of at most `days` days over [start, end), the last one clipped."""
    out = df.withColumn("tile_start", F.explode(F.sequence(F.col(start), F.date_sub(F.col(end), 1), F.expr(f"interval {days} days"))))
    return out.withColumn("tile_end", F.least(F.date_add("tile_start", days), F.col(end)))


def series_links(events: DataFrame, keys: list[str], max_days: int = 800) -> DataFrame:
    """Event chains within each key, in order of availability: an event with a known identity joins its root; one
    without joins the only open root of the last max_days days; with several open ones it starts a new root, marked
    ambiguous.

    Spark sorts each key's events within its partition, and a task folds the stream batch by batch. Its state is the
    roots of the key at hand that are open and not older than max_days, and the roots of its identities."""
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    limit = max_days * 86_400_000_000

    def fold(batches):
        key, open_, known = None, {}, {}
        for b in batches:
            at = b.column("_at").to_pylist()
            ids, identities, closes = (b.column(c).to_pylist() for c in ("event_id", "identity", "closes"))
            roots, unsure = [], []
            for i, k in enumerate(zip(*(b.column(c).to_pylist() for c in keys))):
                if k != key:
                    key, open_, known = k, {}, {}
                identity, ambiguous = identities[i], False
                root = known.get(identity) if identity is not None else None
                if root is None and identity is None:
                    open_ = {r: t for r, t in open_.items() if at[i] - t <= limit}
                    ambiguous = len(open_) > 1
                    root = next(iter(open_)) if len(open_) == 1 else None
                root = ids[i] if root is None else root
                open_.pop(root, None)
                if not closes[i]:
                    open_[root] = at[i]
                if identity is not None:
                    known[identity] = root
                roots.append(root), unsure.append(ambiguous)
            cols = [*(b.column(c) for c in keys), b.column("event_id"), pa.array(roots, pa.int64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "event_id", "root_event_id", "ambiguous"])

    rows = events.select(*keys, "event_id", "identity", F.unix_micros(F.col("available_at").cast("timestamp")).alias("_at"), F.coalesce("closes", F.lit(False)).alias("closes"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "_at", "event_id")
    return dealt.mapInArrow(fold, f"{kinds}, event_id long, root_event_id long, ambiguous boolean")
