"""Point-in-time selection over immutable, versioned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def known_at(df: DataFrame, cutoff: Column, *instants: str) -> DataFrame:
    """Rows whose instants are null or not after the cutoff; the first one must be there."""
    ok = F.col(instants[0]) <= cutoff
    for c in instants[1:]:
        ok &= F.col(c).isNull() | (F.col(c) <= cutoff)
    return df.where(ok)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in order (give a unique last column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def active_versions(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows of each key that tie for the best rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.rank().over(w)).where("_n = 1").drop("_n")


def heads(df: DataFrame, id_col: str, supersedes_col: str) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = df.where(F.col(supersedes_col).isNotNull()).select(F.col(supersedes_col).alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti")


def version_faults(df: DataFrame, id_col: str, supersedes_col: str, time_col: str) -> DataFrame:
    """(id, fault) of versions that are duplicate, dangling, branched or older than what they supersede."""
    old = df.select(F.col(id_col).alias("_old"), F.col(time_col).alias("_then")).dropDuplicates(["_old"])
    linked = df.where(F.col(supersedes_col).isNotNull()).join(old, F.col(supersedes_col) == F.col("_old"), "left")
    duplicate = df.groupBy(id_col).count().where("count > 1").select(id_col, F.lit("duplicate").alias("fault"))
    dangling = linked.where("_old is null").select(id_col, F.lit("dangling").alias("fault"))
    reversed_ = linked.where(F.col(time_col) < F.col("_then")).select(id_col, F.lit("time_reversal").alias("fault"))
    branch = linked.groupBy(supersedes_col).count().where("count > 1").select(F.col(supersedes_col).alias(id_col), F.lit("branch").alias("fault"))
    return duplicate.union(dangling).union(reversed_).union(branch)


def conflicts(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Keys held with more than one payload, and how many."""
    return df.groupBy(*keys).agg(F.countDistinct(payload).alias("n_payloads")).where("n_payloads > 1")


def immutable_append(table: DataFrame, incoming: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): equal rows are known already, a known key with another payload is a conflict."""
    new = incoming.dropDuplicates([key, payload])
    clash = conflicts(table.select(key, payload).union(new.select(key, payload)), [key], payload)
    return new.join(table.select(key), key, "left_anti").join(clash.select(key), key, "left_anti"), clash


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the right row of its keys that has the greatest `since` not after `at`.
    One union and one window over the keys: no range join, nothing is paired."""
    payload = F.struct(*values)
    r = right.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_side"), payload.alias("_v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys])
    l_ = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), *[c for c in left.columns if c not in keys])
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l_).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])
