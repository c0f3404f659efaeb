"""One fact for each key out of what several sources say in several versions: agreement within a source, then across."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def materialized(facts: DataFrame, keys: list[str], source: list[str], preferred: Column) -> DataFrame:
    """(*keys, outcome, fact_id, value, unit, n_sources): the fact of each key, or why there is none.

    facts: keys, source, fact_id, record_id, row_key, supersedes (a record_id), available_at, value, unit. Versions form a graph
    within a key and source. Its leaves, which nothing there replaces, must agree in value and unit; a later retrieval
    alone corrects nothing. The outcome is the first of: `revision_of_another_row`, `revision_out_of_order` (what is
    replaced wasn't available before), `no_leaf` (versions replace each other in a circle), `conflict_within_source`,
    `conflict_across_sources`, `selected`. The newest leaf stands for a source, and of sources that agree a preferred one
    is taken, then the smallest fact_id. A null value or unit is a value of its own.
    """
    own = [*keys, *source]
    targets = facts.where("supersedes is not null").select(*own, F.col("supersedes").alias("record_id"), F.col("row_key").alias("by_row"), F.col("available_at").alias("by_at"))
    replaced = targets.groupBy(*own, "record_id").agg(F.collect_set("by_row").alias("by_rows"), F.min("by_at").alias("by_at"))
    marked = facts.join(replaced, [*own, "record_id"], "left")
    other = F.exists("by_rows", lambda x: x != F.col("row_key"))
    leaf = F.col("by_at").isNull()
    said = F.struct(F.col("value").alias("value"), F.col("unit").alias("unit"))
    per = marked.groupBy(*own).agg(
        F.max(F.coalesce(other, F.lit(False))).alias("another"), F.max(F.coalesce(F.col("available_at") >= F.col("by_at"), F.lit(False))).alias("disorder"), F.count_if(leaf).alias("n_leaves"),
        (F.min(F.when(leaf, said)) != F.max(F.when(leaf, said))).alias("within"), F.max(F.when(leaf, F.struct("available_at", "fact_id", said.alias("said"), preferred.alias("preferred")))).alias("best"),
    )
    out = per.groupBy(*keys).agg(
        F.max("another").alias("another"), F.max("disorder").alias("disorder"), (F.min("n_leaves") == 0).alias("none"), F.max(F.coalesce("within", F.lit(False))).alias("within"), (F.min("best.said") != F.max("best.said")).alias("across"),
        F.min(F.struct((~F.col("best.preferred")).alias("later"), F.col("best.fact_id").alias("fact_id"), F.col("best.said").alias("said"))).alias("chosen"), F.count("*").alias("n_sources"),
    )
    outcome = F.when(F.col("another"), "revision_of_another_row").when(F.col("disorder"), "revision_out_of_order").when(F.col("none"), "no_leaf").when(F.col("within"), "conflict_within_source").when(F.col("across"), "conflict_across_sources").otherwise("selected")
    out = out.withColumn("outcome", outcome)
    kept = lambda c: F.when(F.col("outcome") == "selected", F.col(c))
    return out.select(*keys, "outcome", kept("chosen.fact_id").alias("fact_id"), kept("chosen.said.value").alias("value"), kept("chosen.said.unit").alias("unit"), "n_sources")


def chosen(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(*keys, fact_id, value, unit, n_candidates, n_values): the first candidate in the order (priority, number of parents, newest, id) and
    how many different values there were; more than one is a conflict that is kept in sight, not resolved."""
    said = F.struct("value", "unit")
    return candidates.groupBy(*keys).agg(F.min_by(F.struct("fact_id", "value", "unit"), F.struct(*order)).alias("x"), F.count("*").alias("n_candidates"), F.count_distinct(said).alias("n_values")).select(*keys, "x.*", "n_candidates", "n_values")
