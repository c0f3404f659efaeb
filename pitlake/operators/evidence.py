"""Fields, references, lineage, conflicts, versions and differences of evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.operators.analytics import _cut


def mapped_fields(rows: DataFrame, keys: list[str], fields: list[str], rules: dict[str, str], default: str = "unclassified") -> DataFrame:
    """(keys, field, value, nature) of every field of every row: none is lost, unknown ones get the default nature."""
    nature = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    long = rows.select(*keys, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(keys, fields, "field", "value")
    return long.withColumn("nature", F.coalesce(F.try_element_at(nature, F.col("field")), F.lit(default)))


def alias_matches(queries: DataFrame, aliases: DataFrame, name: str = "name", at: str = "at") -> DataFrame:
    """Queries with the aliases (alias, valid_from, valid_to) of their name, whatever its case, that are valid at
    their date; both ends belong to the interval, an open end is null."""
    a = aliases.withColumn("_key", F.lower("alias"))
    joined = queries.withColumn("_key", F.lower(name)).join(a, "_key").drop("_key")
    return joined.where((F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) <= F.col("valid_to"))))


def near_matches(left: DataFrame, right: DataFrame, keys: list[str], a: Column, b: Column, tolerance: float = 0.001) -> DataFrame:
    """Pairs of equal keys whose values differ by at most the tolerance relative to the larger one (1 at least)."""
    return left.join(right, keys).where(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= tolerance)


def lineage(edges: DataFrame, child: str, parent: str, rounds: int = 40) -> DataFrame:
    """(child, ancestor) pairs over any number of steps, by path doubling: each round joins the pairs that are exactly so
    many steps apart with all pairs that are at most as many apart, so a depth of n needs log2(n) rounds, each of them
    written once. In a graph without cycles in which a node has one parent no pair is found twice, and only new pairs
    are written; else pairs are made distinct. The result has every pair; selection.roots gives the last ancestor alone."""
    exact = _cut(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child is not null and ancestor is not null").distinct())
    known, n = exact, exact.count()
    plain, n_exact = exact.select("child").distinct().count() == n, n
    for _ in range(rounds):
        if plain and not n_exact:
            return known.select(F.col("child").alias(child), "ancestor")
        step = exact.select("child", F.col("ancestor").alias("_mid"))
        further = lambda pairs: step.join(pairs.select(F.col("child").alias("_mid"), "ancestor").hint("merge"), "_mid").select("child", "ancestor")  # noqa: E731, B023
        more, twice = further(known), further(exact)
        if plain:
            known, exact = known.union(_cut(more)), _cut(twice)
            before, n_exact = n_exact, exact.count()
            plain = n_exact < before  # as many that far apart as half as far: there is a cycle
            if not plain:
                known, n = known.distinct(), -1
            continue
        known, exact = _cut(known.union(more).distinct()), _cut(twice.distinct())
        before, n = n, known.count()
        if n == before:
            return known.select(F.col("child").alias(child), "ancestor")
    raise RuntimeError(f"lineage is deeper than 2 ** {rounds} steps")


def dangling(references: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """References to targets that aren't there."""
    return references.where(F.col(ref).isNotNull()).join(targets.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def conflicting(claims: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All claims, with whether those of their key (null keys are keys) hold more than one value."""
    many = claims.groupBy(*keys).agg((F.min(value) != F.max(value)).alias("conflict"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    return claims.alias("c").join(many.alias("m"), on).select("c.*", F.coalesce("m.conflict", F.lit(False)).alias("conflict"))


def matrix(cells: DataFrame, labels: list[str], period: str, value: str, periods: list[str]) -> DataFrame:
    """A row for each label and a column for each period: the value, `conflict` for several, null for none."""
    one = F.when(F.min(value) != F.max(value), "conflict").otherwise(F.min(value))
    return cells.groupBy(*labels).pivot(period, periods).agg(one)


def difference(current: DataFrame, previous: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, change: added, removed or changed) between two tables with unique keys; equal rows don't appear."""
    a, b = (df.select(key, F.struct(*values).alias(name)) for df, name in ((current, "_a"), (previous, "_b")))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).where("change is not null")


def content_versions(seen: DataFrame, resource: str, order: list[str], digest: str) -> DataFrame:
    """version of each observation of a resource, one more whenever the digest isn't that of the one before, and
    whether the observation is unchanged."""
    w = Window.partitionBy(resource).orderBy(*order)
    df = seen.withColumn("unchanged", F.coalesce(F.lag(digest).over(w) == F.col(digest), F.lit(False)))
    return df.withColumn("version", F.sum((~F.col("unchanged")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def resolve_fields(candidates: DataFrame, keys: list[str], valid: Column, order: list[Column], value: str) -> DataFrame:
    """For each key the value of the first valid candidate, null if none is; and how many were."""
    first = F.min_by(value, F.when(valid, F.struct(*order)))
    return candidates.groupBy(*keys).agg(first.alias(value), F.count_if(valid).alias("n_valid"))


def lifecycle(facts: DataFrame, id_col: str, supersedes: str, keys: list[str]) -> DataFrame:
    """status of each fact: superseded, conflict (its key has several others that aren't), or current."""
    gone = facts.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id_col)).distinct().withColumn("_gone", F.lit(True))
    marked = facts.join(gone, id_col, "left")
    heads = marked.where("_gone is null").groupBy(*keys).agg(F.count("*").alias("_heads"))
    status = F.when(F.col("_gone"), "superseded").when(F.col("_heads") > 1, "conflict").otherwise("current")
    return marked.join(heads, keys, "left").select(*facts.columns, status.alias("status"))


def latest_distinct(rows: DataFrame, keys: list[str], content: list[str], order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each key, of rows with equal content the newest only."""
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, *content).orderBy(*order))).where("_n = 1")
    return one.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def referenced(sources: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Sources that something refers to; all of them when there is no reference at all."""
    if references.where(F.col(key).isNotNull()).isEmpty():
        return sources
    return sources.join(references.select(key), key, "left_semi")


def cycles(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """The smallest node of each cycle of a graph in which a node has at most one edge out, by path doubling."""
    up = edges.select(F.col(a).alias("node"), F.col(b).alias("to"), F.least(a, b).alias("last"))
    return on_rings(up, F.least, rounds).select(F.col("last").alias("node")).distinct()


def on_rings(edges: DataFrame, best: Callable, rounds: int = 40) -> DataFrame:
    """(node, last) of the nodes on rings of a graph with at most one edge out of a node (node, to, last): the best `last` all
    the way round.

    Each round doubles the steps, and nodes whose way ends go. It is over when a round loses no node, reaches as many
    nodes as the one before and changes no `last`: then no way ends, the nodes reached are those on rings, and each of
    them has seen its whole ring. So the rounds grow with the longest way, not with the number of nodes. The two sides
    of a join are of one size, so neither is broadcast."""
    up = _cut(edges)
    n = up.count()
    for _ in range(rounds):
        nxt = up.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("last").alias("more"))
        longer = _cut(up.join(nxt.hint("merge"), "to").select("node", F.col("next").alias("to"), best("last", "more").alias("last"), (best("last", "more") != F.col("last")).alias("moved")))
        state = longer.agg(F.count("*").alias("n"), F.count_if("moved").alias("moved")).first()
        reached = lambda df: df.select("to").distinct().count()
        if state["n"] == n and not state["moved"] and reached(longer) == reached(up):
            return up.join(up.select(F.col("to").alias("node")).distinct().hint("merge"), "node", "left_semi").select("node", "last")
        up, n = longer.drop("moved"), state["n"]
    raise RuntimeError(f"a way is longer than 2 ** {rounds} steps")


def person_key(name: str) -> Column:
    """A name in lower case without blanks, dots, dashes and underscores. Compatibility forms (full width) of letters
    and digits become plain ones."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.regexp_replace(F.lower(F.translate(F.col(name), wide, "".join(chr(ord(c) - 0xFEE0) for c in wide))), r"[\s\u00b7\u2022\u30fb._-]+", "")
