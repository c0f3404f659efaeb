"""Control relations as a general directed graph: strongly connected parts, proof of indirect paths, state at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators.analytics import _cut


def strong_components(edges: DataFrame, a: str, b: str, rounds: int = 200) -> DataFrame:
    """(node, root, size) of all nodes that lie on a cycle of a directed graph of any out-degree: `root` is the largest
    node of the strongly connected part, of `size` nodes. Null ends are no edges, repeated edges are one.

    Nodes without an edge in or out are trimmed while that takes much away. Then each node is coloured by the largest
    node that reaches it (edges out of the nodes that changed last are followed); a colour's own node, and what goes back
    to it within the colour, is one part. It is taken out with all edges between colours, and what is left goes on.
    Every step is a join on nodes with sums on the map side, written to the shared folder; their number grows with the
    longest path between two nodes of a part, not with the nodes. More than `rounds` steps are an error.
    """
    every = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    loops = _cut(every.where("a = b").select(F.col("a").alias("node")))
    left, parts, steps = _cut(every.where("a <> b")), [], 0

    def step() -> None:
        nonlocal steps
        steps += 1
        if steps > rounds:
            raise RuntimeError(f"components did not settle in {rounds} steps")

    while n := left.count():
        step()
        for _ in range(4):  # trimming only saves work: what it leaves is coloured
            less = _cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            left, before, n = less, n, less.count()
            if n > 0.9 * before:
                break
        if not n:
            break
        colour = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("colour"))
        front = colour = _cut(colour)
        while True:
            step()
            reached = left.join(front.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("new"))
            both = _cut(colour.join(reached, "node", "left").select("node", F.greatest("colour", "new").alias("colour"), (F.coalesce(F.col("new") > F.col("colour"), F.lit(False))).alias("moved")))
            colour, front = both.drop("moved"), both.where("moved").drop("moved")
            if front.isEmpty():
                break
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"colour_{end}"))
        within = _cut(left.join(of("a"), "a").join(of("b"), "b").where("colour_a = colour_b").select("a", "b", F.col("colour_a").alias("colour")))
        part = front = _cut(colour.where("node = colour"))
        while True:
            step()
            back = within.join(front.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "colour").distinct()
            front = _cut(back.join(part, "node", "left_anti"))
            if front.isEmpty():
                break
            part = _cut(part.union(front))
        parts.append(part.select("node", F.col("colour").alias("root")))
        gone = part.select("node")
        left = _cut(within.select("a", "b").join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti"))
    out = loops.select("node", F.col("node").alias("root"), F.lit(1).cast("long").alias("size")).limit(0)
    for part in parts:
        out = out.union(part.join(part.groupBy("root").agg(F.count("*").alias("size")).where("size > 1"), "root").select("node", "root", "size"))
    alone = loops.join(out, "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(1).cast("long").alias("size"))
    return out.union(alone)


def unproven_segments(relations: DataFrame, record: str, path: str, direct: DataFrame, scope: str) -> DataFrame:
    """(record, n_missing): records whose chain (an array of nodes) has a step that is no direct edge (scope, a, b). A chain
    of one node or none has no steps."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(path) - 2), lambda i: F.struct(F.col(path)[i].alias("a"), F.col(path)[i + 1].alias("b")))
    steps = relations.where(F.size(path) > 1).select(record, scope, F.inline(pairs))
    missing = steps.join(direct.select(scope, "a", "b").distinct(), [scope, "a", "b"], "left_anti")
    return missing.groupBy(record).agg(F.count("*").alias("n_missing"))


def control_state(relations: DataFrame, states: DataFrame, scope: str) -> DataFrame:
    """(state_id, outcome, n_relations, n_conflicts, n_unproven, n_cyclic): the control graph of each state.

    relations: record_id, scope, controller, controlled, kind, direction ('direct' or 'indirect'), path, valid_from, valid_to,
    available_at, supersedes. states: state_id, scope, state_at, known_at. A record counts if it is known by
    known_at, no other known record replaces it, and it holds at state_at (half-open; a null end is open). Several such
    records of one controller, controlled node and kind that differ are a conflict, and none of them counts. Then
    every step of an indirect chain needs a direct edge, and no node may lie on a cycle. The outcome is the worst of
    cyclic, unproven, conflicted and complete; a state without relations is complete.
    """
    seen = relations.join(states, scope).where("available_at <= known_at")
    gone = seen.where("supersedes is not null").select("state_id", F.col("supersedes").alias("record_id")).distinct()
    held = seen.join(gone, ["state_id", "record_id"], "left_anti").where("valid_from <= state_at and (valid_to is null or state_at < valid_to)")
    key = ["state_id", "controller", "controlled", "kind"]
    same = held.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("direction", F.array_join("path", ",")).alias("d"), F.min_by(F.struct("record_id", "direction", "path"), "record_id").alias("x"))
    one = _cut(same.select(*key, "n", "d", "x.*"))
    good = one.where("d = 1").select("state_id", "record_id", F.col("controller").alias("a"), F.col("controlled").alias("b"), "direction", "path")
    indirect = good.where("direction = 'indirect'").withColumn("of", F.struct("state_id", "record_id"))
    unproven = unproven_segments(indirect, "of", "path", good.where("direction = 'direct'"), "state_id")
    bad = unproven.groupBy(F.col("of.state_id").alias("state_id")).agg(F.count("*").alias("n_unproven"))
    node = lambda c: F.concat_ws("/", "state_id", c)
    cyclic = strong_components(good.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    cyclic = cyclic.groupBy(F.substring_index("node", "/", 1).alias("s")).agg(F.count("*").alias("n_cyclic"))
    counts = one.groupBy("state_id").agg(F.count_if(F.col("d") == 1).alias("n_relations"), F.count_if(F.col("d") > 1).alias("n_conflicts"))
    out = states.select("state_id", F.col("state_id").cast("string").alias("s")).join(counts, "state_id", "left").join(bad, "state_id", "left").join(cyclic, "s", "left").drop("s").na.fill(0)
    outcome = F.when(F.col("n_cyclic") > 0, "cyclic").when(F.col("n_unproven") > 0, "unproven").when(F.col("n_conflicts") > 0, "conflicted").otherwise("complete")
    return out.select("state_id", outcome.alias("outcome"), "n_relations", "n_conflicts", "n_unproven", "n_cyclic")
