"""States rebuilt from an anchor and the deltas after it, as of two times: when it held, and when it was known.

One pipeline for six kinds of state: what is available by `known_at` counts, then versions are resolved, then the latest
complete anchor is chosen, then the deltas after it up to `state_at`, then the kind's reducer runs. Whatever is
wrong is kept beside the state: the completeness is `conflicted` over `incomplete` over `complete`, and `invalid` where
the version graph or a balance can't be right.

states: state_id, company, state_at, known_at. anchors: company, anchor_id, reference_at, available_at, complete,
supersedes, withdrawn. items (of anchors): anchor_id, subject, other, quantity, unit, basis. deltas: company, delta_id,
effective_at, announced_at, available_at, supersedes, withdrawn, subject, other, action, quantity, unit, basis, valid_to.
sides: company, side ('gap', 'conflict'), available_at, closed_at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.operators.analytics import _cut
from pitlake.operators.evidence import cycles

PLUS = ["increase", "pledge"]


@dataclass
class Inputs:
    states: DataFrame
    anchors: DataFrame
    items: DataFrame
    deltas: DataFrame
    sides: DataFrame


@dataclass
class Rebuilt:
    """summary: state_id, anchor_id, n_selected, n_excluded, n_issues, completeness. positions: state_id and what the kind
    says about each key. decisions: state_id, delta_id, decision."""

    summary: DataFrame
    positions: DataFrame
    decisions: DataFrame


def visible_versions(items: DataFrame, states: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """All items of each state's company with their decision (`available_after_known_at`, `superseded`, `withdrawn`, `head`),
    and (state_id, fault) of states whose visible versions are no set of chains: `dangling` (what is replaced isn't
    visible), `predates` (it was available later than what replaces it), `branch` (replaced twice), `cycle`."""
    met = items.join(states, "company")
    seen = met.where("available_at <= known_at")
    links = seen.where("supersedes is not null").select("state_id", F.col(id_col).alias("by"), F.col("supersedes").alias("target"), F.col("available_at").alias("by_at"))
    targets = links.join(seen.select("state_id", F.col(id_col).alias("target"), F.col("available_at").alias("target_at")), ["state_id", "target"], "left")
    faults = targets.select("state_id", F.when(F.col("target_at").isNull(), "dangling").when(F.col("by_at") < F.col("target_at"), "predates").alias("fault")).where("fault is not null")
    replaced = links.groupBy("state_id", F.col("target").alias(id_col)).agg(F.count("*").alias("n_by"))
    faults = faults.union(replaced.where("n_by > 1").select("state_id", F.lit("branch")))
    tied = targets.where("by_at = target_at")  # a chain that only goes back in time can't close; one within an instant can
    node = lambda c: F.concat_ws("/", F.col("state_id").cast("string"), F.col(c).cast("string"))
    single = tied.groupBy("state_id", "by").agg(F.first("target").alias("target")).select(node("by").alias("a"), node("target").alias("b"))
    closed = cycles(single, "a", "b").select(F.substring_index("node", "/", 1).cast(states.schema["state_id"].dataType).alias("state_id"), F.lit("cycle").alias("fault"))
    marked = met.join(replaced, ["state_id", id_col], "left")
    decision = F.when(F.col("available_at") > F.col("known_at"), "available_after_known_at").when(F.col("n_by").isNotNull(), "superseded").when(F.col("withdrawn"), "withdrawn").otherwise("head")
    return marked.withColumn("decision", decision).drop("n_by"), faults.union(closed).distinct()


def selected(inputs: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state with anchor_id and reference_at, deltas with their decisions, faults): the latest complete anchor by reference,
    availability and id, and the deltas that are heads, effective by state_at and after the anchor."""
    anchors, wrong = visible_versions(inputs.anchors, inputs.states, "anchor_id")
    fit = anchors.where("decision = 'head' and complete and reference_at <= state_at")
    best = fit.groupBy("state_id").agg(F.max(F.struct("reference_at", "available_at", "anchor_id")).alias("x")).select("state_id", "x.anchor_id", "x.reference_at")
    states = _cut(inputs.states.join(best, "state_id", "left"))
    deltas, faults = visible_versions(inputs.deltas, inputs.states, "delta_id")
    deltas = deltas.join(states.select("state_id", "anchor_id", "reference_at"), "state_id")
    late, early = F.col("effective_at") > F.col("state_at"), F.coalesce(F.col("effective_at") <= F.col("reference_at"), F.lit(False))
    decision = F.when(F.col("decision") != "head", F.col("decision")).when(late, "effective_after_state_at").when(early, "not_after_anchor_boundary").otherwise("selected")
    return states, _cut(deltas.withColumn("decision", decision)), _cut(wrong.union(faults).distinct())


def balances(states: DataFrame, deltas: DataFrame, items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state_id, *keys, balance, n_applied, n_issues) and (state_id, status). From the first delta on that lacks its quantity,
    unit or basis, or has another unit or basis than the anchor, a balance is unknown for good; without an anchor item it
    always was. A negative balance is an error of the state."""
    start = states.join(items, "anchor_id").select("state_id", *keys, F.col("quantity").alias("start"), F.col("unit").alias("start_unit"), F.col("basis").alias("start_basis"))
    moves = deltas.where("decision = 'selected'").select("state_id", *keys, "effective_at", "announced_at", "delta_id", "action", "quantity", "unit", "basis")
    rows = moves.join(start.select("state_id", *keys, "start", "start_unit", "start_basis"), ["state_id", *keys], "left")
    off = F.col("quantity").isNull() | F.col("unit").isNull() | F.col("basis").isNull() | F.coalesce(F.col("unit") != F.col("start_unit"), F.lit(False)) | F.coalesce(F.col("basis") != F.col("start_basis"), F.lit(False))
    w = Window.partitionBy("state_id", *keys).orderBy("effective_at", "announced_at", "delta_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("start").isNull() | F.max(off).over(w)
    signed = F.when(F.col("action").isin(PLUS), F.col("quantity")).otherwise(-F.col("quantity"))
    run = rows.withColumn("bad", bad).withColumn("signed", F.when(~F.col("bad"), signed)).withColumn("now", F.when(~F.col("bad"), F.col("start") + F.sum("signed").over(w)))
    moved = run.groupBy("state_id", *keys).agg(F.sum("signed").alias("total"), F.count_if(~F.col("bad")).alias("n_applied"), F.count_if("bad").alias("n_issues"), F.min("now").alias("least"))
    both = start.join(moved, ["state_id", *keys], "full")
    known = F.col("start").isNotNull() & (F.coalesce("n_issues", F.lit(0)) == 0)
    out = both.select("state_id", *keys, F.when(known, F.col("start") + F.coalesce("total", F.lit(0))).alias("balance"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_applied", "n_issues")], F.coalesce(F.col("least") < 0, F.lit(False)).alias("negative"))
    status = out.groupBy("state_id").agg(F.max("negative").alias("negative"), F.sum("n_issues").alias("n_issues"))
    return out.drop("negative"), status.select("state_id", F.when(F.col("negative"), "invalid").when(F.col("n_issues") > 0, "incomplete").otherwise("complete").alias("status"), "n_issues")


def roles(states: DataFrame, deltas: DataFrame, items: DataFrame, single: tuple[str, ...] = ("chair",)) -> tuple[DataFrame, DataFrame]:
    """(state_id, subject, other, since, problem) of the roles (other) held at each state. The anchor's holders are there from the
    start; `appoint` opens a role (again: renews it), `dismiss` closes it, `resign` without a role closes the person's
    only one. What closes nothing is `close_without_open`, what could close several `ambiguous`, and closes none; two
    holders of a single role are a conflict. Spark sorts each state's rows; a task holds one state's open roles."""
    start = states.join(items, "anchor_id").select("state_id", F.lit(0).alias("first"), F.col("reference_at").alias("at"), F.col("reference_at").alias("said"), F.lit(0).cast("long").alias("delta_id"), "subject", "other", F.lit("appoint").alias("action"))
    moves = deltas.where("decision = 'selected'").select("state_id", F.lit(1).alias("first"), F.col("effective_at").alias("at"), F.col("announced_at").alias("said"), "delta_id", "subject", "other", "action")
    types = {f.name: f.dataType.simpleString() for f in start.schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, problems, kinds = None, {}, [], None

        def ended() -> list:
            rows = [(state, s, o, at, "overlap" if o in single and sum(x[1] == o for x in held) > 1 else None) for (s, o), at in held.items()]
            return rows + [(state, s, o, at, p) for s, o, at, p in problems]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["state_id", "subject", "other", "since", "problem"])

        for b in batches:
            kinds = kinds or [b.schema.field(c).type for c in ("state_id", "subject", "other", "at")] + [pa.string()]
            out = []
            for s, subject, other, at, action in zip(*(b.column(c).to_pylist() for c in ("state_id", "subject", "other", "at", "action"))):
                if s != state:
                    out += ended() if state is not None else []
                    state, held, problems = s, {}, []
                if action == "appoint":
                    held[subject, other] = at
                    continue
                mine = [k for k in held if k[0] == subject and other in (None, k[1])]
                if len(mine) == 1:
                    del held[mine[0]]
                else:
                    problems.append((subject, other, at, "ambiguous" if mine else "close_without_open"))
            yield made(out)
        if state is not None:
            yield made(ended())

    rows = start.union(moves).repartition("state_id").sortWithinPartitions("state_id", "first", "at", "said", "delta_id")
    found = _cut(rows.mapInArrow(fold, f"state_id {types['state_id']}, subject {types['subject']}, other {types['other']}, since {types['at']}, problem string"))
    status = found.groupBy("state_id").agg(F.max(F.col("problem") == "overlap").alias("conflict"), F.count("problem").alias("n_issues"))
    return found, status.select("state_id", F.when(F.coalesce("conflict", F.lit(False)), "conflicted").when(F.col("n_issues") > 0, "incomplete").otherwise("complete").alias("status"), "n_issues")


def records(states: DataFrame, deltas: DataFrame, key: list[str], holds: Column, latest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(state_id, *key, delta_id, quantity): the records that hold, one for each natural key; records of one key that differ are a
    conflict and none is kept. With latest, only the records of each subject's last year (its `basis`)."""
    good = deltas.where("decision = 'selected'").where(holds)
    if latest:
        last = good.groupBy("state_id", "subject").agg(F.max("basis").alias("basis"))
        good = good.join(last, ["state_id", "subject", "basis"], "left_semi")
    same = good.groupBy("state_id", *key).agg(F.count_distinct(F.struct("action", "quantity", "unit")).alias("n"), F.min("delta_id").alias("delta_id"), F.min("quantity").alias("quantity"))
    same = _cut(same)
    status = same.groupBy("state_id").agg(F.count_if(F.col("n") > 1).alias("n_issues"))
    return same.where("n = 1").drop("n"), status.select("state_id", F.when(F.col("n_issues") > 0, "conflicted").otherwise("complete").alias("status"), "n_issues")




def open_at_state() -> Column:
    return F.col("valid_to").isNull() | (F.col("state_at") < F.col("valid_to"))


#: Reducers by kind of state: (states, deltas, items) to positions and status.
REDUCERS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame]]] = {
    "ownership": lambda s, d, i: balances(s, d, i, ["subject"]),
    "pledge": lambda s, d, i: balances(s, d, i, ["subject", "other", "basis_key"]),
    "roster": lambda s, d, i: roles(s, d, i),
    "control": lambda s, d, i: records(s, d, ["subject", "other"], open_at_state()),
    "annual": lambda s, d, i: records(s, d, ["subject", "basis"], F.lit(True), latest=True),
    "interval": lambda s, d, i: records(s, d, ["subject", "other", "basis"], open_at_state()),
}
#: Kinds that are nothing without an anchor.
ANCHORED = {"ownership", "pledge", "roster"}


def reconstruct(kind: str, inputs: Inputs) -> Rebuilt:
    """The states of one kind (a key of REDUCERS; another is an error), with their completeness and every delta's decision.

    Deltas of a company that has no state are left out; a state without deltas is its anchor's. A kind that needs an
    anchor is incomplete without one. Open gaps that are known make a state incomplete, open conflicts conflicted."""
    if kind not in REDUCERS:
        raise ValueError(f"no such kind of state: {kind}")
    states, deltas, faults = selected(inputs)
    items = inputs.items
    if kind == "pledge":
        deltas, items = (x.withColumn("basis_key", F.coalesce("basis", F.lit(""))) for x in (deltas, items))
    positions, status = REDUCERS[kind](states, deltas, items)
    known = inputs.sides.join(inputs.states, "company").where("available_at <= known_at and (closed_at is null or closed_at > known_at)")
    side = known.groupBy("state_id").agg(F.max(F.col("side") == "conflict").alias("in_conflict"), F.max(F.col("side") == "gap").alias("in_gap"))
    counts = deltas.groupBy("state_id").agg(F.count_if(F.col("decision") == "selected").alias("n_selected"), F.count_if(F.col("decision") != "selected").alias("n_excluded"))
    wrong = faults.groupBy("state_id").agg(F.count("*").alias("n_faults"))
    every = states.join(counts, "state_id", "left").join(status, "state_id", "left").join(side, "state_id", "left").join(wrong, "state_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    done = F.coalesce("status", F.lit("complete"))
    lacks = F.col("anchor_id").isNull() if kind in ANCHORED else F.lit(False)
    completeness = F.when((F.coalesce("n_faults", F.lit(0)) > 0) | (done == "invalid"), "invalid").when((done == "conflicted") | yes("in_conflict"), "conflicted").when((done == "incomplete") | yes("in_gap") | lacks, "incomplete").otherwise("complete")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    summary = every.select("state_id", "anchor_id", zero("n_selected"), zero("n_excluded"), zero("n_issues"), completeness.alias("completeness"))
    return Rebuilt(summary, positions, deltas.select("state_id", "delta_id", "decision"))
