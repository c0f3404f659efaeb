"""Releases, corrections, analysis scopes, changes between report versions, and merges of materials by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.functions import rules
from pitlake.operators import evidence, selection
from pitlake.operators.analytics import _cut as cut

#: The checks of a release, in their order.
RELEASE_CHECKS = ("bundle_identity", "candidate_content_identity", "question_coverage", "method_identities", "source_checks", "case_checks", "agent_samples", "human_review")


def release_checks(releases: DataFrame, expected: DataFrame, ready: DataFrame, methods: DataFrame, checks: DataFrame, samples: DataFrame, reviews: DataFrame) -> DataFrame:
    """(release_id, check_name, passed) for the eight checks of each release; every list is joined by its key, none is collected.

    releases (release_id, bundle_id, evidence_bundle_id, content_sha256, recorded_sha256, recorded: whether evidence
    names a content at all); expected (release_id, question_id, step_id); ready (release_id, question_id); methods
    (release_id, method_id, content_sha256); checks (release_id, kind: source or case, method_id, content_sha256,
    accepted); samples (release_id, sample_id, bundle_id, step_id, method_id, accepted): a row for each method of a
    sample; reviews (release_id, review_id, bundle_id, step_id, accepted): a row for each step of a review.

    Coverage and methods must be equal sets without repeats; checks of a kind must all be accepted with the method's
    very content, and reach every method; a sample counts for its step if all its methods are the release's; one review
    must reach all steps."""
    r, hexed = "release_id", lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    asked = expected.groupBy(r, "question_id").agg(F.lit(1).alias("asked"))
    told = ready.groupBy(r, "question_id").agg(F.count("*").alias("told"))
    coverage = asked.join(told, [r, "question_id"], "full").groupBy(r).agg(F.every(F.coalesce((F.col("asked") == 1) & (F.col("told") == 1), F.lit(False))).alias("question_coverage"))
    held = methods.groupBy(r, "method_id").agg(F.count("*").alias("n"), F.min("content_sha256").alias("content"), F.every(hexed("content_sha256") & F.coalesce(F.trim("method_id") != "", F.lit(False))).alias("good"))
    valid = held.groupBy(r).agg(F.every(F.col("good") & (F.col("n") == 1)).alias("method_identities"))
    known = held.where("good").select(r, "method_id", "content")
    seen = checks.groupBy(r, "kind", "method_id").agg(F.every(F.coalesce("accepted", F.lit(False))).alias("accepted"), F.min("content_sha256").alias("low"), F.max("content_sha256").alias("high"), F.count("content_sha256").alias("n_content"), F.count("*").alias("n"))
    each = known.crossJoin(F.broadcast(checks.sparkSession.createDataFrame([("source",), ("case",)], "kind string")))  # two kinds
    each = each.join(seen, [r, "kind", "method_id"], "full")
    fine = F.col("accepted") & (F.col("n") == F.col("n_content")) & (F.col("low") == F.col("content")) & (F.col("high") == F.col("content"))
    done = each.groupBy(r).agg(*[F.every(F.when(F.col("kind") == k, F.coalesce(fine, F.lit(False)))).alias(f"{k}_checks") for k in ("source", "case")])
    steps = expected.select(r, "step_id").distinct()
    named = samples.join(known.select(r, "method_id", F.lit(True).alias("theirs")), [r, "method_id"], "left").join(releases.select(r, F.col("bundle_id").alias("bundle")), r)
    whole = named.groupBy(r, "sample_id", "step_id").agg(F.every(F.coalesce(F.col("accepted") & F.col("theirs") & (F.col("bundle_id") == F.col("bundle")), F.lit(False))).alias("ok")).where("ok")
    sampled = steps.join(whole.select(r, "step_id", F.lit(True).alias("hit")).distinct(), [r, "step_id"], "left").groupBy(r).agg(F.every(F.col("hit").isNotNull()).alias("agent_samples"))
    counted = steps.groupBy(r).agg(F.count("*").alias("n_steps"))
    reached = reviews.join(steps, [r, "step_id"], "left_semi").join(releases.select(r, F.col("bundle_id").alias("bundle")), r)
    reached = reached.groupBy(r, "review_id").agg(F.countDistinct("step_id").alias("n"), F.every(F.coalesce(F.col("accepted") & (F.col("bundle_id") == F.col("bundle")), F.lit(False))).alias("ok"))
    human = reached.join(counted, r).groupBy(r).agg(F.bool_or(F.col("ok") & (F.col("n") == F.col("n_steps"))).alias("human_review"))
    own = releases.select(
        r, ((F.col("bundle_id") != "") & (F.col("bundle_id") == F.col("evidence_bundle_id"))).alias("bundle_identity"),
        (~F.coalesce("recorded", F.lit(False)) | (hexed("content_sha256") & (F.col("content_sha256") == F.col("recorded_sha256")))).alias("candidate_content_identity"),
    )
    every = reduce(lambda a, b: a.join(b, r, "left"), [own, coverage, valid, done, sampled, human])
    # Nothing is accepted of a release whose methods are not valid.
    held_by = {c: F.col("method_identities") if c in ("source_checks", "case_checks") else F.lit(True) for c in RELEASE_CHECKS}
    found = F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.coalesce(F.col(c) & held_by[c], F.lit(False)).alias("passed")) for c in RELEASE_CHECKS]))
    return every.select(r, found.alias("c")).select(r, "c.*")


def corrections(facts: DataFrame, citations: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged changes, and for each fact the one that stands for it now.

    facts (fact_id, fact_key); citations (fact_id, citation_id, available_at); changes (change_id, previous_id,
    replacement_id, citation_id, notice: whether the citation says that it corrects, available_at). The first table has
    change_id and reason (null: accepted); the second fact_id, current_id, n_steps. A fact has one replacement: the
    first change in order of change_id is it, the same one again is accepted, another one is a branch. Of a ring of
    replacements the last change is refused, which is what taking them one by one does. Chains are followed by path
    doubling, so a chain of n needs log2(n) rounds."""
    f = facts.select("fact_id", "fact_key")
    first = citations.groupBy("fact_id").agg(F.min("available_at").alias("first_at"))
    own = citations.select(F.col("fact_id").alias("replacement_id"), "citation_id", F.lit(True).alias("cited")).distinct()
    j = changes.join(f.select(F.col("fact_id").alias("previous_id"), F.col("fact_key").alias("old_key")), "previous_id", "left").join(f.select(F.col("fact_id").alias("replacement_id"), F.col("fact_key").alias("new_key")), "replacement_id", "left")
    j = j.join(first.withColumnRenamed("fact_id", "previous_id"), "previous_id", "left").join(own, ["replacement_id", "citation_id"], "left")
    reason = rules.first_reason(
        ("correction_replacement_missing", F.col("new_key").isNull()), ("correction_requires_explicit_notice", ~F.coalesce("notice", F.lit(False))), ("correction_target_missing", F.col("old_key").isNull()),
        ("correction_identity_or_version_mismatch", (F.col("old_key") != F.col("new_key")) | (F.col("previous_id") == F.col("replacement_id"))),
        ("correction_predates_original_evidence", F.col("available_at") < F.col("first_at")), ("correction_not_cited_by_replacement", F.col("cited").isNull()),
    )
    judged = j.select("change_id", "previous_id", "replacement_id", reason.alias("reason"))
    w = Window.partitionBy("previous_id").orderBy("change_id")
    good = judged.where("reason is null").withColumn("taken", F.first("replacement_id").over(w))
    edges = cut(good.groupBy("previous_id").agg(F.min("taken").alias("replacement_id"), F.min("change_id").alias("change_id")))
    refused = cut(_closing(edges))
    open_ = edges.join(refused, "change_id", "left_anti")
    late = good.select("change_id", F.when(F.col("replacement_id") != F.col("taken"), "correction_branch_conflict").alias("late"))
    ring = edges.join(refused, "change_id", "left_semi").select("previous_id", "replacement_id", F.lit("correction_cycle").alias("ring"))
    out = judged.join(late, "change_id", "left").join(ring, ["previous_id", "replacement_id"], "left").select("change_id", F.coalesce("reason", "late", "ring").alias("reason"))
    there = facts.select("fact_id").distinct()
    ends = selection.ends(open_, "previous_id", "replacement_id").select(F.col("node").alias("fact_id"), F.col("root").alias("current_id"), F.col("depth").alias("n_steps"))
    stands = there.join(ends, "fact_id", "left").select("fact_id", F.coalesce("current_id", "fact_id").alias("current_id"), F.coalesce("n_steps", F.lit(0)).cast("long").alias("n_steps"))
    return out, stands


def _closing(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(change_id) of the last change of each ring in a graph with at most one edge out of a node (previous_id ->
    replacement_id). Nodes that never come to an end lead into rings, those that others
    always reach are on them; the largest change met on the way round is the ring's last."""
    up = edges.select(F.col("previous_id").alias("node"), F.col("replacement_id").alias("to"), F.col("change_id").alias("last"))
    return evidence.on_rings(up, F.greatest, rounds).select(F.col("last").alias("change_id")).distinct()


def analysis_scope(companies: DataFrame, published: DataFrame, years: int = 5, quarters: int = 12, months: int = 60) -> DataFrame:
    """(company, role, period) of what a study of a company reads, and what it lacks.

    companies (company, until, listed, since: dates, the last two may be null); published (company, kind: Y, Q or M,
    end: last day of the period; repeats are one). A period is eligible if it ends by `until`, and neither before the
    listing nor before `since`. Roles: annual, quarterly, monthly (the last so many eligible ones), business (the annual
    ones, the last half-year's second quarter and that of a year before if published and eligible), dependency (the
    year before each annual one; the quarter a year before and the three before each quarterly one), missing (dependencies
    that were not published), before_listing (published by `until` but before the listing)."""
    # A company's periods are few (the calendar bounds them), so they meet in one array by one shuffle.
    ends = published.groupBy("company").agg(F.collect_set(F.struct("kind", "end")).alias("all")).join(companies, "company")
    ends = ends.withColumn("own", F.filter("all", lambda p: p["end"] <= F.col("until")))
    early = lambda p: F.coalesce(p["end"] < F.col("listed"), F.lit(False))
    ends = ends.withColumn("fit", F.filter("own", lambda p: ~early(p) & F.coalesce(p["end"] >= F.col("since"), F.lit(True))))
    of = lambda kind: F.transform(F.filter("fit", lambda p: p["kind"] == kind), lambda p: p["end"])
    last = lambda kind, n: F.slice(F.sort_array(of(kind), asc=False), 1, n)
    ends = ends.select("company", "all", last("Y", years).alias("annual"), last("Q", quarters).alias("quarterly"), last("M", months).alias("monthly"), F.filter(of("Q"), lambda e: F.month(e) == 6).alias("halves"), F.filter("own", early).alias("before"))
    back = lambda kind, b: lambda e: F.struct(F.lit(kind).alias("kind"), F.last_day(F.add_months(e, -b)).alias("end"))
    wants = [F.transform("annual", back("Y", 12)), *(F.transform("quarterly", back("Q", b)) for b in (3, 6, 9, 12))]
    ends = ends.withColumn("wants", F.array_distinct(F.concat(*wants))).withColumn("top", F.array_max("halves"))
    named = lambda role, kind, c: F.transform(c, lambda e: F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), e.alias("end")))
    kinds = lambda role, c: F.transform(c, lambda p: F.struct(F.lit(role).alias("role"), p["kind"].alias("kind"), p["end"].alias("end")))
    half = F.filter("halves", lambda e: (e == F.col("top")) | (e == F.add_months("top", -12)))
    parts = [named("annual", "Y", "annual"), named("quarterly", "Q", "quarterly"), named("monthly", "M", "monthly"), named("business", "Y", "annual"), named("business", "Q", half), kinds("dependency", "wants"), kinds("missing", F.array_except("wants", "all")), kinds("before_listing", "before")]
    found = ends.select("company", F.explode(F.concat(*parts)).alias("p")).select("company", "p.*")
    label = F.concat("kind", F.when(F.col("kind") == "Y", F.year("end").cast("string")).when(F.col("kind") == "Q", F.concat(F.year("end").cast("string"), F.lit("Q"), F.quarter("end").cast("string"))).otherwise(F.date_format("end", "yyyy-MM")))
    return found.select("company", "role", label.alias("period"))


def report_changes(reports: DataFrame, facts: DataFrame, assumptions: DataFrame, key: str, order: list[str], plain: dict[str, str]) -> DataFrame:
    """(report_id, parent_report_id, changes) of each report against the one before of its key: the sections that differ,
    in the order snapshot and so on as `plain` (section -> column of reports) names them, then facts and assumptions.

    facts (report_id, fact_id, content) are compared as sets by id, assumptions (report_id, position, content) as lists.
    Each item meets that of the other version by a key of its own, so no report's items are collected."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = reports.select("report_id", *[F.col(c).alias(f"_{s}") for s, c in plain.items()], F.lag("report_id").over(w).alias("parent_report_id"), *[F.lag(c).over(w).alias(f"_old_{s}") for s, c in plain.items()])
    # An item goes to its own report and to the one that follows: one join brings it to both.
    child = F.lead("report_id").over(w)
    goes = F.filter(F.array(F.when(F.lag("report_id").over(w).isNotNull(), F.struct(F.col("report_id").alias("of"), F.lit(1).alias("side"))), F.when(child.isNotNull(), F.struct(child.alias("of"), F.lit(0).alias("side")))), lambda x: x.isNotNull())
    ways = reports.select("report_id", goes.alias("goes"))

    def differing(items: DataFrame, part: str, name: str) -> DataFrame:
        both = items.join(ways, "report_id").select(F.explode("goes").alias("to"), part, "content").select(F.col("to.of").alias("report_id"), part, F.col("to.side").alias("side"), "content")
        one = both.groupBy("report_id", part).agg((F.min("side") == F.max("side")).alias("alone"), (~F.min("content").eqNullSafe(F.max("content")) | (F.count("content") % 2 == 1)).alias("other"))
        return one.groupBy("report_id").agg(F.bool_or(F.col("alone") | F.col("other")).alias(name))

    j = pairs.join(differing(facts, "fact_id", "_facts"), "report_id", "left").join(differing(assumptions, "position", "_assumptions"), "report_id", "left")
    checks = [(s, ~F.col(f"_{s}").eqNullSafe(F.col(f"_old_{s}"))) for s in plain] + [(s, F.coalesce(F.col(f"_{s}"), F.lit(False))) for s in ("facts", "assumptions")]
    found = F.array_join(rules.reasons(*checks), ",")
    return j.select("report_id", "parent_report_id", F.when(F.col("parent_report_id").isNull(), "initial").when(found == "", "unchanged").otherwise(found).alias("changes"))


def merged_by_field(parent: DataFrame, current: DataFrame, keys: dict[str, list[str]], content: list[str]) -> DataFrame:
    """(field, key, outcome, n) of materials in two lists, each row with a field and a key of that field's columns: `kept`
    where all rows of a key are equal in `content`, `conflicting_material` where they are not, `identity_missing` where
    no column of the key has a value (empty texts are none)."""
    rows = parent.unionByName(current)
    of = lambda cols: F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]))
    empty = lambda cols: reduce(Column.__and__, [F.coalesce(F.col(c).cast("string") == "", F.lit(True)) for c in cols])
    key, none = F.when(F.lit(False), ""), F.when(F.lit(False), False)
    for field, cols in keys.items():
        key, none = key.when(F.col("field") == field, of(cols)), none.when(F.col("field") == field, empty(cols))
    one = rows.select("field", F.when(~none, key).alias("key"), F.xxhash64(*content).alias("h"), F.sha2(of(content), 256).alias("digest"))
    seen = one.groupBy("field", "key").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("differs"))
    return seen.select("field", "key", F.when(F.col("key").isNull(), "identity_missing").when(F.col("differs"), "conflicting_material").otherwise("kept").alias("outcome"), "n")


def merged_facts(rows: DataFrame, keys: list[str], same: list[str], fact_id: str) -> DataFrame:
    """One row for each key: the columns of `same` if all rows agree on them (else null, and conflict is true), and how many
    different facts stand behind it, the smallest and the largest of their ids."""
    differ = reduce(Column.__or__, [F.coalesce(F.min(c) != F.max(c), F.lit(False)) | F.count(c).between(F.lit(1), F.count("*") - 1) for c in same])
    g = rows.groupBy(*keys).agg(differ.alias("conflict"), *[F.min(c).alias(c) for c in same], F.countDistinct(fact_id).alias("n_facts"), F.min(fact_id).alias("first_fact"), F.max(fact_id).alias("last_fact"))
    return g.select(*keys, *[F.when(~F.col("conflict"), F.col(c)).alias(c) for c in same], "conflict", "n_facts", "first_fact", "last_fact")
