"""Admission gates, kinds of documents, checks of claims and answers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlake.functions import rules

#: Words of titles, in the order in which they are tried.
PROCEDURAL = ("取消会议", "会议通知", "股东大会的通知", "股东大会通知", "法律意见书", "表决结果", "英文")
FILING_USES = (
    ("statements", "年度报告|半年度报告|季度报告"), ("business", "经营|产销|调价|重大事项|业绩说明|投资者关系"), ("governance", "留置|立案|处罚|诉讼|担保|关联交易|内部控制|风险评估|辞职|聘任|董事会.*决议|监事会.*决议"),
    ("capital", "分红|利润分配|权益分派|回购|增发|募集资金|投资项目|增持|减持|质押|解禁|股权激励|股东大会.*决议"),
)
PERIOD_PAIRS = (("valid_from", "valid_to"), ("fiscal_period_start", "fiscal_period_end"), ("report_period_start", "report_period_end"), ("period_start", "period_end"), ("issued_at", "responded_at"), ("grant_at", "vesting_start_at"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def field_failure(f: dict[str, Column], rule: dict[str, Column]) -> Column:
    """Code of the first reason against a field, null for none: without a rule by its nature and whether it is known,
    else definition, identity, locator, value, unit, quality, nature and event, in this order."""
    no_rule = rule["standard_field"].isNull()
    actual = ("forecast", "provider_estimate", "platform_label", "source_text")
    without = F.when(f["nature"].isin(*actual), "nature_not_actual_fact").when(~f["known"], "unknown_field").otherwise(F.coalesce(f["rejection"], F.lit("standard_mapping_missing")))
    named = rules.first_reason(
        ("definition_version_missing_or_mismatched", ~same(f["definition_version"], f["registry_version"])),
        ("field_mapping_or_identity_mismatch", ~f["known"] | ~same(f["standard_field"], rule["standard_field"]) | ~same(f["dataset"], f["job_dataset"])),
        ("field_locator_missing_or_mismatched", f["row_key"].isNull() | ~same(f["path"], F.concat(F.lit("$."), f["raw_name"]))),
        ("original_value_mismatch", ~same(f["row_value"], f["value"])), ("unit_missing_or_conflicting", f["unit"].isNull() | ~same(f["unit"], rule["unit"])),
        ("quality_or_nature_not_admissible", ~same(f["quality"], F.lit("passed")) | ~same(f["nature"], rule["nature"])), ("nature_not_actual_fact", ~rule["nature"].isin("observed", "deterministic", "announced_plan")),
        ("event_definition_missing", (rule["nature"] == "announced_plan") & (f["job_dataset"] != "dividend")),
    )
    return F.when(no_rule, without).otherwise(named)


def filing_use(title: Column) -> Column:
    """struct<category, reason> of a filing: procedure and other languages first, then summaries, then what it is for."""
    veto = F.lit(False)
    for word in PROCEDURAL:
        veto |= title.contains(word)
    pair = lambda c, r: F.struct(F.lit(c).cast("string").alias("category"), F.lit(r).alias("reason"))
    out = pair(None, "no_default_use_identified")
    for name, pattern in reversed(FILING_USES):
        out = F.when(title.rlike(pattern), pair(name, "research_relevant_filing")).otherwise(out)
    return F.when(veto, pair(None, "procedural_or_duplicate_language")).when(title.contains("摘要"), pair(None, "summary_duplicates_full_filing")).otherwise(out)


def material_type(title_type: Column, body_type: Column) -> Column:
    """struct<type, status> from the types of title and heading: agreement, a heading where the title says nothing, or
    a review."""
    other = F.lit("other_announcement")
    pair = lambda t, s: F.struct(t.alias("type"), s.alias("status"))
    agree = F.when(title_type == other, "unclassified").otherwise("title_body_agree")
    return F.when(body_type.isNull(), pair(title_type, F.lit("title_only"))).when(title_type == body_type, pair(title_type, agree)).when((title_type == other) & (body_type != other), pair(body_type, F.lit("content_heading"))).otherwise(pair(title_type, F.lit("requires_review")))


def period_disorder(pairs: list[tuple[str, Column, str, Column]]) -> Column:
    """`end precedes start` of the first pair in disorder."""
    return rules.first_reason(*[(f"{b} precedes {a}", (y < x)) for a, x, b, y in pairs])


def answer_state(n_valid: Column, n_values: Column, parsed: Column, absent: Column, bounded: Column) -> Column:
    """Why a question isn't answered, null if it is: only located answers that agree count, and an absence needs its
    period."""
    return rules.first_reason(
        ("parsed_but_requirement_unanswered", (n_valid == 0) & parsed), ("reading_material_or_answer_missing", n_valid == 0), ("conflicting_located_answers", n_values != 1), ("negative_fact_period_unbounded", absent & ~bounded)
    )
