"""Outcomes of attempts, windows, periods, titles, names and identities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlake.functions import rules

#: Words of titles and names.
NOT_A_REPORT = ("摘要", "英文版", "取消", "社会责任", "审计报告")
REPORT_WORDS = (("q1", ("第一季度报告", "一季度报告"), 3, 31), ("h1", ("半年度报告", "中期报告"), 6, 30), ("q3", ("第三季度报告", "三季度报告"), 9, 30), ("annual", ("年度报告",), 12, 31))
ANONYMOUS = ("匿名", "未披露", "未公开", "-", "--")
SCALES = {"元": 1.0, "万元": 10_000.0, "亿元": 100_000_000.0, "股": 1.0, "万股": 10_000.0, "亿股": 100_000_000.0}


def attempt_outcome(status: Column, policy: Column, denied: Column, marker: Column, mime_ok: Column, schema_ok: Column, committed: Column) -> Column:
    """struct<outcome, reason, retryable> of one response, first match wins; what would be a failure is `partial` once
    segments are committed."""
    code = lambda x: F.concat(F.lit("http_"), x.cast("string"))
    cases = [
        (policy.isNotNull(), "policy_skipped", policy, False), (status == 429, "rate_limited", F.lit("upstream_rate_limited"), True), (status == 401, "login_required", code(status), False),
        (status == 402, "paywalled", code(status), False), (status == 403, "restricted", code(status), False), (status.isin(408, 504), "timeout", code(status), True), (status >= 500, "network_failed", code(status), True),
        (status >= 400, "network_failed", code(status), False), (denied, "restricted", F.lit("upstream_bot_challenge"), False), (marker == "paywall", "paywalled", F.lit("paywall_detected"), False),
        (marker == "login", "login_required", F.lit("login_page_detected"), False), (marker == "challenge", "restricted", F.lit("challenge_page_detected"), False), (~mime_ok, "parse_failed", F.lit("unexpected_mime"), False),
        (~schema_ok, "parse_failed", F.lit("schema_validation_failed"), False),
    ]
    out = F.struct(F.lit("success").alias("outcome"), F.lit("protocol_success").alias("reason"), F.lit(False).alias("retryable"))
    for test, outcome, reason, again in reversed(cases):
        out = F.when(test, F.struct(F.when(committed, "partial").otherwise(outcome).alias("outcome"), reason.alias("reason"), F.lit(again).alias("retryable"))).otherwise(out)
    return out


def discovery_outcome(n: Column, schema_ok: Column, proven: Column, terminal: Column, declared: Column, total: Column, unchanged: Column) -> Column:
    """Reason code of a finished discovery; only a terminal query whose declared total is zero proves that there is no data."""
    closes = declared.isNull() | (declared == total)
    return rules.first_reason(
        ("valid_discovery_anchor", unchanged), ("schema_validation_failed", ~schema_ok), ("discovery_terminal_proof_missing", ~(proven & terminal & closes)), ("negative_discovery_count", (n < 0) | (total < 0)),
        ("discovery_terminal_proof_missing", (n == 0) & (declared.isNull() | (declared != 0))), ("validated_empty_result", n == 0), ("validated_nonempty_result", F.lit(True)),
    )


def market_state(is_open: Column, trade_status: Column, close: Column) -> Column:
    """State of a market row; an empty close is not zero."""
    return F.when(~is_open, "non_trading_day").when(F.trim(trade_status) == "0", "suspended").when(close.isNull() | (F.trim(close) == ""), "source_empty").otherwise("traded")


def post_event_available(event: Column, horizon: Column, retrieved: Column) -> Column:
    """When an outcome may be used: after its horizon and its retrieval; null if the horizon precedes the event."""
    return F.when(horizon >= event, F.greatest(horizon, retrieved))


def incremental_window(safe_through: Column, overlap_days: int, as_of: Column) -> Column:
    """struct<start, end, refused>: from the watermark less the overlap; none without a watermark or behind as_of."""
    start = F.date_sub(safe_through, overlap_days)
    refused = F.when(safe_through.isNull(), "no_watermark").when(as_of <= start, "as_of_before_overlap")
    return F.struct(F.when(refused.isNull(), start).alias("start"), F.when(refused.isNull(), as_of).alias("end"), refused.alias("refused"))


def event_window(last: Column, marked: Column, as_of: Column, overlap_days: int = 30) -> Column:
    """struct<start, limitation>: a source that marks updates starts where it ended, others look back over the overlap."""
    back = F.date_sub(as_of, overlap_days)
    return F.struct(F.when(marked, F.coalesce(last, as_of)).otherwise(F.least(F.coalesce(last, back), back)).alias("start"), F.when(~marked, "silent_revisions_before_overlap_are_not_guaranteed").alias("limitation"))


def period_start(end: Column, kind: Column) -> Column:
    """First day of a period by its end and kind."""
    first = F.make_date(F.year(end), F.lit(1), F.lit(1))
    return F.when(kind.isin("cumulative", "annual"), first).when(kind == "single_quarter", F.trunc(F.add_months(end, -2), "month")).when(kind == "ttm", F.date_add(F.add_months(end, -12), 1))


def report_windows(as_of: Column, years: int, quarters: int) -> Column:
    """struct<annual, quarters, dependencies>: period ends that must have been reported by as_of (annual and first
    quarter by 30 April, half-year by 31 August, third quarter by 31 October), and the same periods a year before."""
    y, past = F.year(as_of), lambda m, d: as_of >= F.make_date(F.year(as_of), F.lit(m), F.lit(d))
    top = y - F.when(past(4, 30), 1).otherwise(2)
    annual = F.transform(F.sequence(top - (years - 1), top), lambda x: F.make_date(x, F.lit(12), F.lit(31)))
    latest = F.when(past(10, 31), F.make_date(y, F.lit(9), F.lit(30))).when(past(8, 31), F.make_date(y, F.lit(6), F.lit(30))).when(past(4, 30), F.make_date(y, F.lit(3), F.lit(31))).otherwise(F.make_date(y - 1, F.lit(9), F.lit(30)))
    ends = F.transform(F.sequence(F.lit(quarters - 1), F.lit(0)), lambda k: F.last_day(F.add_months(latest, -3 * k)))
    before = F.transform(F.concat(annual, ends), lambda d: F.add_months(d, -12))
    need = F.array_sort(F.array_distinct(F.concat(before, F.array(F.add_months(annual[0], -12)))))
    return F.struct(annual.alias("annual"), ends.alias("quarters"), need.alias("dependencies"))


def filing_period(title: Column) -> Column:
    """struct<kind, period_end> of a report's title; null where a word rules it out, or without a year or a kind."""
    t = F.regexp_replace(title, r"\s+", "")
    veto = F.lit(False)
    for w in NOT_A_REPORT:
        veto |= t.contains(w)
    year = F.when(t.rlike(r"20\d{2}年"), F.regexp_extract(t, r"(20\d{2})年", 1)).cast("int")
    out = F.when(t.rlike(r"\d{4}年年报(?:（.*?）)?$"), F.struct(F.lit("annual").alias("kind"), F.make_date(year, F.lit(12), F.lit(31)).alias("period_end")))
    for kind, words, month, day in reversed(REPORT_WORDS):
        hit = F.lit(False)
        for w in words:
            hit |= t.contains(w)
        out = F.when(hit, F.struct(F.lit(kind).alias("kind"), F.make_date(year, F.lit(month), F.lit(day)).alias("period_end"))).otherwise(out)
    return F.when(~veto & year.isNotNull(), out)


def text_amount(text: Column) -> Column:
    """The first amount or number of shares in a text, in yuan or shares; null without one."""
    unit = F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(亿元|万元|元|亿股|万股|股)", 2)
    number = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(亿元|万元|元|亿股|万股|股)", 1), ",", "")
    scale = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return F.when(unit != "", number.cast("double") * F.try_element_at(scale, unit))


def text_ratio(text: Column) -> Column:
    r = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1)
    return F.when(r != "", r.cast("double") / 100)


def text_date(text: Column) -> Column:
    """The first date in a text (year, month, day by 年月日 or slashes); null without a valid one."""
    part = lambda i: F.regexp_extract(F.regexp_replace(text, r"\s+", ""), r"(20\d{2})[年/](\d{1,2})[月/](\d{1,2})", i)
    return F.try_to_date(F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))), "yyyy-MM-dd")


def security_query(text: Column) -> Column:
    """struct<code, market> of a security query: six digits, with a market before or behind."""
    t = F.replace(F.upper(F.trim(text)), F.lit(" "), F.lit(""))
    market = lambda m: F.when(m.isin("SH", "SS", "XSHG"), "SH").when(m.isin("SZ", "XSHE"), "SZ").when(m == "BJ", "BJ")
    plain, behind, before = r"^([0-9]{6})$", r"^([0-9]{6})[.-](.*)$", r"^(SH|SZ|BJ)([0-9]{6})$"
    pair = lambda c, m: F.struct(c.alias("code"), m.alias("market"))
    none = F.lit(None).cast("string")
    return (
        F.when(t.rlike(plain), pair(t, none)).when(t.rlike(behind), pair(F.regexp_extract(t, behind, 1), market(F.regexp_extract(t, behind, 2))))
        .when(t.rlike(before), pair(F.regexp_extract(t, before, 2), market(F.regexp_extract(t, before, 1)))).otherwise(pair(none, none))
    )


def counterparty(code: Column, name: Column, may_be_anonymous: bool = True) -> Column:
    """struct<kind, key>: coded identities stay apart, and a name alone is never an identity."""
    blank = lambda x: F.when(F.trim(x) != "", F.trim(x))
    code, name = blank(code), blank(name)
    anonymous = F.lit(may_be_anonymous) & (name.isNull() | name.isin(*ANONYMOUS))
    kind = F.when(code.isNotNull(), "source_code").when(anonymous, "anonymous").when(name.isNotNull(), "name_only").otherwise("missing")
    return F.struct(kind.alias("kind"), F.when(code.isNotNull(), F.concat(F.lit("source-code:"), code)).alias("key"))


def combined_status(states: Column) -> Column:
    """One status of several materials' states (a set)."""
    n = F.size(states)
    readable = F.arrays_overlap(states, F.array(*map(F.lit, ("original_readable", "verified_none", "formal_numeric"))))
    return F.when(n == 0, "unavailable").when(n == 1, F.try_element_at(states, F.lit(1))).when(readable, "original_readable").when(F.array_contains(states, "alternative"), "alternative").when(F.array_contains(states, "processing"), "processing").otherwise("unavailable")


def redacted(text: Column) -> Column:
    """Text without secrets, home paths and the queries of addresses."""
    for pattern, put in ((r"(?i)(token|secret|password|api[_-]?key)\s*[=:]\s*[^\s&\"]+", "$1=[redacted]"), (r"/(?:home|Users)/[^\s\"]+", "[path]"), (r"(https?://[^\s?\"]+)\?[^\s\"]*", "$1?[query]")):
        text = F.regexp_replace(text, pattern, put)
    return text
