"""Spans in texts with their places, identities of events, and report slots filled in the order of their dependence."""

from __future__ import annotations

from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The terms that identify an event, the first known one counts.
IDENTITY_TERMS = ["case_number", "plan_id", "transaction_id", "pledge_id", "holder_id", "target_asset", "bond_code"]
#: Scales of amounts and shares.
SCALES = {"元": 1.0, "万元": 10_000.0, "亿元": 100_000_000.0, "股": 1.0, "万股": 10_000.0, "亿股": 100_000_000.0}


def spans(docs: DataFrame, id_col: str, text: str, fields: dict[str, str], page_break: str = "\f") -> DataFrame:
    """(id, field, nth, start, end, page, value) of every match of each field's pattern in whole texts (ids are unique): places in code
    points from 0, the end excluded; pages from 1. Matches of one field don't overlap; null texts have none. The
    places are running sums over what stands between the matches, so that many matches cost no more each."""
    parts = [F.struct(F.lit(name).alias("field"), F.split(text, p, -1).alias("between"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("found")) for name, p in fields.items()]
    rows = docs.where(F.col(text).isNotNull()).select(id_col, F.explode(F.array(*parts)).alias("x")).where("size(x.found) > 0")
    rows = rows.select(id_col, "x.field", F.posexplode(F.arrays_zip("x.between", "x.found")).alias("nth", "y")).where("y.found is not null")
    w = Window.partitionBy(id_col, "field").orderBy("nth")
    size, breaks = F.char_length("y.found"), lambda c: F.char_length(c) - F.char_length(F.replace(F.col(c), F.lit(page_break), F.lit("")))
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum(F.char_length("y.between")).over(so_far) + F.coalesce(F.sum(size).over(earlier), F.lit(0))
    page = 1 + F.sum(breaks("y.between")).over(so_far) + F.coalesce(F.sum(breaks("y.found")).over(earlier), F.lit(0))
    return rows.select(id_col, "field", "nth", start.alias("start"), (start + size).alias("end"), page.alias("page"), F.col("y.found").alias("value"))


def scaled(value: Column) -> Column:
    """The number of an amount or a number of shares, in units of one; a percentage as a share of one; null for anything else."""
    n = F.regexp_replace(F.regexp_extract(value, r"([-+]?[0-9][0-9,，]*(?:\.[0-9]+)?)", 1), "[,，]", "").try_cast("double")
    unit = F.regexp_extract(value, r"([万亿]?[元股]|[%％])\s*$", 1)
    scales = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return F.when(unit.isin("%", "％"), n / 100).otherwise(n * F.try_element_at(scales, F.when(unit != "", unit)))


def event_identity(kind: Column, terms: Column, summary: Column) -> Column:
    """kind:term:value of the first term (a map) that is known, without blanks and in lower case; else, for dividends, the fiscal
    period that the summary names (a year alone is the whole year); else null."""
    value = lambda k: F.lower(F.regexp_replace(F.try_element_at(terms, F.lit(k)), r"\s+", ""))
    known = [F.when(F.try_element_at(terms, F.lit(k)) != "", F.concat(kind, F.lit(f":{k}:"), value(k))) for k in IDENTITY_TERMS]
    pattern = "(20[0-9]{2})年(年度|半年度|中期|三季度|第一季度)?"
    year, period = F.regexp_extract(summary, pattern, 1), F.regexp_extract(summary, pattern, 2)
    named = F.when(period == "", "年度").when(period == "半年度", "中期").otherwise(period)
    return F.coalesce(*known, F.when((kind == "dividend") & (year != ""), F.concat(F.lit("dividend:"), year, F.lit(":"), named)))


def filled_slots(facts: DataFrame, entity: str, slots: dict[str, tuple]) -> DataFrame:
    """(entity, slot, state, value, lacks) of a report's slots, a row for each entity of the facts (entity, metric, value) and slot.

    A slot is ('fact', metric), or ('add' | 'subtract' | 'divide', slot, slot). Slots are filled in the order of their dependence, a
    circle or an unknown operand is an error. A slot is `present` (a fact), `derived`, `undefined` (a divisor of zero, or
    an operand that is undefined) or `missing`; `lacks` are the metrics that are missing for it. Each metric is one sum
    on the map side, and all slots of an entity are expressions over one row. Facts of one metric are summed; a null
    value is no fact."""
    known = {"fact", "add", "subtract", "divide"}
    for name, s in slots.items():
        if s[0] not in known or (s[0] != "fact" and any(x not in slots for x in s[1:])):
            raise ValueError(f"slot {name} isn't defined by other slots")
    try:
        order = list(TopologicalSorter({n: [] if s[0] == "fact" else s[1:] for n, s in slots.items()}).static_order())
    except CycleError as e:
        raise ValueError(f"slots depend on each other: {e.args[1]}") from e
    metrics = sorted({s[1] for s in slots.values() if s[0] == "fact"})
    row = facts.groupBy(entity).agg(*[F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(f"m{i}") for i, m in enumerate(metrics)])
    value: dict[str, Column] = {}
    lacks: dict[str, Column] = {}
    none = F.array().cast("array<string>")
    for i, name in enumerate(order):
        kind, *of = slots[name]
        if kind == "fact":
            value[name] = F.col(f"m{metrics.index(of[0])}")
            lacks[name] = F.when(value[name].isNull(), F.array(F.lit(of[0]))).otherwise(none)
        else:
            a, b = (F.col(f"v{order.index(x)}") for x in of)
            value[name] = a + b if kind == "add" else a - b if kind == "subtract" else F.when(b != 0, a / b)
            lacks[name] = F.array_sort(reduce(F.array_union, [F.col(f"l{order.index(x)}") for x in of]))
        row = row.withColumns({f"v{i}": value[name], f"l{i}": lacks[name]})
    out = [F.struct(F.lit(n).alias("slot"), F.when(F.size(f"l{i}") > 0, "missing").when(F.col(f"v{i}").isNull(), "undefined").otherwise("present" if slots[n][0] == "fact" else "derived").alias("state"), F.col(f"v{i}").cast("double").alias("value"), F.col(f"l{i}").alias("lacks")) for i, n in enumerate(order)]
    return row.select(entity, F.inline(F.array(*out)))
