"""Corrections taken one by one, rings and branches; edges of scopes, merges and report versions."""

import datetime as dt

import numpy as np

from pitlake.operators import reports


def one_by_one(changes):
    """Reasons and edges of valid changes (id, previous, replacement) in the order of their ids."""
    first = {}
    for _, a, b in changes:
        first.setdefault(a, b)
    edges, out = {}, {}
    for i, a, b in changes:
        if first[a] != b:
            out[i] = "correction_branch_conflict"
            continue
        at = b
        while at in edges and at != a:
            at = edges[at]
        out[i] = "correction_cycle" if at == a else None
        if at != a:
            edges[a] = b
    return out, edges


def test_corrections_like_one_by_one(spark):
    rng = np.random.default_rng(3)
    n, day = 120, dt.date(2020, 1, 1)
    changes = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, n, (150, 2))) if a != b]
    changes += [(200, 121, 122), (201, 123, 121), (202, 122, 123), (203, 124, 121), (204, 122, 123), (205, 122, 125), (206, 126, 127), (207, 127, 126)]  # rings of three and two
    n += 8
    facts = spark.createDataFrame([(i, "k") for i in range(n)], "fact_id long, fact_key string")
    cited = spark.createDataFrame([(i, 1, day) for i in range(n)], "fact_id long, citation_id long, available_at date")
    rows = [(i, a, b, 1, True, day) for i, a, b in changes]
    rows += [(900, 1, 1, 1, True, day), (901, 1, 777, 1, True, day), (902, 777, 1, 1, True, day), (903, 2, 3, 1, None, day), (904, 2, 3, 2, True, day), (905, 2, 3, 1, True, dt.date(2019, 1, 1))]
    df = spark.createDataFrame(rows, "change_id long, previous_id long, replacement_id long, citation_id long, notice boolean, available_at date")
    judged, stands = reports.corrections(facts, cited, df)
    got = {r.change_id: r.reason for r in judged.collect()}
    want, edges = one_by_one(changes)
    assert {i: got[i] for i in want} == want and "correction_cycle" in want.values()
    assert [got[i] for i in range(900, 906)] == [
        "correction_identity_or_version_mismatch", "correction_replacement_missing", "correction_target_missing", "correction_requires_explicit_notice", "correction_not_cited_by_replacement", "correction_predates_original_evidence",
    ]
    for r in stands.collect():
        at, steps = r.fact_id, 0
        while at in edges:
            at, steps = edges[at], steps + 1
        assert (r.current_id, r.n_steps) == (at, steps)


def test_scope_of_little_history(spark):
    d = dt.date
    c = spark.createDataFrame([(1, d(2020, 12, 31), d(2018, 6, 1), None), (2, d(2020, 12, 31), None, None)], "company long, until date, listed date, since date")
    p = spark.createDataFrame([(1, "Y", d(2017, 12, 31)), (1, "Y", d(2018, 12, 31)), (1, "Y", d(2018, 12, 31)), (1, "Q", d(2019, 6, 30)), (1, "Q", d(2021, 3, 31))], "company long, kind string, end date")
    got = sorted((r.company, r.role, r.period) for r in reports.analysis_scope(c, p).collect())
    quarters = ["Q2018Q2", "Q2018Q3", "Q2018Q4", "Q2019Q1"]
    assert got == sorted([
        (1, "annual", "Y2018"), (1, "business", "Y2018"), (1, "business", "Q2019Q2"), (1, "quarterly", "Q2019Q2"), (1, "before_listing", "Y2017"),
        (1, "dependency", "Y2017"), *[(1, r, q) for r in ("dependency", "missing") for q in quarters],
    ])


def test_merges(spark):
    rows = [("a", "1", "x"), ("a", "1", "x"), ("a", "2", "x"), ("a", "2", None), ("a", None, "x"), ("a", "", "y"), ("b", "1", "x")]
    df = spark.createDataFrame(rows, "field string, k string, v string")
    got = {(r.field, r.key, r.outcome, r.n) for r in reports.merged_by_field(df, df.limit(0), {"a": ["k"], "b": ["k", "v"]}, ["v"]).collect()}
    assert got == {("a", '["1"]', "kept", 2), ("a", '["2"]', "conflicting_material", 2), ("a", None, "identity_missing", 2), ("b", '["1","x"]', "kept", 1)}
    s = spark.createDataFrame([(1, 1.0, "u", 10), (1, 1.0, "u", 11), (2, 1.0, "u", 12), (2, None, "u", 13), (3, None, "u", 14)], "m int, value double, unit string, fact int")
    got = {r.m: (r.value, r.unit, r.conflict, r.n_facts) for r in reports.merged_facts(s, ["m"], ["value", "unit"], "fact").collect()}
    assert got == {1: (1.0, "u", False, 2), 2: (None, None, True, 2), 3: (None, "u", False, 1)}


def test_changes_between_versions(spark):
    r = spark.createDataFrame([(1, "k", 1, "s"), (2, "k", 2, "s"), (3, "k", 3, None), (4, "k", 4, None)], "report_id long, key string, at int, snapshot string")
    facts = spark.createDataFrame([(1, "a", "1"), (2, "a", "1"), (3, "a", "2"), (4, "a", "2"), (4, "b", None)], "report_id long, fact_id string, content string")
    assumed = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (3, 0, None), (4, 0, None)], "report_id long, position int, content string")
    got = {x.report_id: (x.parent_report_id, x.changes) for x in reports.report_changes(r, facts, assumed, "key", ["at"], {"snapshot": "snapshot"}).collect()}
    assert got == {1: (None, "initial"), 2: (1, "unchanged"), 3: (2, "snapshot,facts,assumptions"), 4: (3, "facts")}
