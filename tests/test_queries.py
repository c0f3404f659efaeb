import pytest

from pitlake import registry
from tests.oracle import DATA, differences


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    more, less, n = differences(spark, registry.queries()[name], registry.oracle_sql()[name])
    assert (more, less) == ([], []) and n


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(DATA)).count()


def test_whole_tables(spark):
    import pyarrow.parquet as pq

    def column(table, name):
        return pq.read_table(DATA / f"{table}.parquet", columns=[name]).column(0).to_pylist()

    q, d = registry.queries(), str(DATA)
    customers, events = column("customer", "c_custkey"), column("events", "event_id")
    counts = q["all_dataset_counts"](spark, d).collect()
    assert sum(r.n for r in counts) == len(customers) and {r.n for r in counts if r.segment == "NONE"} == {0}
    assert q["all_fact_lifecycles"](spark, d).count() == len(events)
    assert q["all_dangling_references"](spark, d).count() == sum(2 * e not in set_ for set_ in [set(events)] for e in events)
    assert q["whole_append"](spark, d).count() == len({e for e in events if e % 2})
    nodes = {n for s in column("lineitem", "l_suppkey") for n in (s, s + 1)}
    got = {r.node: r.root for r in q["all_linked_groups"](spark, d).collect()}
    root = {}
    for n in sorted(nodes):
        root[n] = root.get(n - 1, n)
    assert got == root
