"""Strongly connected parts against a plain search over random graphs; control states against plain loops."""

import random

import pytest

from pitlake.operators import graphs


def reached(edges, start):
    seen, todo = set(), [b for a, b in edges if a == start]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for a, b in edges if a == x]
    return seen


def plain(edges):
    nodes = {x for e in edges for x in e}
    to = {x: reached(edges, x) for x in nodes}
    parts = {x: {y for y in to[x] if x in to[y]} for x in nodes}
    return {(x, max(p), len(p)) for x, p in parts.items() if x in p}


GRAPHS = {
    "random": lambda r: {(r.randint(0, 40), r.randint(0, 40)) for _ in range(60)},
    "sparse": lambda r: {(r.randint(0, 60), r.randint(0, 60)) for _ in range(55)},
    "dense": lambda r: {(r.randint(0, 12), r.randint(0, 12)) for _ in range(60)},
    "path and ring": lambda r: {(i, i + 1) for i in range(15)} | {(20 + i, 20 + (i + 1) % 9) for i in range(9)} | {(7, 22), (3, 3)},
    "hub": lambda r: {(0, i) for i in range(1, 40)} | {(i, 0) for i in range(1, 40, 3)},
    "none": lambda r: {(i, i + 100) for i in range(10)},
}


@pytest.mark.parametrize("name", GRAPHS)
def test_strong_components(spark, name):
    edges = GRAPHS[name](random.Random(4))
    df = spark.createDataFrame([*edges, *list(edges)[:3], (None, 1), (1, None)], "x long, y long")
    assert {tuple(r) for r in graphs.strong_components(df, "x", "y").collect()} == plain(edges)


def test_no_edges_and_too_few_rounds(spark):
    df = spark.createDataFrame([], "x long, y long")
    assert graphs.strong_components(df, "x", "y").count() == 0
    ring = spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)], "x long, y long")
    with pytest.raises(RuntimeError):
        graphs.strong_components(ring, "x", "y", rounds=5)


def test_control_state(spark):
    r = random.Random(9)
    rows = []
    for i in range(160):
        a, b = r.sample(range(12), 2)
        path = [a, r.randrange(12), b] if r.random() < 0.2 else [a, b]
        rows.append((i, r.randint(1, 4), a, b, "shares", "indirect" if len(path) == 3 else "direct", path, r.randint(0, 5), r.choice([None, 4, 7, 9]), r.randint(0, 9), r.choice([None, None, r.randrange(160)])))
    states = [(10 * c + t, c, t, k) for c in range(1, 6) for t, k in ((3, 5), (5, 9), (8, 9))]
    rel = spark.createDataFrame(rows, "record_id long, company long, controller long, controlled long, kind string, direction string, path array<long>, valid_from long, valid_to long, available_at long, supersedes long")
    st = spark.createDataFrame(states, "state_id long, company long, state_at long, known_at long")
    got = {x.state_id: tuple(x)[1:] for x in graphs.control_state(rel, st, "company").collect()}
    want = {}
    for sid, c, at, known in states:
        seen = [x for x in rows if x[1] == c and x[9] <= known]
        held = [x for x in seen if x[0] not in {y[10] for y in seen} and x[7] <= at and (x[8] is None or at < x[8])]
        keys = {}
        for x in held:
            keys.setdefault((x[2], x[3]), []).append(x)
        good = [v[0] for v in keys.values() if len({(x[5], tuple(x[6])) for x in v}) == 1]
        direct = {(x[2], x[3]) for x in good if x[5] == "direct"}
        unproven = sum(x[5] == "indirect" and any(p not in direct for p in zip(x[6], x[6][1:])) for x in good)
        cyclic, conflicts = len(plain({(x[2], x[3]) for x in good})), len(keys) - len(good)
        want[sid] = ("cyclic" if cyclic else "unproven" if unproven else "conflicted" if conflicts else "complete", len(good), conflicts, unproven, cyclic)
    assert got == want and {x[0] for x in want.values()} >= {"cyclic", "complete"}


def _cuts(monkeypatch, *modules):
    """What is written to the shared folder, counted."""
    made = []
    for m in modules:
        for name in ("cut", "_cut"):
            if hasattr(m, name):
                monkeypatch.setattr(m, name, lambda df, old=getattr(m, name): made.append(1) or old(df))
    return made


def test_rings_rounds_by_length(spark, monkeypatch):
    """Rounds grow with the longest way, not with the nodes: 2000 rings of three, ways into them and ways that end."""
    from pitlake.operators import evidence

    rings = [(10 * i + k, 10 * i + (k + 1) % 3) for i in range(2000) for k in range(3)]
    ways = [(10 * i + k, 10 * i + k + 1) for i in range(0, 2000, 7) for k in (5, 6)] + [(10 * i + 3, 10 * i) for i in range(0, 2000, 3)] + [(10 * i + 4, 10 * i + 3) for i in range(0, 2000, 3)]
    edges = spark.createDataFrame([*rings, *ways, (7, 99_999), (99_999, 99_999)], "a long, b long")
    made = _cuts(monkeypatch, evidence)
    got = sorted(r.node for r in evidence.cycles(edges, "a", "b").collect())
    assert got == [10 * i for i in range(2000)] + [99_999] and len(made) < 8
    assert evidence.cycles(edges.where("a % 10 > 4 and a < 99999"), "a", "b").count() == 0
    assert evidence.cycles(edges.limit(0), "a", "b").count() == 0


def test_lineage_writes_pairs_once(spark, monkeypatch):
    """A chain's pairs are written once; cycles and several parents give the same pairs as a plain search."""
    from pitlake.operators import evidence

    def reach(edges):
        out = set(edges)
        while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
            out |= more
        return out

    for edges in ([(i, i // 2) for i in range(2, 40)], [(1, 2), (2, 3), (3, 1), (4, 1), (9, 8)], [(1, 1)], [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 2)], [(i, i + 1) for i in range(17)], []):
        df = spark.createDataFrame(edges, "a long, b long")
        got = [tuple(r) for r in evidence.lineage(df, "a", "b").collect()]
        assert sorted(got) == sorted(reach(set(edges)))
    sizes = []
    monkeypatch.setattr(evidence, "_cut", lambda df, old=evidence._cut: (out := old(df), sizes.append(out.count()))[0])
    assert evidence.lineage(spark.createDataFrame([(i, i + 1) for i in range(32)], "a long, b long"), "a", "b").count() == 528
    assert sum(sizes) < 2 * 528


def test_ends(spark):
    """Root and depth by one doubling, as roots and depths give them; a chain that ended is not written again."""
    from pitlake.operators import selection

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30 + i, 20) for i in range(5)] + [(40, 41)], "a long, b long")
    got = {r.node: (r.root, r.depth) for r in selection.ends(edges, "a", "b").collect()}
    want = {r.node: r.root for r in selection.roots(edges, "a", "b").collect()}, {r.node: r.depth for r in selection.depths(edges, "a", "b").collect()}
    assert got == {n: (want[0][n], want[1][n]) for n in want[0]} and got[0] == (20, 20) and got[40] == (41, 1)
    assert selection.ends(edges.limit(0), "a", "b").count() == 0
