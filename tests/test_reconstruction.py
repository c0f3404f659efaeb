"""States of six kinds against plain loops over random histories."""

import random
from collections import Counter

import pytest

from pitlake.operators import reconstruction as rec

ITEMS = "anchor_id long, subject string, other string, quantity long, unit string, basis string"
ANCHORS = "company long, anchor_id long, reference_at long, available_at long, complete boolean, supersedes long, withdrawn boolean"
DELTAS = "company long, delta_id long, effective_at long, announced_at long, available_at long, supersedes long, withdrawn boolean, subject string, other string, action string, quantity long, unit string, basis string, valid_to long"


def history(seed):
    r = random.Random(seed)
    anchors, items, deltas, n = [], [], [], 100
    for c in range(60):
        for i in range(r.randint(0, 3)):
            n += 1
            old = anchors[-1] if i and r.random() < 0.4 else None
            anchors.append((c, n, r.randint(0, 30), r.randint(0, 50), r.random() < 0.8, old[1] if old else None, r.random() < 0.1))
            items += [(n, s, o, r.randint(20, 60), "shares", "total") for s, o in {(r.choice("abc"), r.choice(["chair", "ceo"])) for _ in range(3)}]
        mine = []
        for _ in range(r.randint(0, 9)):
            n += 1
            at = r.randint(0, 80)
            old = r.choice(mine) if mine and r.random() < 0.15 else None
            mine.append(n)
            role = r.choice(["chair", "ceo", "ceo"])
            deltas.append((c, n, at, at, at + r.choice([0, 0, 3, 20]), old, r.random() < 0.05, r.choice("abc"), role, r.choice(["appoint", "dismiss", "increase", "decrease", "pledge"]), r.choice([1, 2, 5, 40, 9, None]), r.choice(["shares"] * 9 + ["lots"]), r.choice(["total"] * 9 + ["free"]), r.choice([None, at + 10, at + 40])))
        if c % 7 == 0 and mine:  # a resignation without a role
            n += 1
            deltas.append((c, n, 60, 60, 60, None, False, "a", None, "resign", 1, "shares", "total", None))
    deltas += [(59, 9001, 5, 5, 5, 9002, False, "a", "ceo", "appoint", 1, "shares", "total", None), (59, 9002, 5, 5, 5, 9001, False, "a", "ceo", "appoint", 1, "shares", "total", None)]  # a cycle
    sides = [(c, s, 10, r.choice([None, 45])) for c in range(60) for s in ("gap", "conflict") if r.random() < 0.08]
    states = [(100 * c + i, c, at, known) for c in range(61) for i, (at, known) in enumerate([(40, 30), (70, 60), (90, 200)])]
    return states, anchors, items, deltas, sides


def versions(rows, known, at, link, id_, gone):
    seen = [x for x in rows if x[at] <= known]
    ids = {x[id_]: x for x in seen}
    by = Counter(x[link] for x in seen if x[link] is not None)
    fault = any(n > 1 for n in by.values()) or any(x[link] is not None and (x[link] not in ids or x[at] < ids[x[link]][at]) for x in seen)
    for x in seen:
        way, cur = set(), x
        while cur is not None and cur[id_] not in way:
            way.add(cur[id_])
            cur = ids.get(cur[link])
        fault |= cur is not None and cur[id_] == x[id_] and x[link] is not None
    return {x[id_]: "available_after_known_at" if x[at] > known else "superseded" if x[id_] in by else "withdrawn" if x[gone] else "head" for x in rows}, fault


def plain(kind, states, anchors, items, deltas, sides):
    summary, positions = {}, set()
    for sid, c, at, known in states:
        da, fault_a = versions([a for a in anchors if a[0] == c], known, 3, 5, 1, 6)
        fit = [a for a in anchors if a[0] == c and da[a[1]] == "head" and a[4] and a[2] <= at]
        anchor = max(fit, key=lambda a: (a[2], a[3], a[1]), default=None)
        mine = [d for d in deltas if d[0] == c]
        dd, fault_d = versions(mine, known, 4, 5, 1, 6)
        chosen = sorted((d for d in mine if dd[d[1]] == "head" and d[2] <= at and not (anchor and d[2] <= anchor[2])), key=lambda d: (d[2], d[3], d[1]))
        held = [i for i in items if anchor and i[0] == anchor[1]]
        status, issues = "complete", 0
        if kind in ("ownership", "pledge"):
            key = (lambda s, o, b: (s,)) if kind == "ownership" else (lambda s, o, b: (s, o, b or ""))
            pos = {}
            for i in held:
                pos[key(i[1], i[2], i[5])] = [i[3], i[4], i[5], True, 0, 0]
            for d in chosen:
                p = pos.setdefault(key(d[7], d[8], d[12]), [None, None, None, False, 0, 0])
                if p[3] and None not in d[10:13] and p[1] in (None, d[11]) and p[2] in (None, d[12]):
                    p[0] += d[10] if d[9] in rec.PLUS else -d[10]
                    p[4] += 1
                    status = "invalid" if p[0] < 0 else status
                else:
                    p[3], p[5] = False, p[5] + 1
            issues = sum(p[5] for p in pos.values())
            status = status if status == "invalid" or not issues else "incomplete"
            positions |= {(sid, *k, p[0] if p[3] else None, p[4], p[5]) for k, p in pos.items()}
        elif kind == "roster":
            open_, wrong = {(i[1], i[2]): anchor[2] for i in held}, []
            for d in chosen:
                if d[9] == "appoint":
                    open_[d[7], d[8]] = d[2]
                    continue
                m = [k for k in open_ if k[0] == d[7] and d[8] in (None, k[1])]
                if len(m) == 1:
                    del open_[m[0]]
                else:
                    wrong.append((sid, d[7], d[8], d[2], "ambiguous" if m else "close_without_open"))
            chairs = sum(o == "chair" for _, o in open_)
            rows = [(sid, s, o, t, "overlap" if o == "chair" and chairs > 1 else None) for (s, o), t in open_.items()] + wrong
            issues = sum(x[4] is not None for x in rows)
            status = "conflicted" if chairs > 1 else "incomplete" if issues else "complete"
            positions |= set(rows)
        else:
            good = [d for d in chosen if kind == "annual" or d[13] is None or at < d[13]]
            if kind == "annual":
                good = [d for d in good if d[12] == max(x[12] for x in good if x[7] == d[7])]
            cols = {"control": (7, 8), "annual": (7, 12), "interval": (7, 8, 12)}[kind]
            by = {}
            for d in good:
                by.setdefault(tuple(d[i] for i in cols), []).append(d)
            for k, v in by.items():
                if len({(d[9], d[10], d[11]) for d in v}) > 1:
                    issues += 1
                else:
                    positions.add((sid, *k, min(d[1] for d in v), v[0][10]))
            status = "conflicted" if issues else "complete"
        known_sides = {s for cc, s, a, closed in sides if cc == c and a <= known and (closed is None or closed > known)}
        if fault_a or fault_d or status == "invalid":
            out = "invalid"
        elif status == "conflicted" or "conflict" in known_sides:
            out = "conflicted"
        elif status == "incomplete" or "gap" in known_sides or (kind in rec.ANCHORED and anchor is None):
            out = "incomplete"
        else:
            out = "complete"
        summary[sid] = (anchor and anchor[1], len(chosen), len(mine) - len(chosen), issues, out)
    return summary, positions


@pytest.fixture(scope="module")
def inputs(spark):
    states, anchors, items, deltas, sides = history(3)
    made = rec.Inputs(
        spark.createDataFrame(states, "state_id long, company long, state_at long, known_at long"), spark.createDataFrame(anchors, ANCHORS), spark.createDataFrame(items, ITEMS), spark.createDataFrame(deltas, DELTAS),
        spark.createDataFrame(sides, "company long, side string, available_at long, closed_at long"),
    )
    return made, (states, anchors, items, deltas, sides)


@pytest.mark.parametrize("kind", rec.REDUCERS)
def test_against_loops(inputs, kind):
    made, rows = inputs
    if kind == "ownership":  # one item a subject
        seen = {}
        for i in rows[2]:
            seen.setdefault((i[0], i[1]), i)
        rows = (*rows[:2], list(seen.values()), *rows[3:])
        made = rec.Inputs(made.states, made.anchors, made.items.sparkSession.createDataFrame(rows[2], ITEMS), made.deltas, made.sides)
    got = rec.reconstruct(kind, made)
    summary, positions = plain(kind, *rows)
    assert {r.state_id: tuple(r)[1:] for r in got.summary.collect()} == summary
    assert Counter(tuple(r) for r in got.positions.collect()).keys() == positions
    assert len({x[4] for x in summary.values()}) >= 3


def test_unknown_kind(inputs):
    with pytest.raises(ValueError, match="no such kind"):
        rec.reconstruct("weather", inputs[0])
