"""Fuzzy line dedup with its production settings against brute force."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pitlake.llm import lines, queries

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
COMMON = WORDS[:12]


def prose(n):
    return [rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n)]


def lettered(i):
    return "q" + "".join(chr(97 + int(c)) for c in str(i))


def edited(words, k):
    w = list(words)
    for _ in range(k):
        i = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.6:
            w[i] = rng.choice(WORDS)
        elif kind < 0.8 and len(w) > 5:
            del w[i]
        else:
            w.insert(i, rng.choice(WORDS))
    return w


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def similar(a, b):
    return distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


def test_edit_distance():
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert lines.edit_distance(a, b) == distance(a, b)
        assert lines.similar(a, b, 0.8) == similar(a, b)


@pytest.fixture(scope="module")
def corpus():
    bases = [prose(n) for n in (5, 6, 8, 10, 10, 12, 15, 20, 30, 45, 60, 90) for _ in range(8)]
    out = []
    for w in bases:
        out += [w] + [edited(w, rng.randint(1, max(1, len(w) // 5))) for _ in range(3)]
    out += [[*prose(6), *out[0]][:9] for _ in range(20)] + [prose(rng.randint(5, 30)) for _ in range(200)]
    rng.shuffle(out)
    return out


def groups(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("how", [{}, {"dense_above": 2, "per_bucket": 500}])
def test_recall_and_precision(spark, corpus, how):
    """One line a document: of all pairs that are similar, nine in ten and more end in one group; no group has a
    line without a similar one in it."""
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(corpus)], "doc_id long, text string").repartition(4)
    gone = {r.doc_id for r in lines.repeated_lines(df, **how).collect()}
    pairs = [(i, j) for j in range(len(corpus)) for i in range(j) if abs(len(corpus[i]) - len(corpus[j])) <= 20 and similar(corpus[i], corpus[j])]
    want = groups(range(len(corpus)), pairs)
    expected = {i for i, r in want.items() if r != i}
    linked = {x for p in pairs for x in p}
    assert len(pairs) > 250 and gone <= linked
    assert len(gone & expected) >= 0.95 * len(expected) and len(gone - expected) <= 0.05 * len(expected)


def test_recall_on_documents(spark):
    """Links of the distinct lines of sf0.01, with the settings of the query: at least 0.9 of brute force over lines
    that share two words in a row."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    forms = sorted({" ".join(lines.line_words(x)) for r in docs.select("text").collect() for x in (r.text or "").split("\n")})
    forms = [w for w in map(str.split, forms) if 5 <= len(w) <= 60]
    by = {}
    for i, w in enumerate(forms):
        for g in zip(w, w[1:]):
            by.setdefault(g, set()).add(i)
    pairs = {(i, j) for s in by.values() if 1 < len(s) <= 60 for i in s for j in s if i < j}
    pairs = [(i, j) for i, j in pairs if lines.similar(forms[i], forms[j], 0.8)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(forms)], "doc_id long, text string")
    gone = {r.doc_id for r in lines.repeated_lines(df).collect()}
    expected = {i for i, r in groups(range(len(forms)), pairs).items() if r != i}
    assert len(expected) > 50 and len(gone & expected) >= 0.9 * len(expected)


def test_edges(spark):
    line, other = " ".join(prose(30)), " ".join(prose(30))
    changed = line.replace(line.split()[7], "new", 1)
    long = "\n".join([other, *(f"{lettered(i)} " * 3 for i in range(3000)), line])
    data = [(1, f"{line}\nok then\n\n", 1), (2, f"{other}\n{line.upper()}!\nOK, then", 2), (3, f"{changed}\n\n--", 3), (4, None, 4), (5, "", 5), (None, line, 6), (2, f"{other}\n{line.upper()}!\nOK, then", 7), (2, "another text of this id\nthat stays", 8), (9, long, 9), (10, "a\na", 10)]
    df = spark.createDataFrame(data, "doc_id long, text string, k int").selectExpr("*", "'x' removed", "'y' row", "'z' `_id`", "map('a', 1) m", "0 n_removed")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "k", "removed", "row", "_id", "m", "n_lines", "n_removed"]
    got = {r.k: r for r in out.collect()}
    assert {k: r.n_removed for k, r in got.items()} == {1: 0, 2: 2, 3: 1, 4: 0, 5: 0, 6: 0, 7: 2, 8: 0, 9: 2, 10: 1}
    assert {k: r.n_lines for k, r in got.items()} == {1: 4, 2: 3, 3: 3, 4: 0, 5: 1, 6: 1, 7: 3, 8: 2, 9: 3002, 10: 2}
    assert got[2].text == other and got[3].text == "\n--" and got[4].text is None and got[10].text == "a" and got[6].text == line
    assert got[9].text == "\n".join(f"{lettered(i)} " * 3 for i in range(3000)) and {(r.removed, r.row, r._id, r.m["a"]) for r in got.values()} == {("x", "y", "z", 1)}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op6_fuzzy_lines(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs)
    first, gone = {}, {r.doc_id: set(r.removed or ()) for r in got.collect()}
    for r in sorted(docs, key=lambda r: r.doc_id):
        for k, x in enumerate((r.text or "").split("\n")):
            if w := " ".join(lines.line_words(x)):
                assert w not in first or k in gone[r.doc_id]  # every exact repeat goes
                first.setdefault(w, (r.doc_id, k))
    assert Counter(len(x) > 0 for x in gone.values())[True]


def removed(spark, texts, **how):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    return {r.doc_id for r in lines.repeated_lines(df, **how).collect()}


@pytest.mark.parametrize("how", [{}, {"frequent": 2}, {"frequent": 9, "short": (20, 25), "per_bucket": 300}])
def test_no_link_is_lost(spark, corpus, how):
    """What goes is what brute force over all pairs removes, whichever words are blocks: rare ones, pairs, neighbours."""
    few = [[rng.choice(COMMON[:3]) for _ in range(n)] for n in (5, 5, 6, 7, 9, 12, 20) for _ in range(4)]  # one or two distinct words
    far = [w for n in (100, 150, 210, 300) for base in [prose(n)] for w in (base, edited(base, n // 5), edited(base, n // 6))]
    texts = corpus + few + far
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if abs(len(texts[i]) - len(texts[j])) <= 0.2 * max(len(texts[i]), len(texts[j])) and lines.similar(texts[i], texts[j], 0.8)]
    assert removed(spark, texts, **how) == {i for i, r in groups(range(len(texts)), pairs).items() if r != i}


def test_words_beyond_the_rarest_are_blocks(spark):
    """Lines whose 12 rarest words are each in one more line, and whose common words come after all of these."""
    own = [[lettered(1000 * k + i) for i in range(12)] for k in range(2)]
    base = [lettered(5000 + i) for i in range(48)]
    texts = [[x for i in range(12) for x in (*base[4 * i : 4 * i + 4], words[i])] for words in own]
    assert lines.similar(*texts, 0.8)
    others = [[lettered(9000 + 10 * k + i) for i in range(6)] for k in range(80)]
    texts += [[*w, x] for w, x in zip(others, [*own[0], *own[1]])] + [[*others[30 + k % 50], *base[12 * (k % 4) : 12 * (k % 4) + 12], lettered(20000 + k)] for k in range(20)]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if lines.similar(texts[i], texts[j], 0.8)]
    assert (0, 1) in pairs and removed(spark, texts) == {i for i, r in groups(range(len(texts)), pairs).items() if r != i}


def test_trees_are_counted_before_they_are_compared(monkeypatch):
    """Lines of a tree whose words alone rule a link out are not compared word by word; links are those of all pairs."""
    r = random.Random(5)
    base = [r.randrange(1, 1 << 32) for _ in range(95)]

    def changed(n):
        line = list(base)
        for i in r.sample(range(95), n):
            line[i] = r.randrange(1, 1 << 32)
        return line

    made = [changed(1) for _ in range(20)] + [changed(n) for n in (21, 22, 21, 20, 17)]
    root = [1] * 20 + [2, 3, 4, 5, 6]
    calls, plain = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda p, q, least: calls.append((p, q)) or plain(p, q, least))
    t = pa.table({"root": pa.array(root, pa.int64()), "w": pa.array([np.array(x, np.uint32).tobytes() for x in made], pa.binary())})
    out = lines._walk(0.8)((pa.scalar(1),), t)
    assert list(zip(out["a"].to_pylist(), out["b"].to_pylist())) == [(6, 1)]
    assert not any(plain(made[i], made[j], 0.8) for i in range(20, 24) for j in range(25) if i != j)
    assert calls and all(max(len(p), len(q)) - (Counter(p) & Counter(q)).total() <= 19 for p, q in calls)


def test_long_lines_with_a_word_in_common_are_no_candidates():
    """Sketches grow with the lines: one word again and again, and a common one, are no candidates; a near copy is."""
    made = [[7] + [100 + i] * (1300 + 37 * i) for i in range(60)]
    made.append(made[50][:-200] + list(range(1000, 1200)))
    b = pa.RecordBatch.from_arrays([pa.array(range(61), pa.int64()), pa.array([np.array(x, np.uint32).tobytes() for x in made], pa.binary())], names=["hi", "w"])
    levels = SimpleNamespace(value=np.full(1 << lines.COUNTERS, lines.FREQUENT, np.uint8))
    (dealt,) = lines._deal(levels, 0.8, lines.FREQUENT, lines.SHORT, 1)(iter([b]))
    out = lines._meet(0.8, 2)((pa.scalar(0),), pa.table({"packed": dealt.column("packed")}))
    assert [(r["a"], r["b"]) for r in out.to_pylist()] == [(50, 60)]


@pytest.mark.parametrize("side, tile", [(64, (128, 2048)), (3, (7, 5)), (500, (9, 9))])
def test_cells_are_compared_in_full(side, tile):
    """Pairs of small cells are all that may be similar, those of dense ones join the same lines as all pairs do."""
    r = np.random.default_rng(3)
    base = [r.integers(1 << 32, size=n, dtype=np.uint64) for n in (6, 9, 30, 110, 130, 240, 2000)]
    made = [np.sort(np.where(r.random(len(x)) < 0.12, r.integers(1 << 32, size=len(x), dtype=np.uint64), x)[: len(x) - r.integers(3)]) for x in base for _ in range(40)]
    k = r.choice([1, 1, 1, 2, 3, 4, 5], len(made))
    order = np.lexsort(([len(x) for x in made], k))
    k, made = k[order], [made[i] for i in order]
    n = np.array([len(x) for x in made])
    sketch = lines.sketches(np.concatenate(made), np.repeat(np.arange(len(n)), n), n)
    near, across = lines.similar_filter(n, sketch, 0.8, np.arange(len(n)))
    a, b = np.triu_indices(len(n), 1)
    a, b = a[k[a] == k[b]], b[k[a] == k[b]]
    ok = near(a, b)
    want = set(zip(a[ok].tolist(), b[ok].tolist()))
    got = lines.cell_links(k, n, near, across, 0.8, 10**6, side=side, tile=tile)
    assert len(want) > 500 and set(zip(*(x.tolist() for x in got[:2]))) == want
    a, b, root = lines.cell_links(k, n, near, across, 0.8, 2, side=side, tile=tile, at_once=50)
    assert groups(range(len(n)), zip(a.tolist(), b.tolist())) == groups(range(len(n)), want) == dict(enumerate(root.tolist()))
