import random

from pitlake.operators import search


def test_against_loops(spark, tmp_path):
    r = random.Random(6)
    texts = [" ".join(r.choice(["the", "a", "Ünder", "x9", "b", "c"]) + r.choice(["", "", ",", "."]) for _ in range(r.randint(0, 25))) for _ in range(60)] + [None, "", "The the THE", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    queries = {1: "the", 2: "THE b", 3: "a the b", 4: "", 5: "missing the", 6: "the the", 7: "ünder x9 c", 8: None}
    q = spark.createDataFrame(list(queries.items()), "q long, words string")
    posts = search.posting_lists(docs, "doc", "text", str(tmp_path / "posts"), 5)
    import re

    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    every, exact = set(), set()
    for i, t in enumerate(texts):
        w = words(t)
        for k, x in queries.items():
            y = words(x)
            if y and set(y) <= set(w):
                every.add((k, i, sum(a in y for a in w), min(w.index(a) for a in y)))
            at = [p for p in range(len(w)) if y and w[p : p + len(y)] == y]
            if at:
                exact.add((k, i, len(at), at[0]))
    assert {tuple(x) for x in search.all_terms(posts, q, "q", "words").collect()} == every
    hits = search.phrases(posts, q, "q", "words")
    assert {tuple(x) for x in hits.collect()} == exact and exact
    for x in search.snippets(hits, docs, "doc", "text", 2, 6).collect():
        w = words(texts[x.id])
        w[x.first] = f"[{w[x.first]}]"
        assert x.snippet == " ".join(w[max(0, x.first - 2) :][:6])
    assert {x.doc for x in search.containing(docs, "doc", "text", "e, ").collect()} == {i for i, t in enumerate(texts) if "e, " in (t or "").lower()}
    assert search.containing(docs, "doc", "text", " ").count() == 0 == search.posting_lists(docs.limit(0), "doc", "text").count()


def test_one_shuffle_of_lists(spark):
    """Words are lists before they are shuffled, and once; repeated ids are one document whose positions are all of theirs."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, None), (3, "..."), (4, "b B")], "k long, t string").repartition(3)
    lists = search.posting_lists(docs, "k", "t")
    assert sorted((r.term, r.id, list(r.positions)) for r in lists.collect()) == [("a", 1, [0, 0, 2]), ("b", 1, [1]), ("b", 4, [0, 1]), ("c", 1, [1])]
    made = []
    old, search._cut = search._cut, lambda df: made.append(df._jdf.queryExecution().executedPlan().toString()) or df
    try:
        search.posting_lists(docs, "k", "t")
    finally:
        search._cut = old
    assert made[0].count("Exchange rangepartitioning") == 1 and made[0].count("Exchange hashpartitioning") == 0
