"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns."""

import hashlib
import itertools
import math
import os
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pitlake.llm import bpe, common, crf, kneser_ney, mixing, quality, simhash, substrings, vectors, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
rng = np.random.default_rng(7)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


def made_rows():
    shared = prose(40)
    texts = [prose(int(rng.integers(5, 120))) for _ in range(60)]
    texts += [f"{prose(20)} {shared}\n{prose(15)}" for _ in range(20)]
    texts += [texts[0], texts[0], texts[3] + " tail", "x " * 300, "Same line of six plain words\n" * 4 + prose(30)]
    texts += [None, "", "   \n\t", "one", prose(6000), "Ünïcode ΣΑΣ <|endoftext|> é it's 123 日本語 x", "#*$ | <>"]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4], 0, "clash") for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, texts[1], "en", "c", 0, "clash")]


ROWS = made_rows()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def reach(links):
    """Smallest node reachable from each."""
    least = {x: x for x in links}
    changed = True
    while changed:
        changed = False
        for x, near in links.items():
            m = min([least[x], *(least[y] for y in near)])
            if m < least[x]:
                least[x], changed = m, True
    return least


def test_quality(docs, empty):
    got = {(r.doc_id, r.text): r for r in quality.quality_rules(docs).collect()}
    for i, t, *_ in rows():
        r, w = got[i, t], [x.decode() for x in words(t)]
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        seen = [x for x in (t or "").split("\n") if x.split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(inside), len(seen) - len(set(seen)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
        if len(w) <= 150:
            longest = max((k for k in range(1, len(w)) if len({tuple(w[a : a + k]) for a in range(len(w) - k + 1)}) < len(w) - k + 1), default=0)
            assert r.longest_repeat == longest
            eights = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            long = {p for k in range(len(w) - 7) if eights[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
            assert math.isclose(r.repeat_fraction, sum(len(w[p]) for p in long) / max(sum(map(len, w)), 1), abs_tol=1e-12)
            assert r.kept == (not r.base_failed and r.repeat_fraction <= 0.3 and longest <= 100)
    assert quality.quality_rules(empty).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    for r in bpe.encode(docs).collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty).count() == 0


def adversarial(n, seed=11):
    r = np.random.default_rng(seed)
    bits = ["a", "b", "the", "The", "ing", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u3000", ".", "...", "!", "'s", "'", "12", "3", "e\u0301", "\u0301", "\u00df", "\u65e5\u672c", "\U0001f600", "<|endoftext|>", "<|", "|>", "\u200b", "x" * 40, "\r", "-", "_"]
    return ["".join(r.choice(bits, int(r.integers(1, 1500)))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_chunks(docs, name):
    """Chunks, joins and repairs against the library: prose, shared passages, and texts of awkward pieces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    coder = bpe.ChunkEncoder(path, keep_mb=1)
    shared = prose(3000)
    texts = [f"{prose(200)}\n{shared[k:]}" for k in (0, 7, 9)] + adversarial(150) + [(t or "") for _, t, *_ in ROWS]
    for i in range(0, len(texts), 40):
        part = texts[i : i + 40]
        for t, ids in zip(part, coder.encode_all([t.encode() for t in part])):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
    fresh = bpe.ChunkEncoder(path)
    fresh.encode_all([texts[0].encode()])
    n = len(fresh.bodies)
    fresh.encode_all([texts[1].encode(), texts[2].encode()])
    assert n > 10 and len(fresh.bodies) < 2 * n and fresh.whole == 0  # the shared passage's chunks are known
    for r in bpe.encode(docs, tokenizer=path).collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_bpe_repairs(tmp_path):
    """A tokenizer whose pieces reach across blanks: joins widen or texts are encoded whole, and ids stay right."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {c: i for i, c in enumerate(["<unk>", "a", "b", "c", " ", "a ", "a b", " c", "b a", "b a ", "cc", "c c"])}
    merges = [("a", " "), ("a ", "b"), ("b", " a"), (" ", "c"), ("c", "c"), ("c", " c")]
    merges = [m for m in merges if m[0] in vocab and m[1] in vocab and m[0] + m[1] in vocab]
    tok = Tokenizer(models.BPE(vocab, merges, unk_token="<unk>"))
    tok.save(str(tmp_path / "crossing.json"))
    coder = bpe.ChunkEncoder(str(tmp_path / "crossing.json"), bits=4)
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(["a", "b", "c", " ", "a b", "c c"], 400)) for _ in range(60)]
    for t, ids in zip(texts, coder.encode_all([t.encode() for t in texts])):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_simhash(spark, docs, empty):
    def fp(t):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {}
    for i, t, *_ in rows():
        if i is not None:
            fps[i] = fp(t)
    least = reach({i: [j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4] for i in fps})
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexed("fp").alias("f"), "component_id").collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.f, r.component_id) == (f"{fps[r.doc_id]:016x}", least[r.doc_id])
    assert simhash.near_duplicates(empty).count() == 0


def test_hamming_links_and_components(spark):
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, int(rng.integers(1, 7)), replace=False)) for b in base for _ in range(6)]
    all_ = sorted({int(b) for b in base} | set(near))
    want = {(a, b) for a in all_ for b in all_ if a < b and (a ^ b).bit_count() <= 4}
    df = spark.createDataFrame([(x,) for x in all_], "fp long").repartition(4)
    for embed in ("bits", "popcount"):
        got = {tuple(sorted(r)) for r in common.hamming_links(df, len(all_), 4, 7, embed, per_bucket=50).collect()}
        assert got == want
    dense = common.hamming_links(df, len(all_), 4, 7, dense_above=2)
    sets = {r.node: r.root for r in common.components(dense).collect()}
    links = {x: [] for x in all_}
    for a, b in want:
        links[a].append(b), links[b].append(a)
    assert {x: sets.get(x, x) for x in all_} == reach(links)


@pytest.mark.parametrize("small", [False, True])
def test_substrings(docs, empty, small):
    how = {"per_bucket": 200, "per_group": 5000} if small else {}
    least = {}
    for i, t, *_ in rows():
        w = words(t)
        for s in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[s : s + 13])
            least[k] = min(least.get(k, i), i)
    got = substrings.remove_repeats(docs, digests=True, **how).collect()
    assert len(got) == len(rows())
    want = Counter()
    for i, t, *_ in rows():
        w, gone = words(t), set()
        for s in range(len(w) - 12 if i is not None else 0):
            if least[tuple(w[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("how", [{}, {"per_bucket": 300, "per_group": 20_000}])
def test_substrings_with_ids_far_apart(spark, how):
    """Ids from end to end of their range, in slices and groups of their own, rows that repeat an id and rows without one."""
    r = random.Random(3)
    passages = [[r.choice("abcdefghij") for _ in range(r.randint(5, 40))] for _ in range(30)]
    ids = [-(1 << 63), (1 << 63) - 1, None, -1, 0, 7, 7, 8, *(r.randrange(-(1 << 62), 1 << 62) for _ in range(60))]
    data = [(i, " ".join(w for _ in range(r.randint(1, 8)) for w in [*r.choice(passages), str(r.randrange(1000))])) for i in ids]
    data += [data[9], data[5]]
    least = {}
    for i, t in data:
        w = t.split()
        for s in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[s : s + 13])
            least[k] = min(least.get(k, i), i)
    want = Counter()
    for i, t in data:
        w, gone = t.split(), set()
        for s in range(len(w) - 12 if i is not None else 0):
            if least[tuple(w[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        want[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    got = substrings.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(5), **how).collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, bytes(x.kept).decode()) for x in got) == want
    assert sum(x.n_removed for x in got) > 1000


def test_substring_probes_do_not_grow_with_buckets():
    """The same hashes in 500 buckets: no document is named in each bucket that has one of its hashes."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(100_000)}" for _ in range(300)) for _ in range(100)]
    docs = pa.table({"doc_id": pa.array(range(100), pa.int64()), "key": [substrings.text_key(t.encode()) for t in texts], "text": texts})
    sizes = []
    for buckets in (1, 500):
        out = substrings._probe(13, buckets)((pa.scalar(0),), docs)
        sizes.append(sum(map(len, out.column("packed").to_pylist())))
        h = np.concatenate([substrings.thick(x) for row in out.column("packed").to_pylist() for x in substrings.unpack(row)[1:]])
        assert len(h) == 100 * 294  # all blocks of seven words
    assert sizes[1] <= 1.3 * sizes[0] <= 1.3 * 4.1 * 100 * 294


def test_mixing(docs, empty):
    got = mixing.mix(docs, block=2, frame=16, rows_per_bucket=8).collect()
    ids = Counter(r.doc_id for r in docs.collect())
    assert {k: v for k, v in Counter(r.doc_id for r in got if r.epoch == 0).items()} == dict(ids)
    places = sorted(r.place for r in got)
    assert len(set(places)) == len(places) and places[0] == 0
    full = [p for p in range(max(r.slot for r in got)) if sum(r.slot == p for r in got) != 2]
    assert not full  # only the last slot may be short
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1.0})


def test_mixing_keeps_exact_weights(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    df = spark.range(9000).selectExpr("id doc_id", "'t' text", "case when id % 10 < 5 then 'a' when id % 10 < 8 then 'b' else 'c' end source")
    of = dict({(r.slot, r.source) for r in mixing.mix(df, weights, block=1).collect()})
    assert sorted(of) == list(range(len(of))) and len(of) >= 9000
    done = Counter()
    for t in range(len(of)):
        done[of[t]] += 1
        assert all(abs(done[s] - w * (t + 1)) < 1 for s, w in weights.items())
    many = {f"s{i:03}": 1.0 for i in range(99)} | {"big": 9901.0}
    shares = mixing.whole_shares(many)
    got = Counter(s for s, _ in mixing.schedule(shares, {s: 0 if s != "big" else 9900 for s in many}))
    assert got["big"] == 9901 and max(got[s] for s in many if s != "big") == 1


def test_mixing_of_many_sources(spark):
    """600 sources of Zipf weights: every prefix of the output is within one block of each source's target share."""
    df = spark.range(12_000).selectExpr("id doc_id", "'t' text", "concat('s', int(pow(600, (id + 0.5) / 12000))) source").selectExpr("doc_id", "text", "source")
    names = sorted(r[0] for r in df.select("source").distinct().collect())
    extra = spark.createDataFrame([(20_000 + i, "t", f"z{i}") for i in range(600 - len(names))], "doc_id long, text string, source string")
    df = df.union(extra)
    weights = {s: 1.0 / (i + 1) ** 1.2 for i, s in enumerate([*names, *(f"z{i}" for i in range(600 - len(names)))])}
    total = sum(weights.values())
    of = dict({(r.slot, r.source) for r in mixing.mix(df, weights, block=4).collect()})
    assert sorted(of) == list(range(len(of))) and len(set(of.values())) == 600
    names = sorted(weights)
    share = np.array([weights[s] / total for s in names])
    done, index = np.zeros(600), {s: i for i, s in enumerate(names)}
    for t in range(len(of)):
        done[index[of[t]]] += 1
        assert np.abs(done - share * (t + 1)).max() < 1 + 1e-9


def test_mixing_repeats_its_schedule(spark):
    """A mix longer than the sum of shares, against the schedule made slot by slot; a source of three rows that fills nine
    tenths of it and so is repeated 9000 times."""
    df = spark.range(3003).selectExpr("id doc_id", "'t' text", "if(id < 3, 'a', 'b') source")
    for weights, shares in (({"a": 0.9, "b": 0.1}, {"a": 9, "b": 1}), (None, None)):
        got = mixing.mix(df, weights, block=2, period=16).collect()
        if weights is None:
            x, y = 3**0.7, 3000**0.7
            shares = {"a": max(1, round(16 * x / (x + y))), "b": round(16 * y / (x + y))}
        want = list(mixing.schedule(shares, {"a": 1, "b": 1499}))
        assert sorted({(r.slot, r.source, r.block) for r in got}) == [(i, s, j) for i, (s, j) in enumerate(want)]
        assert sorted(r.place for r in got) == list(range(2 * len(want))) and all(r.place // 2 == r.slot for r in got)
        assert sorted(r.doc_id for r in got if r.epoch == 0) == list(range(3003))
        times = Counter(r.doc_id for r in got if r.source == "a")
        assert max(times.values()) - min(times.values()) <= 1 and len({(r.doc_id, r.epoch) for r in got}) == len(got)
        assert weights is None or max(r.epoch for r in got) > mixing.EPOCHS


def test_mixing_edges(spark):
    df = spark.createDataFrame([(i % 3 or None, None if i % 5 == 0 else f"t{i}", ["a", "b", None][i % 3], i) for i in range(60)], "doc_id long, text string, source string, k int")
    clash = df.selectExpr("*", "1 _s", "2 _n", "3 `_i`", "4 s", "5 h", "6 row", "map('a', k) m", "7 slot")
    got = mixing.mix(clash, block=3).collect()
    assert {r.k for r in got if r.epoch == 0} == set(range(60)) and sum(r.epoch == 0 for r in got) == 60
    assert {(r._s, r._n, r._i, r.s, r.h, r.row) for r in got} == {(1, 2, 3, 4, 5, 6)} and all(r.m["a"] == r.k for r in got)
    assert len({r.place for r in got}) == len(got)
    few = mixing.mix(clash, block=3, keep=["k"])
    assert few.columns == ["k", "epoch", "block", "slot", "place"] and {(r.place, r.k) for r in few.collect()} == {(r.place, r.k) for r in got}


def test_crf(spark):
    made = {"xx": "aba bab abba baab", "yy": "ogo gog oggo goog"}
    def text(lang):
        return " ".join("".join(rng.choice(list(made[lang].replace(" ", "")), 5)) for _ in range(30))
    data = [(i, text(lang), lang) for i, lang in enumerate(["xx", "yy"] * 60)] + [(900, None, "xx"), (901, "123 !", "yy"), (902, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in crf.languages(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in data[:120]) and all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert {r.lang_pred for r in crf.languages(df.where("doc_id > 899")).collect()} == {"und"}
    e, at = rng.normal(size=(300, 3)), np.array([0, 0, 1, 130, 300])
    change, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    whole = np.concatenate([one_pass(e[a:b], change, first) for a, b in zip(at, at[1:]) if b > a])
    assert np.allclose(crf.marginals(e, at, change, first), whole, atol=1e-6)
    assert crf.languages(df.limit(0)).count() == 0
    same = crf.languages(df.where("doc_id < 3").union(df.where("doc_id < 3")).withColumn("words", F.lit(1)).withColumn("score", F.lit("x"))).collect()
    assert Counter(r.doc_id for r in same) == {0: 2, 1: 2, 2: 2} and {(r.words, type(r.score)) for r in same} == {(1, float)}


def test_crf_pairs():
    """Expected label pairs and the trained weights against enumeration of all label sequences."""
    e, at, k = rng.normal(size=(9, 3)), np.array([0, 4, 5, 9]), 3
    change, first = rng.normal(size=(k, k)), rng.normal(size=k)
    want = np.zeros((k, k))
    for a, b in zip(at, at[1:]):
        total, part = 0.0, np.zeros((k, k))
        for y in itertools.product(range(k), repeat=int(b - a)):
            p = math.exp(first[y[0]] + sum(e[a + i, y[i]] for i in range(len(y))) + sum(change[y[i - 1], y[i]] for i in range(1, len(y))))
            total += p
            for i in range(1, len(y)):
                part[y[i - 1], y[i]] += p
        want += part / total
    for block in (2, 3, 64):
        got = np.zeros((k, k))
        crf.marginals(e, at, change, first, block, got)
        assert np.allclose(got, want, atol=1e-6)


def test_crf_words(spark):
    """Code-switched text: whole words, and a change of language within a text; first is trained."""
    def text(lang, n):
        return " ".join("".join(rng.choice(list({"xx": "abe", "yy": "ogu"}[lang]), 5)) for _ in range(n))

    samples = [(text(lang, 30), i) for _ in range(80) for i, lang in enumerate(["xx", "xx", "yy"][:2] if _ % 3 else ["xx", "yy"])]
    samples = [(t, int(set(t) & set("ogu") != set())) for t, _ in samples]
    model = crf.train(samples, ["xx", "yy"])
    assert np.abs(model.first).max() > 0
    mixed = [(i, text("xx", 12) + " " + text("yy", 9) + " 123 " + text("xx", 7)) for i in range(20)] + [(99, None), (100, ""), (101, "ab" * 5000 + " " + "ogo" * 5000)]
    got = {r.doc_id: r for r in crf.label_words(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    want = ["xx"] * 12 + ["yy"] * 9 + ["und"] + ["xx"] * 7
    right = sum(a == b for i in range(20) for a, b in zip(got[i].word_langs, want))
    assert right >= 0.95 * 20 * len(want) and all(len(got[i].words) == len(want) for i in range(20))
    assert got[99].word_langs == got[100].word_langs == [] and got[101].word_langs == ["xx", "yy"]
    assert crf.label_words(spark.createDataFrame(mixed, "doc_id long, text string"), None).collect()[0].word_langs[0] == "und"


def test_crf_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = crf.languages(docs, keep=["doc_id", "lang"]).where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 50 and sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def one_pass(e, change, first):
    x, m = np.exp(e), np.exp(change)
    a, b = [np.exp(first) * x[0]], [np.ones(e.shape[1])]
    for t in range(1, len(e)):
        a.append((a[-1] / a[-1].sum()) @ m * x[t])
        b.append((y := m @ (x[len(e) - t] * b[-1])) / y.sum())
    p = np.array(a) * np.array(b[::-1])
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(docs, empty, spark, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "HOT_TOKENS", 40)
    monkeypatch.setattr(kneser_ney, "HOT_SHARE", 1 / 1000)
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 7 == 2
    padded = lambda t: [*[1] * (order - 1), *(x.lower() for x in words(t)), 2]
    grams = [Counter() for _ in range(order + 1)]  # by length: raw for the longest, else numbers of words before
    uni = Counter()
    for i, t, *_ in rows():
        if not held(i):
            w = padded(t)
            uni.update(w[order - 1 :])
            grams[order].update(tuple(w[k - order + 1 : k + 1]) for k in range(order - 1, len(w)))
    for n in range(order, 1, -1):
        grams[n - 1].update(g[1:] for g in grams[n])
    n, v = sum(uni.values()), len(uni)
    d = [None] + [kneser_ney.discounts([sum(c == k for c in grams[m].values()) for k in (1, 2, 3, 4)]) for m in range(1, order + 1)]
    total = [Counter() for _ in range(order + 1)]
    back = [Counter() for _ in range(order + 1)]
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            total[m][g[:-1]] += c
        for g, c in grams[m].items():
            back[m][g[:-1]] += d[m][min(c, 3) - 1] / total[m][g[:-1]]
    pairs = len(grams[2])
    rest = sum(d[1][min(c, 3) - 1] for c in grams[1].values()) / pairs
    cut = lambda c, x: max(c - ([0.0, *x][min(c, 3)]), 0)

    def p(g):
        out = cut(grams[1][g[-1:]], d[1]) / pairs + rest / (v + 1)
        for m in range(2, order + 1):
            h = g[-m:]
            if total[m][h[:-1]]:
                out = cut(grams[m][h], d[m]) / total[m][h[:-1]] + back[m][h[:-1]] * out
        return out

    context = next(iter(grams[order]))[:-1]
    assert abs(sum(p((*context, w)) for w in uni) + p((*context, b"never")) - 1) < 1e-9
    got = kneser_ney.perplexity(docs, order=order).collect()
    assert len(got) == len(rows())
    for r in got:
        w = padded(r.text)
        own = w[order - 1 :]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(x in uni for x in own), n)
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in own), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(tuple(w[k - order + 1 : k + 1]))) for k in range(order - 1, len(w))), rel_tol=1e-6)
    assert kneser_ney.perplexity(empty, order=order).count() == 0


def test_kneser_ney_is_never_sure(spark):
    """Contexts whose followers all have one count leave something to others: no score is minus infinity."""
    texts = ["a b", "a b", "c d", "c d", "e f", "e f", "a b c", "x", "y", "z", "q r s", "q r s", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, f"a z{i} d b") for i in range(30)], "doc_id long, text string")
    got = kneser_ney.perplexity(df).collect()
    assert any(r.held_out for r in got) and all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_hashed_words():
    texts = ["".join(rng.choice(list("ab \n\té"), 40)).encode() for _ in range(50)] + [b"", b"x" * 2000]
    for block in (8, 100, 1 << 20):
        where, seen = [], {}
        h, at = common.hashed_words(texts, block, where)
        assert [where[0][i:j] for i, j in zip(where[1], where[2])] == [w for t in texts for w in t.split()]
        assert np.diff(at).tolist() == [len(t.split()) for t in texts]
        for w, x in zip((w for t in texts for w in t.split()), h.tolist()):
            assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_warc(spark):
    page = "<p>" + prose(400) + "</p>"
    data = [(1, "http://a/1", page), (2, "http://a/2\nx", page), (9, None, page), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", "é" * 900)]
    data += [(100 + i, f"http://b/{i}", f"<html>{prose(300)}</html>") for i in range(150)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(data)
    for i, _, html in data:
        b = (html or "").encode()
        again = html == page and i != 9
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 9) if again else ("response", None))
        assert again or bytes(got[i].payload) == b
    assert warc.round_trip(df.limit(0)).count() == 0
    assert warc.round_trip(df.withColumn("payload", F.lit(1)).withColumn("top", F.lit("x"))).count() == len(data)
    raw = warc.record(1, "u", b"body", 4, hashlib.sha1(b"body").hexdigest(), None)
    assert warc.parse(raw)["payload"] == b"body"
    for bad in (raw[:-1], raw.replace(b"body", b"bodx"), raw.replace(b"Length: 4", b"Length: 5"), b"x" + raw):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)


@pytest.mark.parametrize("rows", [1, 5, 400])
def test_warc_dictionary(spark, tmp_path, rows):
    """Every archive starts with its dictionary in a skippable frame, and its frames cannot be read without it."""
    import zstandard

    made = [(i, f"http://c/{i}", "" if rows == 1 else f"<html><body class='x'>{prose(250)}</body></html>") for i in range(rows)]
    df = spark.createDataFrame(made, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.round_trip(df, f"file://{tmp_path}/w").collect()}
    assert got == {i: html for i, _, html in made}
    files = list((tmp_path / "w").glob("*.warc.zst"))
    assert files
    for f in files:
        raw = f.read_bytes()
        magic, n = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
        assert magic == warc.DICTIONARY_MAGIC and n > 0 and len(list(warc.read_archive(raw))) > 0
        assert (raw[8:12] == b"\x37\xa4\x30\xec") == (rows == 400)  # trained, or raw content
        if rows == 400:
            with pytest.raises(zstandard.ZstdError):
                list(warc.read_archive(raw[8 + n :]))
            packed = zstandard.ZstdCompressor().compress(raw[8 : 8 + n])  # a dictionary that is itself compressed
            again = raw[:4] + len(packed).to_bytes(4, "little") + packed + raw[8 + n :]
            assert [r["page_id"] for r in warc.read_archive(again)] == [r["page_id"] for r in warc.read_archive(raw)]
        for cut in (raw[: 8 + n // 2], raw[:-3]):
            with pytest.raises((warc.BadArchive, zstandard.ZstdError)):
                list(warc.read_archive(cut))


def test_vectors(spark):
    x = rng.normal(size=(60, 16))
    x = np.concatenate([x, x[:20] + rng.normal(size=(20, 16)) * 0.15, x[:10], x[:1] * 3]).astype(np.float32)
    data = [(i, [float(c) for c in v], i % 2 if i < 60 else (i - 60) % 2) for i, v in enumerate(x)]
    data += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, data[0][1], None), (505, [1.0], 1), (506, [], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    ok = {i: (np.array(v, np.float64), y) for i, v, y in data[: len(x)]}
    links = {i: [j for j in ok if j != i and ok[i][1] == ok[j][1] and ok[i][0] @ ok[j][0] / np.sqrt((ok[i][0] ** 2).sum() * (ok[j][0] ** 2).sum()) >= 0.93] for i in ok}
    least = reach(links)
    for how in ({"margin": None}, {"margin": None, "split_above": 3}, {}):
        got = {r.vec_id: r for r in vectors.near_duplicates(df, **how).collect()}
        assert len(got) == len(data)
        for i, r in got.items():
            assert (r.n_links, r.component_id) == (len(links.get(i, [])), least.get(i, i)) and r.kept == (i == least.get(i, i))
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    zeros = spark.createDataFrame([(1, [0.0, 1.0], 1), (2, [-0.0, 1.0], 1), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(zeros).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


def test_vectors_of_many_lengths(spark):
    """Each length links by itself; null ids, extra and clashing columns."""
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0]
    data = [(1, a, 1), (2, a, 1), (3, b, 1), (4, b, 1), (5, [1.0, 2.01], 1), (6, b, 2), (7, [4.0], 1), (None, a, 1), (8, [5.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' rep", "1 n_links", "2 h")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (2, 3, True), 4: (2, 3, False), 5: (2, 3, False), 6: (0, 6, True), 7: (1, 7, True), 8: (1, 7, False), None: (0, None, False)}


@pytest.mark.parametrize("where", ["sf0.1", "check_s"])
def test_vectors_recall(spark, where):
    """Settings of the query against brute force over whole tables: no link too many, nine in ten of all or more."""
    path = f"/root/testdata/{where}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table here")
    t = spark.read.parquet(path).select("vec_id", "embedding", "label")
    data = [r for r in t.collect() if r.embedding and r.label is not None and all(c is not None and math.isfinite(c) for c in r.embedding) and any(r.embedding)]
    x, y, ids = np.array([r.embedding for r in data], np.float64), np.array([r.label for r in data]), np.array([r.vec_id for r in data])
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    want = dict(zip(ids.tolist(), np.concatenate([((x[i : i + 1000] @ x.T >= 0.93) & (y[i : i + 1000, None] == y)).sum(1) - 1 for i in range(0, len(x), 1000)]).tolist()))
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(t).collect()}
    total, have = sum(want.values()), sum(min(got[i], n) for i, n in want.items())
    print(f"recall of links at {where}: {have / max(total, 1):.4f} of {total}")
    assert sum(max(0, got[i] - n) for i, n in want.items()) <= 2 and have >= 0.9 * total
