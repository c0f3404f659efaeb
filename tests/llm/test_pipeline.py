"""The pipeline and the registered queries: each stage of a small corpus against plain loops, and every query over
whole tables of the smallest size."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash

import corpus_pipeline
from pitlake.llm import bpe, lines, queries

rng = random.Random(8)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(4000)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    shared = prose(25)
    docs = [prose(60) + "\n" + prose(40) for _ in range(40)]
    docs += [f"{prose(30)}\n{shared}\n{prose(20)}" for _ in range(6)]  # one line in six documents
    changed = shared.split()
    changed[9] = "changed"
    docs += [f"{prose(30)}\n{' '.join(changed)}"]
    docs += [docs[0], docs[1], docs[1], docs[2].replace(" ", "  ", 1)]  # copies: all their lines go
    docs += ["too short", "", None, "word " * 50, (prose(9) + " ") * 12, f"{prose(15)}\n" + f"{docs[3].split(chr(10))[0]}"]
    return [(i, t, "en", "abc"[i % 2 if i % 5 else 2], len(t or "")) for i, t in enumerate(docs)]


CORPUS = corpus()


def repeats(w, k):
    seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return {p for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for p in range(i, i + k)}


def quality(rows):
    out = []
    for r in rows:
        w = (r[1] or "").split()
        longest = max((k for k in range(1, len(w)) if repeats(w, k)), default=0)
        share = sum(len(w[p]) for p in repeats(w, 8)) / max(sum(map(len, w)), 1)
        if len(w) >= 10 and 100 * len(repeats(w, 5)) <= 20 * len(w) and share <= 0.3 and longest <= 100:
            out.append(r)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def line_dedup(rows):
    kept, out = [], []
    for r in sorted(rows):
        stay = []
        for line in r[1].split("\n"):
            w = lines.line_words(line)
            if w and any(distance(w, k) <= 0.2 * max(len(w), len(k)) + 1e-9 for k in kept if abs(len(k) - len(w)) <= 0.2 * max(len(k), len(w)) + 1e-9):
                continue
            stay.append(line)
            if w:
                kept.append(w)
        text = "\n".join(stay)
        if text.split() or stay == r[1].split("\n"):
            out.append((*r[:1], text, *r[2:4], len(text)))
    return out


def fingerprint(t):
    w = t.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    fps = {r[0]: fingerprint(r[1]) for r in rows}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            m = min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4)
            if m < root[i]:
                root[i], changed = m, True
    return [r for r in rows if root[r[0]] == r[0]]


def given(counts, block=16):
    """Blocks of each source until the last one has given all of its rows, by a plain earliest-deadline-first loop."""
    weight = {s: Fraction(float(n) ** 0.7) for s, n in counts.items()}
    total = sum(weight.values())
    done, slot = Counter(), 0
    while any(done[s] * block < n for s, n in counts.items()):
        ready = [s for s in counts if done[s] * total / weight[s] // 1 <= slot]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * total / weight[s] // 1), done[s] * total / weight[s] // 1, s))
        done[s] += 1
        slot += 1
    return done


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(CORPUS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, small):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = CORPUS
    for (_, stage), brute in zip(corpus_pipeline.STAGES, (quality, line_dedup, simhash)):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        want = brute(want)
        have = {tuple(r) for r in out.collect()}
        assert (have - set(want), set(want) - have, out.count()) == (set(), set(), len(want))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert 30 < len(want) < 55
    counts = Counter(r[3] for r in want)
    blocks, rows = given(counts), corpus_pipeline.STAGES[3][1](spark, docs, small)
    assert rows.columns == docs.columns
    got = rows.collect()
    per_doc, by_source = Counter(r.doc_id for r in got), defaultdict(list)
    for r in want:
        by_source[r[3]].append(per_doc[r[0]])
    for s, n in by_source.items():
        assert sum(n) == blocks[s] * 16 and max(n) - min(n) <= 1
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    for r in corpus_pipeline.STAGES[4][1](spark, rows, small).collect():
        text = next(w[1] for w in want if w[0] == r.doc_id)
        ids = tok.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run(spark, small):
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, small).collect())
    want = simhash(line_dedup(quality(CORPUS)))
    assert set(got) == {r[0] for r in want} and sum(got.values()) == 16 * sum(given(Counter(r[3] for r in want)).values())


CONTRACT = {
    "op2_vectors": ("embeddings", "vec_id n_links component_id kept"), "op3_substrings": ("documents", "doc_id n_words n_removed kept_sha256"), "op4_simhash": ("documents", "doc_id fingerprint component_id"),
    "op5_languages": ("documents", "doc_id held_out lang_pred score"), "op7_quality_rules": ("documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    "op8_warc": ("pages", "page_id payload_bytes payload_digest record_type refers_to"), "op9_kneser_ney": ("documents", "doc_id held_out n_tokens n_known train_tokens base_score score"), "op10_bpe": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, name):
    d = "/root/testdata/sf0.001"
    table, columns = CONTRACT[name]
    got = queries.QUERIES[name](spark, d)
    assert got.columns[: len(columns.split())] == columns.split()
    assert got.count() == spark.read.parquet(f"{d}/{table}.parquet").count()
