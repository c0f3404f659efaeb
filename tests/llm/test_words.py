"""Byte-level BPE, spelling variants and ranked search against plain versions: nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
import zstandard

from pitlake.llm import bpe, byte_bpe, common, kneser_ney, lines, queries, ranked, spelling
from pitlake.llm import warc as warc_op
from tests.oracle import differences

SCHEMA = "doc_id long, text string, lang string, n_tokens string, term string"
rng = random.Random(5)
SYLLABLES = ["ba", "ré", "ti", "on", "er", "th", "lo", "mü", "en", "st"]
WORDS = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 6))) for _ in range(300)]


def prose(n):
    return " ".join(WORDS[min(int(rng.expovariate(0.03)), 299)] for _ in range(n))


def made_rows():
    texts = [prose(rng.randint(1, 150)) for _ in range(150)]
    texts += [None, "", "  \n\t ", "...", "Hello  World's 123\n\n\n  x", prose(9000), "a" * 5000, " " * 3000 + "x", "Ünïcode ΣΑΣ é 日本語 \U0001f600 <|endoftext|>", "ABC abc Abc", texts[0], texts[0]]
    texts += ["࢏՘ x౜ \U0001e6c0", "longest " + "Thererother " * 30 + "therother thererothe thererotheer" * 3]
    out = [(i, t, "en", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[1], None, None, None)]


ROWS = made_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.default_ranks(), "rb"))}
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_splits(library):
    """Pre-tokens as the library's, with every letter and number of either Unicode version."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    split = byte_bpe.splitter(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    for text in ("".join(f" {c}{c}1a" for c in chars[i : i + 5000]) for i in range(0, len(chars), 50_000)):
        assert [i for w in split(text) for i in library.encode_ordinary(w)] == library.encode_ordinary(text)


@pytest.mark.parametrize("settings", [{}, {"block_mb": 1, "cell_mb": 1}])
def test_byte_bpe(docs, empty, library, settings):
    got = Counter((r.doc_id, r.text, r.lang, r.n_tokens, tuple(r.ids), bytes(r.decoded)) for r in byte_bpe.encode(docs, **settings).collect())
    want = Counter((i, t, l, len(ids := library.encode_ordinary(t or "")), tuple(ids), (t or "").encode()) for i, t, l, *_ in ROWS)
    assert got == want
    digests = Counter(tuple(r) for r in byte_bpe.encode(docs, keep=["doc_id"], digests=True, **settings).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == Counter((i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in ROWS)
    assert byte_bpe.encode(empty).count() == 0


def test_byte_bpe_cells(spark, library):
    """Words over several cells and blocks of one task."""
    texts = [" ".join(f"{rng.randrange(10**9):x}" for _ in range(60_000)) for _ in range(5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    out = byte_bpe.encode(df, block_mb=1, cell_mb=1)
    got = {r.doc_id: (list(r.ids), bytes(r.decoded).decode()) for r in out.collect()}
    assert got == {i: (library.encode_ordinary(t), t) for i, t in enumerate(texts)}


def test_byte_decode(spark, library):
    ids = [library.encode_ordinary("Hello é 日本"), [], None]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(ids)], "doc_id long, ids array<int>, decoded string")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in byte_bpe.decode(df).collect()} == {0: "Hello é 日本".encode(), 1: bytearray(), 2: None}
    with pytest.raises(Exception, match="token table"):
        byte_bpe.decode(spark.createDataFrame([(0, [999_999])], "doc_id long, ids array<int>")).collect()


def vocabulary(rows, least, seen):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= seen}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize(("least", "seen"), [(7, 2), (4, 1)])
def test_spelling(docs, empty, least, seen):
    got = [tuple(r) for r in spelling.variants(docs, least=least, seen=seen).collect()]
    want = expected_variants(vocabulary(ROWS, least, seen))
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in got)
    assert spelling.variants(empty).count() == 0


def test_spelling_near_words(spark):
    """Every pair of a dense made vocabulary: short alphabets, repeated letters, prefixes, ties, lengths 4 to 9."""
    made = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(900)} | {"aaaa", "aaaaa", "aaaaaa", "aaaaaaa"}
    df = spark.createDataFrame([(w, rng.randint(1, 50)) for w in made], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_words(df).collect()]
    want = {(a, b) for a in made for b in made if a != b and one_apart(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_spelling_paths_and_ties(spark):
    """A path of three forms; of two near words with equal counts the smaller in code points, a prefix included."""
    counts = {"abcdefgh": 1, "abcdefgx": 10, "abcdefyx": 100, "abcdezyx": 1000, "prefixes": 30, "prefixesa": 30, "prefixesb": 2}
    text = " ".join(f"{w} " * n for w, n in counts.items())
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in spelling.variants(df, seen=1, one_in=1 << 40).collect()}
    assert got["abcdefgh"] == ("abcdefgx", "abcdezyx") and got["abcdefyx"] == ("abcdezyx", "abcdezyx") and got["abcdezyx"] == (None, "abcdezyx")
    assert got["prefixesb"] == ("prefixes", "prefixes")


def test_long_texts_in_pieces():
    text = "Straße " * 50 + "é" * 40 + " end"
    whole, cut = Counter(), Counter()
    spelling.counted_runs(3, text, 3, 31, whole)
    spelling.counted_runs(3, text, 3, 31, cut, piece=7)
    assert whole == cut
    raw = ("Ab c9é, " * 20 + "x" * 50 + " z").encode()
    assert [w for p in ranked.terms_of(raw, 9) for w in p] == [w for p in ranked.terms_of(raw) for w in p]


def terms(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def expected_ranks(rows, items, k):
    held = [(i, Counter(terms(t))) for i, t, *_ in rows]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("settings", [{}, {"shard_docs": 40}, {"shard_docs": 7}])
def test_ranked_search(spark, docs, empty, settings):
    items = [(i, prose(rng.randint(1, 30))) for i in range(40)] + [(100, None), (101, ""), (102, "unknownterm"), (103, "ABC"), (103, "ABC"), (None, WORDS[0])]
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, score int, block int")
    index = ranked.build(docs, **settings)
    for k, how in ((50, {}), (3, {"block": 7}), (5, {"broadcast_mb": -1})):
        assert Counter(tuple(r) for r in ranked.search(index, q, k=k, **how).collect()) == expected_ranks(ROWS, items, k)
    assert ranked.search(index, q.limit(0)).count() == 0
    assert ranked.search(ranked.build(empty), q).count() == 0


def test_treap_search_prunes(monkeypatch):
    """The k best of many documents, whatever is pruned: the same as all scores sorted, and most is pruned."""
    r, n_docs = np.random.default_rng(3), 20_000
    lists, weights = [], [int(x) for x in r.integers(1, 9000, 12)]
    for _ in weights:
        d = np.sort(r.choice(n_docs, int(r.integers(1, 9000)), replace=False))
        lists.append((d, (r.pareto(1.0, len(d)) * 50 + 1).astype(np.int64)))
    packed = []
    for d, v in lists:
        left, right, root = ranked.treap(v.tolist())
        packed.append(ranked.pack(*(ranked.small(np.asarray(x)) for x in (d, v, left, right, [root]))))
    forest = ranked.Forest(packed, weights, n_docs)
    scored = []
    leaves = forest._leaves
    monkeypatch.setattr(forest, "_leaves", lambda *a: (out := leaves(*a), scored.append(len(out[0])))[0])
    chosen = [sorted(r.choice(12, int(r.integers(1, 7)), replace=False).tolist()) for _ in range(9)]
    items, terms_ = np.array([i for i, c in enumerate(chosen) for _ in c]), np.array([t for c in chosen for t in c])
    item, score, doc = forest.search(items, terms_, 9, 20)
    touched = 0
    for i, c in enumerate(chosen):
        total = np.zeros(n_docs, np.int64)
        for t in c:
            np.add.at(total, lists[t][0], lists[t][1] * weights[t])
        order = np.lexsort((np.arange(n_docs), -total))[:20]
        assert [(int(total[d]), int(d)) for d in order if total[d] > 0] == list(zip(score[item == i].tolist(), doc[item == i].tolist()))
        touched += (total > 0).sum()
    assert sum(scored) < touched / 2


@pytest.mark.parametrize("name", ["op8_warc", "op11_spelling", "op13_ranked_search"])
def test_against_sql(spark, name):
    more, less, n = differences(spark, queries.QUERIES[name], queries.ORACLES[name])
    assert (more, less) == ([], []) and n


def thue_morse(n, swap):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_that_differ_by_rule(spark):
    """Words of 1,024 and 2,048 letters that any polynomial modulo 2 ** 64 takes for one: own hashes, ids, counts."""
    from tokenizers import Tokenizer

    words = [thue_morse(n, s) for n in (1024, 2048) for s in (0, 1)]
    h, _ = common.hashed_words([" ".join(words).encode()])
    assert len(set(h.tolist())) == 4
    texts = [f"{prose(200)} {w} {prose(200)}" for w in words] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    assert {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()} == {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    train = Counter(w for i, t in enumerate(texts) for w in [*t.lower().split(), ""] if crc32(str(i).encode()) % 7 != 2)
    for r in kneser_ney.perplexity(df).collect():
        w = [*texts[r.doc_id].lower().split(), ""]
        assert r.n_known == sum(train[x] > 0 for x in w) and r.train_tokens == train.total()
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 1) / (train.total() + len(train) + 1)) for x in w), rel_tol=1e-12)


def test_equal_hashes_of_different_words(monkeypatch):
    """Bytes decide: with a hash that is the same for all words, in one text and against the store."""
    calls = []
    store = bpe.Words(lambda raws: (calls.append(raws), [np.frombuffer(w, np.uint8).astype(np.uint32) for w in raws])[1])
    real = bpe.hashed_words
    monkeypatch.setattr(bpe, "hashed_words", lambda texts, where: (lambda h, at: (h * np.uint64(0), at))(*real(texts, where=where)))
    for texts in ([b"one"], [b"two"], [b"one two", b"", b"one"], [b"one one"]):
        assert [x.tolist() for x in store.encode(texts)] == [[c for w in t.split() for c in w] for t in texts]


def test_word_store_is_bounded_by_bytes():
    """However long words and ids are, the store starts afresh before it outgrows its bytes by more than a batch."""
    store = bpe.Words(lambda raws: [np.frombuffer(w, np.uint8).astype(np.uint32) for w in raws], most=1 << 20)
    held = []
    for i in range(30):
        words = [b"%04d" % (100 * i + j) + b"x" * 1000 for j in range(100)]
        assert b"".join(x.astype(np.uint8).tobytes() for x in store.encode([b" ".join(words)])) == b"".join(words)
        held.append(sum(map(len, store.index)) + store.flat.nbytes)
    assert max(held) <= (1 << 20) + 100 * 5300 and store.size >= held[-1]


def test_a_seen_line_has_its_digest_again():
    """Lines a task met before get the same digest and no words; lines without words none."""
    b = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6]), pa.array(["Ab cd\n\nx", "ab  CD!\nAb cd\n--"])], names=["doc_id", "row", "text"])
    rows = [r for out in lines._occurrences(1)(iter([b])) for r in out.to_pylist()]
    assert [(r["doc_id"], r["line_no"], r["w"] is None) for r in rows] == [(1, 0, False), (1, 2, False), (2, 0, False), (2, 1, True)]
    x = xxhash.xxh3_128_digest(b"ab cd")
    want = tuple(int.from_bytes(h, "little", signed=True) for h in (x[:8], x[8:]))
    assert [(r["hi"], r["lo"]) == want for r in rows] == [True, False, True, True]


def warc(kind, block, *fields, version="WARC/1.1", length=None, end=b"\r\n\r\n"):
    lines = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", "WARC-Date: 2024-01-01T00:00:00Z", *fields, f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + end


def test_foreign_archives(spark, tmp_path):
    """Records by other hands: all types, HTTP messages, base32 and hex, blocks and payloads; bad ones apart."""
    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    b32 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    hexed = lambda x: "SHA-256:" + hashlib.sha256(x).hexdigest().upper()
    web = "Content-Type: application/http; msgtype=response"
    good = [
        warc("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), warc("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http;msgtype=request", "WARC-Concurrent-To: <urn:uuid:1>", "WARC-Concurrent-To: <urn:uuid:2>"),
        warc("response", http, web, f"WARC-Payload-Digest: {b32(body)}", f"WARC-Block-Digest: {hexed(http)}", "WARC-Target-URI: http://x/", " y"), warc("resource", body, f"WARC-Payload-Digest: {hexed(body)}", version="WARC/1.0"),
        warc("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", web, f"WARC-Payload-Digest: {b32(body)}", "WARC-Refers-To: <urn:uuid:9>"), warc("metadata", b""), warc("response", http[:-3], web, f"WARC-Payload-Digest: {b32(body)}", "WARC-Truncated: length"),
        warc("conversion", body, "WARC-Payload-Digest: blake3:zz"),
    ]
    bad = [
        warc("response", http, web, f"WARC-Payload-Digest: {b32(http)}"), warc("resource", body, f"WARC-Block-Digest: {b32(b'other')}"), warc("resource", body, length=3), warc("resource", body, "WARC-Target-URI: a", "WARC-Target-URI: b"),
        warc("resource", body, version="HTTP/1.1"), warc("resource", body).replace(b"WARC-Date", b"WARC-Dote"), warc("resource", body, end=b"\r\n"), warc("resource", body, length="x"), warc("revisit", b""), b"\xff\xfe nonsense",
    ]
    words = zstandard.ZstdCompressionDict(b"".join(good))
    writer = zstandard.ZstdCompressor(dict_data=words)
    lead = (0x184D2A5D).to_bytes(4, "little") + len(words.as_bytes()).to_bytes(4, "little") + words.as_bytes()
    (tmp_path / "mixed.warc.zst").write_bytes(lead + b"".join(writer.compress(r) for pair in zip(good, bad) for r in pair) + b"".join(writer.compress(r) for r in bad[len(good) :]))
    (tmp_path / "plain.warc.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(r) for r in good[:2]) + b"\x28\xb5\x2f")
    (tmp_path / "empty.warc.zst").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = warc_op.read(files, strict=False).collect()
    fine = [r for r in rows if r.error is None]
    assert Counter(r.record_type for r in fine) == Counter(["warcinfo", "request", "response", "resource", "revisit", "metadata", "response", "conversion", "warcinfo", "request"])
    assert len(rows) - len(fine) == len(bad) + 1 and all(r.record_id is None for r in rows if r.error)
    one = next(r for r in fine if r.url)
    assert (bytes(one.payload), one.payload_digest, one.payload_bytes, one.url, one.page_id) == (body, hashlib.sha1(body).hexdigest(), len(body), "http://x/ y", None)
    again = next(r for r in fine if r.record_type == "revisit")
    assert (again.payload, again.payload_digest, again.refers_to_id, again.refers_to) == (None, hashlib.sha1(body).hexdigest(), "<urn:uuid:9>", None)
    with pytest.raises(Exception, match="archive"):
        warc_op.read(files).collect()


def test_copies_by_salt(spark):
    """The join for a table of copies that is too large to broadcast gives the same."""
    pages = spark.createDataFrame([(i, f"u{i}", "x" * 2000 if i % 3 else f"{i}" * 900) for i in range(60)] + [(None, None, "x" * 2000)], "page_id long, url string, html string")
    rows = lambda how: Counter(tuple(r) for r in warc_op.resolved(pages, **how).drop("payload").collect())
    assert rows({}) == rows({"broadcast_mb": -1}) and warc_op.resolved(pages).where("record_type = 'revisit' and payload is not null").count() == 0


def test_same_words():
    """Byte for byte, at every length and place of a difference."""
    for n in (1, 2, 7, 8, 9, 15, 16, 17, 24, 40):
        w = bytes(rng.choice(b"abcdefgh") for _ in range(n))
        for k in range(-1, n):
            other = w if k < 0 else w[:k] + b"X" + w[k + 1 :]
            raw = w + b" " + other + b"\n"
            starts, ends = np.array([0, n + 1]), np.array([n, 2 * n + 1])
            assert bpe.same_words(raw, starts, ends, np.array([0, 0]), block=4) == (k < 0)
    assert not bpe.same_words(b"a ab\n", np.array([0, 2]), np.array([1, 4]), np.array([0, 0]))
