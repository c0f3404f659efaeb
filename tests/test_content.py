"""Charsets, formats, the store, checked loads and the gate; facts out of several sources against a plain loop."""

import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pitlake.operators import materialize
from pitlake.sources import content


def test_charsets(spark):
    text = "<p>中文 é</p>"
    cases = [
        (1, b"\xef\xbb\xbf" + text.encode(), text, "utf-8-sig", "decoded"), (2, b'<meta charset="gb2312">' + text.encode("gb18030"), '<meta charset="gb2312">' + text, "gb18030", "decoded"),
        (3, b"<meta charset=big5>" + "中文".encode("big5"), "<meta charset=big5>中文", "big5", "decoded"), (4, text.encode("gb18030"), text, "gb18030", "decoded"), (5, text.encode(), text, "utf-8", "decoded"),
        (6, b"<meta charset=koi8-r>x", None, None, "unsupported_charset"), (7, b"<meta charset=utf-8>" + text.encode("gb18030"), None, "utf-8", "undecodable"), (8, b"\xff\xff\xff", None, "gb18030", "undecodable"),
        (9, b"", "", "utf-8", "decoded"), (10, None, None, None, "missing"), (11, b" " * 9000 + b"charset=koi8-r", " " * 9000 + "charset=koi8-r", "utf-8", "decoded"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "id long, raw binary")
    assert {tuple(r) for r in content.decoded(df, "id", "raw").collect()} == {(c[0], *c[2:]) for c in cases}


def test_formats(spark):
    html = "<html><title>T &amp; U</title><script>var x='<p>';</script><style>p{}</style><!-- c --><p>a &#20013;\t b<br>c</p></html>"
    rows = [(1, "html", html.encode()), (2, "TXT", b" a  b \r\n\r\nc<p>"), (3, "md", b"# x\n"), (4, "pdf", b"%PDF"), (5, "txt", b""), (6, "html", b"<meta charset=koi8-r>"), (7, None, b"x")]
    got = {r.id: (r.status, r.text) for r in content.ingested(spark.createDataFrame(rows, "id long, kind string, raw binary"), "id", "kind", "raw").collect()}
    assert got == {1: ("parsed", "T & U\na 中 b\nc"), 2: ("parsed", "a b\nc<p>"), 3: ("parsed", "# x"), 4: ("unsupported_format", None), 5: ("empty", ""), 6: ("unsupported_charset", None), 7: ("unsupported_format", None)}


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    put = lambda rows: {r.name: r.reused for r in content.archive(spark.createDataFrame(rows, "name string, content binary"), root).collect()}
    assert content.manifests(spark, root).count() == 0
    assert put([("a", b"one"), ("b", b"two"), ("c", b"one"), ("n", None)]) == {"a": False, "b": False, "c": False}
    assert put([("d", b"one"), ("e", b"three")]) == {"d": True, "e": False}
    assert content.blobs(spark, root).count() == 3 and content.manifests(spark, root).count() == 5
    held = content.blobs(spark, root)
    assert {r.state for r in content.verified(content.manifests(spark, root), held).collect()} == {"good"}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    broken = held.where(F.col("digest") != sha(b"two")).withColumn("content", F.when(F.col("digest") == sha(b"one"), F.lit(b"on")).when(F.col("digest") == sha(b"three"), F.lit(b"thrEe")).otherwise(F.col("content")))
    assert {r.name: r.state for r in content.verified(content.manifests(spark, root), broken).collect()} == {"a": "cut", "b": "missing", "c": "cut", "d": "cut", "e": "altered"}
    spark.createDataFrame([("zz", "x", 1, False)], "name string, digest string, length long, reused boolean").write.parquet(f"{root}/manifests/run=torn")
    Path(f"{tmp_path}/store/manifests/run=torn/_SUCCESS").unlink()  # a run that was cut off
    assert content.manifests(spark, root).count() == 5


def test_gate(spark):
    df = spark.createDataFrame([(1, None), (1, "old"), (2, "forged"), (2, "old"), (2, None), (3, "old"), (4, "gone"), (4, "forged")], "g long, x string")
    got = {r.g: tuple(r)[1:] for r in content.gate(df, "g", F.col("x"), ["gone", "forged"]).collect()}
    assert got == {1: (1, 1, None, True), 2: (1, 2, "forged", False), 3: (0, 1, None, False), 4: (0, 2, "gone", False)}


def test_projection(spark, tmp_path):
    files = {"good.jsonl": '{"a": 1}\n\n{"a": "x"}\n', "changed.jsonl": '{"a": 2}\n', "new.jsonl": '{"a": 3}\n', "few.jsonl": '{"a": 4}\n'}
    for n, t in files.items():
        (tmp_path / n).write_text(t)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = [("good.jsonl", sha(files["good.jsonl"]), 2), ("changed.jsonl", sha("other"), 1), ("few.jsonl", sha(files["few.jsonl"]), 2), ("lost.jsonl", sha(""), 0)]
    found, rows, bad = content.checked_projection(spark, str(tmp_path), spark.createDataFrame(listed, "name string, sha256 string, n_rows long"), "a long")
    assert {r.name: r.state for r in found.collect()} == {"good.jsonl": "good", "changed.jsonl": "hash_mismatch", "new.jsonl": "unlisted", "few.jsonl": "row_count_mismatch", "lost.jsonl": "missing"}
    assert [tuple(r) for r in rows.collect()] == [("good.jsonl", 0, 1)] and [json.loads(r.line)["a"] for r in bad.collect()] == ["x"]


def loop(facts):
    out = {}
    for key in {f[0] for f in facts}:
        found, reasons = [], set()
        for source in {f[1] for f in facts if f[0] == key}:
            mine = [f for f in facts if f[:2] == (key, source)]
            by = {f[3]: f for f in mine}
            for f in mine:
                if (p := by.get(f[5])) is not None:
                    reasons |= {0} if p[4] != f[4] else set()
                    reasons |= {1} if p[6] >= f[6] else set()
            leaves = [f for f in mine if f[3] not in {x[5] for x in mine}]
            reasons |= {2} if not leaves else {3} if len({f[7:] for f in leaves}) > 1 else set()
            found += [max(leaves, key=lambda f: (f[6], f[2]))] if leaves else []
        reasons |= {4} if len({f[7:] for f in found}) > 1 else set()
        names = ["revision_of_another_row", "revision_out_of_order", "no_leaf", "conflict_within_source", "conflict_across_sources"]
        best = min(found, key=lambda f: (f[1] != "s0", f[2]), default=None)
        out[key] = (names[min(reasons)], None, None, None) if reasons else ("selected", best[2], *best[7:])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_materialized(spark, seed):
    r = random.Random(seed)
    facts = []
    for i in range(700):
        key, source = r.randrange(200), f"s{r.randrange(3)}"
        same = [f for f in facts if f[:2] == (key, source)]
        old = r.choice(same) if same and r.random() < 0.7 else None
        facts.append((key, source, i, i, old[4] if old and r.random() < 0.9 else r.randrange(2), old[3] if old else None, (old[6] + r.choice([1, 1, 1, 0])) if old else r.randrange(5), r.choice([1, 1, 1, 1, 2]), r.choice(["CNY"] * 8 + ["USD", None])))
    facts += [(900, "s1", 9000, 9000, 0, 9001, 5, 1, "CNY"), (900, "s1", 9001, 9001, 0, 9000, 5, 1, "CNY"), (901, "s1", 9002, 9002, 0, 12345678, 5, 1, "CNY")]
    df = spark.createDataFrame(facts, "key long, source string, fact_id long, record_id long, row_key long, supersedes long, available_at long, value long, unit string")
    got = {x.key: (x.outcome, x.fact_id, x.value, x.unit) for x in materialize.materialized(df, ["key"], ["source"], F.col("source") == "s0").collect()}
    want = loop(facts)
    assert got == want and len({x[0] for x in want.values()}) >= 5


def test_chosen(spark):
    rows = [(1, 10, 2, 0, 5, 1.0, "u"), (1, 11, 1, 3, 5, 2.0, "u"), (1, 12, 1, 0, 4, 3.0, "u"), (1, 13, 1, 0, 6, 3.0, "u"), (2, 20, 1, 0, 1, None, None), (2, 19, 1, 0, 1, None, None)]
    df = spark.createDataFrame(rows, "key long, fact_id long, priority long, parents long, available_at long, value double, unit string")
    got = {tuple(x) for x in materialize.chosen(df, ["key"], [F.col("priority"), F.col("parents"), -F.col("available_at"), F.col("fact_id")]).collect()}
    assert got == {(1, 13, 3.0, "u", 4, 3), (2, 19, None, None, 2, 1)}


def test_pieces_are_bounded():
    """A batch of large rows is cut by bytes: nothing is lost, no slice is larger than the limit unless it is one row."""
    import pyarrow as pa

    rows = [b"x" * n for n in (10, 90, 5, 200, 0, 50, 50, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(rows, pa.binary())], names=["k", "c"])
    got = list(content.pieces(batch.slice(1), 1, 100))
    assert [p.column(0).to_pylist() for p in got] == [[1, 2], [3], [4, 5, 6], [7, 8]]
    assert list(content.pieces(batch.slice(0, 0), 1)) == []
