"""Bytes as they come: charsets by mark, declaration or trial; a content-addressed store; loads that are checked first."""

from __future__ import annotations

import codecs
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.operators.grids import plain_text

#: Declared charsets and how they are read.
CHARSETS = {"utf-8": "utf-8", "utf8": "utf-8", "gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5"}
_DECLARED = re.compile(rb"charset\s*=\s*[\"']?\s*([a-zA-Z0-9_-]+)", re.I)


def sniff(raw: bytes) -> tuple[str | None, str | None, str]:
    """(text, charset, status): a UTF-8 mark decides, then the first declaration within 8 KB, then trial (UTF-8, GB18030). Bytes
    that don't fit are `undecodable`, never replaced; a charset that isn't known is `unsupported_charset`."""
    if raw.startswith(codecs.BOM_UTF8):
        tried = ["utf-8-sig"]
    elif found := _DECLARED.search(raw[:8192]):
        name = CHARSETS.get(found[1].decode("ascii").lower().replace("_", "-"))
        if name is None:
            return None, None, "unsupported_charset"
        tried = [name]
    else:
        tried = ["utf-8", "gb18030"]
    for name in tried:
        try:
            return raw.decode(name), name, "decoded"
        except UnicodeDecodeError:
            continue
    return None, tried[-1], "undecodable"


def pieces(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes in a column, a row at least: what a task holds of its copies is bounded."""
    sizes, start, held = pc.binary_length(batch.column(column)).fill_null(0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def decoded(files: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, text, charset, status) of bytes; null bytes are `missing`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, 1):
                found = [sniff(x.as_py()) if x.is_valid else (None, None, "missing") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[i] for f in found], pa.string()) for i in range(3))], names=[id_col, "text", "charset", "status"])

    return files.select(id_col, content).mapInArrow(run, f"{id_col} {files.schema[id_col].dataType.simpleString()}, text string, charset string, status string")


def ingested(files: DataFrame, id_col: str, suffix: str, content: str) -> DataFrame:
    """(id, sha256, charset, status, text) of HTML, plain and Markdown files; others are `unsupported_format`. HTML loses
    scripts, styles and comments, blocks become lines; all lose blanks at the ends of lines and empty lines."""
    text = F.col("text")
    bare = F.regexp_replace(text, "(?is)<(script|style)(?=[\\s>]).*?</\\1\\s*>|<!--.*?-->", "")
    lines = plain_text(F.regexp_replace(bare, "(?i)<(br|p|div|h[1-6]|li|tr|/p|/div|/h[1-6]|/li|/tr|/title)(?=[\\s/>])[^>]*>", "\n"))
    known = F.lower(suffix).isin("html", "htm", "txt", "md")
    read = decoded(files, id_col, content)
    meta = files.select(id_col, F.lower(suffix).alias("_suffix"), F.sha2(content, 256).alias("sha256"), F.coalesce(known, F.lit(False)).alias("_known"))
    both = meta.join(read, id_col).withColumn("text", F.when(F.col("_known") & (F.col("status") == "decoded"), _clean(F.when(F.col("_suffix").isin("html", "htm"), lines).otherwise(text))))
    status = F.when(~F.col("_known"), "unsupported_format").when(F.col("status") != "decoded", F.col("status")).when(F.col("text") == "", "empty").otherwise("parsed")
    return both.select(id_col, "sha256", "charset", status.alias("status"), "text")


def _clean(body: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(body, "\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "[\\t\\u00A0 \\f\\x0B]+", " "))), lambda x: x != ""), "\n")


def archive(files: DataFrame, root: str, name: str = "name", content: str = "content") -> DataFrame:
    """Put files (name, content) into the store at `root`, and return its manifest of this run: (name, digest, length, reused).

    A blob is kept once, whatever names it comes under and in whatever run: only digests that no manifest has are written.
    Blobs are committed before the manifest that names them, and a manifest appears as a whole, so that a reader never
    meets a name without its bytes; an interrupted run leaves blobs that no one names. Null content is no file."""
    spark = files.sparkSession
    found = files.where(F.col(content).isNotNull()).select(F.col(name).alias("name"), F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("length"), F.col(content).alias("content"))
    known = manifests(spark, root).select("digest").distinct()
    fresh = found.join(known, "digest", "left_anti").groupBy("digest").agg(F.first("length").alias("length"), F.first("content").alias("content"))
    run = uuid.uuid4().hex
    fresh.write.option("compression", "zstd").parquet(f"{root}/blobs/run={run}")
    seen = spark.read.schema("digest string, length long").parquet(f"{root}/blobs/run={run}").select("digest", F.lit(False).alias("old"))
    out = found.drop("content").join(seen, "digest", "left").select("name", "digest", "length", F.col("old").isNull().alias("reused"))
    out.write.parquet(f"{root}/manifests/run={run}")
    return spark.read.schema(out.schema).parquet(f"{root}/manifests/run={run}")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    schema = "name string, digest string, length long, reused boolean"
    return _runs(spark, f"{root}/manifests", schema)


def blobs(spark: SparkSession, root: str) -> DataFrame:
    return _runs(spark, f"{root}/blobs", "digest string, length long, content binary")


def _runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All runs that are complete; none before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(s.getPath()) for s in store.listStatus(p) if store.exists(hadoop.Path(s.getPath(), "_SUCCESS"))] if store.exists(p) else []
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def verified(manifest: DataFrame, held: DataFrame) -> DataFrame:
    """(name, digest, state) of a manifest against blobs (digest, content): `missing`, `cut` (shorter), `altered` (other bytes), `good`."""
    proof = held.select("digest", F.octet_length("content").cast("long").alias("_n"), F.sha2("content", 256).alias("_sha")).dropDuplicates(["digest"])
    state = F.when(F.col("_sha").isNull(), "missing").when(F.col("_n") < F.col("length"), "cut").when(F.col("_sha") != F.col("digest"), "altered").otherwise("good")
    return manifest.join(proof, "digest", "left").select("name", "digest", state.alias("state"))


def gate(items: DataFrame, group: str, exclusion: Column, blocking: list[str]) -> DataFrame:
    """(group, n_items, n_excluded, blocked_by, passes): evidence passes with one item at least that nothing excludes, and no
    exclusion that blocks; `blocked_by` is the first of those in their order."""
    order = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(blocking))):
        order = F.when(F.col("_x") == b, i).otherwise(order)
    rows = items.withColumn("_x", exclusion).groupBy(group).agg(F.count_if(F.col("_x").isNull()).alias("n_items"), F.count("_x").alias("n_excluded"), F.min(order).alias("_b"))
    blocked = F.when(F.col("_b").isNotNull(), F.element_at(F.array(*[F.lit(b) for b in blocking]), F.col("_b") + 1))
    return rows.select(group, "n_items", "n_excluded", blocked.alias("blocked_by"), ((F.col("n_items") > 0) & F.col("_b").isNull()).alias("passes"))


def checked_projection(spark: SparkSession, path: str, listed: DataFrame, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, rows, bad lines) of JSON lines under `path` against what is listed (name, sha256, n_rows): every file's bytes are hashed,
    and only good files are parsed. States: `missing`, `unlisted`, `hash_mismatch`, `row_count_mismatch` (good lines, bad
    ones included, aren't as many as listed), `good`."""
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    lines = F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: F.trim(x) != "")
    here = raw.select("name", F.sha2("content", 256).alias("found"), F.size(lines).cast("long").alias("n_found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") != F.col("sha256"), "hash_mismatch").when(F.col("n_found") != F.col("n_rows"), "row_count_mismatch").otherwise("good")
    files = listed.join(here, "name", "full").select("name", state.alias("state"))
    good = raw.join(files.where("state = 'good'"), "name", "left_semi").select("name", F.posexplode(lines).alias("line_no", "line"))
    parsed = good.withColumn("r", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return files, parsed.where("r._bad is null").select("name", "line_no", "r.*").drop("_bad"), parsed.where("r._bad is not null").select("name", "line_no", "line")
