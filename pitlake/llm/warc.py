"""Operator 8: WARC archives in dictionary-compressed Zstandard, one frame a record."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pitlake.llm.common import shared_dir, table
from pitlake.llm.packed import put

DICTIONARY_MAGIC = 0x184D2A5D
RECORD = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary, record_id string, refers_to_id string, error string"
_PAGE = re.compile("<urn:page:(-?[0-9]*)>")


class BadArchive(ValueError):
    pass


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record; payload None: a revisit of refers_to."""
    kind = "revisit" if payload is None else "response"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    body = b"" if payload is None else payload
    if payload is None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def digest_of(named: str, data: bytes) -> bool | None:
    """Whether data has the digest `algorithm:value` (hex of either case, or base32); None for an algorithm that isn't known."""
    algorithm, _, value = named.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return None
    found, value = hashlib.new(algorithm, data).digest(), value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def headers(head: str) -> dict[str, str]:
    """Named fields of a record; a line that starts with a blank goes on with the one before. Of the fields that may stand
    several times (WARC-Concurrent-To) all are kept, one a line; any other that does is an error."""
    out: dict[str, str] = {}
    last = ""
    for line in head.split("\r\n"):
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower()
        if not colon or not last or (last in out and last != "warc-concurrent-to"):
            raise BadArchive(f"bad header {line[:40]!r}")
        out[last] = f"{out[last]}\n{value.strip()}" if last in out else value.strip()
    return out


def parse(raw: bytes) -> dict:
    """One record of any type, all of it: version, headers, lengths, end marks and digests are checked.

    The payload is the block, or what follows the HTTP headers of a block that has them (its content type says so). The block's
    digest is of the block, the payload's of the payload; a revisit's is that of the payload it stands for, and one of a
    truncated record can't be checked. Digests are hex or base32."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, _, fields = head.decode("utf-8", "replace").partition("\r\n")
    if not mark or version not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("no WARC version or no end of headers")
    h = headers(fields)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise BadArchive(f"no {name}")
    if not h["content-length"].isdigit():
        raise BadArchive("the length is no number")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive("the length isn't that of the block")
    kind, block = h["warc-type"], rest[:n]
    payload = block
    if h.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        ends = [(i, len(e)) for e in (b"\r\n\r\n", b"\n\n") if (i := block.find(e)) >= 0]
        payload = block[sum(min(ends)) :] if ends else b""
    if "warc-block-digest" in h and digest_of(h["warc-block-digest"], block) is False:
        raise BadArchive("the block isn't that of its digest")
    named = h.get("warc-payload-digest")
    whole = kind != "revisit" and "warc-truncated" not in h
    if whole and named and digest_of(named, payload) is False:
        raise BadArchive("the payload isn't that of its digest")
    size = h.get("x-payload-length", "")
    if whole and size and size != str(len(payload)):
        raise BadArchive("the payload isn't as long as its header says")
    if kind == "revisit" and "warc-refers-to" not in h and "warc-refers-to-target-uri" not in h and not named:
        raise BadArchive("a revisit of nothing")
    page = lambda x: int(m[1]) if x and (m := _PAGE.fullmatch(x)) and m[1] else None
    return {
        "page_id": page(h["warc-record-id"]), "record_type": kind, "url": h.get("warc-target-uri"), "payload_digest": _hex(named) if named else hashlib.sha1(payload).hexdigest(),
        "payload_bytes": int(size) if size.isdigit() else len(payload), "refers_to": page(h.get("warc-refers-to")), "payload": None if kind == "revisit" else payload,
        "record_id": h["warc-record-id"], "refers_to_id": h.get("warc-refers-to"), "error": None,
    }


def _hex(named: str) -> str:
    """The value of a digest in lower-case hex; as it is if it is neither hex nor base32."""
    value = named.partition(":")[2].strip()
    sizes = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
    n = sizes.get(named.partition(":")[0].strip().lower().replace("-", ""))
    if n and len(value) == 2 * n:
        return value.lower()
    try:
        return base64.b32decode(value.upper().rstrip("=") + "=" * (-len(value.rstrip("=")) % 8)).hex()
    except ValueError:
        return value


def read_archive(raw: bytes, strict: bool = True) -> Iterator[dict]:
    """The records of one archive: the dictionary stands in the leading skippable frame (plain or itself a frame),
    then each frame is one record. A bad one is an error, or, if not strict, a record with nothing but its error; what is cut
    off, or no frame, ends the archive."""
    at, words = 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", raw, 4)[0]
        held = raw[8:at]
        if len(held) != at - 8:
            raise BadArchive("the dictionary frame is cut off")
        if held[:4] == b"\x28\xb5\x2f\xfd":
            held = zstandard.ZstdDecompressor().decompress(held)
        words = zstandard.ZstdCompressionDict(held) if held else None
    reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    view = memoryview(raw)
    while at < len(raw):
        if len(raw) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", raw, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", raw, at + 4)[0]
            continue
        one = reader.decompressobj()
        parts, step = [], 1 << 16
        start = at
        while not one.eof and at < len(raw):
            parts.append(one.decompress(view[at : at + step]))
            at += step
        if not one.eof:
            raise BadArchive(f"the frame at byte {start} is cut off")
        at = min(at, len(raw)) - len(one.unused_data)
        try:
            found = parse(b"".join(parts))
        except BadArchive as e:
            if strict:
                raise
            found = failed(f"the record at byte {start}: {e}")
        yield found


def failed(error: str) -> dict:
    return dict.fromkeys(x.split(" ")[0] for x in RECORD.split(", ")) | {"error": error}


def train_dictionary(pages: DataFrame, sample: int = 2000, each: int = 20_000, size: int = 64 << 10) -> bytes:
    """A dictionary from records of at most `sample` pages (payload, url), `each` bytes of each payload. Where they are
    too few or too short to train on, a raw one: the last `size` bytes of them, or of an empty record; never empty."""
    rows = pages.where("payload is not null").select(F.substring("payload", 1, each), "url").limit(sample).collect()
    samples = [record(i, r[1], bytes(r[0]), len(r[0]), hashlib.sha1(bytes(r[0])).hexdigest(), None) for i, r in enumerate(rows)]
    total = sum(map(len, samples))
    try:
        trained = zstandard.train_dictionary(min(size, total // 8), samples).as_bytes() if total >= 8 * 1024 else b""
    except zstandard.ZstdError:
        trained = b""
    return trained or b"".join(samples or [record(0, "http://", b"", 0, "0" * 40, None)])[-size:]


def resolved(pages: DataFrame, least: int = 1000, broadcast_mb: int = 64, salts: int = 32) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest, record_type and refers_to: of equal payloads of at least
    `least` bytes the one with the largest page_id is the response; all others lose their payload here.

    Which that is comes from digests and ids alone. The table of payloads that occur twice is broadcast if it is small (its
    size is checked), so that no payload is shuffled; else it is joined with the copies of a payload dealt over `salts`."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = p.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("copies"))
    large = table(large.where("copies > 1").drop("copies"), "warc-copies")
    keys = ["payload_digest", "payload_bytes"]
    if large.count() * 100 <= broadcast_mb << 20:
        p = p.join(F.broadcast(large), keys, "left")
    else:
        spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, [*keys, "salt"], "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return p.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"))


def write(pages: DataFrame, path: str, dictionary: bytes = b"", archive_bytes: int = 64 << 20) -> DataFrame:
    """Write resolved pages as .warc.zst archives under path; returns (path, records, bytes) of each.

    A task writes its rows as one archive, and a further one for each archive_bytes. Names come from the task's
    partition, and a file appears as a whole: a task that runs again replaces its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=words) if words else zstandard.ZstdCompressor(level=3)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        out, n, done = io.BytesIO(), 0, []

        def close() -> None:
            nonlocal out, n
            if n:
                name = f"{path}/part-{TaskContext.get().partitionId():06d}-{len(done):04d}.warc.zst"
                put(name, lead + out.getvalue())
                done.append((name, n, len(lead) + out.tell()))
            out, n = io.BytesIO(), 0

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                page, url, payload, size, digest, kind, refers = r
                out.write(writer.compress(record(page, url, payload, size, digest, refers)))
                n += 1
                if out.tell() >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    rows = pages.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return table(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read(files: DataFrame, strict: bool = True) -> DataFrame:
    """Records of archives (rows with binary column content, as from spark.read.format("binaryFile")), whoever wrote them: all
    record types, plain records and such of HTTP messages. page_id and refers_to are those of archives written here, else
    null; record_id and refers_to_id are as they stand. If not strict, bad records are rows with an error and nothing else."""
    kinds = {f.name: to_arrow_type(f.dataType) for f in T._parse_datatype_string(RECORD).fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in kinds.items()], names=list(kinds))

        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                try:
                    for r in read_archive(content.as_py(), strict):
                        rows.append(r)
                        size += len(r["payload"] or b"") + 200
                        if size > 8 << 20:
                            yield made(rows)
                            rows, size = [], 0
                except (BadArchive, zstandard.ZstdError, struct.error) as e:
                    if strict:
                        raise
                    rows.append(failed(f"the archive: {e}"))
                yield made(rows)

    return files.select("content").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, path: str | None = None, least: int = 1000) -> DataFrame:
    """Write pages (page_id, url, html) as archives and read the records back.

    A null html is an empty payload, a null url has no target header, a null page_id comes back null (and is never
    a response that others revisit, unless all copies are null: then each is one). Rows that repeat a page_id are
    records of their own; among equal payloads those with the largest page_id are all responses. An empty table
    writes nothing and gives no records. Extra columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    sample = pages.select(F.col("html").cast("binary").alias("payload"), "url")
    done = write(resolved(pages, least), path, train_dictionary(sample))
    if done.isEmpty():
        return spark.createDataFrame([], RECORD)
    return read(spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".warc.zst")))
