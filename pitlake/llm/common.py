"""Shared pieces of the training-data operators: shared tables, text mappers, link search, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MASK64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or if it is unset, in local mode only (tests), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='pitlake-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_cell(df: DataFrame, cells: int):
    """df grouped by its column cell (of which there are about `cells`), over as many tasks as that needs: the session's
    number of shuffle partitions would stay as it is while cells grow with the input."""
    return df.repartition(2 * cells, "cell").groupBy("cell")


def columns_after(df: DataFrame, keep: list[str] | None, fields: dict[str, str]) -> tuple[list[str], T.StructType]:
    """Columns passed on, and the schema of them plus fields; a new field replaces an input column of its name."""
    new = {f.lower() for f in fields}
    passed = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in passed])
    for name, kind in fields.items():
        schema.add(name, T._parse_datatype_string(kind))
    return passed, schema


def with_text_columns(
    df: DataFrame, text_col: str, fields: dict[str, str], compute: Callable[[list[bytes]], dict[str, list]], keep: list[str] | None = None, words_at_once: int = 400_000, setup: Callable | None = None
) -> DataFrame:
    """Add columns computed from whole texts (UTF-8; null as empty), Arrow batch by Arrow batch.

    A batch is cut so that about words_at_once words (of 7 bytes) are in work at a time; a longer text stands alone.
    With setup, its result (made once a task) is compute's second argument.
    """
    passed, schema = columns_after(df, keep, fields)
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields[len(passed) :]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for start, stop, raw in slices(texts, 7 * words_at_once):
                made = compute(raw, *state)
                old = [batch.column(batch.schema.get_field_index(c)).slice(start, stop - start) for c in passed]
                new = [pa.array(made[n], kinds[n]) for n in fields]
                yield pa.RecordBatch.from_arrays(old + new, names=[*passed, *fields])
            give_back()

    used = list(dict.fromkeys([*passed, text_col]))
    return df.select(*used).mapInArrow(run, schema)


def give_back() -> None:
    """Return this Python worker's free memory to the system. Workers live on from task to task and stage to stage, and
    would hold what the largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows whose texts together have at most about `most` bytes."""
    raw, size, start = [], 0, 0
    for i, x in enumerate(texts):
        b = (x.as_py() or "").encode("utf-8", "surrogatepass")
        if raw and size + len(b) > most:
            yield start, i, raw
            raw, size, start = [], 0, i
        raw.append(b)
        size += len(b)
    if raw:
        yield start, start + len(raw), raw


def spans(lengths: list[int]) -> np.ndarray:
    """Offsets (one more than lengths) of concatenated runs."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """Masks of every choice of blocks - max_bits blocks out of `blocks`: two values that differ in at most
    max_bits bits agree on at least one of these masks (pigeonhole)."""
    edges = [2 * (32 * i // blocks) for i in range(blocks + 1)]  # never inside a two-bit segment, so that it holds for bit counts too
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(one, blocks - max_bits)]


def blocks_for(n: int, max_bits: int, least: int = 7, each: int = 8) -> int:
    """How many blocks: enough that n even values leave about `each` in a cell at most, so that candidates grow with n
    and not with its square. Any number of blocks finds the same links."""
    blocks = max(least, max_bits + 1)
    while blocks < 2 * max_bits + 2 and n > each << (64 * (blocks - max_bits) // blocks):
        blocks += 1
    return blocks


def popcount_pairs(x: np.ndarray) -> np.ndarray:
    """Bit counts (0 to 2) of the 32 two-bit segments of each 64-bit value, kept in place."""
    return x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))


def manhattan_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed two-bit coordinates: at most the Hamming distance of what they count."""
    low = np.uint64(0x3333333333333333)
    total = np.zeros(len(a), np.int64)
    for shift in (np.uint64(0), np.uint64(2)):
        p, q = (a >> shift) & low, (b >> shift) & low
        d = (p | np.uint64(0x4444444444444444)) - q  # 4 + p - q in each nibble: 2 to 6
        for k in range(16):
            total += np.abs(((d >> np.uint64(4 * k)) & np.uint64(15)).astype(np.int64) - 4)
    return total


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_R = 0x2545F4914F6CDD1D
_tables: dict[str, np.ndarray] = {}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    t = _tables.get(name)
    if t is None or len(t) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        t = np.full(size, base, np.uint64)
        t[0] = 1
        _tables[name] = t = np.cumprod(t, dtype=np.uint64)
    return t[:n]


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2 ** 64."""
    return _grown("p", _R, n)


def inverses(n: int) -> np.ndarray:
    return _grown("i", pow(_R, -1, 1 << 64), n)


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
_places = mix64(np.arange(1 << 12, dtype=np.uint64) + np.uint64(_R))


def _drawn(n: int) -> np.ndarray:
    """A number for each place in a word, for n places at least."""
    global _places
    if len(_places) < n:
        _places = mix64(np.arange(1 << int(n).bit_length(), dtype=np.uint64) + np.uint64(_R))
    return _places


def hashed_words(texts: list[bytes], block: int = 1 << 20, where: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts one after another, and the texts' offsets. A word's
    hash is a sum over its bytes of a number drawn for the byte and its place, so that no rule of a word's letters makes
    two words equal; sums are taken from running ones of about `block` bytes at a time. `where` gets all texts as one,
    and the words' starts and ends in it."""
    raw = b"\n".join(texts) + b"\n"
    out, places, stops, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        stop = min(at + block, len(raw))
        cut = max(raw.rfind(b" ", at, stop), raw.rfind(b"\n", at, stop)) + 1
        if cut <= at:  # one word longer than a block
            cut = min(i for i in (raw.find(b" ", stop), raw.find(b"\n", stop)) if i >= 0) + 1
        x = np.frombuffer(raw, np.uint8, cut - at, at)
        edges = np.flatnonzero(np.diff((x == 32) | ((x >= 9) & (x <= 13)), prepend=True))
        starts, ends = edges[0::2], edges[1::2]
        step = np.ones(len(x), np.int32)  # a running sum of it is each byte's place in its word
        step[starts[:1]] = -starts[:1]
        step[starts[1:]] = 1 - np.diff(starts)
        place = np.cumsum(step, dtype=np.int32)
        drawn = (_drawn(int((ends - starts).max()) if len(starts) else 0).take(place, mode="clip") ^ _BYTES.take(x)) * np.uint64(0x9E3779B97F4A7C15)
        drawn ^= drawn >> np.uint64(32)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(drawn, out=total[1:])
        out.append(mix64(total[ends] - total[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + at)
        stops.append(ends + at)
        at = cut
    starts = np.concatenate(places)
    if where is not None:
        where += [raw, starts, np.concatenate(stops)]
    return np.concatenate(out), np.searchsorted(starts, spans([len(t) + 1 for t in texts]))


def near_pairs(values: np.ndarray, keys: np.ndarray, near: Callable, dense_above: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with equal key for which near(a, b) holds.

    Keys held by more than dense_above rows are walked breadth first and give a spanning forest of
    their links, never all pairs.
    """
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[cut, len(k)])
    size = np.repeat(sizes, sizes)
    left, right = [], []
    at = np.flatnonzero((size > 1) & (size <= dense_above))
    end = np.repeat(cut + sizes, sizes)
    shift = 1
    while len(at := at[at + shift < end[at]]):
        a, b = order[at], order[at + shift]
        ok = near(values[a], values[b])
        left.append(a[ok])
        right.append(b[ok])
        shift += 1
    a, b = forests(values, order[size > dense_above], np.cumsum(np.diff(k[size > dense_above], prepend=k[:1]) != 0) if (size > dense_above).any() else size[:0], near)
    left.append(a)
    right.append(b)
    return np.concatenate(left), np.concatenate(right)


def forests(values: np.ndarray, rest: np.ndarray, group: np.ndarray, near: Callable) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each group of rows `rest` (groups in order). All groups are walked side
    by side: in each round one row of every group meets those of its group that nothing has reached yet."""
    left, right = [rest[:0]], [rest[:0]]
    queue, of = rest[:0], group[:0]
    head = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
    while len(rest):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        head[group[first]] = rest[first]
        fresh = np.zeros(len(head), bool)
        fresh[group[first]] = True
        g, at = np.unique(of, return_index=True)
        head[g], fresh[g] = queue[at], False
        more = np.ones(len(rest), bool)
        more[first[fresh[group[first]]]] = False  # a new root leaves the rest
        rest, group = rest[more], group[more]
        ok = near(values[head[group]], values[rest])
        left.append(head[group[ok]])
        right.append(rest[ok])
        wait = np.ones(len(queue), bool)
        wait[at] = False
        queue, of = np.r_[queue[wait], rest[ok]], np.r_[of[wait], group[ok]]
        rest, group = rest[~ok], group[~ok]
        going = np.zeros(len(head), bool)
        going[group] = True
        queue, of = queue[going[of]], of[going[of]]
    return np.concatenate(left), np.concatenate(right)


def hamming_links(fps: DataFrame, n: int, max_bits: int, blocks: int | None = None, embed: str = "bits", dense_above: int = 64, per_bucket: int = 400_000) -> DataFrame:
    """Links (a, b) between the distinct 64-bit values of column fp that differ in at most max_bits bits.

    Each value goes, packed with others, to one bucket for each mask: all values that agree on a mask meet.
    embed="popcount": the masks apply to the bit counts of two-bit segments (a grid over the embedding), the
    Manhattan distance there is the first bound, and the Hamming distance decides.
    Groups of more than dense_above values in one cell give a spanning forest of their links. blocks: None takes
    blocks_for(n, max_bits).
    """
    blocks = blocks or blocks_for(n, max_bits)
    masks = block_masks(max_bits, blocks)
    buckets = max(1, -(-n // per_bucket))
    grid = popcount_pairs if embed == "popcount" else (lambda x: x)

    def keys(x: np.ndarray, i: int) -> np.ndarray:
        return mix64((grid(x) & np.uint64(masks[i])) + np.uint64(i))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            cell, packed = [], []
            for i in range(len(masks)):
                to = (keys(x, i) >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
                for j in range(buckets):
                    if ends[j] < ends[j + 1]:
                        cell.append(i * buckets + j)
                        packed.append(x[order[ends[j] : ends[j + 1]]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(packed, pa.binary())], names=["cell", "packed"])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(a ^ b) <= max_bits
        if embed != "popcount":
            return ok
        ok = np.zeros(len(a), bool)
        may = np.flatnonzero(manhattan_pairs(grid(a), grid(b)) <= max_bits) if len(a) else np.empty(0, np.int64)
        ok[may] = np.bitwise_count(a[may] ^ b[may]) <= max_bits
        return ok

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("packed").to_pylist()), np.uint64)
        a, b = near_pairs(x, keys(x, key[0].as_py() // buckets), near, dense_above)
        return pa.table({"a": x[a].view(np.int64), "b": x[b].view(np.int64)})

    return fps.select("fp").mapInArrow(deal, "cell long, packed binary").groupBy("cell").applyInArrow(meet, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each node that isn't its component's
    smallest. Alternates large-star and small-star joins; every round is written to the shared folder."""
    e = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(e)
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = table(small.union(low).distinct(), "edges")
        now = _mark(e)
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
