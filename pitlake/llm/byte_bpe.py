"""Operator 12: byte-level BPE with every distinct pre-token encoded once for the whole corpus."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pitlake.llm.common import by_cell, columns_after, slices, table
from pitlake.llm.packed import pack, small, unpack

FIELDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary"}
DIGESTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def token_bytes(path: str) -> dict[bytes, int]:
    """The file's table of tokens: bytes to id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def single_piece(path: str):
    """An encoder that takes each text as one piece."""
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=token_bytes(path), special_tokens={})


@cache
def splitter(path: str, pattern: str):
    """A function from a text to its pre-tokens as the tiktoken library would match them.

    The `regex` library and tiktoken know different versions of Unicode, so that some characters are letters or numbers
    to one of them only. Texts without such a character are split by the pattern as it stands, the others by the same
    pattern with the classes written out as tiktoken has them.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    plain, odd, own = regex.compile(pattern), set(), pattern
    for name in (r"\p{L}", r"\p{N}"):
        classes = tiktoken.Encoding("class", pat_str=f"{name}+", mergeable_ranks=token_bytes(path), special_tokens={})
        theirs = classes.decode(classes.encode_ordinary(every))
        odd |= set(theirs) ^ set(regex.findall(name, every))
        points = np.array([ord(c) for c in theirs])
        cut = np.flatnonzero(np.diff(points, prepend=-2) != 1)
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[cut], points[np.r_[cut[1:] - 1, len(points) - 1]]))
        own = regex.sub(r"(\[[^\]]*)" + regex.escape(name), lambda m, r=ranges: m[1] + r, own).replace(name, f"[{ranges}]")
    slow = regex.compile(own)
    high = re.compile(f"[{min(odd)}-\U0010ffff]") if odd else None  # most texts have no character from there on

    def split(text: str) -> list[str]:
        return (slow if high and high.search(text) and not odd.isdisjoint(text) else plain).findall(text)

    return split


def packed_bytes(*arrays: np.ndarray, level: int = 6) -> bytes:
    raw = pack(*arrays)
    settings = zstandard.ZstdCompressionParameters.from_level(level, source_size=len(raw), window_log=25, enable_ldm=True)
    return zstandard.ZstdCompressor(compression_params=settings).compress(raw)


def unpacked_bytes(data: bytes) -> list[np.ndarray]:
    return unpack(zstandard.ZstdDecompressor(max_window_size=1 << 27).decompress(data))


def packed_words(words: list[bytes]) -> bytes:
    return packed_bytes(small(np.fromiter(map(len, words), np.int64, len(words))), np.frombuffer(b"".join(words), np.uint8))


def unpacked_words(data: bytes) -> list[bytes]:
    sizes, raw = unpacked_bytes(data)
    ends, raw = np.cumsum(sizes, dtype=np.int64).tolist(), raw.tobytes()
    return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends)]


class TokenTable:
    """The bytes of each id, as one array: what decoding looks ids up in."""

    def __init__(self, path: str) -> None:
        ranks = token_bytes(path)
        size = max(ranks.values(), default=-1) + 1
        pieces = [b""] * size
        for raw, i in ranks.items():
            pieces[i] = raw
        self.names = [str(i) for i in range(size)]
        self.sizes = np.fromiter(map(len, pieces), np.int64, size)
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids one after another; an id that the file doesn't have is an error."""
        out, ids = [], ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.known[ids].all()):
            raise ValueError("an id isn't in the token table")
        for at in range(0, len(ids), 1 << 20):
            part = ids[at : at + (1 << 20)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def digest(self, ids: np.ndarray) -> str:
        names = self.names
        out = hashlib.sha256()
        for at in range(0, len(ids), 1 << 20):
            out.update(((" " if at else "") + " ".join([names[i] for i in ids[at : at + (1 << 20)].tolist()])).encode())
        return out.hexdigest()


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None, pattern: str | None = None, digests: bool = False, block_mb: int = 32, cell_mb: int = 64) -> DataFrame:
    """Rows of docs with the ids of the whole text and the bytes that the ids decode to; with digests, their SHA-256
    (of the decimal ids joined by a blank, and of the decoded bytes) in place of them.

    Texts are cut into pre-tokens block by block of about block_mb MB of text; a block has its distinct pre-tokens once
    and the place of each in its texts, as numbers in the order of frequency. Distinct words are shuffled by their hash
    to cells (one for each cell_mb MB of text), where each is encoded once for all blocks; its ids go back to the
    blocks that have it, where texts are put together by position. A word that is everywhere is one entry a block,
    so no cell has more than a share of the words and one entry a block for each. The blocks are written to the shared
    folder first: numbers of words mean the same to all tasks, whatever is lost and run again.

    Null and empty texts have no ids and decode to nothing. A text longer than a block is a block of its own. Repeated
    rows have the same result each; an empty table gives an empty result. Input columns named like a result are
    replaced; all others (or those of keep) are handed on.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()
    fields = DIGESTS if digests else FIELDS
    passed, schema = columns_after(docs, keep, fields)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[len(passed) :]]
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    cells = max(1, -(-size // (cell_mb << 20)))
    used = list(dict.fromkeys([*passed, text_col]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task, number = splitter(path, pattern), TaskContext.get().partitionId(), count()
        kept, places, bytes_, index = [], [], 0, defaultdict(count().__next__)

        def block() -> pa.RecordBatch:
            words = [w.encode() for w in index]
            flat = np.concatenate([np.empty(0, np.uint32), *places])
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            words, flat = [words[i] for i in order.tolist()], rank[flat]
            cell = np.fromiter((crc32(w) % cells for w in words), np.uint32, len(words))
            seq = packed_bytes((flat & 0xFFFF).astype("<u2"), small(flat >> 16), small(np.array([len(p) for p in places], np.int64)), small(cell))
            names = [str(i) for i in range(len(passed))]
            rows = pa.Table.from_batches([pa.RecordBatch.from_arrays(k, names=names) for k in kept]) if passed else None
            out = pa.BufferOutputStream()
            if passed:
                with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                    f.write_table(rows.combine_chunks())
            cols = [[task << 32 | next(number)], [packed_words(words)], [seq], [out.getvalue().to_pybytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "words", "seq", "kept"])

        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            for start, stop, raw in slices(texts, block_mb << 20):
                if places and bytes_ + sum(map(len, raw)) > block_mb << 20:
                    yield block()
                    kept, places, bytes_, index = [], [], 0, defaultdict(count().__next__)
                kept.append([b.column(b.schema.get_field_index(c)).slice(start, stop - start) for c in passed])
                for t in raw:
                    found = split(t.decode("utf-8", "replace"))
                    places.append(np.fromiter(map(index.__getitem__, found), np.uint32, len(found)))
                    bytes_ += len(t)
        if places:
            yield block()

    blocks = table(docs.select(*used).mapInArrow(cut, "block long, words binary, seq binary, kept binary"), "pre-tokens")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                to = defaultdict(list)
                for w in unpacked_words(data):
                    to[crc32(w) % cells].append(w)
                yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.int64()), pa.array([block] * len(to), pa.int64()), pa.array(map(packed_words, to.values()), pa.binary())], names=["cell", "block", "packed"])

    def encoded(key: tuple, t: pa.Table) -> pa.Table:
        encoder = single_piece(path)
        ids: dict[bytes, np.ndarray] = {}
        out = []
        for data in t.column("packed").to_pylist():
            found = []
            for w in unpacked_words(data):
                if w not in ids:
                    ids[w] = np.array(encoder.encode_ordinary(w.decode()), np.uint32)
                found.append(ids[w])
            flat = np.concatenate([np.empty(0, np.uint32), *found])
            out.append(packed_bytes(small(np.fromiter(map(len, found), np.int64, len(found))), small(flat)))
        return pa.table({"block": t.column("block"), "cell": t.column("cell"), "packed": pa.array(out, pa.binary()), "kept": pa.nulls(len(out), pa.binary())})

    parts = by_cell(blocks.select("block", "words").mapInArrow(deal, "cell long, block long, packed binary"), cells).applyInArrow(encoded, "block long, cell long, packed binary, kept binary")
    whole = blocks.select("block", F.lit(-1).cast("long").alias("cell"), F.col("seq").alias("packed"), "kept")

    def reassembled(key: tuple, t: pa.Table) -> pa.Table:
        tokens, cell, packed = TokenTable(path), t.column("cell").to_pylist(), t.column("packed").to_pylist()
        at = cell.index(-1)
        low, high, docs_, cell_of = unpacked_bytes(packed[at])
        seq = low.astype(np.uint32) | (high.astype(np.uint32) << 16)
        found = {c: unpacked_bytes(p) for c, p in zip(cell, packed) if c >= 0}
        sizes, starts, flat, base = np.zeros(len(cell_of), np.int64), np.zeros(len(cell_of), np.int64), [np.empty(0, np.uint32)], 0
        for c, (n, ids) in found.items():
            mine, n = np.flatnonzero(cell_of == c), n.astype(np.int64)
            if len(mine) != len(n):
                raise RuntimeError("a block's words and ids differ in number")
            sizes[mine], starts[mine] = n, base + np.cumsum(n) - n
            flat.append(ids.astype(np.uint32))
            base += len(ids)
        flat, stop, made = np.concatenate(flat), 0, [[], [], []]
        for n in docs_.tolist():
            word = seq[stop : stop + n]
            stop += n
            s = sizes[word]
            ends = np.cumsum(s)
            ids = flat[np.repeat(starts[word] - ends + s, s) + np.arange(ends[-1])] if n else flat[:0]
            raw = tokens.decode(ids)
            made[0].append(len(ids))
            made[1].append(tokens.digest(ids) if digests else ids.astype(np.int32))
            made[2].append(hashlib.sha256(raw).hexdigest() if digests else raw)
        new = [pa.array(m, k) for m, k in zip(made, kinds)]
        old = pa.ipc.open_stream(t.column("kept")[at].as_py()).read_all().columns if passed else []
        return pa.table([*old, *new], names=[*passed, *fields])

    return parts.union(whole).groupBy("block").applyInArrow(reassembled, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Rows of encoded with the bytes of their ids, looked up in the file's token table (as large as its vocabulary).

    Null ids decode to null, none to nothing; a null or unknown id is an error. An input column named out_col is
    replaced."""
    path = path or default_ranks()
    passed = [c for c in encoded.columns if c.lower() != out_col.lower()]
    schema = T.StructType([encoded.schema[c] for c in passed]).add(out_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenTable(path)
        for b in batches:
            raw = [tokens.decode(np.array(x, np.int64)) if x is not None else None for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in passed), pa.array(raw, pa.binary())], names=[*passed, out_col])

    return encoded.select(*dict.fromkeys([*passed, ids_col])).mapInArrow(run, schema)
