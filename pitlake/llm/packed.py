"""Arrays packed into binary values, so that a shuffle moves a few bytes an entry; word hashes; mapped files."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_KINDS = [np.dtype(k) for k in ("u1", "u2", "<u4", "<u8", "<i8", "<f4", "<f8", "<i4")]


def pack(*arrays: np.ndarray) -> bytes:
    out = [bytes([len(arrays)])]
    for a in arrays:
        out += [bytes([_KINDS.index(a.dtype)]), len(a).to_bytes(8, "little"), a.tobytes()]
    return b"".join(out)


def unpack(packed: bytes) -> list[np.ndarray]:
    at, out = 1, []
    for _ in range(packed[0]):
        kind, n = _KINDS[packed[at]], int.from_bytes(packed[at + 1 : at + 9], "little")
        out.append(np.frombuffer(packed, kind, n, at + 9))
        at += 9 + n * kind.itemsize
    return out


def merged(rows: list[bytes]) -> list[np.ndarray]:
    """The arrays of several packed values, each concatenated over all of them."""
    return [np.concatenate(x) for x in zip(*map(unpack, rows))]


def runs_of(to: np.ndarray, n: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """An order that sorts entries by destination, and (destination, start, stop) of each that has entries."""
    order = np.argsort(to, kind="stable")
    s = to[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    return order, zip(s[first].tolist(), first.tolist(), [*first[1:].tolist(), len(s)])


def small(x: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers in the narrowest unsigned type that holds all of them."""
    most = int(x.max()) if len(x) else 0
    return x.astype("u1" if most < 1 << 8 else "u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


class WordHashes(dict):
    """128-bit hashes of words as two lanes; starts afresh when it holds `most` words."""

    def __init__(self, most: int = 500_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh3_128_intdigest(word)
        return out

    def lanes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        d = [self[w] for w in words]
        low = (1 << 64) - 1
        return np.fromiter((x >> 64 for x in d), np.uint64, len(d)), np.fromiter((x & low for x in d), np.uint64, len(d))


def put(path: str, data: bytes) -> None:
    """Write a file of the shared folder as a whole: a repeated or lost task leaves no part of it."""
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    store.create_dir(p.rpartition("/")[0], recursive=True)
    part = f"{p}.{os.getpid()}-{os.urandom(4).hex()}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, p)


def mapped(path: str, kind: str) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array. From a store that isn't a file system, a worker maps
    a private copy whose name is gone at once."""
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(p, np.dtype(kind), "r") if os.path.getsize(p) else np.empty(0, np.dtype(kind))
    with store.open_input_stream(p) as src, tempfile.NamedTemporaryFile() as copy:
        while block := src.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, np.dtype(kind), "r") if copy.tell() else np.empty(0, np.dtype(kind))


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in the sorted `keys`, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return [k[first], *(np.add.reduceat(v[order].astype(np.int64), first) for v in values)]


def batch(cells: list[int], packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(packed, pa.binary())], names=["cell", "packed"])
