"""Operator 3: substring dedup by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import mix64, slices, spans
from pitlake.llm.packed import WordHashes, found, pack, runs_of, small, unpack

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def text_key(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) - (1 << 63)


class Texts:
    """The words of some rows as hash lanes, with what each position's window needs."""

    def __init__(self, ids: np.ndarray, ranks: np.ndarray, raw: list[bytes], known: WordHashes, window: int) -> None:
        self.ids, self.ranks, self.words = ids, ranks, [b.split() for b in raw]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.at = spans(self.lengths)
        self.n = int(self.at[-1])
        self.doc = np.repeat(np.arange(len(raw)), self.lengths)
        self.place = np.arange(self.n) - self.at[self.doc]
        self.left = self.lengths[self.doc] - self.place  # words from here to the end of the text
        self.hi, self.lo = known.lanes([w for words in self.words for w in words])
        self.window = window

    def rolled(self, lane: np.ndarray, k: int, by: np.uint64) -> np.ndarray:
        """A hash of the k words from each position (only meaningful where the text has them)."""
        out = np.zeros(self.n, np.uint64)
        for i in range(k):
            out[: self.n - i] = out[: self.n - i] * by + lane[i:]
        return mix64(out)

    def starts(self) -> np.ndarray:
        return np.flatnonzero(self.left >= self.window)

    def split_known(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that start at `at`: those that the smallest id here holds, with both lanes of their hash
        (one row for each document), and those of larger ids, which are repeats already."""
        hi, lo = self.rolled(self.hi, self.window, _A)[at], self.rolled(self.lo, self.window, _B)[at]
        ids = self.ids[self.doc[at]]
        order = np.lexsort((ids, lo, hi))
        h, o, i = hi[order], lo[order], ids[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(at) else np.empty(0, bool)
        least = i[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))] if len(at) else i
        is_least = i == least
        return at[order[is_least]], h[is_least], o[is_least], at[order[~is_least]]

    def marks(self, at: np.ndarray, width: int) -> np.ndarray:
        """Positions within `width` from any of `at`."""
        step = np.zeros(self.n + width + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + width, -1)
        return np.cumsum(step)[: self.n] > 0

    def decided(self, at: np.ndarray) -> bytes:
        """The places of the windows that start at `at`, by the rank of their document in its group."""
        at = np.sort(at)
        d = self.doc[at]
        start = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        return pack(np.array([DECIDED], "u1"), small(self.ranks[d[start]]), small(np.diff(np.r_[start, len(at)])), small(self.place[at]))


def group_of(ids: np.ndarray, keys: np.ndarray, groups: int) -> np.ndarray:
    return ((mix64(ids.view(np.uint64) * _A + keys.view(np.uint64)) >> np.uint64(8)) % np.uint64(groups)).astype(np.int64)


def ranks_of(docs: pa.Table) -> np.ndarray:
    """The rank of each row's (id, key of the text) in its group, the same whatever order the rows come in; equal rows
    have equal ranks, rows with a null id have -1."""
    ids, keys = (docs.column(c).fill_null(0).to_numpy() for c in ("doc_id", "key"))
    named = np.flatnonzero(docs.column("doc_id").is_valid().to_numpy())
    order = named[np.lexsort((keys[named], ids[named]))]
    out = np.full(len(ids), -1, np.int64)
    out[order] = np.cumsum(np.r_[False, (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])][: len(order)])
    return out


def texts_of(docs: pa.Table, window: int) -> Iterator[Texts]:
    """The rows of a group that have an id, slice by slice."""
    ranks = ranks_of(docs)
    named = pa.array(np.flatnonzero(ranks >= 0))
    ranks, docs = ranks[ranks >= 0], docs.select(["doc_id", "text"]).take(named)
    known = WordHashes(200_000)
    for start, stop, raw in slices(docs.column("text").combine_chunks() if len(docs) else [], 3_000_000):
        yield Texts(docs.column("doc_id").slice(start, stop - start).to_numpy(), ranks[start:stop], raw, known, window)


def thin(h: np.ndarray) -> np.ndarray:
    """Distinct 32-bit values in order as their distances, first the low bytes of all: the high ones are few and compress."""
    return np.diff(h, prepend=h.dtype.type(0)).astype("<u4").view("u1").reshape(-1, 4).T.ravel()


def thick(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


DECIDED, LIVE = 0, 1


def _anchor(window: int) -> int:
    """The block length: every window holds a whole aligned block."""
    return (window + 1) // 2


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def _probe(window: int, buckets: int):
    """Each slice of a group: its own repeats (decided), and for all other windows the aligned blocks to index and the
    rolling blocks to probe with: hashes only, each once a slice, by hash bucket. Those that an aligned block of one
    document and any block of a larger one here share are live already."""
    block = _anchor(window)

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        g = key[0].as_py()
        cells, packed = [], []
        for t in texts_of(docs, window):
            least, _, _, gone = t.split_known(t.starts())
            if len(gone):
                cells.append(-1 - g)
                packed.append(t.decided(gone))
            at = np.flatnonzero(t.marks(least, window - block + 1))
            h = t.rolled(t.lo, block, _B)[at]
            h = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64((1 << 32) - 1)
            order = np.argsort(h)
            h, who, aligned = h[order], t.ids[t.doc[at]][order], (t.place[at] % block == 0)[order]
            if not len(h):
                continue
            first = _starts(h)
            h, indexed = h[first], np.logical_or.reduceat(aligned, first)
            live = indexed & (np.maximum.reduceat(who, first) > np.minimum.reduceat(np.where(aligned, who, np.iinfo(np.int64).max), first))
            if live.any():
                cells.append(-1 - g)
                packed.append(pack(np.array([LIVE], "u1"), thin(np.unique(h[live].astype(np.uint32)))))
            _, runs = runs_of((h >> np.uint64(32)).astype(np.int64), buckets)
            for s, i, j in runs:
                x, a = h[i:j].astype(np.uint32), indexed[i:j]
                cells.append(s)
                packed.append(pack(np.array([g], "<i8"), thin(x[a]), thin(x[~a])))
        return pa.table({"cell": pa.array(cells, pa.int64()), "packed": pa.array(packed, pa.binary())})

    return run


def _passed(cell: int, rows: list[bytes]) -> pa.Table:
    return pa.table({"g": pa.array([-1 - cell] * len(rows), pa.int64()), "packed": pa.array(rows, pa.binary())})


def _hit():
    """A bucket of block hashes: those that an aligned block of one slice and any block of another share, sent to the
    groups of all such slices. What is known already passes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        cell, rows = key[0].as_py(), t.column("packed").to_pylist()
        if cell < 0:
            return _passed(cell, rows)
        lists, g = [], []
        for r in rows:
            to, *both = unpack(r)
            g.append(int(to[0]))
            lists += [thick(x) for x in both]
        sizes = [len(x) for x in lists]
        h = np.concatenate(lists)
        of = np.repeat(np.arange(len(lists)), sizes)
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        first = _starts(h)
        many = np.diff(np.r_[first, len(h)])
        live = np.repeat((many > 1) & np.logical_or.reduceat(of % 2 == 0, first), many) if len(h) else np.empty(0, bool)
        h, of = h[live], of[live] // 2
        order, runs = runs_of(of, len(g))
        h = h[order]  # in order within each slice
        to, packed = [], []
        for r, i, j in runs:
            to.append(g[r])
            packed.append(pack(np.array([LIVE], "u1"), thin(h[i:j])))
        return pa.table({"g": pa.array(to, pa.int64()), "packed": pa.array(packed, pa.binary())})

    return run


def _extend(window: int, buckets: int):
    """A group of documents with its hits: hits grow to all windows around them, whose hashes go to the buckets
    for the smallest id; those of larger ids within a slice are decided here."""
    block = _anchor(window)

    def run(key: tuple, docs: pa.Table, hits: pa.Table) -> pa.Table:
        rows = hits.column("packed").to_pylist()
        live = [thick(unpack(r)[1]) for r in rows if unpack(r)[0][0] == LIVE]
        packed = [r for r in rows if unpack(r)[0][0] == DECIDED]
        g = key[0].as_py() if rows else 0
        cells = [-1 - g] * len(packed)
        live = np.unique(np.concatenate(live)) if live else np.empty(0, np.uint32)
        for t in texts_of(docs, window) if len(live) else ():
            near = np.zeros(t.n + 1, bool)
            at = np.flatnonzero(found(live, t.rolled(t.lo, block, _B).astype(np.uint32))[1] & (t.left >= block))
            for back in range(window - block + 1):  # a window may start so many places up to the hit
                b = at - back
                near[b[b >= 0]] = True
            least, hi, lo, gone = t.split_known(np.flatnonzero(near[: t.n] & (t.left >= window)))
            if len(gone):
                cells.append(-1 - g)
                packed.append(t.decided(gone))
            to = ((hi >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((least, to))
            _, runs = runs_of(to[order], buckets)
            for s, i, j in runs:
                o = order[i:j]
                d = t.doc[least[o]]
                first = _starts(d)
                ids = t.ids[d[first]]
                base = ids.min()
                cells.append(s)
                packed.append(pack(np.array([g, base], "<i8"), small(ids.view(np.uint64) - base.view(np.uint64)), small(t.ranks[d[first]]), small(np.diff(np.r_[first, len(o)])), small(t.place[least[o]]), hi[o], lo[o]))
        return pa.table({"cell": pa.array(cells, pa.int64()), "packed": pa.array(packed, pa.binary())})

    return run


def _decide():
    """A bucket of window hashes: windows whose sequence a smaller id holds too."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        cell, rows = key[0].as_py(), t.column("packed").to_pylist()
        if cell < 0:
            return _passed(cell, rows)
        parts = [unpack(r) for r in rows]
        ids = np.concatenate([(p[1].astype(np.uint64) + p[0][1:].view(np.uint64)).view(np.int64) for p in parts])
        of = np.repeat([int(p[0][0]) for p in parts], [len(p[1]) for p in parts])
        ranks, sizes, place = (np.concatenate([p[i].astype(np.int64) for p in parts]) for i in (2, 3, 4))
        hi, lo = (np.concatenate([p[i] for p in parts]) for i in (5, 6))
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((lo, hi))
        h, o, who = hi[order], lo[order], ids[doc[order]]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
        least = np.repeat(np.minimum.reduceat(who, first), np.diff(np.r_[first, len(h)]))
        gone = order[who > least]
        order = np.lexsort((place[gone], ranks[doc[gone]], of[doc[gone]]))
        d, p = doc[gone][order], place[gone][order]
        g, packed = [], []
        cut = _starts(of[d])
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(d)]):
            r = ranks[d[i:j]]
            start = _starts(r)
            g.append(int(of[d[i]]))
            packed.append(pack(np.array([DECIDED], "u1"), small(r[start]), small(np.diff(np.r_[start, j - i])), small(p[i:j])))
        return pa.table({"g": pa.array(g, pa.int64()), "packed": pa.array(packed, pa.binary())})

    return run


def _removed(window: int):
    def run(key: tuple, docs: pa.Table, decided: pa.Table) -> pa.Table:
        gone: dict[int, list[np.ndarray]] = {}
        for row in decided.column("packed").to_pylist():
            _, ranks, sizes, places = unpack(row)
            ends = np.cumsum(sizes.astype(np.int64)).tolist()
            for r, a, b in zip(ranks.tolist(), [0, *ends], ends):
                gone.setdefault(r, []).append(places[a:b])
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        for i, r, text in zip(docs.column("doc_id").to_pylist(), ranks_of(docs).tolist(), docs.column("text")):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            cut = np.zeros(len(words) + 1, np.int64)
            if r in gone:
                at = np.unique(np.concatenate([x.astype(np.int64) for x in gone[r]]))
                np.add.at(cut, at, 1)
                np.add.at(cut, at + window, -1)
                left = [w for w, c in zip(words, np.cumsum(cut).tolist()) if not c]
            else:
                left = words
            out["doc_id"].append(i)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(left))
            out["kept"].append(b" ".join(left))
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.binary())})

    return run


def _digested(run):
    def digest(key: tuple, docs: pa.Table, decided: pa.Table) -> pa.Table:
        t = run(key, docs, decided)
        sha = [hashlib.sha256(x.as_py()).hexdigest() for x in t.column("kept")]
        return t.drop_columns(["kept"]).append_column("kept_sha256", pa.array(sha, pa.string()))

    return digest


def _keyed(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array([text_key((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in b.column(1)], np.int64)
            ids = b.column(0)
            g = group_of(ids.fill_null(0).to_numpy(zero_copy_only=False), keys, groups)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), ids, pa.array(keys, pa.int64()), b.column(1)], names=["g", "doc_id", "key", "text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, digests: bool = False, per_bucket: int = 1_500_000, per_group: int = 8_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept: the words left, joined by single spaces, as UTF-8 bytes) of each row.

    A word goes if one of the `window`-word windows over it also starts in a document with a smaller id. Blocks of
    (window + 1) // 2 words at every multiple of that length are indexed; any window holds one of them whole, so
    probing the index with every rolling block finds all documents that share a window. Hits grow to the windows
    around them, and these are compared by 128-bit hashes. A passage that many documents hold is decided within
    each slice of a group of documents first; a slice hands on one row for each sequence, and no pairs are made.

    What is shuffled doesn't grow with the number of buckets to speak of: probes are hashes without documents, and
    a document of a group is a number in it.

    Rows with a null id neither remove nor lose words. Null and empty texts have no words. Rows that repeat an id
    don't remove each other's words; equal ones get equal results. Extra columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(1, -(-size // (6 * per_bucket))), max(1, -(-size // per_group))
    keyed = texts.mapInArrow(_keyed(groups), "g long, doc_id long, key long, text string")
    probes = keyed.groupBy("g").applyInArrow(_probe(window, buckets), "cell long, packed binary")
    hits = probes.groupBy("cell").applyInArrow(_hit(), "g long, packed binary")
    windows = keyed.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(_extend(window, buckets), "cell long, packed binary")
    decided = windows.groupBy("cell").applyInArrow(_decide(), "g long, packed binary")
    run = _removed(window)
    return keyed.groupBy("g").cogroup(decided.groupBy("g")).applyInArrow(_digested(run) if digests else run, f"doc_id long, n_words long, n_removed long, {'kept_sha256 string' if digests else 'kept binary'}")
