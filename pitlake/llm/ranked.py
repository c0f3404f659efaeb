"""Operator 13: ranked lexical search over an inverted treap for each term."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlake.llm.common import columns_after, slices, table
from pitlake.llm.packed import pack, small, unpack

#: Bytes of term characters as they are (A-Z in lower case), all others as blanks.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The term of a shard's row of documents; no term is empty.
DOCUMENTS = ""


def terms_of(raw: bytes, piece: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text in order, a list for each piece of it."""
    at = 0
    while at < len(raw):
        part = raw[at : at + piece].translate(_TERMS)
        if at + piece < len(raw):
            part = part[: part.rfind(b" ") + 1]
            while not part:  # a term longer than a piece
                piece *= 2
                part = raw[at : at + piece].translate(_TERMS)
                part = part[: part.rfind(b" ") + 1] if at + piece < len(raw) else part
        at += len(part)
        yield part.split()


@dataclass
class Index:
    """rows: (shard, term, size, treap), and for each shard a row of the term DOCUMENTS with the ids of its documents.
    n documents have a term, and they have `total` of them."""

    rows: DataFrame
    n: int
    total: int


def treap(impact: list[int]) -> tuple[list[int], list[int], int]:
    """Left and right children (place + 1; 0 if there is none) of each entry, and the root's place: a search tree by place
    and a heap by impact, built from left to right with the right spine on a stack."""
    left, right, spine = [0] * len(impact), [0] * len(impact), []
    for i, v in enumerate(impact):
        last = 0
        while spine and impact[spine[-1]] < v:
            last = spine.pop() + 1
        left[i] = last
        if spine:
            right[spine[-1]] = i + 1
        spine.append(i)
    return left, right, spine[0]


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 16_384, shard_mb: int = 24) -> Index:
    """An index of all terms of all documents, written to the shared folder.

    Documents are cut into shards of at most shard_docs documents or about shard_mb MB of text (a longer text is a shard of
    its own), so that a frequent term is a treap of bounded size in each shard. Within a shard, documents are numbered by
    id (null last); a term's treap holds its documents with their impacts, search order by number and heap order by
    impact. Texts are read twice: once to count, once to index; texts are never shuffled.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for _, _, raw in slices(b.column(0), 1 << 24):
                sizes = [sum(map(len, terms_of(t))) for t in raw]
                n, total = n + sum(s > 0 for s in sizes), total + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    found = pairs.select("text").mapInArrow(sums, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n_docs, total = found[0] or 0, found[1] or 0

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), count()
        held, size = Held(n_docs, total), 0
        for b in batches:
            for start, _, raw in slices(b.column(1), shard_mb << 20):
                ids = b.column(0).slice(start, len(raw)).to_pylist()
                for i, t in zip(ids, raw):
                    if held.ids and (len(held.ids) >= shard_docs or size + len(t) > shard_mb << 20):
                        yield from held.rows(task << 32 | next(number))
                        held, size = Held(n_docs, total), 0
                    held.add(i, t)
                    size += len(t)
        if held.ids:
            yield from held.rows(task << 32 | next(number))

    return Index(table(pairs.mapInArrow(shards, "shard long, term string, size int, treap binary"), "treaps"), n_docs, total)


class Held:
    """The documents of a shard that is being made."""

    def __init__(self, n_docs: int, total: int) -> None:
        self.n_docs, self.total = n_docs, total
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        seen: Counter = Counter()
        for part in terms_of(raw):
            seen.update(part)
        if seen:
            self.ids.append(doc_id)
            self.lengths.append(seen.total())
            self.terms.append(np.fromiter(map(self.index.__getitem__, seen), np.int64, len(seen)))
            self.counts.append(np.fromiter(seen.values(), np.int64, len(seen)))

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        null = np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, null))
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        sizes = [len(t) for t in self.terms]
        term, doc, tf = np.concatenate(self.terms), np.repeat(number, sizes), np.concatenate(self.counts)
        m = 50 + (50 * np.array(self.lengths, np.int64) * self.n_docs) // self.total
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes))
        at = np.lexsort((doc, term))
        doc, impact = doc[at], impact[at]
        ends = np.cumsum(np.bincount(term)).tolist()
        values, out, start = impact.tolist(), [], 0
        for stop in ends:
            left, right, root = treap(values[start:stop])
            out.append(pack(small(doc[start:stop]), small(impact[start:stop]), small(np.array(left)), small(np.array(right)), small(np.array([root]))))
            start = stop
        names, cuts = [t.decode() for t in self.index], np.diff([0, *ends]).tolist()
        names, cuts, out = [DOCUMENTS, *names], [len(ids), *cuts], [pack(ids[order], null[order].astype("u1")), *out]
        for i in range(0, len(names), 20_000):
            k = len(names[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int64()), pa.array(names[i : i + k], pa.string()), pa.array(cuts[i : i + k], pa.int32()), pa.array(out[i : i + k], pa.binary())], names=["shard", "term", "size", "treap"])


class Forest:
    """The treaps of some terms of one shard, one after another in common arrays."""

    def __init__(self, treaps: list[bytes], weights: list[int], n_docs: int) -> None:
        parts = [unpack(t) for t in treaps]
        sizes = np.array([len(p[0]) for p in parts], np.int64)
        base = np.cumsum(sizes) - sizes
        self.doc = np.concatenate([p[0].astype(np.int64) for p in parts])
        self.value = np.concatenate([p[1].astype(np.int64) * w for p, w in zip(parts, weights)])
        child = lambda k: np.concatenate([np.where(p[k] > 0, p[k].astype(np.int64) - 1 + b, -1) for p, b in zip(parts, base)])
        self.left, self.right = child(2), child(3)
        self.root = np.array([int(p[4][0]) + b for p, b in zip(parts, base)], np.int64)
        self.key = np.repeat(np.arange(len(parts)) * n_docs, sizes) + self.doc
        self.n_docs = n_docs

    def search(self, items: np.ndarray, terms: np.ndarray, n_items: int, k: int, leaf: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best (item, score, document) of each item; `items` and `terms` are the pairs of both, ordered by item.

        All items go down their terms' treaps together. A visit is an item and a range of documents, with the highest
        node of each treap within the range. Where the sum of these nodes, which nothing in the range exceeds, is below
        the item's k-th score so far, the range is left out. Otherwise the best node's document is scored and splits
        the range and the treaps in two; ranges of at most `leaf` documents are scored as they are.
        """
        best = (np.empty(0, np.int64),) * 3
        limit = np.ones(n_items, np.int64)  # a score has to be above 0
        visit_item, first = np.unique(items, return_index=True)
        low, high = np.full(len(visit_item), -1), np.full(len(visit_item), self.n_docs)
        visit, term, node = np.repeat(np.arange(len(visit_item)), np.diff(np.r_[first, len(items)])), terms, self.root[terms]
        while len(visit):
            start = np.flatnonzero(np.r_[True, visit[1:] != visit[:-1]])
            most = np.add.reduceat(self.value[node], start)
            go = most >= limit[visit_item[visit[start]]]
            small_ = go & (high[visit[start]] - low[visit[start]] - 1 <= leaf)
            which = np.zeros(len(visit_item), np.int8)
            which[visit[start]] = np.where(small_, 1, np.where(go, 2, 0))
            at = which[visit] == 1
            if at.any():
                best = self._kept(best, self._leaves(visit[at], term[at], visit_item, low, high, leaf), limit, k)
            at = which[visit] == 2
            visit, term, node = visit[at], term[at], node[at]
            if not len(visit):
                break
            start = np.flatnonzero(np.r_[True, visit[1:] != visit[:-1]])
            sizes = np.diff(np.r_[start, len(visit)])
            owner = visit[start]
            value = self.value[node]
            top = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, start), sizes))
            top = top[np.unique(visit[top], return_index=True)[1]]
            pivot = self.doc[node[top]]
            score, to_left, to_right = self._split(node, np.repeat(pivot, sizes), low[visit], high[visit])
            best = self._kept(best, (visit_item[owner], np.add.reduceat(score, start), pivot), limit, k)
            n = len(owner)
            back = np.repeat(np.arange(n), sizes)
            visit = np.r_[back, back + n]
            term, node = np.r_[term, term], np.r_[to_left, to_right]
            visit_item, low, high = np.r_[visit_item[owner], visit_item[owner]], np.r_[low[owner], pivot], np.r_[pivot, high[owner]]
            at = node >= 0
            visit, term, node = visit[at], term[at], node[at]
        return best

    def _split(self, node: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each treap gives to the pivot, and its highest nodes within (low, pivot) and (pivot, high); -1 if none."""
        score, to_left, to_right = np.zeros(len(node), np.int64), np.full(len(node), -1), np.full(len(node), -1)
        at, cur = np.arange(len(node)), node
        while len(at):
            doc = self.doc[cur]
            hit, less = doc == pivot[at], doc < pivot[at]
            score[at[hit]] = self.value[cur[hit]]
            first = less & (to_left[at] < 0) & (doc > low[at])
            to_left[at[first]] = cur[first]
            first = ~less & ~hit & (to_right[at] < 0) & (doc < high[at])
            to_right[at[first]] = cur[first]
            h = at[hit]
            to_left[h] = np.where(to_left[h] < 0, self._within(self.left[cur[hit]], low[h], self.right, np.less_equal), to_left[h])
            to_right[h] = np.where(to_right[h] < 0, self._within(self.right[cur[hit]], high[h], self.left, np.greater_equal), to_right[h])
            cur = np.where(less, self.right[cur], self.left[cur])
            more = ~hit & (cur >= 0)
            at, cur = at[more], cur[more]
        return score, to_left, to_right

    def _within(self, node: np.ndarray, edge: np.ndarray, child: np.ndarray, outside) -> np.ndarray:
        """Go down from nodes outside the edge to the highest one inside."""
        node = node.copy()
        while True:
            out = np.flatnonzero(node >= 0)
            out = out[outside(self.doc[node[out]], edge[out])]
            if not len(out):
                return node
            node[out] = child[node[out]]

    def _leaves(self, visit: np.ndarray, term: np.ndarray, visit_item: np.ndarray, low: np.ndarray, high: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all documents in small ranges: a treap's entries there stand side by side."""
        a = np.searchsorted(self.key, term * self.n_docs + low[visit] + 1)
        b = np.searchsorted(self.key, term * self.n_docs + high[visit])
        sizes = b - a
        ends = np.cumsum(sizes)
        entry = np.repeat(a - ends + sizes, sizes) + np.arange(ends[-1])
        owner = np.repeat(visit, sizes)
        cell = owner * (leaf + 1) + self.doc[entry] - low[owner]
        u, inverse = np.unique(cell, return_inverse=True)
        score = np.zeros(len(u), np.int64)
        np.add.at(score, inverse, self.value[entry])
        owner = u // (leaf + 1)
        return visit_item[owner], score, u % (leaf + 1) + low[owner]

    @staticmethod
    def _kept(best: tuple, more: tuple, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of both for each item, and the limit raised to the k-th score of those that have k."""
        good = more[1] >= limit[more[0]]
        item, score, doc = (np.r_[x, y[good]] for x, y in zip(best, more))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
        place = np.arange(len(item)) - np.repeat(start, np.diff(np.r_[start, len(item)]))
        full = place == k - 1
        limit[item[full]] = np.maximum(limit[item[full]], score[full])
        on = place < k
        return item[on], score[on], doc[on]


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 50, block: int = 256, broadcast_mb: int = 64, salts: int = 16) -> DataFrame:
    """(id_col, rank, doc_id, score): the k documents with the highest scores above 0 for each row of queries.

    Queries are asked in blocks of at most `block` rows; every shard that has a term of a block answers for it with
    its treaps of the block's terms, and the best k of each shard meet in one ranking. The table of asked terms is
    broadcast to the index if it is small, else joined with the hot terms' rows dealt over `salts`.
    Equal scores rank by doc_id (null last). Null and empty queries, and those of unknown terms, have no rows; repeated
    queries and repeated documents count row by row. Other columns of queries are not read.
    """
    spark = queries.sparkSession
    _, schema = columns_after(queries, [id_col], {"block": "long", "item": "int", "term": "string"})

    def asked_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), count()
        for b in batches:
            for start in range(0, b.num_rows, block):
                part, at = b.slice(start, block), task << 32 | next(number)
                terms = [sorted({w for x in terms_of((t or "").encode("utf-8", "surrogatepass")) for w in x}) for t in part.column(1).to_pylist()]
                row = pa.array([i for i, t in enumerate(terms) for _ in t], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array([at] * len(row), pa.int64()), row, pa.array([w.decode() for t in terms for w in t], pa.string())], names=schema.names)

    asked = table(queries.select(id_col, text_col).mapInArrow(asked_terms, schema), "asked-terms")
    terms = asked.select("term").distinct()
    held = index.rows.select("shard", "term", "size")
    df = held.join(F.broadcast(terms) if _small(asked, broadcast_mb) else terms, "term", "left_semi").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")
    wanted = asked.groupBy("term", "block").agg(F.sort_array(F.collect_list("item")).alias("items")).join(df.select("term", weight), "term").where("weight > 0")
    wanted = table(wanted.unionByName(asked.select("block").distinct().select(F.lit(DOCUMENTS).alias("term"), "block", F.expr("cast(array() as array<int>)").alias("items"), F.lit(0).cast("long").alias("weight"))), "wanted-terms")
    if _small(wanted, broadcast_mb):
        found = index.rows.join(F.broadcast(wanted), "term")
    else:
        found = index.rows.withColumn("salt", F.pmod(F.hash("shard"), F.lit(salts))).join(wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["term", "salt"])

    def answers(key: tuple, t: pa.Table) -> pa.Table:
        rows = [(x, y, z, w) for x, y, z, w in zip(*(t.column(c).to_pylist() for c in ("term", "items", "treap", "weight")))]
        ids, null = next(unpack(z) for x, _, z, _ in rows if x == DOCUMENTS)
        rows = sorted((r for r in rows if r[0] != DOCUMENTS), key=lambda r: r[0])
        item = score = doc = np.empty(0, np.int64)
        if rows:
            pair = np.array([(i, j) for j, r in enumerate(rows) for i in r[1]], np.int64)
            pair = pair[np.argsort(pair[:, 0], kind="stable")]
            item, score, doc = Forest([r[2] for r in rows], [r[3] for r in rows], len(ids)).search(pair[:, 0], pair[:, 1], int(pair[:, 0].max()) + 1, k)
        return pa.table({"block": pa.array([key[1].as_py()] * len(item), pa.int64()), "item": pa.array(item, pa.int32()), "doc_id": pa.array(ids[doc], pa.int64(), mask=null[doc].astype(bool)), "score": pa.array(score, pa.int64())})

    best = found.select("shard", "block", "term", "items", "weight", "treap").groupBy("shard", "block").applyInArrow(answers, "block long, item int, doc_id long, score long")
    w = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = asked.select("block", "item", id_col).distinct()
    return ranked.join(names, ["block", "item"]).select(id_col, "rank", "doc_id", "score")


def _small(df: DataFrame, mb: int) -> bool:
    """Whether the rows of df, a written table, surely take at most `mb` MB."""
    size = df.agg(F.sum(F.octet_length("term") + 40 + (4 * F.size("items") if "items" in df.columns else 0))).first()[0] or 0
    return size <= mb << 20
