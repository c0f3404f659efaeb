"""Operator 2: embedding near-dedup over inverted lists with product quantisation."""

from __future__ import annotations

import math
from dataclasses import dataclass
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import components, table


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, block: int = 1000) -> np.ndarray:
    """The nearest row of c for each row of x, `block` rows at a time."""
    return np.concatenate([squared(x[i : i + block], c).argmin(1) for i in range(0, len(x), block)])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)


@dataclass
class Index:
    lists: np.ndarray  # (lists, dim)
    books: list[np.ndarray]  # for each subspace: (words, its dim)
    cuts: list[int]

    def home(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's nearest list, and all lists whose side of the plane halfway between the two centres is within
        `reach` of it: a list's vectors lie on its side, so this is a lower bound of the distance to any of them."""
        d = squared(x, self.lists)
        home = d.argmin(1)
        apart = np.sqrt(squared(self.lists, self.lists))
        own = d[np.arange(len(x)), home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d - own[:, None]) / (2 * apart[home])
        plane[np.arange(len(x)), home] = 0
        return home, [np.flatnonzero(p <= reach + 1e-6) for p in np.where(np.isfinite(plane), plane, 0)]

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far what they stand for is from each row."""
        r = x - self.lists[home]
        out = np.empty((len(x), len(self.books)), np.uint8)
        off = np.zeros(len(x))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            d = squared(r[:, a:b], book)
            out[:, m] = d.argmin(1)
            off += d[np.arange(len(x)), out[:, m]]
        return out, np.sqrt(off)

    def distances(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of list `at`, from one table of partial distances a
        query and subspace."""
        r = q - self.lists[at]
        out = np.zeros((len(q), len(codes)))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            out += squared(r[:, a:b], book)[:, codes[:, m]]
        return np.sqrt(out)


def build(sample: np.ndarray, lists: int, parts: int, words: int) -> Index:
    centres = k_means(sample, min(lists, len(sample)))
    own = nearest(sample, centres)
    r = sample - centres[own]
    dim = sample.shape[1]
    cuts = [dim * i // parts for i in range(parts + 1)]
    return Index(centres, [k_means(r[:, a:b], min(words, len(r))) for a, b in zip(cuts, cuts[1:])], cuts)


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, and their unit vectors."""
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return raw, raw / np.sqrt((raw**2).sum(1, keepdims=True))


def _assign(index, near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                _, x = unit(part.column(3))
                home, probes = ix.home(x, near)
                codes, off = ix.codes(x, home)
                made = [pa.array(home, pa.int32()), pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=["rep", "copies", "label", "v", "home", "probes", "code", "off"])

    return run


class _Sets:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        r = self.roots()
        for x, y in np.unique(np.stack([r[a], r[b]], 1), axis=0).tolist():
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def _compare(index, least: float, reach: float):
    """A block of one list's members against a block of its queries: table distances first, then exact cosines.
    Gives each vector's links found here, and edges that span them."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ix, at = index.value, key[1].as_py()
        t = t.combine_chunks()
        member, query = (t.column(c).to_numpy() for c in ("member", "query"))
        rep, copies, home, off = (t.column(c).to_numpy() for c in ("rep", "copies", "home", "off"))
        raw, x = unit(t.column("v").chunk(0))
        norms = np.sqrt((raw**2).sum(1))
        m, q = np.flatnonzero(member), np.flatnonzero(query)
        out_rep, out_n, ea, eb = [], [], [], []
        if len(m) and len(q):
            codes = np.frombuffer(b"".join(t.column("code").take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), -1)
            probes = t.column("probes").take(pa.array(m)).to_pylist()
            width = max(map(len, probes))
            wide = np.full((len(m), width), -1)
            for i, p in enumerate(probes):
                wide[i, : len(p)] = p
            n = np.zeros(len(rep), np.int64)
            sets = _Sets(len(rep))
            step = max(1, min(256, 4_000_000 // len(m)))
            for i in range(0, len(q), step):
                part = q[i : i + step]
                a, b = np.nonzero(ix.distances(x[part], at, codes) <= reach + off[m][None, :] + 1e-6)
                for j in range(0, len(a), 200_000):
                    qa, mb = part[a[j : j + 200_000]], m[b[j : j + 200_000]]
                    own = b[j : j + 200_000]
                    cos = np.einsum("ij,ij->i", raw[qa], raw[mb]) / (norms[qa] * norms[mb])
                    ok = (cos >= least) & (rep[qa] != rep[mb])
                    same = home[qa] == at  # both directions are looked at in this list
                    twice = ~same & (wide[own] == home[qa][:, None]).any(1)  # seen in the query's list too
                    ok &= same | ~twice | (at < home[qa])
                    qa, mb, both = qa[ok], mb[ok], ~same[ok]
                    np.add.at(n, qa, copies[mb])
                    np.add.at(n, mb[both], copies[qa[both]])
                    sets.join(qa, mb)
            hit = np.flatnonzero(n)
            out_rep, out_n = rep[hit], n[hit]
            r = sets.roots()
            e = np.flatnonzero(r != np.arange(len(r)))
            ea, eb = rep[e], rep[r[e]]
        nothing = lambda k: pa.nulls(k, pa.int64())
        return pa.table({
            "rep": pa.concat_arrays([pa.array(out_rep, pa.int64()), nothing(len(ea))]), "n": pa.concat_arrays([pa.array(out_n, pa.int64()), nothing(len(ea))]),
            "a": pa.concat_arrays([nothing(len(out_rep)), pa.array(ea, pa.int64())]), "b": pa.concat_arrays([nothing(len(out_rep)), pa.array(eb, pa.int64())]),
        })

    return run


def _links(fit: DataFrame, n: int, dim: int, kind: str, least: float, sample: int, parts: int, words: int, margin: float | None, split_above: int) -> DataFrame:
    """Links (rep, n) of distinct vectors of one length, and edges (a, b) that span them; see near_duplicates."""
    spark = fit.sparkSession
    rate = 1.1 * sample / n + 1e-9  # drawn by hash, so that tasks send no more than about the sample
    drawn = fit.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < rate).select("h", "g", "rep", "v").collect()
    x = np.array([r["v"] for r in sorted(drawn)[:sample]] or fit.select("v").first()[:1], np.float64)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    index = spark.sparkContext.broadcast(build(x, max(1, min(len(x) // 8, math.isqrt(n))), min(parts, dim), words))
    reach = math.sqrt(2 - 2 * least)
    near = reach if margin is None else min(reach, margin * reach / math.sqrt(dim))
    label = fit.schema["label"].dataType.simpleString()
    placed = table(fit.select("rep", "copies", "label", "v").mapInArrow(_assign(index, near), f"rep long, copies long, label {label}, v {kind}, home int, probes array<int>, code binary, off double"), "placed")
    full = placed.select("label", F.explode("probes").alias("at")).groupBy("label", "at").count().where(F.col("count") > split_above)
    full = full.select("label", "at", F.ceil(F.col("count") / split_above).cast("int").alias("many"))
    shares = F.coalesce("many", F.lit(1))
    block = F.pmod(F.xxhash64("rep"), shares).cast("int")
    each = F.sequence(F.lit(0), shares - 1)

    def cell(members: Column, queries: Column, member: Column, query: Column) -> Column:
        return F.struct(members.alias("mi"), queries.alias("qi"), member.alias("member"), query.alias("query"))

    yes, no = F.lit(True), F.lit(False)
    probing = placed.withColumn("at", F.explode(F.filter("probes", lambda p: p != F.col("home")))).withColumns({"probes": F.lit(None).cast("array<int>"), "code": F.lit(None).cast("binary")})
    queries = probing.join(full, ["label", "at"], "left").withColumn("c", F.explode(F.transform(each, lambda i: cell(i, block, no, yes))))
    alike = F.concat(F.transform(each, lambda j: cell(block, j, yes, block == j)), F.transform(F.filter(each, lambda i: i != block), lambda i: cell(i, block, no, yes)))
    members = placed.withColumn("at", F.col("home")).join(full, ["label", "at"], "left").withColumn("c", F.explode(alike))
    cols = ["label", "at", "c.*", "rep", "copies", "v", "home", "probes", "code", "off"]
    both = members.select(*cols).union(queries.select(*cols))
    return table(both.groupBy("label", "at", "mi", "qi").applyInArrow(_compare(index, least, reach), "rep long, n long, a long, b long"), "vector-links")


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = 20_000, parts: int = 8, words: int = 256, margin: float | None = 1.5, split_above: int = 8000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: how many other vectors of its (non-null) label have a
    cosine of at least `least`, the smallest id reachable over such links, and whether that is its own.

    Equal vectors of a label are compared once and counted by their number. The index is fitted on the `sample`
    vectors with the smallest hashes; all vectors are in it. The number of lists follows the square root of the
    number of vectors, up to sample // 8 (2500), so that the index is bounded; from 6 million vectors on lists grow
    with the table unless sample does. A query probes its own list and those whose
    dividing plane is within `margin` * reach / sqrt(dimensions) of it, where reach is the distance at the cosine
    `least`: two vectors that far apart in a random direction differ by 1 / sqrt(dimensions) of that along the line
    between two centres. A pair is found if either of the two probes the other's list. margin=None takes the whole
    reach, which loses no pair but probes most lists in many dimensions. In the lists probed nothing is lost: table
    distances drop what the bound with the code's own error rules out, and exact cosines in double precision decide.
    A list with more than split_above queries is cut into blocks of members and of queries, each pair of them a task's group.

    Vectors of different lengths do not link; each length has an index of its own, one after another. Vectors that are
    null, empty, zero, or hold null or non-finite components, and those with a null label or id, link with nothing: 0
    links, their own component. Repeated rows are vectors of their own and link like copies; 0.0 and -0.0 are equal. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    plain = F.transform("v", lambda x: x + F.lit(0).cast(kind[6:-1]))  # no negative zeros
    hashed = base.where(usable).withColumn("v", plain).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    reps = table(hashed.groupBy("label", "h", "g").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    lengths = {r["d"]: r["n"] for r in reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    got = [_links(reps.where(F.size("v") == d), n, d, kind, least, sample, parts, words, margin, split_above) for d, n in sorted(lengths.items()) if n > 1]
    own = F.col("id").alias("component_id")
    known = reps.select("label", "h", "g", "rep", "copies")
    if got:
        links = reduce(DataFrame.union, got)
        roots = components(links.where("a is not null").select("a", "b"))
        known = known.join(links.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("far")), "rep", "left").join(roots, F.col("rep") == roots.node, "left")
    else:
        known = known.withColumns({"far": F.lit(0).cast("long"), "root": F.lit(None).cast("long")})
    known = known.select("label", "h", "g", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = hashed.select("id", "label", "h", "g").join(known, ["label", "h", "g"]).select("id", "n_links", "component_id")
    rest = base.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), own)
    return linked.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
