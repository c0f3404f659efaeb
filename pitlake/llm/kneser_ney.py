"""Operator 9: interpolated modified Kneser-Ney n-gram model, counted in Spark, read from memory-mapped arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import by_cell, hashed_words, mix64, shared_dir, slices, table, with_text_columns
from pitlake.llm.packed import batch, found, mapped, merged, pack, put, runs_of, small, summed, unpack

START, END = np.uint64(1), np.uint64(2)
#: The words after which followers are dealt one by one: those with at least this many tokens, and this share of all tokens.
HOT_TOKENS, HOT_SHARE = 100_000, 1 / 65_536


def tokens(raw: list[bytes], order: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Word keys (64 bits) of all texts with an end after each, preceded by those of the order - 1 words before, the
    farthest first (a start before the first word); offsets of the texts."""
    words, at = hashed_words([b.lower() for b in raw])
    words = np.where(words < 16, words + np.uint64(16), words)
    at = at + np.arange(len(at))
    key = np.full(int(at[-1]), END, np.uint64)
    inside = np.ones(len(key), bool)
    inside[at[1:] - 1] = False
    key[inside] = words
    out = [key]
    for _ in range(order - 1):
        before = np.r_[START, out[0][:-1]]
        before[at[:-1]] = START
        out.insert(0, before)
    return out, at


def gram_key(words: list[np.ndarray]) -> np.ndarray:
    """The key of a sequence of words; that of one word is the word's own."""
    out = words[-1]
    for w in words[-2::-1]:
        out = mix64(w * np.uint64(0x9E3779B97F4A7C15) + out)
    return out


def shard_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((mix64(key) >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


def gram_shard(words: list[np.ndarray], hot: np.ndarray, n: int) -> np.ndarray:
    """The followers of a context share a shard; after a hot word they are dealt one by one."""
    if len(words) == 1:
        return shard_of(words[0], n)
    return shard_of(np.where(found(hot, words[-2])[1], gram_key(words), gram_key(words[:-1])), n)


def firsts(words: list[np.ndarray]) -> np.ndarray:
    """Where a sequence of words differs from the one before, in sorted columns of words."""
    if not len(words[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(words[0]), bool)
    new[0] = True
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    return np.flatnonzero(new)


def counted_grams(words: list[np.ndarray], count: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct sequences in order, and the sums of their counts (None: how often each occurs)."""
    order = np.lexsort(words[::-1])
    words = [w[order] for w in words]
    first = firsts(words)
    n = np.diff(np.r_[first, len(order)]) if count is None else np.add.reduceat(count[order], first) if len(first) else count
    return [w[first] for w in words], n


def packed_grams(words: list[np.ndarray], count: np.ndarray) -> bytes:
    """Sorted sequences as their contexts, each context's number of followers, followers and counts."""
    if len(words) == 1:
        return pack(words[0], small(count))
    start = firsts(words[:-1])
    return pack(*(w[start] for w in words[:-1]), small(np.diff(np.r_[start, len(count)])), words[-1], small(count))


def unpacked_grams(rows: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = []
    for row in rows:
        *ctx, follower, count = unpack(row)
        if ctx:
            *ctx, sizes = ctx
            ctx = [np.repeat(w, sizes.astype(np.int64)) for w in ctx]
        parts.append([*ctx, follower, count.astype(np.int64)])
    *words, count = (np.concatenate(x) for x in zip(*parts))
    return words, count


def dealt(words: list[np.ndarray], count: np.ndarray, hot: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    order, runs = runs_of(gram_shard(words, hot, shards), shards)
    return [(s, packed_grams([w[order[i:j]] for w in words], count[order[i:j]])) for s, i, j in runs]


@dataclass
class Model:
    """Where the arrays are, and the numbers that score a text with them."""

    path: str
    shards: int
    hot: np.ndarray
    tokens: int
    words: int
    discounts: list[list[float]]  # of sequences of 1, 2, ... words
    unigram_total: int
    unigram_rest: float


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from how many counts are 1, 2, 3 and 4. Where the estimate takes nothing off or more than the
    count, as small corpora can have it, half the count: every context leaves something to words it hasn't seen."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [d if 0 < d < i + 1 else (i + 1) / 2 for i, d in enumerate(out)]


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    """What stays of the counts; 0 stays 0."""
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def train(docs: DataFrame, text_col: str = "text", order: int = 2, per_shard: int = 2_000_000) -> Model:
    """Count words, sequences of `order` words (2 or more), what they continue and their contexts in all texts of docs,
    and write them as sorted arrays.

    Entries are summed in each task, then packed and dealt to shards by hash. One shard holds about per_shard
    tokens' sequences. Followers of a context that ends in a hot word are spread over all shards. A level's shards hand
    on its contexts, and the shorter sequences that its own continue, to the next stage: highest counts are raw, all
    others are numbers of distinct words before. The driver gets sums, and the hot words (at most 1 / HOT_SHARE of
    them).
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(1, -(-((size[0] or 0) // 6 + size[1]) // per_shard))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, raw in slices(b.column(0), 14_000_000):
                w, c = np.unique(tokens(raw, 1)[0][0], return_counts=True)
                at, runs = runs_of(shard_of(w, shards), shards)
                cut = [(s, pack(w[at[i:j]], small(c[at[i:j]]))) for s, i, j in runs]
                yield batch([s for s, _ in cut], [p for _, p in cut])

    def sum_words(key: tuple, t: pa.Table) -> pa.Table:
        w, c = summed(*merged(t.column("packed").to_pylist()))
        put(f"{path}/word-{key[0].as_py()}.key", w.tobytes())
        put(f"{path}/word-{key[0].as_py()}.count", c.astype("<u8").tobytes())
        big = c >= HOT_TOKENS
        return pa.table({"word": np.r_[w[big], 0].view(np.int64), "tokens": np.r_[c[big], c.sum()], "words": np.r_[np.zeros(big.sum(), np.int64), len(w)]})

    counted = table(by_cell(texts.mapInArrow(words, "cell long, packed binary"), shards).applyInArrow(sum_words, "word long, tokens long, words long"), "word-counts")
    total = counted.where("words > 0").agg(F.sum("tokens"), F.sum("words")).first()
    n, v = total[0] or 0, total[1] or 0
    hot = counted.where((F.col("words") == 0) & (F.col("tokens") >= n * HOT_SHARE)).select("word").collect()
    hot = np.sort(np.r_[np.array([r[0] for r in hot], np.int64).view(np.uint64), START])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, raw in slices(b.column(0), 14_000_000):
                cut = dealt(*counted_grams(tokens(raw, order)[0], None), hot, shards)
                yield batch([s for s, _ in cut], [p for _, p in cut])

    sums = "n1 long, n2 long, n3 long, n4 long, rows long"

    def written(level: int, shard: int, rows: list[bytes]) -> pa.Table:
        """The sums of one shard's sequences of `level` words, written as sorted arrays; what goes on to the next
        stage: contexts (even cells) and shorter sequences (odd ones)."""
        w, c = counted_grams(*unpacked_grams(rows))
        hashed = gram_key(w)
        at = np.argsort(hashed)
        put(f"{path}/gram{level}-{shard}.key", hashed[at].tobytes())
        put(f"{path}/gram{level}-{shard}.count", c[at].astype("<u8").tobytes())
        out = []
        if level > 1:
            ctx = summed(gram_key(w[:-1]), c, c == 1, c == 2, c >= 3)
            at, runs = runs_of(shard_of(ctx[0], shards), shards)
            out = [(2 * s, pack(ctx[0][at[i:j]], *(small(x[at[i:j]]) for x in ctx[1:]))) for s, i, j in runs]
            out += [(2 * s + 1, p) for s, p in dealt(*counted_grams(w[1:], None), hot, shards)]
        m, stats = len(out), {f"n{i}": int((c == i).sum()) for i in (1, 2, 3, 4)} | {"rows": len(c)}
        return pa.table({"cell": [x for x, _ in out] + [-1], "packed": pa.array([p for _, p in out] + [b""], pa.binary())} | {k: [0] * m + [x] for k, x in stats.items()})

    def contexts(level: int, shard: int, rows: list[bytes], d: list[float]) -> None:
        arrays = [np.concatenate(x) for x in zip(*map(unpack, rows))]
        ctx, c, one, two, more = summed(*arrays)
        put(f"{path}/context{level}-{shard}.key", ctx.tobytes())
        put(f"{path}/context{level}-{shard}.total", c.astype("<f8").tobytes())
        put(f"{path}/context{level}-{shard}.rest", ((d[0] * one + d[1] * two + d[2] * more) / c).astype("<f8").tobytes())

    def first(key: tuple, t: pa.Table) -> pa.Table:
        return written(order, key[0].as_py(), t.column("packed").to_pylist())

    def then(level: int, d: list[float]):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            shard, odd = divmod(key[0].as_py(), 2)
            rows = t.column("packed").to_pylist()
            if odd:
                return written(level, shard, rows)
            contexts(level + 1, shard, rows, d)
            return pa.table({"cell": pa.array([], pa.int64()), "packed": pa.array([], pa.binary())} | {k: pa.array([], pa.int64()) for k in ("n1", "n2", "n3", "n4", "rows")})

        return run

    out, found_sums = [], None
    stage = table(by_cell(texts.mapInArrow(grams, "cell long, packed binary"), shards).applyInArrow(first, f"cell long, packed binary, {sums}"), "gram-counts")
    for level in range(order, 0, -1):
        found_sums = stage.where("cell < 0").agg(*(F.sum(f"n{i}") for i in (1, 2, 3, 4)), F.sum("rows")).first()
        out.insert(0, discounts([x or 0 for x in found_sums[:4]]))
        if level == 2:
            pairs = found_sums[4] or 0
        if level > 1:
            stage = table(by_cell(stage.where("cell >= 0").select("cell", "packed"), 2 * shards).applyInArrow(then(level - 1, out[0]), f"cell long, packed binary, {sums}"), "gram-counts")
    n1, u = [x or 0 for x in found_sums], out[0]
    rest = (u[0] * n1[0] + u[1] * n1[1] + u[2] * (n1[4] - n1[0] - n1[1])) / pairs if pairs else 1.0
    return Model(path, shards, hot, n, v, out, pairs, rest)


class Arrays:
    """The model's arrays in one worker: mapped, never read whole."""

    def __init__(self, model: Model) -> None:
        self.m, self.open = model, {}

    def look_up(self, kind: str, shard: np.ndarray, key: np.ndarray, *fields: tuple[str, str]) -> list[np.ndarray]:
        """The fields' values for each key; zero where it isn't in its shard."""
        out = [np.zeros(len(key), np.dtype(k)) for _, k in fields]
        order = np.lexsort((key, shard))
        s = shard[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else []
        for i, j in zip(first, [*first[1:], len(s)]):
            o = order[i:j]
            at, ok = found(self.array(f"{kind}-{s[i]}.key", "<u8"), key[o])
            for x, (name, k) in zip(out, fields):
                x[o[ok]] = self.array(f"{kind}-{s[i]}.{name}", k)[at[ok]]
        return out

    def array(self, name: str, kind: str) -> np.ndarray:
        if name not in self.open:
            try:
                self.open[name] = mapped(f"{self.m.path}/{name}", kind)
            except FileNotFoundError:  # no entry has this shard
                self.open[name] = np.empty(0, np.dtype(kind))
        return self.open[name]

    def score(self, raw: list[bytes]) -> dict[str, list]:
        m = self.m
        words, at = tokens(raw, len(m.discounts))
        w, inverse = np.unique(words[-1], return_inverse=True)
        shard = shard_of(w, m.shards)
        (count,) = self.look_up("word", shard, w, ("count", "<u8"))
        (follows,) = self.look_up("gram1", shard, w, ("count", "<u8"))
        p = (discounted(follows.astype(np.int64), m.discounts[0]) / max(m.unigram_total, 1) + m.unigram_rest / (m.words + 1))[inverse]
        count = count.astype(np.int64)[inverse]
        for level in range(2, len(m.discounts) + 1):
            gram = words[-level:]
            c, back = np.unique(gram_key(gram[:-1]), return_inverse=True)
            total, rest = self.look_up(f"context{level}", shard_of(c, m.shards), c, ("total", "<f8"), ("rest", "<f8"))
            total, rest = total[back], rest[back]
            (n,) = self.look_up(f"gram{level}", gram_shard(gram, m.hot, m.shards), gram_key(gram), ("count", "<u8"))
            seen = total > 0
            p = np.where(seen, discounted(n.astype(np.int64), m.discounts[level - 1]) / np.where(seen, total, 1) + rest * p, p)
        sums = lambda x: np.add.reduceat(x, at[:-1]) if len(x) else x
        return {
            "n_tokens": np.diff(at), "n_known": sums((count > 0).astype(np.int64)), "train_tokens": [m.tokens] * len(raw),
            "base_score": sums(np.log10((count + 1) / (m.tokens + (m.words + 1)))), "score": sums(np.log10(p)),
        }


FIELDS = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with the log10 probability of the whole text under the model, and under add-one word counts.

    Perplexity is 10 ** (-score / n_tokens). Tokens are the lower-cased (A-Z) words and one end. Null and empty
    texts are one end. Repeated rows score alike; an empty table gives an empty result. A model of no texts gives
    each token probability 1. Input columns named like a result are replaced.
    """
    return with_text_columns(docs, text_col, FIELDS, lambda raw, arrays: arrays.score(raw), keep, setup=lambda: Arrays(model))


def held_out(id_col: str = "doc_id", of: int = 7, is_: int = 2) -> Column:
    """Whether crc32 of the id as text (null: empty) has remainder is_."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of == is_


def perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, order: int = 2) -> DataFrame:
    """Train on the documents that aren't held out, score all of them."""
    held = held_out(id_col).alias("held_out")
    model = train(docs.where(~held_out(id_col)), text_col, order)
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() != "held_out"]
    return score(docs.select(*dict.fromkeys([*cols, text_col]), held), model, text_col, [*cols, "held_out"])
