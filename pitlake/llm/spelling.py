"""Operator 11: spelling variants: words one edit apart, found by their rarest bigrams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import table

LETTERS = "[A-Za-zÀ-ÿ]"
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def counted_runs(doc_id: object, text: str, least: int, one_in: int, into: Counter, piece: int = 1 << 22) -> None:
    """Add the words of one text to `into`; long texts are read a piece at a time, cut behind a run."""
    start, seen = crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    rest, runs, at = re.compile(f"{LETTERS}+"), re.compile(f"{LETTERS}{{{least},}}"), 0
    while at < len(text):
        stop = min(at + piece, len(text))
        if stop < len(text) and (m := rest.match(text, stop)):
            stop = m.end()
        seen.update(runs.findall(text, at, stop))
        at = stop
    for run, n in seen.items():
        word = run.translate(_LOWER)
        h = crc32(word.encode(), start)
        if h % one_in == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
            if len(word) < least:
                continue
        into[word] += n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, seen: int = 2, one_in: int = 31, at_once: int = 400_000) -> DataFrame:
    """(word, n) of all words with at least `least` code points and `seen` occurrences. Each task sums its words before
    they are shuffled, so that a frequent word is a row or two of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                if t.is_valid:
                    counted_runs(i.as_py(), t.as_py(), least, one_in, total)
                if len(total) > at_once:
                    yield out()
                    total.clear()
        yield out()

    return docs.select(id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """All bigrams, the rarest first (ties by the bigram). There are at most as many as pairs of the alphabet: 90 * 90."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")).alias("g"))
    return {r.g: i for i, r in enumerate(grams.groupBy("g").count().orderBy("count", "g").collect())}


def rarest(words: DataFrame, order: dict[str, int], n: int = 3) -> DataFrame:
    """(word, n, p) with a row for each place p (from 0) of a word's n rarest bigrams; ties by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [[p for _, p in sorted((order[w[i : i + 2]], i) for i in range(len(w) - 1))[:n]] for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.list_(pa.int32()))], names=["word", "n", "p"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, p array<int>").select("word", "n", F.explode("p").alias("p"))


def join_keys(longer: int) -> Column:
    """Keys of a word (columns word, p) such that two words one edit apart have one in common: the shorter word has it
    among those for longer=0, the other among those for longer=1 (words of one length have it among both).

    Of two such words, all but two bigrams of each are the other's too, at the same place from the start (left of the
    edit) or from the end (right of it), and in the same order; so the first common bigram in the global order is among
    the three rarest of both. The edit stands in one third of the shorter word, of c code points; what is before and
    behind that third is equal. A key is the lengths, the equal parts, the bigram and its place, so that few words share
    one that aren't near; a bigram right of the edit isn't before its third, one left of it not behind.
    """
    size, p = F.char_length("word"), F.col("p")
    gram = F.substring("word", p + 1, 2)

    def third(c: Column, j: int) -> Column:
        return F.ceil(c * j / 3).cast("int")

    def key(kind: int, j: int, c: Column, behind: Column | None, place: Column) -> Column:
        return F.xxhash64(6 * c + 3 * kind + j, F.left("word", third(c, j)), F.lit("") if behind is None else F.right("word", behind), gram, place)

    keys, c = [key(0, j, size, size - third(size, j + 1), p) for j in range(3)], size - longer
    for j in range(3):
        behind = c - third(c, j + 1) + 1 if j < 2 else None
        left, right = key(1, j, c, behind, p), key(1, j, c, behind, p - size)
        keys += [F.when(p + 2 < third(c, j + 1), left) if j < 2 else left, F.when(p - longer >= third(c, j), right)]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, n): words one inserted, deleted or replaced code point apart, both ways, with the count n of b.

    Each word's three rarest bigrams go to a join on keys that hold the bigram and its place; Levenshtein distances decide.
    No pair of words is met twice in a key, and pairs that meet in several keys are made distinct."""
    places = table(rarest(words, bigram_order(words)), "rarest-bigrams")
    x, y = (places.select(F.explode(join_keys(longer)).alias("key"), F.col("word").alias(w), F.col("n").alias(f"n{w}")) for longer, w in ((0, "a"), (1, "b")))
    pairs = x.join(y, "key").where("(a < b or char_length(a) < char_length(b)) and levenshtein(a, b, 1) = 1").select("a", "b", "na", "nb").distinct()
    return pairs.select(F.explode(F.array(F.struct("a", "b", F.col("nb").alias("n")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("na").alias("n")))).alias("x")).select("x.*")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, seen: int = 2, one_in: int = 31, times: int = 10, rounds: int = 40) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of the corpus, the near word of largest n that it stands for if
    that is at least `times` as frequent, and the last word that following forms leads to.

    Null and empty texts have no words, a null id counts as empty text; repeated rows count as often as they stand
    there; of near words with equal n the smallest in code-point order is taken. Only id and text are read, so other
    columns can't clash. An empty table gives an empty result. `least` must be 4 or more: shorter words
    have no three bigrams. Counts grow at least tenfold along forms, so paths are short; they are followed by joins, a
    round for each doubling of their length.
    """
    if least < 4 or times < 2:
        raise ValueError("words need four code points, and forms twice the count")
    words = table(vocabulary(docs, id_col, text_col, least, seen, one_in), "vocabulary")
    best = F.min(F.struct((-F.col("n")).alias("less"), "b"))
    near = near_words(words).groupBy(F.col("a").alias("word")).agg(best["b"].alias("form"), F.max("n").alias("form_n"), F.count("*").alias("n_near"))
    is_form = F.col("form_n") >= times * F.col("n")
    found = table(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")),
        "word-forms",
    )
    paths = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        paths = table(paths.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        if not paths.where("moved").limit(1).count():
            break
        paths = paths.drop("moved")
    else:
        raise RuntimeError(f"forms did not end in {rounds} rounds")
    return found.join(paths.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
