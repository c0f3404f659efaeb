"""Full-text search: posting lists with positions as a table; terms, phrases and a plain pattern, with the text around the hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.operators.analytics import _cut


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order; none in a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def posting_lists(docs: DataFrame, id_col: str, text: str, path: str | None = None, files: int | None = None) -> DataFrame:
    """(term, id, positions) of all documents, written in the order of term and document: a query reads the row groups of its
    terms. Rows are dealt by ranges of both, so that a word of every document is spread over files. With a path the table
    stays there. Repeated ids are one document whose positions are all of theirs."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("words")).mapInArrow(_by_term, f"term string, id {kind}, positions array<int>")
    dealt = rows.repartitionByRange(files, "term", "id") if files else rows.repartitionByRange("term", "id")
    # Rows of one term and id are in one range: repeated ids meet without another shuffle.
    dealt = dealt.groupBy("term", "id").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")).sortWithinPartitions("term", "id")
    if path is None:
        return _cut(dealt)
    dealt.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(dealt.schema).parquet(path)


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, id, positions) of each row's words, so that what is shuffled are lists and not single words."""
    for whole in batches:
        for start in range(0, len(whole), 500):
            b = whole.slice(start, 500)
            words = b.column(1).flatten()
            if not len(words):
                continue
            n = np.diff(b.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(len(b)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            coded = words.dictionary_encode()
            key = row * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            ends = pa.array(np.r_[first, len(order)], pa.int32())
            at = order[first]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), b.column(0).take(pa.array(row[at])), pa.ListArray.from_arrays(ends, pa.array(place[order], pa.int32()))], names=["term", "id", "positions"])


def _asked(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), tokens(F.col(text)).alias("words")).where("size(words) > 0").select("query_id", F.size("words").alias("n_words"), F.posexplode("words").alias("offset", "term"))


def all_terms(postings: DataFrame, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, id, n_hits, first): documents that hold every word of a query anywhere, how often its words stand there and
    where the first does. A query without words finds nothing."""
    asked = _asked(queries, query_id, text).select("query_id", "term").distinct()
    need = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    hits = postings.join(asked, "term").groupBy("query_id", "id").agg(F.count("*").alias("n"), F.sum(F.size("positions")).alias("n_hits"), F.min(F.col("positions")[0]).alias("first"))
    return hits.join(need, "query_id").where("n = n_terms").select("query_id", "id", "n_hits", "first")


def phrases(postings: DataFrame, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, id, n_hits, first): documents in which the words of a query follow each other, how often and where first. Only
    documents with all words are looked at; a place counts if every word stands at its distance from it."""
    asked = _asked(queries, query_id, text)
    whole = all_terms(postings, queries, query_id, text).select("query_id", "id")
    starts = postings.join(asked, "term").join(whole, ["query_id", "id"], "left_semi").select("query_id", "id", "n_words", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start"))
    places = starts.groupBy("query_id", "id", "start").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words")).where("n = n_words")
    return places.groupBy("query_id", "id").agg(F.count("*").alias("n_hits"), F.min("start").alias("first"))


def containing(docs: DataFrame, id_col: str, text: str, pattern: str) -> DataFrame:
    """The fallback for patterns that aren't words: documents that hold the pattern as it stands, letters of either case, with their
    first 300 characters. An empty pattern finds nothing."""
    found = docs.where(F.lower(text).contains(pattern.lower()) & F.lit(pattern.strip() != ""))
    return found.select(id_col, F.substring(text, 1, 300).alias("snippet"))


def snippets(hits: DataFrame, docs: DataFrame, id_col: str, text: str, before: int = 4, length: int = 24) -> DataFrame:
    """hits with the words around the first one, which is in brackets."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("_text"))  # as they are: lists of words are twice as large
    start = F.greatest(F.col("first") - before, F.lit(0))
    near = F.slice(tokens(F.col("_text")), start + 1, F.lit(length))
    marked = F.transform(near, lambda x, i: F.when(i + start == F.col("first"), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    return hits.join(texts, "id").select(*hits.columns, F.array_join(marked, " ").alias("snippet"))
