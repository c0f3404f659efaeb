"""Operator 4: SimHash near-dedup over word shingles."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import components, hamming_links, table, with_text_columns


def majority(hashes: np.ndarray, lengths: list[int]) -> np.ndarray:
    """For each run of hashes: the 64 bits set in over half of them (no hashes: zero)."""
    out = np.zeros(len(lengths), np.uint64)
    start = 0
    for i, n in enumerate(lengths):
        if n:
            bits = np.unpackbits(hashes[start : start + n].view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
            ones = bits.sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
        start += n
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with fp (long): the SimHash of the text's word shingles under XXH64."""

    def compute(raw: list[bytes]) -> dict[str, list]:
        digest = xxhash.xxh64_intdigest
        out, lengths = [], []
        for b in raw:
            words = b.lower().split()
            text = b" ".join(words)
            if len(words) <= shingle:
                found = [digest(text, seed)] if words else []
            else:
                ends = np.cumsum([len(w) + 1 for w in words]).tolist()
                starts = [0, *ends]
                found = [digest(text[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :])]
            out.extend(found)
            lengths.append(len(found))
        return {"fp": majority(np.array(out, np.uint64), lengths).view(np.int64)}

    return with_text_columns(docs, text_col, {"fp": "long"}, compute, keep)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, blocks: int | None = None, **how) -> DataFrame:
    """(id, fp, component_id) of each row: component_id is the smallest id whose fingerprint can be reached over
    fingerprints that differ in at most max_bits bits.

    Equal fingerprints meet by a group-by, so copies are never paired. Distinct ones are mapped to the bit counts
    of 32 two-bit segments; a pair within max_bits has a Manhattan distance of at most max_bits there, so at least
    blocks - max_bits of `blocks` coordinate groups are equal: those grid cells are joined, then the Manhattan and
    the Hamming distance decide.

    Null and empty texts have fingerprint zero and link with each other (and with near fingerprints) like any
    others. Rows with a null id get a result but never name a component, unless no other row is in it (then null).
    Repeated rows stay, each with the same component. Extra columns are ignored.
    """
    fps = table(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), keep=["id"], **how), "simhash")
    distinct = table(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = hamming_links(distinct, distinct.count(), max_bits, blocks, embed="popcount")
    parts = components(links)
    roots = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(roots.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hexed(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
