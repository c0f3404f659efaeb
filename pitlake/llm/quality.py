"""Operator 7: quality rules, with suffix-array repetition."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from pitlake.llm.common import spans, with_text_columns

FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "repeat_fraction": "double", "longest_repeat": "long", "base_failed": "boolean", "kept": "boolean",
}
BLANKS = b"\x20\t\n\x0b\x0c\r"


class _Ids(dict):
    def __init__(self) -> None:
        self.next = count().__next__

    def __missing__(self, word: bytes) -> int:
        self[word] = out = self.next()
        return out


def longest_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position of concatenated token sequences: the length of the longest substring that starts
    there and also starts elsewhere in the same document.

    Suffix array by prefix doubling (only groups still tied are sorted again), then the common prefix of
    neighbours from the ranks of each doubling, largest step first.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, doc))
    new = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    levels, step = [rank.copy()], 1
    last = np.r_[np.flatnonzero(np.diff(doc)), n - 1]
    end = np.repeat(last + 1, np.diff(np.r_[-1, last]))
    while True:
        sizes = np.bincount(rank[:n], minlength=n)
        tied = np.flatnonzero(sizes[rank[:n]] > 1)
        if not len(tied):
            break
        ahead = tied + step
        after = np.where(ahead < end[tied], rank[np.minimum(ahead, n)], -1)
        by = np.lexsort((after, rank[tied]))
        t, r, a = tied[by], rank[tied][by], after[by]
        first = np.r_[True, r[1:] != r[:-1]]
        place = np.arange(len(t))
        start = np.maximum.accumulate(np.where(first, place, 0))
        again = np.maximum.accumulate(np.where(np.r_[True, (r[1:] != r[:-1]) | (a[1:] != a[:-1])], place, 0))
        rank[t] = r + again - start
        step *= 2
        levels.append(rank.copy())
    suffixes = np.empty(n, np.int64)
    suffixes[rank[:n]] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):  # all ranks of the last level differ
        x, y = np.minimum(a + lcp, n), np.minimum(b + lcp, n)
        lcp += np.where((levels[k][x] == levels[k][y]) & (x < n) & (y < n), 1 << k, 0)
    out = np.zeros(n, np.int64)
    out[a] = lcp
    out[b] = np.maximum(out[b], lcp)
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Positions inside the union of all repeated substrings of at least `least` tokens."""
    step = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(step, at, 1)
    np.add.at(step, at + longest[at], -1)
    return np.cumsum(step[:-1]) > 0


def dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    with_word = [x for x in lines if x.strip(BLANKS)]
    return len(with_word) - len(set(with_word))


def measure(min_words: int = 10, max_base_percent: int = 20, min_repeat: int = 8, max_fraction: float = 0.3, max_longest: int = 100):
    def compute(raw: list[bytes]) -> dict[str, list]:
        ids, lengths, chars, widths = _Ids(), [], [], []
        flat: list[int] = []
        for b in raw:
            words = b.split()
            lengths.append(len(words))
            flat.extend([ids[w] for w in words])
            chars.append(len(b.decode("utf-8", "surrogatepass")) - sum(map(b.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))))
        at = spans(lengths)
        doc = np.repeat(np.arange(len(raw)), lengths)
        longest = longest_repeats(np.asarray(flat, np.int64), doc)
        widths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in ids), np.int64, len(ids))
        width = widths[np.asarray(flat, np.int64)] if flat else np.zeros(0, np.int64)

        def total(x: np.ndarray) -> np.ndarray:
            s = np.r_[0, np.cumsum(x)]
            return s[at[1:]] - s[at[:-1]]

        n = np.asarray(lengths, np.int64)
        repeated = total(covered(longest, 5))
        fraction = total(width * covered(longest, min_repeat)) / np.maximum(chars, 1)
        most = np.zeros(len(raw), np.int64)
        np.maximum.at(most, doc, longest)
        failed = (n < min_words) | (100 * repeated > max_base_percent * n)
        kept = ~failed & (fraction <= max_fraction) & (most <= max_longest)
        return {
            "n_words": n, "word_chars": chars, "n_symbols": [len(b) - len(b.translate(None, b"#*$%&|<>")) for b in raw], "n_dup_lines": [dup_lines(b) for b in raw],
            "n_repeat_words": repeated, "repeat_fraction": fraction, "longest_repeat": most, "base_failed": failed, "kept": kept,
        }

    return compute


def quality_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, **limits) -> DataFrame:
    """Rows of docs with the measures of FIELDS; one row out for each row in, no shuffle.

    Words are runs of characters other than space and U+0009 to U+000D. Repeats are word sequences that occur
    twice or more in the text: repeat_fraction is the share of the words' characters inside repeats of at least
    min_repeat (8) words, longest_repeat the longest repeat in words. base_failed: under min_words (10) words, or
    over max_base_percent (20) percent of words in repeated 5-word windows. kept: not base_failed, fraction at
    most max_fraction (0.3) and longest at most max_longest (100).

    Null and empty texts have no words and fail. Repeated rows are judged alike, each by itself. An empty table
    gives an empty result. Input columns named like a measure are replaced; all others pass unchanged (or those
    in keep).
    """
    return with_text_columns(docs, text_col, FIELDS, measure(**limits), keep)
