"""Operator 6: fuzzy line dedup."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import components, free_name, give_back, hashed_words, mix64, slices, table
from pitlake.llm.packed import batch as packed_batch
from pitlake.llm.packed import merged, pack, runs_of, small

COUNTERS = 22  # bits of a word's hash that say which counter it has
SALTS = 32  # shares of a group of lines in a join on the group
RARE, FREQUENT = 1, 42  # counter levels: up to RARE in no other line, from FREQUENT on in some 1200 or more
WIDE = (100, 200, 450, 900, 1800, 3600, 7200, 14400, 28800)  # words from which lines have sketches of twice the width
SHORT = (64, 80)  # words of lines: from the first on pairs of neighbours are blocks, up to the second all pairs


_ASCII = bytes(c if c > 127 or chr(c).islower() or c == 10 else c + 32 if chr(c).isupper() else 48 if chr(c).isdigit() else 32 for c in range(256))


def folded(raw: bytes) -> bytes:
    """A text of UTF-8 in lower case, digits as 0, with blanks for all but letters, digits and line ends."""
    if not raw.isascii():
        text = raw.decode("utf-8", "surrogatepass").lower()
        beyond = set(raw.translate(None, bytes(range(128))).decode("utf-8", "surrogatepass").lower())
        other = {c: "0" if c.isdecimal() else " " for c in beyond if c > "\x7f" and (c.isdecimal() or not c.isalnum())}
        if len(other) > 20:
            text = text.translate(str.maketrans(other))
        else:
            for c, as_ in other.items():
                text = text.replace(c, as_)
        raw = text.encode("utf-8", "surrogatepass")
    return raw.translate(_ASCII)


def normalised(raw: bytes) -> bytes:
    """The words of a line of UTF-8, one blank between: lower case, digits as 0, cut at anything but letters and digits."""
    return b" ".join(folded(raw).split())


def line_words(line: str) -> list[str]:
    return normalised(line.encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass").split()


def level(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of quarter octaves, in a byte: 0 and 1 stay as they are."""
    return np.minimum(np.floor(4 * np.log2(np.maximum(counts, 1))) + (counts > 0), 255).astype(np.uint8)


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, bit-parallel over the first."""
    if not a or not b:
        return len(a) or len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    last = 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(xh | up) & full, up & xh
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | ~(xv | plus) & full, plus & xv
    return score


def similar(p: list, q: list, least: float) -> bool:
    """Word edit similarity, 1 - distance / longer length, of at least `least`."""
    most = max(len(p), len(q))
    edits = int((1 - least) * most + 1e-9)
    if abs(len(p) - len(q)) > edits or len(set(p).difference(q)) > edits:
        return False
    i, stop = 0, min(len(p), len(q))
    while i < stop and p[i] == q[i]:
        i += 1
    j, stop = 0, stop - i
    while j < stop and p[-1 - j] == q[-1 - j]:
        j += 1
    p, q = p[i : len(p) - j], q[i : len(q) - j]
    if len(set(p)) < len(p) and (Counter(p) - Counter(q)).total() > edits:
        return False
    return edit_distance(p, q) <= edits


def word_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit word hashes of all lines one after another, and the lines' offsets."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint32, int(at[-1] - at[0]) // 4, int(at[0])) if at[-1] > at[0] else np.zeros(0, np.uint32)
    return flat, (at - at[0]) // 4


def _occurrences(min_words: int):
    """Each line with a word: where it is and its 128-bit digest; its word hashes where the task meets it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bytes] = {}  # the digest of a line's normal form; empty for lines that don't count
        for b in batches:
            for start, _, raws in slices(b.column(2), 2_000_000):
                if len(seen) > 400_000:
                    seen.clear()
                of, no, digests, new, norms = [], [], [], [], []
                for i, text in enumerate(raws, start):
                    for k, (raw, line) in enumerate(zip(text.split(b"\n"), folded(text).split(b"\n"))):
                        key = xxhash.xxh3_128_intdigest(raw)
                        if key in seen:
                            d, fresh = seen[key], False
                        else:
                            words = line.split()
                            fresh = bool(words) and len(words) >= min_words
                            d = b""
                            if fresh:
                                norm = b" ".join(words)
                                norms.append(norm)
                                d = xxhash.xxh3_128_digest(norm)
                            seen[key] = d
                        if d:
                            of.append(i), no.append(k), digests.append(d), new.append(fresh)
                flat, at = hashed_words(norms)
                flat = (flat >> np.uint64(32)).astype(np.uint32)
                ends = np.zeros(len(new) + 1, np.int32)
                ends[1:][new] = 4 * np.diff(at)
                rows = pa.array(of, pa.int64())
                hi, lo = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
                w = pa.Array.from_buffers(pa.binary(), len(new), [pa.array(new, pa.bool_()).buffers()[1], pa.py_buffer(np.cumsum(ends, dtype=np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(no, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), w], names=["doc_id", "row", "line_no", "hi", "lo", "w"])
        seen.clear()
        give_back()

    return run


def counted(df: DataFrame, slots_of: Callable[[pa.RecordBatch], np.ndarray], chunks: int = 256) -> np.ndarray:
    """How often the rows of df have each of 2 ** COUNTERS slots, on the scale of `level`. Each task's counters
    (up to 255) are cut into chunks that are summed by a group-by; the driver gets one byte a counter."""
    each = (1 << COUNTERS) // chunks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNTERS, np.int64)
        for b in batches:
            n += np.bincount(slots_of(b), minlength=len(n))
        n = np.minimum(n, 255).astype(np.uint8).reshape(chunks, each)
        have = np.flatnonzero(n.any(1))
        yield packed_batch(have.tolist(), [n[i].tobytes() for i in have])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        n = np.zeros(each, np.int64)
        for row in t.column("packed").to_pylist():
            n += np.frombuffer(row, np.uint8)
        return pa.table({"cell": [key[0].as_py()], "packed": pa.array([level(n).tobytes()], pa.binary())})

    out = np.zeros((chunks, each), np.uint8)
    for r in df.mapInArrow(count, "cell long, packed binary").groupBy("cell").applyInArrow(add, "cell long, packed binary").collect():
        out[r["cell"]] = np.frombuffer(r["packed"], np.uint8)
    return out.ravel()


def edits_of(n: np.ndarray, least: float) -> np.ndarray:
    """The edits that a similarity of `least` allows where the longer line has n words."""
    return np.floor((1 - least) * n + 1e-9).astype(np.int64)


def occurrence(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which occurrence in its line a word is, from 0. Lines are in order, equal words of a line side by side."""
    first, all_ = np.r_[True, (words[1:] != words[:-1]) | (own[1:] != own[:-1])][: len(words)], np.arange(len(words))
    return all_ - np.maximum.accumulate(np.where(first, all_, 0))


def sketches(words: np.ndarray, own: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For each bit of a line's sketch whether an odd number of its words falls on it; a word's second occurrence in a line
    is another word than its first. A sketch has 128 bits, and twice as many from each number of words in WIDE on: one
    array (a row a line) for each of these widths. Lines are in order, equal words of a line side by side."""
    nth = occurrence(words, own)
    h = mix64(words.astype(np.uint64) + np.uint64(1 << 34) + (nth.astype(np.uint64) << np.uint64(36)))
    kind = np.searchsorted(WIDE, n, "right")
    row, out = np.zeros(len(n), np.int64), []
    for i in range(len(WIDE) + 1):
        mine = kind == i
        if not mine.any():
            out.append(np.zeros((0, 2 << i), np.uint64))
            continue
        row[mine] = np.arange(mine.sum())
        of = np.flatnonzero(mine[own])
        lane = row[own[of]] << i + 1 | (h[of] >> np.uint64(6) & np.uint64((2 << i) - 1)).astype(np.int64)
        order = np.argsort(lane)
        s = np.zeros(int(mine.sum()) << i + 1, np.uint64)
        if len(of):
            lane = lane[order]
            first = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]])
            s[lane[first]] = np.bitwise_xor.reduceat(np.uint64(1) << (h[of][order] & np.uint64(63)), first)
        out.append(s.reshape(-1, 2 << i))
    return out


def keys_of(flat: np.ndarray, at: np.ndarray, levels: np.ndarray, least: float, frequent: int = FREQUENT, short: tuple[int, int] = SHORT) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(sketches of the lines; line, key of each block): see repeated_lines."""
    n = np.diff(at)
    line = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    grades = levels[flat >> (32 - COUNTERS)].astype(np.uint64)
    x = np.sort(line << np.uint64(40) | grades << np.uint64(32) | flat)
    sketch = sketches(x & np.uint64((1 << 32) - 1), line.astype(np.int64), n)
    x = x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
    own = (x >> np.uint64(40)).astype(np.int64)
    start = np.searchsorted(own, np.arange(len(n) + 1))
    place = np.arange(len(x)) - start[own]  # among the line's distinct words, the rarest first
    grade = (x >> np.uint64(32) & np.uint64(255)).astype(np.int64)
    word = x & np.uint64((1 << 32) - 1)
    edits = edits_of(n, least)
    few = np.diff(start) <= edits + 1  # one distinct word may be all that is left of such a line
    single = np.flatnonzero((grade > RARE) & (place <= edits[own]) & ((grade < frequent) | few[own]))
    of, key = [own[single]], [mix64(word[single] + np.uint64(1 << 33))]
    often = np.flatnonzero((grade >= frequent) & (place <= edits[own] + 1) & (n[own] <= short[1]))
    for shift in range(1, int(np.bincount(own[often], minlength=1).max())):
        one = np.flatnonzero(own[often[:-shift]] == own[often[shift:]])
        of.append(own[often[one]])
        key.append(mix64(mix64(word[often[one]]) + word[often[one + shift]]))
    rare = np.bincount(own[grade < frequent], minlength=len(n))
    wide = (n >= short[0]) & (rare <= edits)
    two = np.flatnonzero((line[1:] == line[:-1]) & wide[line[1:].astype(np.int64)] & (np.minimum(grades[1:], grades[:-1]) >= frequent))
    h = mix64(mix64(flat[two].astype(np.uint64)) + flat[two + 1]) >> np.uint64(32)
    x = np.sort(line[two] << np.uint64(41) | grades[two] + grades[two + 1] << np.uint64(32) | h)
    x = x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
    own_two = (x >> np.uint64(41)).astype(np.int64)
    place = np.arange(len(x)) - np.searchsorted(own_two, np.arange(len(n)))[own_two]
    lost = np.floor(2 * (1 - least) * n + 1e-8).astype(np.int64) - 2 * rare
    use = place <= lost[own_two]
    of.append(own_two[use])
    key.append(mix64((x[use] & np.uint64((1 << 32) - 1)) + np.uint64(1 << 35)))
    return sketch, np.concatenate(of), np.concatenate(key)


def similar_filter(n: np.ndarray, parts: list[np.ndarray], least: float, order: np.ndarray | None = None) -> tuple[Callable, Callable]:
    """(near, across). near(a, b): whether lines a and b (places in `order`) may be similar; loses no similar ones. across:
    a coarser choice from the pairs of two runs of lines. All but the edits of the longer
    line's words are in both, counted as often as they are in both, so the words that only one has are no more than the
    rest of both; each changes one bit of the sketches.
    Halves of a sketch, laid over each other, are the sketch of half its width, so those of lines of one length and more
    are compared at the width of the shortest."""
    kind = np.searchsorted(WIDE, n, "right").astype(np.int8)
    have, wide = [np.flatnonzero(kind >= i) if i else None for i in range(len(parts))], list(parts)
    for i in range(len(WIDE) - 1, -1, -1):
        wide[i] = np.zeros((int((kind >= i).sum()), 2 << i), np.uint64)
        mine = kind[kind >= i] == i
        wide[i][mine] = parts[i]
        wide[i][~mine] = wide[i + 1][:, : 2 << i] ^ wide[i + 1][:, 2 << i :]
    if order is not None:
        n, kind, wide[0] = n[order], kind[order], wide[0][order]
    lanes = []
    while wide:
        lanes.append(np.ascontiguousarray(wide.pop(0).T))

    def rows(i: int, at: np.ndarray) -> np.ndarray:
        """Where lanes[i] have lines, those of lanes[0] in `order`."""
        return np.searchsorted(have[i], at if order is None else order[at]) if i else at

    need = n - edits_of(n, least)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = n[a] + n[b] - 2 * np.maximum(need[a], need[b])
        ok = most >= np.abs(n[a] - n[b])
        on = np.flatnonzero(ok)
        for i in range(len(lanes)):
            if not len(on):
                break
            x, y = rows(i, a[on]), rows(i, b[on])
            bits = np.zeros(len(on), np.int64)
            for lane in lanes[i]:
                bits += np.bitwise_count(lane[x] ^ lane[y])
            ok[on] = bits <= most[on]
            on = on[ok[on]]
            on = on[np.minimum(kind[a[on]], kind[b[on]]) > i]
        return ok

    own, other = n.astype(np.int32), (n - 2 * need).astype(np.int32)

    def across(at: int, to: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a line from at to `to` and a later one from start to stop, in order of words."""
        i = int(kind[at])
        x, y, bits = rows(i, np.arange(at, to)), rows(i, np.arange(start, stop)), np.zeros((to - at, stop - start), np.uint8 if i == 0 else np.int32)
        for lane in lanes[i]:
            bits += np.bitwise_count(lane[x][:, None] ^ lane[y])
        a, b = np.divmod(np.flatnonzero(bits <= own[at:to, None] + other[start:stop]), stop - start)
        later = a + at < b + start
        return a[later] + at, b[later] + start

    return near, across


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(roots after the pairs a, b have joined trees; the pairs that did so, a spanning forest of them)."""
    left, right = [a[:0]], [b[:0]]
    while True:
        x, y = root[a], root[b]
        ok = x != y
        if not ok.any():
            return root, np.concatenate(left), np.concatenate(right)
        a, b = a[ok], b[ok]
        high, one = np.unique(np.maximum(x, y)[ok], return_index=True)
        root[high] = np.minimum(x, y)[ok][one]
        left.append(a[one])
        right.append(b[one])
        while not np.array_equal(up := root[root], root):
            root = up


def cell_links(k: np.ndarray, n: np.ndarray, near: Callable, across: Callable, least: float, dense_above: int, side: int = 64, at_once: int = 200_000, tile: tuple[int, int] = (128, 2048)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, root) of lines in order of (key, words): pairs of lines of one key that may be similar, all of them in cells
    of up to dense_above lines and a spanning forest of them in others; the roots of the latter's trees. Lines are
    compared as far as lengths allow: in cells of up to `side` lines those of all cells with the next, the next but one
    and so on, in larger ones tile by tile."""
    need = n - edits_of(n, least)
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[cut, len(k)])
    size, end = np.repeat(sizes, sizes), np.repeat(cut + sizes, sizes)
    none = [np.empty(0, np.int64)]
    root, left, right, wait_a, wait_b, waiting = np.arange(len(k)), [], [], [], [], 0

    def add(a: np.ndarray, b: np.ndarray, now: bool = False) -> None:
        """Pairs that may be similar: those of dense cells wait until many, or all, are joined at once."""
        nonlocal root, wait_a, wait_b, waiting
        dense = size[a] > dense_above
        left.append(a[~dense])
        right.append(b[~dense])
        wait_a.append(a[dense])
        wait_b.append(b[dense])
        waiting += len(wait_a[-1])
        if waiting > at_once or now:
            root, a, b = joined(root, np.concatenate(wait_a), np.concatenate(wait_b))
            left.append(a)
            right.append(b)
            wait_a, wait_b, waiting = [], [], 0

    at, shift = np.flatnonzero((size > 1) & (size <= side)), 1
    while len(at):
        at = at[at + shift < end[at]]
        at = at[need[at + shift] <= n[at]]
        a = at[root[at] != root[at + shift]]
        a = a[near(a, a + shift)]
        add(a, a + shift, not shift & shift - 1)
        shift += 1
    for start, stop in zip(cut[sizes > side].tolist(), (cut + sizes)[sizes > side].tolist()):
        for i in range(start, stop - 1, tile[0]):
            to = min(i + tile[0], stop)
            last = start + int(np.searchsorted(need[start:stop], n[to - 1], "right"))
            for j in range(i + 1, last, tile[1]):
                a, b = across(i, to, j, min(j + tile[1], last))
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
                ok = near(a, b)
                add(a[ok], b[ok])
    add(*none, *none, True)
    return np.concatenate(left + none), np.concatenate(right + none), root


def pieces(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of lines with about `most` words together: (start, stop, word hashes, offsets)."""
    flat, at = word_arrays(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield start, stop, flat[at[start] : at[stop]], at[start : stop + 1] - at[start]
        start = stop


def _deal(levels, least: float, frequent: int, short: tuple[int, int], buckets: int):
    none = np.zeros(0, "<u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for start, stop, flat, at in pieces(b.column(1)):
                sketch, of, key = keys_of(flat, at, levels.value, least, frequent, short)
                n, own, half = np.minimum(np.diff(at), (1 << 32) - 1).astype("<u4"), ids[start:stop], (key >> np.uint64(32)).astype("<u4")
                kind = np.searchsorted(WIDE, n, "right")
                row = [np.cumsum(kind == i) - 1 for i in range(len(sketch))]
                by_line = np.argsort(of, kind="stable")
                of, key, half = of[by_line], key[by_line], half[by_line]
                order, runs = runs_of(small(key % np.uint64(buckets)), buckets)
                of, half, runs = of[order], half[order], list(runs)
                new = np.r_[True, of[1:] != of[:-1]][: len(of)]
                new[[i for _, i, _ in runs]] = True
                first = np.flatnonzero(new)
                many, of = np.diff(np.r_[first, len(of)]), of[first]
                ends = np.searchsorted(first, [j for _, _, j in runs]).tolist()
                cells, packed, widths, was = [], [], [s if len(s) else None for s in sketch], 0
                for (cell, i, j), end in zip(runs, ends):
                    o = of[was:end]
                    k = kind[o]
                    cells.append(cell)
                    packed.append(pack(half[i:j], small(many[was:end]), own[o], *(none if s is None else s[row[w][o[k == w]]].ravel() for w, s in enumerate(widths)), small(n[o])))
                    was = end
                yield packed_batch(cells, packed)
        give_back()

    return run


def _meet(least: float, dense_above: int):
    """Pairs (a, b) of lines of one bucket that share a key and pass the filter. Of cells with more than dense_above
    lines a spanning forest of them, and the lines of each tree of three or more: (head, a)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        try:
            return meet(t)
        finally:
            give_back()

    def meet(t: pa.Table) -> pa.Table:
        k, many, ids, *parts, n = merged(t.column("packed").to_pylist())
        order = np.argsort(ids)
        order = order[np.argsort(n[order], kind="stable")]
        own, n = ids[order], n.astype(np.int64)
        new = np.r_[True, own[1:] != own[:-1]]
        place = np.empty(len(ids), np.uint64)
        place[order] = np.cumsum(new) - 1  # among the distinct lines, in order of words
        x = np.sort(k.astype(np.uint64) << np.uint64(32) | np.repeat(place, many))
        x = x[np.r_[True, x[1:] != x[:-1]]]
        k = x >> np.uint64(32)
        same = k[1:] == k[:-1]
        met = np.r_[False, same] | np.r_[same, False]
        k, line = k[met], order[new][(x[met] & np.uint64((1 << 32) - 1)).astype(np.int64)]
        del order, own, new, place, x, same, met, many
        near, across = similar_filter(n, [s.reshape(-1, 2 << i) for i, s in enumerate(parts)], least, line)
        del parts
        ids, n = ids[line], n[line]
        a, b, root = cell_links(k, n, near, across, least, dense_above)
        pair = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1), axis=0)
        d = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 2)
        tree = np.unique(np.stack([ids[root[d]], ids[d]], 1), axis=0)
        return pa.table({
            "a": np.r_[pair[:, 0], tree[:, 1]], "b": pa.concat_arrays([pa.array(pair[:, 1]), pa.nulls(len(tree), pa.int64())]),
            "head": pa.concat_arrays([pa.nulls(len(pair), pa.int64()), pa.array(tree[:, 0])]),
        })

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (c.to_pylist() for c in batch.columns[2:])
            ok = pa.array([i for i in range(len(p)) if similar(np.frombuffer(p[i], np.uint32).tolist(), np.frombuffer(q[i], np.uint32).tolist(), least)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok)], names=["a", "b"])

    return run


def _walk(least: float):
    """Verified links, as pairs of components, between the lines of one tree that are in different components so far.
    Each line outside the largest component meets the others once; components that a link joins are one from then on.
    A line's words, a second occurrence as another word, are marked, so that what it has in common with another is a
    look at the other's words: edits are no fewer than the words of the longer line that are not."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        root, w, known = t.column("root").to_numpy(), t.column("w"), {}
        flat, at = word_arrays(w.combine_chunks())
        n = np.diff(at)
        own = np.repeat(np.arange(len(n)), n)
        x = np.sort(own.astype(np.uint64) << np.uint64(32) | flat)
        x &= np.uint64((1 << 32) - 1)
        near, _ = similar_filter(n, sketches(x, own, n), least)
        _, ids = np.unique(x | occurrence(x, own).astype(np.uint64) << np.uint64(32), return_inverse=True)
        mine = np.zeros(int(ids.max(initial=-1)) + 1, bool)
        _, part, many = np.unique(root, return_inverse=True, return_counts=True)
        untried = np.ones(len(n), bool)

        def words(i: int) -> list:
            if i not in known:
                known[i] = np.frombuffer(w[i].as_py(), np.uint32).tolist()
            return known[i]

        ea, eb = [], []
        for i in np.flatnonzero(part != many.argmax()).tolist():
            untried[i] = False
            others = np.flatnonzero(untried & (part != part[i]))
            mine[ids[at[i] : at[i + 1]]] = True
            for j in others[near(np.full(len(others), i), others)].tolist():
                most = max(n[i], n[j])
                if part[j] != part[i] and most - np.count_nonzero(mine[ids[at[j] : at[j + 1]]]) <= edits_of(most, least) and similar(words(i), words(j), least):
                    ea.append(root[i]), eb.append(root[j])
                    part[part == part[j]] = part[i]
            mine[ids[at[i] : at[i + 1]]] = False
        return pa.table({"a": pa.array(ea, pa.int64()), "b": pa.array(eb, pa.int64())})

    return run


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, least: float = 0.8, frequent: int = FREQUENT, short: tuple[int, int] = SHORT, per_bucket: int = 1_500_000, dense_above: int = 2
) -> DataFrame:
    """(doc_id, row, removed: sorted array<int>) of documents with lines to remove; row is xxhash64 of the text. See
    dedup_lines.

    Links. At a similarity of `least` (0.6 at least), an edit script leaves all but a share of 1 - least of a line's words alone,
    so no more of its distinct words are missing in the other line. In one order of all words the first common one is
    among the first of both lines, as many as the edits allowed and one more, and the second common one within one
    place more (prefix filter). The order is by rarity, from 2 ** COUNTERS counters over all lines, which are broadcast.
    If the first common word is below level `frequent`, it is the block. Else all common words are frequent, and lines
    of up to short[1] words have the pairs of their first ones as blocks. Lines of short[0] words or more have pairs of
    neighbours, of which an edit takes two: the first ones in order, as many as the edits left by the line's rarer words can
    take and one more. Lines whose similarity may be in doubt are in both ways (short[0] <= least * short[1]), so each
    similar pair meets, and no line has more blocks than a fixed multiple of its words.

    A pair that meets goes on to the verification if lengths and sketches allow it, which all similar pairs do. Of cells
    with more than dense_above lines a spanning forest of such pairs goes on at first. Where its links fail, so that a
    tree's lines are not all in one component, they are verified against each other until no pair of them is left
    untried: one task holds the distinct lines of such a tree.
    """
    if least < 0.6 or not 20 <= short[0] <= least * short[1]:
        raise ValueError("least is 0.6 or more, and 20 <= short[0] <= least * short[1]")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    occ = table(texts.mapInArrow(_occurrences(min_words), "doc_id long, row long, line_no int, hi long, lo long, w binary"), "lines")
    words = occ.where("w is not null and octet_length(w) >= 20").select("hi", "w")  # shorter ones have no similar one
    levels = counted(words.select("w"), lambda b: word_arrays(b.column(0))[0] >> (32 - COUNTERS))
    n, size = words.agg(F.count("*"), F.sum(F.octet_length("w"))).first()
    buckets = max(1, -(-round(n + (1 - least) * (size or 0) / 4) // per_bucket))
    dealt = words.mapInArrow(_deal(spark.sparkContext.broadcast(levels), least, frequent, short, buckets), "cell long, packed binary")
    met = table(dealt.groupBy("cell").applyInArrow(_meet(least, dense_above), "a long, b long, head long"), "line-cells")
    pairs = met.where("b is not null").select("a", "b").distinct()

    def text_of(ids: DataFrame) -> DataFrame:
        """(hi, w) of the lines of ids (one column) and few others, by counters of the ids; dealt by hi, as both sides of
        a join on it need it."""
        top = lambda x: (x.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - COUNTERS)).astype(np.int64)
        wanted = spark.sparkContext.broadcast(counted(ids, lambda b: top(b.column(0))) > 0)

        def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(wanted.value[top(b.column(0))]))

        return words.mapInArrow(those, words.schema).dropDuplicates(["hi"])

    text = text_of(met.where("b is not null").select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.join(text.select(F.col("hi").alias("a"), F.col("w").alias("p")), "a").join(text.select(F.col("hi").alias("b"), F.col("w").alias("q")), "b")
    parts = components(both.select("a", "b", "p", "q").mapInArrow(_verify(least), "a long, b long"))
    trees = met.where("head is not null").select("head", F.col("a").alias("id")).distinct()
    trees = trees.join(parts, trees.id == parts.node, "left").select("head", "id", F.coalesce("root", "id").alias("root"))
    mixed = trees.groupBy("head").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("head")
    members = table(trees.join(mixed, "head"), "line-trees")
    walked = members.join(text_of(members.select("id")).withColumnRenamed("hi", "id"), "id").groupBy("head")
    more = table(walked.applyInArrow(_walk(least), "a long, b long"), "line-links")
    if not more.isEmpty():
        over = components(more).select(F.col("node").alias("was"), F.col("root").alias("now"))
        parts = table(parts.join(over, parts.root == over.was, "left").select("node", F.coalesce("now", "root").alias("root")).union(over), "line-parts")
    grouped = parts.union(parts.select("root", "root").distinct())
    lines = occ.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("first"), F.count("*").alias("n"))
    rooted = lines.join(grouped, lines.hi == grouped.node, "left").where("root is not null or n > 1")
    rooted = table(rooted.select("hi", "lo", "first", "root", F.pmod(F.xxhash64("hi"), F.lit(SALTS)).alias("salt")), "line-groups")
    keep = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("keep")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    kept = rooted.join(keep, ["root", "salt"], "left").select("hi", "lo", F.coalesce("keep", "first").alias("keep"))
    gone = occ.select("doc_id", "row", "line_no", "hi", "lo").join(kept, ["hi", "lo"]).where(F.struct("doc_id", "row", "line_no") != F.col("keep"))
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of docs with text_col without its repeated lines, and n_lines, n_removed (long).

    Lines are split at \\n and normalised (case, digits, punctuation). Lines link when their normalised forms are
    equal or their word edit similarity (1 - distance / words of the longer line) is at least `least` (0.8): the blocks
    of repeated_lines bring all such pairs together. Of each connected group the occurrence with
    the smallest (id, hash of the text, line number) stays and all others go. Lines of fewer than five words can only
    have equal ones. Lines without a letter or digit (empty ones) always stay, and so do those of fewer than
    min_words words. Equal normalised lines meet by a group-by and are never paired.

    Null texts stay null with 0 lines, empty ones have one line. Rows with a null id are left as they are. Rows with
    equal ids and texts count as one document: what is removed goes in each; rows with one id and different texts are
    documents of their own. Words are compared by 32-bit hashes, lines by 128-bit ones (64 bits for links). Input
    columns n_lines and n_removed are replaced; all others pass.
    """
    base = docs.drop("n_lines", "n_removed")
    gone = repeated_lines(docs, id_col, text_col, **how)
    names = {c: free_name(base, c) for c in ("row", "doc_id", "removed")}
    gone = gone.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = base.join(gone, (F.col(id_col) == F.col(names["doc_id"])) & (F.xxhash64(text_col) == F.col(names["row"])), "left").drop(names["row"], names["doc_id"])
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, m = [], [], []
            for text, removed in zip(b.column(at), b.column(b.num_columns - 1)):
                x, out = text.as_py(), removed.as_py()
                lines = [] if x is None else x.split("\n")
                if out:
                    drop = set(out)
                    x = "\n".join(line for i, line in enumerate(lines) if i not in drop)
                texts.append(x), n.append(len(lines)), m.append(len(out or ()))
            cols = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(m, pa.int64())]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(run, schema)
