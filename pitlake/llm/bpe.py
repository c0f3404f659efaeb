"""Operator 10: BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame

from pitlake.llm.common import hashed_words, inverses, powers, with_text_columns

FIELDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string"}
DIGESTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
BLANKS = b"\x20\t\n\x0b\x0c\r"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_points(raw: bytes, window: int = 16, bits: int = 8) -> list[int]:
    """Content-defined cuts: after each byte where a rolling hash of the last `window` bytes ends in `bits` zero
    bits, moved on to the start of a code point. Equal passages get equal cuts wherever they stand."""
    x = np.frombuffer(raw, np.uint8)
    if len(x) <= window:
        return [len(raw)]
    p = np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers(len(x)), dtype=np.uint64)
    rolled = (p[window:] - p[:-window]) * inverses(len(x))[1 : len(x) - window + 1]
    hit = np.flatnonzero((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) == 0) + window + 1
    hit = hit[hit < len(x)]
    hit = hit[(x[hit] & 0xC0) != 0x80]
    return [*hit.tolist(), len(raw)]


_BREAK = re.compile(rb"(?<=[^\x09-\x0d\x20])[\x09-\x0d\x20]")


def break_after(raw: bytes, at: int) -> int:
    """The first place from `at` on where a blank follows another character; -1 if there is none."""
    found = _BREAK.search(raw, at)
    return found.start() if found else -1


def break_before(raw: bytes, stop: int) -> int:
    """The last such place before `stop`; -1 if there is none."""
    while (stop := max(raw.rfind(b" ", 0, stop), raw.rfind(b"\n", 0, stop))) > 0:
        if raw[stop - 1] not in BLANKS:
            return stop
    return -1


#: Splits of which no piece holds a blank: by name, or by the pattern of the pieces that are kept.
_WORDS = ("Whitespace", "WhitespaceSplit")
_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def drops_blanks(path: str) -> bool:
    """Whether the file surely drops white space before it merges, so that a text's ids are those of its words one
    after another: nothing in its normaliser, first split or added tokens reaches across a blank."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    blank_only = lambda n: n["type"] == "Replace" and (n["pattern"], n["content"]) == ({"Regex": r"\s+"}, " ")
    if not all(n["type"] in ("NFC", "Lowercase") or blank_only(n) for n in steps(spec["normalizer"], "normalizers")):
        return False
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"]):
        return False
    split = steps(spec["pre_tokenizer"], "pretokenizers")
    if not split or any(x.get("add_prefix_space") for x in split) or spec["post_processor"] is not None or spec["model"].get("dropout"):
        return False
    first = split[0]
    return first["type"] in _WORDS or first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in _PATTERNS


class Words:
    """Ids of words, for a file that drops white space: each distinct word is encoded once while the store holds it.
    A batch's distinct words come from 64-bit hashes, and all bytes are compared; where words of equal hash differ, a batch is
    encoded word by word. A store of more than `most` bytes starts afresh."""

    def __init__(self, ids_of: Callable[[list[bytes]], list[np.ndarray]], most: int = 32 << 20) -> None:
        self.ids_of, self.most = ids_of, most
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.size = 0
        self.flat, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.size > self.most:
            self.forget()
        where: list = []
        h, offsets = hashed_words(texts, where=where)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        raw, starts, ends = where
        if not same_words(raw, starts, ends, first[inverse]):
            return self.one_by_one(raw, starts, ends, offsets)
        words = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        known = np.array([self.index.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            found = self.ids_of(fresh)
            known[new] = np.arange(len(self.index), len(self.index) + len(new))
            self.index.update(zip(fresh, known[new].tolist()))
            self.at = np.r_[self.at, self.at[-1] + np.cumsum([len(x) for x in found])]
            self.flat = np.concatenate([self.flat, *found]).astype(np.uint32)
            self.size += sum(map(len, fresh)) + 4 * sum(map(len, found)) + 200 * len(fresh)
        word = known[inverse]
        sizes = self.at[word + 1] - self.at[word]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(self.at[word] - ends[:-1], sizes) + np.arange(ends[-1])]
        cut = ends[offsets]
        return [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def one_by_one(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        words = [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, self.ids_of(distinct)))
        return [np.concatenate([np.empty(0, np.uint32), *(ids[w] for w in words[i:j])]).astype(np.uint32) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def same_words(raw: bytes, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, block: int = 1 << 22) -> bool:
    """Whether each word has the same bytes as the word numbered `other`."""
    at = np.flatnonzero(other != np.arange(len(other)))
    a, b, sizes = starts[at], starts[other[at]], (ends - starts)[at]
    if not np.array_equal(sizes, (ends - starts)[other[at]]):
        return False
    eight = np.ndarray((len(raw),), "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    short = sizes <= 8
    mask = (np.uint64(1) << (8 * np.minimum(sizes[short], 7)).astype(np.uint64)) - np.uint64(1)
    mask[sizes[short] == 8] = np.uint64(0xFFFFFFFFFFFFFFFF)
    if ((eight[a[short]] ^ eight[b[short]]) & mask).any():
        return False
    a, b, sizes = a[~short], b[~short], sizes[~short]
    if not (np.array_equal(eight[a], eight[b]) and np.array_equal(eight[a + sizes - 8], eight[b + sizes - 8])):
        return False
    rest = sizes > 16  # the others' ends overlap
    a, b, sizes = a[rest] + 8, b[rest] + 8, sizes[rest] - 16
    x, stop = np.frombuffer(raw, np.uint8), np.cumsum(sizes)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + block)))
        n = sizes[i:j]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(x[np.repeat(a[i:j], n) + place], x[np.repeat(b[i:j], n) + place]):
            return False
        i = j
    return True


class ChunkEncoder:
    """Encodes texts from content-defined chunks, each distinct one encoded once and kept while the Python worker
    lives. The chunks' ids are joined by re-encoding what stands around each cut.

    A chunk counts between its first and its last break (a blank after another character). With a file that surely
    drops white space (see drops_blanks), this body's ids are those of its words, each encoded once; with any other,
    the whole chunk is encoded, and counts if it agrees with the encodings of its head and its tail. A join is all from the last break of one chunk to the
    first of a later one. It is encoded with a word of context on both sides, and must agree with the encodings of
    the three; if not, the context grows (2, 4 and 8 words), and at last the whole text is encoded. Chunks that do not
    agree become part of a join. `whole` counts the texts encoded as a whole.

    The stores are bounded (keep_mb of chunks, as much of joins, twice of words); a full one starts afresh, which costs
    time and changes nothing else.
    """

    def __init__(self, path: str, keep_mb: int = 32, bits: int = 10) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.most, self.bits, self.whole = keep_mb << 20, bits, 0
        self.kind = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.words = Words(self.ids_of, 2 * self.most) if drops_blanks(path) else None
        self.bodies: dict[bytes, tuple[int, int, np.ndarray] | None] = {}
        self.parts: dict[bytes, np.ndarray] = {}
        self.size = [0, 0]

    def ids_of(self, raws: list[bytes]) -> list[np.ndarray]:
        found = self.tok.encode_batch_fast([r.decode("utf-8", "surrogatepass") for r in raws], add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in found]

    def learn_parts(self, wanted: Iterable[bytes]) -> None:
        new = [p for p in dict.fromkeys(wanted) if p not in self.parts]
        for p, ids in zip(new, self.ids_of(new)):
            self.parts[p] = ids
            self.size[1] += len(p) + ids.nbytes + 200

    def learn_chunks(self, chunks: Iterable[bytes]) -> None:
        """For each new chunk its body's place and ids; None if it has none that agrees."""
        new = {}
        for c in chunks:
            if c not in self.bodies and c not in new:
                new[c] = (break_after(c, 0), break_before(c, len(c)))
        good = [c for c, (a, b) in new.items() if 0 < a < b]
        if self.words:
            found = dict(zip(good, self.words.encode([c[new[c][0] : new[c][1]] for c in good])))
            for c in new:
                self.bodies[c] = (*new[c], found[c].astype(self.kind)) if c in found else None
                self.size[0] += len(c) + (found[c].nbytes if c in found else 0) + 300
            return
        self.learn_parts(p for c in good for p in (c[: new[c][0]], c[new[c][1] :]))
        ids = dict(zip(good, self.ids_of(good)))
        for c, (a, b) in new.items():
            body = None
            if c in ids:
                head, tail, all_ = self.parts[c[:a]], self.parts[c[b:]], ids[c]
                i, j = len(head), len(all_) - len(tail)
                if i <= j and np.array_equal(all_[:i], head) and np.array_equal(all_[j:], tail):
                    body = (a, b, all_[i:j].copy())
            self.bodies[c] = body
            self.size[0] += len(c) + (body[2].nbytes if body else 0) + 300

    def agrees(self, before: bytes, join: bytes, after: bytes) -> bool:
        return np.array_equal(self.parts[before + join + after], np.concatenate([self.parts[x] for x in (before, join, after)]))

    def encode_all(self, raws: list[bytes]) -> list[np.ndarray]:
        for i, store in enumerate((self.bodies, self.parts)):
            if self.size[i] > self.most:
                store.clear()
                self.size[i] = 0
        cuts = {r: cut_points(r, bits=self.bits) for r in dict.fromkeys(raws)}
        self.learn_chunks(r[a:b] for r, cut in cuts.items() for a, b in zip([0, *cut], cut))
        plans = {}
        for r, cut in cuts.items():
            bodies = [(a + body[0], a + body[1], body[2]) for a, b in zip([0, *cut], cut) if (body := self.bodies[r[a:b]])]
            edges = [0, *(x for lo, hi, _ in bodies for x in (lo, hi)), len(r)]
            plans[r] = bodies, [(edges[i], edges[i + 1]) for i in range(0, len(edges), 2)]
        left = {r: [(*j, 1) for j in joins] for r, (bodies, joins) in plans.items() if bodies}
        whole = [r for r, (bodies, _) in plans.items() if not bodies]
        while left:
            checks = {r: [self.around(r, *j) for j in joins] for r, joins in left.items()}
            self.learn_parts(p for cs in checks.values() for c in cs for p in (*c, b"".join(c)))
            again = {}
            for r, cs in checks.items():
                wider = [(lo, hi, 2 * n) for (lo, hi, n), c in zip(left[r], cs) if not self.agrees(*c)]
                if any(n > 8 for *_, n in wider):
                    whole.append(r)
                elif wider:
                    again[r] = wider
            left = again
        out = dict(zip(whole, self.ids_of(whole)))
        self.whole += sum(len(plans[r][1]) > 1 for r in whole)
        for r, (bodies, joins) in plans.items():
            if r not in out:
                ids = [self.parts[r[joins[0][0] : joins[0][1]]]]
                for (_, _, body), (lo, hi) in zip(bodies, joins[1:]):
                    ids += [body, self.parts[r[lo:hi]]]
                out[r] = np.concatenate(ids)
        return [out[r].astype(np.uint32) for r in raws]

    @staticmethod
    def around(raw: bytes, lo: int, hi: int, words: int) -> tuple[bytes, bytes, bytes]:
        """A join with `words` words before and after it."""
        start, stop = lo, hi
        for _ in range(words):
            start = max(break_before(raw, start), 0) if start else 0
            stop = len(raw) if (to := break_after(raw, stop + 1)) < 0 else to
        return raw[start:lo], raw[lo:hi], raw[hi:stop]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


_coders: dict[str, ChunkEncoder] = {}


def coder(path: str) -> ChunkEncoder:
    """One encoder for each tokenizer file in each Python worker, whose stores outlive a task."""
    if path not in _coders:
        _coders[path] = ChunkEncoder(path)
    return _coders[path]


def encode(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Rows of docs with the token ids of the whole text and the text decoded from them (or their digests only).

    Equals the tokenizers library on the same file without added special tokens, whether the file keeps white space
    or not; with a file whose encodings of chunks do not agree with those of texts, texts are encoded as a whole. Rows
    keep their partition: no shuffle, so chunks are shared by the texts that one Python worker sees. Null and empty
    texts encode to no ids and decode to the empty string; repeated texts, chunks and joins are encoded once as long
    as the worker's stores hold them; columns named like a result are replaced.
    """
    path = tokenizer or default_tokenizer()

    def compute(raw: list[bytes], chunks: ChunkEncoder) -> dict[str, list]:
        ids = chunks.encode_all(raw)
        text = chunks.decode(ids)
        n = [len(x) for x in ids]
        if digests:
            return {"n_tokens": n, "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in text]}
        return {"n_tokens": n, "ids": [x.astype(np.int32) for x in ids], "decoded": text}

    return with_text_columns(docs, text_col, DIGESTS if digests else FIELDS, compute, keep, words_at_once=150_000, setup=lambda: coder(path))
