"""Operator 5: language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import mix64, spans, with_text_columns

BITS = 18
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2 ** BITS, langs)
    change: np.ndarray  # (langs, langs): from, to
    first: np.ndarray  # (langs,)
    lexicon: dict[str, list[str]]  # word: the features it has from the sample's word lists


def plain(word: str) -> str:
    return word.strip(".,;:!?()[]{}\"'«»*#$%&|<>-_/\\0123456789").lower()


def features(words: list[str], lexicon: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed affix, character n-gram, whole-word and lexicon features: (index of the word, feature) pairs; none for
    a word without a letter. Two- and three-letter pieces of ^word$ include the affixes of one and two letters."""
    edged, of, listed, listed_of = [], [], [], []
    for i, word in enumerate(words):
        w = plain(word)
        if w.isalpha() or any(map(str.isalpha, w)):
            edged.append(f"^{w}$")
            of.append(i)
            found = lexicon.get(w, ["l?"])
            listed += found
            listed_of += [i] * len(found)
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer("".join(edged).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = spans([len(w) for w in edged])
    start, size, owner = at[:-1], np.diff(at), np.array(of)
    own = np.repeat(np.arange(len(of)), size)
    left = at[1:][own] - np.arange(len(c))  # letters from here to the word's end

    def pieces(k: int, where: np.ndarray) -> np.ndarray:
        h = np.full(len(where), k, np.uint64)
        for j in range(k):
            h = mix64(h ^ (c[where + j] << np.uint64(20)))
        return h

    out = [(owner, np.add.reduceat(mix64(c + ((np.arange(len(c)) - start[own]).astype(np.uint64) << np.uint64(32))), start))]
    for k in (2, 3):
        where = np.flatnonzero(left >= k)
        out.append((owner[own[where]], pieces(k, where)))
    for k in (4, 5):
        long = np.flatnonzero(size >= k)
        out += [(owner[long], pieces(k, start[long])), (owner[long], pieces(k, at[1:][long] - k))]
    crc = {f: (crc32(f.encode()) & 0xFFFFFF) << 40 for f in set(listed)}
    out.append((np.array(listed_of), np.array([crc[f] for f in listed], np.uint64)))
    ids = np.concatenate([h for _, h in out])
    return np.concatenate([o for o, _ in out]), (ids >> np.uint64(40) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def lexicons(words: list[tuple[str, int]], langs: int, least: int = 3) -> dict[str, list[str]]:
    """For words seen at least `least` times in the sample: which share of it each language has, in steps."""
    counts: dict[str, np.ndarray] = {}
    for w, lang in words:
        if (p := plain(w)) not in counts:
            counts[p] = np.zeros(langs)
        counts[p][lang] += 1
    return {w: [f"l{i}:{int(4 * s)}" for i, s in enumerate(c / c.sum()) if s > 0] for w, c in counts.items() if w and c.sum() >= least}


def marginals(e: np.ndarray, at: np.ndarray, change: np.ndarray, first: np.ndarray, block: int = 64, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every position of concatenated sequences, by forward-backward. The expected number of
    each pair of neighbouring labels is added to `pairs` (langs, langs), if given.

    Sequences are cut into blocks whose transfer products are taken side by side; then states pass from block to
    block, and at last inside all blocks side by side. The result is that of one pass from end to end.
    """
    n, langs = e.shape
    lengths = np.diff(at)
    blocks = -(-lengths // block)
    start = spans(blocks)
    total = int(start[-1])
    slot = np.repeat(start[:-1] * block - at[:-1], lengths) + np.arange(n)
    x = np.ones((total * block, langs))
    x[slot] = np.exp(e - e.max(1, keepdims=True)) + 1e-12
    real = np.zeros(total * block, bool)
    real[slot] = True
    x, real = x.reshape(total, block, langs), real.reshape(total, block)
    move = np.exp(change - change.max())
    heads = np.zeros(total, bool)
    heads[start[:-1][lengths > 0]] = True
    begin = np.exp(first - first.max())

    def step(v: np.ndarray, t: int) -> np.ndarray:
        """Rows v (blocks, k, langs) after position t."""
        moved = v @ move
        if t == 0:
            moved = np.where(heads[:, None, None], v, moved)
        out = moved * x[:, t, None, :]
        out = np.where(real[:, t, None, None], out, v)
        return out / out.max(axis=(1, 2), keepdims=True)

    product = np.broadcast_to(np.eye(langs), (total, langs, langs)).copy()
    for t in range(block):
        product = step(product, t)
    into = np.zeros((total, langs))
    back = np.ones((total, langs))
    order = np.argsort(-blocks, kind="stable")
    many = blocks[order]
    for j in range(int(blocks.max(initial=0))):
        s = start[order[: np.searchsorted(-many, -j, "left")]] + j
        v = np.broadcast_to(begin, (len(s), langs)) if j == 0 else np.einsum("bi,bij->bj", into[s - 1], product[s - 1])
        into[s] = v / v.max(1, keepdims=True)
    for j in range(int(blocks.max(initial=0)) - 2, -1, -1):
        s = start[order[: np.searchsorted(-many, -(j + 1), "left")]] + j
        v = np.einsum("bij,bj->bi", product[s + 1], back[s + 1])
        back[s] = v / v.max(1, keepdims=True)
    forward = np.empty_like(x)
    v = into[:, None, :]
    for t in range(block):
        v = step(v, t)
        forward[:, t] = v[:, 0]
    b = back
    for t in range(block - 1, -1, -1):
        if pairs is not None:
            both = real[:, t] if t else real[:, 0] & ~heads
            two = (forward[both, t - 1] if t else into[both])[:, :, None] * move * (b * x[:, t])[both, None, :]
            pairs += (two / two.sum((1, 2), keepdims=True)).sum(0)
        forward[:, t] *= b
        moved = (b * x[:, t]) @ move.T
        b = np.where(real[:, t, None], moved, b)
        b = b / b.max(1, keepdims=True)
    out = forward.reshape(-1, langs)[slot]
    return out / out.sum(1, keepdims=True)


def train(samples: list[tuple[str, int]], langs: list[str], epochs: int = 4, length: int = 40, batch: int = 32, rate: float = 0.3, seed: int = 1) -> Model:
    """Maximum likelihood by AdaGrad on sequences of words. A third of the sequences is joined from pieces of two
    languages, so that changes of language within a text are learned as well."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    rows = [(t.split(), lang) for t, lang in samples]
    lexicon = lexicons([(w, lang) for ws, lang in rows for w in ws], k)
    pieces = [(ws[i : i + length], lang) for ws, lang in rows for i in range(0, max(1, len(ws) - length // 2), length) if ws[i : i + length]]
    ids: dict[str, int] = {}
    coded = [(np.array([ids.setdefault(w, len(ids)) for w in ws]), lang) for ws, lang in pieces]
    of, flat = features(list(ids), lexicon)
    flat = flat[np.argsort(of, kind="stable")]
    at = spans(np.bincount(of, minlength=len(ids)))
    w, gw = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-3)
    change, first = np.eye(k) * 2.0, np.zeros(k)
    gc, g1 = np.full((k, k), 1.0), np.full(k, 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for i in range(0, len(order), batch):
            seqs = []
            for j in order[i : i + batch]:
                words, lang = coded[j]
                y = np.full(len(words), lang)
                if rng.random() < 1 / 3:
                    other, o = coded[rng.integers(len(coded))]
                    a, b = rng.integers(1, len(words) + 1), rng.integers(1, len(other) + 1)
                    words, y = np.r_[words[:a], other[:b]], np.r_[y[:a], np.full(b, o)]
                seqs.append((words, y))
            x, y = np.concatenate([s[0] for s in seqs]), np.concatenate([s[1] for s in seqs])
            sat = spans([len(s[0]) for s in seqs])
            u, inverse = np.unique(x, return_inverse=True)
            sizes = at[u + 1] - at[u]
            mine = flat[np.repeat(at[u] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
            own = np.repeat(np.arange(len(u)), sizes)
            e = np.zeros((len(u), k))
            np.add.at(e, own, w[mine])
            expected = np.zeros((k, k))
            p = marginals(e[inverse], sat, change, first, pairs=expected)
            off = p.copy()
            off[np.arange(len(y)), y] -= 1
            g = np.zeros((len(u), k))
            np.add.at(g, inverse, off)
            f, where = np.unique(mine, return_inverse=True)
            gf = np.zeros((len(f), k))
            np.add.at(gf, where, g[own])
            gf /= len(seqs)
            gw[f] += gf**2
            w[f] -= rate * gf / np.sqrt(gw[f])
            inside = np.ones(len(y), bool)
            inside[sat[:-1]] = False
            t = np.flatnonzero(inside)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[t - 1], y[t]), 1)
            gt = (expected - seen) / len(seqs)
            gc += gt**2
            change -= 0.1 * gt / np.sqrt(gc)
            g0 = off[sat[:-1]].sum(0) / len(seqs)
            g1 += g0**2
            first -= 0.1 * g0 / np.sqrt(g1)
    return Model(langs, w.astype(np.float32), change, first, lexicon)


class Labeller:
    """The model in one worker, with the word scores that it has made so far (bounded)."""

    def __init__(self, model: Model, most: int = 400_000) -> None:
        self.m, self.most = model, most
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.scores = np.zeros((1 << 12, len(self.m.langs)), np.float32)
        self.letters = np.zeros(1 << 12, bool)

    def learn(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            first, n = len(self.ids), len(part)
            self.ids.update(zip(part, range(first, first + n)))
            while first + n > len(self.letters):
                self.scores, self.letters = np.r_[self.scores, np.zeros_like(self.scores)], np.r_[self.letters, np.zeros_like(self.letters)]
            of, f = features([w.decode("utf-8", "surrogatepass") for w in part], self.m.lexicon)
            for i in range(len(self.m.langs)):
                self.scores[first : first + n, i] = np.bincount(of, self.m.weights[f, i], n)
            self.letters[first : first + n] = np.bincount(of, minlength=n) > 0

    def words_of(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = [b.split() for b in raw]
        if len(self.ids) > self.most:
            self.forget()
        self.learn(list(dict.fromkeys(w for ws in lists for w in ws if w not in self.ids)))
        at = spans([len(w) for w in lists])
        return np.fromiter((self.ids[w] for ws in lists for w in ws), np.int64, int(at[-1])), at

    def predict(self, raw: list[bytes]) -> dict[str, list]:
        x, at = self.words_of(raw)
        p = marginals(self.scores[x].astype(np.float64), at, self.m.change, self.m.first) if len(x) else np.zeros((0, len(self.m.langs)))
        letters = self.letters[x]
        doc = np.repeat(np.arange(len(raw)), np.diff(at))
        sums = np.stack([np.bincount(doc, p[:, i] * letters, len(raw)) for i in range(p.shape[1])], 1)
        n = np.bincount(doc, letters, len(raw))
        best = sums.argmax(1)
        share = sums[np.arange(len(raw)), best] / np.maximum(n, 1)
        return {"lang_pred": [self.m.langs[b] if c else UNKNOWN for b, c in zip(best, n)], "score": [float(min(max(s, 0.0), 1.0)) if c else 0.0 for s, c in zip(share, n)]}

    def words(self, raw: list[bytes]) -> dict[str, list]:
        """The words, and the most probable language of each (`und` for those without a letter)."""
        x, at = self.words_of(raw)
        best = marginals(self.scores[x].astype(np.float64), at, self.m.change, self.m.first).argmax(1) if len(x) else x
        names = np.where(self.letters[x], np.array(self.m.langs, object)[best], UNKNOWN) if len(x) else x
        return {"words": [[w.decode("utf-8", "replace") for w in b.split()] for b in raw], "word_langs": [list(names[a:b]) for a, b in zip(at, at[1:])]}


def held_out(id_col: str = "doc_id", of: int = 5) -> Column:
    """Whether crc32 of the id as text (null: empty) is divisible by `of`."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of == 0


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 6000, each_lang: int = 300, chars: int = 400, max_langs: int = 64) -> Model | None:
    """Train on a bounded sample of labelled texts: of each language its share of `sample`, at least each_lang if it
    has so many, and three stretches of `chars` characters of each text. None without labelled words.

    Texts are drawn by the hash of the whole text, below a threshold from the number of distinct texts of the
    language, so that tasks send only about what is drawn; equal texts of a language count once. More than max_langs
    languages are an error (the model has 2 ** BITS weights for each).
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("t"), F.col(lang_col).alias("y"), F.xxhash64(text_col).alias("h"))
    have = {r["y"]: max(r["n"], 1) for r in rows.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).limit(max_langs + 1).collect()}
    if len(have) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not have:
        return None
    langs, total = sorted(have), sum(have.values())
    want = {y: max(each_lang, round(sample * n / total)) for y, n in have.items()}
    rate = F.create_map(*[F.lit(x) for y in langs for x in (y, min(1.0, 1.2 * want[y] / have[y] + 1e-9))])
    drawn = rows.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < rate[F.col("y")]).dropDuplicates(["y", "h"])
    n = F.length("t")
    parts = [F.substring("t", F.greatest(F.lit(1), (n * s).cast("int") - chars).cast("int"), F.lit(chars)) for s in (0.0, 0.5, 1.0)]
    short = F.when(n <= 3 * chars, F.col("t")).otherwise(F.concat_ws(" ", *parts))
    found = sorted((r["h"], r["t"], r["y"]) for r in drawn.select(F.shiftrightunsigned("h", 11).alias("h"), short.alias("t"), "y").collect())
    taken: dict[str, int] = dict.fromkeys(langs, 0)
    samples = []
    for _, t, y in found:
        if taken[y] < want[y]:
            taken[y] += 1
            samples.append((t, langs.index(y)))
    return train(samples, langs)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with lang_pred and score: the language with the largest mean probability over the words with
    a letter, and that mean. Whole texts; no shuffle. The model (bounded: 2 ** BITS rows, and the sample's words) is
    broadcast.

    Words of any length count whole. Null texts and those without a letter get `und` and 0, and so do all without a model. Repeated rows get equal
    results. Input columns lang_pred and score are replaced.
    """
    kinds = {"lang_pred": "string", "score": "double"}
    if model is None:
        return docs.select(*[c for c in (keep or docs.columns) if c not in kinds], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_text_columns(docs, text_col, kinds, lambda raw, labeller: labeller.predict(raw), keep, words_at_once=200_000, setup=lambda: Labeller(shared.value))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learn from the labelled documents that aren't held out and predict all."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() != "held_out"]
    return identify(docs.select(*dict.fromkeys([*cols, text_col]), held_out(id_col).alias("held_out")), model, text_col, [*cols, "held_out"])


def label_words(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with `words` and `word_langs`: the language of each word of a text that may change its language
    on the way, by forward-backward over the whole text; `und` for words without a letter, and for all without a
    model. Null and empty texts have no words. Input columns of these names are replaced."""
    kinds = {"words": "array<string>", "word_langs": "array<string>"}
    model = model or Model([UNKNOWN], np.zeros((1 << BITS, 1), np.float32), np.zeros((1, 1)), np.zeros(1), {})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_text_columns(docs, text_col, kinds, lambda raw, labeller: labeller.words(raw), keep, words_at_once=200_000, setup=lambda: Labeller(shared.value))
