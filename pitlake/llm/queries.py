"""The registered queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm import bpe, byte_bpe, crf, kneser_ney, lines, mixing, quality, ranked, simhash, spelling, substrings, vectors, warc
from pitlake.llm.common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), keep=["doc_id", "source"]).select("doc_id", "source", "epoch", "block", "slot", "place")


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), digests=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.languages(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    gone = lines.repeated_lines(docs)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines")
    found = docs.select("doc_id", F.xxhash64("text").alias("row"), n).join(gone, ["doc_id", "row"], "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), "removed")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_fraction", "longest_repeat")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kneser_ney.perplexity(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), keep=["doc_id"], digests=True)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir), keep=["doc_id"], digests=True)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_vectors": op2_vectors,
    "op3_substrings": op3_substrings,
    "op4_simhash": op4_simhash,
    "op5_languages": op5_languages,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_bpe": op10_bpe,
    "op11_spelling": op11_spelling,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_ranked_search": op13_ranked_search,
}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLES: dict[str, str] = {
    "op11_spelling": f"""
        WITH RECURSIVE table256 AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
        runs AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))")} AS run FROM documents),
        held AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
        raw AS (SELECT run, n, flatten(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM held),
        hashed AS (SELECT run, n, xor(list_reduce([4294967295] || CAST(bytes AS BIGINT[]), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM raw, table256),
        said AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places),
        pairs AS (SELECT a.word, b.word AS b, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
                  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
        near AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(b, (-n, b)) AS b FROM pairs GROUP BY word),
        forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN b END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM words w LEFT JOIN near USING (word)),
        paths AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT p.word, f.word, f.form FROM paths p JOIN forms f ON p.next = f.word)
        SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM forms f JOIN paths p ON p.word = f.word AND p.next IS NULL
    """,
    "op13_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
        f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
        s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
        w AS (SELECT term, CAST(floor(1000 * ln((2e0 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
        q AS (SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS terms FROM benchmark)),
        c AS (SELECT q.i, q.item_id, d.r, d.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.terms) * docs) // total)))) AS BIGINT) AS score
              FROM q JOIN w USING (term) JOIN f USING (term) JOIN d ON d.r = f.r, s GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 50
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        t AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN t USING (payload_digest)
    """,
}
