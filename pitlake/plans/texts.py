"""Registered queries of texts: search over posting lists, decoding, stores of content."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from pitlake.operators import search, slots
from pitlake.operators.analytics import shared_dir
from pitlake.plans.queries import query
from pitlake.sources import content
from pitlake.sources.tables import read

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_ASKED = f"q AS (SELECT item_id, {_WORDS.format('text')}[3:5] AS ws FROM benchmark), d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents)"


def _queries(spark, sf_dir):
    """Three words out of each benchmark item."""
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(search.tokens(F.col("text")), 3, 3), " ").alias("words"))


@query(f"""WITH {_ASKED}, t AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS p FROM d), a AS (SELECT DISTINCT item_id, unnest(ws) AS term FROM q), n AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1),
  h AS (SELECT item_id, doc_id, count(DISTINCT term) AS k, count(*) AS n_hits, min(p) AS first FROM t JOIN a USING (term) GROUP BY ALL)
SELECT item_id, doc_id, n_hits, CAST(first AS INTEGER) AS first FROM h JOIN n USING (item_id) WHERE k = n""")
def word_search(spark, sf_dir):
    """Documents that hold all of three words, for each benchmark item."""
    docs = read(spark, sf_dir, "documents")
    return search.all_terms(search.posting_lists(docs, "doc_id", "text"), _queries(spark, sf_dir), "item_id", "words").select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "n_hits", "first")


@query(f"""WITH {_ASKED}, t AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS p FROM d), f AS (SELECT item_id, ws, doc_id, p FROM q JOIN t ON t.term = q.ws[1]),
  h AS (SELECT item_id, doc_id, count(*) AS n_hits, min(p) AS first FROM f JOIN d USING (doc_id) WHERE d.ws[p + 1 : p + len(f.ws)] = f.ws GROUP BY ALL)
SELECT item_id, doc_id, n_hits, CAST(first AS INTEGER) AS first, array_to_string(list_transform(ws[greatest(first - 4, 0) + 1 : greatest(first - 4, 0) + 24], lambda x, i: CASE WHEN i - 1 + greatest(first - 4, 0) = first THEN '[' || x || ']' ELSE x END), ' ') AS snippet FROM h JOIN d USING (doc_id)""")
def phrase_search(spark, sf_dir):
    """Documents in which three words of a benchmark item follow each other, with the words around them."""
    docs = read(spark, sf_dir, "documents")
    hits = search.phrases(search.posting_lists(docs, "doc_id", "text"), _queries(spark, sf_dir), "item_id", "words")
    return search.snippets(hits, docs, "doc_id", "text").select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "n_hits", "first", "snippet")


@query("SELECT doc_id, substr(text, 1, 300) AS snippet FROM documents WHERE contains(lower(text), '.\n')")
def pattern_search(spark, sf_dir):
    """The fallback for a pattern that is no word: a stop at the end of a line."""
    return search.containing(read(spark, sf_dir, "documents"), "doc_id", "text", ".\n")


def _encoded(spark, sf_dir):
    """The pages as bytes by language: French declares GB2312 and is GB18030, German declares nothing and is GB18030, Spanish declares
    what no one knows, English has a UTF-8 mark; a page without any of these is as it was."""

    def run(batches):
        for b in (part for whole in batches for part in content.pieces(whole, 1)):
            out = []
            for html in b.column(1).to_pylist():
                lang = re.search('lang="([a-z]+)"', html or "")
                meta = '<meta charset="utf-8">'
                match lang and lang[1]:
                    case "fr":
                        out.append(html.replace(meta, '<meta charset="GB2312">').encode("gb18030"))
                    case "de":
                        out.append(html.replace(meta, "").encode("gb18030"))
                    case "es":
                        out.append(html.replace(meta, "<meta charset=koi8-r>").encode())
                    case "en":
                        out.append(b"\xef\xbb\xbf" + html.encode())
                    case _:
                        out.append(None if html is None else html.encode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["page_id", "content"])

    return read(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, content binary")


_SEEN = """p AS (SELECT page_id, html, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages),
  t AS (SELECT page_id, lang, CASE lang WHEN 'fr' THEN replace(html, '<meta charset="utf-8">', '<meta charset="GB2312">') WHEN 'de' THEN replace(html, '<meta charset="utf-8">', '') ELSE html END AS text FROM p)"""


@query(f"""WITH {_SEEN} SELECT page_id, CASE WHEN lang <> 'es' THEN sha256(text) END AS text_sha256, CASE lang WHEN 'fr' THEN 'gb18030' WHEN 'de' THEN CASE WHEN octet_length(encode(text)) = length(text) THEN 'utf-8' ELSE 'gb18030' END WHEN 'es' THEN NULL WHEN 'en' THEN 'utf-8-sig' ELSE 'utf-8' END AS charset, CASE lang WHEN 'es' THEN 'unsupported_charset' ELSE 'decoded' END AS status FROM t""")
def sniffed_pages(spark, sf_dir):
    """Pages decoded by mark, declaration or trial, wrong declarations included."""
    found = content.decoded(_encoded(spark, sf_dir), "page_id", "content")
    return found.select("page_id", F.sha2("text", 256).alias("text_sha256"), "charset", "status")


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT -1 - doc_id, text FROM documents WHERE text IS NOT NULL), s AS (SELECT k, sha256(text) AS digest, octet_length(encode(text)) AS length FROM c), d AS (SELECT k, digest, length, k < 0 AND digest IN (SELECT digest FROM s WHERE k >= 0) AS reused FROM s)
SELECT CAST(k AS VARCHAR) AS name, digest, length, reused, 'good' AS state FROM d""")
def content_store(spark, sf_dir):
    """Texts of conversations, then of documents, put into a content-addressed store and read back: every blob once, every
    name's bytes hashed again."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    conversations = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"))
    documents = read(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"))
    found = content.archive(conversations, root).union(content.archive(documents, root))
    return found.join(content.verified(found, content.blobs(spark, root)).select("name", "state"), "name")


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'forged' WHEN l_shipdate > TIMESTAMP '2000-06-30' THEN 'future' WHEN l_discount = 0 THEN 'audit_only' END AS e FROM lineitem)
SELECT l_orderkey, count(*) FILTER (e IS NULL) AS n_items, count(e) AS n_excluded, CASE WHEN bool_or(e = 'forged') THEN 'forged' WHEN bool_or(e = 'future') THEN 'future' END AS blocked_by, count(*) FILTER (e IS NULL) > 0 AND NOT coalesce(bool_or(e IN ('forged', 'future')), false) AS passes FROM x GROUP BY 1""")
def evidence_gate(spark, sf_dir):
    """Evidence passes with an item that nothing excludes and no exclusion that blocks."""
    why = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), "forged").when(F.col("l_shipdate") > F.lit("2000-06-30").cast("timestamp_ntz"), "future").when(F.col("l_discount") == 0, "audit_only")
    return content.gate(read(spark, sf_dir, "lineitem"), "l_orderkey", why, ["forged", "future"])


_FIELDS = {"phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "card": "[0-9]{16}", "mail": r"[a-z0-9.]+@[a-z0-9.]+\.com", "secret": 'token = "[0-9a-f]{40}"', "word": "[Tt]h[a-z]+"}


@query(" UNION ALL ".join(f"""SELECT doc_id, '{n}' AS field, CAST(i - 1 AS INTEGER) AS nth, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, f[i] AS value FROM
  (SELECT doc_id, regexp_split_to_array(text, '{p}') AS b, regexp_extract_all(text, '{p}') AS f FROM documents), LATERAL (SELECT unnest(range(1, len(f) + 1)) AS i)""" for n, p in _FIELDS.items()))  # fmt: skip
def text_spans(spark, sf_dir):
    """Every phone number, address, card, mail, secret and word of a kind in the documents, with its place."""
    return slots.spans(read(spark, sf_dir, "documents"), "doc_id", "text", _FIELDS).select("doc_id", "field", "nth", "start", "value")


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'dividend' ELSE event_type END AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k < 10 THEN kind || ':case_number:' || 'no' || k WHEN k < 20 THEN kind || ':pledge_id:' || user_id WHEN k < 30 THEN kind || ':bond_code:b' || k WHEN kind = 'dividend' THEN 'dividend:2024:' || CASE WHEN value > 20 THEN '中期' WHEN value > 10 THEN '三季度' ELSE '年度' END END AS identity FROM e""")
def event_keys(spark, sf_dir):
    """Identities of events from the first of seven terms, else from the fiscal period that the text names."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.when(F.col("event_type") == "purchase", "dividend").otherwise(F.col("event_type"))
    terms = F.create_map(
        F.lit("bond_code"), F.when(F.col("k") < 30, F.concat(F.lit("B "), "k")), F.lit("pledge_id"), F.when(F.col("k") < 20, F.col("user_id").cast("string")).otherwise(""), F.lit("case_number"), F.when(F.col("k") < 10, F.concat(F.lit("No\t"), "k")),
    )
    said = F.concat(F.date_format("ts", "yyyy"), F.lit("年"), F.when(F.col("value") > 20, "半年度").when(F.col("value") > 10, "三季度").otherwise(""), F.lit("分红"))
    return e.select("event_id", slots.event_identity(kind, terms, said).alias("identity"))


_SLOTS = {"done": ("fact", "F"), "open": ("fact", "O"), "held": ("fact", "P"), "share": ("divide", "done", "total"), "total": ("add", "both", "held"), "both": ("add", "done", "open"), "gap": ("subtract", "done", "open"), "rest": ("divide", "gap", "held")}


@query("""WITH m AS (SELECT o_custkey AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS f, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS o, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P') AS DOUBLE) AS p FROM orders GROUP BY 1),
  s AS (SELECT c, unnest([{'slot': 'done', 'v': f, 'l': [f, NULL, NULL], 'u': [1, 0, 0]}, {'slot': 'open', 'v': o, 'l': NULL, 'u': [0, 1, 0]}, {'slot': 'held', 'v': p, 'l': NULL, 'u': [0, 0, 1]}, {'slot': 'both', 'v': f + o, 'l': NULL, 'u': [1, 1, 0]}, {'slot': 'total', 'v': f + o + p, 'l': NULL, 'u': [1, 1, 1]}, {'slot': 'share', 'v': f / (f + o + p), 'l': NULL, 'u': [1, 1, 1]}, {'slot': 'gap', 'v': f - o, 'l': NULL, 'u': [1, 1, 0]}, {'slot': 'rest', 'v': (f - o) / p, 'l': NULL, 'u': [1, 1, 1]}]) AS x, f, o, p FROM m)
SELECT c AS o_custkey, x.slot AS slot, CASE WHEN x.v IS NULL THEN 'missing' WHEN x.slot IN ('done', 'open', 'held') THEN 'present' ELSE 'derived' END AS state, round(x.v, 6) AS value, concat(CASE WHEN x.u[1] = 1 AND f IS NULL THEN 'F' END, CASE WHEN x.u[2] = 1 AND o IS NULL THEN 'O' END, CASE WHEN x.u[3] = 1 AND p IS NULL THEN 'P' END) AS lacks FROM s""")
def report_slots(spark, sf_dir):
    """A report's inputs from facts, derived in the order of their dependence where operands allow, else what they lack."""
    facts = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("metric"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    facts = facts.groupBy("o_custkey", "metric").agg(F.sum("value").cast("double").alias("value"))
    return slots.filled_slots(facts, "o_custkey", _SLOTS).select("o_custkey", "slot", "state", F.round("value", 6).alias("value"), F.array_join("lacks", "").alias("lacks"))
