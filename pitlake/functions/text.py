"""Text columns: markup, keys, rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags away, the five named entities unescaped, blanks single."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def content_id(*columns: str, prefix: str = "", digits: int = 64) -> Column:
    """A stable id of the values: each goes in with its length, so that no two rows of values read alike; a null differs
    from an empty text."""
    part = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("n"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[part(F.col(c).cast("string")) for c in columns]), 256), 1, digits))


def snippet(text: Column, word: str, around: int = 150) -> Column:
    """The text around the first place of word, whatever its case."""
    at = F.instr(F.lower(text), F.lit(word.lower()))
    return F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(word)))


def best_rule(title: Column, body: Column, rules: list[tuple[str, int, list[str], list[str], list[str]]]) -> Column:
    """(score, type) of the rule (type, priority, title, body and veto patterns) with the best score: 1000 a title
    match, 10 a body match, and the priority; a veto or no match rules it out; the earliest wins ties."""
    hits = lambda text, patterns: sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in patterns), F.lit(0))
    found = []
    for i, (name, priority, titles, bodies, vetoes) in enumerate(rules):
        n = 1000 * hits(title, titles) + 10 * hits(body, bodies)
        ok = (n > 0) & (hits(title, vetoes) == 0)
        found.append(F.when(ok, F.struct((n + priority).alias("score"), F.lit(-i).alias("_order"), F.lit(name).alias("type"))))
    return F.array_max(F.array(*found))
