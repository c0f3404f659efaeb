"""Text to tables, chunks and folds that need a row at a time: Spark deals and sorts the rows, small helpers walk them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Units that a heading can name.
UNITS = {"元": 1.0, "千元": 1_000.0, "万元": 10_000.0, "百万元": 1_000_000.0, "亿元": 100_000_000.0}


def text_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line_no, line) of every line with something on it."""
    out = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return out.withColumn("line", F.trim("line")).where("line <> ''")


def table_rows(lines: DataFrame, id_col: str, heading: str, end: str) -> DataFrame:
    """Rows of the tables in documents: (id, line_no, section, label, numbers, scale). A line that matches `heading`
    starts a section and may name its unit, one that matches `end` closes it; within, a line of a label and numbers is a
    row. The state is the last heading, unit and end before a line: windows over one document's lines."""
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head, is_end = F.col("line").rlike(heading), F.col("line").rlike(end)
    unit = F.regexp_extract("line", "单位[:：]?(百万元|千元|万元|亿元|元)", 1)
    scale = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.when(unit != "", unit))
    state = lines.select(
        id_col, "line_no", "line", (is_head | is_end).alias("mark"),
        F.last(F.when(is_head | is_end, F.when(is_head, F.col("line")).otherwise("")), ignorenulls=True).over(w).alias("section"), F.last(scale, ignorenulls=True).over(w).alias("scale"),
    )
    numbers = F.transform(F.regexp_extract_all("line", F.lit(r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)(?![0-9%])")), lambda x: F.regexp_replace(x, ",", "").cast("double"))
    rows = state.where("section <> '' and not mark").select(id_col, "line_no", "section", F.trim(F.regexp_extract("line", r"^([^0-9-]+)", 1)).alias("label"), numbers.alias("numbers"), F.coalesce("scale", F.lit(1.0)).alias("scale"))
    return rows.where("label <> '' and size(numbers) > 0")


def filled_headers(headers: Column) -> Column:
    """Header cells with merged parents filled from the left: a blank cell has the name of the one before it."""
    step = lambda acc, h: F.concat(acc, F.array(F.when(F.trim(h) != "", h).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")))))
    return F.aggregate(headers, F.array().cast("array<string>"), step)


def utf8_chunks(docs: DataFrame, id_col: str, text: str, limit: int) -> DataFrame:
    """(id, chunk_no, chunk) of texts in chunks of at most `limit` UTF-8 bytes, cut between characters. A null text has
    no chunk, an empty one has one; a character longer than the limit stands alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1)):
                if not t.is_valid:
                    continue
                raw, start, out = t.as_py().encode(), 0, []
                while start < len(raw):
                    stop = min(start + limit, len(raw))
                    while stop < len(raw) and stop > start and raw[stop] & 0xC0 == 0x80:
                        stop -= 1
                    if stop == start:  # one character is longer
                        stop += 1
                        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                            stop += 1
                    out.append(raw[start:stop].decode())
                    start = stop
                out = out or [""]
                ids = pa.concat_arrays([b.column(0).slice(i, 1)] * len(out))
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(out)), pa.int32()), pa.array(out, pa.string())], names=[id_col, "chunk_no", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, chunk_no int, chunk string")


def decoded(docs: DataFrame, id_col: str, content: str, charset: str) -> DataFrame:
    """(id, text, charset) of bytes in the declared charset (its aliases too); an unknown or missing one, or bytes that
    don't fit, are read as UTF-8 with replacement marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, used = [], []
            for raw, name in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for n in (name, "utf-8"):
                    try:
                        texts.append(None if raw is None else raw.decode({"gb2312": "gb18030", "gbk": "gb18030"}.get((n or "").lower(), n or "?")))
                        used.append(n)
                        break
                    except (LookupError, UnicodeDecodeError):
                        continue
                else:
                    texts.append(raw.decode("utf-8", "replace"))
                    used.append("utf-8 with replacement")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(used, pa.string())], names=[id_col, "text", "charset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, content, charset).mapInArrow(run, f"{id_col} {kind}, text string, charset string")


TENURE = "company long, person long, role string, start_event long, start_at timestamp_ntz, end_at timestamp_ntz, status string"


def role_tenures(deltas: DataFrame, single: tuple[str, ...] = ("chair",)) -> DataFrame:
    """Tenures of a company's people out of its deltas (company, person, role, action, at, event_id) in their order.

    `appoint` and `acting` open a tenure; the same person and role open already is a renewal, which ends the old one.
    `dismiss` ends the tenure of its role; `resign` without a role ends the person's only open one, and is ambiguous with
    several: it closes none and marks them. Opening a role of `single` that another holds marks both as overlapping.
    Spark sorts each company's deltas within a partition; a task holds the open tenures of one company at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        company, open_ = None, {}
        names = [x.split(" ")[0] for x in TENURE.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.timestamp("us"), pa.timestamp("us"), pa.string()]

        def rows(tenures: list, end) -> list:
            return [(company, p, r, e, at, end, s) for (p, r), (e, at, s) in tenures]

        def made(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            done = []
            for c, person, role, action, at, event in zip(*(b.column(n).to_pylist() for n in ("company", "person", "role", "action", "at", "event_id"))):
                if c != company:
                    done += rows(list(open_.items()), None)
                    company, open_ = c, {}
                if action in ("appoint", "acting"):
                    if (person, role) in open_:
                        done += rows([((person, role), open_.pop((person, role)))], at)
                    state = "acting" if action == "acting" else "held"
                    if role in single and (others := [k for k in open_ if k[1] == role]):
                        state = "overlap"
                        for k in others:
                            open_[k] = (*open_[k][:2], "overlap")
                    open_[person, role] = (event, at, state)
                else:
                    mine = [k for k in open_ if k[0] == person and (role is None or k[1] == role)]
                    if len(mine) == 1:
                        done += rows([(mine[0], open_.pop(mine[0]))], at)
                    else:
                        for k in mine:
                            open_[k] = (*open_[k][:2], "ambiguous")
            yield made(done)
        yield made(rows(list(open_.items()), None))

    cols = ["company", "person", "role", "action", "at", "event_id"]
    return deltas.select(*cols).repartition("company").sortWithinPartitions("company", "at", "event_id").mapInArrow(run, TENURE)
