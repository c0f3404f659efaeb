"""Notes: the tables of one HTML page at a time, cell by cell. What grids finds by windows over rows of any source comes here
from one pass over whole pages, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pitlake.operators import grids

# The blanks of Java's \s; its $ also stands before a last line end, its dot for no line end, whichever it is.
_END = "(?=[\x85\u2028\u2029]?\\Z)"
_BLANKS, _EDGES = re.compile("[ \t\n\x0b\f\r\u00a0\u3000]+"), re.compile(f"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+{_END}")
_NUMBER = re.compile(rf"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{_END}")
_WORDS, _STARTS, _UNIT, _CURRENCY = (re.compile(x, re.A) for x in (grids.HEADER_WORDS, grids.CAPTION_STARTS, grids.UNIT, grids.CURRENCY))
_HEADING, _AMOUNT, _NO_TITLE = re.compile(r"([（(]\s*[0-9]+\s*[)）][.．、]?|[0-9]+[、．.])\s*", re.A), re.compile(r"[0-9][0-9,]*\.[0-9]{2}"), re.compile("[√□]|单位")
_TITLE_EDGES, _GROUP_EDGES = re.compile(f"^[：:。]+|[：:。]+{_END}"), re.compile(f"^[：:]+|[：:]+{_END}")
_PART, _GROUP, _OPENS = re.compile("[一二三四]+[、.]"), re.compile("^[一二三四五六七八九十]+[、.]"), re.compile(f"[一二三四五六七八九十]+[、.]|按[^\n\r\x85\u2028\u2029]+分类{_END}")
_ITEM, _INNER = re.compile("[0-9]+[.、．]"), re.compile("[（(][0-9]+[)）]")
_SHARE, _COUNT = re.compile("[%％]|比例|利率"), re.compile("股数|数量")
_LABELS, _GROUPS, _CAPTIONS = frozenset(grids.HEADER_LABELS), frozenset(grids.GROUP_LABELS), frozenset(grids.CAPTION_LINES)


def _compact(x: str) -> str:
    return _BLANKS.sub("", x) if _BLANKS.search(x) else x


@grids.remembered(1 << 14, 40)
def _cell(raw: str) -> tuple[str, str | None]:
    """(state, value) of a cell."""
    x = _compact(raw)
    n = x.replace(",", "").replace("，", "")
    if n == "":
        return "disclosed_blank", None
    if n in ("-", "—", "/", "不适用"):
        return "not_applicable_or_dash", None
    return ("ready", n.replace("+", "")) if _NUMBER.match(n) else ("disclosed_text", x)


@grids.remembered()
def _caption(before: str, fallback: str) -> str:
    """The heading nearest above a table."""
    lines, last = [x for line in before.split("\n") if (x := _EDGES.sub("", line).strip(" "))], None
    for i, x in enumerate(lines):
        if found := _HEADING.match(x):
            text = x[found.end() :] or (lines[i + 1] if i + 1 < len(lines) else "")
            last = text if text and not _NO_TITLE.match(text) else last
        elif x in _CAPTIONS or len(x) <= 65 and _STARTS.search(x) and not _AMOUNT.search(x):
            last = x
    return _TITLE_EDGES.sub("", fallback if last is None else _compact(last))


@grids.remembered()
def _money(before: str) -> tuple[str | None, str | None]:
    """The last unit and currency that a text names."""
    units, currencies = _UNIT.findall(before), _CURRENCY.findall(before)
    return units[-1] if units else None, grids.CURRENCIES[currencies[-1]] if currencies else None


def _is_header(row_no: int, texts: list[str]) -> bool:
    first, others = _compact(texts[0]), texts[1:]
    if row_no and (row_no > 3 or first and first not in _LABELS) or any(_cell(x)[0] == "ready" for x in others):
        return False
    return bool(row_no) or not _PART.match(first) and (first == "" or first in _LABELS or any(_WORDS.search(_compact(x)) for x in others))


@grids.remembered(64)
def _paths(head: tuple[tuple[str, ...], ...]) -> tuple[str, ...]:
    """One path for each column out of the header rows."""
    paths: list[list[str]] = [[] for _ in head[0]]
    for row in head:
        paths = [[*path, text] if (text := _compact(x)) and path[-1:] != [text] else path for path, x in zip(paths, row)]
    return tuple(" / ".join(x) for x in paths)


@grids.remembered(64)
def _columns(headers: tuple[str, ...], unit: str | None, currency: str | None) -> list[tuple[str, str, str | None]]:
    """(header, unit, currency) of the columns but the first."""
    out = []
    for x in headers[1:]:
        own = "%" if _SHARE.search(x) else "原表列单位" if _COUNT.search(x) else "原文未标单位" if unit is None else unit
        out.append((x, own, currency if own == unit != "股" else None))
    return out


def _tables(tables: list[tuple[int, str, list[tuple[int, list[str]]]]], title: str) -> Iterator[tuple]:
    """(table_no, section, headers, unit, currency, rows, broken) of the tables of a page; rows: (row_no, label, texts, issue)
    of the rows of note_rows, none where the header doesn't fit."""
    named_before = headers = unit = currency = None
    section, broken, group, item = None, False, "", ""
    for table_no, before, rows in tables:
        depth = 0
        while depth < len(rows) and _is_header(*rows[depth]):
            depth += 1
        own = _paths(tuple(tuple(x) for _, x in rows[:depth])) if depth else ()
        said = _caption(before, title)
        named = any(own)
        starts = named and not (own == named_before and said == title)
        if named:
            named_before = own
        if starts:
            headers, section, broken, group, item = own, said, False, "", ""
        broken = broken or not (starts or headers is not None and rows[0][0] == 0 and len(rows[0][1]) == len(headers))
        said_unit, said_currency = _money(before)
        unit, currency = said_unit or unit, said_currency or currency
        found, seen = [], set()
        for row_no, texts in rows if not broken else ():
            if row_no < depth:
                continue
            label, fits = _compact(texts[0]), len(texts) == len(headers)
            opens = label in _GROUPS or _OPENS.match(label)
            if fits and (opens or label == "") and not any(map(_compact, texts[1:])):
                if opens:
                    group, item = _GROUP_EDGES.sub("", _GROUP.sub("", label, count=1)), ""
                continue
            numbered = _ITEM.match(label)
            bare = label[numbered.end() :] if numbered else label
            if fits and numbered:
                item = bare
            inner = item != "" and _INNER.match(label)
            name = f"{item} / {label[inner.end():]}" if inner else bare
            name = f"{group} / {name}" if group else name
            again = (fits, name) in seen
            seen.add((fits, name))
            found.append((row_no, name, texts, "column_count_mismatch" if not fits else "row_label_missing" if label == "" else "repeated_row_label" if again else None))
        yield table_no, section, headers, unit, currency, found, broken


def _pages(pages: DataFrame, id_col: str, html: str, title: str, fields: dict[str, tuple[str, pa.DataType]], made: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The id of each page with what `made` finds in its tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b, of, out = whole.slice(at, 500), [], []
                for page, text in enumerate(b.column(1).to_pylist()):
                    tables = [(n, before, rows) for n, before, grid in grids.tables_of(text) if (rows := [(i, x) for i, x in enumerate(grid) if x])]
                    was = len(out)
                    for table in _tables(tables, title):
                        out.extend(made(*table))
                    of += [page] * (len(out) - was)
                columns = list(zip(*out)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int32())), *(pa.array(x, kind) for x, (_, kind) in zip(columns, fields.values()))], names=[b.schema.names[0], *fields])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html).mapInArrow(run, ", ".join([f"{id_col} {kind}", *(f"{k} {v}" for k, (v, _) in fields.items())]))


def html_cells(pages: DataFrame, id_col: str, html: str, title: str = "") -> DataFrame:
    """grids.note_cells of the tables in HTML, with its columns. Each page is a document of its own, also where ids are equal.
    Null and empty pages, and pages without tables, have no rows."""

    def made(table_no: int, section: str, headers: tuple, unit: str | None, currency: str | None, rows: list, broken: bool) -> Iterator[tuple]:
        columns = _columns(headers, unit, currency) if rows else ()
        for row_no, label, texts, issue in rows:
            if issue is None or issue == "repeated_row_label":
                for i, (raw, (header, own, money)) in enumerate(zip(texts[1:], columns), 2):
                    if header:
                        state, value = _cell(raw)
                        said = header + label
                        text = state == "disclosed_text"
                        yield table_no, row_no, i, section, label, header, value, state, "原文文字" if text else own, None if text else money, "期初" in said or "期末" in said

    number, text = ("int", pa.int32()), ("string", pa.string())
    fields = {"table_no": number, "row_no": number, "column_no": number, "section": text, "label": text, "header": text, "value": text, "state": text, "unit": text, "currency": text, "at_date": ("boolean", pa.bool_())}
    return _pages(pages, id_col, html, title, fields, made)


def html_issues(pages: DataFrame, id_col: str, html: str, title: str = "") -> DataFrame:
    """grids.note_issues of the tables in HTML: (id, table_no, issues). Pages as in html_cells."""

    def made(table_no: int, section: str, headers: tuple, unit: str | None, currency: str | None, rows: list, broken: bool) -> Iterator[tuple]:
        issues = {issue for *_, issue in rows if issue}
        if broken:
            issues.add("continuation_without_matching_header")
        elif "" in headers[1:] and any(issue in (None, "repeated_row_label") for *_, issue in rows):
            issues.add("column_header_missing")
        yield table_no, sorted(issues)

    return _pages(pages, id_col, html, title, {"table_no": ("int", pa.int32()), "issues": ("array<string>", pa.list_(pa.string()))}, made)
