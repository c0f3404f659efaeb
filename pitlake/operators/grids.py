"""Tables of unknown shape in documents: cells out of HTML, header depth, merged headers, context of rows, typed cells."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First cells of header rows.
HEADER_LABELS = ["项目", "类别", "账龄", "单位名称", "名称", "合同分类", "种类", "被投资单位", "债权项目", "关联方", "公司名称", "债务人名称", "借款单位", "债券品种"]
#: What other cells of a header row say, captions, units, currencies, states.
HEADER_WORDS = "期初|期末|本期|上期|账面|金额|比例|余额|合计|房屋|土地|机器|软件|原值|原因"
CAPTION_STARTS = "^(收到|支付|取得|处置|购建|偿还|筹资活动产生|经营活动产生|投资活动产生|其他说明|按账龄披露|按坏账|按组合|本期实际核销)"
CAPTION_LINES = ["项目列示", "应付股利", "应付利息", "应收股利", "应收利息", "工程物资"]
UNIT = r"单位\s*[：:]\s*(亿元|万元|千元|元|股)"
CURRENCY = r"币种\s*[：:]\s*(人民币|美元|港币|港元|欧元)"
CURRENCIES = {"人民币": "CNY", "美元": "USD", "港币": "HKD", "港元": "HKD", "欧元": "EUR"}
GROUP_LABELS = ["其中：", "其中:", "商品类型"]

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def compact(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s\u00A0\u3000]+", "")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is evaluated once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def remembered(most: int = 1 << 12, longest: int = 500) -> Callable[[Callable], Callable]:
    """A function of a text, or of a tuple first, that keeps its last results for short ones."""

    def of(f: Callable) -> Callable:
        kept = lru_cache(most)(f)
        return wraps(f)(lambda x, *more: kept(x, *more) if len(x) <= longest else f(x, *more))

    return of


def plain_text(x: Column) -> Column:
    """HTML without tags, named and numeric entities decoded; &amp; last, so that nothing is decoded twice."""

    def entities(text: Column) -> Column:
        out = let(text, lambda t: _decoded(t, "&#([0-9]{1,6});", "&#", 10))
        out = let(out, lambda t: _decoded(t, "&#x([0-9A-Fa-f]{1,5});", "&#x", 16))
        for name, c in ENTITIES.items():
            out = F.replace(out, F.lit(name), F.lit(c))
        return out

    return let(F.regexp_replace(x, "(?s)<[^>]*>", ""), lambda t: F.when(t.contains("&"), entities(t)).otherwise(t))


def _decoded(text: Column, pattern: str, opens: str, base: int) -> Column:
    """Text with numeric entities of one base decoded."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern)))
    return F.when(~text.contains(opens), text).otherwise(F.aggregate(codes, text, lambda s, n: F.replace(s, F.concat(F.lit(opens), n, F.lit(";")), let(F.conv(n, base, 10).cast("int"), _character))))


def _character(code: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes; a replacement mark where there is none."""
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    tail = lambda shift: byte(F.lit(128) + F.shiftright(code, shift).bitwiseAND(63))
    raw = (
        F.when(code < 128, byte(code)).when(code < 2048, F.concat(byte(F.shiftright(code, 6) + 192), tail(0)))
        .when(code < 65536, F.concat(byte(F.shiftright(code, 12) + 224), tail(6), tail(0))).otherwise(F.concat(byte(F.shiftright(code, 18) + 240), tail(12), tail(6), tail(0)))
    )
    good = (code > 0) & ~code.between(0xD800, 0xDFFF) & (code <= 0x10FFFF)
    return F.when(good, F.decode(F.unhex(raw), "UTF-8")).otherwise("\ufffd")


def html_rows(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, table_no, before, row_no, texts) of all tables in HTML, on a grid: a cell that spans rows or columns gives
    its text to every place it covers. `before` is the text between the table and the one before. Null and empty
    pages, and pages without tables, have no rows; an unclosed table ends with the page, an inner one is a table of its
    own."""
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html).mapInArrow(_placed, f"{id_col} {kind}, table_no int, before string, row_no int, texts array<string>")


# The blanks of Java's \s; its $ also stands before a last line end, whichever it is.
_TABLE, _END, _ROW = (re.compile(x, re.I | re.A) for x in (r"<table(?=[\s>])[^>]*>", r"</table\s*>", r"<tr(?=[\s>])[^>]*>"))
_CELL, _BREAK = re.compile(r"<(?=t[dh][\s>])", re.I | re.A), re.compile("<(?:br|/p|/div|/h[1-6]|/li|/tr)[^>]*>", re.I | re.A)
_SPAN = [re.compile(r"\b" + "".join(f"[{c}{c.upper()}]" for c in x) + r"[ \t\n\x0b\f\r]*=[ \t\n\x0b\f\r]*[\"']?([0-9]{1,4})") for x in ("colspan", "rowspan")]
_TAG, _EDGES = re.compile("<[^>]*>"), re.compile("^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+(?=[\x85\u2028\u2029]?\\Z)")
_CODES = [(re.compile("&#([0-9]{1,6});"), "&#", 10), (re.compile("&#x([0-9A-Fa-f]{1,5});"), "&#x", 16)]


def _plain(x: str) -> str:
    """plain_text of one text."""
    x = _TAG.sub("", x) if "<" in x else x
    if "&" not in x:
        return x
    for pattern, opens, base in _CODES:
        for n in dict.fromkeys(pattern.findall(x)):
            c = int(n, base)
            x = x.replace(f"{opens}{n};", chr(c) if 0 < c <= 0x10FFFF and not 0xD800 <= c <= 0xDFFF else "\ufffd")
    for name, c in ENTITIES.items():
        x = x.replace(name, c)
    return x


@remembered()
def _cells(row: str) -> tuple[tuple[str, int, int], ...]:
    """(text, columns, rows) of the cells of a row."""
    out = []
    for cell in _CELL.split(row)[1:]:
        tag, _, body = cell.partition(">")
        span = [min(max(int(found[1]), 1), 1000) if "span" in tag.lower() and (found := pattern.search(tag)) else 1 for pattern in _SPAN]
        out.append((_EDGES.sub("", _plain(body if len(tag) < len(cell) else cell)), *span))
    return tuple(out)


def _simple(row: str) -> list[str] | None:
    """The texts of a row that holds nothing but plain cells; None for any other."""
    cells = row.replace("</td>", "").replace("</tr>", "")
    first, *texts = cells.split("<td>")
    if first or cells.count("<") != len(texts) or "&" in row or not row.isprintable():
        return None
    return [x.strip(" ") for x in texts]


@remembered()
def _before(x: str) -> str:
    return _plain(_BREAK.sub("\n", x))


def tables_of(html: str | None) -> Iterator[tuple[int, str, Iterator[list[str]]]]:
    """(table_no, before, grid) of the tables of a page, see html_rows."""
    before, *rest = _TABLE.split(html or "")
    for n, x in enumerate(rest, 1):
        table, *after = _END.split(x, maxsplit=1)
        yield n, _before(before), _grid(_ROW.split(table)[1:])
        before = "".join(after)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to the rows of their tables' grids, some megabytes of HTML at a time."""
    for whole in batches:
        for at in range(0, len(whole), 500):
            b, from_page, out = whole.slice(at, 500), [], ([], [], [], [])
            for page, html in enumerate(b.column(1).to_pylist()):
                for n, before, grid in tables_of(html):
                    for row_no, texts in enumerate(grid):
                        from_page.append(page)
                        for column, x in zip(out, (n, before, row_no, texts)):
                            column.append(x)
            kinds = pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(from_page, pa.int32())), *map(pa.array, out, kinds)], names=[b.schema.names[0], "table_no", "before", "row_no", "texts"])


def _grid(rows: list[str]) -> Iterator[list[str]]:
    """Rows of cells with spans to rows of a grid."""
    open_: dict[int, tuple[int, str]] = {}  # column: rows that a cell from above still covers, its text
    for row in rows:
        if not open_ and (texts := _simple(row)) is not None:
            yield texts
            continue
        line, column = {c: text for c, (_, text) in open_.items()}, 0
        open_ = {c: (down - 1, text) for c, (down, text) in open_.items() if down > 1}
        for text, across, down in _cells(row):
            while column in line:
                column += 1
            for c in range(column, column + across):
                line[c] = text
                if down > 1:
                    open_[c] = (down - 1, text)
            column += across
        yield [line.get(c, "") for c in range(max(line, default=-1) + 1)]


def text_rows(docs: DataFrame, id_col: str, text: str, separator: str = r"\|") -> DataFrame:
    """The same out of texts: consecutive lines with a separator are a table (one around all of a line is its
    frame), the lines since the table before stand before it. A blank cell is null: whether a merged cell covers it is for the header rules to infer."""
    lines = docs.select(id_col, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line")).withColumn("is_row", F.col("line").rlike(separator))
    w = Window.partitionBy(id_col).orderBy("line_no")
    marked = lines.withColumn("first", F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False)))
    marked = marked.withColumn("after", F.sum(F.col("first").cast("int")).over(w)).withColumn("table_no", F.when(F.col("is_row"), F.col("after")).otherwise(F.col("after") + 1))
    before = marked.where("not is_row").groupBy(id_col, "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("before"))
    cells = F.transform(F.split(F.regexp_replace("line", rf"^\s*{separator}(.*){separator}\s*$", "$1"), separator), lambda c: F.when(F.trim(c) != "", F.trim(c)))
    rows = marked.where("is_row").withColumn("row_no", F.row_number().over(Window.partitionBy(id_col, "table_no").orderBy("line_no")) - 1)
    return rows.join(before, [id_col, "table_no"], "left").select(id_col, "table_no", F.coalesce("before", F.lit("")).alias("before"), "row_no", cells.alias("texts"))


def cell_state(x: Column) -> Column:
    n = F.regexp_replace(compact(x), "[,，]", "")
    return F.when(n == "", "disclosed_blank").when(n.isin("-", "—", "/", "不适用"), "not_applicable_or_dash").when(n.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "ready").otherwise("disclosed_text")


def _is_number(x: Column) -> Column:
    """Whether cell_state is ready."""
    return F.regexp_replace(x, r"[\s\u00A0\u3000,，]+", "").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def cell_value(x: Column) -> Column:
    state = cell_state(x)
    return F.when(state == "ready", F.regexp_replace(compact(x), "[,，+]", "")).when(state == "disclosed_text", compact(x))


def header_paths(rows: Column) -> Column:
    """One path for each column out of the header rows, upper cells first, ' / ' between. A null cell belongs to the
    filled cell to its left as far as the cells above agree that both have one parent; a text repeated downwards is
    one."""
    blank = F.transform(rows[0], lambda _: F.array().cast("array<string>"))

    def filled(row: Column, paths: Column, i: Column) -> Column:
        own, above = F.element_at(row, i), F.element_at(paths, i)
        parent = F.try_element_at(F.filter(F.slice(row, F.lit(1), i), lambda x: compact(x) != ""), F.lit(-1))
        joined = own.isNull() & ((F.size(above) == 0) | ((i > 1) & (above == F.element_at(paths, F.greatest(i - 1, F.lit(1))))))
        return F.when(compact(own) != "", compact(own)).when(joined, compact(parent)).otherwise("")

    def step(paths: Column, row: Column) -> Column:
        def longer(i: Column) -> Column:
            text, above = filled(row, paths, i), F.element_at(paths, i)
            return F.when((text != "") & (F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit("")) != text), F.concat(above, F.array(text))).otherwise(above)

        return F.transform(F.sequence(F.lit(1), F.least(F.size(paths), F.size(row))), longer)

    return F.aggregate(rows, blank, step, lambda p: F.transform(p, lambda x: F.array_join(x, " / ")))


def caption(before: Column, fallback: Column) -> Column:
    """The heading nearest above a table: the last numbered line (or what follows a bare number), or a known one."""
    lines = F.filter(F.transform(F.split(before, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    number = r"^([（(]\s*[0-9]+\s*[)）][.．、]?|[0-9]+[、．.])\s*"

    def candidate(x: Column, i: Column) -> Column:
        rest = F.regexp_replace(x, number, "")
        text = F.when(rest != "", rest).otherwise(F.coalesce(F.try_element_at(lines, i + 2), F.lit("")))
        known = x.rlike(CAPTION_STARTS) & (F.length(x) <= 65) & ~x.rlike(r"[0-9][0-9,]*\.[0-9]{2}")
        return F.when(x.rlike(number), F.when((text != "") & ~text.rlike("^([√□]|单位)"), text)).when(known | x.isin(CAPTION_LINES), x)

    last = F.try_element_at(F.filter(F.transform(lines, candidate), lambda x: x.isNotNull()), F.lit(-1))
    return F.regexp_replace(F.coalesce(F.when(last.isNotNull(), compact(last)), fallback), "^[：:。]+|[：:。]+$", "")


def note_tables(rows: DataFrame, id_col: str, title: str = "") -> DataFrame:
    """(id, table_no, chain, headers, section, unit, currency, depth, issue): what the tables of each document are.

    The first row is a header unless it has numbers, starts a group, or names nothing that headers name; up to three
    more rows are, while their first cell is blank or a header's and none has numbers. A table without a header (or
    with a blank one, or the same one without a caption of its own) goes on with the last header (`chain`: the table that
    it stands in) if it is as wide; else its issue is `continuation_without_matching_header`, and so is that of all
    that follow without a header. Unit and currency hold until others are named.
    """
    first, others = compact(F.col("texts")[0]), F.slice("texts", 2, F.greatest(F.size("texts"), F.lit(1)))
    numbers = F.exists(others, lambda x: F.coalesce(_is_number(x), F.lit(False)))
    names = F.exists(others, lambda x: compact(x).rlike(HEADER_WORDS))
    opens = ~numbers & ~first.rlike("^[一二三四]+[、.]") & ((first == "") | first.isin(HEADER_LABELS) | names)
    goes = (F.col("row_no") < 4) & ((first == "") | first.isin(HEADER_LABELS)) & ~numbers
    w = Window.partitionBy(id_col, "table_no").orderBy("row_no")
    sized = rows.where("size(texts) > 0").withColumn("is_header", F.every(F.when(F.col("row_no") == 0, opens).otherwise(goes)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.array_sort(F.collect_list(F.when(F.col("is_header"), F.struct("row_no", "texts"))))
    tables = sized.groupBy(id_col, "table_no").agg(F.first("before").alias("before"), F.max(F.when(F.col("row_no") == 0, F.size("texts"))).alias("width"), head.alias("head"))
    tables = tables.select("*", F.size("head").alias("depth"), F.when(F.size("head") > 0, header_paths(F.transform("head", lambda x: x["texts"]))).alias("own"))
    docs = Window.partitionBy(id_col).orderBy("table_no")
    said = caption(F.col("before"), F.lit(title))
    named = F.coalesce(F.exists("own", lambda x: x != ""), F.lit(False))
    again = F.coalesce(F.col("own") == F.last(F.when(named, F.col("own")), ignorenulls=True).over(docs.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) & (said == title)
    tables = tables.withColumn("starts", named & ~again)
    so_far = docs.rowsBetween(Window.unboundedPreceding, 0)
    held = lambda c: F.last(F.when(F.col("starts"), c), ignorenulls=True).over(so_far)
    tables = tables.withColumn("chain", held(F.col("table_no"))).withColumn("headers", held(F.col("own"))).withColumn("section", held(said))
    fits = F.col("starts") | F.coalesce(F.col("width") == F.size("headers"), F.lit(False))
    tables = tables.withColumn("broken", ~F.every(fits).over(Window.partitionBy(id_col, "chain").orderBy("table_no").rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda pattern: F.last(F.try_element_at(F.regexp_extract_all("before", F.lit(pattern)), F.lit(-1)), ignorenulls=True).over(so_far)
    currencies = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    money = last(CURRENCY)
    return tables.select(id_col, "table_no", "chain", "headers", "section", last(UNIT).alias("unit"), F.when(money.isNotNull(), F.try_element_at(currencies, money)).alias("currency"), "depth", F.when(F.col("broken"), "continuation_without_matching_header").alias("issue"))


def note_rows(rows: DataFrame, tables: DataFrame, id_col: str) -> DataFrame:
    """(id, table_no, row_no, label, values, issue, ...): body rows with their full labels, in the context of the groups
    ('一、…', '其中：', '按…分类', without values) and numbered items ('1.…') above them, which a continuation takes over."""
    body = rows.where("size(texts) > 0").join(tables.where("issue is null").drop("issue"), [id_col, "table_no"]).where("row_no >= depth")
    # Columns of their own, so that each is computed once for all that use it.
    body = body.select("*", compact(F.col("texts")[0]).alias("own"), F.slice("texts", 2, F.greatest(F.size("texts"), F.lit(1))).alias("values"))
    body = body.withColumn("empty", F.forall("values", lambda x: compact(x) == ""))
    label, empty = F.col("own"), F.col("empty")
    body = body.withColumn("is_group", (F.size("texts") == F.size("headers")) & (label.rlike("^[一二三四五六七八九十]+[、.]") | label.isin(GROUP_LABELS) | label.rlike("^按.+分类$")) & empty)
    numbered, inner = label.rlike(r"^[0-9]+[.、．]"), label.rlike("^[（(][0-9]+[)）]")
    bare = F.regexp_replace(label, r"^[0-9]+[.、．]\s*", "")
    fits = F.size("texts") == F.size("headers")
    w = Window.partitionBy(id_col, "chain").orderBy("table_no", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("is_group"), F.regexp_replace(F.regexp_replace(label, "^[一二三四五六七八九十]+[、.]", ""), "^[：:]+|[：:]+$", "")), ignorenulls=True).over(w)
    item = F.last(F.when(F.col("is_group"), "").when(fits & numbered, bare), ignorenulls=True).over(w)
    found = body.select("*", F.coalesce(above, F.lit("")).alias("group"), F.coalesce(item, F.lit("")).alias("item"), bare.alias("bare"), fits.alias("fits"))
    named = F.when(inner & ~numbered & (F.col("item") != ""), F.concat("item", F.lit(" / "), F.regexp_replace("own", "^[（(][0-9]+[)）]", ""))).otherwise(F.col("bare"))
    found = found.where("not is_group and not (fits and own = '' and empty)").withColumn("label", F.when(F.col("group") != "", F.concat("group", F.lit(" / "), named)).otherwise(named))
    again = F.row_number().over(Window.partitionBy(id_col, "table_no", "fits", "label").orderBy("row_no")) > 1
    issue = F.when(~F.col("fits"), "column_count_mismatch").when(F.col("own") == "", "row_label_missing").when(again, "repeated_row_label")
    return found.withColumn("issue", issue).drop("before", "texts", "own", "bare", "item", "group", "is_group", "fits", "empty")


def note_cells(found: DataFrame, id_col: str) -> DataFrame:
    """(id, table_no, row_no, column_no, section, label, header, value, state, unit, currency, at_date): the cells of
    the rows of note_rows. Columns without a header have none (see note_issues)."""
    cells = found.where("issue is null or issue = 'repeated_row_label'").select("*", F.posexplode("values").alias("i", "raw"))
    cells = cells.withColumn("header", F.col("headers")[F.col("i") + 1]).where("header <> ''").withColumn("state", cell_state(F.col("raw")))
    state = F.col("state")
    own = F.when(F.col("header").rlike("[%％]|比例|利率"), "%").when(F.col("header").rlike("股数|数量"), "原表列单位").otherwise(F.coalesce("unit", F.lit("原文未标单位")))
    kept = (F.col("unit") != "股") & (own == F.col("unit")) & (state != "disclosed_text")
    return cells.select(
        id_col, "table_no", "row_no", (F.col("i") + 2).alias("column_no"), "section", "label", "header", cell_value(F.col("raw")).alias("value"), "state",
        F.when(state == "disclosed_text", "原文文字").otherwise(own).alias("unit"), F.when(kept, F.col("currency")).alias("currency"), F.concat("header", "label").rlike("期初|期末").alias("at_date"),
    )


def note_issues(found: DataFrame, tables: DataFrame, id_col: str) -> DataFrame:
    """(id, table_no, issues): the distinct problems of every table, in order; none for a good one."""
    missing = found.where("issue is null or issue = 'repeated_row_label'").where("exists(slice(headers, 2, size(headers)), x -> x = '')").select(id_col, "table_no", F.lit("column_header_missing").alias("issue"))
    every = found.where("issue is not null").select(id_col, "table_no", "issue").union(missing).union(tables.where("issue is not null").select(id_col, "table_no", "issue"))
    issues = every.groupBy(id_col, "table_no").agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    return tables.select(id_col, "table_no").join(issues, [id_col, "table_no"], "left").select(id_col, "table_no", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))
