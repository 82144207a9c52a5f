"""Blocks of a text and the tables in it, within the row: lines are tagged, joined and split again, so a document of any
length takes one pass and no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what a line is, in this order; (?d) makes \n the only line end
TABLE, HEADING, LIST, BLANK = r"(?d)^\|.+\|$", r"(?d)^#{1,6}\s+.+$", r"(?d)^\s*[-*+]\s+.+$", r"(?d)^\s*$"
SEPARATOR = r"(?d)^\|[\s\-:|]+\|$"
_START, _SPACES = "\x01", " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    """text without the characters of \\s at its ends."""
    return F.btrim(text, F.lit(_SPACES))


def strip_variable(x: Column) -> Column:
    """strip() of a variable, which may be named again at no cost: looking at the end is cheaper than trimming it, which
    takes note of every character's place first."""
    ends = [F.endswith(x, F.lit(c)) for c in _SPACES]
    return F.when(reduce(or_, ends), strip(x)).otherwise(F.ltrim(x, F.lit(_SPACES)))


def let(value: Column, use) -> Column:
    """use(value), with value computed once and bound to a variable. Columns that are built on each other over many
    steps would be written out in full, many times over, where a filter or a join above makes the optimiser look through
    them; a variable stays one."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def islands(units: Column, starts: Column, sep: str = "\n") -> Column:
    """Joins units into runs that begin where starts is true. A unit that holds \\x01 right after a separator would
    begin a run of its own."""


    def runs(tagged: Column) -> Column:
        joined = let(F.array_join(tagged, sep), lambda j: F.when(F.startswith(j, F.lit(_START)), F.substring(j, 2, 2**31 - 1)).otherwise(j))
        return F.when(F.size(tagged) > 0, F.split(joined, sep + _START, -1)).otherwise(F.array().cast("array<string>"))

    return let(F.zip_with(units, starts, lambda u, s: F.when(s, F.concat(F.lit(_START), u)).otherwise(u)), runs)


def block_list(text: Column) -> Column:
    """array(struct(kind, content)) of text, list and table blocks. A blank line ends a block; a heading starts one and
    is a part of it; items of a list begin with "- "; a table has two lines at least, a single one is left out."""
    def kind(x: Column) -> Column:
        # the first character decides for most lines, so that no pattern is run
        def of(left: Column) -> Column:
            listed = reduce(or_, (F.startswith(left, F.lit(c)) for c in "-*+"))
            return F.when(F.startswith(x, F.lit("|")) & x.rlike(TABLE), "T").when(F.startswith(x, F.lit("#")) & x.rlike(HEADING), "H").when(listed & x.rlike(LIST), "L").when(left == "", "B").otherwise("X")

        return let(F.ltrim(x, F.lit(_SPACES)), of)

    def tagged(rows: Column) -> Column:
        """Lines without the blank ones, each with whether it begins a block and, if so, with its letter before it."""

        def row(r: Column, i: Column) -> Column:
            k, p = r["k"], F.when(i == 0, "B").otherwise(F.get(rows, i - 1)["k"])
            starts = (k == "H") | ~((k == p) | ((k == "X") & (p == "H")))
            return F.when(k != "B", let(starts, lambda s: F.struct(s.alias("s"), F.when(s, F.concat(k, r["x"])).otherwise(r["x"]).alias("x"))))

        return F.array_compact(F.transform(rows, row))

    # each step is bound once: a lambda evaluates what it names again for every use
    rows = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.struct(kind(x).alias("k"), x.alias("x")))
    runs = let(let(rows, tagged), lambda t: islands(F.transform(t, lambda r: r["x"]), F.transform(t, lambda r: r["s"])))

    def block(run: Column) -> Column:
        letter, body = F.substring(run, 1, 1), F.substring(run, 2, 2**31 - 1)
        items = F.regexp_replace(body, r"(?md)^[ \t\r\f\x0B]*[-*+][ \t\r\f\x0B]+(.*?)[ \t\r\f\x0B]*$", "- $1")
        return F.struct(F.when(letter == "T", "table").when(letter == "L", "list").otherwise("text").alias("kind"), F.when(letter == "T", body).when(letter == "L", items).otherwise(let(body, strip_variable)).alias("content"))

    return F.filter(F.transform(runs, block), lambda b: (b["kind"] != "table") | F.contains(b["content"], F.lit("\n")))


def line_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block (from 1), kind, n_lines, content."""
    b = docs.select(key, F.posexplode(block_list(F.col(text))).alias("_i", "_b"))
    return b.select(key, (F.col("_i") + 1).cast("long").alias("block"), "_b.kind", (F.length("_b.content") - F.length(F.replace(F.col("_b.content"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), "_b.content")


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), strip)


def table_headers(content: Column) -> Column:
    """The cells of a table block's first line; none if that is a separator."""
    first = F.substring_index(content, "\n", 1)
    return F.when(first.rlike(SEPARATOR), F.array().cast("array<string>")).otherwise(_cells(first))


def table_rows(content: Column) -> Column:
    """The cells of the lines after the first; separators go."""
    lines = F.split(content, "\n", -1)
    return F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: ~x.rlike(SEPARATOR)), _cells)


def table_cells(content: Column) -> Column:
    """struct(headers, rows) of a table block."""
    return F.struct(table_headers(content).alias("headers"), table_rows(content).alias("rows"))


def clean_table(table: Column) -> Column:
    """Rows without any text go, white space within cells is one space; null if nothing is left."""

    def clean(cells: Column) -> Column:
        return F.transform(cells, lambda c: F.regexp_replace(strip(c), r"\s+", " "))

    rows = F.transform(F.filter(table["rows"], lambda r: F.exists(r, lambda c: ~c.rlike(BLANK))), clean)
    return F.when((F.size(rows) > 0) | (F.size(table["headers"]) > 0), F.struct(clean(table["headers"]).alias("headers"), rows.alias("rows")))


def clean_image(description: Column, ocr_text: Column, content: Column) -> Column:
    """struct(description, ocr_text) of an image, cleaned; null if it has neither of them nor content."""
    from .text import degarble

    d, o = strip(description), strip(degarble(ocr_text))
    has = (F.coalesce(d, F.lit("")) != "") | (F.coalesce(o, F.lit("")) != "") | (F.coalesce(F.length(content), F.lit(0)) > 0)
    return F.when(has, F.struct(d.alias("description"), o.alias("ocr_text")))


def _row(cells: Column) -> Column:
    return F.array_join(cells, " | ")


def _table_text(headers: Column, rows: Column, rule: bool) -> Column:
    head = _row(headers)
    top = F.when(F.size(headers) > 0, F.array(head, F.rpad(F.lit(""), F.length(head), "-")) if rule else F.array(head)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(top, F.transform(rows, _row)), "\n")


def table_text(table: Column, rule: bool = True) -> Column:
    """The cells of a struct(headers, rows), joined; rule: a line of dashes below the headers."""
    return _table_text(table["headers"], table["rows"], rule)


def block_text(block: Column, rule: bool = True) -> Column:
    return F.when(block["kind"] == "table", _table_text(table_headers(block["content"]), table_rows(block["content"]), rule)).otherwise(block["content"])


def document_text(blocks: Column) -> Column:
    """Text and table blocks, joined by a blank line; lists aren't a part of it."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["kind"] != "list"), lambda b: block_text(b)), "\n\n")


def title(blocks: Column) -> Column:
    """The heading of the first text block that begins with # or ##; empty without one."""
    found = F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: F.regexp_extract(b["content"], r"(?md)\A#{1,2}\s+(.+)$", 1))
    return F.coalesce(strip(F.get(F.filter(found, lambda x: x != ""), 0)), F.lit(""))
