"""Tables given as sparse cells, rendered as plain text, as markdown and as one line for each row; array expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = "struct<text:string,row:int,col:int,row_span:int,col_span:int,column_header:boolean,row_header:boolean,row_section:boolean>"
TABLE = f"struct<num_rows:int,num_cols:int,caption:string,cells:array<{CELL}>>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def _cells(table: Column) -> Column:
    return F.coalesce(table["cells"], F.array().cast(f"array<{CELL}>"))


def _size(table: Column, declared: str, position: str) -> Column:
    """The declared number of rows or columns, or as many as the cells reach; 0 for no table."""
    reach = F.coalesce(F.array_max(F.transform(_cells(table), lambda c: c[position])) + 1, F.lit(0))
    return F.when(F.coalesce(table[declared], F.lit(0)) > 0, table[declared]).otherwise(reach)


def _numbers(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _rows(table: Column) -> Column:
    """The cells of each row."""
    return F.transform(_numbers(_size(table, "num_rows", "row")), lambda r: F.filter(_cells(table), lambda c: c["row"] == r))


def grid(table: Column) -> Column:
    """Dense rows of texts: the first text of a place that isn't blank, '' where there is none; cells out of range are left out."""
    cols = _numbers(_size(table, "num_cols", "col"))
    text = lambda row, k: F.filter(F.transform(F.filter(row, lambda c: c["col"] == k), lambda c: strip(F.coalesce(c["text"], F.lit("")))), lambda t: t != "")
    return F.transform(_rows(table), lambda row: F.transform(cols, lambda k: F.coalesce(F.get(text(row, k), 0), F.lit(""))))


def header_rows(table: Column) -> Column:
    """How many rows lead as headers: those with a flagged cell in range, else one."""
    width = _size(table, "num_cols", "col")
    flags = F.transform(_rows(table), lambda row: F.exists(row, lambda c: F.coalesce(c["column_header"], F.lit(False)) & (c["col"] >= 0) & (c["col"] < width)))
    first_without = F.array_position(flags, F.lit(False))
    return F.greatest(F.when(first_without == 0, F.size(flags)).otherwise(first_without - 1), F.lit(1)).cast("int")


def flat(table: Column) -> Column:
    """Caption, then each row's texts with blanks between; rows without text are left out."""
    lines = F.transform(grid(table), lambda r: F.array_join(F.filter(r, lambda t: t != ""), " "))
    return F.array_join(F.filter(F.concat(F.array(strip(F.coalesce(table["caption"], F.lit("")))), lines), lambda t: t != ""), "\n")


def _has_grid(table: Column) -> Column:
    return F.coalesce((_size(table, "num_rows", "row") > 0) & (_size(table, "num_cols", "col") > 0), F.lit(False))


def markdown(table: Column) -> tuple[Column, Column]:
    """(header lines with the line of dashes, body lines); both empty without a grid."""
    none = F.array().cast("array<string>")
    escaped = lambda t: F.regexp_replace(F.replace(t, F.lit("|"), F.lit("\\|")), "[\r\n]", " ")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, escaped), " | "), F.lit(" |"))
    lines, n = F.transform(grid(table), line), header_rows(table)
    dashes = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), _size(table, "num_cols", "col")), " | "), F.lit(" |"))
    return F.when(_has_grid(table), F.concat(F.slice(lines, 1, n), F.array(dashes))).otherwise(none), F.when(_has_grid(table), F.slice(lines, n + 1, F.greatest(F.size(lines) - n, F.lit(0)))).otherwise(none)


def linearized(table: Column) -> Column:
    """``label — column: value; ...`` for each row after the headers; a column's label joins its header texts, or is ``col`` with its number.

    The first text of a row is its label where the first column is blank, and then still comes as a value too. Rows without text are left out.
    """
    none = F.array().cast("array<string>")
    rows, n = grid(table), header_rows(table)
    heads, body = F.slice(rows, 1, n), F.slice(rows, n + 1, F.greatest(F.size(rows) - n, F.lit(0)))
    cols = _numbers(_size(table, "num_cols", "col"))
    names = F.transform(cols, lambda k: _squeeze(F.array_join(F.filter(F.transform(heads, lambda r: F.get(r, k)), lambda t: t != ""), " ")))
    name = lambda k: F.when(F.get(names, k) == "", F.concat(F.lit("col"), k.cast("string"))).otherwise(F.get(names, k))

    def line(r: Column) -> Column:
        label = _squeeze(F.coalesce(F.get(F.filter(r, lambda t: t != ""), 0), F.lit("")))
        values = F.filter(F.transform(cols, lambda k: F.when((k > 0) & (F.get(r, k) != ""), F.concat(name(k), F.lit(": "), _squeeze(F.get(r, k))))), lambda t: t.isNotNull())
        joined = F.array_join(values, "; ")
        return F.when(F.size(values) == 0, label).when(label == "", joined).otherwise(F.concat(label, F.lit(" — "), joined))

    return F.when(_has_grid(table), F.filter(F.transform(body, line), lambda t: t != "")).otherwise(none)
