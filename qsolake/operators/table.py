"""Edits of table rows: a row is row_no and cells, an array of strings; columns are counted from 0.

Every edit of single rows is an array expression and needs no shuffle. rows, where given, is a condition that
selects rows; columns a list of places; both select everything if left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.sources.logs import trimmed


def map_cells(table: DataFrame, change: Callable[[Column], Column], columns: list[int] | None = None, rows: Column | None = None) -> DataFrame:
    chosen = lambda i: F.lit(True) if not columns else i.isin(columns)
    made = F.transform("cells", lambda v, i: F.when(chosen(i), change(v)).otherwise(v))
    return table.withColumn("cells", made if rows is None else F.when(rows, made).otherwise(F.col("cells")))


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, before, after of every cell that an edit of single rows changed."""
    both = before.join(after.select(*keys, F.col("cells").alias("_after")), keys)
    cells = F.posexplode(F.arrays_zip(F.col("cells").alias("before"), F.col("_after").alias("after"))).alias("column", "c")
    return both.select(*keys, cells).select(*keys, "column", "c.before", "c.after").where("before <> after")


#: The named cell edits.
EDITS: dict[str, Callable[[Column], Column]] = {
    "trim": trimmed,
    "trim_all": lambda v: F.regexp_replace(v, "(?U)\\s", ""),
    "remove_alpha": lambda v: F.regexp_replace(v, "[A-Za-z]", ""),
    "remove_numeric": lambda v: F.regexp_replace(v, "[0-9]", ""),
    "remove_symbols": lambda v: F.regexp_replace(v, "(?U)[^A-Za-z0-9\\s]", ""),
    "remove_left": lambda v: F.substring(v, 2, 1 << 30),
    "remove_right": lambda v: F.left(v, F.greatest(F.length(v) - 1, F.lit(0))),
    "empty": lambda v: F.repeat(F.lit(" "), F.length(v)),
}


def edit(table: DataFrame, name: str, **selection) -> DataFrame:
    return map_cells(table, EDITS[name], **selection)


def replace(table: DataFrame, old: str, new: str, **selection) -> DataFrame:
    return map_cells(table, lambda v: F.replace(v, F.lit(old), F.lit(new)), **selection)


def fill(table: DataFrame, value: str, **selection) -> DataFrame:
    return map_cells(table, lambda v: F.lit(value), **selection)


def insert_column(table: DataFrame, after: int, value: Column) -> DataFrame:
    """value as a new column behind column `after`; -1 puts it first."""
    return table.withColumn("cells", F.concat(F.slice("cells", 1, after + 1), F.array(value), F.slice("cells", after + 2, 1 << 30)))


def duplicate_column(table: DataFrame, column: int) -> DataFrame:
    return insert_column(table, column, F.coalesce(F.get("cells", F.lit(column)), F.lit("")))


def delete_columns(table: DataFrame, columns: list[int], keep: bool = False) -> DataFrame:
    return table.withColumn("cells", F.filter("cells", lambda v, i: i.isin(columns) if keep else ~i.isin(columns)))


def move_columns(table: DataFrame, columns: list[int], width: int, direction: str) -> DataFrame:
    """The columns one place left or right; nothing moves if one of them stands at that border."""
    chosen = {c for c in columns if 0 <= c < width}
    if not chosen or (0 if direction == "left" else width - 1) in chosen:
        return table
    step = -1 if direction == "left" else 1
    order = list(range(width))
    for c in sorted(chosen, reverse=step > 0):
        order[c], order[c + step] = order[c + step], order[c]
    return table.withColumn("cells", F.array(*[F.coalesce(F.get("cells", F.lit(c)), F.lit("")) for c in order]))


def split_column(table: DataFrame, column: int, separator: str) -> DataFrame:
    """The column at its first separator: what stands before it and what stands behind it."""
    value = F.coalesce(F.get("cells", F.lit(column)), F.lit(""))
    at = F.instr(value, F.lit(separator))
    left = F.when(at > 0, F.left(value, at - 1)).otherwise(value)
    right = F.when(at > 0, F.substring(value, at + len(separator), F.length(value))).otherwise("")
    return table.withColumn("cells", F.concat(F.slice("cells", 1, column), F.array(left, right), F.slice("cells", column + 2, 1 << 30)))


def split_pieces(table: DataFrame, column: int, separator: str, width: int) -> DataFrame:
    """The column as `width` columns; the last takes what is left."""
    value = F.coalesce(F.get("cells", F.lit(column)), F.lit(""))
    parts = F.split(value, "\\Q" + separator + "\\E", width)
    made = F.concat(parts, F.array_repeat(F.lit(""), width - F.size(parts)))
    return table.withColumn("cells", F.concat(F.slice("cells", 1, column), made, F.slice("cells", column + 2, 1 << 30)))


def join_columns(table: DataFrame, columns: list[int], with_space: bool = False) -> DataFrame:
    """The columns put together in the place of the first; with_space leaves out empty ones and sets blanks between."""
    chosen = sorted(set(columns))
    values = [F.coalesce(F.get("cells", F.lit(c)), F.lit("")) for c in chosen]
    made = F.array_join(F.filter(F.transform(F.array(*values), trimmed), lambda v: v != ""), " ") if with_space else F.concat(*values)
    placed = F.transform("cells", lambda v, i: F.when(i == chosen[0], made).otherwise(v))
    return table.withColumn("cells", F.filter(placed, lambda v, i: ~i.isin(chosen[1:])))


def shift_rows(table: DataFrame, direction: str, rows: Column | None = None, by: Column | int = 1) -> DataFrame:
    """Cells moved left or right within their row; what falls off is lost, empty cells come in."""
    by, n = F.lit(by) if isinstance(by, int) else by, F.size("cells")
    room = F.least(by, n)
    blank = F.array_repeat(F.lit(""), room)
    kept = F.when(n > room, F.slice("cells", room + 1 if direction == "left" else F.lit(1), F.greatest(n - room, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    moved = F.concat(kept, blank) if direction == "left" else F.concat(blank, kept)
    return table.withColumn("cells", moved if rows is None else F.when(rows, moved).otherwise(F.col("cells")))


def align_rows(table: DataFrame, columns: list[int], keys: list[str]) -> DataFrame:
    """Rows shifted so that their first filled cell among columns stands where it does most often in the table (keys)."""
    ordered = sorted(columns)
    first = F.coalesce(*[F.when(trimmed(F.coalesce(F.get("cells", F.lit(c)), F.lit(""))) != "", c) for c in ordered])
    placed = table.withColumn("_first", first)
    counts = placed.where("_first is not null").groupBy(*keys, "_first").count()
    most = counts.groupBy(*keys).agg(F.max(F.struct("count", -F.col("_first"))).alias("m")).select(*keys, (-F.col("m")["col2"]).alias("_most"))
    joined = placed.join(F.broadcast(most) if not keys else most, keys, "left") if keys else placed.crossJoin(F.broadcast(most))
    right = shift_rows(joined, "right", F.col("_most") > F.col("_first"), F.greatest(F.col("_most") - F.col("_first"), F.lit(0)))
    left = shift_rows(right, "left", F.col("_most") < F.col("_first"), F.greatest(F.col("_first") - F.col("_most"), F.lit(0)))
    return left.drop("_first", "_most")


def serial_column(table: DataFrame, keys: list[str], after: int = -1, start: int = 1, width: int = 3) -> DataFrame:
    """A running number of each table's rows (keys) as a new column, zeros in front."""
    n = (F.row_number().over(Window.partitionBy(*keys).orderBy("row_no")) + start - 1).cast("string")
    numbered = table.withColumn("_n", F.lpad(n, F.greatest(F.length(n), F.lit(width)), F.lit("0")))
    return insert_column(numbered, after, F.col("_n")).drop("_n")


def delete_rows(table: DataFrame, rows: Column) -> DataFrame:
    return table.where(~rows)


def copy_column(table: DataFrame, column: int) -> DataFrame:
    """row_no and value."""
    return table.select("row_no", F.coalesce(F.get("cells", F.lit(column)), F.lit("")).alias("value"))


def paste_column(table: DataFrame, after: int, values: DataFrame) -> DataFrame:
    """values (row_no, value) as a new column; rows without one get an empty cell."""
    joined = table.join(values.withColumnRenamed("value", "_value"), "row_no", "left")
    return insert_column(joined, after, F.coalesce("_value", F.lit(""))).drop("_value")
