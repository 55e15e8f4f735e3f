"""Edits of guided imports, recipes that repeat them on other files, and the report of where every value comes from.

Sessions are rows of guided.sessions. Columns are split, joined, added and mapped and cells corrected in all files at once;
each edit carries along what stood in a cell of the source, so the lineage of guided.contacts and the report show it.

A recipe is a program of such steps on columns of given names. It is checked before any file is read: the width after each
step is known from the steps alone. It is then one expression over the arrays of a file, so replaying it needs no shuffle;
a file of other columns stays as it was and says so in `notice`.

Defined cases: an edit of a column that a file doesn't have leaves the file as it is; missing cells are empty; cells beyond
the columns stay after a join; null cells of edits are empty, and of two edits of one cell the greater value holds."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.functions.radio import let
from qsolake.sources import guided

UNITS, ORDERS = ("auto", "MHz", "kHz", "Hz"), ("auto", "ymd", "dmy", "mdy")


class Split(NamedTuple):
    """One column becomes `width` columns; the last takes what is left. A blank as separator: any white space."""

    index: int
    separator: str
    width: int


class Join(NamedTuple):
    """Columns become one, at the place of the first, with blanks between."""

    indexes: tuple[int, ...]


class Add(NamedTuple):
    """An empty column at the end."""

    name: str = "Constant"


class Mapping(NamedTuple):
    """What a column means; a constant stands for its cells."""

    name: str
    field: str = ""
    unit: str = "auto"
    constant: str | None = None
    upper: bool = False
    date_order: str | None = None


class Recipe(NamedTuple):
    base: tuple[str, ...]
    steps: tuple[Split | Join | Add, ...]
    columns: tuple[Mapping, ...]


# --- recipes -----------------------------------------------------------------------------------------------------


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _fault(step: object, width: int) -> str | None:
    """What is wrong with a step on so many columns."""
    if isinstance(step, Add):
        return None if isinstance(step.name, str) else "the name isn't text"
    if isinstance(step, Split):
        if not _whole(step.index) or not 0 <= step.index < width:
            return f"there is no column {step.index}"
        if not isinstance(step.separator, str) or not step.separator:
            return "the separator is empty"
        return None if _whole(step.width) and step.width >= 2 else "a split gives two columns or more"
    if isinstance(step, Join):
        if len(step.indexes) < 2 or len(set(step.indexes)) < len(step.indexes):
            return "a join takes two different columns or more"
        return None if all(_whole(i) and 0 <= i < width for i in step.indexes) else "a joined column is missing"
    return "the step is of no known kind"


def _widened(step: Split | Join | Add) -> int:
    return 1 if isinstance(step, Add) else step.width - 1 if isinstance(step, Split) else 1 - len(step.indexes)


def faults(recipe: Recipe) -> list[str]:
    """What keeps a recipe from being replayed; found without reading a file."""
    if not recipe.base or not all(isinstance(name, str) for name in recipe.base):
        return ["the recipe names no columns to begin with"]
    width = len(recipe.base)
    for n, step in enumerate(recipe.steps, 1):
        wrong = _fault(step, width)
        if wrong:  # widths after it mean nothing
            return [f"step {n}: {wrong}"]
        width += _widened(step)
    found = [] if width == len(recipe.columns) else [f"the steps give {width} columns, the recipe names {len(recipe.columns)}"]
    for n, c in enumerate(recipe.columns, 1):
        texts = all(isinstance(x, str) for x in (c.name, c.field)) and all(x is None or isinstance(x, str) for x in (c.constant, c.date_order))
        if not texts or not isinstance(c.upper, bool) or c.unit not in UNITS or c.date_order not in (None, *ORDERS) or not re.fullmatch("([A-Z][A-Z0-9_]*)?", c.field):
            found.append(f"column {n}: its settings can't be used")
    return found


def checked(recipe: Recipe) -> Recipe:
    found = faults(recipe)
    if found:
        raise ValueError("; ".join(found))
    return recipe


_KINDS = {"split": Split, "join": Join, "add": Add}


def to_json(recipe: Recipe) -> str:
    steps = [{"kind": kind, **step._asdict()} for step in checked(recipe).steps for kind, made in _KINDS.items() if type(step) is made]
    return json.dumps({"base": recipe.base, "steps": steps, "columns": [c._asdict() for c in recipe.columns]})


def from_json(text: str) -> Recipe:
    """A recipe from its text; anything else is refused with ValueError."""
    try:
        data = json.loads(text)
        steps = [_KINDS[s["kind"]](**{k: tuple(v) if k == "indexes" else v for k, v in s.items() if k != "kind"}) for s in data["steps"]]
        made = Recipe(tuple(data["base"]), tuple(steps), tuple(Mapping(**c) for c in data["columns"]))
    except (AttributeError, KeyError, TypeError) as wrong:
        raise ValueError(f"no recipe: {wrong}") from wrong
    return checked(made)


# --- steps on the cells and columns of a file --------------------------------------------------------------------


def _row(r: Column, cells: Column, originals: Column) -> Column:
    return F.struct(r["nth"].alias("nth"), r["original"].alias("original"), cells.alias("cells"), r["kind"].alias("kind"), r["errors"].alias("errors"), originals.alias("originals"))


def _or_empty(cells: Column, i: Column | int) -> Column:
    return F.coalesce(F.get(cells, F.lit(i) if isinstance(i, int) else i), F.lit(""))


def _put(items: Column, index: int, middle: Column) -> Column:
    """The item at index replaced by others."""
    return F.concat(F.slice(items, 1, index), middle, F.slice(items, index + 2, F.size(items) + 1))


def _kept(items: Column, gone: list[int], width: Column, joined: Column) -> Column:
    """The items of the columns that a join leaves, the joined one at the first place, and what lies beyond the columns."""
    first, rest = gone[0], gone[1:]
    places = F.filter(F.sequence(F.lit(0), width - 1), lambda i: ~i.isin(rest))
    return F.concat(F.transform(places, lambda i: F.when(i == first, joined).otherwise(_or_empty(items, i))), F.slice(items, width + 1, F.size(items) + 1))


def _edited(rows: Column, cells, originals) -> Column:
    """Rows with cells and originals made anew; both get the array that they are made from."""
    return F.transform(rows, lambda r: _row(r, cells(r["cells"]), let(F.coalesce(r["originals"], r["cells"]), originals)))


def _stepped(rows: Column, step: Split | Join | Add, width: Column) -> Column:
    if isinstance(step, Add):
        more = lambda items: F.array_append(items, F.lit(""))
        return _edited(rows, more, more)
    if isinstance(step, Split):
        i, n = step.index, step.width
        blank = step.separator == " "

        def parts(cells: Column) -> Column:
            cell = _or_empty(cells, i)
            pieces = F.split(guided.trimmed(cell), r"(?U)\s+") if blank else F.split(cell, re.escape(step.separator))
            return let(pieces, lambda p: F.array(*[_or_empty(p, k) for k in range(n - 1)], F.array_join(F.slice(p, n, F.size(p)), step.separator)))

        return _edited(rows, lambda c: _put(c, i, parts(c)), lambda o: _put(o, i, F.array_repeat(_or_empty(o, i), n)))
    gone = sorted(step.indexes)
    both = lambda items, mark: F.concat_ws(mark, *[_or_empty(items, i) for i in gone])
    return _edited(rows, lambda c: _kept(c, gone, width, guided.trimmed(both(c, " "))), lambda o: _kept(o, gone, width, both(o, " | ")))


def _columns(columns: Column, step: Split | Join | Add) -> Column:
    """The columns after a step; those that it made have no field yet."""
    if isinstance(step, Add):
        return F.array_append(columns, guided.column(step.name, locked=True))
    if isinstance(step, Split):
        name = lambda c, k: guided.column(F.concat(c["name"], F.lit(f" {k + 1}")), locked=True)
        return let(columns, lambda cs: _put(cs, step.index, let(F.get(cs, F.lit(step.index)), lambda c: F.array(*[name(c, k) for k in range(step.width)]))))
    gone = sorted(step.indexes)
    marked = F.transform(columns, lambda c, i: F.when(i == gone[0], guided.column("Combined exchange", locked=True)).when(~i.isin(gone), c))
    return F.filter(marked, lambda c: c.isNotNull())


# --- edits of sessions -------------------------------------------------------------------------------------------


def edit(sessions: DataFrame, step: Split | Join | Add) -> DataFrame:
    """Sessions after one step, in every file that has its columns."""
    most = step.index if isinstance(step, Split) else max(step.indexes) if isinstance(step, Join) else -1
    wrong = _fault(step, most + 1)
    if wrong:
        raise ValueError(wrong)
    fits = F.size("columns") > most
    # Rows first: beside a new `columns`, the width in their lambdas would be taken from that.
    rows = F.when(fits, _stepped(F.col("rows"), step, F.size("columns"))).otherwise(F.col("rows"))
    return sessions.withColumn("rows", rows).withColumn("columns", F.when(fits, _columns(F.col("columns"), step)).otherwise(F.col("columns")))


def split_width(sessions: DataFrame, index: int, separator: str) -> int:
    """The number of parts of the longest cell of a column over all files."""
    cells = F.transform("rows", lambda r: _or_empty(r["cells"], index))
    parts = lambda c: F.size(F.split(guided.trimmed(c), r"(?U)\s+") if separator == " " else F.split(c, re.escape(separator)))
    return sessions.select(F.max(F.coalesce(F.array_max(F.transform(cells, parts)), F.lit(1)))).first()[0] or 1


def map_column(sessions: DataFrame, index: int, **settings) -> DataFrame:
    """Name, field, unit, constant, upper or date_order of a column set in every file that has it; the rest stays."""
    if set(settings) - set(Mapping._fields):
        raise ValueError(f"no settings: {sorted(set(settings) - set(Mapping._fields))}")
    old = lambda c: {k: c[k] for k in ("name", "field", "unit", "confidence", "constant", "upper", "date_order")}
    mapped = F.transform("columns", lambda c, i: F.when(i == index, guided.column(**{**old(c), **settings, "locked": True})).otherwise(c))
    return sessions.withColumn("columns", mapped)


def change_cells(sessions: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells corrected: edits are (path, nth, place, value), place from 0."""
    one = edits.where("path IS NOT NULL AND nth IS NOT NULL AND place IS NOT NULL").groupBy("path", "nth", "place").agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))
    by_row = one.groupBy("path", "nth").agg(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "value"))).alias("cells"))
    by_file = by_row.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("nth").cast("long").alias("nth"), "cells"))).alias("_edits"))

    def corrected(r: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(r["cells"]), F.size("columns"), F.lit(1)) - 1)
        new = lambda own: F.transform(places, lambda i: F.coalesce(F.try_element_at(own, i), _or_empty(r["cells"], i)))
        changed = lambda own: F.when(own.isNull(), r).otherwise(_row(r, new(own), F.coalesce(r["originals"], r["cells"])))
        return let(F.try_element_at("_edits", r["nth"].cast("long")), changed)

    rows = F.when(F.col("_edits").isNull(), F.col("rows")).otherwise(F.transform("rows", corrected))
    return sessions.join(by_file, "path", "left").withColumn("rows", rows).drop("_edits")


def replay(sessions: DataFrame, recipe: Recipe) -> DataFrame:
    """Sessions after all steps of a recipe, with `notice`: applied, or columns-differ for a file left as it was. ValueError
    for a recipe with faults, before anything is read."""
    checked(recipe)
    rows, width = F.col("rows"), len(recipe.base)
    for step in recipe.steps:
        rows, width = _stepped(rows, step, F.lit(width)), width + _widened(step)
    fits = F.transform("columns", lambda c: F.lower(c["name"])).eqNullSafe(F.array(*[F.lit(name.lower()) for name in recipe.base]))
    named = F.array(*[guided.column(**c._asdict(), confidence=1.0, locked=True) for c in recipe.columns])
    return sessions.withColumns({
        "columns": F.when(fits, named).otherwise(F.col("columns")),
        "rows": F.when(fits, rows).otherwise(F.col("rows")),
        "notice": F.when(fits, "applied").otherwise("columns-differ"),
    })


def report(sessions: DataFrame, *, recipe: Recipe | None = None, date_order: str = "auto") -> DataFrame:
    """path, nth and line: JSON of each file (nth null: interpretation, columns, other rows, metadata, the recipe) and of each
    contact (values with their lineage, unmapped cells, issues). One row each, so files of any length are written by many tasks."""
    others = F.filter("rows", lambda r: r["kind"] != "qso")
    head = F.to_json(F.struct(
        F.lit(1).alias("version"), "path", "candidate", "score", "strategy", "columns", others.alias("rows"), "metadata",
        F.lit(to_json(recipe) if recipe else None).cast("string").alias("recipe"),
    ))
    made = guided.contacts(sessions, date_order=date_order, lineage=True)
    lines = made.select("path", "nth", F.to_json(F.struct("path", "nth", "original", "values", "lineage", "unmapped", "issues")).alias("line"))
    return sessions.select("path", F.lit(None).cast("int").alias("nth"), head.alias("line")).unionByName(lines)
