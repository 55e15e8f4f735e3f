"""Guided import: the layout of any text table is guessed, its columns are named, its contacts are normalized.

Files are rows (path, text). Six interpretations of each are scored on a sample of its beginning, the best (or the one
asked for) is read in full, rows are classified, columns get fields from headings or from their values, and every
contact is brought to canonical values with the issues that a person has to look at. All is column expressions over
whole files, but for the scan of quoted cells.

Defined cases: null texts are left out; an empty text gives a file without columns. Files of any size are read; where Limits
are given, a file beyond one has `rejected` set and no rows."""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qsolake.functions import radio
from qsolake.functions.radio import let
from qsolake.sources.logs import short_batches


class Limits(NamedTuple):
    """What a file may have at most; None: any number."""

    characters: int | None = None
    rows: int | None = None
    columns: int | None = None
    cells: int | None = None


#: Characters at the beginning of a text by which interpretations are scored.
SAMPLE = 100_000
# The fields, and the headings (letters and digits only) that name them.
FIELDS = [
    "QSO_DATE", "TIME_ON", "FREQ", "BAND", "MODE", "SUBMODE", "CALL", "STATION_CALLSIGN", "RST_SENT", "RST_RCVD", "STX", "SRX",
    "STX_STRING", "SRX_STRING", "MY_GRIDSQUARE", "GRIDSQUARE", "QSO_POINTS", "COMMENT", "OPERATOR", "EDI_NEW_WWL",
    "EDI_NEW_EXCHANGE", "EDI_NEW_DXCC", "EDI_DUPLICATE",
]
HEADINGS = {
    "date": "QSO_DATE", "qsodate": "QSO_DATE", "time": "TIME_ON", "timeon": "TIME_ON", "utc": "TIME_ON", "freq": "FREQ",
    "frequency": "FREQ", "frequencykhz": "FREQ", "frequencymhz": "FREQ", "band": "BAND", "mode": "MODE", "submode": "SUBMODE",
    "call": "CALL", "callsign": "CALL", "contactedcall": "CALL", "mycall": "STATION_CALLSIGN", "stationcallsign": "STATION_CALLSIGN",
    "stationcall": "STATION_CALLSIGN", "snt": "RST_SENT", "sent": "RST_SENT", "rstsent": "RST_SENT", "rcvd": "RST_RCVD",
    "received": "RST_RCVD", "rstrcvd": "RST_RCVD", "rstreceived": "RST_RCVD", "stx": "STX", "sentserial": "STX", "serialsent": "STX",
    "srx": "SRX", "receivedserial": "SRX", "serialreceived": "SRX", "stxstring": "STX_STRING", "sentexchange": "STX_STRING",
    "srxstring": "SRX_STRING", "receivedexchange": "SRX_STRING", "mygrid": "MY_GRIDSQUARE", "mygridsquare": "MY_GRIDSQUARE",
    "mylocator": "MY_GRIDSQUARE", "grid": "GRIDSQUARE", "gridsquare": "GRIDSQUARE", "locator": "GRIDSQUARE", "pts": "QSO_POINTS",
    "points": "QSO_POINTS", "qsopoints": "QSO_POINTS", "comment": "COMMENT", "comments": "COMMENT", "notes": "COMMENT",
    "operator": "OPERATOR",
}
# The grouped table of sent and received exchanges, known by the words of its heading.
GROUPED = "QSO_DATE TIME_ON FREQ MODE STATION_CALLSIGN RST_SENT STX MY_GRIDSQUARE CALL RST_RCVD SRX GRIDSQUARE QSO_POINTS COMMENT".split()
SIGNATURES = [["mycall", "snt exchange", "rcvd exchange"], ["station sent exchange", "contact received exchange"]]
DELIMITERS = ["\t", ";", ",", "|"]
# Shapes of cells.
GRID = r"(?i)^[A-R]{2}\d{2}([A-X]{2}(\d{2})?)?$"
DATE = r"^(\d{8}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"
TIME = r"(?i)^([0-2]\d[0-5]\d([0-5]\d)?|[0-2]?\d:[0-5]\d(:[0-5]\d)?)Z?$"
MODE = r"(?i)^(USB|LSB|SSB|PHONE|PH|CW|FM|AM|FT8|FT4|RTTY|PSK31|DG|DIGI|DIGITAL)$"
MODES = {"USB": "SSB", "LSB": "SSB", "PHONE": "SSB", "PH": "SSB", "DG": "DIGITAL", "DIGI": "DIGITAL"}
#: Unicode's white space, as (?U)\s matches it.
WHITE = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85")
CALL = r"^(?=.{3,20}$)(?=.*[A-Z])(?=.*\d)[A-Z0-9]+(/[A-Z0-9]+)*$"
UNCLOSED, STRAY_QUOTE, AFTER_QUOTE = "unclosed quoted field", "quote inside an unquoted field", "text after a closing quote"

is_grid = lambda s: s.rlike(GRID)
is_date = lambda s: s.rlike(DATE)
is_time = lambda s: s.rlike(TIME)
is_mode = lambda s: s.rlike(MODE)


def trimmed(x: Column) -> Column:
    """radio.trimmed() without a pattern, as here it is asked of every cell."""
    return F.btrim(x, F.lit(WHITE))


def is_call(s: Column) -> Column:
    return F.upper(s).rlike(CALL) & ~is_grid(s)


#: Any of the shapes; what is a locator and reads like a call counts as well.
EVIDENCE = f"(?i)^(?:{'|'.join(shape.removeprefix('(?i)')[1:-1] for shape in (DATE, TIME, GRID, MODE))})$"


def evidence(s: Column) -> Column:
    return s.rlike(EVIDENCE) | F.upper(s).rlike(CALL)


def field_of(heading: Column) -> Column:
    """The field that a heading names, else an empty string; none has a digit in its name, as most cells do."""
    table = [F.lit(x) for pair in HEADINGS.items() for x in pair]
    found = F.try_element_at(F.create_map(*table), F.regexp_replace(F.lower(heading), "[^a-z0-9]", ""))
    return F.when(heading.rlike("[0-9]"), "").otherwise(F.coalesce(found, F.when(heading.isin(FIELDS), heading), F.lit("")))


# --- cells -------------------------------------------------------------------------------------------------------

ROW = T.StructType().add("original", T.StringType()).add("cells", T.ArrayType(T.StringType())).add("errors", T.ArrayType(T.StringType()))


LINE_END = re.compile("\r\n|\r|\n")


def scanned(text: str, delimiter: str) -> list[tuple[str, list[str], list[str]]]:
    """Records of delimited text: line ends and delimiters inside quotes belong to their cell."""
    piece = re.compile(rf'"|\r\n|\r|\n|{re.escape(delimiter)}|[^"\r\n{re.escape(delimiter)}]+')
    rows, cells, errors, cell, start, at = [], [], [], "", 0, 0
    quoted = closed = False
    quote = -2  # the next one, -1: none

    def record(end: int) -> None:
        nonlocal cells, errors, cell, closed
        found = dict.fromkeys([*errors, *([UNCLOSED] if quoted else [])])
        rows.append((text[start:end], [*cells, cell], list(found)))
        cells, errors, cell, closed = [], [], "", False

    while at < len(text):
        if at == start and not quoted:  # lines before the one of the next quote are cut as they are
            if -1 != quote < at:
                quote = text.find('"', at)
            end = len(text) if quote < 0 else max(text.rfind("\n", at, quote), text.rfind("\r", at, quote)) + 1
            if end > at:
                lines = LINE_END.split(text[at:end])
                rows += [(line, line.split(delimiter), []) for line in (lines if lines[-1] else lines[:-1])]
                at = start = end
                continue
        part = piece.match(text, at).group()
        at += len(part)
        if part == '"' and quoted:
            if text.startswith('"', at):
                cell, at = cell + part, at + 1
            else:
                quoted, closed = False, True
        elif part == '"' and not cell and not closed:
            quoted = True
        elif part == '"':
            errors.append(STRAY_QUOTE)
            cell += part
        elif quoted:
            cell += part
        elif part == delimiter:
            cells.append(cell)
            cell, closed = "", False
        elif part[0] in "\r\n":
            record(at - len(part))
            start = at
        else:
            if closed and part.strip():
                errors.append(AFTER_QUOTE)
            cell += part
    if start < len(text):
        record(len(text))
    return rows


@F.arrow_udf(T.ArrayType(ROW))
def _scan(texts: pa.Array, delimiters: pa.Array) -> pa.Array:
    found = [None if t is None or d is None else scanned(t, d) for t, d in zip(texts.to_pylist(), delimiters.to_pylist())]
    rows = [row for rows in found for row in rows or ()]

    def lists(values: list, n: list[int], none: list[bool] | None = None) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(n)], pa.int32()), values, mask=pa.array(none) if none else None)

    parts = [lists(pa.array([x for row in rows for x in row[k]], pa.string()), [len(row[k]) for row in rows]) for k in (1, 2)]
    whole = pa.StructArray.from_arrays([pa.array([row[0] for row in rows], pa.string()), *parts], ["original", "cells", "errors"])
    return lists(whole, [len(x or ()) for x in found], [x is None for x in found])


def _lines(text: Column) -> Column:
    lines = F.split(text, "\r\n|\r|\n")
    return let(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def _tokens(line: Column) -> Column:
    return F.split(trimmed(line), r"(?U)\s+")


def _cut(line: Column, bounds: Column) -> Column:
    starts = F.concat(F.array(F.lit(0)), bounds)
    ends = F.concat(bounds, F.array(F.length(line)))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(line, x["a"] + 1, F.greatest(x["b"] - x["a"], F.lit(0))))


def cells_of(text: Column, strategy: Column, delimiter: Column, bounds: Column) -> Column:
    """The rows of a text as one interpretation reads them."""
    row = lambda line, cells: F.struct(line.alias("original"), cells.alias("cells"), F.array().cast("array<string>").alias("errors"))
    asked = strategy == "delimited"
    return (
        F.when(asked, _scan(F.when(asked, text), F.when(asked, delimiter)))
        .when(strategy == "whitespace", F.transform(_lines(text), lambda x: row(x, _tokens(x))))
        .otherwise(F.transform(_lines(text), lambda x: row(x, _cut(x, bounds))))
    )


def boundaries(text: Column) -> Column:
    """Where columns begin: after positions that are blank in up to 100 lines with digits and four words."""
    useful = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike(r"\d") & (F.size(_tokens(x)) >= 4))

    def found(lines: Column) -> Column:
        width = F.least(F.array_min(F.transform(lines, F.length)), F.lit(2000))
        blank = lambda i: F.forall(lines, lambda x: F.substring(x, i + 1, 1).rlike(r"(?U)^\s"))
        gaps = F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda i: (i > 0) & blank(i))
        ends = let(gaps, lambda g: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i > 0) & ~F.get(g, i) & F.coalesce(F.get(g, i - 1), F.lit(False))))
        return F.when(F.size(lines) < 2, F.array().cast("array<int>")).otherwise(ends)

    return let(F.slice(useful, 1, 100), found)


# --- interpretations ---------------------------------------------------------------------------------------------


def readable(files: DataFrame) -> DataFrame:
    return short_batches(files).where(F.col("text").isNotNull()).select("path", F.regexp_replace("text", "^\ufeff", "").alias("text"))


def over(value: Column, most: int | None) -> Column:
    return F.lit(False) if most is None else value > most


def interpretations(files: DataFrame, bounds: list[int] | None = None, *, limits: Limits = Limits()) -> DataFrame:
    """path and, for each interpretation, candidate, strategy, delimiter, bounds, width and score (0 to 100): 35 for rows of equal
    width, 45 for cells of a known shape, up to 20 for known headings. Small rows: the texts stay behind."""
    small = readable(files).where(~over(F.length("text"), limits.characters))
    wanted = F.array(*map(F.lit, sorted({b for b in bounds if 0 < b <= 10_000}))).cast("array<int>") if bounds is not None else boundaries(F.col("text"))
    one = lambda name, strategy, d=None: F.struct(F.lit(name).alias("candidate"), F.lit(strategy).alias("strategy"), F.lit(d).cast("string").alias("delimiter"))
    kinds = [*(one(f"delimiter-{i}", "delimited", d) for i, d in enumerate(DELIMITERS)), one("whitespace", "whitespace"), one("fixed-width", "fixed-width")]
    tried = small.withColumn("bounds", wanted).select("*", F.inline(F.array(*kinds)))
    rows = cells_of(F.substring("text", 1, SAMPLE), F.col("strategy"), F.col("delimiter"), F.col("bounds"))
    active = F.slice(F.filter("_rows", lambda r: r["original"].rlike(r"(?U)\S") & ~r["original"].rlike(r"(?U)^\s*[#;]")), 1, 200)
    known = lambda cells, test: F.size(F.filter(cells, test))
    sized = tried.withColumn("_rows", rows).withColumn("_active", F.transform(active, lambda r: F.transform(r["cells"], trimmed))).withColumn("_sizes", F.transform("_active", F.size))
    most = F.array_max(F.transform(F.array_distinct("_sizes"), lambda w: F.struct(F.size(F.filter("_sizes", lambda x: x == w)).alias("n"), w.alias("w"))))
    named = F.coalesce(F.array_max(F.transform("_active", lambda cells: known(cells, lambda c: field_of(c) != ""))), F.lit(0))
    seen = F.aggregate("_active", F.lit(0), lambda n, cells: n + known(cells, evidence))
    scored = sized.select(
        "path", "candidate", "strategy", "delimiter", "bounds", F.size("_active").alias("_n"), most.alias("_most"), seen.alias("_seen"), named.alias("_named"),
        (F.exists("_rows", lambda r: over(F.size(r["cells"]), limits.columns)) | over(F.size("_rows"), limits.rows)).alias("_over"),
    )
    width = F.coalesce("_most.w", F.lit(0))
    share = F.col("_most.n") / F.col("_n") * 35 + F.col("_seen") / (F.col("_n") * width) * 45 + F.least(F.lit(20), F.col("_named") * 3)
    score = F.when(F.col("_over"), -1.0).when(width < 2, 0.0).otherwise(F.round(F.least(F.lit(100.0), share), 2))
    return scored.select("path", "candidate", "strategy", "delimiter", "bounds", width.alias("width"), score.alias("score"))


def chosen(candidates: DataFrame, candidate: str | None = None) -> DataFrame:
    """One interpretation a file: the one asked for, else the one of the best score, the first by name of equals."""
    if candidate:
        return candidates.where(F.col("candidate") == candidate)
    best = F.min_by(F.struct(*candidates.columns), F.struct(-F.col("score"), F.col("candidate")))
    return candidates.groupBy("path").agg(best.alias("_best")).select("_best.*")


# --- rows and columns --------------------------------------------------------------------------------------------


def column(name, field="", unit="auto", confidence=0.0, constant=None, upper=False, date_order=None, locked=False) -> Column:
    """A column of a session. One that a user has set is locked; a constant stands for its cells."""
    given = {"name": name, "field": field, "unit": unit, "confidence": confidence, "constant": constant, "upper": upper, "date_order": date_order, "locked": locked}
    kinds = {"confidence": "double", "upper": "boolean", "locked": "boolean"}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds.get(k, "string")).alias(k) for k, v in given.items()])


def sessions(files: DataFrame, picked: DataFrame | None = None, *, limits: Limits = Limits()) -> DataFrame:
    """path, candidate, score, columns (as column() makes them), rows (nth, original, cells, kind, errors, and
    originals: what stood in each cell before edits, null without any), metadata, grouped and rejected, of each file as chosen()
    reads it."""
    picked = chosen(interpretations(files, limits=limits)) if picked is None else picked
    df = readable(files).join(picked, "path", "left").withColumn("_long", over(F.length("text"), limits.characters))
    df = df.withColumn("text", F.when(F.col("_long"), "").otherwise(F.col("text"))).withColumn("strategy", F.coalesce("strategy", F.lit("whitespace")))
    df = df.withColumn("_all", cells_of(F.col("text"), F.col("strategy"), F.col("delimiter"), F.col("bounds")))
    total = F.aggregate("_all", F.lit(0), lambda n, r: n + F.size(r["cells"]))
    rejected = F.when(F.col("_long"), "characters").when(over(F.size("_all"), limits.rows), "rows").when(F.exists("_all", lambda r: over(F.size(r["cells"]), limits.columns)), "columns").when(over(total, limits.cells), "cells")
    df = df.withColumn("rejected", rejected).withColumn("_all", F.when(F.col("rejected").isNull(), F.col("_all")).otherwise(F.slice("_all", 1, 0)))
    dated = lambda r: F.exists(r["cells"], lambda c: is_date(trimmed(c)))
    headings = lambda r: F.size(F.filter(r["cells"], lambda c: let(trimmed(c), field_of) != ""))
    # Rows after the first that is a heading are passed over.
    head = F.aggregate(F.slice("_all", 1, 30), F.lit(None).cast(ROW), lambda found, r: F.when(found.isNotNull(), found).when(~dated(r) & (headings(r) >= 2), r))
    df = df.withColumn("_header", head).withColumn("_names", F.transform("_header.cells", trimmed)).withColumn("_title", trimmed(F.col("_header.original")))
    words = F.regexp_replace(F.lower(F.coalesce("_header.original", F.lit(""))), r"(?U)\s+", " ")
    signed = F.lit(False)
    for signature in SIGNATURES:
        parts = F.lit(True)
        for part in signature:
            parts = parts & words.contains(part)
        signed = signed | parts
    df = df.withColumn("grouped", signed & F.col("strategy").isin("whitespace", "fixed-width"))
    wanted = F.array(*map(F.lit, ("QSO_DATE", "TIME_ON", "CALL")))
    header_fields = F.coalesce(F.transform("_names", field_of), F.array().cast("array<string>"))
    # Where the fields that tell a contact are, an array for each.
    places_of = F.transform(wanted, lambda f: F.filter(F.transform("_fields", lambda x, i: F.when(x == f, i)), lambda i: i.isNotNull()))
    df = df.withColumn("_fields", header_fields).withColumn("_wanted", places_of)

    def kind(r: Column) -> Column:
        def of(text: Column) -> Column:
            filled = F.filter("_wanted", lambda at: F.exists(at, lambda i: trimmed(F.coalesce(F.get(r["cells"], i), F.lit(""))) != ""))
            return (
                F.when(text == "", "blank").when(text == F.col("_title"), "header").when(
                    F.col("grouped") & r["original"].rlike(r"(?i)YYYYMMDD\s+HHMM") & ~F.exists(r["cells"], lambda c: c.rlike(r"^\d{8}$")), "header")
                .when(F.size(filled) >= 2, "qso").when(text.rlike(r"^([-=_*]{3,}|#|//)"), "comment")
                .when(text.rlike(r"(?i)^(total\b|summary\b|page\s+\d|\d+\s+qsos?\b)"), "summary")
                .when(text.rlike(r"^[A-Za-z][\w -]{1,35}\s*[:=]") & ~dated(r), "metadata").otherwise("qso")
            )

        return let(trimmed(r["original"]), of)

    last = F.when(F.col("grouped"), len(GROUPED) - 1).when(F.element_at("_fields", -1) == "COMMENT", F.size("_fields") - 1)
    df = df.withColumn("_tail", F.when((F.col("strategy") == "whitespace") & (F.size("_fields") > 0), last))

    def shaped(r: Column, i: Column) -> Column:
        rest = F.regexp_replace(r["original"], F.concat(F.lit(r"(?U)^\s*(?:\S+\s+){"), F.col("_tail").cast("string"), F.lit("}")), F.lit(""))
        joined = F.concat(F.slice(r["cells"], 1, F.col("_tail")), F.array(F.regexp_replace(rest, r"(?U)\s+$", "")))
        long = lambda k: (k == "qso") & F.coalesce(F.size(r["cells"]) > F.col("_tail") + 1, F.lit(False))
        return let(kind(r), lambda k: F.struct(i.alias("nth"), r["original"].alias("original"), F.when(long(k), joined).otherwise(r["cells"]).alias("cells"), k.alias("kind"), r["errors"].alias("errors"), F.lit(None).cast("array<string>").alias("originals")))

    df = df.withColumn("rows", F.transform("_all", shaped)).withColumn("_data", F.filter("rows", lambda r: r["kind"] == "qso"))
    sizes = F.transform(F.slice("_data", 1, 200), lambda r: F.size(r["cells"]))
    width = F.greatest(F.size("_fields"), F.coalesce(F.array_max(sizes), F.lit(0)), F.when(F.col("grouped"), len(GROUPED)).otherwise(0))
    df = df.withColumn("_width", width).withColumn("_seen", F.slice("_data", 1, 100))
    places = F.when(F.col("_width") > 0, F.sequence(F.lit(0), F.col("_width") - 1)).otherwise(F.array().cast("array<int>"))
    group = F.array(*map(F.lit, GROUPED))
    given = lambda i: F.coalesce(F.when(F.col("grouped"), F.get(group, i)).otherwise(F.when(F.get("_names", i) != "", F.get("_names", i))), F.concat(F.lit("COLUMN_"), (i + 1).cast("string")))
    df = df.withColumn("_titles", F.transform(places, given)).withColumn("_first", F.transform("_titles", field_of))

    def shares(i: Column) -> Column:
        values = F.transform("_seen", lambda r: trimmed(F.coalesce(F.get(r["cells"], i), F.lit(""))))
        unnamed = F.get("_first", i) == ""

        def of(v: Column, some: Column, calls: Column, grids: Column) -> Column:
            most = lambda n, of: n > F.size(of) * 0.8
            tests = {"date": is_date, "mode": is_mode, "freq": _frequency, "time": is_time}
            return F.struct(
                *[(unnamed & most(F.size(F.filter(some, test)), some)).alias(name) for name, test in tests.items()], most(calls, some).alias("call"),
                most(grids, some).alias("grid"), most(calls, v).alias("calls"), most(grids, v).alias("grids"),
            )

        count = lambda v, test: F.size(F.filter(v, test))
        return let(values, lambda v: let(F.filter(v, lambda x: x != ""), lambda some: let(count(some, is_call), lambda calls: let(count(some, is_grid), lambda grids: of(v, some, calls, grids)))))

    # Only columns that no heading names are looked at.
    df = df.withColumn("_shares", F.when(F.exists("_first", lambda f: f == ""), F.transform(places, shares)))
    only = lambda name: F.size(F.filter("_shares", lambda s: s[name])) == 1

    def infer(fields: Column, i: Column) -> Column:
        s = F.get("_shares", i)
        guess = (
            F.when(s["date"], "QSO_DATE").when(s["mode"], "MODE").when(s["freq"], "FREQ").when(s["time"] & F.array_contains(fields, "QSO_DATE"), "TIME_ON")
            .when(s["call"] & only("calls"), "CALL").when(s["grid"] & only("grids"), "GRIDSQUARE")
        )
        return let(guess, lambda g: F.when((F.get(fields, i) != "") | g.isNull() | F.array_contains(fields, g), fields).otherwise(F.transform(fields, lambda f, j: F.when(j == i, g).otherwise(f))))

    df = df.withColumn("_named", F.aggregate(places, F.col("_first"), infer))
    unit = lambda name: F.when(name.rlike("(?i)khz"), "kHz").when(name.rlike("(?i)mhz"), "MHz").otherwise("auto")
    sure = lambda i: F.when(F.get("_first", i) != "", 0.98).when(F.get("_named", i) != "", 0.85).otherwise(0.0)
    shown = lambda i: column(F.get("_titles", i), F.get("_named", i), unit(F.get("_titles", i)), sure(i))
    pairs = F.transform(F.filter("rows", lambda r: r["kind"] == "metadata"), lambda r: F.struct(
        trimmed(F.regexp_extract(r["original"], r"^\s*([^:=]+)[:=]", 1)).alias("k"), trimmed(F.regexp_extract(r["original"], r"^\s*[^:=]+[:=]\s*(.*)$", 1)).alias("v")))
    standing = let(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"])))
    return df.select("path", "candidate", "score", F.transform(places, shown).alias("columns"), "rows", F.map_from_entries(standing).alias("metadata"), "grouped", "strategy", "rejected")


def _frequency(s: Column) -> Column:
    value = F.regexp_replace(s, ",", ".").try_cast("double")
    return s.rlike(r"^\d+[.,]\d+$") & (F.size(_units(value)) > 0)


def _units(value: Column) -> Column:
    """The units in which a number lies in a band."""
    fits = lambda div, name: F.when(radio.import_frequency_band(value / div) != "", F.lit(name))
    return F.array_compact(F.array(fits(1, "MHz"), fits(1000, "kHz"), fits(1_000_000, "Hz")))


# --- contacts ----------------------------------------------------------------------------------------------------

CAPITALS = ["CALL", "STATION_CALLSIGN", "GRIDSQUARE", "MY_GRIDSQUARE", "MODE", "SUBMODE", "BAND", "OPERATOR"]
ISSUE = "array<struct<code:string,field:string,severity:string>>"


def _checked(value: Column, code: Column) -> Column:
    return F.struct(value.alias("value"), code.alias("code"))


def _date(v: Column, order: Column) -> Column:
    part = lambda pattern, k: F.regexp_extract(v, pattern, k)
    iso, last = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    joined = lambda y, m, d: F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    a, b, y = part(last, 1), part(last, 2), part(last, 3)
    over = lambda x: x.try_cast("int") > 12
    day_first = (order == "dmy") | ((order != "mdy") & over(a))
    digits = (
        F.when(v.rlike(r"^\d{8}$"), v).when(v.rlike(iso), joined(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(v.rlike(last) & day_first, joined(y, b, a)).when(v.rlike(last) & ((order == "mdy") | over(b)), joined(y, a, b))
    )

    def judged(d: Column) -> Column:
        fine = F.try_to_date(d, "yyyyMMdd").isNotNull()
        return _checked(F.when(fine, d).otherwise(v), F.when(d.isNull() & v.rlike(last), "ambiguous-date").when(~F.coalesce(fine, F.lit(False)), "invalid-date"))

    return let(digits, judged)


def _time(v: Column) -> Column:
    clock = r"(?i)^(\d{1,2}):(\d{2})(?::(\d{2}))?Z?$"
    compact = F.when(v.rlike(clock), F.concat(F.lpad(F.regexp_extract(v, clock, 1), 2, "0"), F.regexp_extract(v, clock, 2), F.regexp_extract(v, clock, 3))).otherwise(F.regexp_replace(v, "(?i)Z$", ""))
    return let(compact, lambda t: _checked(t, F.when(~t.rlike(r"^([01]\d|2[0-3])[0-5]\d([0-5]\d)?$"), "invalid-time")))


def _megahertz(v: Column, unit: Column) -> Column:
    text = F.regexp_replace(v, ",", ".")
    number = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))

    def judged(n: Column) -> Column:
        def by_unit(fits: Column) -> Column:
            used = F.when(unit != "auto", unit).when(F.size(fits) == 1, F.get(fits, F.lit(0)))
            mhz = n / F.when(used == "Hz", 1e6).when(used == "kHz", 1e3).otherwise(1.0)
            shown = F.regexp_replace(F.regexp_replace(F.format_string("%.9f", mhz), "0+$", ""), r"\.$", "")
            bad = n.isNull() | (n <= 0)
            return _checked(F.when(bad, v).otherwise(shown), F.when(bad, "invalid-frequency").when(used.isNull(), "ambiguous-frequency"))

        return let(_units(n), by_unit)

    return let(number, judged)


def _normal(field: Column, raw: Column, unit: Column, date_order: Column, upper: Column) -> Column:
    """value and code (null if nothing is wrong) of one cell of a field."""

    def of(v: Column) -> Column:
        mode = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair]), v), v)
        return (
            F.when(field == "QSO_DATE", _date(v, date_order)).when(field == "TIME_ON", _time(v)).when(field == "FREQ", _megahertz(v, unit))
            .when(field == "MODE", _checked(mode, F.lit(None).cast("string")))
            .otherwise(_checked(v, F.when(field.isin("CALL", "STATION_CALLSIGN") & ~is_call(v), "invalid-call")
                .when(field.isin("GRIDSQUARE", "MY_GRIDSQUARE") & ~is_grid(v), "invalid-locator")
                .when(field.isin("STX", "SRX", "QSO_POINTS") & ~v.rlike(r"^\d+$"), "invalid-number")
                .when(field.isin("RST_SENT", "RST_RCVD") & ~v.rlike(r"^([1-5][1-9][1-9]?|[+-]\d{1,2})$"), "invalid-report")))
        )

    return let(F.when(field.isin(CAPITALS) | upper, F.upper(raw)).otherwise(raw), of)


def _changes(x: Column) -> Column:
    """What was done to a cell until it was a value, in order."""
    field, text, value = x["field"], x["text"], x["n"]["value"]
    capital = F.upper(text)
    return F.array_compact(F.array(
        F.when(x["edited"], "edited"), F.when(x["fixed"], "constant"), F.when(x["given"] != text, "trimmed"), F.when((field.isin(CAPITALS) | x["upper"]) & (text != capital), "case"),
        F.when((field == "QSO_DATE") & (value != text), "date"), F.when((field == "TIME_ON") & (value != trimmed(x["original"])), "time"),
        F.when((field == "FREQ") & (value != trimmed(x["original"])) & ~x["n"]["code"].eqNullSafe("invalid-frequency"), "frequency"),
        F.when((field == "MODE") & capital.isin(list(MODES)), F.concat(F.lit("mode:"), capital)),
    ))


def _lineage(x: Column, field: Column, value: Column, changes: Column) -> Column:
    """One value of a contact: the column and cell that it comes from, what was done to it, and how far it can be trusted."""

    def classed(done: Column) -> Column:
        errors = F.filter("_found", lambda i: (i["field"] == field) & (i["severity"] == "error"))
        unsure = (~x["locked"] & (x["confidence"] < 0.95)) | ((field == "FREQ") & (x["unit"] == "auto") & (F.size(done) > 0))
        sort = (
            F.when(F.exists(errors, lambda i: i["code"].rlike("ambiguous|conflict|duplicate-mapping")), "ambiguous").when(F.size(errors) > 0, "unsupported")
            .when(F.arrays_overlap(done, F.array(F.lit("edited"), F.lit("constant"))), "user-supplied").when(unsure, "suggested-repair")
            .when(F.size(done) > 0, "lossless-normalization").otherwise("preserved")
        )
        return F.struct(
            field.alias("field"), x["name"].alias("column"), x["place"].alias("place"), x["original"].alias("original"), value.alias("value"),
            x["confidence"].alias("confidence"), done.alias("changes"), sort.alias("class"),
        )

    return let(changes, classed)


def contacts(session: DataFrame, *, date_order: str = "auto", lineage: bool = False, repeats: bool = True) -> DataFrame:
    """path, nth, original, values (field to value), unmapped (column to cell) and issues (code, field, severity) of
    every row taken for a contact. Values that a check refuses stay as they are, beside their issue. date_order holds for
    columns without their own. Without repeats, rows that repeat have no issue of it.

    With lineage, also the lineage of every value: field, column, place (null where derived), original (the cell before any
    edit), value, confidence, changes and class (preserved, lossless-normalization, suggested-repair, user-supplied,
    ambiguous, unsupported); one entry for each cell that fills the field, in the order of columns."""
    df = session.select("path", "columns", "grouped", "strategy", F.inline(F.filter("rows", lambda r: r["kind"] == "qso")))
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    first_cell = lambda i: F.when(F.col("originals").isNull(), cell(i)).otherwise(F.coalesce(F.get("originals", i), F.lit("")))
    given = lambda c, i: F.coalesce(c["constant"], cell(i))
    df = df.withColumn("_texts", F.transform("columns", lambda c, i: trimmed(given(c, i))))
    text = lambda i: F.get("_texts", i)
    items = F.transform("columns", lambda c, i: F.when((c["field"] != "") & (text(i) != ""), F.struct(
        c["field"].alias("field"), F.when(c["field"] == "MODE", F.upper(text(i))).alias("raw"),
        _normal(c["field"], text(i), c["unit"], F.coalesce(c["date_order"], F.lit(date_order)), c["upper"]).alias("n"),
        *([text(i).alias("text"), c["unit"].alias("unit"), c["upper"].alias("upper"), c["name"].alias("name"), i.alias("place"), c["confidence"].alias("confidence"), c["locked"].alias("locked"),
           given(c, i).alias("given"), first_cell(i).alias("original"), (cell(i) != first_cell(i)).alias("edited"), c["constant"].isNotNull().alias("fixed")] if lineage else []),
    )))
    # What a contact's columns say of its cells is settled here, so that later steps needn't carry them.
    short = F.size("cells") < F.size("columns")
    full = F.forall(F.slice(F.transform("columns", lambda c, i: (c["field"] != "") & (trimmed(cell(i)) != "")), 1, F.size("cells")), lambda x: x)
    no_comment = F.col("grouped") & (F.col("strategy") == "whitespace") & (F.element_at("columns", -1)["field"] == "COMMENT") & (F.size("cells") == F.size("columns") - 1) & full
    df = df.withColumns({
        "_items": F.filter(items, lambda x: x.isNotNull()), "_short": short & ~F.coalesce(no_comment, F.lit(False)),
        "_extra": F.slice("cells", F.size("columns") + 1, F.size("cells")),
    })
    df = df.withColumn("_fields", F.transform("_items", lambda x: x["field"]))
    df = df.withColumn("_firsts", F.filter("_items", lambda x, i: F.array_position("_fields", x["field"]) == i + 1))
    value = lambda name: F.get("_items", F.array_position("_fields", F.lit(name)).cast("int") - 1)["n"]["value"]
    side = F.get(F.filter("_items", lambda x: (x["field"] == "MODE") & x["raw"].isin("USB", "LSB")), F.lit(0))["raw"]
    bad = lambda name: F.exists("_items", lambda x: (x["field"] == name) & x["n"]["code"].isNotNull())
    again = F.filter(F.when(F.size("_firsts") < F.size("_items"), F.col("_items")).otherwise(F.slice("_items", 1, 0)), lambda x: F.exists("_firsts", lambda y: (y["field"] == x["field"]) & (y["n"]["value"] != x["n"]["value"])))
    df = df.withColumns({"_side": side, "_sub": value("SUBMODE"), "_own": value("BAND"), "_freq": value("FREQ"), "_again": again})
    df = df.withColumn("_band", radio.import_frequency_band(F.col("_freq").try_cast("double")))
    more = lambda name, v, cond: F.when(cond, F.array(F.struct(F.lit(name).alias("key"), v.alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    banded = (F.col("_band") != "") & F.col("_own").isNull() & ~bad("FREQ") & ~F.exists("_again", lambda x: x["field"] == "FREQ")
    entries = F.concat(
        F.transform("_firsts", lambda x: F.struct(x["field"].alias("key"), x["n"]["value"].alias("value"))),
        more("SUBMODE", F.col("_side"), F.col("_side").isNotNull() & F.col("_sub").isNull()),
        more("BAND", F.col("_band"), banded),
    )
    df = df.withColumn("values", F.map_from_entries(entries))
    issue = lambda code, field=None, severity="error": F.struct(F.lit(code).alias("code"), (field if isinstance(field, Column) else F.lit(field).cast("string")).alias("field"), F.lit(severity).alias("severity"))
    if_so = lambda cond, made: F.when(cond, F.array(made)).otherwise(F.array().cast(ISSUE))
    has = lambda name: F.map_contains_key("values", F.lit(name))
    found = [
        if_so(F.col("_short"), issue("structure")),
        F.transform("errors", lambda e: issue("malformed-record")),
        F.transform(F.filter("_items", lambda x: x["n"]["code"].isNotNull()), lambda x: F.struct(x["n"]["code"].alias("code"), x["field"].alias("field"), F.lit("error").alias("severity"))),
        F.transform("_again", lambda x: issue("duplicate-mapping", x["field"])),
        if_so(F.col("_side") != F.col("_sub"), issue("submode-conflict", "SUBMODE")),
        if_so((F.col("_band") != "") & (F.col("_band") != F.col("_own")), issue("band-conflict", "BAND")),
        *[if_so(~has(name), issue("missing-field", name)) for name in ("QSO_DATE", "TIME_ON", "CALL", "MODE")],
        if_so(~has("FREQ") & ~has("BAND"), issue("missing-field", "FREQ")),
        F.transform("_extra", lambda c: issue("extra-cell", severity="warning")),
    ]
    twice = F.row_number().over(Window.partitionBy("path", F.to_json("values")).orderBy("nth")) > 1 if repeats else F.lit(False)
    made = df.withColumn("_found", F.concat(*[x.cast(ISSUE) for x in found])).withColumn("_twice", twice)
    left = F.filter(F.transform("columns", lambda c, i: F.struct(F.concat(F.lit("column-"), i.cast("string")).alias("key"), F.when(c["field"] == "", first_cell(i)).alias("value"))), lambda x: x["value"].isNotNull())
    extra = F.transform("_extra", lambda c, i: F.struct(F.concat(F.lit("extra-"), i.cast("string")).alias("key"), c.alias("value")))
    sides = F.filter("_items", lambda x: (x["field"] == "MODE") & x["raw"].isin("USB", "LSB"))
    none = lambda kind: F.lit(None).cast(kind)
    band = F.struct(
        F.lit("BAND").alias("field"), F.lit("derived").alias("column"), none("int").alias("place"), F.col("_freq").alias("original"), F.col("_band").alias("value"),
        F.lit(1.0).alias("confidence"), F.array(F.lit("band")).alias("changes"), F.lit("lossless-normalization").alias("class"),
    )
    lines = lambda: F.concat(
        F.transform("_items", lambda x: _lineage(x, x["field"], x["n"]["value"], _changes(x))),
        F.transform(sides, lambda x: _lineage(x, F.lit("SUBMODE"), x["raw"], F.array_append(_changes(x), F.lit("submode")))),
        F.filter(F.array(band), lambda x: F.coalesce(banded, F.lit(False))),
    )
    return made.select(
        "path", "nth", "original", "values", F.map_from_entries(F.concat(left, extra)).alias("unmapped"),
        F.concat("_found", if_so(F.col("_twice"), issue("duplicate-row", severity="warning")).cast(ISSUE)).alias("issues"),
        *([lines().alias("lineage")] if lineage else []),
    )
