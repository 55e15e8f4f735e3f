"""Contact lines of many contests in one plan, and repairs of Cabrillo files.

Each log finds its contest's layout by a join; the columns of a line are then an array that differs from row to row, and
cells are cut by it. Repairs are rows (keys, line_no, before, after) that are made, looked at, and applied only where the
line still reads as before. Columns count characters. A null text has no lines; a line end stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qsolake.functions.radio import frequency_to_khz, trimmed
from qsolake.functions.values import mapped
from qsolake.sources import logs as source

LAYOUT = "contest string, minimum_length int, separators array<int>, fields array<struct<name:string,width:int>>"
# The layout of the contests with QTCs, whose lines may also be cut by blanks; the endings that a contest's
# name may have beyond its layout's; the fields that make up an exchange; the codes of modes in a contact line.
COMPACT = "DARC-WAEDC-"
WAE_CONTESTS = ("DARC-WAEDC-CW", "DARC-WAEDC-SSB", "DARC-WAEDC-RTTY")
WAE_FIELDS = [("MY_CALL", 13), ("RST_SENT", 3), ("STX_STRING", 6), ("CALL", 13), ("RST_RCVD", 3), ("SRX_STRING", 6), ("TRANSMITTER_ID", 1)]
WAE_SEPARATORS = [4, 10, 13, 24, 29, 43, 47, 54, 68, 72, 79]
ENDINGS = ("-CW", "-SSB", "-RTTY")
SENT, RECEIVED = ("STX", "STX_STRING"), ("SRX", "SRX_STRING", "GRIDSQUARE")
MODE_CODES = {
    "AMTORFEC": "AM", "CONTESTI": "CO", "DOMINO": "DO", "DOMINOF": "DO", "HELL": "HE", "HELL80": "HE", "MFSK8": "MF", "MFSK16": "MK", "OLIVIA": "OL", "PAC": "PT", "PAC2": "PT",
    "PAC3": "PT", "PKT": "AX", "PSK31": "PS", "PSK63": "PM", "PSK125": "PO", "QPSK63": "QM", "RTTYM": "RY", "SSTV": "TV", "THRB": "TH", "FT4": "DG", "FT8": "DG",
    "CW": "CW", "SSB": "PH", "USB": "PH", "LSB": "PH", "FM": "FM", "AM": "AM", "RTTY": "RY",
}
PREFIX = "(?i)^\\s*X?-?QSO:\\s*"


def layout_table(spark: SparkSession, layouts: DataFrame | None = None) -> DataFrame:
    """contest, layout: one row for every name that a layout serves; an exact name goes before one with an ending, of
    layouts that share a name the smallest counts. layouts has the columns of LAYOUT; the contests with QTCs are built in."""
    own = spark.createDataFrame([(c, 79, WAE_SEPARATORS, WAE_FIELDS) for c in WAE_CONTESTS], LAYOUT)
    if layouts is not None:
        own = own.unionByName(layouts.join(own, "contest", "left_anti").select(own.columns))
    name = F.upper(trimmed(F.col("contest")))
    body = own.select(name.alias("name"), F.struct(name.alias("name"), "minimum_length", "separators", "fields").alias("layout"))
    served = F.array(F.struct(F.lit(0).alias("rank"), F.col("name").alias("contest")), *[F.struct(F.lit(1).alias("rank"), F.concat("name", F.lit(e)).alias("contest")) for e in ENDINGS])
    rows = body.select("layout", F.inline(served))
    return rows.groupBy("contest").agg(F.min(F.struct("rank", "layout"))["layout"].alias("layout"))


def with_layout(logs: DataFrame, table: DataFrame, text_col: str = "text") -> DataFrame:
    """logs with contest (of the first CONTEST line, GENERIC-CONTEST without one), layout and columns (name, start, stop)."""
    heads = F.filter(source.split_lines(F.col(text_col)), lambda x: x.rlike("(?i)^\\s*CONTEST:"))
    contest = F.coalesce(F.upper(trimmed(F.regexp_extract(F.get(heads, F.lit(0)), source.HEADER, 2))), F.lit("GENERIC-CONTEST"))
    column = lambda n, a, b: F.struct(F.lit(n).alias("name"), F.lit(a).alias("start"), F.lit(b).alias("stop"))
    fields = F.col("layout.fields")
    start = lambda i: F.aggregate(F.slice(fields, F.lit(1), i), F.lit(30), lambda at, f: at + f["width"] + 1)
    own = F.transform(fields, lambda f, i: F.struct(f["name"].alias("name"), start(i).alias("start"), (start(i) + f["width"]).alias("stop")))
    columns = F.when(F.col("layout").isNull(), F.array(*[column(*c) for c in source.CABRILLO_GENERIC])).otherwise(F.concat(F.array(*[column(*c) for c in source.CABRILLO_COMMON]), own))
    return logs.withColumn("contest", contest).join(table, "contest", "left").withColumn("columns", columns)


def fixed_width(raw: Column) -> Column:
    """Whether a line of the layout beside it is long enough and blank between its columns."""
    line = F.when(raw.startswith("X-QSO:"), F.substring(raw, 3, 1 << 30)).otherwise(raw)
    return (F.length(line) >= F.col("layout.minimum_length")) & F.forall("layout.separators", lambda at: F.substring(line, at + 1, F.lit(1)).rlike("^\\s?$"))


def cells(raw: Column) -> Column:
    """The cells (name, value, width) of a contact line, by the columns beside it: cut at them where there is a layout and
    the line starts with QSO: (X-QSO:), else by blanks, as are lines of the contests with QTCs that aren't of fixed width."""
    line = F.when(raw.startswith("X-QSO:"), F.substring(raw, 3, 1 << 30)).otherwise(raw)
    cut = F.col("layout").isNotNull() & line.startswith("QSO:") & (~F.col("layout.name").startswith(COMPACT) | fixed_width(raw))
    parts = F.split(trimmed(F.regexp_replace(raw, PREFIX, "")), "\\s+")
    width = lambda c: c["stop"] - c["start"]
    return F.transform("columns", lambda c, i: F.struct(
        c["name"].alias("name"), F.when(F.coalesce(cut, F.lit(False)), trimmed(F.substring(line, c["start"] + 1, width(c)))).otherwise(F.coalesce(F.get(parts, i), F.lit(""))).alias("value"),
        width(c).alias("width")))


def cell(cells_: Column, name: str) -> Column:
    return F.coalesce(F.get(F.filter(cells_, lambda c: c["name"] == name), F.lit(0))["value"], F.lit(""))


def exchange(cells_: Column, names: tuple[str, ...]) -> Column:
    """The filled cells of those names, in the order of the line."""
    return F.array_join(F.transform(F.filter(cells_, lambda c: c["name"].isin(*names) & (c["value"] != "")), lambda c: c["value"]), " ")


def aligned(cells_: Column, excluded: Column) -> Column:
    """A contact line with every cell cut and filled to its column."""
    line = F.array_join(F.transform(cells_, lambda c: F.concat(F.lit(" "), F.rpad(F.substring(c["value"], F.lit(1), c["width"]), c["width"], F.lit(" ")))), "")
    return F.concat(F.when(excluded, "X-QSO:").otherwise("QSO:"), F.regexp_replace(line, "\\s+$", ""))


def contest_contacts(logs: DataFrame, table: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each contact line of logs of any contests: the keys of logs, contest, layout (its name), line_no,
    excluded, cells, and what is read from them. table: layout_table()."""
    keys = [c for c in logs.columns if c != text_col]
    rows = with_layout(logs, table, text_col).select(*keys, "contest", "layout", "columns", F.posexplode(source.split_lines(F.col(text_col))).alias("nth", "raw"))
    # Rows of one element: what a cell is made of isn't copied into every expression that reads one.
    made = rows.where(F.col("raw").rlike("(?i)^\\s*(X-)?QSO:")).select(*keys, "contest", "layout", "nth", "raw", F.explode(F.array(cells(F.col("raw")))).alias("cells"))
    read = {"frequency": "FREQUENCY", "mode": "MODE", "date": "QSO_DATE", "time": "TIME_ON", "my_call": "MY_CALL", "call": "CALL", "sent_rst": "RST_SENT", "received_rst": "RST_RCVD"}
    return made.select(
        *keys, "contest", F.col("layout.name").alias("layout"), (F.col("nth") + 1).alias("line_no"), F.col("raw").startswith("X-QSO:").alias("excluded"), "cells",
        *[cell(F.col("cells"), n).alias(c) for c, n in read.items()], exchange(F.col("cells"), SENT).alias("sent_exchange"), exchange(F.col("cells"), RECEIVED).alias("received_exchange"),
    )


# --- repairs -----------------------------------------------------------------------------------------------------


def tabs_expanded(line: Column) -> Column:
    """Tabs filled up to the next column that 8 divides: after each one the count starts anew, so no part needs another's."""
    parts = F.split(line, "\t")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.repeat(F.lit(" "), (8 - F.length(p) % 8).cast("int")))).otherwise(p)), "")


def repairs(logs: DataFrame, table: DataFrame, text_col: str = "text", deprecated: dict[str, str] | None = None) -> DataFrame:
    """The keys of logs, line_no, before, after, reasons: a row for each line that can be mended.

    Blanks at the end go, tabs become spaces; in contact lines dates, times, modes and frequencies are brought to their
    form and the cells to their columns. Cells beyond the last column and beyond their width are cut then, so look before
    applying. deprecated: old mode names and what they are called now."""
    keys = [c for c in logs.columns if c != text_col]
    rows = with_layout(logs, table, text_col).select(*keys, "layout", "columns", F.posexplode(source.split_lines(F.col(text_col))).alias("nth", "raw"))
    rows = rows.where(F.col("raw").rlike("[ \\t]$") | F.col("raw").rlike("\\t|(?i)^\\s*(X-)?QSO:"))
    short = F.regexp_replace("raw", "[ \\t]+$", "")
    rows = rows.withColumn("tabs", F.instr(short, "\t") > 0).withColumn("plain", tabs_expanded(short)).withColumn("contact", F.col("raw").rlike("(?i)^\\s*(X-)?QSO:"))
    rows = rows.select("*", F.explode(F.array(F.when(F.col("contact"), cells(F.col("plain"))))).alias("cells"))
    of = lambda name: cell(F.col("cells"), name)
    upper = F.upper(of("MODE"))
    now = F.coalesce(mapped(upper, deprecated), upper) if deprecated else upper
    code = F.coalesce(mapped(now, MODE_CODES), now)
    digits, clock = of("QSO_DATE").rlike("^\\d{8}$"), of("TIME_ON").rlike("^\\d{1,2}:\\d{2}$")
    khz = frequency_to_khz(of("FREQUENCY"))
    mhz = of("FREQUENCY").rlike("^\\d{1,3}[.,]\\d+$") & (khz != of("FREQUENCY"))
    new = {
        "QSO_DATE": (digits, F.regexp_replace(of("QSO_DATE"), "^(.{4})(..)(..)$", "$1-$2-$3"), F.lit("Normalize date to YYYY-MM-DD")),
        "TIME_ON": (clock, F.lpad(F.replace(of("TIME_ON"), F.lit(":"), F.lit("")), 4, "0"), F.lit("Normalize time to HHMM")),
        "MODE": (code != upper, code, F.concat(F.lit("Map mode "), upper, F.lit(" to "), code)),
        "FREQUENCY": (mhz, khz, F.lit("Normalize frequency to kHz")),
    }
    rows = rows.select("*", F.inline(F.array(F.struct(*[F.when(w, v).alias(f"new_{n}") for n, (w, v, _) in new.items()], F.filter(F.array(
        F.when(F.col("tabs"), "Expand tabs to fixed-width spaces"), *[F.when(F.col("contact") & w, r) for w, _, r in new.values()]), lambda r: r.isNotNull()).alias("found")))))

    def renewed(c: Column) -> Column:
        value = F.coalesce(*[F.when(c["name"] == n, F.col(f"new_{n}")) for n in new], c["value"])
        return F.struct(c["name"].alias("name"), value.alias("value"), c["width"].alias("width"))

    held = F.transform("cells", renewed)
    compact = F.col("layout.name").startswith(COMPACT) & ~fixed_width(F.col("plain")) & (F.size(F.split(trimmed(F.col("plain")), "\\s+")) >= 11)
    align = F.col("contact") & (of("CALL") != "") & (F.col("layout").isNotNull() | (F.size("found") > 0)) & ~F.coalesce(compact, F.lit(False))
    out = rows.withColumn("after", F.when(align, aligned(held, F.col("plain").rlike("^\\s*X-QSO:"))).otherwise(F.col("plain")))
    realigned = F.when(align & (F.col("after") != F.col("plain")) & F.col("layout").isNotNull(), F.array(F.concat(F.lit("Realign to "), "layout.name", F.lit(" columns")))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat("found", realigned)
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("Remove trailing whitespace"))).otherwise(reasons)
    return out.where("after <> raw").select(*keys, (F.col("nth") + 1).alias("line_no"), F.col("raw").alias("before"), "after", reasons.alias("reasons"))


def _held(logs: DataFrame, changes: DataFrame, text_col: str) -> DataFrame:
    """The lines of logs that have changes, with nth, line, its end, the changes' text, and state, and changes without a line."""
    keys = [c for c in logs.columns if c != text_col]
    one = changes.groupBy(*keys, "line_no").agg(F.min("before").alias("before"), F.min("after").alias("after"), F.count_distinct("before", "after").alias("versions"))
    cut = F.split(F.col(text_col), "(?<=\\n)|(?<=\\r)(?!\\n)")
    rows = logs.join(changes.select(*keys).distinct(), keys, "left_semi").select(*keys, F.posexplode(cut).alias("nth", "piece"))
    rows = rows.withColumn("line", F.regexp_replace("piece", "[\\r\\n]+$", "")).withColumn("line_no", F.col("nth") + 1)
    state = (
        F.when(F.coalesce(F.col("piece"), F.lit("")) == "", "missing").when(F.col("versions") > 1, "overlap")
        .when(F.col("line") != F.col("before"), "stale").when(F.col("after").rlike("[\\r\\n]"), "lines").otherwise("applied")
    )
    return rows.join(one, [*keys, "line_no"], "full").withColumn("state", F.when(F.col("versions").isNotNull(), state))


def repair_states(logs: DataFrame, changes: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of logs, line_no and state of each line with changes: applied; stale (it doesn't read as before any more);
    overlap (its changes differ); missing (no such line); lines (the new text isn't one line)."""
    keys = [c for c in logs.columns if c != text_col]
    return _held(logs, changes, text_col).where("state is not null").select(*keys, "line_no", "state")


def apply_repairs(logs: DataFrame, changes: DataFrame, text_col: str = "text") -> DataFrame:
    """logs with the changes that repair_states calls applied. Keys are unique in logs; a log without changes never
    leaves its row."""
    keys = [c for c in logs.columns if c != text_col]
    end = F.substring("piece", F.length("line") + 1, F.lit(2))
    text = F.when(F.col("state") == "applied", F.concat("after", end)).otherwise(F.col("piece"))
    rows = _held(logs, changes, text_col).where("piece is not null").select(*keys, "nth", text.alias("_text"))
    done = rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "_text"))), lambda x: x["_text"]), "").alias(text_col))
    marked = changes.select(*keys).distinct().withColumn("_changed", F.lit(True))
    same = logs.join(marked, keys, "left").where(F.col("_changed").isNull() | F.col(text_col).isNull()).drop("_changed")
    return same.unionByName(done).select(logs.columns)
