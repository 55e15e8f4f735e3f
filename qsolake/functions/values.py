"""Dates, times, serial numbers, modes and text cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qsolake.functions.radio import trimmed

# Date layouts as (pattern, order of year, month and day among its groups).
DATES = {
    "YYYYMMDD": (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
    "YYYY-MM-DD": (r"^(\d{4})-(\d{2})-(\d{2})$", (1, 2, 3)),
    "YYYY.MM.DD": (r"^(\d{4})\.(\d{2})\.(\d{2})$", (1, 2, 3)),
    "YYYY/MM/DD": (r"^(\d{4})/(\d{2})/(\d{2})$", (1, 2, 3)),
    "DD/MM/YYYY": (r"^(\d{2})/(\d{2})/(\d{4})$", (3, 2, 1)),
    "MM/DD/YYYY": (r"^(\d{2})/(\d{2})/(\d{4})$", (3, 1, 2)),
    "DD-MMM-YYYY": (r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$", (3, 2, 1)),
}
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
TIMES = {
    "HHMM": r"^(\d{2})(\d{2})()$",
    "HHMMSS": r"^(\d{2})(\d{2})(\d{2})$",
    "HH:MM": r"^(\d{2}):(\d{2})()$",
    "HH:MM:SS": r"^(\d{2}):(\d{2}):(\d{2})$",
}
# Mode codes of contest logs and of general logs.
ADIF_MODE = {
    "PH": "SSB", "RY": "RTTY", "DG": "DATA", "CO": "CONTESTI", "DO": "DOMINO", "HE": "HELL", "MF": "MFSK", "MK": "MFSK",
    "OL": "OLIVIA", "PS": "PSK", "PM": "PSK", "PO": "PSK", "QM": "PSK", "PT": "PAC", "TH": "THRB", "TV": "SSTV", "AX": "PKT",
}
SUBMODES = {"USB": "SSB", "LSB": "SSB", "PSK31": "PSK", "PSK63": "PSK", "FT4": "MFSK", "JT65A": "JT65"}
CABRILLO_MODE = {"SSB": "PH", "USB": "PH", "LSB": "PH", "AM": "PH", "RTTY": "RY", "FM": "FM", "CW": "CW", "PSK": "PS", "SSTV": "TV", "DATA": "DG"}
UNSAFE = "[\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F\\u0081\\u008D\\u008F\\u0090\\u009D\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def mapped(x: Column, table: dict[str, str]) -> Column:
    """The table's value, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), x)


def padded(x: Column, width: int) -> Column:
    """Left-padded with zeros, never cut."""
    return F.lpad(x, F.greatest(F.length(x), F.lit(width)), "0")


def calendar_day(digits: Column) -> Column:
    """The date of yyyyMMdd, from 1930 on; null if there is no such day."""
    return F.when(digits.rlike(r"^\d{8}$") & (F.substring(digits, 1, 4) >= "1930"), F.try_to_date(digits, "yyyyMMdd"))


def convert_date(x: Column, source: str, target: str = "YYYYMMDD") -> Column:
    pattern, order = DATES[source]
    text = trimmed(x)
    year, month, day = (F.regexp_extract(text, pattern, k) for k in order)
    if source == "DD-MMM-YYYY":
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(month)).cast("string")
    date = calendar_day(F.concat(year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    return F.date_format(date, "yyyyMMdd" if target == "YYYYMMDD" else "yyyy-MM-dd")


def convert_time(x: Column, source: str, target: str) -> Column:
    text = trimmed(x)
    hour, minute, second = (F.regexp_extract(text, TIMES[source], k) for k in (1, 2, 3))
    second = F.when(second == "", "00").otherwise(second)
    parts = [hour, minute, second] if target in ("HHMMSS", "HH:MM:SS") else [hour, minute]
    good = text.rlike(TIMES[source]) & (hour <= "23") & (minute <= "59") & (second <= "59")
    return F.when(good, F.concat_ws(":" if ":" in target else "", *parts))


def shift_time(date: Column, time: Column, minutes: int) -> Column:
    """struct(date yyyy-MM-dd, time HHMM or HHMMSS as given), minutes later; null for invalid input."""
    day = convert_date(date, "YYYY-MM-DD", "YYYY-MM-DD")
    full = F.coalesce(convert_time(time, "HHMM", "HHMMSS"), convert_time(time, "HHMMSS", "HHMMSS"))
    moved = F.try_to_timestamp(F.concat(day, full), F.lit("yyyy-MM-ddHHmmss")) + F.make_dt_interval(mins=F.lit(minutes))
    text = F.when(F.length(trimmed(time)) == 6, F.date_format(moved, "HHmmss")).otherwise(F.date_format(moved, "HHmm"))
    return F.when(moved.isNotNull(), F.struct(F.date_format(moved, "yyyy-MM-dd").alias("date"), text.alias("time")))


def normalize_serial(x: Column, width: int) -> Column:
    text = trimmed(x)
    digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
    return F.when(text.rlike(r"^\d+$"), padded(digits, width))


def mode_to_adif(x: Column) -> Column:
    """struct(mode, submode): a submode's mode, with the submode kept."""
    original = F.upper(trimmed(x))
    family = mapped(original, SUBMODES)
    return F.struct(F.coalesce(family, mapped(original, ADIF_MODE), original).alias("mode"), F.when(family.isNotNull(), original).alias("submode"))


def mode_to_cabrillo(x: Column) -> Column:
    original = F.upper(trimmed(x))
    mode = F.coalesce(mapped(original, SUBMODES), original)
    return F.coalesce(mapped(mode, CABRILLO_MODE), mode)


def clean_whitespace(x: Column) -> Column:
    """Control characters and unusual blanks become spaces; line ends and tabs stay."""
    return F.regexp_replace(x, UNSAFE, " ")


def csv_quoted(x: Column) -> Column:
    return F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def formula_safe(x: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(x.rlike("^[\\s\\x00-\\x1f]*[=+@-]"), F.concat(F.lit("'"), x)).otherwise(x)


def xml_escaped(x: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def leading_int(x: Column) -> Column:
    """The integer a text starts with, null if it starts with none."""
    return F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("long")
