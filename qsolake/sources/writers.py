"""Writing contact logs: each row becomes a line or record by expressions; the rows of a log are put together only
where a whole document is asked for, and otherwise written as sorted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.sources.logs import CABRILLO_GENERIC, EDI_FIELDS


def padded(value: Column, width: int) -> Column:
    return F.rpad(F.substring(value, 1, width), width, " ")


def cabrillo_line(fields: dict[str, Column], excluded: Column | None = None) -> Column:
    """A contact as a fixed-width line: values cut and filled to their columns."""
    parts, at = [F.lit("QSO:")], 4
    for name, start, end in CABRILLO_GENERIC:
        parts += [F.lit(" " * (start - at)), padded(F.coalesce(fields.get(name, F.lit("")), F.lit("")), end - start)]
        at = end
    line = F.rtrim(F.concat(*parts))
    return line if excluded is None else F.when(excluded, F.concat(F.lit("X-"), line)).otherwise(line)


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units, which ADIF lengths count."""
    return (F.octet_length(F.encode(value, "UTF-16LE")) / 2).cast("int")


def adif_tag(name: Column | str, value: Column, type_: Column | None = None) -> Column:
    kind = F.lit("") if type_ is None else F.when(F.coalesce(type_, F.lit("")) == "", "").otherwise(F.concat(F.lit(":"), type_))
    name = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.lit("<"), name, F.lit(":"), utf16_length(value).cast("string"), kind, F.lit(">"), value)


def adif_record(fields: dict[str, Column]) -> Column:
    """A record of the fields that aren't empty."""
    tags = [F.when(F.coalesce(v, F.lit("")) != "", adif_tag(n.upper(), v)) for n, v in fields.items()]
    return F.concat(F.concat_ws(" ", *tags), F.lit(" <EOR>"))


def adif_from_tags(tags: str, lower: bool = False, types: bool = True) -> Column:
    """A record written anew from its tags."""
    name = (lambda t: F.lower(t["name"])) if lower else (lambda t: t["name"])
    made = F.transform(tags, lambda t: adif_tag(name(t), t["value"], t["type"] if types else None))
    return F.concat(F.array_join(made, " "), F.lit(" <eor>" if lower else " <EOR>"))


def xml_escaped(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def adx_record(fields: dict[str, Column]) -> Column:
    """A RECORD element of the fields that aren't empty."""
    made = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"<{n}>"), xml_escaped(v), F.lit(f"</{n}>"))) for n, v in fields.items()]
    return F.concat(F.lit("<RECORD>"), F.concat_ws("", *made), F.lit("</RECORD>"))


def edi_line(fields: dict[str, Column]) -> Column:
    return F.concat_ws(";", *[F.coalesce(fields.get(n, F.lit("")), F.lit("")) for n in EDI_FIELDS])


def csv_line(values: list[Column], separator: str = ",") -> Column:
    def cell(v: Column) -> Column:
        v = F.coalesce(v, F.lit(""))
        return F.when(v.rlike(f'["\\r\\n{separator}]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.array_join(F.array(*map(cell, values)), separator)


def documents(rows: DataFrame, keys: list[str], order: str, line: str, head: Column, tail: Column, newline: str = "\n") -> DataFrame:
    """The keys and text of whole logs: one log is one document, so its lines come together."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), newline)
    return rows.groupBy(*keys).agg(body.alias("_body")).select(*keys, F.concat(head, "_body", tail).alias("text"))


# Headings of the reports, and the columns of scored rows that they show.
SCORE_REPORT = {
    "QSO_ID": "line_no", "CALL": "call", "BAND": "band", "MODE": "mode", "COUNTRY": "w_country", "CONTINENT": "w_continent", "MATCHED_PREFIX": "w_matched",
    "POINTS": "points", "BONUS_POINTS": "bonus_points", "MULTIPLIER": "multiplier", "DUPLICATE": "duplicate",
}
ACTIVITY_REPORT = {"START": "bucket", "QSOS": "qsos", "POINTS": "points"}


def report_lines(rows: DataFrame, report: dict[str, str], keys: list[str]) -> DataFrame:
    """The keys and, for each row, its CSV line; flags show as Y or N, columns that rows lack are 0 for bonus points, else
    empty. The heading is report_heading(report); rows stay rows, so a log of any size is written by many tasks."""
    types = dict(rows.dtypes)

    def cell(heading: str, column: str) -> Column:
        if column not in types:
            return F.lit("0" if heading == "BONUS_POINTS" else "")
        return F.when(F.col(column), "Y").otherwise("N") if types[column] == "boolean" else F.col(column).cast("string")

    return rows.select(*keys, csv_line([cell(h, c) for h, c in report.items()]).alias("line"))


# The heading of the report of duplicates.
DUPLICATE_HEADING = "Kind,First call,Second call,Differing fields,Reason"


def duplicate_lines(candidates: DataFrame) -> DataFrame:
    """first, second and the CSV line of each of contacts.duplicate_candidates(), every cell quoted."""
    quoted = lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.col("kind"), F.col("first_call"), F.col("second_call"), F.array_join("differing", ";"), F.col("reason")]
    return candidates.select("first", "second", F.array_join(F.array(*map(quoted, cells)), ",").alias("line"))


def report_heading(report: dict[str, str]) -> str:
    return ",".join(report)
