"""Reading contact logs: a log is one row (its keys and a column text), a file read whole.

Cabrillo, EDI and delimited text are cut into lines and fields by array expressions, so that no row leaves its
task until the contacts are exploded. ADIF values are length-prefixed, which no pattern can follow: the records are
split by Spark and one Arrow function scans the tags of a record. ADX is read by a standard XML parser, whose records
leave the task as they come.

A null text gives no line and no contact. Order within a log is line_no or record, counted from 1."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qsolake.functions.radio import let

LINE_END = "\\r\\n|\\n|\\r"
TAGS = "array<struct<name:string,value:string,type:string>>"
# The fixed columns of a Cabrillo contact line (name, first column, end), and the order of EDI fields.
CABRILLO_COMMON = (("FREQUENCY", 5, 10), ("MODE", 11, 13), ("QSO_DATE", 14, 24), ("TIME_ON", 25, 29))
CABRILLO_GENERIC = (
    *CABRILLO_COMMON, ("MY_CALL", 30, 43), ("RST_SENT", 44, 47), ("STX_STRING", 48, 54),
    ("CALL", 55, 68), ("RST_RCVD", 69, 72), ("SRX_STRING", 73, 79),
)
EDI_FIELDS = (
    "DATE", "TIME", "CALL", "MODE_CODE", "RST_SENT", "QSO_SENT", "RST_RCVD", "QSO_RCVD", "EXCHANGE_RCVD", "WWL_RCVD",
    "QSO_POINTS", "NEW_EXCHANGE", "NEW_WWL", "NEW_DXCC", "DUPLICATE",
)


#: Bytes of an Arrow batch of whole documents that goes to Python, where the application doesn't set them.
BATCH_BYTES = 8 << 20


def short_batches(files: DataFrame) -> DataFrame:
    """files, after the session is told to bound Arrow batches by bytes, unless the application did; the plan runs later."""
    conf, setting = files.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(setting, None) is None:
        conf.set(setting, f"{BATCH_BYTES}b")
    return files


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file under path, decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decoded(F.col("content")).alias("d")).select("path", "d.*")


#: The bytes of Windows-1252 that aren't Latin-1's; one without a character stands for itself, as browsers read it.
LEGACY_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def _legacy(content: Column) -> Column:
    latin = "".join(map(chr, LEGACY_BYTES))
    return F.struct(F.translate(F.decode(content, "ISO-8859-1"), latin, bytes(LEGACY_BYTES).decode("cp1252")).alias("text"), F.lit("Windows-1252").alias("encoding"))


def decoded(content: Column) -> Column:
    """A struct of text and encoding: by byte-order mark, else UTF-8 if valid, else Windows-1252."""
    as_ = lambda text, name: F.struct(text.alias("text"), F.lit(name).alias("encoding"))
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n, 1 << 30)
    return (
        F.when(head == "EFBBBF", as_(F.decode(rest(4), "UTF-8"), "UTF-8 BOM"))
        .when(head.startswith("FFFE"), as_(F.decode(rest(3), "UTF-16LE"), "UTF-16 LE"))
        .when(F.is_valid_utf8(content.cast("string")), as_(content.cast("string"), "UTF-8"))
        .otherwise(_legacy(content))
    )


def detect_format(text: Column, name: Column | None = None) -> Column:
    """cabrillo, edi, adif or text: content goes before the file's extension."""
    sample = F.substring(text, 1, 32_000)
    extension = F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), "[.]"), -1)) if name is not None else F.lit("")
    cabrillo_head = sample.rlike("(?im)^\\s*(CALLSIGN|CONTEST|END-OF-LOG)\\s*:")
    return (
        F.when(sample.rlike("(?im)^\\s*START-OF-LOG\\s*:") | sample.rlike("(?im)^\\s*(X-)?QSO:"), "cabrillo")
        .when(sample.rlike("(?im)^\\s*\\[(REG1TEST;[^\\]]+|QSORecords;\\d+)\\]"), "edi")
        .when(sample.rlike("(?i)<([\\w.-]+:)?ADX\\b") | (extension == "adx"), "adif")
        .when(sample.rlike("(?i)<(ADIF_VER|EOH|CALL|QSO_DATE|EOR)[:>]"), "adif")
        .when(extension == "edi", "edi").when(extension.isin("adi", "adif"), "adif")
        .when(extension.isin("cbr", "cab") | ((extension == "log") & cabrillo_head), "cabrillo")
        .otherwise("text")
    )


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")


def split_lines(text: Column) -> Column:
    """The lines of a text; a line end at its end opens no further one."""
    return F.split(F.regexp_replace(text, f"({LINE_END})\\z", ""), LINE_END)


def lines(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of logs, line_no, raw."""
    keys = [c for c in logs.columns if c != text_col]
    out = logs.select(*keys, F.posexplode(split_lines(F.col(text_col))).alias("line_no", "raw"))
    return out.withColumn("line_no", F.col("line_no") + 1)


HEADER = "(?i)^\\s*([A-Z][A-Z0-9-]*):\\s?(.*)$"


def cabrillo_kind(raw: Column) -> Column:
    return (
        F.when(trimmed(raw) == "", "blank").when(raw.rlike("(?i)^\\s*(X-)?QSO:"), "qso").when(raw.rlike("(?i)^\\s*QTC:"), "qtc")
        .when(raw.rlike("^\\s*[#;]"), "comment").when(raw.rlike(HEADER), "header").otherwise("unknown")
    )


def cabrillo_lines(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """lines() with kind, and key and value of headers."""
    header = F.col("kind") == "header"
    return (
        lines(logs, text_col).withColumn("kind", cabrillo_kind(F.col("raw")))
        .withColumn("key", F.when(header, F.upper(F.regexp_extract("raw", HEADER, 1))).when(F.col("kind") == "qtc", "QTC"))
        .withColumn("value", F.when(header, F.regexp_extract("raw", HEADER, 2)))
    )


def cabrillo_fields(raw: Column, layout: tuple[tuple[str, int], ...] | None = None) -> Column:
    """A struct of a contact line's fields: by white space, or by the columns of a layout ((name, width), ...)."""
    if layout is None:
        parts = F.split(trimmed(F.regexp_replace(raw, "(?i)^\\s*X?-?QSO:\\s*", "")), "\\s+")
        return F.struct(*[F.coalesce(F.get(parts, i), F.lit("")).alias(n) for i, (n, *_) in enumerate(CABRILLO_GENERIC)])
    columns, at = list(CABRILLO_COMMON), 30
    for name, width in layout:
        columns.append((name, at, at + width))
        at += width + 1
    fixed = F.when(raw.startswith("X-QSO:"), F.substring(raw, 3, 1 << 30)).otherwise(raw)
    parts = F.split(trimmed(F.regexp_replace(raw, "(?i)^\\s*X?-?QSO:\\s*", "")), "\\s+")
    return F.struct(*[
        F.when(fixed.startswith("QSO:"), trimmed(F.substring(fixed, a + 1, b - a))).otherwise(F.coalesce(F.get(parts, i), F.lit(""))).alias(n)
        for i, (n, a, b) in enumerate(columns)
    ])


def cabrillo_contacts(logs: DataFrame, text_col: str = "text", layout=None) -> DataFrame:
    """One row for each contact line: the keys of logs, line_no, excluded (an X-QSO) and the fields."""
    keys = [c for c in logs.columns if c != text_col]
    rows = lines(logs, text_col).where(F.col("raw").rlike("(?i)^\\s*(X-)?QSO:"))
    return rows.select(*keys, "line_no", F.col("raw").startswith("X-QSO:").alias("excluded"), cabrillo_fields(F.col("raw"), layout).alias("f")).select(
        *keys, "line_no", "excluded", "f.*"
    )


def cabrillo_headers(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of logs, line_no, key, value of header lines."""
    return cabrillo_lines(logs, text_col).where("kind = 'header'").drop("raw", "kind")


# --- EDI --------------------------------------------------------------------------------------------------------


def _after_marker(text_lines: Column) -> Column:
    """line_no and raw of the record lines: after a record marker, up to a remarks marker, without blank and end lines."""
    records, remarks = "(?i)^\\s*\\[QSORecords;\\d+\\]\\s*$", "(?i)^\\s*\\[Remarks\\]\\s*$"
    kinds = F.transform(text_lines, lambda x, i: F.struct(
        (i + 1).alias("line_no"), x.alias("raw"), F.when(x.rlike(records), 1).when(x.rlike(remarks), 2).otherwise(0).alias("marker")
    ))
    plain = lambda x: (x["marker"] == 0) & (x["raw"] != "") & ~x["raw"].rlike("(?i)^\\s*\\[END(;[^\\]]*)?\\]\\s*$")
    # A log has few markers: each line is held against them, not against all lines.
    inside = lambda x, s: F.try_element_at(F.filter(s, lambda m: m["line_no"] < x["line_no"]), F.lit(-1))["marker"] == 1
    return let(kinds, lambda k: let(F.filter(k, lambda x: x["marker"] > 0), lambda s: F.filter(k, lambda x: plain(x) & inside(x, s))))


def edi_contacts(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each record after the record marker: the keys of logs, line_no, n_fields and the fields."""
    keys = [c for c in logs.columns if c != text_col]
    rows = logs.select(*keys, F.explode(_after_marker(split_lines(F.col(text_col)))).alias("r")).select(*keys, "r.line_no", "r.raw")
    parts = F.split("raw", ";")
    return rows.select(
        *keys, "line_no", F.size(parts).alias("n_fields"), *[F.coalesce(F.get(parts, i), F.lit("")).alias(n) for i, n in enumerate(EDI_FIELDS)]
    )


def edi_headers(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of logs and headers, a map of upper-case key to value (the first of each key)."""
    keys = [c for c in logs.columns if c != text_col]
    before = F.regexp_extract(text_col, "(?is)\\A(.*?)(^\\s*\\[(?:Remarks|QSORecords;\\d+)\\]|\\z)".replace("(?is)", "(?ism)"), 1)
    heads = F.filter(F.split(before, LINE_END), lambda x: x.rlike("^[^=\\s]+="))
    pairs = F.transform(heads, lambda x: F.struct(F.upper(F.regexp_extract(x, "^([^=\\s]+)=", 1)).alias("k"), F.regexp_extract(x, "^[^=\\s]+=(.*)$", 1).alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return logs.select(*keys, F.map_from_entries(first).alias("headers"))


# --- ADIF and ADX -----------------------------------------------------------------------------------------------

TAG = re.compile(r"<\s*([A-Z][A-Z0-9_]*)(?::(\d+)(?::([^>]+))?)?\s*>", re.IGNORECASE)


def scan_spans(record: str) -> list[tuple[str, str, str | None, int, int]]:
    """Tags of a record with the places where each begins and ends, in characters. A tag's length, in UTF-16 units, says
    where its value ends and the next tag may begin; one that ends within a character takes all of it."""
    wide = any(c > "\uffff" for c in record)
    if wide:
        record = "".join(chr(u) for u in memoryview(record.encode("utf-16-le")).cast("H"))
        place = [0, *accumulate(int(not 0xDC00 <= ord(c) < 0xE000) for c in record)]
    found, at = [], 0
    while tag := TAG.search(record, at):
        at = tag.end()
        if tag[2] is not None and tag[1].upper() not in ("EOH", "EOR"):
            at = min(at + int(tag[2]), len(record))
            found.append((tag[1].upper(), record[tag.end() : at], tag[3], tag.start(), at))
    if wide:
        found = [(n, v.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"), t, place[a], place[b]) for n, v, t, a, b in found]
    return found


def scan_tags(record: str) -> list[tuple[str, str, str | None]]:
    return [tag[:3] for tag in scan_spans(record)]


def tags_of(record: str) -> Column:
    @F.pandas_udf(TAGS)
    def run(records: pd.Series) -> pd.Series:
        return records.map(lambda r: [{"name": n, "value": v, "type": t} for n, v, t in scan_tags(r or "")])

    return run(record)


def adif_records(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of logs, record, original, tags: what stands before each <EOR>, without the header up to <EOH>."""
    keys = [c for c in logs.columns if c != text_col]
    body = F.regexp_replace(F.col(text_col), "(?is)\\A.*?<\\s*EOH\\s*>", "")
    parts = F.split(body, "(?i)<\\s*EOR\\s*>")
    records = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last end isn't a record
    rows = logs.select(*keys, F.posexplode(records).alias("nth", "original")).withColumn("tags", tags_of("original"))
    numbered = rows.where(F.size("tags") > 0)
    return numbered.select(*keys, (F.col("nth") + 1).alias("record"), "original", "tags")


def tag(tags: str, name: str) -> Column:
    """The value of the first tag of that name, else empty."""
    return F.coalesce(F.get(F.filter(tags, lambda t: t["name"] == name.upper()), F.lit(0))["value"], F.lit(""))


ADX_TAGS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("type", pa.string())]))
#: Bytes of an ADX document that are parsed before its finished records are passed on.
ADX_CHUNK = 1 << 20


def _fed(parser, text: memoryview) -> Iterator[None]:
    """Parse a document piece by piece; anything that isn't well-formed, or declares a document type, is an error."""

    def refuse(*_):
        raise ValueError("document types aren't read")

    parser.StartDoctypeDeclHandler = refuse
    while text[:3] == b"\xef\xbb\xbf":
        text = text[3:]
    for at in range(0, len(text), ADX_CHUNK):
        parser.Parse(text[at : at + ADX_CHUNK], False)
        yield
    parser.Parse(b"", True)


def scan_adx(text: memoryview) -> Iterator[pa.ListArray]:
    """The tags of the records of a well-formed ADX document in UTF-8, in order, as many records at once as a piece of it holds."""
    path, value, starts, tags = [], [], [], ([], [], [])

    def start(name, attributes):
        path.append((name.rpartition(":")[2].upper(), attributes))
        value.clear()
        if path[-1][0] == "RECORD":
            starts.append(len(tags[0]))

    def end(_):
        name, attributes = path.pop()
        if len(path) > 1 and path[-1][0] == "RECORD":
            upper = {k.upper(): v for k, v in attributes.items()}
            if name == "APP":
                name = f"APP_{upper.get('PROGRAMID', '')}_{upper.get('FIELDNAME', '')}".upper()
            elif name == "USERDEF":
                name = f"USERDEF_{upper.get('FIELDNAME', '')}".upper()
            for part, x in zip(tags, (name, "".join(value), upper.get("TYPE"))):
                part.append(x)
        value.clear()

    def records(bounds: list[int]) -> pa.ListArray:
        parts = [pa.array(part[: bounds[-1]], pa.string()) for part in tags]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(parts, ["name", "value", "type"]))

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, value.append
    for _ in _fed(parser, text):
        if len(starts) > 1:  # the last record may go on
            yield records(starts)
            for part in tags:
                del part[: starts[-1]]
            starts[:] = [0]
    if starts:
        yield records([*starts, len(tags[0])])


def adx_records(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of logs, record, tags, error: a document that can't be read gives one row with its error.

    A document is parsed twice, as its last byte may be the one that can't be read: once to see that, once for its records,
    which leave the task while the rest is parsed."""
    keys = [c for c in logs.columns if c != text_col]
    schema = T.StructType([*(f for f in logs.schema if f.name != text_col), *T.StructType.fromDDL(f"record int, tags {TAGS}, error string")])

    def of_document(text: memoryview) -> Iterator[tuple[list[int | None], pa.Array, str | None]]:
        try:
            for _ in _fed(expat.ParserCreate(), text):
                pass
        except (ValueError, expat.ExpatError) as e:
            yield [None], pa.nulls(1, ADX_TAGS), str(e)
            return
        n = 1
        for tags in scan_adx(text):
            yield list(range(n, n + len(tags))), tags, None
            n += len(tags)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(text_col)):
                for numbers, tags, error in of_document(memoryview(text.as_buffer() or b"")):
                    own = [batch.column(k).take(pa.array([at] * len(tags), pa.int32())) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), tags, pa.array([error] * len(tags), pa.string())], schema.names)

    return short_batches(logs).mapInArrow(read, schema)


# --- delimited text ---------------------------------------------------------------------------------------------

DELIMITERS = ("\t", ";", ",", "|")


def detect_delimiter(text: Column) -> Column:
    """The delimiter whose count agrees best with the first line's over the first 50 filled lines; empty if none does."""
    filled = F.slice(F.filter(F.split(text, LINE_END), lambda x: trimmed(x) != ""), 1, 50)

    def rated(order: int, d: str) -> Column:
        widths = F.transform(filled, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))) + 1)
        width = F.coalesce(F.get(widths, F.lit(0)), F.lit(1))
        agree = F.size(F.filter(widths, lambda w: (w == width) & (w > 1)))
        return F.struct(agree.alias("agree"), width.alias("width"), F.lit(-order).alias("order"), F.lit(d).alias("delimiter"))

    best = F.array_max(F.array(*[rated(i, d) for i, d in enumerate(DELIMITERS)]))
    n = F.size(filled)
    least = F.when(n <= 1, 1).otherwise(F.greatest(F.lit(2), F.ceil(n * 0.7)))
    return F.when(best["agree"] >= least, best["delimiter"]).otherwise("")


def table_rows(logs: DataFrame, text_col: str = "text", delimiter: Column | None = None) -> DataFrame:
    """The keys of logs, row_no and cells, every row of a text filled up to its widest; without a delimiter a character a cell."""
    keys = [c for c in logs.columns if c != text_col]
    d = detect_delimiter(F.col(text_col)) if delimiter is None else delimiter
    quoted = F.concat(F.lit("\\Q"), F.col("_d"), F.lit("\\E"))
    cut = F.transform("_lines", lambda x: F.when(x == "", F.when(F.col("_d") == "", F.array().cast("array<string>")).otherwise(F.array(F.lit("")))).otherwise(
        F.when(F.col("_d") == "", F.filter(F.split(x, "(?!^)"), lambda c: c != "")).otherwise(F.split(x, quoted))))
    rows = logs.select(*keys, d.alias("_d"), split_lines(F.col(text_col)).alias("_lines")).withColumn("_cells", cut)
    width = F.array_max(F.transform("_cells", F.size))
    full = F.transform("_cells", lambda c: F.concat(c, F.array_repeat(F.lit(""), F.col("_width") - F.size(c))))
    out = rows.withColumn("_width", width).select(*keys, F.posexplode(full).alias("row_no", "cells"))
    return out.withColumn("row_no", F.col("row_no") + 1)
