"""Imported contacts as logs of another format, with what stands in the way and what is lost.

Contacts are rows of guided.contacts. `gated` finds what keeps a file from being written; `export` writes the records of
files without an error, one row each, so a log of any size is made by many tasks; `losses` reads what was written back and
joins it, field by field, to the contacts it came from: a field that isn't there is lost, one that reads otherwise changed.
Nothing is asked of a person: what a form would ask is a column of `metadata`, one row a file.

Defined cases: a file without contacts is IMPORT-EMPTY and not written; a null cell is an empty one; without metadata a
file is held to have none; rows that repeat are written each; a csv has no gates but IMPORT-EMPTY and import errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.functions.values import mapped
from qsolake.sources import logs, writers
from qsolake.sources.logs import EDI_FIELDS

FORMATS = ("adif", "cabrillo", "edi", "csv")
METADATA = "utc_confirmed boolean, contest string, station string, locator string, band string, scoring string, claimed_score string, dates string"
# Modes and bands as EDI and Cabrillo write them.
EDI_MODES = {"SSB": "1", "USB": "1", "LSB": "1", "CW": "2", "SSB-CW": "3", "CW-SSB": "4", "AM": "5", "FM": "6", "RTTY": "7", "SSTV": "8", "ATV": "9"}
EDI_BANDS = {
    "6M": "50 MHz", "4M": "70 MHz", "2M": "144 MHz", "1.25M": "222 MHz", "70CM": "432 MHz", "23CM": "1.3 GHz", "13CM": "2.3 GHz", "9CM": "3.4 GHz",
    "6CM": "5.7 GHz", "3CM": "10 GHz", "1.25CM": "24 GHz", "6MM": "47 GHz", "4MM": "76 GHz",
}
CABRILLO_BANDS = {
    "6M": "50", "4M": "70", "2M": "144", "1.25M": "222", "70CM": "432", "33CM": "902", "23CM": "1.2G", "13CM": "2.3G", "9CM": "3.4G", "6CM": "5.7G",
    "3CM": "10G", "1.25CM": "24G", "6MM": "47G", "4MM": "75G", "2.5MM": "122G", "2MM": "134G", "1MM": "241G",
}
CABRILLO_MODES = {"SSB": "PH", "USB": "PH", "LSB": "PH", "AM": "PH", "RTTY": "RY", "FM": "FM", "CW": "CW"}
DIGITAL = (
    "DG DIGITAL DATA FT4 FT8 PSK PSK31 PSK63 PSK125 QPSK QPSK31 QPSK63 MFSK MFSK8 MFSK16 OLIVIA DOMINO HELL PAX PKT PACKET JS8 JT4 JT9 JT65 Q65 MSK144 "
    "WSPR THOR THROB DSTAR C4FM DMR FREEDV ROS VARA WINMOR ARDOP"
).split()
#: Fields that a record of a format holds; adif and csv hold all.
HELD = {
    "cabrillo": ("FREQ", "MODE", "QSO_DATE", "TIME_ON", "STATION_CALLSIGN", "RST_SENT", "STX_STRING", "CALL", "RST_RCVD", "SRX_STRING", "BAND"),
    "edi": (
        "QSO_DATE", "TIME_ON", "CALL", "MODE", "RST_SENT", "STX", "RST_RCVD", "SRX", "SRX_STRING", "GRIDSQUARE", "QSO_POINTS", "EDI_NEW_EXCHANGE",
        "EDI_NEW_WWL", "EDI_NEW_DXCC", "EDI_DUPLICATE", "STATION_CALLSIGN", "MY_GRIDSQUARE", "BAND",
    ),
}
#: Separators of a format that a value can't hold.
SEPARATORS = {"edi": "[;\r\n]", "cabrillo": "[\r\n]"}
MAP = "map<string,string>"


def v(name: str, values: str = "values") -> Column:
    """A field of a contact, empty if it has none."""
    return F.coalesce(F.try_element_at(F.col(values), F.lit(name)), F.lit(""))


def same(a: Column) -> Column:
    return F.upper(F.trim(a))


def prepared(contacts: DataFrame, metadata: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """contacts with the metadata of their file (one struct, m), and one row a file with its common values.

    A value of the file is the metadata's, else the one that all its contacts share; n_<name> counts the different ones."""
    shared = {"station": "STATION_CALLSIGN", "locator": "MY_GRIDSQUARE", "band": "BAND"}
    stated = F.col("values").isNotNull()
    files = contacts.groupBy("path").agg(
        F.count_if(stated).alias("n"), F.min(F.nullif(v("QSO_DATE"), F.lit(""))).alias("first"), F.max(F.nullif(v("QSO_DATE"), F.lit(""))).alias("last"),
        *[x for k, f in shared.items() for x in (F.min(F.nullif(same(v(f)), F.lit(""))).alias(f"min_{k}"), F.max(F.nullif(same(v(f)), F.lit(""))).alias(f"max_{k}"))],
        F.sum(F.when((v("EDI_DUPLICATE") != "D") & v("QSO_POINTS").rlike(r"^\d{1,6}$"), v("QSO_POINTS").try_cast("long"))).alias("points"),
        F.count_if(v("EDI_DUPLICATE") != "D").alias("counted"), F.bool_and(v("QSO_POINTS").rlike(r"^\d{1,6}$")).alias("all_points"),
    )
    names = [c.split()[0] for c in METADATA.split(", ")]
    if metadata is None:
        files = files.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in METADATA.split(", ")])
    else:
        files = files.join(metadata.select("path", *names), "path", "left")
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    for k in shared:
        one = F.when(F.col(f"min_{k}") == F.col(f"max_{k}"), F.col(f"min_{k}"))
        mine = F.when(text(k) != "", F.upper(text(k))).otherwise(F.coalesce(one, F.lit("")))
        files = files.withColumn(f"mixed_{k}", F.coalesce((F.col(f"min_{k}") != F.col(f"max_{k}")) | ((mine != "") & (F.col(f"min_{k}") != mine)), F.lit(False))).withColumn(f"use_{k}", mine)
    dates = F.when(text("dates") != "", text("dates")).otherwise(F.concat_ws(";", "first", "last"))
    files = files.select(
        "path", "n", "first", "last", "points", "counted", "all_points", F.coalesce("utc_confirmed", F.lit(False)).alias("utc"), text("contest").alias("contest"),
        text("scoring").alias("scoring"), text("claimed_score").alias("claimed"), dates.alias("dates"), *[F.col(f"use_{k}").alias(k) for k in shared], *[f"mixed_{k}" for k in shared],
    )
    whole = F.struct(*[c for c in files.columns if c != "path"]).alias("m")
    return contacts.where(stated).join(files.select("path", whole), "path"), files


def digital(values: str = "values") -> Column:
    return F.upper(v("SUBMODE", values)).isin(DIGITAL) | F.upper(v("MODE", values)).isin(DIGITAL)


def cabrillo_mode() -> Column:
    named = F.coalesce(mapped(F.upper(v("SUBMODE")), CABRILLO_MODES), mapped(F.upper(v("MODE")), CABRILLO_MODES), F.lit(""))
    return F.when(digital(), "DG").otherwise(named)


def edi_mode() -> Column:
    return F.coalesce(F.nullif(v("EDI_MODE_CODE"), F.lit("")), mapped(v("MODE"), EDI_MODES), F.lit(""))


def cabrillo_fields() -> dict[str, Column]:
    code = mapped(F.upper(v("BAND")), CABRILLO_BANDS)
    khz = F.round(v("FREQ").try_cast("double") * 1000).cast("long").cast("string")
    either = lambda a, b: F.coalesce(F.nullif(v(a), F.lit("")), v(b))
    return {
        "FREQUENCY": F.coalesce(code, khz, F.lit("")), "MODE": cabrillo_mode(), "QSO_DATE": F.regexp_replace(v("QSO_DATE"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
        "TIME_ON": F.substring(v("TIME_ON"), 1, 4), "MY_CALL": F.coalesce(F.nullif(v("STATION_CALLSIGN"), F.lit("")), F.col("m.station")), "RST_SENT": v("RST_SENT"),
        "STX_STRING": either("STX_STRING", "STX"), "CALL": v("CALL"), "RST_RCVD": v("RST_RCVD"), "SRX_STRING": either("SRX_STRING", "SRX"),
    }


def edi_fields() -> dict[str, Column]:
    serial = lambda x: F.when(v(x).rlike(r"^\d{1,2}$"), F.lpad(v(x), 3, "0")).otherwise(v(x))
    made = [
        F.substring(v("QSO_DATE"), 3, 6), F.substring(v("TIME_ON"), 1, 4), v("CALL"), edi_mode(), v("RST_SENT"), serial("STX"), v("RST_RCVD"), serial("SRX"), v("SRX_STRING"),
        v("GRIDSQUARE"), v("QSO_POINTS"), v("EDI_NEW_EXCHANGE"), v("EDI_NEW_WWL"), v("EDI_NEW_DXCC"), v("EDI_DUPLICATE"),
    ]
    return dict(zip(EDI_FIELDS, made))


# --- gates -------------------------------------------------------------------------------------------------------


def _finding(wrong: Column, code: str, field: str = "") -> Column:
    made = F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit("error").alias("severity"))
    return F.when(F.coalesce(wrong, F.lit(False)), made)


def _file_gates(format: str) -> list[Column]:
    found = [_finding(F.col("n") == 0, "IMPORT-EMPTY")]
    if format == "csv":
        return found
    found += [_finding(~F.col("utc"), "IMPORT-UTC", "TIME_ON")]
    if format in ("edi", "cabrillo"):
        found += [_finding(F.col("mixed_station"), "IMPORT-MIXED-METADATA", "STATION_CALLSIGN"), _finding(F.col("station") == "", "IMPORT-STATION", "STATION_CALLSIGN"),
                  _finding(F.col("contest") == "", "IMPORT-CONTEST", "CONTEST"), _finding(F.concat_ws("", "station", "contest").rlike("[\r\n]"), "IMPORT-HEADER-INJECTION")]
    if format == "edi":
        day = lambda i: F.coalesce(F.get(F.split("dates", ";"), i), F.lit(""))
        fine = lambda d: d.rlike(r"^\d{8}$") & F.try_to_date(d, "yyyyMMdd").isNotNull()
        summed = (F.col("scoring") == "supplied-points") & F.coalesce("all_points", F.lit(False))
        found += [
            _finding(F.col("mixed_locator"), "IMPORT-MIXED-METADATA", "MY_GRIDSQUARE"), _finding(F.col("mixed_band"), "IMPORT-MIXED-METADATA", "BAND"),
            _finding((F.size(F.split("dates", ";")) != 2) | ~F.coalesce(fine(day(0)), F.lit(False)) | ~F.coalesce(fine(day(1)), F.lit(False)) | (day(0) > day(1)), "IMPORT-CONTEST-DATES", "TDate"),
            _finding((F.col("scoring") == "") & (F.col("claimed") == ""), "IMPORT-SCORING"), _finding(~summed & ~F.col("claimed").rlike(r"^\d+$"), "IMPORT-SCORE"),
        ]
    return found


def _contact_gates(format: str) -> list[Column]:
    if format == "csv":
        return []
    coded = F.lit(format == "edi") & v("EDI_MODE_CODE").rlike("^[0-9]$")
    found = [_finding((v(f) == "") & ~(coded if f == "MODE" else F.lit(False)), "IMPORT-REQUIRED", f) for f in ("CALL", "QSO_DATE", "TIME_ON", "MODE")]
    if format == "adif":
        odd = F.exists(F.map_keys("values"), lambda k: ~k.rlike("^[A-Z][A-Z0-9_]*$"))
        return [*found, _finding(odd, "IMPORT-FIELD-NAME")]
    if format == "cabrillo":
        made = cabrillo_fields()
        widths = {n: end - start for n, start, end in logs.CABRILLO_GENERIC}
        return [
            *found, _finding(cabrillo_mode() == "", "IMPORT-CAB-MODE", "MODE"), _finding(made["FREQUENCY"] == "", "IMPORT-FREQUENCY", "FREQ"),
            *[_finding(F.length(made[n]) > w, "IMPORT-CAB-WIDTH", n) for n, w in widths.items() if n in made],
            _finding(F.concat_ws("", *made.values()).rlike("[\r\n]"), "IMPORT-CAB-SEPARATOR"),
        ]
    day = lambda i: F.get(F.split("m.dates", ";"), i)
    p = v("QSO_POINTS")
    transmitted = lambda c: F.when(c == "3", "1").when(c == "4", "2").otherwise(c)

    def conflict(field: str) -> Column:
        told = mapped(v(field), EDI_MODES)
        code = v("EDI_MODE_CODE")
        differs = (transmitted(told) != transmitted(code)) | (told.isin("3", "4") & (told != code))
        return (code != "") & (v(field) != "") & F.coalesce(differs, code != "0")

    return [
        *found, _finding((v("EDI_DUPLICATE") == "D") & (F.coalesce(p.try_cast("double"), F.lit(1.0)) != 0), "IMPORT-EDI-DUPLICATE-POINTS", "QSO_POINTS"),
        _finding((v("QSO_DATE") != "") & ((v("QSO_DATE") < day(0)) | (v("QSO_DATE") > day(1))), "IMPORT-CONTEST-RANGE", "QSO_DATE"),
        _finding(~p.rlike(r"^\d{1,6}$"), "IMPORT-POINTS", "QSO_POINTS"), _finding(edi_mode() == "", "IMPORT-EDI-MODE", "MODE"),
        _finding(conflict("MODE"), "IMPORT-EDI-MODE-CONFLICT", "MODE"), _finding(conflict("SUBMODE"), "IMPORT-EDI-MODE-CONFLICT", "SUBMODE"),
        *[_finding((v(n) != "") & ~v(n).rlike(r"^\d{1,4}$"), "IMPORT-EDI-SERIAL", n) for n in ("STX", "SRX")],
        *[_finding((v(n) != "") & ~F.length(v(n)).isin(2, 3), "IMPORT-EDI-RST", n) for n in ("RST_SENT", "RST_RCVD")],
        _finding(F.length(v("SRX_STRING")) > 6, "IMPORT-EDI-EXCHANGE", "SRX_STRING"),
        _finding((v("GRIDSQUARE") != "") & ~v("GRIDSQUARE").rlike(r"(?i)^[A-R]{2}\d{2}([A-X]{2})?$"), "IMPORT-EDI-GRID", "GRIDSQUARE"),
        _finding(F.exists(F.array(*edi_fields().values()), lambda x: x.rlike(SEPARATORS["edi"])), "IMPORT-EDI-SEPARATOR"),
    ]


def gated(contacts: DataFrame, format: str, metadata: DataFrame | None = None) -> DataFrame:
    """path, nth (null for the whole file), code, field, severity: the import's own issues and what the format asks for."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}")
    rows, files = prepared(contacts, metadata)
    no_place = F.lit(None).cast("int").alias("nth")
    own = F.transform("issues", lambda i: F.struct(i["code"].alias("code"), F.coalesce(i["field"], F.lit("")).alias("field"), i["severity"].alias("severity")))

    def found(frame: DataFrame, nth: Column | str, array: Column) -> DataFrame:
        # The outer form, as the inner one makes the planner evaluate the whole array once more in a filter before it.
        return frame.select("path", nth, F.inline_outer(array)).where("code is not null")

    checks = lambda made: F.filter(F.array(*made), lambda c: c.isNotNull())
    of_contacts = F.concat(own, checks(_contact_gates(format))) if _contact_gates(format) else own
    return found(files, no_place, checks(_file_gates(format))).unionByName(found(rows, F.col("nth").cast("int").alias("nth"), of_contacts))


def tallied(contacts: DataFrame, format: str, metadata: DataFrame | None = None) -> DataFrame:
    """path, errors and warnings: how many findings of gated() a file has, and its rows that repeat (a warning each), which
    contacts read without repeats don't tell. Where no gate of a contact asks for its file, contacts are read once."""
    count = lambda severity: F.count_if(F.col("severity") == severity)
    again = lambda rows: rows.groupBy("path", F.to_json("values").alias("_json"))
    if format in ("edi", "cabrillo"):
        found = gated(contacts, format, metadata).groupBy("path").agg(count("error").alias("errors"), count("warning").alias("warnings"))
        more = again(contacts.where("values is not null")).agg((F.count(F.lit(1)) - 1).alias("n")).groupBy("path").agg(F.sum("n").alias("again"))
        both = found.join(more, "path", "full_outer").na.fill(0, ["errors", "warnings", "again"])
        return both.select("path", "errors", (F.col("warnings") + F.col("again")).alias("warnings"))
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}")
    of = lambda severity: F.size(F.filter("issues", lambda i: i["severity"] == severity))
    gates = [F.when(c.isNotNull(), 1).otherwise(0) for c in _contact_gates(format)]
    rows = contacts.withColumn("_errors", sum(gates, of("error"))).withColumn("_warnings", of("warning"))
    # Rows that repeat come together first, and only their counts go on.
    whole = again(rows.select("path", "values", "_errors", "_warnings")).agg(
        F.sum("_errors").alias("errors"), F.sum("_warnings").alias("warnings"), F.count(F.lit(1)).alias("n"))
    stated = lambda n: F.sum(F.when(F.col("_json").isNotNull(), n).otherwise(0))
    files = whole.groupBy("path").agg(stated(F.col("errors")).alias("errors"), stated(F.col("warnings") + F.col("n") - 1).alias("warnings"), stated(F.col("n")).alias("n"))
    if metadata is not None:
        files = files.join(metadata.select("path", "utc_confirmed"), "path", "left")
    files = files.withColumn("utc", F.coalesce("utc_confirmed", F.lit(False)) if metadata is not None else F.lit(False))
    return files.select("path", sum([F.when(c.isNotNull(), 1).otherwise(0) for c in _file_gates(format)], F.col("errors")).alias("errors"), "warnings")


# --- records -----------------------------------------------------------------------------------------------------


def _entries(values: Column) -> Column:
    return F.filter(F.map_entries(values), lambda e: F.coalesce(e["value"], F.lit("")) != "")


def record(format: str, names: list[str] | None = None) -> Column:
    """The record of a prepared contact."""
    if format == "cabrillo":
        return writers.cabrillo_line(cabrillo_fields())
    if format == "edi":
        return writers.edi_line(edi_fields())
    if format == "csv":
        safe = lambda x: F.when(x.rlike("^[\\s\\x00-\\x1f]*[=+@-]") | x.rlike("^[\t\r\n]"), F.concat(F.lit("'"), x)).otherwise(x)
        return writers.csv_line([safe(v(n)) for n in names] + [safe(F.col("original")), safe(F.to_json("unmapped"))])
    given = lambda name, value: F.when((v(name) == "") & (value != ""), F.map_from_arrays(F.array(F.lit(name)), F.array(value))).otherwise(F.create_map().cast(MAP))
    contest = F.when(F.col("m.contest") != "", F.map_from_arrays(F.array(F.lit("CONTEST_ID")), F.array("m.contest"))).otherwise(F.create_map().cast(MAP))
    kept = F.map_filter("values", lambda k, x: (F.coalesce(x, F.lit("")) != "") & ((k != "CONTEST_ID") | (F.col("m.contest") == "")))
    full = F.map_concat(kept, given("STATION_CALLSIGN", F.col("m.station")), given("MY_GRIDSQUARE", F.col("m.locator")), contest)
    target = lambda k: F.when((k == "QSO_POINTS") | k.startswith("EDI_"), F.concat(F.lit("APP_QSOLAKE_"), k)).otherwise(k)
    tags = F.transform(F.array_sort(_entries(full)), lambda e: writers.adif_tag(target(e["key"]), e["value"]))
    left = F.when(F.size("unmapped") > 0, F.array(writers.adif_tag("APP_QSOLAKE_UNMAPPED", F.to_json("unmapped")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(F.concat(tags, F.array(writers.adif_tag("APP_QSOLAKE_SOURCE_ROW", F.coalesce("original", F.lit("")))), left), " "), F.lit(" <EOR>"))


def columns_of(contacts: DataFrame) -> list[str]:
    """The fields that any contact has, sorted: the head of a csv (a bounded set of names)."""
    names = contacts.select(F.explode(F.map_keys("values")).alias("k")).distinct()
    return sorted(r.k for r in names.collect())


def export(contacts: DataFrame, format: str, metadata: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """path, nth, line: the records of every file that nothing keeps from being written, each a row.

    names are the columns of a csv, columns_of(contacts) if not given."""
    bad = gated(contacts, format, metadata).where("severity = 'error'").select("path").distinct()
    rows, _ = prepared(contacts, metadata)
    if format == "csv" and names is None:
        names = columns_of(contacts)
    return rows.join(bad, "path", "left_anti").select("path", "nth", record(format, names).alias("line"))


def heads(contacts: DataFrame, format: str, metadata: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """path, head, tail: what stands before and after the records of a file."""
    _, files = prepared(contacts, metadata)
    if format == "adif":
        head, tail = F.concat(writers.adif_tag("ADIF_VER", F.lit("3.1.7")), F.lit(" "), writers.adif_tag("PROGRAMID", F.lit("qsolake")), F.lit(" <EOH>")), F.lit("")
    elif format == "csv":
        head, tail = F.lit(",".join([*(columns_of(contacts) if names is None else names), "SOURCE_ROW", "UNMAPPED"])), F.lit("")
    elif format == "cabrillo":
        head = F.concat_ws("\n", F.lit("START-OF-LOG: 3.0"), F.concat(F.lit("CALLSIGN: "), "station"), F.concat(F.lit("CONTEST: "), "contest"), F.lit("CREATED-BY: qsolake"))
        tail = F.lit("END-OF-LOG:")
    else:
        total = F.when((F.col("scoring") == "supplied-points") & F.col("all_points"), F.coalesce("points", F.lit(0)).cast("string")).otherwise(F.col("claimed"))
        band = F.coalesce(mapped(F.col("band"), EDI_BANDS), F.col("band"))
        pairs = {"TName": F.col("contest"), "TDate": F.col("dates"), "PCall": F.col("station"), "PWWLo": F.col("locator"), "PBand": band,
                 "CQSOs": F.concat(F.col("counted").cast("string"), F.lit(";1")), "CQSOP": F.coalesce(F.col("points").cast("string"), F.lit("")), "CToSc": total}
        stated = [F.concat(F.lit(f"{k}="), x) for k, x in pairs.items()]
        head = F.concat_ws("\n", F.lit("[REG1TEST;1]"), *stated, F.lit("[Remarks]"), F.lit(""), F.concat(F.lit("[QSORecords;"), F.col("n").cast("string"), F.lit("]")))
        tail = F.lit("")
    return files.select("path", head.alias("head"), tail.alias("tail"))


# --- what is lost ------------------------------------------------------------------------------------------------


def reread(lines: DataFrame, format: str, names: list[str] | None = None) -> DataFrame:
    """path, nth and back: the fields that a reader of the format finds in each written record."""
    pairs = lambda fields: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), x.alias("value")) for k, x in fields.items()]), lambda e: e["value"] != ""))
    if format == "adif":
        tags = lines.withColumn("tags", logs.tags_of("line"))
        named = F.transform("tags", lambda t: F.struct(F.regexp_replace(t["name"], "^APP_QSOLAKE_", "").alias("key"), t["value"].alias("value")))
        return tags.select("path", "nth", F.map_from_entries(named).alias("back"))
    if format == "csv":
        # Quotes open and close in pairs, so that a comma with an even number of them after it ends a cell.
        cells = F.split(F.concat(F.lit(","), "line"), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
        bare = F.transform(F.slice(cells, 2, F.size(cells)), lambda x: F.replace(F.regexp_replace(x, '(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
        return lines.select("path", "nth", F.map_from_entries(F.filter(F.arrays_zip(F.array(*map(F.lit, names)).alias("key"), F.slice(bare, 1, len(names)).alias("value")), lambda e: e["value"] != "")).alias("back"))
    if format == "cabrillo":
        f = logs.cabrillo_fields(F.col("line"))
        place = {"CALL": f["CALL"], "QSO_DATE": F.replace(f["QSO_DATE"], F.lit("-")), "TIME_ON": f["TIME_ON"], "STATION_CALLSIGN": f["MY_CALL"], "RST_SENT": f["RST_SENT"],
                 "RST_RCVD": f["RST_RCVD"], "STX_STRING": f["STX_STRING"], "SRX_STRING": f["SRX_STRING"], "MODE": f["MODE"], "FREQ": f["FREQUENCY"]}
        return lines.select("path", "nth", pairs(place).alias("back"))
    parts = F.split("line", ";")
    f = {n: F.get(parts, i) for i, n in enumerate(EDI_FIELDS)}
    place = {"QSO_DATE": F.concat(F.lit("20"), f["DATE"]), "TIME_ON": f["TIME"], "CALL": f["CALL"], "MODE": f["MODE_CODE"], "RST_SENT": f["RST_SENT"], "STX": f["QSO_SENT"], "RST_RCVD": f["RST_RCVD"],
             "SRX": f["QSO_RCVD"], "SRX_STRING": f["EXCHANGE_RCVD"], "GRIDSQUARE": f["WWL_RCVD"], "QSO_POINTS": f["QSO_POINTS"], "EDI_NEW_EXCHANGE": f["NEW_EXCHANGE"],
             "EDI_NEW_WWL": f["NEW_WWL"], "EDI_NEW_DXCC": f["NEW_DXCC"], "EDI_DUPLICATE": f["DUPLICATE"]}
    return lines.select("path", "nth", pairs(place).alias("back"))


def losses(contacts: DataFrame, lines: DataFrame, format: str, metadata: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """path, nth, field, kind, source, written: every field of a written contact that its record lacks (lost), has
    otherwise (changed) or has though the contact doesn't (added). Serials that fill an empty exchange count as held, as do
    station, locator and band that the head of an EDI file states."""
    rows, _ = prepared(contacts, metadata)
    if format == "csv" and names is None:
        names = columns_of(contacts)
    # Whatever depends on the whole contact goes into its entries, so that later expressions read plain columns.
    nothing = F.lit(None).cast("string")
    mode = {"cabrillo": cabrillo_mode, "edi": edi_mode}.get(format, lambda: nothing)()
    heads_of = {"STATION_CALLSIGN": "station", "MY_GRIDSQUARE": "locator", "BAND": "band"} if format == "edi" else {}
    head = lambda key: F.coalesce(*[F.when(key == f, F.col(f"m.{k}")) for f, k in heads_of.items()], nothing)
    entries = F.transform(_entries(F.col("values")), lambda e: F.struct(
        e["key"].alias("field"), e["value"].alias("source"), F.when(e["key"] == "MODE", mode).alias("told"), head(e["key"]).alias("head")))
    source = rows.join(lines.select("path", "nth"), ["path", "nth"]).select("path", "nth", F.inline(entries))
    if format == "cabrillo":
        fills = F.when(F.col("field") == "STX", "STX_STRING").when(F.col("field") == "SRX", "SRX_STRING").otherwise(F.col("field"))
        filled = F.max(F.col("field").isin("STX_STRING", "SRX_STRING")).over(Window.partitionBy("path", "nth", fills))
        source = source.withColumn("field_there", F.when(filled & F.col("field").isin("STX", "SRX"), F.col("field")).otherwise(fills))
    else:
        source = source.withColumn("field_there", F.col("field"))
    back = reread(lines, format, names).select("path", "nth", F.explode("back").alias("field_there", "written"))
    both = source.join(back, ["path", "nth", "field_there"], "full_outer")
    stated, field, source, written = F.lit(False), F.col("field"), F.col("source"), F.col("written")
    same_thing = F.lit(False)
    if format == "edi":
        stated = (field == "EDI_MODE_CODE") | F.coalesce(same(source) == F.col("head"), F.lit(False))
        same_thing = (field == "MODE") & (F.col("told") == written)
    elif format == "cabrillo":
        stated = (field == "BAND") & F.coalesce(mapped(F.upper(source), CABRILLO_BANDS).isNotNull(), F.lit(False))
        same_thing = (field == "MODE") & (F.col("told") == written) & (written != "DG") | (field == "FREQ") & (F.round(source.try_cast("double") * 1000, 6) == written.try_cast("double"))
    own = F.col("field_there").isin("SOURCE_ROW", "UNMAPPED", "CONTEST_ID", "STATION_CALLSIGN", "MY_GRIDSQUARE")
    kind = (
        F.when(field.isNull(), F.when(~own, "added")).when(written.isNull(), F.when(~stated, "lost"))
        .when((written != source) & ~F.coalesce(same_thing, F.lit(False)), "changed")
    )
    return both.select("path", "nth", F.coalesce("field", "field_there").alias("field"), kind.alias("kind"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("written", F.lit("")).alias("written")).where("kind is not null")
