"""Checks of logs: every finding is a row (keys, line_no, severity, code, field).

The checks of a contact are one array expression that is exploded; only the repeated-contact check has a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.functions import radio
from qsolake.sources import logs as source

FINDING = "struct<severity:string,code:string,field:string>"
# The headers that an EDI log needs, and the modes of a Cabrillo contact.
EDI_REQUIRED = ("TNAME", "TDATE", "PCALL", "PWWLO", "PBAND")
MODES = "(?i)^(CW|PH|FM|RY|DG|AM)$"


def finding(wrong: Column, severity: str, code: str, field: str = "") -> Column:
    made = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).alias("field"))
    return F.when(F.coalesce(wrong, F.lit(False)), made)


def findings(rows: DataFrame, keys: list[str], *checks: Column) -> DataFrame:
    real = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return rows.select(*keys, "line_no", F.explode(real).alias("f")).select(*keys, "line_no", "f.*")


def valid_date(value: Column, form: str = "yyyy-MM-dd") -> Column:
    shape = "^" + "".join("\\d" if c.isalpha() else c for c in form) + "$"
    return value.rlike(shape) & F.try_to_timestamp(value, F.lit(form)).isNotNull()


def valid_time(value: Column) -> Column:
    return value.rlike("^([01]\\d|2[0-3])[0-5]\\d$")


def check_cabrillo(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """Findings of Cabrillo logs; those of the whole log have line_no 0 where no line is to blame."""
    keys = [c for c in logs.columns if c != text_col]
    rows = source.cabrillo_lines(logs, text_col)
    content = ~F.col("kind").isin("blank", "comment")
    first = lambda key: F.min(F.when(F.col("key") == key, F.struct("line_no", F.regexp_replace("value", "^\\s+|\\s+$", "").alias("v"))))
    heads = rows.groupBy(*keys).agg(
        F.min(F.when(content, F.struct("line_no", "key"))).alias("start"), F.max(F.coalesce(F.col("key") == "END-OF-LOG", F.lit(False))).alias("ended"),
        first("CALLSIGN").alias("own"), first("CONTEST").alias("contest"),
    )
    line = lambda c: F.coalesce(F.col(c)["line_no"], F.lit(0))
    blank = lambda c: F.coalesce(F.col(c)["v"], F.lit("")) == ""
    whole = [
        (line("start"), finding(F.coalesce(F.col("start")["key"], F.lit("")) != "START-OF-LOG", "error", "CAB-START")),
        (F.lit(0), finding(~F.col("ended"), "error", "CAB-END")),
        (line("own"), finding(blank("own"), "error", "CAB-HEADER-REQUIRED", "CALLSIGN")),
        (line("contest"), finding(blank("contest"), "error", "CAB-HEADER-REQUIRED", "CONTEST")),
        (line("own"), finding(~blank("own") & ~radio.plausible_callsign(F.col("own")["v"]), "warning", "CAB-CALLSIGN", "CALLSIGN")),
    ]
    placed = F.filter(F.array(*[F.when(c.isNotNull(), F.struct(n.alias("line_no"), c.alias("f"))) for n, c in whole]), lambda x: x.isNotNull())
    of_log = heads.select(*keys, F.explode(placed).alias("p")).select(*keys, "p.line_no", "p.f.*")
    contacts = source.cabrillo_contacts(logs, text_col)
    band = F.coalesce(radio.band_from_frequency(F.col("FREQUENCY")), F.lit(""))
    nth = F.row_number().over(Window.partitionBy(*keys, band, "MODE", F.upper("CALL")).orderBy("line_no"))
    of_contacts = findings(
        contacts.withColumn("_nth", nth), keys,
        finding(F.col("CALL") == "", "error", "QSO-CALL-EMPTY", "CALL"),
        finding((F.col("CALL") != "") & ~radio.plausible_callsign(F.col("CALL")), "warning", "QSO-CALL", "CALL"),
        finding(~valid_date(F.col("QSO_DATE")), "error", "QSO-DATE", "QSO_DATE"),
        finding(~valid_time(F.col("TIME_ON")), "error", "QSO-TIME", "TIME_ON"),
        finding(band == "", "warning", "QSO-FREQUENCY", "FREQUENCY"),
        finding(~F.col("MODE").rlike(MODES), "warning", "QSO-MODE", "MODE"),
        finding(F.col("SRX_STRING") == "", "warning", "QSO-EXCHANGE", "SRX_STRING"),
        finding((F.col("_nth") > 1) & (F.col("CALL") != ""), "warning", "QSO-DUPLICATE", "CALL"),
    )
    return of_log.unionByName(of_contacts)


def check_edi(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """Findings of EDI logs: signature, marker, declared number, headers and the fields of records."""
    keys = [c for c in logs.columns if c != text_col]
    text = F.col(text_col)
    declared = F.regexp_extract(text, "(?im)^\\s*\\[QSORecords;(\\d+)\\]\\s*$", 1)
    n = F.size(source._after_marker(source.split_lines(text)))
    heads = source.edi_headers(logs, text_col).withColumn("line_no", F.lit(0))
    whole = logs.withColumn("line_no", F.lit(0))
    record = [
        finding(F.col("n_fields") != len(source.EDI_FIELDS), "error", "EDI-FIELD-COUNT"),
        finding(~valid_date(F.col("DATE"), "yyMMdd"), "error", "EDI-QSO-DATE", "DATE"),
        finding(~valid_time(F.col("TIME")), "error", "EDI-QSO-TIME", "TIME"),
        finding(F.col("CALL") == "", "error", "EDI-QSO-CALL", "CALL"),
        finding(~F.col("MODE_CODE").rlike("^[0-9]?$"), "warning", "EDI-QSO-MODE", "MODE_CODE"),
        finding((F.col("WWL_RCVD") != "") & ~F.col("WWL_RCVD").rlike("(?i)^[A-R]{2}[0-9]{2}([A-X]{2})?$"), "warning", "EDI-QSO-WWL", "WWL_RCVD"),
        finding((F.col("QSO_POINTS") != "") & ~F.col("QSO_POINTS").rlike("^\\d+$"), "error", "EDI-QSO-POINTS", "QSO_POINTS"),
    ]
    return (
        findings(
            whole, keys,
            finding(~text.rlike("(?im)^\\s*\\[REG1TEST;[^\\]]+\\]\\s*$"), "error", "EDI-SIGNATURE"),
            finding(declared == "", "error", "EDI-RECORDS-MARKER"),
            finding((declared != "") & (declared.try_cast("int") != n), "error", "EDI-RECORD-COUNT"),
        )
        .unionByName(findings(heads, keys, *[finding(F.coalesce(F.col("headers")[k], F.lit("")) == "", "error", "EDI-HEADER-REQUIRED", k) for k in EDI_REQUIRED]))
        .unionByName(findings(source.edi_contacts(logs, text_col), keys, *record))
    )


def check_adif(records: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of ADIF records (source.adif_records): line_no is the record's number."""
    of = lambda name: source.tag("tags", name)
    return findings(
        records.withColumn("line_no", F.col("record")), keys,
        finding(of("CALL") == "", "error", "ADIF-CALL-EMPTY", "CALL"),
        finding((of("CALL") != "") & ~radio.plausible_callsign(of("CALL")), "warning", "ADIF-CALL", "CALL"),
        finding(~valid_date(of("QSO_DATE"), "yyyyMMdd"), "error", "ADIF-DATE", "QSO_DATE"),
        finding(~of("TIME_ON").rlike("^([01]\\d|2[0-3])[0-5]\\d([0-5]\\d)?$"), "error", "ADIF-TIME", "TIME_ON"),
        finding((of("BAND") == "") & (of("FREQ") == ""), "error", "ADIF-BAND", "BAND"),
        finding(of("MODE") == "", "error", "ADIF-MODE", "MODE"),
        finding((of("GRIDSQUARE") != "") & ~of("GRIDSQUARE").rlike("(?i)^[A-R]{2}([0-9]{2}([A-X]{2}([0-9]{2})?)?)?$"), "error", "ADIF-GRID", "GRIDSQUARE"),
    )
