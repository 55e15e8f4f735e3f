"""What keeps contacts from being accepted elsewhere: one row a finding, for one of eight destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.functions.radio import adif_frequency_band, plausible_callsign, trimmed
from qsolake.sources.logs import tag

PROFILES = ["generic", "lotw", "clublog", "qrz", "pota", "sota", "wwff", "iota"]
# What a station's location is made of, and the common forms of references.
LOCATION = ["MY_DXCC", "MY_STATE", "MY_CNTY", "MY_CQ_ZONE", "MY_ITU_ZONE", "MY_GRIDSQUARE", "MY_VUCC_GRIDS"]
REFERENCES = {
    "POTA": r"^[A-Z0-9]{1,4}-\d{4,5}$", "SOTA": r"^[A-Z0-9]{1,4}/[A-Z0-9]{2}-\d{3}$", "WWFF": r"^[A-Z0-9]{1,4}FF-\d{4,5}$",
    "IOTA": r"^(AF|AN|AS|EU|NA|OC|SA)-\d{3}$",
}
GRID = r"(?i)^[A-R]{2}\d{2}([A-X]{2}(\d{2})?)?(,[A-R]{2}\d{2}([A-X]{2}(\d{2})?)?)*$"


def valid_date(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\d{8}$") & F.try_to_date(x, "yyyyMMdd").isNotNull(), F.lit(False))


def valid_time(x: Column) -> Column:
    return x.rlike("^([01][0-9]|2[0-3])[0-5][0-9]([0-5][0-9])?$")


def finding(condition: Column, severity: str, code: str, field: str) -> Column:
    made = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).alias("field"))
    return F.when(F.coalesce(condition, F.lit(False)), made)


def core(name: str, t) -> list[Column]:
    """Required fields, and that call, date, time and band make sense."""
    needed = [("CALL", None), ("QSO_DATE", None), ("TIME_ON", "TIME_OFF"), ("BAND", "FREQ"), ("MODE", None)]
    out = [finding((t(a) == "") & ((t(b) == "") if b else F.lit(True)), "error", f"{name}-REQUIRED", a) for a, b in needed]
    time = F.coalesce(F.nullif(t("TIME_ON"), F.lit("")), t("TIME_OFF"))
    band, told = F.upper(trimmed(t("BAND"))), adif_frequency_band(t("FREQ"))
    return [
        *out, finding((t("CALL") != "") & ~plausible_callsign(t("CALL")), "warning", f"{name}-CALL", "CALL"),
        finding((t("QSO_DATE") != "") & ~valid_date(t("QSO_DATE")), "error", f"{name}-DATE", "QSO_DATE"),
        finding((time != "") & ~valid_time(time), "error", f"{name}-TIME", "TIME_ON"),
        finding((band != "") & (t("FREQ") != "") & (told != "") & (band != told), "error", f"{name}-BAND-FREQ", "FREQ"),
    ]


def activity(t, program: str) -> Column:
    """The reference of a program, the station's own before the worked one's."""
    own = F.when(F.upper(t("MY_SIG")) == program, t("MY_SIG_INFO")).otherwise("")
    return F.coalesce(F.nullif(own, F.lit("")), F.when(F.upper(t("SIG")) == program, t("SIG_INFO")), F.lit(""))


def findings(records: DataFrame, profile: str, *, date_from: str = "", date_to: str = "", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, record, severity, code, field of each finding. records: keys, record, tags, and w_country of the call for
    clublog. A log of several station locations gives lotw one finding without a record."""
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile}")
    t = lambda name: tag("tags", name)
    name, out = profile.upper(), []
    if profile != "generic":
        out += core(name, t)
    if profile == "lotw":
        prop = F.upper(t("PROP_MODE"))
        out += [
            finding(t("STATION_CALLSIGN") == "", "error", "LOTW-REQUIRED", "STATION_CALLSIGN"),
            finding((prop == "SAT") & (t("SAT_NAME") == ""), "error", "LOTW-SAT-NAME", "SAT_NAME"),
            finding((t("SAT_NAME") != "") & (prop != "SAT"), "error", "LOTW-PROP-SAT", "PROP_MODE"),
        ]
    elif profile == "clublog":
        if "w_country" in records.columns:
            out.append(finding((t("COUNTRY") != "") & (F.upper(t("COUNTRY")) != F.upper("w_country")), "warning", "CLUBLOG-ENTITY", "COUNTRY"))
        out.append(finding((t("QSL_RCVD") == "") & (t("LOTW_QSL_RCVD") == ""), "info", "CLUBLOG-QSL-STATUS", "QSL_RCVD"))
    elif profile == "qrz":
        for field, most in (("CQZ", 40), ("ITUZ", 90)):
            fine = t(field).rlike(r"^\d+$") & t(field).try_cast("long").between(1, most)
            out.append(finding((t(field) != "") & ~F.coalesce(fine, F.lit(False)), "error", f"QRZ-{field}", field))
        if date_from:
            out.append(finding(t("QSO_DATE") < date_from.replace("-", ""), "error", "QRZ-DATE-RANGE", "QSO_DATE"))
        if date_to:
            out.append(finding(t("QSO_DATE") > date_to.replace("-", ""), "error", "QRZ-DATE-RANGE", "QSO_DATE"))
    elif profile in ("pota", "sota", "wwff"):
        reference = activity(t, name)
        out += [
            finding(reference == "", "error", f"{name}-REFERENCE", "MY_SIG_INFO"),
            finding((reference != "") & ~F.upper(reference).rlike(REFERENCES[name]), "warning", f"{name}-REFERENCE-FORMAT", "MY_SIG_INFO"),
        ]
    elif profile == "iota":
        reference = F.coalesce(F.nullif(t("MY_IOTA"), F.lit("")), t("IOTA"))
        out += [
            finding(reference == "", "error", "IOTA-REFERENCE", "MY_IOTA"),
            finding((reference != "") & ~F.upper(reference).rlike(REFERENCES["IOTA"]), "error", "IOTA-REFERENCE-FORMAT", "MY_IOTA"),
        ]
    out += [finding((t(g) != "") & ~trimmed(t(g)).rlike(GRID), "error", f"{name}-GRID", g) for g in ("GRIDSQUARE", "MY_GRIDSQUARE")]
    found = records.select(*keys, "record", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("f")).select(*keys, "record", "f.*")
    if profile == "lotw":
        place = F.concat_ws("|", F.upper(t("STATION_CALLSIGN")), *[F.upper(t(c)) for c in LOCATION])
        stations = records.where(t("STATION_CALLSIGN") != "").groupBy(*keys).agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b")
        mixed = stations.select(*keys, F.lit(None).cast("int").alias("record"), F.lit("error").alias("severity"), F.lit("LOTW-MIXED-LOCATION").alias("code"), F.lit("STATION_CALLSIGN").alias("field"))
        found = found.unionByName(mixed)
    return found


def outcome(records: DataFrame, found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, record, outcome: rejected with an error, review with a warning, else ready."""
    worst = found.where("record is not null").groupBy(*keys, "record").agg(
        F.bool_or(F.col("severity") == "error").alias("bad"), F.bool_or(F.col("severity") == "warning").alias("odd")
    )
    state = F.when(F.coalesce("bad", F.lit(False)), "rejected").when(F.coalesce("odd", F.lit(False)), "review").otherwise("ready")
    return records.select(*keys, "record").join(worst, [*keys, "record"], "left").select(*keys, "record", state.alias("outcome"))
