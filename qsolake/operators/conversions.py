"""Contacts of one format as those of another: Cabrillo, ADIF and EDI fields mapped column by column.

Every function takes a frame of contacts or records, one row each, and gives the frame with the target's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.functions.radio import band_from_frequency, frequency_from_band, frequency_to_khz, frequency_to_mhz
from qsolake.functions.values import mapped, mode_to_adif
from qsolake.sources.logs import tag

# Names of one format for those of another.
CABRILLO_TO_ADIF = {
    "FREQUENCY": "FREQ", "MODE": "MODE", "QSO_DATE": "QSO_DATE", "TIME_ON": "TIME_ON", "MY_CALL": "STATION_CALLSIGN", "CALL": "CALL",
    "RST_SENT": "RST_SENT", "RST_RCVD": "RST_RCVD", "STX": "STX", "STX_STRING": "STX_STRING", "SRX": "SRX", "SRX_STRING": "SRX_STRING",
    "FREQ_RX": "FREQ_RX", "PROP_MODE": "PROP_MODE", "SAT_MODE": "SAT_MODE", "GRIDSQUARE": "GRIDSQUARE", "MY_GRIDSQUARE": "MY_GRIDSQUARE",
}
DEPRECATED_MODES = {"USB": "SSB", "LSB": "SSB", "PSK31": "PSK", "PSK63": "PSK", "FT4": "MFSK", "JT65A": "JT65"}
ADIF_TO_CABRILLO_MODE = {"SSB": "PH", "USB": "PH", "LSB": "PH", "AM": "PH", "RTTY": "RY", "FM": "FM", "CW": "CW", "PSK": "PS", "SSTV": "TV", "DATA": "DG"}
EDI_MODES = {"1": "SSB", "2": "CW", "3": "SSB", "4": "CW", "5": "AM", "6": "FM", "7": "RTTY", "8": "SSTV", "9": "ATV"}
# Bands of EDI headers in MHz, from the first number up to below the second.
EDI_BANDS = [
    (50, 54, "6M"), (70, 71, "4M"), (144, 148, "2M"), (430, 450, "70CM"), (1200, 1300.000001, "23CM"), (2300, 2450, "13CM"), (3300, 3500, "9CM"),
    (5650, 5925, "6CM"), (10_000, 10_500, "3CM"), (24_000, 24_250, "1.25CM"), (47_000, 47_200, "6MM"), (75_500, 81_500, "4MM"),
    (122_000, 123_000, "2.5MM"), (134_000, 141_000, "2MM"), (241_000, 250_000, "1MM"),
]


def filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def cabrillo_to_adif(contacts: DataFrame, field_map: dict[str, str] | None = None, contest: str = "") -> DataFrame:
    """contacts (Cabrillo fields as columns; excluded ones left out) with tags, the fields of an ADIF record.

    field_map overrides where a column goes; an empty target drops it. Frequencies become MHz, dates lose their dashes,
    modes become mode and submode, and the band follows from the frequency where nothing maps to it. Of columns with
    one target the last that is filled counts. Columns that map to nothing are listed in unmapped where they are filled."""
    rows = contacts.where("not excluded") if "excluded" in contacts.columns else contacts
    targets = {c: (field_map or {}).get(c, CABRILLO_TO_ADIF.get(c, "")) for c in rows.columns if c == c.upper() and not c.startswith("_")}
    values: dict[str, Column] = {}
    for column, target in targets.items():
        if not target:
            continue
        value = filled(column)
        if column == "MODE" and target == "MODE":
            pair = mode_to_adif(value)
            values["SUBMODE"] = F.coalesce(pair["submode"], F.lit(""))
            value = F.when(value == "", "").otherwise(pair["mode"])
        elif column in ("FREQUENCY", "FREQ_RX") and target in ("FREQ", "FREQ_RX"):
            value = F.when(value == "", "").otherwise(frequency_to_mhz(value))
        elif column == "FREQUENCY" and target == "BAND":
            value = band_from_frequency(value)
        elif column == "QSO_DATE" and target == "QSO_DATE":
            value = F.replace(value, F.lit("-"), F.lit(""))
        values[target] = F.coalesce(F.nullif(value, F.lit("")), values[target]) if target in values else value
    if "BAND" not in values and "FREQUENCY" in rows.columns:
        values["BAND"] = band_from_frequency(filled("FREQUENCY"))
    if contest and contest != "GENERIC-CONTEST":
        values["CONTEST_ID"] = F.lit(contest)
    lost = [F.when(filled(c) != "", c) for c, t in targets.items() if not t]
    tags = [F.struct(F.lit(k).alias("name"), v.alias("value"), F.lit(None).cast("string").alias("type")) for k, v in values.items()]
    return rows.withColumn("tags", F.filter(F.array(*tags), lambda t: t["value"] != "")).withColumn(
        "unmapped", F.filter(F.array(*lost), lambda c: c.isNotNull()) if lost else F.array().cast("array<string>")
    )


def adif_mode_to_cabrillo(mode: Column, submode: Column) -> Column:
    told = F.upper(F.coalesce(F.nullif(submode, F.lit("")), mode))
    current = F.coalesce(mapped(told, DEPRECATED_MODES), told)
    return F.coalesce(mapped(current, ADIF_TO_CABRILLO_MODE), F.substring(current, 1, 2))


def adif_to_cabrillo(records: DataFrame, station: str = "", tags: str = "tags") -> DataFrame:
    """records (tags of ADIF records) with the fields of a generic contact line as columns, and inferred.

    FREQ goes before BAND, whose representative frequency is taken (inferred says so), TIME_ON before TIME_OFF, and the
    submode before the mode. The station's call is the given one, else STATION_CALLSIGN, else OPERATOR. Exchanges fall
    back from text to serial."""
    t = lambda name: tag(tags, name)
    first = lambda *names: F.coalesce(*[F.nullif(t(n), F.lit("")) for n in names], F.lit(""))
    from_band = frequency_from_band(t("BAND"))
    date = t("QSO_DATE")
    dashed = F.when(date.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))).otherwise(date)
    return records.withColumns({
        "FREQUENCY": F.when(t("FREQ") != "", frequency_to_khz(t("FREQ"))).otherwise(from_band),
        "MODE": F.when((t("MODE") == "") & (t("SUBMODE") == ""), "").otherwise(adif_mode_to_cabrillo(t("MODE"), t("SUBMODE"))),
        "QSO_DATE": dashed, "TIME_ON": F.substring(first("TIME_ON", "TIME_OFF"), 1, 4),
        "MY_CALL": F.lit(station) if station else first("STATION_CALLSIGN", "OPERATOR"), "RST_SENT": t("RST_SENT"), "STX_STRING": first("STX_STRING", "STX"),
        "CALL": t("CALL"), "RST_RCVD": t("RST_RCVD"), "SRX_STRING": first("SRX_STRING", "SRX"), "inferred": (t("FREQ") == "") & (from_band != ""),
    })


def edi_band(header: Column) -> Column:
    """The band of a PBand header; GHz where it says so."""
    text = F.replace(header, F.lit(","), F.lit("."))
    number = F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double")
    mhz = F.when(text.rlike("(?i)GHz"), number * 1000).otherwise(number)
    out = F
    for low, high, name in EDI_BANDS:
        out = out.when((mhz >= low) & (mhz < high), name)
    return out.otherwise("")


def edi_date(date: Column, contest_start: Column) -> Column:
    """A date of six digits with its century: the contest's, else by the year 70."""
    century = F.when(contest_start.rlike(r"^\d{8}$"), F.substring(contest_start, 1, 2)).when(F.substring(date, 1, 2) >= "70", "19").otherwise("20")
    return F.when(date.rlike(r"^\d{6}$"), F.concat(century, date)).otherwise("")


def edi_to_adif(contacts: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """EDI contacts with the fields of ADIF records as columns; station, locator and band are their log's headers."""
    h = lambda name: F.coalesce(F.try_element_at(F.col("headers"), F.lit(name.upper())), F.lit(""))
    rows = contacts.join(headers, keys, "left")
    start = F.split(h("TDate"), ";")[0]
    flags = F.concat_ws("/", "NEW_EXCHANGE", "NEW_WWL", "NEW_DXCC", "DUPLICATE")
    return rows.select(
        *keys, "line_no", F.col("CALL"), edi_date(F.col("DATE"), start).alias("QSO_DATE"), F.col("TIME").alias("TIME_ON"),
        F.coalesce(mapped(F.col("MODE_CODE"), EDI_MODES), F.lit("")).alias("MODE"), "RST_SENT", F.col("QSO_SENT").alias("STX"), "RST_RCVD",
        F.col("QSO_RCVD").alias("SRX"), F.col("EXCHANGE_RCVD").alias("SRX_STRING"), F.col("WWL_RCVD").alias("GRIDSQUARE"), h("PWWLo").alias("MY_GRIDSQUARE"),
        edi_band(h("PBand")).alias("BAND"), h("PCall").alias("STATION_CALLSIGN"), F.col("QSO_POINTS").alias("EDI_QSO_POINTS"), flags.alias("EDI_FLAGS"),
    )


def triple(name: str) -> list[Column]:
    """Three numbers of a header, 0 where one is missing."""
    parts = F.split(F.coalesce(F.try_element_at(F.col("headers"), F.lit(name.upper())), F.lit("")), ";")
    return [F.coalesce(F.regexp_replace(F.get(parts, F.lit(i)), ",", ".").try_cast("double"), F.lit(0.0)) for i in range(3)]


def edi_scores(contacts: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """One row a log: contacts by status, points, new multipliers and their bonuses, and the total that its claim fits.

    A contact is a duplicate by its flag, an error by its call, incomplete without points, else counted. New locators,
    exchanges and countries are those flagged N among the counted; where none is flagged the header's number counts. The
    formula is the first of points, points + bonuses, points x multipliers, (points + bonuses) x multipliers that gives
    the claimed total (CToSc), else points."""
    points = F.regexp_replace("QSO_POINTS", ",", ".").try_cast("double")
    status = (
        F.when(F.upper(F.trim("DUPLICATE")) == "D", "duplicate").when(F.upper(F.trim("CALL")) == "ERROR", "error")
        .when(points.isNull() | (points <= 0), "incomplete").otherwise("counted")
    )
    counted = F.col("status") == "counted"
    new = lambda c: F.count_if(counted & (F.upper(F.trim(c)) == "N"))
    sums = contacts.withColumn("status", status).withColumn("points", points).groupBy(*keys).agg(
        F.count_if(counted).alias("valid"), F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status").isin("error", "incomplete")).alias("invalid"), F.coalesce(F.sum(F.when(counted, F.col("points"))), F.lit(0.0)).alias("qso_points"),
        new("NEW_WWL").alias("w"), new("NEW_EXCHANGE").alias("e"), new("NEW_DXCC").alias("d"),
    )
    rows = sums.join(headers, keys, "left")
    parts = {"w": triple("CWWLs"), "e": triple("CExcs"), "d": triple("CDXCs")}
    count = {k: F.when(F.col(k) > 0, F.col(k)).otherwise(p[0]).cast("double") for k, p in parts.items()}
    bonus = sum((count[k] * p[1] for k, p in parts.items()), F.lit(0.0))
    product = F.lit(1.0)
    for p in parts.values():
        product = product * F.when(p[2] > 0, p[2]).otherwise(1.0)
    rows = rows.select(
        *keys, "valid", "duplicates", "invalid", "qso_points", *[count[k].cast("long").alias(n) for k, n in (("w", "new_wwls"), ("e", "new_exchanges"), ("d", "new_dxccs"))],
        bonus.alias("bonuses"), product.alias("multipliers"), F.regexp_replace(F.try_element_at(F.col("headers"), F.lit("CTOSC")), ",", ".").try_cast("double").alias("claimed"),
    )
    p, b, m = F.col("qso_points"), F.col("bonuses"), F.col("multipliers")
    formulas = {"points": p, "points-bonuses": p + b, "points-multipliers": p * m, "points-bonuses-multipliers": (p + b) * m}
    chosen = F
    for name, value in formulas.items():
        chosen = chosen.when(value == F.col("claimed"), name)
    rows = rows.withColumn("formula", chosen.otherwise("points")).withColumn("inferred", F.coalesce(F.array_contains(F.array(*formulas.values()), F.col("claimed")), F.lit(False)))
    total = F
    for name, value in formulas.items():
        total = total.when(F.col("formula") == name, value)
    return rows.withColumn("total", total)
