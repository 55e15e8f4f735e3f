"""QTC lines of Cabrillo logs, and their checks.

A QTC passes an earlier contact on; it belongs to a series of declared size. Series, pairs of stations and repeated
reports are grouped within a log by their own keys, so no task holds a log's lines. A null text has no line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qsolake.functions import radio
from qsolake.operators.cabrillo_lines import WAE_CONTESTS, contest_contacts, layout_table
from qsolake.operators.checks import finding, findings, valid_date, valid_time
from qsolake.operators.lookup import country_lookup
from qsolake.plans.contest_sets import WAE_EUROPE
from qsolake.sources import logs as source

# The columns of a QTC line (name, first column, end); the frequencies, series and sizes that hold.
COLUMNS = (
    ("frequency", 5, 10), ("mode", 11, 13), ("date", 14, 24), ("time", 25, 29), ("receiver", 30, 43), ("series", 44, 50), ("sender", 55, 68), ("qso_time", 69, 73),
    ("qso_call", 74, 87), ("qso_serial", 88, 92),
)
FREQUENCY = r"^(3[5-9]\d{2}|7\d{3}|14\d{3}|21\d{3}|28\d{3})$"
SERIES = r"^(\d{1,3})/(10|[1-9])$"
SERIAL = r"^\d{1,6}$"
MOST = 10


def qtc_lines(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of logs, line_no and the cells of each QTC line: by columns where it has their shape, else by blanks."""
    keys = [c for c in logs.columns if c != text_col]
    rows = source.lines(logs, text_col).where(F.col("raw").rlike("(?i)^\\s*QTC:"))
    at = {n: F.substring("raw", a + 1, b - a) for n, a, b in COLUMNS}
    shaped = (
        (F.length("raw") >= 89) & at["date"].rlike(r"^\d{4}-\d{2}-\d{2}$") & source.trimmed(at["mode"]).rlike("(?i)^(CW|PH|RY)$") & source.trimmed(at["series"]).rlike(SERIES)
    )
    parts = F.split(source.trimmed(F.regexp_replace("raw", "(?i)^\\s*QTC:\\s*", "")), "\\s+")
    cells = F.struct(*[F.when(shaped, source.trimmed(at[n])).otherwise(F.coalesce(F.get(parts, i), F.lit(""))).alias(n) for i, (n, _, _) in enumerate(COLUMNS)])
    return rows.select(*keys, F.col("line_no"), F.inline(F.array(cells)))


def qtc_counts(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of logs and n, the QTCs of each log that has some: what scoring.totals takes as qtcs, if the key is doc_id."""
    keys = [c for c in logs.columns if c != text_col]
    return source.lines(logs, text_col).where(F.col("raw").rlike("(?i)^\\s*QTC:")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def check_qtcs(logs: DataFrame, countries: DataFrame, text_col: str = "text") -> DataFrame:
    """Findings (keys, line_no, severity, code, field) of logs of the contests with QTCs; other logs have none.

    countries is that of country_lookup. What concerns a series stands at its first line, what concerns a pair of stations
    at line 0. Keys are unique in logs."""
    keys = [c for c in logs.columns if c != text_col]
    heads = F.filter(source.split_lines(F.col(text_col)), lambda x: x.rlike("(?i)^\\s*CONTEST:"))
    contest = F.upper(source.trimmed(F.regexp_extract(F.get(heads, F.lit(0)), source.HEADER, 2)))
    mode = F.when(contest.endswith("-CW"), "CW").when(contest.endswith("-SSB"), "PH").otherwise("RY")
    marked = logs.withColumn("expected", mode).where(contest.isin(*WAE_CONTESTS))
    # The expected mode goes along as a key of the log; findings() leaves it out.
    of_contacts = findings(
        contest_contacts(marked, layout_table(logs.sparkSession), text_col), keys,
        finding(F.upper("mode") != F.col("expected"), "error", "WAEDC-QSO-MODE", "MODE"),
        finding(~F.col("sent_exchange").rlike(SERIAL), "error", "WAEDC-STX", "STX_STRING"),
        finding(~F.col("received_exchange").rlike(SERIAL), "error", "WAEDC-SRX", "SRX_STRING"),
    )
    rows = qtc_lines(marked, text_col)
    number = F.regexp_extract("series", SERIES, 1).try_cast("int")
    rows = rows.withColumn("number", F.when(F.col("series").rlike(SERIES), number)).withColumn("band", radio.band_from_frequency(F.col("frequency")))
    upper = lambda c: F.upper(F.col(c))
    report = Window.partitionBy(*keys, "qso_time", upper("qso_call"), "qso_serial").orderBy("line_no")
    placed = rows.withColumn("nth", F.row_number().over(report))
    placed = country_lookup(country_lookup(placed, "receiver", countries, "r_"), "sender", countries, "s_")
    known = F.col("r_primary").isNotNull() & F.col("s_primary").isNotNull()
    european = lambda side: F.col(f"{side}_primary").isin(*WAE_EUROPE)
    voice = F.col("expected") != "RY"
    unlikely = lambda c: ~radio.plausible_callsign(F.col(c))
    of_lines = findings(
        placed, keys,
        finding((F.col("band") == "") | ~F.col("frequency").rlike(FREQUENCY), "error", "QTC-FREQUENCY", "FREQUENCY"),
        finding(upper("mode") != F.col("expected"), "error", "QTC-MODE", "MODE"),
        finding(~F.coalesce(valid_date(F.col("date")), F.lit(False)), "error", "QTC-DATE", "QSO_DATE"),
        finding(~valid_time(F.col("time")), "error", "QTC-TIME", "TIME_ON"),
        finding(~valid_time(F.col("qso_time")), "error", "QTC-QSO-TIME", "TIME_QSO"),
        finding(unlikely("receiver"), "error", "QTC-CALL", "CALL_RX"),
        finding(unlikely("sender"), "error", "QTC-CALL", "CALL_TX"),
        finding(unlikely("qso_call"), "error", "QTC-CALL", "CALL_QSO"),
        finding(~F.col("qso_serial").rlike(r"^\d{1,4}$"), "error", "QTC-SERIAL", "NR_QSO"),
        finding(F.coalesce(F.col("number"), F.lit(0)) < 1, "error", "QTC-GROUP", "QTC_GROUP"),
        finding((F.col("qso_call") != "") & (upper("qso_call") == upper("receiver")), "error", "QTC-RETURN", "CALL_QSO"),
        finding(F.col("nth") > 1, "error", "QTC-REPORTED-TWICE", "CALL_QSO"),
        finding(known & ~voice & (F.col("r_continent") == F.col("s_continent")), "error", "QTC-CONTINENT", "CALL_RX"),
        finding(known & voice & ~european("r"), "error", "QTC-RECEIVER-EU", "CALL_RX"),
        finding(known & voice & european("s"), "error", "QTC-SENDER-DX", "CALL_TX"),
    )
    declared = F.regexp_extract("series", SERIES, 2).try_cast("int")
    signature = F.struct("band", "mode", "receiver")
    series = rows.where("number is not null").groupBy(*keys, upper("sender").alias("_sender"), "number").agg(
        F.min(F.struct("line_no", declared.alias("declared"))).alias("first"), F.count(F.lit(1)).alias("n"), F.min(signature).alias("least"), F.max(signature).alias("most")
    )
    of_series = findings(
        series.withColumn("line_no", F.col("first.line_no")), keys,
        finding(F.col("n") != F.col("first.declared"), "error", "QTC-SERIES-SIZE", "QTC_GROUP"),
        finding(F.col("least") != F.col("most"), "error", "QTC-SERIES-METADATA", "QTC_GROUP"),
    )
    pairs = rows.groupBy(*keys, F.least(upper("sender"), upper("receiver")).alias("_a"), F.greatest(upper("sender"), upper("receiver")).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    of_pairs = findings(pairs.withColumn("line_no", F.lit(0)), keys, finding(F.col("n") > MOST, "error", "QTC-PAIR-LIMIT"))
    return of_contacts.unionByName(of_lines).unionByName(of_series).unionByName(of_pairs)
