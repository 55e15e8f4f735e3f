"""Contact-log views over the driver's tables, in SQL expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One row for each event: a contact of one of ten stations.
QSO = {
    "doc_id": "user_id % 10",
    "line_no": "event_id",
    "qso_date": "CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS STRING)",
    "time_on": "lpad(CAST(hour(ts) * 100 + minute(ts) AS STRING), 4, '0')",
    "epoch_min": "CAST((day(ts) * 24 + hour(ts)) * 60 + minute(ts) AS BIGINT)",
    "call": """CASE user_id % 7 WHEN 0 THEN 'K' WHEN 1 THEN 'G' WHEN 2 THEN 'DL' WHEN 3 THEN 'JA' WHEN 4 THEN 'VE' WHEN 5 THEN 'PY' ELSE 'ZS' END
      || CAST(user_id % 10 AS STRING) || CASE user_id % 5 WHEN 0 THEN 'AB' WHEN 1 THEN 'XYZ' WHEN 2 THEN 'Q/P' WHEN 3 THEN 'WW' ELSE 'RC/7' END""",
    "freq": """CASE event_id % 9 WHEN 0 THEN '1840' WHEN 1 THEN '3550' WHEN 2 THEN '7.05' WHEN 3 THEN '14050' WHEN 4 THEN '21050,5'
      WHEN 5 THEN '28.4' WHEN 6 THEN '144300' WHEN 7 THEN '10.368G' ELSE '999999' END""",
    "mode": "CASE event_type WHEN 'view' THEN 'CW' WHEN 'click' THEN 'PH' WHEN 'signup' THEN 'RY' WHEN 'purchase' THEN 'cw' ELSE 'DG' END",
    "sent": "CAST(user_id % 40 + 1 AS STRING)",
    "rcvd": "CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'NM' WHEN 2 THEN 'YL' ELSE CAST(event_id % 40 + 1 AS STRING) END",
    "my_grid": "'JN' || CAST(user_id % 10 AS STRING) || CAST(event_id % 3 AS STRING) || 'CR'",
    "grid": "CASE event_id % 13 WHEN 0 THEN '' ELSE 'KO' || CAST(event_id % 10 AS STRING) || CAST(user_id % 10 AS STRING) || 'AT' END",
    "comment": "CASE event_id % 17 WHEN 0 THEN '=1+1' WHEN 1 THEN 'a,b' WHEN 2 THEN 'say \"hi\"' ELSE event_type END",
}
#: The station that each log belongs to.
STATION = "CASE doc_id % 4 WHEN 0 THEN 'DL1AA' WHEN 1 THEN 'K2BB' WHEN 2 THEN 'JA3CC' ELSE 'ZS4DD' END"
# A small country table for the views (prefix, exact call, country, continent, CQ zone, ITU zone).
COUNTRIES = [
    ("K", False, "United States", "NA", 4, 8), ("K7", False, "United States West", "NA", 3, 6), ("G", False, "England", "EU", 14, 27),
    ("DL", False, "Germany", "EU", 14, 28), ("JA", False, "Japan", "AS", 25, 45), ("VE", False, "Canada", "NA", 5, 9),
    ("VE7", False, "Canada West", "NA", 3, 2), ("PY", False, "Brazil", "SA", 11, 15), ("ZS", False, "South Africa", "AF", 38, 57),
    ("ZS9", False, "Marion", "AF", 38, 57), ("G0AB", True, "Exact Island", "EU", 15, 28), ("7", False, "Region Seven", "AF", 33, 46),
]


def select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


QSO_SQL = f"(SELECT *, {STATION} AS my_call FROM (SELECT {select(QSO)} FROM events))"
COUNTRY_SQL = "(SELECT * FROM (VALUES " + ", ".join(str(c).replace("True", "TRUE").replace("False", "FALSE") for c in COUNTRIES) + ") AS c(prefix, exact, country, continent, cq_zone, itu_zone))"


def qso(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[f"{v} AS {k}" for k, v in QSO.items()]).selectExpr("*", f"{STATION} AS my_call")


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, "prefix string, exact boolean, country string, continent string, cq_zone int, itu_zone int")
