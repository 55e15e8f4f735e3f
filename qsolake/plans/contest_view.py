"""A view of contest contacts over the events table, in expressions that Spark and DuckDB read alike.

It holds what contest rules tell apart: stations and worked calls of many entities (some in none), mobile and portable
calls, every kind of exchange, locators of four and six places, and frequencies of all kinds. A log is one station's
part of 100,000 events, so logs stay bounded and their number grows with the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Stations, stems of worked calls, calls that rules name, exchanges and frequencies of the view.
STATIONS = (
    "DL1AA K2BB JA3CC ZS4DD G4EE OK1FF YO5GG UR5HH RA3II UN7JJ YB1KK PA3LL ON4MM LZ2NN HA5OO 4X4PP 4L1QQ SP3RR EA5SS I2TT CT1UU F5VV OH2WW "
    "SM5XX 9A1YY YU7ZZ HB9AB ES1CD LY2EF VE3GH XE1IJ JT1KL PY2MN VK2OP XX1QR RA9ST TM5UV RA2WX JT1YZ SV5AB/QRP OM3CD GM3EF CU2GH KH6IJ"
)
STEMS = (
    "K1 W4 N6 AA0 VE3 VO1 VY2 XE2 KH6 KL7 DL3 DK5 G4 GM3 GW4 F5 TM2 I2 IT9 IK4 IS0 ON4 PA3 HB9 HB0 OE1 OK1 OM3 SP3 SQ9 HA5 HG1 YO5 YU7 LZ2 "
    "9A1 SV1 SV5 SV9 ES1 YL2 LY2 OH2 SM5 LA3 OZ1 UR5 RA3 RA9 RA0 RA2 RA1 UN7 4L1 4X4 4Z5 JA1 JE7 JD1 HL2 BY1 YB1 YC0 8A2 VK2 ZL1 ZS6 ZS1 3B8 "
    "7P8 PY2 LU5 CE3 TF3 CT1 CT3 CU2 EA5 EB1 EA8 XX9 QQ1 JT1 JU1 R1F FT8W"
)
NAMED = "IQ4FF I4JEE EA4URE CT1ARR CQ3EPC GB4RN VE1RAC VE7RAC R1AN1 KG4ABC KG4AB AG4Z YB9ZZ/MM RA6PX RA9WA RA0QA RA5SA"
SUFFIXES = "- - - - - - - - /P /M /MM /A /QRP /N /7 - -"
RECEIVED = (
    "- OH CA NY TX MD DC HI NB QC ON PEI NWT NT SK AB BC MAR ALB KIN NYC EMA LAX GH 5 14 05 27 28 40 41 001 599 17 30 DX YL NM TRC RCC12 UR-KI "
    "EPC0123 EPC0000 EPC EU-005 OC-021 0000 A12 /77 B/9 12A34 DOK B07 BU ZG GR NH ANT AN BW M KI DO CC LU SS AGS JAL ROMA MI SO W5 5W 100 AF SA "
    "ABC ABQ XYM 599_14 5_MI 559_OH 599_KI JN75CR KO12AT JN75 SM1 SM2 2SM1 0 -3 7.5 10W 3W5 X PE NF XX1 ALBC CAL1 Z9"
)
SENT = "14 27 05 ALB KIN ABCD OH A1 EU-005 UR-1 TRC SM1 AB 5 100 23 YL JN75CR KO12AT OC-021 28 SM2"
FREQUENCIES = (
    "1840 1950 2050 3550 3799 3999 5300 7.05 7.12 10120 14050 14200 18.1 21050,5 24900 28.4 28050 50 50100 70 144 144300 222 432 433000 903 1296.2 "
    "2.3 1.2 5760 10 10.368G 24 999999 14.1 7010 3501 21.2 28600 144.3 1850"
)
SPECIAL_CELLS = "OH ON PEI 27 5 ZG KI 14 AN BU"


def word(words: str, number: str) -> str:
    """The word at a number that is taken round the list; - is empty, _ a blank."""
    n = len(words.split())
    return f"replace(replace(split_part('{words}', ' ', CAST(({number}) % {n} AS INT) + 1), '-', '#'), '_', ' ')"


def plain(words: str, number: str, hyphens: bool = False) -> str:
    """word(), with a lone - as nothing and other hyphens kept."""
    w = word(words, number)
    return f"CASE WHEN {w} = '#' THEN '' ELSE replace({w}, '#', '-') END"


N = "(user_id % 44 + 44 * CAST(floor(event_id / 100000) AS BIGINT))"
MIX = "((event_id * 7919 + user_id * 104729) % 1000003)"
COLUMNS = {
    "doc_id": N,
    "line_no": "event_id",
    "qso_date": "CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS STRING)",
    "time_on": "lpad(CAST(hour(ts) * 100 + minute(ts) AS STRING), 4, '0')",
    "my_call": plain(STATIONS, N),
    "call": f"""CASE WHEN event_id % 19 = 0 THEN {plain(NAMED, MIX)} ELSE concat({plain(STEMS, MIX)},
      CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'TBC' WHEN 2 THEN 'XY' ELSE 'WPQ' END, {plain(SUFFIXES, "event_id + user_id")}) END""",
    "freq": plain(FREQUENCIES, "event_id"),
    "mode": "CASE event_type WHEN 'view' THEN 'CW' WHEN 'click' THEN 'PH' WHEN 'signup' THEN 'RY' WHEN 'purchase' THEN 'cw' ELSE 'FM' END",
    "sent": plain(SENT, f"{N} + event_id % 2 * 3"),
    "rcvd": plain(RECEIVED, f"{MIX} + event_id"),
    "srx_string": f"CASE WHEN event_id % 9 = 0 THEN {plain(SPECIAL_CELLS, MIX)} ELSE '' END",
    "my_grid": "CASE WHEN event_id % 11 = 0 THEN 'JN75' ELSE concat('JN', CAST(user_id % 10 AS STRING), CAST(event_id % 3 AS STRING), 'CR') END",
    "grid": """CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 13 = 1 THEN 'KO12' WHEN event_id % 13 = 2 THEN 'JN75CR'
      ELSE concat('KO', CAST(event_id % 10 AS STRING), CAST(user_id % 10 AS STRING), 'AT') END""",
}
# A small country table (prefix, exact call, country, continent, CQ zone, ITU zone, primary prefix).
COUNTRIES = [
    ("K", False, "United States", "NA", 4, 8, "W"), ("W", False, "United States", "NA", 4, 8, "W"), ("N", False, "United States", "NA", 4, 8, "W"),
    ("AA", False, "United States", "NA", 4, 8, "W"), ("AG", False, "United States", "NA", 4, 8, "W"), ("KG4", False, "Guantanamo Bay", "NA", 8, 11, "KG4"),
    ("KH6", False, "Hawaii", "OC", 31, 61, "KH6"), ("KL7", False, "Alaska", "NA", 1, 1, "KL7"), ("VE", False, "Canada", "NA", 5, 9, "VE"),
    ("VO", False, "Canada", "NA", 5, 9, "VE"), ("VY", False, "Canada", "NA", 5, 9, "VE"), ("XE", False, "Mexico", "NA", 6, 10, "XE"),
    ("DL", False, "Germany", "EU", 14, 28, "DL"), ("DK", False, "Germany", "EU", 14, 28, "DL"), ("G", False, "England", "EU", 14, 27, "G"),
    ("GM", False, "Scotland", "EU", 14, 27, "GM"), ("GW", False, "Wales", "EU", 14, 27, "GW"), ("F", False, "France", "EU", 14, 27, "F"),
    ("TM", False, "France", "EU", 14, 27, "F"), ("FT8W", False, "Crozet", "AF", 39, 68, "FT8W"), ("I", False, "Italy", "EU", 15, 28, "I"),
    ("IT9", False, "Sicily", "EU", 15, 28, "IT9"), ("IS0", False, "Sardinia", "EU", 15, 28, "IS"), ("ON", False, "Belgium", "EU", 14, 27, "ON"),
    ("PA", False, "Netherlands", "EU", 14, 27, "PA"), ("HB", False, "Switzerland", "EU", 14, 28, "HB"), ("HB0", False, "Liechtenstein", "EU", 14, 28, "HB0"),
    ("OE", False, "Austria", "EU", 15, 28, "OE"), ("OK", False, "Czech Republic", "EU", 15, 28, "OK"), ("OM", False, "Slovak Republic", "EU", 15, 28, "OM"),
    ("SP", False, "Poland", "EU", 15, 28, "SP"), ("SQ", False, "Poland", "EU", 15, 28, "SP"), ("HA", False, "Hungary", "EU", 15, 28, "HA"),
    ("HG", False, "Hungary", "EU", 15, 28, "HA"), ("YO", False, "Romania", "EU", 20, 28, "YO"), ("YU", False, "Serbia", "EU", 15, 28, "YU"),
    ("LZ", False, "Bulgaria", "EU", 20, 28, "LZ"), ("9A", False, "Croatia", "EU", 15, 28, "9A"), ("SV", False, "Greece", "EU", 20, 28, "SV"),
    ("SV5", False, "Dodecanese", "EU", 20, 28, "SV5"), ("SV9", False, "Crete", "EU", 20, 28, "SV9"), ("ES", False, "Estonia", "EU", 15, 29, "ES"),
    ("YL", False, "Latvia", "EU", 15, 29, "YL"), ("LY", False, "Lithuania", "EU", 15, 29, "LY"), ("OH", False, "Finland", "EU", 15, 18, "OH"),
    ("SM", False, "Sweden", "EU", 14, 18, "SM"), ("LA", False, "Norway", "EU", 14, 18, "LA"), ("OZ", False, "Denmark", "EU", 14, 18, "OZ"),
    ("UR", False, "Ukraine", "EU", 16, 29, "UR"), ("RA", False, "European Russia", "EU", 16, 29, "RA1"), ("R1", False, "European Russia", "EU", 16, 29, "RA1"),
    ("RA9", False, "Asiatic Russia", "AS", 17, 30, "RA0"), ("RA0", False, "Asiatic Russia", "AS", 19, 33, "RA0"), ("RA2", False, "Kaliningrad", "EU", 15, 29, "RA2"),
    ("R1F", False, "Franz Josef Land", "EU", 40, 75, "R1F"), ("UN", False, "Kazakhstan", "AS", 17, 30, "UN"), ("4L", False, "Georgia", "AS", 21, 29, "4L"),
    ("4X", False, "Israel", "AS", 20, 39, "4X"), ("4Z", False, "Israel", "AS", 20, 39, "4X"), ("JA", False, "Japan", "AS", 25, 45, "JA"),
    ("JE", False, "Japan", "AS", 25, 45, "JA"), ("JD1", False, "Ogasawara", "AS", 27, 45, "JD/O"), ("HL", False, "South Korea", "AS", 25, 44, "HL"),
    ("BY", False, "China", "AS", 24, 44, "BY"), ("YB", False, "Indonesia", "OC", 28, 51, "YB"), ("YC", False, "Indonesia", "OC", 28, 51, "YB"),
    ("8A", False, "Indonesia", "OC", 28, 54, "YB"), ("VK", False, "Australia", "OC", 30, 59, "VK"), ("ZL", False, "New Zealand", "OC", 32, 60, "ZL"),
    ("ZS", False, "South Africa", "AF", 38, 57, "ZS"), ("3B8", False, "Mauritius", "AF", 39, 53, "3B8"), ("7P", False, "Lesotho", "AF", 38, 57, "7P"),
    ("PY", False, "Brazil", "SA", 11, 15, "PY"), ("LU", False, "Argentina", "SA", 13, 14, "LU"), ("CE", False, "Chile", "SA", 12, 14, "CE"),
    ("TF", False, "Iceland", "EU", 40, 17, "TF"), ("CT", False, "Portugal", "EU", 14, 37, "CT"), ("CS", False, "Portugal", "EU", 14, 37, "CT"),
    ("CT3", False, "Madeira", "AF", 33, 36, "CT3"), ("CQ3", False, "Madeira", "AF", 33, 36, "CT3"), ("CU", False, "Azores", "EU", 14, 36, "CU"),
    ("EA", False, "Spain", "EU", 14, 37, "EA"), ("EB", False, "Spain", "EU", 14, 37, "EA"), ("EA8", False, "Canary Islands", "AF", 33, 36, "EA8"),
    ("XX9", False, "Macao", "AS", 24, 44, "XX9"), ("JT", False, "Mongolia", "AS", 23, 32, "JT"), ("JU", False, "Mongolia", "AS", 23, 32, "JT"),
    ("KG4AB", True, "Guantanamo Bay", "NA", 8, 11, "KG4"), ("7", False, "Region Seven", "AF", 33, 46, "7X"),
]
FIELDS = "prefix string, exact boolean, country string, continent string, cq_zone int, itu_zone int, primary string"
CONTACTS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM events)"
COUNTRIES_SQL = (
    "(SELECT * FROM (VALUES " + ", ".join(str(c).replace("True", "TRUE").replace("False", "FALSE") for c in COUNTRIES)
    + ") AS c(prefix, exact, country, continent, cq_zone, itu_zone, prim))"
)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{v} AS {k}" for k, v in COLUMNS.items()])


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, FIELDS)
