"""The registered queries of exports: contacts of the contact view in files of 50, with defects planted, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsolake.operators import exports
from qsolake.plans import synth

FILE = "CAST(floor(line_no / 50) AS BIGINT)"
# A third of the files has no defect but those of its head.
BAD = f"({FILE} % 3 = 0)"
CONTACT = {
    "path": FILE, "nth": "CAST(line_no % 50 AS INT)", "bad": BAD, "qso_date": f"CASE WHEN {BAD} AND line_no % 31 = 0 THEN '' ELSE qso_date END",
    "time_on": "CASE WHEN line_no % 7 = 0 THEN time_on || '30' ELSE time_on END",
    "freq": "CASE line_no % 4 WHEN 0 THEN '144.3' WHEN 1 THEN '144.25' WHEN 2 THEN '144.0505' ELSE '' END", "band": "'2M'",
    "mode": f"CASE WHEN line_no % 6 = 0 THEN 'SSB' WHEN line_no % 6 = 1 THEN 'CW' WHEN line_no % 6 = 2 THEN 'FM' WHEN line_no % 6 = 3 THEN 'RTTY' WHEN {BAD} THEN 'FT8' ELSE 'AM' END",
    "submode": "CASE WHEN line_no % 12 = 0 THEN 'USB' ELSE '' END",
    "station": f"CASE WHEN {BAD} AND line_no % 50 = 9 AND {FILE} % 2 = 0 THEN 'Q9ZZ' ELSE 'Q1' || CAST({FILE} % 9 AS STRING) || 'AB' END",
    "call": "call", "rst": "CASE WHEN line_no % 6 = 1 THEN '599' ELSE '59' END", "stx": "CAST(line_no % 50 + 1 AS STRING)",
    "srx": f"CASE WHEN {BAD} AND line_no % 37 = 0 THEN '12345' WHEN line_no % 5 = 0 THEN '' ELSE CAST(line_no % 1200 AS STRING) END",
    "srx_string": f"CASE WHEN {BAD} AND line_no % 41 = 0 THEN 'TOOLONG' WHEN line_no % 10 = 0 THEN 'NM' ELSE '' END",
    "grid": f"CASE WHEN {BAD} AND line_no % 43 = 0 THEN 'KO' ELSE grid END", "points": f"CASE WHEN {BAD} AND line_no % 47 = 0 THEN '' ELSE CAST(line_no % 90 AS STRING) END",
    "comment": "comment",
}
NAMES = {
    "QSO_DATE": "qso_date", "TIME_ON": "time_on", "FREQ": "freq", "BAND": "band", "MODE": "mode", "SUBMODE": "submode", "STATION_CALLSIGN": "station", "CALL": "call", "RST_SENT": "rst",
    "RST_RCVD": "rst", "STX": "stx", "SRX": "srx", "SRX_STRING": "srx_string", "GRIDSQUARE": "grid", "QSO_POINTS": "points", "COMMENT": "comment",
}
HEAD = {
    "utc_confirmed": "path % 7 <> 1", "contest": "CASE WHEN path % 11 = 2 THEN '' ELSE 'SPRING' END", "station": "CAST(NULL AS STRING)", "locator": "'KK11AA'", "band": "CAST(NULL AS STRING)",
    "scoring": "CASE WHEN path % 13 = 4 THEN '' ELSE 'supplied-points' END", "claimed_score": "CASE WHEN path % 26 = 4 THEN '77' ELSE '' END", "dates": "CAST(NULL AS STRING)",
}


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir).selectExpr(*[f"{v} AS {k}" for k, v in CONTACT.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in NAMES.items()])
    made = F.struct(
        F.col("path").cast("string").alias("path"), "nth", F.concat_ws(",", "qso_date", "call").alias("original"), F.map_from_entries(F.filter(pairs, lambda p: p["value"] != "")).alias("values"),
        F.create_map().cast("map<string,string>").alias("unmapped"), F.array().cast("array<struct<code:string,field:string,severity:string>>").alias("issues"),
    )
    # Rows of one element: what a field is made of isn't copied into every expression that reads the field.
    return rows.select(F.inline_outer(F.array(made)))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = synth.qso(spark, sf_dir).selectExpr(f"{FILE} AS path").distinct()
    return files.selectExpr("CAST(path AS STRING) AS path", *[f"{v} AS {k}" for k, v in HEAD.items()])


def export_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exports.gated(contacts(spark, sf_dir), "edi", metadata(spark, sf_dir))
    return found.select(F.col("path").cast("long").alias("file"), F.coalesce("nth", F.lit(-1)).cast("long").alias("nth"), "code", "field")


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of EDI files that pass all gates."""
    lines = exports.export(contacts(spark, sf_dir), "edi", metadata(spark, sf_dir))
    return lines.select(F.col("path").cast("long").alias("file"), F.col("nth").cast("long").alias("nth"), "line")


def _losses(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    rows, heads = contacts(spark, sf_dir), metadata(spark, sf_dir)
    names = list(NAMES) if format == "csv" else None
    found = exports.losses(rows, exports.export(rows, format, heads, names), format, heads, names)
    return found.select(F.col("path").cast("long").alias("file"), F.col("nth").cast("long").alias("nth"), "field", "kind", "source", "written")


def export_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir, "edi")


def export_loss_cabrillo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir, "cabrillo")


def export_loss_adif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is lost in ADIF: the number of records written and of fields that differ."""
    rows, heads = contacts(spark, sf_dir), metadata(spark, sf_dir)
    lines = exports.export(rows, "adif", heads)
    return lines.agg(F.count(F.lit(1)).alias("records")).crossJoin(exports.losses(rows, lines, "adif", heads).agg(F.count(F.lit(1)).alias("differing")))


def export_loss_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir, "csv")


_SQL = f"""WITH c AS (SELECT {synth.select(CONTACT)} FROM {synth.QSO_SQL}), h AS (SELECT *, CASE WHEN scoring = '' THEN claimed_score ELSE 'sum' END AS told
  FROM (SELECT path, {synth.select(HEAD)} FROM (SELECT DISTINCT path FROM c))),
  f AS (SELECT path, min(nullif(qso_date, '')) AS d0, max(nullif(qso_date, '')) AS d1, count(DISTINCT station) AS stations, bool_and(points <> '') AS pointed FROM c GROUP BY path),
  g AS (SELECT c.path, nth, code, field FROM c, (VALUES ('IMPORT-REQUIRED', 'QSO_DATE'), ('IMPORT-POINTS', 'QSO_POINTS'), ('IMPORT-EDI-MODE', 'MODE'), ('IMPORT-EDI-SERIAL', 'SRX'),
      ('IMPORT-EDI-EXCHANGE', 'SRX_STRING'), ('IMPORT-EDI-GRID', 'GRIDSQUARE')) AS t(code, field)
    WHERE CASE field WHEN 'QSO_DATE' THEN qso_date = '' WHEN 'QSO_POINTS' THEN points = '' WHEN 'MODE' THEN mode = 'FT8' WHEN 'SRX' THEN length(srx) > 4 WHEN 'SRX_STRING' THEN length(srx_string) > 6 ELSE length(grid) = 2 END
    UNION ALL SELECT h.path, -1, code, field FROM h JOIN f USING (path), (VALUES ('IMPORT-UTC', 'TIME_ON'), ('IMPORT-CONTEST', 'CONTEST'), ('IMPORT-SCORING', ''), ('IMPORT-SCORE', ''), ('IMPORT-MIXED-METADATA', 'STATION_CALLSIGN'),
      ('IMPORT-STATION', 'STATION_CALLSIGN')) AS t(code, field)
    WHERE CASE code WHEN 'IMPORT-UTC' THEN NOT utc_confirmed WHEN 'IMPORT-CONTEST' THEN contest = '' WHEN 'IMPORT-SCORING' THEN scoring = '' AND claimed_score = ''
      WHEN 'IMPORT-SCORE' THEN NOT (told = 'sum' AND pointed) AND claimed_score = '' ELSE stations > 1 END),
  m(mode, code, cab) AS (VALUES ('SSB', '1', 'PH'), ('CW', '2', 'CW'), ('AM', '5', 'PH'), ('FM', '6', 'FM'), ('RTTY', '7', 'RY')), w AS (SELECT c.*, m.code FROM c JOIN m USING (mode) WHERE c.path NOT IN (SELECT path FROM g))
"""
GATING_SQL = _SQL + "SELECT path AS file, nth::BIGINT AS nth, code, field FROM g"
RECORDS_SQL = _SQL + """SELECT path AS file, nth::BIGINT AS nth, concat_ws(';', substr(qso_date, 3), substr(time_on, 1, 4), call, code, rst, CASE WHEN length(stx) < 3 THEN lpad(stx, 3, '0') ELSE stx END, rst,
  CASE WHEN length(srx) IN (1, 2) THEN lpad(srx, 3, '0') ELSE srx END, srx_string, grid, points, '', '', '', '') AS line FROM w"""
LOSS_SQL = _SQL + """SELECT path AS file, nth::BIGINT AS nth, field, kind, source, written FROM (
  SELECT path, nth, 'TIME_ON' AS field, 'changed' AS kind, time_on AS source, substr(time_on, 1, 4) AS written FROM w WHERE length(time_on) > 4
  UNION ALL SELECT path, nth, 'FREQ', 'lost', freq, '' FROM w WHERE freq <> '' UNION ALL SELECT path, nth, 'SUBMODE', 'lost', submode, '' FROM w WHERE submode <> ''
  UNION ALL SELECT path, nth, 'COMMENT', 'lost', comment, '' FROM w UNION ALL SELECT path, nth, 'STX', 'changed', stx, lpad(stx, 3, '0') FROM w WHERE length(stx) < 3
  UNION ALL SELECT path, nth, 'SRX', 'changed', srx, lpad(srx, 3, '0') FROM w WHERE length(srx) IN (1, 2))"""
# Cabrillo has no gate for points, serials, grids or exchanges that only EDI bounds.
_CAB = _SQL + """, z AS (SELECT c.* FROM c WHERE path NOT IN (SELECT path FROM g WHERE code IN ('IMPORT-UTC', 'IMPORT-CONTEST', 'IMPORT-MIXED-METADATA', 'IMPORT-STATION', 'IMPORT-REQUIRED'))
    AND path NOT IN (SELECT path FROM c WHERE length(call) > 13))
"""
CABRILLO_SQL = _CAB + """SELECT path AS file, nth::BIGINT AS nth, field, kind, source, written FROM (
  SELECT path, nth, 'TIME_ON' AS field, 'changed' AS kind, time_on AS source, substr(time_on, 1, 4) AS written FROM z WHERE length(time_on) > 4
  UNION ALL SELECT path, nth, 'FREQ', 'changed', freq, '144' FROM z WHERE freq <> '' UNION ALL SELECT path, nth, 'FREQ', 'added', '', '144' FROM z WHERE freq = ''
  UNION ALL SELECT path, nth, 'SUBMODE', 'lost', submode, '' FROM z WHERE submode <> '' UNION ALL SELECT path, nth, 'MODE', 'changed', mode, 'DG' FROM z WHERE mode = 'FT8'
  UNION ALL SELECT path, nth, 'COMMENT', 'lost', comment, '' FROM z UNION ALL SELECT path, nth, 'GRIDSQUARE', 'lost', grid, '' FROM z WHERE grid <> '' UNION ALL SELECT path, nth, 'QSO_POINTS', 'lost', points, '' FROM z WHERE points <> ''
  UNION ALL SELECT path, nth, 'SRX', 'lost', srx, '' FROM z WHERE srx <> '' AND srx_string <> '')"""
ADIF_SQL = _SQL + "SELECT count(*) AS records, 0::BIGINT AS differing FROM c WHERE path NOT IN (SELECT path FROM g WHERE code IN ('IMPORT-UTC', 'IMPORT-REQUIRED'))"
CSV_SQL = _SQL + "SELECT path AS file, nth::BIGINT AS nth, 'COMMENT' AS field, 'changed' AS kind, comment AS source, '''' || comment AS written FROM c WHERE comment LIKE '=%'"

QUERIES = {
    "export_gating": export_gating, "export_records": export_records, "export_loss": export_loss, "export_loss_cabrillo": export_loss_cabrillo, "export_loss_adif": export_loss_adif,
    "export_loss_csv": export_loss_csv,
}
ORACLES = {
    "export_gating": GATING_SQL, "export_records": RECORDS_SQL, "export_loss": LOSS_SQL, "export_loss_cabrillo": CABRILLO_SQL, "export_loss_adif": ADIF_SQL, "export_loss_csv": CSV_SQL,
}
