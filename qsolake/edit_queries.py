"""The registered queries of edits: files of 50 contacts made from the contact view, edits at known places, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsolake import rule_queries
from qsolake.operators import adif_edits, cabrillo_lines, contacts, qtcs
from qsolake.plans import contest_view, synth
from qsolake.sources import writers

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


FILE = "CAST(floor(line_no / 50) AS BIGINT)"
# --- ADIF --------------------------------------------------------------------------------------------------------

_TAG = "CAST(length({0}) AS STRING) || '>' || {0}"
#: A record by parts, with lower-case names, a note between tags, a type and a name outside the basic plane.
CALL_TAG, NAME_TAG = "'<call:' || " + _TAG.format("call"), "'<Name:4:S>J😀o'"
BEFORE, BETWEEN, AFTER = "CASE WHEN line_no % 3 = 0 THEN 'a note ' ELSE '' END", "chr(13) || chr(10) || '<MODE:2>CW '", "' <comment:7>a<b:9>c ' || CASE WHEN line_no % 4 = 0 THEN '<call:1>X' ELSE '' END"
RECORD = f"{BEFORE} || {CALL_TAG} || {BETWEEN} || {NAME_TAG} || {AFTER}"
EOR = "CASE WHEN line_no % 2 = 0 THEN '<eor>' ELSE '< EOR >' END"
HEAD, TAIL = "'made by hand <ADIF_VER:5>3.1.4 <Eoh>' || chr(10)", "' after the last record'"
NEW_CALL, NEW_NAME = "'Q' || CAST(line_no AS STRING)", "'Zoë 😀'"
EDITED = f"""CASE WHEN {FILE} % 4 = 1 THEN {RECORD} ELSE
  {BEFORE} || CASE WHEN line_no % 5 = 0 THEN '<CALL:' || {_TAG.format(f'({NEW_CALL})')} ELSE {CALL_TAG} END || {BETWEEN}
  || CASE WHEN line_no % 7 = 0 THEN '<NAME:6:S>' || {NEW_NAME} ELSE {NAME_TAG} END || ' <comment:7>a<b:9>c '
  || CASE WHEN line_no % 20 = 0 THEN '<CALL:' || {_TAG.format(f'({NEW_CALL})')} WHEN line_no % 4 = 0 THEN '<call:1>X' ELSE '' END
  || CASE WHEN line_no % 11 = 0 THEN '<QTH:5>Essen <STATE:0> ' ELSE '' END END"""


def adif_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir).selectExpr(f"{FILE} AS file", "line_no", f"{RECORD} || {EOR} AS line")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    return rows.groupBy("file").agg(body.alias("body")).select("file", F.concat(F.expr(HEAD), "body", F.expr(TAIL)).alias("text"))


def adif_edit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of three files of four, some of them replaced by later ones, and some that can't be made."""
    rows = synth.qso(spark, sf_dir).selectExpr("*", f"{FILE} AS file").where("file % 4 <> 1").selectExpr("*", "row_number() OVER (PARTITION BY file ORDER BY line_no) AS record")
    made = [
        ("line_no % 5 = 0", "'call'", "'FIRST'", 1), ("line_no % 5 = 0", "' CALL '", NEW_CALL, 2), ("line_no % 7 = 0", "'name'", NEW_NAME, 3), ("line_no % 11 = 0", "'qth'", "'Essen'", 4),
        ("line_no % 11 = 0", "'state'", "CAST(NULL AS STRING)", 5), ("line_no % 13 = 0", "'EOR'", "'x'", 6), ("line_no % 13 = 1", "'QTH'", "'x < eor > y'", 7),
    ]
    out = [rows.where(when).selectExpr("file", "record", f"{name} AS name", f"{value} AS value", f"{nth} AS nth") for when, name, value, nth in made]
    out.append(rows.where("line_no % 17 = 0").selectExpr("file", "record + 1000 AS record", "'QTH' AS name", "'x' AS value", "8 AS nth"))
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_


_FILES = f"WITH q AS (SELECT *, {FILE} AS file, row_number() OVER (PARTITION BY {FILE} ORDER BY line_no) AS record FROM {synth.QSO_SQL})"


@query("adif_patch", f"{_FILES} SELECT file, {HEAD} || string_agg({EDITED} || {EOR}, '' ORDER BY line_no) || {TAIL} AS text FROM q GROUP BY file")
def adif_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adif_edits.patch_adif(adif_files(spark, sf_dir), adif_edit_rows(spark, sf_dir))


@query("adif_edits_refused", f"""{_FILES} SELECT file, record + CASE WHEN nth = 8 THEN 1000 ELSE 0 END AS record, nth::BIGINT AS nth, reason FROM q,
  (VALUES (6, 'name'), (7, 'marker'), (8, 'record')) AS v(nth, reason) WHERE file % 4 <> 1 AND CASE nth WHEN 6 THEN line_no % 13 = 0 WHEN 7 THEN line_no % 13 = 1 ELSE line_no % 17 = 0 END""")
def adif_edits_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adif_edits.refused_edits(adif_files(spark, sf_dir), adif_edit_rows(spark, sf_dir))
    return found.select("file", F.col("record").cast("long").alias("record"), F.col("nth").cast("long").alias("nth"), "reason")


@query("adif_roundtrip", f"{_FILES} SELECT file, count(*) AS records, TRUE AS same, 'ADIF_VER=3.1.4' AS header, {TAIL} AS tail FROM q GROUP BY file")
def adif_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file cut into its parts, put together again and held against what was read."""
    cut = adif_files(spark, sf_dir).withColumn("p", adif_edits.adif_parts(F.col("text")))
    again = F.concat("p.header", F.array_join(F.transform("p.records", lambda r: F.concat(r["body"], r["end"])), ""), "p.tail")
    heads = adif_edits.adif_documents(adif_files(spark, sf_dir)).select("file", F.array_join(F.transform("header_tags", lambda t: F.concat(t["name"], F.lit("="), t["value"])), ",").alias("header"))
    return cut.select("file", F.size("p.records").cast("long").alias("records"), (again == F.col("text")).alias("same"), F.col("p.tail").alias("tail")).join(heads, "file")


# --- contact lines of many contests, and their repairs -------------------------------------------------------------

CONTEST = f"CASE {FILE} % 4 WHEN 0 THEN 'ANY' WHEN 1 THEN 'SPRING-CW' WHEN 2 THEN 'DARC-WAEDC-SSB' ELSE 'VHF' END"
LINE = {
    "file": FILE, "n": "line_no", "k": f"{FILE} % 4", "f": "CASE WHEN line_no % 4 = 0 THEN '7.05' ELSE '14050' END",
    "m": f"CASE WHEN {FILE} % 4 = 2 THEN 'PH' WHEN line_no % 3 = 0 THEN 'CW' WHEN line_no % 3 = 1 THEN 'ssb' ELSE 'PH' END",
    "d": "CASE WHEN line_no % 5 = 0 THEN qso_date ELSE concat_ws('-', substr(qso_date, 1, 4), substr(qso_date, 5, 2), substr(qso_date, 7, 2)) END",
    "t": "CASE WHEN line_no % 7 = 0 THEN substr(time_on, 1, 2) || ':' || substr(time_on, 3, 2) ELSE time_on END", "own": "my_call", "sent": "sent", "call": "call",
    "rcvd": "CASE WHEN rcvd = '' THEN '000' ELSE rcvd END", "grid": "CASE WHEN grid = '' THEN '' ELSE substr(grid, 1, 4) END",
}
_BLANKS = "CASE WHEN n % 6 = 0 THEN '  ' ELSE '' END"
_TOKENS = "f || ' ' || m || ' ' || d || ' ' || t || ' ' || own || ' 599 ' || sent || ' ' || call || ' 59 ' || rcvd"


def fixed(f: str, m: str, d: str, t: str, width: int, rest: str = "") -> str:
    left = f"'QSO: ' || rpad({f}, 5, ' ') || ' ' || rpad({m}, 2, ' ') || ' ' || rpad({d}, 10, ' ') || ' ' || rpad({t}, 4, ' ') || ' ' || rpad(own, 13, ' ') || ' 599 '"
    return f"rtrim({left} || rpad(sent, {width}, ' ') || ' ' || rpad(call, 13, ' ') || ' 59  ' || rpad(rcvd, {width}, ' '){rest})"


#: Without a layout by blanks or tabs, with one by blanks after a leading one, compact, or at its columns.
VHF = fixed("f", "substr(m, 1, 2)", "d", "substr(t, 1, 4)", 4, " || ' ' || rpad(grid, 6, ' ')")
WRITTEN = f"CASE k WHEN 0 THEN 'QSO:' || CASE WHEN n % 11 = 0 THEN chr(9) ELSE ' ' END || {_TOKENS} WHEN 1 THEN ' QSO: ' || {_TOKENS} WHEN 2 THEN 'QSO: ' || {_TOKENS} ELSE {VHF} END || {_BLANKS}"
MIDDLE = [("MY_CALL", 13), ("RST_SENT", 3), ("STX", 4), ("CALL", 13), ("RST_RCVD", 3), ("SRX", 4)]
LAYOUTS = [("SPRING", 76, [4, 10, 13, 24, 29], MIDDLE), ("VHF", 80, [4, 10, 13, 24, 29], [*MIDDLE, ("GRIDSQUARE", 6)])]


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir).selectExpr("*", f"{CONTEST} AS contest").selectExpr("contest", *[f"{v} AS {k}" for k, v in LINE.items()]).selectExpr("file", "contest", "n", f"{WRITTEN} AS line")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\r\n")
    made = rows.groupBy("file", "contest").agg(body.alias("body"))
    return made.select("file", F.concat(F.lit("START-OF-LOG: 3.0\r\nContest: "), F.lower("contest"), F.lit(" \r\n"), "body", F.lit("\r\nEND-OF-LOG:")).alias("text"))


def layouts(spark: SparkSession) -> DataFrame:
    return cabrillo_lines.layout_table(spark, spark.createDataFrame(LAYOUTS, cabrillo_lines.LAYOUT))


_LINES = f"""WITH l AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY n) + 2)::BIGINT AS line_no FROM (SELECT {synth.select(LINE)} FROM {synth.QSO_SQL})),
  w AS (SELECT *, {WRITTEN} AS before, {VHF} AS vhf FROM l)"""


@query("parse_layouts", f"""{_LINES} SELECT file, line_no, CASE k WHEN 0 THEN '-' WHEN 1 THEN 'SPRING' WHEN 2 THEN 'DARC-WAEDC-SSB' ELSE 'VHF' END AS layout, f AS frequency,
  CASE WHEN k = 3 THEN substr(m, 1, 2) ELSE m END AS mode, d AS date, CASE WHEN k = 3 THEN substr(t, 1, 4) ELSE t END AS time, own AS my_call, call, sent AS sent_exchange,
  rcvd || CASE WHEN k = 3 AND grid <> '' THEN ' ' || grid ELSE '' END AS received_exchange FROM w""")
def parse_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cabrillo_lines.contest_contacts(line_files(spark, sf_dir), layouts(spark)).withColumn("layout", F.coalesce("layout", F.lit("-")))
    return found.select("file", F.col("line_no").cast("long").alias("line_no"), "layout", "frequency", "mode", "date", "time", "my_call", "call", "sent_exchange", "received_exchange")


# A mode of two letters or an hour cut off at its column stays as it is.
_NEW = {
    "f": "CASE WHEN n % 4 = 0 THEN '7050' ELSE f END", "m": "CASE WHEN m = 'ssb' THEN CASE WHEN k = 3 THEN 'ss' ELSE 'PH' END ELSE m END",
    "d": "CASE WHEN n % 5 = 0 THEN concat_ws('-', substr(d, 1, 4), substr(d, 5, 2), substr(d, 7, 2)) ELSE d END", "t": "CASE WHEN n % 7 = 0 THEN CASE WHEN k = 3 THEN substr(t, 1, 4) ELSE replace(t, ':', '') END ELSE t END",
}
_AFTER = f"""{_LINES}, x AS (SELECT *, rtrim(replace(before, chr(9), '    ')) AS plain, list_filter([CASE WHEN k = 0 AND n % 11 = 0 THEN 'Expand tabs to fixed-width spaces' END, CASE WHEN n % 5 = 0 THEN 'Normalize date to YYYY-MM-DD' END,
    CASE WHEN n % 7 = 0 AND k <> 3 THEN 'Normalize time to HHMM' END, CASE WHEN m = 'ssb' AND k <> 3 THEN 'Map mode SSB to PH' END, CASE WHEN n % 4 = 0 THEN 'Normalize frequency to kHz' END], lambda r: r IS NOT NULL) AS found FROM w),
  y AS (SELECT *, CASE WHEN k = 2 OR k = 0 AND len(found) = 0 THEN plain WHEN k = 0 THEN {fixed(*_NEW.values(), 6)}
    WHEN k = 1 THEN {fixed(*_NEW.values(), 4)} ELSE {fixed(*_NEW.values(), 4, " || ' ' || rpad(grid, 6, ' ')")} END AS after FROM x),
  z AS (SELECT *, list_concat(found, CASE WHEN k IN (1, 3) AND after <> plain THEN ['Realign to ' || CASE k WHEN 1 THEN 'SPRING' ELSE 'VHF' END || ' columns'] ELSE [] END) AS reasons FROM y WHERE after <> before),
  heads AS (SELECT DISTINCT file, 2::BIGINT AS line_no, 'Contest: ' || lower({CONTEST.replace(FILE, 'file')}) AS after FROM l),
  changes AS (SELECT file, line_no, before, after, CASE WHEN len(reasons) = 0 THEN 'Remove trailing whitespace' ELSE array_to_string(reasons, '; ') END AS reasons FROM z
    UNION ALL SELECT file, line_no, after || ' ', after, 'Remove trailing whitespace' FROM heads)"""


@query("repair_preview", f"{_AFTER} SELECT * FROM changes")
def repair_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cabrillo_lines.repairs(line_files(spark, sf_dir), layouts(spark))
    return found.select("file", F.col("line_no").cast("long").alias("line_no"), "before", "after", F.array_join("reasons", "; ").alias("reasons"))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repairs, some of them of a line that has changed since, some with a second one, and some of no line."""
    found = cabrillo_lines.repairs(line_files(spark, sf_dir), layouts(spark)).select("file", "line_no", "before", "after")
    stale = found.withColumn("before", F.when((F.col("line_no") + F.col("file")) % 13 == 0, F.concat("before", F.lit("!"))).otherwise(F.col("before")))
    second = stale.where((F.col("line_no") + F.col("file")) % 17 == 0).withColumn("after", F.lit("QSO: other"))
    return stale.unionByName(second).unionByName(found.where("line_no = 2").withColumn("line_no", F.col("line_no") + 100_000))


_STATE = "CASE WHEN (line_no + file) % 17 = 0 THEN 'overlap' WHEN (line_no + file) % 13 = 0 THEN 'stale' ELSE 'applied' END"


@query("repair_states", f"{_AFTER} SELECT file, line_no, {_STATE} AS state FROM changes UNION ALL SELECT file, line_no + 100000, 'missing' FROM heads")
def repair_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cabrillo_lines.repair_states(line_files(spark, sf_dir), _planted(spark, sf_dir))
    return found.select("file", F.col("line_no").cast("long").alias("line_no"), "state")


@query("repair_apply", f"""{_AFTER}, kept AS (SELECT * FROM changes WHERE {_STATE} = 'applied'), parts AS (
    SELECT w.file, w.line_no, coalesce(kept.after, w.before) AS line FROM w LEFT JOIN kept ON w.file = kept.file AND w.line_no = kept.line_no
    UNION ALL SELECT h.file, 2, coalesce(kept.after, h.after || ' ') FROM heads h LEFT JOIN kept ON h.file = kept.file AND kept.line_no = 2)
  SELECT file, 'START-OF-LOG: 3.0' || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY line_no) || chr(13) || chr(10) || 'END-OF-LOG:' AS text FROM parts GROUP BY file""")
def repair_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cabrillo_lines.apply_repairs(line_files(spark, sf_dir), _planted(spark, sf_dir))


# --- QTCs --------------------------------------------------------------------------------------------------------

QTC_CONTEST = f"CASE {FILE} % 4 WHEN 0 THEN 'DARC-WAEDC-CW' WHEN 1 THEN 'DARC-WAEDC-SSB' WHEN 2 THEN 'DARC-WAEDC-RTTY' ELSE 'ANY' END"
OWN_MODE = f"CASE {FILE} % 4 WHEN 0 THEN 'CW' WHEN 1 THEN 'PH' ELSE 'RY' END"
PART = "CAST(floor(line_no % 50 / 10) + 1 AS BIGINT)"
RECEIVER = f"CASE WHEN {FILE} % 5 = 0 THEN 'DL1AA' WHEN line_no % 7 = 0 THEN 'JA1XX' ELSE 'DL' || CAST({PART} AS STRING) || 'AA' END"
QTC = {
    "file": FILE, "n": "line_no", "k": f"{FILE} % 4", "f": "CASE WHEN line_no % 53 = 0 THEN '10120' WHEN line_no % 2 = 0 THEN '14050' ELSE '14060' END",
    "m": f"CASE WHEN line_no % 47 = 0 THEN 'FM' ELSE {OWN_MODE} END", "d": "CASE WHEN line_no % 43 = 0 THEN '2026-13-40' ELSE '2026-08-09' END", "t": "CASE WHEN line_no % 41 = 0 THEN '2460' ELSE time_on END",
    "rx": RECEIVER, "g": f"CASE WHEN line_no % 19 = 0 THEN 'x' WHEN line_no % 23 = 0 THEN '0/10' ELSE CAST({PART} AS STRING) || '/10' END", "tx": "CASE WHEN line_no % 11 = 0 THEN 'DL9ZZ' ELSE 'PY2AB' END",
    "qt": "CASE WHEN line_no % 13 = 0 THEN '1200' WHEN line_no % 37 = 0 THEN '99' ELSE time_on END",
    "qc": f"CASE WHEN line_no % 13 = 0 THEN 'k1abc' WHEN line_no % 17 = 0 THEN {RECEIVER} WHEN line_no % 31 = 0 THEN 'NOCALL' ELSE 'W1' || chr(CAST(65 + line_no % 26 AS INT)) || 'Z' END",
    "qs": "CASE WHEN line_no % 13 = 0 THEN '77' WHEN line_no % 29 = 0 THEN 'X1' ELSE CAST(line_no % 1000 AS STRING) END",
}
SHAPED = """rtrim('QTC: ' || rpad(f, 5, ' ') || ' ' || rpad(m, 2, ' ') || ' ' || d || ' ' || t || ' ' || rpad(rx, 13, ' ') || ' ' || rpad(g, 6, ' ') || '     ' || rpad(tx, 13, ' ') || ' '
  || rpad(qt, 4, ' ') || ' ' || rpad(qc, 13, ' ') || ' ' || rpad(qs, 4, ' '))"""
BLANKS = "concat_ws(' ', 'qtc:', f, m, d, t, rx, g, tx, qt, qc, qs)"
CONTACT_LINE = """'QSO: ' || f || ' ' || CASE WHEN n % 8 = 0 THEN 'CW' ELSE m END || ' 2026-08-09 1200 K1ABC 599 ' || CASE WHEN n % 12 = 0 THEN 'AB' ELSE '001' END || ' DL1AA 599 ' || CASE WHEN n % 20 = 0 THEN 'QTC' ELSE '7' END"""


def qtc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of 50 QTCs, one in two at its columns, with a contact before every fourth."""
    rows = synth.qso(spark, sf_dir).selectExpr(f"{QTC_CONTEST} AS contest", *[f"{v} AS {k}" for k, v in QTC.items()])
    lines = rows.selectExpr("file", "contest", "n", f"CASE WHEN n % 4 = 0 THEN {CONTACT_LINE} || chr(10) ELSE '' END || CASE WHEN n % 2 = 0 THEN {SHAPED} ELSE {BLANKS} END AS line")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("file", "contest").agg(body.alias("body")).select("file", F.concat(F.lit("CONTEST: "), "contest", F.lit("\n"), "body").alias("text"))


_QTCS = f"""WITH a AS (SELECT {synth.select(QTC)} FROM {synth.QSO_SQL}), b AS (SELECT *, sum(CASE WHEN n % 4 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY file ORDER BY n) + 1 AS line_no FROM a),
  v AS (SELECT *, CASE k WHEN 0 THEN 'CW' WHEN 1 THEN 'PH' ELSE 'RY' END AS own, CASE WHEN g <> 'x' THEN split_part(g, '/', 1) END AS series FROM b)"""


@query("parse_qtcs", f"""{_QTCS} SELECT file, line_no::BIGINT AS line_no, f AS frequency, m AS mode, d AS date, t AS time, rx AS receiver, g AS series, tx AS sender, qt AS qso_time, qc AS qso_call, qs AS qso_serial FROM v""")
def parse_qtcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qtcs.qtc_lines(qtc_files(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


@query("check_qtc", f"""{_QTCS}, w AS (SELECT * FROM v WHERE k <> 3) SELECT file, line_no::BIGINT AS line_no, code, field FROM (
  SELECT file, line_no - 1 AS line_no, 'WAEDC-QSO-MODE' AS code, 'MODE' AS field FROM w WHERE n % 4 = 0 AND CASE WHEN n % 8 = 0 THEN 'CW' ELSE m END <> own
  UNION ALL SELECT file, line_no - 1, 'WAEDC-STX', 'STX_STRING' FROM w WHERE n % 12 = 0 UNION ALL SELECT file, line_no - 1, 'WAEDC-SRX', 'SRX_STRING' FROM w WHERE n % 20 = 0
  UNION ALL SELECT file, line_no, 'QTC-FREQUENCY', 'FREQUENCY' FROM w WHERE f = '10120' UNION ALL SELECT file, line_no, 'QTC-MODE', 'MODE' FROM w WHERE m = 'FM'
  UNION ALL SELECT file, line_no, 'QTC-DATE', 'QSO_DATE' FROM w WHERE d <> '2026-08-09' UNION ALL SELECT file, line_no, 'QTC-TIME', 'TIME_ON' FROM w WHERE t = '2460'
  UNION ALL SELECT file, line_no, 'QTC-QSO-TIME', 'TIME_QSO' FROM w WHERE qt = '99' UNION ALL SELECT file, line_no, 'QTC-CALL', 'CALL_QSO' FROM w WHERE qc = 'NOCALL'
  UNION ALL SELECT file, line_no, 'QTC-SERIAL', 'NR_QSO' FROM w WHERE qs = 'X1' UNION ALL SELECT file, line_no, 'QTC-GROUP', 'QTC_GROUP' FROM w WHERE g IN ('x', '0/10')
  UNION ALL SELECT file, line_no, 'QTC-RETURN', 'CALL_QSO' FROM w WHERE qc = rx
  UNION ALL SELECT file, line_no, 'QTC-REPORTED-TWICE', 'CALL_QSO' FROM (SELECT *, row_number() OVER (PARTITION BY file, qt, upper(qc), qs ORDER BY line_no) AS nth FROM w) WHERE nth > 1
  UNION ALL SELECT file, line_no, 'QTC-CONTINENT', 'CALL_RX' FROM w WHERE own = 'RY' AND rx <> 'JA1XX' AND tx = 'DL9ZZ'
  UNION ALL SELECT file, line_no, 'QTC-RECEIVER-EU', 'CALL_RX' FROM w WHERE own <> 'RY' AND rx = 'JA1XX' UNION ALL SELECT file, line_no, 'QTC-SENDER-DX', 'CALL_TX' FROM w WHERE own <> 'RY' AND tx = 'DL9ZZ'
  UNION ALL SELECT file, min(line_no), 'QTC-SERIES-SIZE', 'QTC_GROUP' FROM w WHERE series IS NOT NULL GROUP BY file, tx, series HAVING count(*) <> 10
  UNION ALL SELECT file, min(line_no), 'QTC-SERIES-METADATA', 'QTC_GROUP' FROM w WHERE series IS NOT NULL GROUP BY file, tx, series HAVING count(DISTINCT CASE WHEN f = '10120' THEN '30M' ELSE '20M' END || m || rx) > 1
  UNION ALL SELECT file, 0, 'QTC-PAIR-LIMIT', '' FROM w GROUP BY file, tx, rx HAVING count(*) > 10)""")
def check_qtc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qtcs.check_qtcs(qtc_files(spark, sf_dir), synth.countries(spark))
    return found.select("file", F.col("line_no").cast("long").alias("line_no"), "code", "field")


@query("rule_wae_dx_with_qtcs", f"""WITH t AS ({rule_queries.RULE_SQL["wae-dx"]}), s AS (SELECT doc_id, count(*) AS sent FROM {contest_view.CONTACTS_SQL} WHERE line_no % 5 = 0 GROUP BY doc_id)
  SELECT doc_id, qsos, duplicates, points, multipliers, ((points + coalesce(sent, 0)) * multipliers)::BIGINT AS total FROM t LEFT JOIN s USING (doc_id)""")
def rule_wae_dx_with_qtcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each station of the contest view, with a QTC for every fifth contact, read for the number of its QTCs."""
    rows = contest_view.contacts(spark, sf_dir).where("line_no % 5 = 0").selectExpr("doc_id", "concat_ws(' ', 'QTC: 14050 CW 2026-08-09 1200 DL1AA 1/10', my_call, time_on, call, line_no) AS line")
    texts = rows.groupBy("doc_id").agg(F.concat(F.lit("CONTEST: DARC-WAEDC-CW\n"), F.array_join(F.collect_list("line"), "\n")).alias("text"))
    return rule_queries.rule_totals(spark, sf_dir, "wae-dx", qtcs.qtc_counts(texts))


# --- duplicates of records ---------------------------------------------------------------------------------------

#: Every fourth event again as a record of its own, with a change by its number: none, the call's letters, the time, another
#: band, mode, submode, station or activity. Calls grow with the events, so pairs do as the records.
RECORD_FIELDS = {
    "BAND": "CASE WHEN v = 4 THEN '40m' WHEN n % 2 = 0 THEN '' ELSE '20M' END",
    "CALL": "CASE WHEN v = 1 THEN 'q' ELSE 'Q' END || CAST(floor(n / 20) AS BIGINT) || 'AB'",
    "COMMENT": "CASE WHEN v = 9 THEN 'again' ELSE '' END", "FREQ": "CASE WHEN n % 2 = 0 THEN '14.05' ELSE '' END", "MODE": "CASE WHEN v = 5 THEN 'DATA' ELSE 'MFSK' END",
    "MY_STATE": "CASE WHEN v = 7 THEN 'TX' ELSE '' END", "QSO_DATE": "qso_date", "SIG_INFO": "CASE WHEN v = 8 THEN 'P-1' ELSE '' END", "SUBMODE": "CASE WHEN v = 6 THEN 'FT4' WHEN n % 3 = 0 THEN '' ELSE 'JS8' END",
    "TIME_ON": "CASE v WHEN 2 THEN substr(time_on, 1, 2) || lpad(CAST((CAST(substr(time_on, 3, 2) AS INT) + n % 9) % 60 AS STRING), 2, '0') WHEN 3 THEN 'noon' ELSE time_on || '15' END",
}
_ORIGINAL = ("line_no * 2 AS id", "line_no AS n", "qso_date", "time_on", "0 AS v")
_COPY = ("line_no * 2 + 1 AS id", "line_no AS n", "qso_date", "time_on", "CAST(floor(line_no / 4) % 10 AS INT) AS v")


def duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir)
    both = rows.selectExpr(*_ORIGINAL).unionByName(rows.where("line_no % 4 = 0").selectExpr(*_COPY))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(x).alias("value")) for k, x in RECORD_FIELDS.items()])
    return both.select("id", F.map_from_entries(F.filter(pairs, lambda p: p["value"] != "")).alias("fields"))


_DIFFERING = "concat_ws(';', " + ", ".join(f"CASE WHEN a.{k} <> b.{k} THEN '{k}' END" for k in RECORD_FIELDS) + ")"
_DUPLICATES = f"""WITH r AS (SELECT id, v, {synth.select(RECORD_FIELDS)} FROM (SELECT {', '.join(_ORIGINAL)} FROM {synth.QSO_SQL} UNION ALL SELECT {', '.join(_COPY)} FROM {synth.QSO_SQL} WHERE line_no % 4 = 0)),
  m AS (SELECT *, CASE WHEN v <> 3 THEN CAST(substr(TIME_ON, 1, 2) AS INT) * 60 + CAST(substr(TIME_ON, 3, 2) AS INT) END AS t, CASE WHEN BAND = '' THEN '20M' ELSE upper(BAND) END AS b, CASE WHEN SUBMODE = '' THEN MODE ELSE SUBMODE END AS md FROM r),
  p AS (SELECT a.id AS first, b.id AS second, abs(a.t - b.t) AS delta, a.b = b.b AND a.md = b.md AS alike, a.MY_STATE = b.MY_STATE AS same, a.SIG_INFO <> b.SIG_INFO AS act, upper(a.CALL) AS first_call, upper(b.CALL) AS second_call, {_DIFFERING} AS differing
    FROM m a JOIN m b ON upper(a.CALL) = upper(b.CALL) AND a.QSO_DATE = b.QSO_DATE AND a.id < b.id AND abs(a.t - b.t) <= 5),
  k AS (SELECT *, CASE WHEN act THEN 'activity-aware' WHEN delta = 0 AND alike AND same THEN 'lotw' WHEN delta = 0 AND alike THEN 'exact' WHEN alike THEN 'near' ELSE 'possible' END AS kind FROM p WHERE alike OR delta = 0),
  z AS (SELECT *, CASE kind WHEN 'near' THEN 'Same call, band, and mode within ' || delta || ' minutes' WHEN 'activity-aware' THEN 'Similar QSO with different activity references; keep both unless confirmed'
    WHEN 'lotw' THEN 'Matches documented LoTW identity fields' WHEN 'exact' THEN 'Same call, date/time, band, and mode' ELSE 'Same call and time with differing band or mode' END AS reason FROM k)"""


@query("duplicate_candidates", _DUPLICATES + " SELECT first, second, kind, delta::INT AS delta, reason, differing FROM z")
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contacts.duplicate_candidates(duplicate_records(spark, sf_dir))
    return found.select("first", "second", "kind", F.col("delta").cast("int").alias("delta"), "reason", F.array_join("differing", ";").alias("differing"))


@query("duplicate_report", _DUPLICATES + """ SELECT first, second, '"' || concat_ws('","', kind, first_call, second_call, differing, reason) || '"' AS line FROM z""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.duplicate_lines(contacts.duplicate_candidates(duplicate_records(spark, sf_dir)))


@query("resolve_merge_chains", f"""SELECT min(line_no) AS id, coalesce(arg_min(grid, line_no) FILTER (grid <> '' AND line_no % 7 >= 2), '') AS grid,
  coalesce(arg_min(comment, line_no) FILTER (line_no % 7 >= 1), '') AS comment FROM {synth.QSO_SQL} GROUP BY floor(line_no / 7)""")
def resolve_merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of seven contacts, each a pair with the next alone, whose cells are empty in the first ones."""
    rows = synth.qso(spark, sf_dir).selectExpr(
        "line_no AS id", "'Q' || CAST(floor(line_no / 7) AS BIGINT) || 'AB' AS call", "'20260101' AS qso_date", "line_no % 7 * 20 AS epoch_min", "'20M' AS band", "'CW' AS mode",
        "CASE WHEN line_no % 7 < 2 THEN '' ELSE grid END AS grid", "CASE WHEN line_no % 7 < 1 THEN CAST(NULL AS STRING) ELSE comment END AS comment",
    )
    done = contacts.resolve_duplicates(rows.select("id", "grid", "comment"), contacts.duplicate_pairs(rows, 30), "merge")
    return done.select("id", "grid", F.coalesce("comment", F.lit("")).alias("comment"))
