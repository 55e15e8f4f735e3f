"""The registered queries of readers, writers, table edits, search and checks, each with the SQL that gives its rows.

Logs for the readers are written from the contact view first, so the SQL reads that view: what is parsed back must
be what was written; a Cabrillo frequency is cut to its five columns. A log is one station's day."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qsolake.operators import checks, search, table
from qsolake.plans import synth
from qsolake.sources import logs, writers

QUERIES, ORACLES = {}, {}
CTE = f"WITH q AS (SELECT * FROM {synth.QSO_SQL}) "
KEYS = ["doc_id", "qso_date"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def contact_fields() -> dict[str, Column]:
    day = F.concat_ws("-", F.substring("qso_date", 1, 4), F.substring("qso_date", 5, 2), F.substring("qso_date", 7, 2))
    return {
        "FREQUENCY": F.col("freq"), "MODE": F.upper("mode"), "QSO_DATE": day, "TIME_ON": F.col("time_on"), "MY_CALL": F.col("my_call"), "RST_SENT": F.lit("599"),
        "STX_STRING": F.col("sent"), "CALL": F.col("call"), "RST_RCVD": F.lit("59"), "SRX_STRING": F.col("rcvd"),
    }


def cabrillo_logs(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    rows = synth.qso(spark, sf_dir).where(where).withColumn("line", writers.cabrillo_line(contact_fields(), F.col("line_no") % 29 == 0))
    head = F.concat(F.lit("START-OF-LOG: 3.0\nCALLSIGN: "), F.when(F.col("doc_id") % 4 == 0, "DL1AA").otherwise("K2BB"), F.lit("\nCONTEST: GENERIC-CONTEST\n# day "), "qso_date", F.lit("\n"))
    return writers.documents(rows, KEYS, "line_no", "line", head, F.lit("\nEND-OF-LOG:\n")).withColumnRenamed("qso_date", "day")


@query("parse_cabrillo", CTE + """SELECT doc_id, qso_date, (row_number() OVER (PARTITION BY doc_id, qso_date ORDER BY line_no) + 4)::BIGINT AS line_no,
  line_no % 29 = 0 AS excluded, substr(freq, 1, 5) AS FREQUENCY, call AS CALL, upper(mode) AS MODE, my_call AS MY_CALL, sent AS STX_STRING, rcvd AS SRX_STRING FROM q""")
def parse_cabrillo(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.cabrillo_contacts(cabrillo_logs(spark, sf_dir))
    return found.select("doc_id", F.col("day").alias("qso_date"), F.col("line_no").cast("long").alias("line_no"), "excluded", "FREQUENCY", "CALL", "MODE", "MY_CALL", "STX_STRING", "SRX_STRING")


@query("cabrillo_line_kinds", CTE + """SELECT doc_id, kind, sum(n)::BIGINT AS n FROM (
  SELECT doc_id, 'qso' AS kind, count(*) AS n FROM q GROUP BY doc_id
  UNION ALL SELECT doc_id, 'header', 4 * count(DISTINCT qso_date) FROM q GROUP BY doc_id
  UNION ALL SELECT doc_id, 'comment', count(DISTINCT qso_date) FROM q GROUP BY doc_id) GROUP BY doc_id, kind""")
def cabrillo_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.cabrillo_lines(cabrillo_logs(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _documents(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    rows, end = synth.qso(spark, sf_dir), F.lit("\n")
    if form == "cabrillo":
        return cabrillo_logs(spark, sf_dir)
    if form == "edi":
        fields = {"DATE": F.substring("qso_date", 3, 6), "TIME": F.col("time_on"), "CALL": F.col("call"), "MODE_CODE": F.when(F.upper("mode") == "CW", "2").otherwise("1"),
                  "QSO_SENT": F.col("sent"), "QSO_RCVD": F.col("rcvd"), "WWL_RCVD": F.col("grid"), "QSO_POINTS": (F.col("line_no") % 100).cast("string")}
        # one declared number for all logs: wrong for most of them, on purpose
        head = F.concat(F.lit("[REG1TEST;1]\nTName=Any\nTDate="), "qso_date", F.lit(";"), "qso_date", F.lit("\nPCall=K2BB\nPBand=144 MHz\n[Remarks]\na;b\n[QSORecords;3]\n"))
        return writers.documents(rows.withColumn("line", writers.edi_line(fields)), KEYS, "line_no", "line", head, F.lit("\n[END;any]\n"))
    fields = {"CALL": F.col("call"), "QSO_DATE": F.col("qso_date"), "TIME_ON": F.col("time_on"), "MODE": F.upper("mode"), "FREQ": F.col("freq"), "SRX": F.col("rcvd"),
              "GRIDSQUARE": F.col("grid"), "COMMENT": F.concat(F.lit("<CALL:2> \U0001f600 & "), F.col("comment"))}
    if form == "adif":
        return writers.documents(rows.withColumn("line", writers.adif_record(fields)), KEYS, "line_no", "line", F.lit("any text <ADIF_VER:5>3.1.7 <EOH>\n"), end)
    head = F.lit('<?xml version="1.0"?>\n<ADX><HEADER><ADIF_VER>3.1.7</ADIF_VER></HEADER><RECORDS>')
    return writers.documents(rows.withColumn("line", writers.adx_record(fields)), KEYS, "line_no", "line", head, F.lit("</RECORDS></ADX>"), "")


RECORD_SQL = CTE + """SELECT doc_id, qso_date, row_number() OVER (PARTITION BY doc_id, qso_date ORDER BY line_no)::BIGINT AS record, call, time_on,
  rcvd AS srx, grid, '<CALL:2> \U0001f600 & ' || comment AS comment FROM q"""


def _records(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    found = (logs.adif_records if form == "adif" else logs.adx_records)(_documents(spark, sf_dir, form))
    of = lambda n: logs.tag("tags", n)
    return found.select(
        *KEYS, F.col("record").cast("long").alias("record"), of("CALL").alias("call"), of("TIME_ON").alias("time_on"), of("SRX").alias("srx"),
        of("GRIDSQUARE").alias("grid"), of("COMMENT").alias("comment"),
    )


query("parse_adif", RECORD_SQL)(partial(_records, form="adif"))
query("parse_adx", RECORD_SQL)(partial(_records, form="adx"))


@query("parse_edi", CTE + """SELECT doc_id, qso_date, (row_number() OVER (PARTITION BY doc_id, qso_date ORDER BY line_no) + 8)::BIGINT AS line_no,
  15::BIGINT AS n_fields, call AS CALL, sent AS QSO_SENT, rcvd AS QSO_RCVD, grid AS WWL_RCVD, (line_no % 100)::VARCHAR AS QSO_POINTS FROM q""")
def parse_edi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.edi_contacts(_documents(spark, sf_dir, "edi"))
    return found.select(*KEYS, F.col("line_no").cast("long").alias("line_no"), F.col("n_fields").cast("long").alias("n_fields"), "CALL", "QSO_SENT", "QSO_RCVD", "WWL_RCVD", "QSO_POINTS")


@query("format_sniff", CTE + """SELECT f AS written, f2 AS found, count(*) AS n FROM (SELECT DISTINCT doc_id, qso_date FROM q),
  (VALUES ('cabrillo', 'cabrillo'), ('edi', 'edi'), ('adif', 'adif'), ('adx', 'adif')) AS v(f, f2) GROUP BY 1, 2""")
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_documents(spark, sf_dir, f).select(F.lit(f).alias("written"), logs.detect_format(F.col("text")).alias("found")) for f in ("cabrillo", "edi", "adif", "adx")]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return every.groupBy("written", "found").agg(F.count(F.lit(1)).alias("n"))


@query("check_edi", CTE + """SELECT code, field, count(*) AS n FROM (
  SELECT 'EDI-RECORD-COUNT' AS code, '' AS field FROM q GROUP BY doc_id, qso_date HAVING count(*) <> 3
  UNION ALL SELECT 'EDI-HEADER-REQUIRED', 'PWWLO' FROM q GROUP BY doc_id, qso_date) GROUP BY code, field""")
def check_edi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_edi(_documents(spark, sf_dir, "edi")).groupBy("code", "field").agg(F.count(F.lit(1)).alias("n"))


@query("check_cabrillo", CTE + """, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, qso_date, CASE WHEN freq IN ('144300', '10.368G', '999999') THEN '' ELSE freq END, upper(mode), call ORDER BY line_no) AS n FROM q)
  SELECT code, count(*) AS n FROM (
    SELECT 'QSO-EXCHANGE' AS code FROM q WHERE rcvd = '' UNION ALL SELECT 'QSO-FREQUENCY' FROM q WHERE freq IN ('144300', '10.368G', '999999')
    UNION ALL SELECT 'QSO-DUPLICATE' FROM d WHERE n > 1) GROUP BY code""")
def check_cabrillo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_cabrillo(cabrillo_logs(spark, sf_dir)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("check_adif", CTE + """SELECT code, count(*) AS n FROM (SELECT line_no, unnest([CASE WHEN line_no % 31 = 0 THEN 'ADIF-CALL-EMPTY' WHEN line_no % 37 = 0 THEN 'ADIF-CALL' END,
  CASE WHEN line_no % 23 = 0 THEN 'ADIF-DATE' END, CASE WHEN line_no % 17 = 0 OR line_no % 5 = 0 THEN 'ADIF-TIME' END, CASE WHEN line_no % 3 = 0 AND line_no % 2 = 1 AND line_no % 9 <> 0 THEN 'ADIF-BAND' END,
  CASE WHEN line_no % 11 = 0 THEN 'ADIF-MODE' END, CASE WHEN line_no % 12 = 0 THEN 'ADIF-GRID' END]) AS code FROM q) WHERE code IS NOT NULL GROUP BY code""")
def check_adif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with defects at known places, written as ADIF and read back."""
    n = F.col("line_no")
    fields = {
        "CALL": F.when(n % 31 == 0, "").when(n % 37 == 0, "NOCALL").otherwise(F.col("call")), "QSO_DATE": F.when(n % 23 == 0, "20261340").otherwise(F.col("qso_date")),
        "TIME_ON": F.when(n % 17 == 0, "2460").when(n % 5 == 0, "").otherwise(F.col("time_on")), "BAND": F.when((n % 3 == 0) & (n % 9 != 0), "").otherwise("20M"),
        "FREQ": F.when(n % 2 == 1, "").otherwise("14.05"), "MODE": F.when(n % 11 == 0, "").otherwise("CW"), "GRIDSQUARE": F.when(n % 12 == 0, "ZZ99").otherwise("JO62"),
    }
    tags = F.concat_ws(" ", *[F.when(v != "", F.concat(F.lit(f"<{k}:"), F.length(v).cast("string"), F.lit(">"), v)) for k, v in fields.items()])
    text = F.concat(F.lit("<ADIF_VER:5>3.1.7 <EOH>"), F.array_join(F.collect_list(F.concat(tags, F.lit(" <EOR>"))), "\n"))
    written = synth.qso(spark, sf_dir).groupBy("doc_id", "qso_date", (n % 97).alias("part")).agg(text.alias("text"))
    return checks.check_adif(logs.adif_records(written), [*KEYS, "part"]).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# --- table edits ------------------------------------------------------------------------------------------------

# cells: p_name, p_brand with blanks around it, p_type, size or nothing
PARTS_SQL = "WITH t AS (SELECT p_partkey AS row_no, p_name AS a, ' ' || p_brand || '  ' AS b, p_type AS c, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_size::VARCHAR END AS d FROM part) "


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))
    cells = F.array("p_name", F.concat(F.lit(" "), "p_brand", F.lit("  ")), "p_type", size)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_no"), cells.alias("cells"))


def joined(t: DataFrame) -> DataFrame:
    return t.select("row_no", F.array_join("cells", "|").alias("row"), F.size("cells").cast("long").alias("width"))


def table_query(name: str, row_sql: str, width: int, edit) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return joined(edit(parts(spark, sf_dir)))

    query(f"table_{name}", PARTS_SQL + f"SELECT row_no, {row_sql} AS row, {width}::BIGINT AS width FROM t")(run)


def _each(sql: str) -> str:
    return " || '|' || ".join(sql.format(x) for x in "abcd")


for _name, _sql in {
    "trim": "trim({})", "trim_all": "replace({}, ' ', '')", "remove_alpha": "regexp_replace({}, '[A-Za-z]', '', 'g')", "remove_numeric": "regexp_replace({}, '[0-9]', '', 'g')",
    "remove_symbols": "regexp_replace({}, '[^A-Za-z0-9 ]', '', 'g')", "remove_left": "substr({}, 2)", "remove_right": "substr({0}, 1, greatest(length({0}) - 1, 0))", "empty": "repeat(' ', length({}))",
}.items():
    table_query(_name, _each(_sql), 4, partial(table.edit, name=_name))
table_query("replace", _each("replace({}, 'an', 'AN')"), 4, lambda t: table.replace(t, "an", "AN"))
table_query("fill", "a || '|x|' || c || '|' || d", 4, lambda t: table.fill(t, "x", columns=[1]))
table_query("insert", "a || '|new|' || b || '|' || c || '|' || d", 5, lambda t: table.insert_column(t, 0, F.lit("new")))
table_query("duplicate", "a || '|' || a || '|' || b || '|' || c || '|' || d", 5, lambda t: table.duplicate_column(t, 0))
table_query("delete", "a || '|' || c", 2, lambda t: table.delete_columns(t, [1, 3]))
table_query("keep", "b || '|' || d", 2, lambda t: table.delete_columns(t, [1, 3], keep=True))
table_query("move", "b || '|' || a || '|' || d || '|' || c", 4, lambda t: table.move_columns(t, [1, 3], 4, "left"))
table_query("split", "CASE WHEN contains(a, ' ') THEN split_part(a, ' ', 1) || '|' || substr(a, strpos(a, ' ') + 1) ELSE a || '|' END || '|' || b || '|' || c || '|' || d", 5, lambda t: table.split_column(t, 0, " "))
table_query("join", "a || c || '|' || b || '|' || d", 3, lambda t: table.join_columns(t, [0, 2]))
table_query("combine", "trim(b) || CASE WHEN d = '' THEN '' ELSE ' ' || d END", 1, lambda t: table.join_columns(table.delete_columns(t, [0, 2]), [0, 1], with_space=True))
table_query("shift_right", "'|' || a || '|' || b || '|' || c", 4, lambda t: table.shift_rows(t, "right"))
table_query("shift_left", "CASE WHEN row_no % 2 = 0 THEN b || '|' || c || '|' || d || '|' ELSE a || '|' || b || '|' || c || '|' || d END", 4, lambda t: table.shift_rows(t, "left", F.col("row_no") % 2 == 0))
table_query("shift_some", "CASE WHEN d = '' THEN '|' || a || '|' || b || '|' || c ELSE a || '|' || b || '|' || c || '|' || d END", 4, lambda t: table.shift_rows(t, "right", F.get("cells", F.lit(3)) == ""))


@query("table_align", PARTS_SQL + """, f AS (SELECT *, CASE WHEN row_no % 4 = 0 THEN 1 ELSE 0 END AS first FROM t), n AS (SELECT c, first, count(*) AS n FROM f GROUP BY c, first),
  m AS (SELECT c, first AS most FROM n QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, first) = 1)
  SELECT row_no, CASE WHEN most = 0 THEN a || '|x|' || c || '|' ELSE '|' || a || '|x|' || c END AS row FROM f JOIN m USING (c)""")
def table_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each part type; every fourth row of it begins one cell late."""
    found = spark.read.parquet(f"{sf_dir}/part.parquet")
    late = F.col("p_partkey") % 4 == 0
    cells = F.when(late, F.array(F.lit(""), "p_name", F.lit("x"), "p_type")).otherwise(F.array("p_name", F.lit("x"), "p_type", F.lit("")))
    t = found.select(F.col("p_partkey").alias("row_no"), F.col("p_type").alias("kind"), cells.alias("cells"))
    return table.align_rows(t, [0, 1, 2, 3], ["kind"]).select("row_no", F.array_join("cells", "|").alias("row"))


@query("table_serial", PARTS_SQL + "SELECT row_no, lpad(n, greatest(length(n), 3)::INT, '0') || '|' || a AS row FROM (SELECT *, (row_number() OVER (PARTITION BY c ORDER BY row_no) + 9)::VARCHAR AS n FROM t)")
def table_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).withColumn("kind", F.get("cells", F.lit(2)))
    return table.serial_column(rows, ["kind"], start=10).select("row_no", F.array_join(F.slice("cells", 1, 2), "|").alias("row"))


@query("table_changes", PARTS_SQL + """SELECT row_no, 1::BIGINT AS "column", b AS before, trim(b) AS after FROM t""")
def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = parts(spark, sf_dir)
    return table.changes(before, table.edit(before, "trim"), ["row_no"]).withColumn("column", F.col("column").cast("long"))


@query("delimiter_detect", """SELECT d AS written, d AS found, count(*) AS n FROM part, (VALUES (';'), (','), ('|')) AS v(d) GROUP BY d""")
def delimiter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.explode(F.array(F.lit(";"), F.lit(","), F.lit("|"))).alias("written"))
    text = F.concat(F.lit("a"), "written", F.lit("b"), "written", F.lit("c\n"), F.col("p_partkey").cast("string"), "written", F.lit("x"), "written", F.lit("y\n"))
    return rows.select("written", logs.detect_delimiter(text).alias("found")).groupBy("written", "found").agg(F.count(F.lit(1)).alias("n"))


# --- search -----------------------------------------------------------------------------------------------------


@query("search_count", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i)the'))::BIGINT AS n FROM documents")
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", search.count_matches(F.coalesce("text", F.lit("")), "the").cast("long").alias("n"))


@query("search_find", """WITH l AS (SELECT p_partkey, regexp_replace(p_name, '[0-9]', '#', 'g') || ' a1b22' AS line FROM part)
  SELECT p_partkey, (strpos(line, v) )::BIGINT AS "column", v AS value FROM l, (VALUES ('1'), ('22')) AS x(v)""")
def search_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.regexp_replace("p_name", "[0-9]", "#"), F.lit(" a1b22"))
    found = search.find_all(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.alias("text")), "\\d+", regex=True)
    return found.select("p_partkey", F.col("column").cast("long").alias("column"), "value")


@query("replace_all", "SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '(?i)the', '$1', 'g')) AS digest FROM documents")
def replace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.sha2(search.replace_all(F.coalesce("text", F.lit("")), "the", "$1"), 256).alias("digest"))


@query("line_endings", "SELECT doc_id, sha256(replace(coalesce(text, ''), chr(10), chr(13) || chr(10))) AS digest FROM documents")
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.sha2(search.line_endings(F.coalesce("text", F.lit("")), "\r\n"), 256).alias("digest"))
