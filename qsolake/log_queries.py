"""The registered queries of conversions, preflight, EDI scores, reference data and fast entry, each with its SQL.

Records are built from the contact view with defects at known places, so that every check finds something; the SQL
states what is to be found from the view itself."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qsolake.functions import radio
from qsolake.operators import contacts, conversions, lookup, preflight
from qsolake.plans import contest_view, synth
from qsolake.queries import CTE
from qsolake.sources import reference

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# --- conversions -------------------------------------------------------------------------------------------------

MODE_SQL = "CASE upper(mode) WHEN 'PH' THEN 'SSB' WHEN 'RY' THEN 'RTTY' WHEN 'DG' THEN 'DATA' ELSE upper(mode) END"


def cabrillo_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.concat_ws("-", F.substring("qso_date", 1, 4), F.substring("qso_date", 5, 2), F.substring("qso_date", 7, 2))
    return synth.qso(spark, sf_dir).select(
        "line_no", (F.col("line_no") % 29 == 0).alias("excluded"), F.col("freq").alias("FREQUENCY"), F.upper("mode").alias("MODE"), day.alias("QSO_DATE"),
        F.col("time_on").alias("TIME_ON"), F.col("my_call").alias("MY_CALL"), F.lit("599").alias("RST_SENT"), F.col("sent").alias("STX_STRING"),
        F.col("call").alias("CALL"), F.col("rcvd").alias("SRX_STRING"), F.lit("1").alias("TRANSMITTER"),
    )


def tag_of(name: str) -> Column:
    return F.coalesce(F.get(F.filter("tags", lambda t: t["name"] == name), F.lit(0))["value"], F.lit("")).alias(name.lower())


@query("cabrillo_to_adif", CTE + f"""SELECT line_no, call, qso_date, time_on, {MODE_SQL} AS mode, replace(band, 'OTHER', '') AS band, my_call AS station_callsign, sent AS stx_string,
  rcvd AS srx_string, 'TEST-CW' AS contest_id, 'TRANSMITTER' AS unmapped FROM q WHERE line_no % 29 <> 0""")
def cabrillo_to_adif(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = conversions.cabrillo_to_adif(cabrillo_fields(spark, sf_dir), contest="TEST-CW")
    names = ["CALL", "QSO_DATE", "TIME_ON", "MODE", "BAND", "STATION_CALLSIGN", "STX_STRING", "SRX_STRING", "CONTEST_ID"]
    return made.select("line_no", *[tag_of(n) for n in names], F.array_join("unmapped", ",").alias("unmapped"))


def adif_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the contact view: some without a frequency, with a submode, a bad date or time, or no mode."""
    n = F.col("line_no")
    band = F.when(n % 3 == 0, F.lit("20M")).otherwise("")
    fields = {
        "CALL": F.when(n % 31 == 0, "").when(n % 37 == 0, "NOCALL").otherwise(F.col("call")),
        "QSO_DATE": F.when(n % 23 == 0, "20261340").otherwise(F.col("qso_date")), "TIME_ON": F.when(n % 17 == 0, "2460").when(n % 5 == 0, "").otherwise(F.col("time_on")),
        "TIME_OFF": F.when(n % 5 == 0, "1200").otherwise(""), "BAND": band, "FREQ": F.when(n % 3 == 0, F.when(n % 2 == 0, "7.05").otherwise("")).otherwise("14.05"),
        "MODE": F.when(n % 7 == 0, "SSB").when(n % 11 == 0, "").otherwise("CW"), "SUBMODE": F.when(n % 14 == 0, "USB").otherwise(""),
        "STATION_CALLSIGN": F.when(n % 41 == 0, "").otherwise(F.col("my_call")), "OPERATOR": F.lit("K1OP"), "STX": F.lit("001"), "STX_STRING": F.col("sent"),
        "SRX": F.lit("002"), "SRX_STRING": F.col("rcvd"), "PROP_MODE": F.when(n % 19 == 0, "SAT").otherwise(""), "SAT_NAME": F.when(n % 13 == 0, "AO-7").otherwise(""),
        "MY_SIG": F.when(n % 2 == 0, "POTA").when(n % 3 == 0, "SOTA").otherwise("WWFF"), "MY_SIG_INFO": F.when(n % 10 == 0, "").when(n % 4 == 0, "US-1234").when(n % 9 == 0, "W1/AB-123").otherwise("KFF-0001"),
        "IOTA": F.when(n % 6 == 0, "").when(n % 4 == 0, "EU-5").otherwise("EU-005"), "CQZ": F.when(n % 8 == 0, "41").otherwise("14"), "ITUZ": F.when(n % 9 == 0, "X").otherwise("28"),
        "COUNTRY": F.when(n % 4 == 0, "Nowhere").otherwise(""), "QSL_RCVD": F.when(n % 3 == 0, "Y").otherwise(""), "GRIDSQUARE": F.when(n % 12 == 0, "ZZ99").otherwise(F.col("grid")),
        "MY_GRIDSQUARE": F.col("my_grid"),
    }
    tags = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value"), F.lit(None).cast("string").alias("type")) for k, v in fields.items()]), lambda t: t["value"] != "")
    return synth.qso(spark, sf_dir).select("doc_id", F.col("line_no").alias("record"), "call", tags.alias("tags"))


FIELDS = f"""{CTE}, a AS (SELECT doc_id, line_no AS record, line_no AS n, my_call, sent, rcvd, my_grid, grid, w_country,
  CASE WHEN line_no % 31 = 0 THEN '' WHEN line_no % 37 = 0 THEN 'NOCALL' ELSE call END AS call, CASE WHEN line_no % 23 = 0 THEN '20261340' ELSE qso_date END AS date,
  CASE WHEN line_no % 17 = 0 THEN '2460' WHEN line_no % 5 = 0 THEN '' ELSE time_on END AS t_on, CASE WHEN line_no % 5 = 0 THEN '1200' ELSE '' END AS t_off,
  CASE WHEN line_no % 3 = 0 THEN '20M' ELSE '' END AS own_band, CASE WHEN line_no % 3 <> 0 THEN '14.05' WHEN line_no % 2 = 0 THEN '7.05' ELSE '' END AS f,
  CASE WHEN line_no % 7 = 0 THEN 'SSB' WHEN line_no % 11 = 0 THEN '' ELSE 'CW' END AS m, CASE WHEN line_no % 14 = 0 THEN 'USB' ELSE '' END AS sub,
  CASE WHEN line_no % 41 = 0 THEN '' ELSE my_call END AS station, CASE WHEN line_no % 2 = 0 THEN 'POTA' WHEN line_no % 3 = 0 THEN 'SOTA' ELSE 'WWFF' END AS sig,
  CASE WHEN line_no % 10 = 0 THEN '' WHEN line_no % 4 = 0 THEN 'US-1234' WHEN line_no % 9 = 0 THEN 'W1/AB-123' ELSE 'KFF-0001' END AS info,
  CASE WHEN line_no % 6 = 0 THEN '' WHEN line_no % 4 = 0 THEN 'EU-5' ELSE 'EU-005' END AS iota, CASE WHEN line_no % 12 = 0 THEN 'ZZ99' ELSE grid END AS square FROM g)
"""


@query("adif_to_cabrillo", FIELDS + """SELECT record, CASE WHEN f <> '' THEN CASE f WHEN '14.05' THEN '14050' ELSE '7050' END WHEN own_band <> '' THEN '14050' ELSE '' END AS frequency,
  CASE WHEN sub = 'USB' OR m = 'SSB' THEN 'PH' ELSE m END AS mode, substr(date, 1, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) AS qso_date,
  CASE WHEN t_on <> '' THEN t_on ELSE t_off END AS time_on, CASE WHEN station <> '' THEN station ELSE 'K1OP' END AS my_call,
  CASE WHEN sent <> '' THEN sent ELSE '001' END AS stx_string, call, CASE WHEN rcvd <> '' THEN rcvd ELSE '002' END AS srx_string, f = '' AND own_band <> '' AS inferred FROM a""")
def adif_to_cabrillo(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = conversions.adif_to_cabrillo(adif_records(spark, sf_dir).drop("call"))
    names = ["FREQUENCY", "MODE", "QSO_DATE", "TIME_ON", "MY_CALL", "STX_STRING", "CALL", "SRX_STRING"]
    return made.select("record", *[F.col(n).alias(n.lower()) for n in names], "inferred")


# --- preflight ---------------------------------------------------------------------------------------------------


def _core(name: str) -> str:
    e = lambda cond, sev, code, field: f"SELECT record, '{sev}' AS severity, '{name}-{code}' AS code, '{field}' AS field FROM a WHERE {cond}"
    return " UNION ALL ".join([
        e("call = ''", "error", "REQUIRED", "CALL"), e("m = ''", "error", "REQUIRED", "MODE"), e("call = 'NOCALL'", "warning", "CALL", "CALL"),
        e("n % 23 = 0", "error", "DATE", "QSO_DATE"), e("n % 17 = 0", "error", "TIME", "TIME_ON"), e("n % 6 = 0", "error", "BAND-FREQ", "FREQ"),
    ])


def _grid(name: str) -> str:
    return f"SELECT record, 'error', '{name}-GRID', 'GRIDSQUARE' FROM a WHERE square = 'ZZ99'"


def _reference(name: str, pattern: str) -> str:
    return f"""SELECT record, 'error', '{name}-REFERENCE', 'MY_SIG_INFO' FROM a WHERE sig <> '{name}' OR info = ''
      UNION ALL SELECT record, 'warning', '{name}-REFERENCE-FORMAT', 'MY_SIG_INFO' FROM a WHERE sig = '{name}' AND info <> '' AND NOT regexp_matches(info, '{pattern}')"""


EXTRA = {
    "generic": [],
    "lotw": ["SELECT record, 'error', 'LOTW-REQUIRED', 'STATION_CALLSIGN' FROM a WHERE station = ''", "SELECT record, 'error', 'LOTW-SAT-NAME', 'SAT_NAME' FROM a WHERE n % 19 = 0 AND n % 13 <> 0",
             "SELECT record, 'error', 'LOTW-PROP-SAT', 'PROP_MODE' FROM a WHERE n % 13 = 0 AND n % 19 <> 0",
             "SELECT NULL, 'error', 'LOTW-MIXED-LOCATION', 'STATION_CALLSIGN' FROM a WHERE station <> '' GROUP BY doc_id HAVING count(DISTINCT station || my_grid) > 1"],
    "clublog": ["SELECT record, 'warning', 'CLUBLOG-ENTITY', 'COUNTRY' FROM a WHERE n % 4 = 0 AND w_country IS NOT NULL", "SELECT record, 'info', 'CLUBLOG-QSL-STATUS', 'QSL_RCVD' FROM a WHERE n % 3 <> 0"],
    "qrz": ["SELECT record, 'error', 'QRZ-CQZ', 'CQZ' FROM a WHERE n % 8 = 0", "SELECT record, 'error', 'QRZ-ITUZ', 'ITUZ' FROM a WHERE n % 9 = 0", "SELECT record, 'error', 'QRZ-DATE-RANGE', 'QSO_DATE' FROM a WHERE date > '20240115'"],
    "pota": [_reference("POTA", "^[A-Z0-9]{1,4}-[0-9]{4,5}$")], "sota": [_reference("SOTA", "^[A-Z0-9]{1,4}/[A-Z0-9]{2}-[0-9]{3}$")], "wwff": [_reference("WWFF", "^[A-Z0-9]{1,4}FF-[0-9]{4,5}$")],
    "iota": ["SELECT record, 'error', 'IOTA-REFERENCE', 'MY_IOTA' FROM a WHERE iota = ''", "SELECT record, 'error', 'IOTA-REFERENCE-FORMAT', 'MY_IOTA' FROM a WHERE iota = 'EU-5'"],
}


def preflight_sql(profile: str) -> str:
    name = profile.upper()
    parts = [*([_core(name)] if profile != "generic" else ["SELECT 0::BIGINT AS record, '' AS severity, '' AS code, '' AS field WHERE FALSE"]), *EXTRA[profile], _grid(name)]
    return FIELDS + "SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


def checked(spark: SparkSession, sf_dir: str, profile: str) -> tuple[DataFrame, DataFrame]:
    records = adif_records(spark, sf_dir)
    if profile == "clublog":
        records = lookup.country_lookup(records, "call", synth.countries(spark), "w_")
    return records, preflight.findings(records, profile, date_to="2024-01-15", keys=("doc_id",))


def preflight_findings(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    return checked(spark, sf_dir, profile)[1].drop("doc_id")


for _profile in preflight.PROFILES:
    query(f"preflight_{_profile}", preflight_sql(_profile))(partial(preflight_findings, profile=_profile))


@query("preflight_outcome", FIELDS + f""", x AS (SELECT * FROM ({_core('POTA')} UNION ALL {EXTRA['pota'][0]} UNION ALL {_grid('POTA')})),
  w AS (SELECT record, bool_or(severity = 'error') AS bad, bool_or(severity = 'warning') AS odd FROM x GROUP BY record)
  SELECT doc_id, record, CASE WHEN bad THEN 'rejected' WHEN odd THEN 'review' ELSE 'ready' END AS outcome FROM a LEFT JOIN w USING (record)""")
def preflight_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, found = checked(spark, sf_dir, "pota")
    return preflight.outcome(records, found, ("doc_id",))


# --- EDI ---------------------------------------------------------------------------------------------------------


def edi_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no")
    flag = lambda c: F.when(c, "N").otherwise("")
    return synth.qso(spark, sf_dir).select(
        "doc_id", "line_no", F.substring("qso_date", 3, 6).alias("DATE"), F.col("time_on").alias("TIME"), F.when(n % 21 == 0, "ERROR").otherwise(F.col("call")).alias("CALL"),
        (n % 9 + 1).cast("string").alias("MODE_CODE"), F.lit("59").alias("RST_SENT"), F.col("sent").alias("QSO_SENT"), F.lit("59").alias("RST_RCVD"), F.col("rcvd").alias("QSO_RCVD"),
        F.lit("").alias("EXCHANGE_RCVD"), F.col("grid").alias("WWL_RCVD"), F.when(n % 25 == 0, "").otherwise((n % 500).cast("string")).alias("QSO_POINTS"),
        F.lit("").alias("NEW_EXCHANGE"), flag(n % 6 == 0).alias("NEW_WWL"), flag((n % 8 == 0) & (F.col("doc_id") % 2 == 0)).alias("NEW_DXCC"), F.when(n % 20 == 0, "d").otherwise("").alias("DUPLICATE"),
    )


def edi_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = synth.qso(spark, sf_dir).select("doc_id").distinct()
    pairs = {"PCALL": F.lit("DL1AA"), "PWWLO": F.lit("JO62QM"), "TDATE": F.when(F.col("doc_id") % 2 == 0, "20240101;20240131").otherwise(""), "CTOSC": F.when(F.col("doc_id") % 3 == 0, "1").otherwise(""),
             "PBAND": F.element_at(F.array(*map(F.lit, ["144 MHz", "1,3 GHz", "432 MHz", "10 GHz", "21 MHz"])), (F.col("doc_id") % 5 + 1).cast("int")), "CWWLS": F.lit("9;500;1"), "CEXCS": F.lit("2;10;"), "CDXCS": F.lit("3;5;2")}
    return logs.select("doc_id", F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())).alias("headers"))


EDI = CTE + """, e AS (SELECT doc_id, line_no, qso_date, time_on, sent, rcvd, grid, CASE WHEN line_no % 21 = 0 THEN 'ERROR' ELSE call END AS call, line_no % 9 + 1 AS code,
  CASE WHEN line_no % 25 = 0 THEN NULL ELSE (line_no % 500)::DOUBLE END AS pts, line_no % 6 = 0 AS w, line_no % 8 = 0 AND doc_id % 2 = 0 AS d, line_no % 20 = 0 AS dup FROM q)
"""


@query("edi_to_adif", EDI + """SELECT doc_id, line_no, call, CASE WHEN doc_id % 2 = 0 OR substr(qso_date, 3, 2) < '70' THEN '20' ELSE '19' END || substr(qso_date, 3, 6) AS qso_date, time_on,
  ['SSB','CW','SSB','CW','AM','FM','RTTY','SSTV','ATV'][code] AS mode, sent AS stx, rcvd AS srx, grid AS gridsquare, ['2M','23CM','70CM','3CM',''][doc_id % 5 + 1] AS band,
  'DL1AA' AS station_callsign, '/' || CASE WHEN w THEN 'N' ELSE '' END || '/' || CASE WHEN d THEN 'N' ELSE '' END || '/' || CASE WHEN dup THEN 'd' ELSE '' END AS flags FROM e""")
def edi_to_adif(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = conversions.edi_to_adif(edi_contacts(spark, sf_dir), edi_headers(spark, sf_dir), ["doc_id"])
    names = ["CALL", "QSO_DATE", "TIME_ON", "MODE", "STX", "SRX", "GRIDSQUARE", "BAND", "STATION_CALLSIGN"]
    return made.select("doc_id", "line_no", *[F.col(n).alias(n.lower()) for n in names], F.col("EDI_FLAGS").alias("flags"))


@query("edi_scores", EDI + """, s AS (SELECT *, CASE WHEN dup THEN 'duplicate' WHEN call = 'ERROR' THEN 'error' WHEN pts IS NULL OR pts <= 0 THEN 'incomplete' ELSE 'counted' END AS st FROM e),
  t AS (SELECT doc_id, count(*) FILTER (st = 'counted') AS valid, count(*) FILTER (st = 'duplicate') AS duplicates, count(*) FILTER (st IN ('error', 'incomplete')) AS invalid,
    sum(pts) FILTER (st = 'counted') AS qso_points, count(*) FILTER (st = 'counted' AND w) AS w, count(*) FILTER (st = 'counted' AND d) AS d FROM s GROUP BY doc_id),
  u AS (SELECT *, CASE WHEN w > 0 THEN w ELSE 9 END AS new_wwls, 2::BIGINT AS new_exchanges, CASE WHEN d > 0 THEN d ELSE 3 END AS new_dxccs FROM t)
  SELECT doc_id, valid, duplicates, invalid, qso_points, new_wwls, new_exchanges, new_dxccs, (new_wwls * 500 + 20 + new_dxccs * 5)::DOUBLE AS bonuses, 2::DOUBLE AS multipliers,
    'points' AS formula, qso_points AS total FROM u""")
def edi_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversions.edi_scores(edi_contacts(spark, sf_dir), edi_headers(spark, sf_dir), ["doc_id"]).drop("claimed", "inferred")


# --- reference data ----------------------------------------------------------------------------------------------


@query("country_file", "SELECT n_name AS country, 'N' || n_nationkey AS prefix, FALSE AS exact, 14 AS cq_zone, 28 AS itu_zone, 'EU' AS continent, -(n_nationkey + 0.5)::DOUBLE AS longitude, -1.0::DOUBLE AS utc_offset FROM nation"
       " UNION ALL SELECT n_name, 'X' || n_nationkey || 'A', TRUE, 33, 37, 'AF', -7.0::DOUBLE, -1.0::DOUBLE FROM nation"
       " UNION ALL SELECT n_name, 'Q' || n_nationkey, FALSE, 14, 28, 'EU', -(n_nationkey + 0.5)::DOUBLE, 2.5::DOUBLE FROM nation")
def country_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.col("n_name"), F.lit(":  14:  28:  EU:   48.00:   "), k, F.lit(".50:    1.0:  N"), k, F.lit(":\r\n  # not an alias\r\n    N"), k, F.lit(",=X"), k, F.lit("A(33)[37]{AF}<10.0/7.0>,Q"), k, F.lit("~-2.5~;\r\n"))
    files = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy(F.lit("cty.dat").alias("path")).agg(F.array_join(F.sort_array(F.collect_list(text)), "").alias("text"))
    return reference.country_entries(files).select("country", "prefix", "exact", "cq_zone", "itu_zone", "continent", "longitude", "utc_offset")


@query("known_call_list", CTE + "SELECT DISTINCT c AS call FROM (SELECT call AS c FROM q UNION ALL SELECT split_part(call, '/', 1) FROM q) WHERE length(c) >= 3")
def known_call_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = synth.qso(spark, sf_dir).groupBy("doc_id", "qso_date").agg(F.array_join(F.collect_set(F.lower("call")), ", ").alias("text"))
    return reference.known_calls(texts.withColumn("text", F.concat("text", F.lit("\n12 ab\0NOTACALL;"))))


@query("fast_entry", CTE + """, n AS (SELECT doc_id, line_no, call, time_on, row_number() OVER (PARTITION BY doc_id, qso_date ORDER BY line_no) AS k, qso_date FROM q)
  SELECT doc_id, qso_date, (k + 1)::INT AS line_no, call, qso_date AS date, '14.05' AS freq, 'CW' AS mode, CASE WHEN k = 1 THEN '7' ELSE lpad((k + 6)::VARCHAR, greatest(length((k + 6)::VARCHAR), 3)::INT, '0') END AS stx,
    CASE WHEN k % 7 = 0 THEN 'unclear ???' ELSE '' END AS errors FROM n""")
def fast_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each day: the first line gives date, frequency, mode and serial, the others a call and a fixed time."""
    from pyspark.sql import Window

    rows = synth.qso(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "qso_date").orderBy("line_no")))
    head = F.when(F.col("k") == 1, F.concat(F.lit("DATE="), F.col("qso_date"), F.lit(" FREQ=14.05 MODE=CW STX=7 "))).otherwise("")
    line = F.concat(head, F.lit("1200 "), F.col("call"), F.when(F.col("k") % 7 == 0, " ???").otherwise(""), F.when(F.col("k") % 5 == 0, ' NOTE="a b"').otherwise(""))
    notes = rows.groupBy("doc_id", "qso_date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    made = reference.fast_entries(notes.withColumn("text", F.concat(F.lit("# a day\n"), F.col("text"))))
    value = lambda k: F.try_element_at(F.col("values"), F.lit(k))
    return made.select("doc_id", "qso_date", F.col("line_no").cast("int").alias("line_no"), value("CALL").alias("call"), value("DATE").alias("date"), value("FREQ").alias("freq"), value("MODE").alias("mode"), value("STX").alias("stx"), F.array_join("errors", "; ").alias("errors"))


@query("contest_entities", "SELECT DISTINCT prim AS entity, continent FROM " + contest_view.COUNTRIES_SQL)
def contest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contest_view.countries(spark).select(F.col("primary").alias("entity"), "continent").distinct()


# --- order and duplicates ----------------------------------------------------------------------------------------


@query("sorted_slots", CTE + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY qso_date, time_on, line_no) AS n FROM q),
  p AS (SELECT doc_id, line_no AS slot, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM q) SELECT doc_id, line_no, slot FROM o JOIN p USING (doc_id, n)""")
def sorted_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.sorted_slots(synth.qso(spark, sf_dir)).select("doc_id", "line_no", "slot")


PAIRS = CTE + """, pairs AS (SELECT DISTINCT a.line_no AS first, b.line_no AS second FROM q a JOIN q b ON a.call = b.call AND a.qso_date = b.qso_date AND a.line_no < b.line_no
  AND abs(a.epoch_min - b.epoch_min) <= 30 AND ((a.band = b.band AND upper(a.mode) = upper(b.mode)) OR a.epoch_min = b.epoch_min))
"""
RESOLVED = {
    "keep-first": "SELECT line_no AS id, call, grid FROM q WHERE line_no NOT IN (SELECT second FROM pairs)",
    "keep-last": "SELECT line_no AS id, call, grid FROM q WHERE line_no NOT IN (SELECT first FROM pairs)",
    "merge": """, way AS (SELECT first AS x, second AS y FROM pairs UNION SELECT second, first FROM pairs), reach(id, root) AS (SELECT DISTINCT x, x FROM way UNION SELECT way.y, reach.root FROM reach JOIN way ON way.x = reach.id),
      class AS (SELECT id, min(root) AS root FROM reach GROUP BY id) SELECT line_no AS id, call,
      CASE WHEN grid <> '' THEN grid ELSE coalesce((SELECT arg_min(b.grid, b.line_no) FROM class JOIN q b ON class.id = b.line_no WHERE class.root = q.line_no AND b.grid <> ''), '') END AS grid
      FROM q WHERE line_no NOT IN (SELECT id FROM class WHERE id <> root)""",
}


def resolved(spark: SparkSession, sf_dir: str, action: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir).withColumn("id", F.col("line_no"))
    band = F.coalesce(F.nullif(radio.band_from_frequency(F.col("freq")), F.lit("")), F.lit("OTHER"))
    pairs = contacts.duplicate_pairs(rows.withColumn("band", band), 30)
    return contacts.resolve_duplicates(rows.select("id", "call", "grid"), pairs, action)


for _action, _sql in RESOLVED.items():
    query(f"resolve_{_action.replace('-', '_')}", (PAIRS.replace("WITH", "WITH RECURSIVE", 1) if _action == "merge" else PAIRS) + _sql)(partial(resolved, action=_action))
