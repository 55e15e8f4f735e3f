"""The registered queries of the contact-log operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsolake.functions import geo, radio, values
from qsolake.operators import contacts, lookup
from qsolake.plans import rules, scoring, synth
from qsolake.sources import writers

BAND_CASE = "CASE " + " ".join(f"WHEN khz BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in radio.BANDS_KHZ) + " ELSE '' END"
#: Band of the view's frequencies, which are kHz, MHz below 1000, or GHz with a G.
KHZ_SQL = """CASE WHEN freq LIKE '%G' THEN CAST(replace(replace(freq, 'G', ''), ',', '.') AS DOUBLE) * 1000000
  WHEN CAST(replace(freq, ',', '.') AS DOUBLE) < 1000 THEN CAST(replace(freq, ',', '.') AS DOUBLE) * 1000
  ELSE CAST(replace(freq, ',', '.') AS DOUBLE) END"""
#: The base call of the view's calls, which have at most two parts, and their award prefix.
BASE_SQL = """CASE WHEN call NOT LIKE '%/%' THEN call WHEN split_part(call, '/', 2) IN ('A','AM','M','MM','P','QRP','R') THEN split_part(call, '/', 1)
  WHEN length(split_part(call, '/', 2)) > length(split_part(call, '/', 1)) THEN split_part(call, '/', 2) ELSE split_part(call, '/', 1) END"""
WPX_SQL = f"CASE WHEN regexp_extract({BASE_SQL}, '^(.*[0-9])', 1) <> '' THEN regexp_extract({BASE_SQL}, '^(.*[0-9])', 1) ELSE substr({BASE_SQL}, 1, 2) || '0' END"

CTE = f"""
WITH q0 AS (SELECT *, {KHZ_SQL} AS khz FROM {synth.QSO_SQL}), c AS (SELECT * FROM {synth.COUNTRY_SQL}),
q AS (SELECT *, coalesce(nullif({BAND_CASE}, ''), 'OTHER') AS band, {WPX_SQL} AS wpx FROM q0),
calls AS (SELECT DISTINCT call FROM q UNION SELECT DISTINCT my_call FROM q),
cand AS (
  SELECT call, 0 AS nth, split_part(call, '/', 2) AS cand FROM calls WHERE regexp_matches(split_part(call, '/', 2), '^[A-Z]{{0,3}}[0-9]{{1,2}}$')
  UNION ALL SELECT call, 1, call FROM calls
  UNION ALL SELECT call, 2, split_part(call, '/', 1) FROM calls WHERE call LIKE '%/%' AND length(split_part(call, '/', 1)) <= 4
  UNION ALL SELECT call, 3, {BASE_SQL} FROM calls WHERE call LIKE '%/%'
),
hit AS (
  SELECT call, c.*, row_number() OVER (PARTITION BY call ORDER BY nth, exact DESC, length(prefix) DESC) AS n
  FROM cand JOIN c ON (exact AND prefix = cand) OR (NOT exact AND starts_with(cand, prefix))
),
geo AS (SELECT * FROM hit WHERE n = 1),
g AS (
  SELECT q.*, w.country AS w_country, w.continent AS w_continent, w.cq_zone AS w_cq, w.itu_zone AS w_itu, w.prefix AS w_matched,
    s.country AS s_country, s.continent AS s_continent
  FROM q LEFT JOIN geo w ON q.call = w.call LEFT JOIN geo s ON q.my_call = s.call
)
"""


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = synth.countries(spark)
    rows = lookup.country_lookup(synth.qso(spark, sf_dir), "call", table, "w_")
    return lookup.country_lookup(rows, "my_call", table, "s_")


def scored(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return scoring.score_rows(located(spark, sf_dir), rules.RULES[rule])


QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# --- scalar functions -------------------------------------------------------------------------------------------


@query("band_from_frequency", CTE + "SELECT line_no, freq, replace(band, 'OTHER', '') AS band FROM q")
def band_from_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.qso(spark, sf_dir).select("line_no", "freq", radio.band_from_frequency(F.col("freq")).alias("band"))


@query("wpx_prefix", CTE + "SELECT DISTINCT call, wpx FROM q")
def wpx_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.qso(spark, sf_dir).select("call", radio.wpx_prefix(F.col("call")).alias("wpx")).distinct()


@query("base_call", CTE + f"SELECT DISTINCT call, {BASE_SQL} AS base FROM q")
def base_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.qso(spark, sf_dir).select("call", radio.base_call(F.col("call")).alias("base")).distinct()


@query("callsign_plausible", """SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9/]', '', 'g') AS call,
  length(regexp_replace(upper(c_name), '[^A-Z0-9/]', '', 'g')) BETWEEN 3 AND 15
  AND regexp_matches(regexp_replace(upper(c_name), '[^A-Z0-9/]', '', 'g'), '^([A-Z0-9]{1,4}/)?[A-Z0-9]{1,7}(/[A-Z0-9]{1,4})?$') AS plausible FROM customer""")
def callsign_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", radio.normalize_callsign(name).alias("call"), radio.plausible_callsign(name).alias("plausible"))


def _center(col: str, name: str) -> str:
    lon = f"(ascii(substr({col}, 1, 1)) - 65) * 20.0 - 180 + CAST(substr({col}, 3, 1) AS INT) * 2.0 + (ascii(substr({col}, 5, 1)) - 65) * (2.0::DOUBLE / 24) + (2.0::DOUBLE / 24) / 2"
    lat = f"(ascii(substr({col}, 2, 1)) - 65) * 10.0 - 90 + CAST(substr({col}, 4, 1) AS INT) * 1.0 + (ascii(substr({col}, 6, 1)) - 65) * (1.0::DOUBLE / 24) + (1.0::DOUBLE / 24) / 2"
    return f"radians(CASE WHEN {col} <> '' THEN {lat} END) AS {name}_lat, radians(CASE WHEN {col} <> '' THEN {lon} END) AS {name}_lon"


KM_CTE = CTE + f""", p AS (SELECT *, {_center('my_grid', 'a')}, {_center('grid', 'b')} FROM q),
h AS (SELECT *, pow(sin((b_lat - a_lat) / 2), 2) + cos(a_lat) * cos(b_lat) * pow(sin((b_lon - a_lon) / 2), 2) AS hav FROM p),
km AS (SELECT *, 6371.0088 * 2 * atan2(sqrt(hav), sqrt(1 - hav)) AS km FROM h)
"""


@query("locator_distance", KM_CTE + "SELECT line_no, my_grid, grid, round(km, 6) AS km FROM km")
def locator_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir)
    return rows.select("line_no", "my_grid", "grid", F.round(geo.distance_km(F.col("my_grid"), F.col("grid")), 6).alias("km"))


@query("odx_top1", KM_CTE + """SELECT doc_id, line_no, call, round(km, 6) AS km FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY km DESC, line_no) AS n FROM km WHERE km IS NOT NULL) WHERE n = 1""")
def odx_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir).withColumn("km", geo.distance_km(F.col("my_grid"), F.col("grid")))
    return contacts.farthest(rows).withColumn("km", F.round("km", 6))


@query("convert_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y-%m-%d') AS dashed FROM orders")
def convert_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("d", F.date_format("o_orderdate", "dd-MMM-yyyy"))
    slash = F.date_format("o_orderdate", "MM/dd/yyyy")
    return rows.select(
        "o_orderkey", values.convert_date(F.col("d"), "DD-MMM-YYYY").alias("compact"), values.convert_date(slash, "MM/DD/YYYY", "YYYY-MM-DD").alias("dashed")
    )


@query("shift_time", CTE + """SELECT line_no, strftime(t, '%Y-%m-%d') AS date, strftime(t, '%H%M') AS time FROM (
  SELECT line_no, strptime(qso_date || time_on, '%Y%m%d%H%M') + INTERVAL 95 MINUTE AS t FROM q)""")
def shift_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = values.convert_date(F.col("qso_date"), "YYYYMMDD", "YYYY-MM-DD")
    return synth.qso(spark, sf_dir).select("line_no", values.shift_time(date, F.col("time_on"), 95).alias("s")).select("line_no", "s.*")


@query("serial_pad", CTE + "SELECT line_no, CASE WHEN regexp_matches(rcvd, '^[0-9]+$') THEN lpad(rcvd, greatest(length(rcvd), 3)::INT, '0') END AS serial FROM q")
def serial_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.qso(spark, sf_dir).select("line_no", values.normalize_serial(F.col("rcvd"), 3).alias("serial"))


@query("export_csv_safe", CTE + """SELECT line_no, CASE WHEN contains(s, '"') OR contains(s, ',') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS cell
  FROM (SELECT line_no, CASE WHEN comment LIKE '=%' THEN '''' || comment ELSE comment END AS s FROM q)""")
def export_csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.qso(spark, sf_dir).select("line_no", values.csv_quoted(values.formula_safe(F.col("comment"))).alias("cell"))


# --- look-ups ---------------------------------------------------------------------------------------------------


@query("longest_prefix_lookup", CTE + "SELECT line_no, call, w_country, w_continent, w_cq, w_itu, w_matched FROM g")
def longest_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.country_lookup(synth.qso(spark, sf_dir), "call", synth.countries(spark), "w_")
    return rows.select("line_no", "call", "w_country", "w_continent", "w_cq", "w_itu", "w_matched")


#: Known calls: one for each supplier, in the form of the view's calls.
KNOWN = """concat(CASE s_suppkey % 6 WHEN 0 THEN 'K' WHEN 1 THEN 'G' WHEN 2 THEN 'DL' WHEN 3 THEN 'JA' WHEN 4 THEN 'VE' ELSE 'ZS' END,
  CAST(s_suppkey % 10 AS STRING), CASE s_suppkey % 3 WHEN 0 THEN 'AB' WHEN 1 THEN 'XYZ' ELSE 'WW' END)"""
KNOWN_SQL = f"SELECT DISTINCT {KNOWN} AS call FROM supplier"


def known_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(f"{KNOWN} AS call").distinct()


@query("anti_known_calls", CTE + f"""SELECT line_no, call FROM q WHERE call NOT IN ({KNOWN_SQL}) AND {BASE_SQL} NOT IN ({KNOWN_SQL})""")
def anti_known_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.unknown_calls(synth.qso(spark, sf_dir), "call", known_calls(spark, sf_dir)).select("line_no", "call")


@query("prefix_suggest", CTE + "SELECT DISTINCT call FROM q WHERE call LIKE 'K%' ORDER BY call LIMIT 8")
def prefix_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.prefix_suggestions(synth.qso(spark, sf_dir), "k")


@query("hamming1_suggest", CTE + f""", k AS ({KNOWN_SQL}), m AS (
  SELECT a.call, k.call AS suggestion FROM (SELECT DISTINCT call FROM q) a JOIN k ON length(a.call) = length(k.call) AND hamming(a.call, k.call) = 1
) SELECT call, suggestion FROM (SELECT *, row_number() OVER (PARTITION BY call ORDER BY suggestion) AS n FROM m) WHERE n <= 5""")
def hamming1_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.one_letter_off(synth.qso(spark, sf_dir), known_calls(spark, sf_dir))


# --- duplicates, merging, filters, splits -----------------------------------------------------------------------

DUP = "row_number() OVER (PARTITION BY doc_id, {} ORDER BY line_no) > 1 AS duplicate"


@query("dup_flag", CTE + f"SELECT line_no, {DUP.format('band, mode, upper(call)')} FROM q")
def dup_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir).withColumn("band", F.coalesce(F.nullif(radio.band_from_frequency(F.col("freq")), F.lit("")), F.lit("OTHER")))
    return contacts.flag_duplicates(rows, [F.col("band"), F.col("mode"), F.upper("call")]).select("line_no", "duplicate")


@query("near_duplicates", CTE + """SELECT a.line_no AS first, b.line_no AS second,
  CASE WHEN a.epoch_min = b.epoch_min AND a.band = b.band AND upper(a.mode) = upper(b.mode) THEN 'exact'
    WHEN a.band = b.band AND upper(a.mode) = upper(b.mode) THEN 'near' WHEN a.epoch_min = b.epoch_min THEN 'possible' END AS kind,
  abs(a.epoch_min - b.epoch_min) AS delta
  FROM q a JOIN q b ON a.call = b.call AND a.qso_date = b.qso_date AND a.line_no < b.line_no AND abs(a.epoch_min - b.epoch_min) <= 30
  WHERE kind IS NOT NULL""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir).withColumn("id", F.col("line_no"))
    rows = rows.withColumn("band", F.coalesce(F.nullif(radio.band_from_frequency(F.col("freq")), F.lit("")), F.lit("OTHER")))
    return contacts.duplicate_pairs(rows, 30)


def _merge_sql(pick: str) -> str:
    shifted = "strftime(strptime(qso_date || time_on, '%Y%m%d%H%M') + INTERVAL 1 MINUTE * (line_no % 2), '%H%M')"
    rows = f"SELECT 0 AS nth, line_no AS ord, call, qso_date, time_on, mode, band, line_no FROM q UNION ALL SELECT 1, line_no, call, qso_date, {shifted}, upper(mode), band, line_no + 1000000 FROM q"
    if pick == "all":
        return CTE + f"SELECT call, qso_date, time_on, mode, band, line_no, nth AS first_nth, ord AS first_ord FROM ({rows})"
    keys = "upper(call), qso_date, time_on, upper(mode), band"
    part = f"PARTITION BY {keys} ORDER BY nth, ord"
    wanted = "n = 1" if pick == "first" else "n = total"
    return CTE + f""", r AS ({rows}), o AS (
      SELECT *, row_number() OVER ({part}) AS n, count(*) OVER (PARTITION BY {keys}) AS total,
        first_value(nth) OVER ({part}) AS first_nth, first_value(ord) OVER ({part}) AS first_ord FROM r
    ) SELECT call, qso_date, time_on, mode, band, line_no, first_nth, first_ord FROM o WHERE {wanted}"""


def _merged(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    """The log and a copy of it whose odd contacts are a minute later: on call, date, time, mode and band."""
    band = F.coalesce(F.nullif(radio.band_from_frequency(F.col("freq")), F.lit("")), F.lit("OTHER"))
    a = synth.qso(spark, sf_dir).select("call", "qso_date", "time_on", "mode", band.alias("band"), "line_no", F.col("line_no").alias("ord"))
    later = F.try_to_timestamp(F.concat("qso_date", "time_on"), F.lit("yyyyMMddHHmm")) + F.make_dt_interval(mins=(F.col("line_no") % 2).cast("int"))
    b = a.withColumn("mode", F.upper("mode")).withColumn("time_on", F.date_format(later, "HHmm")).withColumn("line_no", F.col("line_no") + 1_000_000)
    out = contacts.merge([a, b], ["call", "qso_date", "time_on", "mode", "band"], strategy)
    return out.select("call", "qso_date", "time_on", "mode", "band", "line_no", F.col("position._nth").alias("first_nth"), F.col("position.ord").alias("first_ord"))


for _pick in ("first", "last", "all"):
    query(f"merge_keep_{_pick}", _merge_sql(_pick))(partial(_merged, strategy=f"keep-{_pick}"))


@query("filter_date_band_mode", CTE + "SELECT line_no, call FROM g WHERE qso_date >= (SELECT min(qso_date) FROM q) AND qso_date <= '20991231' AND band IN ('20M', '40M') AND upper(mode) = 'CW' AND w_continent IN ('EU', 'AS')")
def filter_date_band_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contacts.filter_contacts(located(spark, sf_dir), date_from="1990-01-01", date_to="2099-12-31", bands=["20m", "40M"], modes=["cw"], continents=["eu", "AS"])
    return out.select("line_no", "call")


@query("split_station", CTE + "SELECT my_call || '|' || my_grid AS part, count(*) AS n FROM q GROUP BY 1")
def split_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.qso(spark, sf_dir).groupBy(contacts.split_key("station").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("split_date", CTE + "SELECT qso_date AS part, count(*) AS n FROM q GROUP BY 1")
def split_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.qso(spark, sf_dir).groupBy(contacts.split_key("date").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("log_summary", CTE + "SELECT doc_id, count(*) AS contacts, count(DISTINCT call) AS calls, min(epoch_min) AS first_min, max(epoch_min) AS last_min, count(DISTINCT qso_date) AS days FROM q GROUP BY doc_id")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.log_summary(synth.qso(spark, sf_dir))


@query("common_metadata", CTE + "SELECT doc_id, CASE WHEN count(DISTINCT my_call) = 1 THEN min(my_call) END AS my_call FROM q GROUP BY doc_id")
def common_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.common_value(synth.qso(spark, sf_dir), "my_call")


# --- scoring ----------------------------------------------------------------------------------------------------

GENERIC = CTE + f""", s0 AS (SELECT *, {DUP.format('band, mode, upper(call)')} FROM g),
s AS (SELECT *, CASE WHEN duplicate THEN 0 ELSE 1 END AS points, CASE WHEN duplicate THEN '' ELSE wpx END AS multiplier FROM s0)
"""


@query("score_by_band", GENERIC + """SELECT doc_id, band, count(*) FILTER (NOT duplicate) AS qsos, sum(points)::BIGINT AS points, 0::BIGINT AS bonus,
  count(DISTINCT nullif(multiplier, '')) AS multipliers FROM s GROUP BY doc_id, band""")
def score_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_band(scored(spark, sf_dir, "generic-prefix"), rules.RULES["generic-prefix"])


@query("score_by_mode", GENERIC + "SELECT doc_id, upper(mode) AS mode, count(*) FILTER (NOT duplicate) AS qsos, sum(points)::BIGINT AS points FROM s GROUP BY 1, 2")
def score_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_mode(scored(spark, sf_dir, "generic-prefix"))


@query("score_by_country", GENERIC + """SELECT doc_id, coalesce(w_country, 'Unknown') AS country, coalesce(w_continent, '') AS continent, count(*) FILTER (NOT duplicate) AS qsos, sum(points)::BIGINT AS points,
  row_number() OVER (PARTITION BY doc_id ORDER BY count(*) FILTER (NOT duplicate) DESC, coalesce(w_country, 'Unknown'), coalesce(w_continent, '')) AS place FROM s GROUP BY 1, 2, 3""")
def score_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_country(scored(spark, sf_dir, "generic-prefix"))


@query("score_by_hour", GENERIC + "SELECT doc_id, qso_date || ' ' || substr(time_on, 1, 2) || ':00' AS hour, count(*) FILTER (NOT duplicate) AS qsos, sum(points)::BIGINT AS points FROM s GROUP BY 1, 2")
def score_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_hour(scored(spark, sf_dir, "generic-prefix"))


@query("score_overrides", GENERIC + """, o AS (SELECT *, CASE WHEN line_no % 50 = 0 THEN 7 ELSE points END AS p, CASE WHEN line_no % 70 = 0 THEN 'X1' ELSE multiplier END AS m FROM s)
  SELECT doc_id, count(*) FILTER (NOT duplicate) AS qsos, count(*) FILTER (duplicate) AS duplicates, sum(p)::BIGINT AS points,
    count(DISTINCT CASE WHEN NOT duplicate AND m <> '' THEN m END) AS multipliers,
    (sum(p) * count(DISTINCT CASE WHEN NOT duplicate AND m <> '' THEN m END))::BIGINT AS total FROM o GROUP BY doc_id""")
def score_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, "generic-prefix")
    overrides = rows.select(
        "doc_id", "line_no", F.when(F.col("line_no") % 50 == 0, 7).cast("long").alias("points"), F.when(F.col("line_no") % 70 == 0, "X1").alias("multiplier")
    ).where("points is not null or multiplier is not null")
    return scoring.totals(scoring.with_overrides(rows, overrides), rules.RULES["generic-prefix"])


for _name, _size, _period in (("15m", 15, None), ("60m", 60, None), ("period", 60, (1500, 20000))):

    def _buckets(spark: SparkSession, sf_dir: str, size=_size, period=_period) -> DataFrame:
        return contacts.activity_buckets(scored(spark, sf_dir, "generic-prefix"), size, period)

    query(f"activity_buckets_{_name}", GENERIC + f"""SELECT doc_id, (epoch_min // {_size} * {_size})::BIGINT AS bucket,
      count(*) FILTER (NOT duplicate) AS qsos, sum(points)::BIGINT AS points FROM s
      {'WHERE epoch_min BETWEEN %d AND %d' % _period if _period else ''} GROUP BY 1, 2""")(_buckets)


@query("report_scores", GENERIC + """SELECT doc_id, array_to_string([line_no::VARCHAR, call, band, mode, coalesce(w_country, ''), coalesce(w_continent, ''), coalesce(w_matched, ''), points::VARCHAR, '0',
  multiplier, CASE WHEN duplicate THEN 'Y' ELSE 'N' END], ',') AS line FROM s""")
def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.report_lines(scored(spark, sf_dir, "generic-prefix"), writers.SCORE_REPORT, ["doc_id"])


@query("report_activity", GENERIC + """SELECT doc_id, concat((epoch_min // 60 * 60)::BIGINT, ',', count(*) FILTER (NOT duplicate), ',', sum(points)::BIGINT) AS line FROM s GROUP BY doc_id, epoch_min // 60""")
def report_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.report_lines(contacts.activity_buckets(scored(spark, sf_dir, "generic-prefix"), 60), writers.ACTIVITY_REPORT, ["doc_id"])
