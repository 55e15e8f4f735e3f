"""The registered queries of the guided import: files in five layouts, made from the contact view, each 50 contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsolake.operators import recovery, workspace
from qsolake.operators.components import checkpoints
from qsolake.plans import synth
from qsolake.queries import CTE
from qsolake.sources import guided

PER_FILE = 50
# Planted: calls and locators that are none, sideband for mode, an empty mode, a cell too few, and cells
# too many, which add a column that the other rows of their file then lack.
BASE = {
    "line_no": "line_no", "file": f"CAST(floor(line_no / {PER_FILE}) AS BIGINT)", "fmt": f"CAST(floor(line_no / {PER_FILE}) AS BIGINT) % 5",
    "d": "qso_date", "t": f"CASE WHEN floor(line_no / {PER_FILE}) % 5 = 4 THEN '1200' ELSE time_on END",
    "f": f"CASE WHEN floor(line_no / {PER_FILE}) % 5 < 4 THEN freq WHEN line_no % 10 = 0 THEN '999999' ELSE '14.05' END",
    "m": f"""CASE WHEN floor(line_no / {PER_FILE}) % 5 = 4 AND mode = 'RY' THEN 'CW' WHEN floor(line_no / {PER_FILE}) % 5 = 1 AND line_no % 31 = 0 THEN ''
      WHEN mode = 'PH' AND line_no % 4 = 0 THEN 'USB' ELSE mode END""",
    "own": "my_call", "c": "CASE WHEN line_no % 37 = 0 THEN 'NOCALL' ELSE call END", "r": "rcvd",
    "g": "CASE WHEN line_no % 41 = 0 THEN 'ZZ99' ELSE grid END", "note": "comment",
}
HEADER = ["Date", "Time", "Freq", "Mode", "MyCall", "Call", "SRX", "Grid", "Comment"]
NAMES = ["QSO_DATE", "TIME_ON", "FREQ", "MODE", "STATION_CALLSIGN", "CALL", "SRX", "GRIDSQUARE", "COMMENT"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.qso(spark, sf_dir).selectExpr(*[f"{v} AS {k}" for k, v in BASE.items()])
    day = F.when(F.col("fmt") == 1, F.concat_ws("-", F.substring("d", 1, 4), F.substring("d", 5, 2), F.substring("d", 7, 2))).when(
        F.col("fmt") == 2, F.concat_ws("/", F.substring("d", 7, 2), F.substring("d", 5, 2), F.substring("d", 1, 4))).otherwise(F.col("d"))
    clock = F.when(F.col("fmt") == 1, F.concat_ws(":", F.substring("t", 1, 2), F.substring("t", 3, 2))).otherwise(F.col("t"))
    cells = F.array(day, clock, "f", "m", "own", "c", "r", "g", "note")
    cells = F.when((F.col("fmt") == 2) & (F.col("line_no") % 29 == 0), F.slice(cells, 1, 8)).when((F.col("fmt") == 3) & (F.col("line_no") % 23 == 0), F.array_append(cells, F.lit("x"))).otherwise(cells)
    mark = F.element_at(F.array(*map(F.lit, [",", "\t", ";", "|", " "])), (F.col("fmt") + 1).cast("int"))
    quoted = F.transform(cells, lambda x: F.when(x.contains(mark) | x.contains('"'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
    line = F.when(F.col("fmt") == 4, F.concat_ws(" ", day, clock, "f", "m", "c")).otherwise(F.array_join(F.transform(quoted, lambda x: F.concat(x, mark)), ""))
    line = F.when(F.col("fmt") == 4, line).otherwise(F.substring(line, F.lit(1), F.length(line) - 1))
    logs = rows.select("file", "fmt", mark.alias("mark"), F.struct("line_no", line.alias("line")).alias("x")).groupBy("file", "fmt", "mark").agg(F.array_sort(F.collect_list("x")).alias("x"))
    names = [F.when(F.col("fmt") == 3, "Frequency kHz").otherwise(h) if h == "Freq" else F.lit(h) for h in HEADER]
    head = F.when(F.col("fmt") == 0, F.array(F.lit("Contest: spring test"), F.array_join(F.array(*names), ","))).when(
        F.col("fmt") == 1, F.array(F.lit("# exported"), F.array_join(F.array(*names), "\t"))).when(F.col("fmt") == 4, F.array().cast("array<string>")).otherwise(
        F.array(F.concat_ws(";", *names).alias("h")))
    head = F.when(F.col("fmt") == 3, F.array(F.concat_ws("|", *names))).otherwise(head)
    foot = F.when(F.col("fmt") == 2, F.array(F.lit("Total of all"))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(head, F.transform("x", lambda r: r["line"]), foot), "\n")
    return logs.select(F.col("file").alias("path"), text.alias("text"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guided.sessions(files(spark, sf_dir))


def import_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.size(F.filter("rows", lambda r: r["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return sessions(spark, sf_dir).select(
        F.col("path").alias("file"), "candidate", F.array_join(F.transform("columns", lambda c: c["field"]), " ").alias("fields"),
        *map(n, ("header", "qso", "comment", "summary", "metadata")), F.coalesce(F.try_element_at("metadata", F.lit("Contest")), F.lit("")).alias("contest"),
    )


def import_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = guided.contacts(sessions(spark, sf_dir))
    codes = F.array_join(F.array_sort(F.transform("issues", lambda i: i["code"])), ",")
    names = [*NAMES, "SUBMODE", "BAND"]
    return made.select(F.col("path").alias("file"), F.col("nth").cast("long").alias("nth"), *[F.coalesce(F.try_element_at("values", F.lit(x)), F.lit("")).alias(x.lower()) for x in names], codes.alias("codes"))


def import_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interpretation of each file that can be exported as ADIF, of the four of best score."""
    checkpoints(spark)
    texts = files(spark, sf_dir).withColumn("path", F.col("path").cast("string")).checkpoint()  # the search reads files three times
    heads = texts.selectExpr("path", "true AS utc_confirmed", *[f"CAST(NULL AS STRING) AS {c}" for c in ("contest", "station", "locator", "band", "scoring", "claimed_score", "dates")])
    found = recovery.recover(texts, "adif", heads, date_order="dmy")
    return found.select(F.col("path").cast("long").alias("file"), "selected", "errors", "reason", F.array_join(F.transform("tried", lambda t: t["candidate"]), ",").alias("tried"))


def import_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each value of each contact comes from and how far it can be trusted."""
    # inline_outer: a filter on whether there is any lineage would be inferred from inline, and planning it takes minutes.
    made = guided.contacts(sessions(spark, sf_dir), lineage=True).select(F.col("path").alias("file"), F.col("nth").cast("long").alias("nth"), F.inline_outer("lineage"))
    return made.where("field IS NOT NULL").select("file", "nth", "field", "column", F.coalesce(F.col("place"), F.lit(-1)).cast("long").alias("place"), "original", "value", F.array_join("changes", ",").alias("changes"), F.col("class").alias("trust"))


#: Comments are split in two words, the first goes to the locator, and an operator is added.
RECIPE = workspace.Recipe(
    base=tuple(h.lower() for h in HEADER),
    steps=(workspace.Split(8, " ", 2), workspace.Join((7, 8)), workspace.Add()),
    columns=(
        *[workspace.Mapping(h, field) for h, field in zip(HEADER[:7], NAMES[:7])],
        workspace.Mapping("Exchange", "SRX_STRING"), workspace.Mapping("Rest", "COMMENT"), workspace.Mapping("Operator", "OPERATOR", constant="q1op"),
    ),
)


def recipe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe on all files: it holds for those of its columns and leaves the others."""
    done = workspace.replay(sessions(spark, sf_dir), RECIPE)
    made = guided.contacts(done, lineage=True).join(done.select("path", "notice"), "path")
    value = lambda name: F.coalesce(F.try_element_at("values", F.lit(name)), F.lit("")).alias(name.lower())
    of = lambda part, alias: F.coalesce(F.get(F.filter("lineage", lambda x: x["field"] == "SRX_STRING"), F.lit(0))[part], F.lit("")).alias(alias)
    return made.select(F.col("path").alias("file"), F.col("nth").cast("long").alias("nth"), "notice", *map(value, ("SRX", "SRX_STRING", "COMMENT", "OPERATOR", "GRIDSQUARE")), of("original", "original"), of("class", "trust"))


_BASE = CTE + f", b AS (SELECT {synth.select(BASE)} FROM q)\n"
DETECT_SQL = _BASE + f"""SELECT file, ['delimiter-2','delimiter-0','delimiter-1','delimiter-3','whitespace'][fmt + 1] AS candidate,
  CASE WHEN fmt = 4 THEN 'QSO_DATE TIME_ON FREQ MODE CALL' WHEN fmt = 3 THEN '{" ".join(NAMES)} ' ELSE '{" ".join(NAMES)}' END AS fields, (fmt < 4)::BIGINT AS n_header, count(*) AS n_qso,
  (fmt = 1)::BIGINT AS n_comment, (fmt = 2)::BIGINT AS n_summary, (fmt = 0)::BIGINT AS n_metadata, CASE WHEN fmt = 0 THEN 'spring test' ELSE '' END AS contest
  FROM b GROUP BY file, fmt"""
_VALUES = _BASE + """, v AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 + [2, 2, 1, 1, 0][fmt + 1] AS nth,
    fmt = 2 AND substr(d, 7, 2) <= '12' AS unsure, CASE WHEN m = 'USB' THEN 'USB' ELSE '' END AS submode,
    CASE upper(m) WHEN 'PH' THEN 'SSB' WHEN 'USB' THEN 'SSB' WHEN 'DG' THEN 'DIGITAL' ELSE upper(m) END AS mode,
    CASE f WHEN '10.368G' THEN f WHEN '1840' THEN '1.84' WHEN '3550' THEN '3.55' WHEN '14050' THEN '14.05' WHEN '21050,5' THEN '21.0505' WHEN '144300' THEN '144.3'
      WHEN '7.05' THEN CASE fmt WHEN 3 THEN '0.00705' ELSE f END WHEN '28.4' THEN CASE fmt WHEN 3 THEN '0.0284' ELSE f END WHEN '999999' THEN CASE fmt WHEN 3 THEN '999.999' ELSE f END ELSE f END AS freq FROM b),
  """
CONTACTS_SQL = _VALUES + """w AS (SELECT file, nth, line_no, fmt, r, f, c, g, m, unsure, submode, mode, freq, t AS time_on, CASE WHEN unsure THEN substr(d, 7, 2) || '/' || substr(d, 5, 2) || '/' || substr(d, 1, 4) ELSE d END AS qso_date,
    CASE WHEN fmt = 4 THEN '' ELSE own END AS station_callsign, c AS call, CASE WHEN fmt = 4 THEN '' ELSE r END AS srx, CASE WHEN fmt = 4 THEN '' ELSE g END AS gridsquare,
    CASE WHEN fmt = 4 OR fmt = 2 AND line_no % 29 = 0 THEN '' ELSE note END AS comment,
    CASE freq WHEN '1.84' THEN '160M' WHEN '3.55' THEN '80M' WHEN '7.05' THEN '40M' WHEN '14.05' THEN '20M' WHEN '21.0505' THEN '15M' WHEN '28.4' THEN '10M' WHEN '144.3' THEN '2M' ELSE '' END AS band FROM v),
  x AS (SELECT *, row_number() OVER (PARTITION BY file, qso_date, time_on, freq, mode, submode, station_callsign, call, srx, gridsquare, comment ORDER BY nth) AS k FROM w)
  SELECT file, nth, qso_date, time_on, freq, mode, station_callsign, call, srx, gridsquare, comment, submode, band, array_to_string(list_sort(list_filter([
    CASE WHEN unsure THEN 'ambiguous-date' END, CASE WHEN f = '10.368G' THEN 'invalid-frequency' WHEN f = '999999' AND fmt <> 3 THEN 'ambiguous-frequency' END, CASE WHEN m = '' THEN 'missing-field' END,
    CASE WHEN c = 'NOCALL' THEN 'invalid-call' END, CASE WHEN srx <> '' AND NOT regexp_full_match(srx, '[0-9]+') THEN 'invalid-number' END, CASE WHEN gridsquare = 'ZZ99' THEN 'invalid-locator' END,
    CASE WHEN fmt = 2 AND line_no % 29 = 0 OR fmt = 3 AND line_no % 23 <> 0 THEN 'structure' END, CASE WHEN k > 1 THEN 'duplicate-row' END], lambda z: z IS NOT NULL)), ',') AS codes FROM x"""
_SOURCE = {
    "qso_date": "CASE fmt WHEN 1 THEN substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) WHEN 2 THEN substr(d, 7, 2) || '/' || substr(d, 5, 2) || '/' || substr(d, 1, 4) ELSE d END",
    "time_on": "CASE fmt WHEN 1 THEN substr(t, 1, 2) || ':' || substr(t, 3, 2) ELSE t END",
    "comment": "CASE WHEN fmt = 2 AND line_no % 29 = 0 THEN '' ELSE note END",
    "band": "CASE freq WHEN '1.84' THEN '160M' WHEN '3.55' THEN '80M' WHEN '7.05' THEN '40M' WHEN '14.05' THEN '20M' WHEN '21.0505' THEN '15M' WHEN '28.4' THEN '10M' WHEN '144.3' THEN '2M' ELSE '' END",
}


def _entry(field: str, place: int, original: str, value: str, changes: str = "''", error: str = "''", cond: str = "TRUE") -> str:
    """One value in SQL; places beyond the five of files without headings are empty there."""
    column = "CASE WHEN fmt = 4 THEN 'COLUMN_%d' WHEN fmt = 3 AND %d = 2 THEN 'Frequency kHz' ELSE '%s' END" % ((place if place < 5 else 4) + 1, place, HEADER[place])
    at = f"CASE WHEN fmt = 4 AND {place} = 5 THEN 4 ELSE {place} END"
    return f"""SELECT file, nth, fmt, '{field}' AS field, {column} AS "column", {at} AS place, {original} AS original, {value} AS value, {changes} AS changes, {error} AS error FROM s
    WHERE {original} <> '' AND ({cond})"""


_FREQ_ERROR = "CASE WHEN f = '10.368G' THEN 'unsupported' WHEN f = '999999' AND fmt <> 3 THEN 'ambiguous' ELSE '' END"
_ENTRIES = [
    _entry("QSO_DATE", 0, "qso_date", "CASE WHEN unsure THEN qso_date ELSE d END", "CASE WHEN fmt = 1 OR fmt = 2 AND NOT unsure THEN 'date' ELSE '' END", "CASE WHEN unsure THEN 'ambiguous' ELSE '' END"),
    _entry("TIME_ON", 1, "time_on", "t", "CASE WHEN fmt = 1 THEN 'time' ELSE '' END"),
    _entry("FREQ", 2, "f", "freq", "CASE WHEN f <> freq THEN 'frequency' ELSE '' END", _FREQ_ERROR),
    _entry("MODE", 3, "m", "mode", "CASE WHEN m = 'cw' THEN 'case' WHEN m IN ('PH', 'USB', 'DG') THEN 'mode:' || m ELSE '' END"),
    _entry("SUBMODE", 3, "m", "m", "'mode:USB,submode'", cond="m = 'USB'"),
    _entry("STATION_CALLSIGN", 4, "own", "own", cond="fmt <> 4"),
    _entry("CALL", 5, "c", "c", error="CASE WHEN c = 'NOCALL' THEN 'unsupported' ELSE '' END"),
    _entry("SRX", 6, "r", "r", error="CASE WHEN regexp_full_match(r, '[0-9]+') THEN '' ELSE 'unsupported' END", cond="fmt <> 4"),
    _entry("GRIDSQUARE", 7, "g", "g", error="CASE WHEN g = 'ZZ99' THEN 'unsupported' ELSE '' END", cond="fmt <> 4"),
    _entry("COMMENT", 8, "comment", "comment", cond="fmt <> 4"),
    f"SELECT file, nth, 0, 'BAND', 'derived', -1, freq, band, 'band', '' FROM s WHERE band <> '' AND {_FREQ_ERROR} = ''",
]
PROVENANCE_SQL = _VALUES + f"""s AS (SELECT file, nth, fmt, line_no, d, t, f, m, own, c, r, g, unsure, mode, freq, {", ".join(f"{v} AS {k}" for k, v in _SOURCE.items())} FROM v),
  e AS ({" UNION ALL ".join(_ENTRIES)})
  SELECT file, nth, field, "column", CAST(place AS BIGINT) AS place, original, value, changes, CASE WHEN error <> '' THEN error WHEN fmt = 4 OR field = 'FREQ' AND fmt <> 3 AND changes <> '' THEN 'suggested-repair'
    WHEN changes <> '' THEN 'lossless-normalization' ELSE 'preserved' END AS trust FROM e"""
RECIPE_SQL = _VALUES + f"""s AS (SELECT file, nth, fmt, r, g, fmt < 3 AS fits, {_SOURCE["comment"]} AS note FROM v), x AS (SELECT *, trim(g || ' ' || split_part(note, ' ', 1)) AS joined FROM s)
  SELECT file, nth, CASE WHEN fits THEN 'applied' ELSE 'columns-differ' END AS notice, CASE WHEN fmt = 4 THEN '' ELSE r END AS srx, CASE WHEN fits THEN joined ELSE '' END AS srx_string,
    CASE WHEN fits THEN split_part(note, ' ', 2) WHEN fmt = 3 THEN note ELSE '' END AS comment, CASE WHEN fits THEN 'Q1OP' ELSE '' END AS operator, CASE WHEN fmt = 3 THEN g ELSE '' END AS gridsquare,
    CASE WHEN fits AND joined <> '' THEN g || ' | ' || note ELSE '' END AS original, CASE WHEN fits AND joined <> '' THEN 'user-supplied' ELSE '' END AS trust FROM x"""
QUERIES = {"import_detect": import_detect, "import_contacts": import_contacts, "import_recovery": import_recovery, "import_provenance": import_provenance, "recipe_replay": recipe_replay}
ORACLES = {"import_detect": DETECT_SQL, "import_contacts": CONTACTS_SQL, "import_provenance": PROVENANCE_SQL, "recipe_replay": RECIPE_SQL}
