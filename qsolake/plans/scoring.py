"""Contest scoring: declarative rules over a frame of contacts, and the totals that follow from them.

A rule (qsolake.plans.rules) is a set of Column builders. The engine flags duplicates in log order, evaluates points,
bonus and multiplier once a row, and brings the rows down to one for each log, band and multiplier; every total is
made from those. Rules that remember what came before in the log are windows over the log in its order.

Contacts have doc_id, line_no, call, my_call, freq, mode, qso_date, time_on, sent and rcvd (exchanges), my_grid, grid,
and what operators.lookup adds for the worked call (w_) and the station (s_). Optional: stx_string, srx_string, srx,
cqz, qth (cells of their own for parts of the exchange) and raw (the log line)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.functions.radio import band_from_frequency, let, trimmed
from qsolake.operators.contacts import flag_duplicates
from qsolake.plans.contest_sets import LEGACY_BANDS

Builder = Callable[[], Column]
OPTIONAL = ["stx_string", "srx_string", "srx", "cqz", "qth"]
CONTINENTS = ["AF", "AS", "EU", "NA", "OC", "SA"]


def no_multiplier() -> Column:
    return F.lit("QSO")


@dataclass(frozen=True)
class Rule:
    """points, bonus, multiplier: expressions over a contact. duplicates: key columns, or None to count all.

    band: how the band is told, see bands(). tokens: the multiplier holds several values, separated by ';'.
    scope: how often a multiplier counts, once a log ("global"), once a band, or by the column that a builder gives.
    with_points: only of contacts with points. weight: what a multiplier counts. fixed, minimum: of their number.
    factors: a factor for each band, in place of multipliers or beside them. first_band: a band's own number has only
    the multipliers that are new there. total: see totals(). prepare: adds columns that the builders need."""

    id: str
    points: Builder
    multiplier: Builder = no_multiplier
    bonus: Builder = lambda: F.lit(0)
    contests: tuple[str, ...] = ()
    duplicates: tuple[str, ...] | None = None
    band: str = "standard"
    tokens: bool = False
    scope: str | Builder = "global"
    with_points: bool = False
    weight: Builder = lambda: F.lit(1)
    fixed: int | None = None
    minimum: int = 0
    factors: dict[str, int] = field(default_factory=dict)
    first_band: bool = False
    total: str = "product"
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows


def per_band(table: dict[str, int], otherwise: int = 0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in table.items() for v in p]), F.col("band")), F.lit(otherwise))


def bands(kind: str) -> Column:
    """The band of a contact: standard, legacy (with the tokens of VHF logs), or one range of kHz for all."""
    standard = F.coalesce(F.nullif(band_from_frequency(F.col("freq")), F.lit("")), F.lit("OTHER"))
    if kind == "standard":
        return standard
    if kind == "legacy":
        token = F.try_element_at(F.create_map(*[F.lit(v) for p in LEGACY_BANDS.items() for v in p]), F.upper(trimmed(F.coalesce("freq", F.lit("")))))
        return F.coalesce(token, standard)
    name, low, high = kind.split(":")
    return F.when(khz().between(float(low), float(high)), name).otherwise("OTHER")


def khz() -> Column:
    """The number that the frequency starts with, taken as kHz."""
    return F.regexp_extract(F.coalesce("freq", F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def score_rows(contacts: DataFrame, rule: Rule) -> DataFrame:
    """contacts with band, duplicate, points, bonus_points and multiplier; crossed-out contacts left out."""
    if "raw" in contacts.columns:
        contacts = contacts.where(~F.coalesce(F.col("raw"), F.lit("")).startswith("X-QSO:"))
    missing = [c for c in OPTIONAL if c not in contacts.columns]
    rows = contacts.withColumns({c: F.lit("") for c in missing}).withColumns(
        {"band": bands(rule.band), "call_key": F.upper("call"), "mode_raw": F.col("mode"), "mode_key": F.upper("mode")}
    )
    rows = rule.prepare(rows)
    if rule.duplicates is None:
        rows = rows.withColumn("duplicate", F.lit(False))
    else:
        rows = flag_duplicates(rows, [F.col(c) for c in rule.duplicates])
    keep = lambda v, nothing: F.when(F.col("duplicate"), F.lit(nothing)).otherwise(v)
    values = {
        "points": keep(F.coalesce(rule.points().cast("long"), F.lit(0)), 0), "bonus_points": keep(rule.bonus().cast("long"), 0),
        "multiplier": keep(F.coalesce(rule.multiplier(), F.lit("")), ""),
    }
    added = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumns(values).drop("call_key", "mode_raw", *missing, *added).withColumnRenamed("mode_key", "mode_upper")


def multiplier_tokens(rule: Rule) -> Column:
    """The multipliers of a row that count, without repeats."""
    counts = ~F.col("duplicate") & (F.col("points") > 0 if rule.with_points else F.lit(True))
    value = F.when(counts, F.col("multiplier")).otherwise("")
    parts = F.transform(F.split(value, ";"), trimmed) if rule.tokens else F.array(value)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def by_multiplier(rows: DataFrame, rule: Rule) -> DataFrame:
    """One row for each log, band and multiplier (null for contacts without), with the sums of its contacts.

    A contact of several multipliers is summed at its first. news: the multiplier counts here, as it does nowhere
    before in its log or band."""
    known = (F.col("band") != "OTHER") & F.col("w_country").isNotNull()
    place = sum((F.when(F.col("w_continent") == c, 1 << i).otherwise(0) for i, c in enumerate(CONTINENTS)), F.lit(0))
    each = rows.select(
        "doc_id", "band", "line_no", "duplicate", "points", "bonus_points", known.alias("known"), place.alias("place"),
        F.posexplode_outer(multiplier_tokens(rule)).alias("nth", "token"),
    ).withColumn("head", F.coalesce(F.col("nth") == 0, F.lit(True)))
    scope = {"global": F.lit(""), "band": F.col("band")}.get(rule.scope) if isinstance(rule.scope, str) else rule.scope()
    scored = F.col("points") > 0
    small = each.withColumn("scope", scope).groupBy("doc_id", "band", "scope", "token").agg(
        F.count_if(F.col("head") & ~F.col("duplicate")).alias("qsos"), F.count_if(F.col("head") & F.col("duplicate")).alias("duplicates"),
        F.sum(F.when(F.col("head"), F.col("points")).otherwise(0)).alias("points"),
        F.sum(F.when(F.col("head"), F.col("bonus_points")).otherwise(0)).alias("bonus"),
        F.count_if(F.col("head") & F.col("known")).alias("accepted"), F.bool_or(scored & ~F.col("duplicate")).alias("active"),
        F.bit_or(F.when(scored, F.col("place")).otherwise(0)).alias("places"), F.min("line_no").alias("first"),
    )
    order = Window.partitionBy("doc_id", "scope", "token").orderBy("first", "band")
    return small.withColumn("news", F.col("token").isNotNull() & (F.row_number().over(order) == 1))


def by_band_parts(rows: DataFrame, rule: Rule) -> DataFrame:
    """One row for each log and band: sums, own (multipliers in the band), new (those that count here)."""
    continent = F.col("token").startswith("CONT:") & F.lit(rule.total == "continents_apart")
    weight = rule.weight()
    return by_multiplier(rows, rule).groupBy("doc_id", "band").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("qsos", "duplicates", "points", "bonus", "accepted")],
        F.bool_or("active").alias("active"), F.bit_or("places").alias("places"),
        F.sum(F.when(F.col("token").isNotNull() & ~continent, weight).otherwise(0)).cast("long").alias("own"),
        F.sum(F.when(F.col("news") & ~continent, weight).otherwise(0)).cast("long").alias("new"),
        F.sum(F.when(F.col("news") & continent, 1).otherwise(0)).cast("long").alias("continents"),
    )


def by_band(rows: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, band, qsos, points, bonus, multipliers."""
    if rule.factors and rule.total == "factors":
        n = per_band(rule.factors)
    else:
        n = F.col("new") if rule.first_band else F.col("own")
    return by_band_parts(rows, rule).select("doc_id", "band", "qsos", "points", "bonus", n.cast("long").alias("multipliers"))


def totals(rows: DataFrame, rule: Rule, qtcs: DataFrame | None = None) -> DataFrame:
    """doc_id, qsos, duplicates, points, multipliers, total: one row a log.

    total: product of points and multipliers; band_product, band_qso_product, band_factor_product and
    band_product_bonus sum up products of the bands; at_least_one does so with one multiplier at least; jolly with a
    hundred a special station; factors with the band's factor; twice_and_bonus and by_500 add to the points;
    continents, continents_apart and accepted have a third factor. qtcs (doc_id, n) count as points for with_qtcs."""
    p, n, own = F.col("points"), F.col("multipliers"), F.col("own")
    product = {
        "band_product": p * own, "band_qso_product": F.col("qsos") * p * own, "band_product_bonus": p * own + F.col("bonus"),
        "band_factor_product": p * own * per_band(rule.factors) if rule.factors else F.lit(0),
        "at_least_one": F.when(F.col("active"), p * F.greatest(own, F.lit(1))).otherwise(0),
        "jolly": p * F.when(own > 0, own * 100).otherwise(1), "factors": p * per_band(rule.factors) if rule.factors else F.lit(0),
    }.get(rule.total)
    count = F.col("new")
    if rule.total == "at_least_one":
        count = F.when(F.col("active"), F.greatest(own, F.lit(1))).otherwise(0)
    elif rule.total == "factors":
        count = F.when(F.col("active"), per_band(rule.factors)).otherwise(0)
    elif rule.total == "continents_apart":
        count = F.col("new") + F.col("continents")
    parts = by_band_parts(rows, rule)
    out = parts.groupBy("doc_id").agg(
        *[F.sum(c).alias(c) for c in ("qsos", "duplicates", "points", "bonus", "accepted", "new", "continents")],
        F.sum(count.cast("long")).alias("counted"), F.sum(F.coalesce(product, F.lit(0)).cast("long") if product is not None else F.lit(0)).alias("products"),
        F.bit_count(F.bit_or("places")).alias("places"),
    )
    count = F.lit(rule.fixed) if rule.fixed is not None else F.greatest("counted", F.lit(rule.minimum))
    out = out.withColumn("multipliers", count.cast("long"))
    if qtcs is not None:
        out = out.join(qtcs.select("doc_id", F.col("n").alias("qtcs")), "doc_id", "left")
    sent = F.coalesce("qtcs", F.lit(0)) if qtcs is not None else F.lit(0)
    total = {
        "product": p * n, "twice_and_bonus": p + n * 2 + F.col("bonus"), "by_500": p + n * 500, "log_bonus": p * n + F.col("bonus"),
        "continents": p * n * F.greatest("places", F.lit(1)), "continents_apart": p * F.col("new") * F.col("continents"),
        "accepted": F.col("accepted") * p * n, "with_qtcs": (p + sent) * n,
    }.get(rule.total, F.col("products"))
    return out.select("doc_id", "qsos", "duplicates", "points", "multipliers", total.cast("long").alias("total"))


def formula(rule: Rule) -> Column:
    """How a row of totals() came about, in words."""
    number = lambda c: F.format_number(c, 0)
    said = {
        "band_product": "Sum of points x multipliers of each band", "band_qso_product": "Sum of contacts x points x multipliers of each band",
        "band_product_bonus": "Sum of points x multipliers of each band, and distance bonus", "factors": "Sum of points x band factor",
        "band_factor_product": "Sum of points x multipliers x band factor", "at_least_one": "Sum of points x multipliers (one at least) of each band",
        "jolly": "Sum of points x special stations x 100 of each band", "twice_and_bonus": "Points + 2 x multipliers + bonus",
        "by_500": "Points + 500 x multipliers", "log_bonus": "Points + bonus of the station", "continents": "Points x multipliers x continents",
        "continents_apart": "Points x multipliers x continents", "accepted": "Contacts x points x multipliers", "with_qtcs": "(Points + QTCs) x multipliers",
    }.get(rule.total)
    if said:
        return F.concat(F.lit(said + " ("), number("points"), F.lit(" points, "), number("multipliers"), F.lit(" multipliers)"))
    return F.concat(number("points"), F.lit(" points x "), number("multipliers"), F.lit(" multipliers"))


def grouped(rows: DataFrame, *keys: Column) -> DataFrame:
    """Contacts and points of each group of a log."""
    return rows.groupBy("doc_id", *keys).agg(F.count_if(~F.col("duplicate")).alias("qsos"), F.sum("points").cast("long").alias("points"))


def by_mode(rows: DataFrame) -> DataFrame:
    return grouped(rows, F.coalesce(F.nullif(F.col("mode_upper"), F.lit("")), F.lit("Unknown")).alias("mode"))


def by_country(rows: DataFrame) -> DataFrame:
    """With place: the country's in its log, most contacts first, then by name."""
    out = grouped(rows, F.coalesce("w_country", F.lit("Unknown")).alias("country"), F.coalesce("w_continent", F.lit("")).alias("continent"))
    order = Window.partitionBy("doc_id").orderBy(F.col("qsos").desc(), "country", "continent")
    return out.withColumn("place", F.row_number().over(order))


def by_hour(rows: DataFrame) -> DataFrame:
    return grouped(rows, F.concat("qso_date", F.lit(" "), F.substring("time_on", 1, 2), F.lit(":00")).alias("hour"))


def with_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows with points and multiplier replaced where overrides (doc_id, line_no, points, multiplier) give one."""
    o = overrides.select("doc_id", "line_no", F.col("points").alias("_p"), F.col("multiplier").alias("_m"))
    return (
        rows.join(o, ["doc_id", "line_no"], "left").withColumn("points", F.coalesce("_p", "points")).withColumn("multiplier", F.coalesce("_m", "multiplier")).drop("_p", "_m")
    )


def exchange_part(cell: str, exchange: str, at: int = -1) -> Column:
    """A cell of its own, upper-cased, else the last (or at-th) word of the exchange as it is."""
    own = F.upper(trimmed(F.coalesce(F.col(cell), F.lit(""))))
    words = let(trimmed(F.coalesce(F.col(exchange), F.lit(""))), lambda x: F.try_element_at(F.split(x, r"\s+"), F.lit(at)))
    return F.coalesce(F.nullif(own, F.lit("")), words, F.lit(""))
