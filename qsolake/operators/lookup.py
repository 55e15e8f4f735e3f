"""Country and call-sign look-ups as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qsolake.functions.radio import PORTABLE_CALLS, base_call, lookup_candidates, normalize_callsign


def country_lookup(frame: DataFrame, call_col: str, countries: DataFrame, prefix: str) -> DataFrame:
    """frame with {prefix}country, _continent, _cq, _itu and _matched of the call, null where no prefix fits.

    Also {prefix}primary, the entity's primary prefix. countries: prefix, exact, country, continent, cq_zone, itu_zone
    and primary (taken for the prefix where there is no such column). Each distinct call is looked up once: its
    candidates' leading parts meet the table in an equi-join, and the best is the earliest candidate, an exact
    entry before a prefix, the longest prefix. Of entries that repeat a prefix the first (smallest) one counts."""
    if "primary" not in countries.columns:
        countries = countries.withColumn("primary", F.col("prefix"))
    table = countries.groupBy("prefix", "exact").agg(F.min(F.struct("country", "continent", "cq_zone", "itu_zone", "primary")).alias("entity"))
    named_usa = (F.col("entity.country") == "United States") | F.col("entity.country").startswith("USA ")
    usa = table.where(named_usa).agg(F.min("entity").alias("usa"))  # one row
    calls = frame.select(F.col(call_col).alias("_call")).distinct()
    tries = calls.select("_call", F.posexplode(lookup_candidates(F.col("_call"))).alias("nth", "candidate"))
    leading = tries.select(
        "_call", "nth", "candidate",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("candidate")), lambda n: F.substring(F.col("candidate"), F.lit(1), n))).alias("prefix"),
    )
    hits = leading.join(table, "prefix").where(~F.col("exact") | (F.col("prefix") == F.col("candidate")))
    best = hits.groupBy("_call").agg(
        F.max_by(F.struct("entity", "prefix"), F.struct(-F.col("nth"), F.col("exact"), F.length("prefix"))).alias("hit")
    )
    continent = F.when(F.col("hit.entity.continent") == "AN", "OC").otherwise(F.replace(F.col("hit.entity.continent"), F.lit("*"), F.lit("")))
    # calls of the pattern KG4xxx are ordinary US calls, not Guantanamo's
    us = base_call(F.col("_call")).rlike("^KG4[A-Z]{3}$") & (F.col("hit.prefix") == "KG4") & (F.col("hit.entity.country") == "Guantanamo Bay")
    best = best.join(F.broadcast(usa), us & F.col("usa").isNotNull(), "left")
    best = best.withColumn("hit", F.when(F.col("usa").isNotNull(), F.struct(F.col("usa").alias("entity"), F.lit("K").alias("prefix"))).otherwise(F.col("hit")))
    named = best.select(
        "_call", F.regexp_replace(F.col("hit.entity.country"), ":$", "").alias(f"{prefix}country"), continent.alias(f"{prefix}continent"),
        F.col("hit.entity.cq_zone").alias(f"{prefix}cq"), F.col("hit.entity.itu_zone").alias(f"{prefix}itu"),
        F.col("hit.entity.primary").alias(f"{prefix}primary"), F.col("hit.prefix").alias(f"{prefix}matched"),
    )
    return frame.join(named, F.col(call_col).eqNullSafe(F.col("_call")), "left").drop("_call")


def unknown_calls(frame: DataFrame, call_col: str, known: DataFrame) -> DataFrame:
    """Rows whose call is neither itself nor by its base in known (call)."""
    names = known.select(F.upper("call").alias("_known")).distinct()
    keyed = frame.withColumn("_full", normalize_callsign(F.col(call_col))).withColumn("_base", base_call(F.col(call_col), PORTABLE_CALLS))
    rest = keyed.join(names, F.col("_full") == F.col("_known"), "left_anti")
    return rest.join(names, F.col("_base") == F.col("_known"), "left_anti").drop("_full", "_base")


def prefix_suggestions(known: DataFrame, partial: str, limit: int = 8) -> DataFrame:
    """The first calls that begin with partial."""
    return known.select("call").distinct().where(F.col("call").startswith(partial.upper())).orderBy("call").limit(limit)


def one_letter_off(calls: DataFrame, known: DataFrame, limit: int = 5) -> DataFrame:
    """call, suggestion: known calls of the same length that differ in exactly one place, the first few of each.

    Both sides are keyed by each call with one place masked, so that only calls which agree elsewhere meet."""

    def masked(df: DataFrame, name: str) -> DataFrame:
        places = F.sequence(F.lit(1), F.length(name))
        mask = lambda i: F.concat(F.substring(F.col(name), F.lit(1), i - 1), F.lit("?"), F.substring(F.col(name), i + 1, F.length(name)))
        return df.where(F.length(name) > 0).select(name, F.explode(F.transform(places, mask)).alias("_masked"))

    a = masked(calls.select(F.col("call")).distinct(), "call")
    b = masked(known.select(F.col("call").alias("suggestion")).distinct(), "suggestion")
    pairs = a.join(b, "_masked").where("call <> suggestion").select("call", "suggestion").distinct()
    few = F.slice(F.array_sort(F.collect_set("suggestion")), 1, limit)
    return pairs.groupBy("call").agg(few.alias("s")).select("call", F.explode("s").alias("suggestion"))
