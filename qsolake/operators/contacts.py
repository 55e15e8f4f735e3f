"""Duplicates, merging, filtering, splitting and summaries of contact logs (one row a contact)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.functions.radio import band_from_frequency, trimmed
from qsolake.operators.components import components


def key_part(name: str) -> Column:
    return F.upper(trimmed(F.coalesce(F.col(name), F.lit(""))))


def contact_band(frame: DataFrame) -> Column:
    """The band column where there is one that is filled, else the band of the frequency."""
    own = F.nullif(key_part("band"), F.lit("")) if "band" in frame.columns else F.lit(None).cast("string")
    return F.coalesce(own, band_from_frequency(F.col("freq")))


def flag_duplicates(frame: DataFrame, keys: list[Column], *, order: str = "line_no", doc: str = "doc_id") -> DataFrame:
    """frame with duplicate: true from the second row of a key on, in the order of the log."""
    nth = F.row_number().over(Window.partitionBy(doc, *keys).orderBy(order))
    return frame.withColumn("duplicate", nth > 1)


# The fields by which confirmations are matched beside call, time, band and mode, and those of an activity.
MATCHED = ("PROP_MODE", "SAT_NAME", "STATION_CALLSIGN", "MY_DXCC", "MY_STATE", "MY_CNTY", "MY_GRIDSQUARE")
ACTIVITY = ("SIG", "SIG_INFO", "MY_SIG", "MY_SIG_INFO")


def duplicate_pairs(frame: DataFrame, tolerance: int = 5, activity: list[str] | None = None, identity: list[str] | None = None) -> DataFrame:
    """first, second, kind, delta: contacts of one call and date that may be the same.

    frame: id, call, qso_date, epoch_min (null if unknown), band, mode. Pairs further apart than the tolerance are
    none, so each contact is put into the time slots it can reach and only contacts of one slot meet. With the columns
    of identity an exact pair that agrees in all of them is lotw."""
    slot = max(tolerance, 0) + 1
    base = frame.where(key_part("call") != "").select(
        "id", key_part("call").alias("c"), key_part("qso_date").alias("d"), F.col("epoch_min").alias("t"), "band", key_part("mode").alias("m"),
        (F.concat_ws("|", *[key_part(x) for x in activity]) if activity else F.lit("")).alias("act"),
        F.array(*[key_part(x) for x in identity or ()]).cast("array<string>").alias("own"),
    )
    here = base.where(F.col("t").isNotNull()).withColumn("slot", F.floor(F.col("t") / slot))
    left = here.select(*[F.col(c).alias(f"a_{c}") for c in here.columns if c not in ("c", "d", "slot")], "c", "d", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    right = here.select(*[F.col(c).alias(f"b_{c}") for c in here.columns if c not in ("c", "d", "slot")], "c", "d", "slot")
    delta = F.abs(F.col("a_t") - F.col("b_t"))
    alike = (F.col("a_band") == F.col("b_band")) & (F.col("a_m") == F.col("b_m"))
    matched = (F.col("a_own") == F.col("b_own")) if identity else F.lit(False)
    kind = (
        F.when((delta == 0) & alike & matched, "lotw").when((delta == 0) & alike, "exact").when((delta <= tolerance) & alike, "near").when(delta == 0, "possible")
    )
    pairs = left.join(right, ["c", "d", "slot"]).where(F.col("a_id") < F.col("b_id")).withColumn("kind", kind).where("kind is not null")
    kinds = F.when(F.col("a_act") != F.col("b_act"), "activity-aware").otherwise(F.col("kind"))
    return pairs.select(F.col("a_id").alias("first"), F.col("b_id").alias("second"), kinds.alias("kind"), delta.alias("delta"))


def duplicate_candidates(frame: DataFrame, tolerance: int = 5) -> DataFrame:
    """first, second, kind, delta, reason, differing (sorted names of fields), first_call, second_call.

    frame: id and fields (a map of a record's fields; a missing one counts as empty). Bands come from the frequency where
    none is given, a submode goes before its mode, a record without a date of eight digits or a time of four is in no pair.
    The maps join the pairs by id once these are found, so that they aren't copied into every slot."""
    of = lambda n: F.upper(trimmed(F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))))
    filled = lambda n: F.nullif(of(n), F.lit(""))
    date, time = of("QSO_DATE"), F.substring(of("TIME_ON"), 1, 4)
    # Pairs share a date, so minutes of the day tell how far apart they are.
    minute = F.when(date.rlike(r"^\d{8}$") & time.rlike(r"^\d{4}$"), F.substring(time, 1, 2).try_cast("int") * 60 + F.substring(time, 3, 2).try_cast("int"))
    slim = frame.select(
        "id", of("CALL").alias("call"), date.alias("qso_date"), minute.alias("epoch_min"), F.coalesce(filled("BAND"), F.upper(band_from_frequency(of("FREQ")))).alias("band"),
        F.coalesce(filled("SUBMODE"), of("MODE")).alias("mode"), *[of(n).alias(n) for n in (*MATCHED, *ACTIVITY)],
    )
    pairs = duplicate_pairs(slim, tolerance, list(ACTIVITY), list(MATCHED))
    side = lambda n: frame.select(F.col("id").alias(n), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias(f"_{n}"), of("CALL").alias(f"{n}_call"))
    met = pairs.join(side("first"), "first").join(side("second"), "second")
    value = lambda n, k: F.coalesce(F.try_element_at(f"_{n}", k), F.lit(""))
    names = F.array_union(F.map_keys("_first"), F.map_keys("_second"))
    differing = F.sort_array(F.filter(names, lambda k: value("first", k) != value("second", k)))
    reason = (
        F.when(F.col("kind") == "near", F.concat(F.lit("Same call, band, and mode within "), F.col("delta").cast("string"), F.lit(" minutes")))
        .when(F.col("kind") == "activity-aware", "Similar QSO with different activity references; keep both unless confirmed")
        .when(F.col("kind") == "lotw", "Matches documented LoTW identity fields").when(F.col("kind") == "exact", "Same call, date/time, band, and mode")
        .otherwise("Same call and time with differing band or mode")
    )
    return met.select("first", "second", "kind", "delta", reason.alias("reason"), differing.alias("differing"), "first_call", "second_call")


def merge(frames: list[DataFrame], keys: list[str], strategy: str = "keep-first") -> DataFrame:
    """One log of several, in their order. keep-last puts the last of a key where its first was.

    Each frame has a column ord; the result has position (order of the merged log)."""
    tagged = [f.withColumn("_nth", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    place = F.struct("_nth", "ord")
    if strategy == "keep-all":
        return rows.withColumn("position", place).drop("_nth")
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.withColumns({n: key_part(k) for n, k in zip(names, keys)})
    ends = keyed.groupBy(*names).agg(F.min(place).alias("position"), (F.min if strategy == "keep-first" else F.max)(place).alias("_chosen"))
    # Combined before the shuffle and joined back on the chosen row's own place, so no key's rows gather in one task.
    chosen = ends.select("position", F.col("_chosen._nth").alias("_nth"), F.col("_chosen.ord").alias("ord"))
    return rows.join(chosen, ["_nth", "ord"]).drop("_nth")


def filter_contacts(
    frame: DataFrame, *, date_from: str = "", date_to: str = "", bands: list[str] = (), modes: list[str] = (),
    callsign: str = "", continents: list[str] = (), cq_zones: list[str] = (),
) -> DataFrame:
    """Contacts that pass every given condition; an empty condition passes all. A missing date fails date_from only."""
    date = F.replace(F.coalesce(F.col("qso_date"), F.lit("")), F.lit("-"), F.lit(""))
    tests = [F.lit(True)]
    if date_from:
        tests.append(date >= date_from.replace("-", ""))
    if date_to:
        tests.append(date <= date_to.replace("-", ""))
    for column, allowed in ((contact_band(frame), bands), (F.col("mode"), modes)):
        if allowed:
            tests.append(F.upper(column).isin([a.upper() for a in allowed]))
    if callsign:
        tests.append(key_part("call") == callsign.strip().upper())
    if continents:
        tests.append(F.upper("w_continent").isin([c.upper() for c in continents]))
    if cq_zones:
        tests.append(F.col("w_cq").cast("string").isin(list(cq_zones)))
    return frame.where(reduce(lambda a, b: a & b, tests))


def split_key(criterion: str) -> Column:
    """The name of the part that a contact goes to: by station, date or activity."""
    if criterion == "station":
        return F.concat_ws("|", key_part("my_call"), key_part("my_grid"))
    if criterion == "date":
        return F.coalesce(F.nullif(key_part("qso_date"), F.lit("")), F.lit("unassigned"))
    return F.coalesce(F.nullif(key_part("activity"), F.lit("")), F.lit("unassigned"))


def activity_buckets(frame: DataFrame, minutes: float, period: tuple[int, int] | None = None) -> DataFrame:
    """bucket (start, in minutes), qsos (no duplicates), points; empty buckets are left out."""
    size = int(min(max(round(minutes), 1), 1440))
    if period:
        frame = frame.where(F.col("epoch_min").between(*period))
    bucket = (F.floor(F.col("epoch_min") / size) * size).cast("long")
    return frame.groupBy("doc_id", bucket.alias("bucket")).agg(
        F.count_if(~F.col("duplicate")).alias("qsos"), F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("points")
    )


def log_summary(frame: DataFrame) -> DataFrame:
    """For each log: contacts, distinct calls, first and last time, days."""
    return frame.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("contacts"), F.count_distinct(key_part("call")).alias("calls"),
        F.min("epoch_min").alias("first_min"), F.max("epoch_min").alias("last_min"), F.count_distinct("qso_date").alias("days"),
    )


def farthest(frame: DataFrame) -> DataFrame:
    """For each log the contact with the greatest distance (km), the first of equals."""
    return frame.where("km is not null").groupBy("doc_id").agg(
        F.max_by(F.struct("line_no", "call", "km"), F.struct("km", -F.col("line_no"))).alias("odx")
    ).select("doc_id", "odx.*")


def common_value(frame: DataFrame, column: str) -> DataFrame:
    """For each log the column's value if all its rows agree, else null."""
    v = F.coalesce(F.col(column), F.lit(""))
    return frame.groupBy("doc_id").agg(F.when(F.min(v) == F.max(v), F.min(v)).alias(column))


def sorted_slots(frame: DataFrame, doc: str = "doc_id") -> DataFrame:
    """frame with slot: the line that each contact goes to when its log is sorted by date, time and line.

    Only the lines that hold contacts change places; other lines of a log stay where they are."""
    lines = Window.partitionBy(doc).orderBy("line_no")
    times = Window.partitionBy(doc).orderBy(F.coalesce("qso_date", F.lit("")), F.coalesce("time_on", F.lit("")), "line_no")
    places = frame.select(doc, F.col("line_no").alias("slot")).withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy("slot")))
    return frame.withColumn("_n", F.row_number().over(times)).join(places, [doc, "_n"]).drop("_n")


def resolve_duplicates(frame: DataFrame, pairs: DataFrame, action: str) -> DataFrame:
    """frame (id) after the pairs (first, second) of duplicate_pairs() are resolved.

    keep-first drops each pair's second row, keep-last its first, keep-both none. merge keeps the smallest id of all rows
    that pairs connect, also by way of others, and fills its empty cells from them, from the smallest id that has one."""
    if action == "keep-both":
        return frame
    if action not in ("keep-first", "keep-last", "merge"):
        raise ValueError(f"no action {action}")
    if action != "merge":
        gone = pairs.select(F.col("first" if action == "keep-last" else "second").alias("id")).distinct()
        return frame.join(gone, "id", "left_anti")
    cells = [c for c in frame.columns if c != "id"]
    grouped = frame.join(components(pairs).select("id", F.col("component").alias("_to")), "id", "left")
    others = grouped.where(F.col("_to") != F.col("id"))
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.struct("id", F.col(c).alias("v")))
    found = others.groupBy("_to").agg(*[F.min(filled(c)).alias(f"_{c}") for c in cells])
    kept = grouped.where(F.col("_to").isNull() | (F.col("_to") == F.col("id"))).drop("_to").join(found, F.col("id") == F.col("_to"), "left")
    merged = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.coalesce(F.col(f"_{c}")["v"], F.col(c))).otherwise(F.col(c)).alias(c) for c in cells]
    return kept.select("id", *merged).select(frame.columns)
