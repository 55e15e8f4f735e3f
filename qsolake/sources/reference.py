"""Reference data: country files, lists of known calls, and the shorthand of fast entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.functions.radio import PORTABLE_CALLS, base_call, normalize_callsign, plausible_callsign, trimmed
from qsolake.sources.logs import LINE_END


def _number(x: Column) -> Column:
    return F.coalesce(trimmed(x).try_cast("double"), F.lit(0.0))


def _prefix(x: Column) -> Column:
    return F.regexp_replace(F.upper(trimmed(x)), "[^A-Z0-9/]", "")


def country_entries(files: DataFrame, text_col: str = "text") -> DataFrame:
    """prefix, exact, country, continent, cq_zone, itu_zone, primary, latitude, longitude, utc_offset of country files.

    An entity is eight fields that end with a colon, then aliases up to a semicolon. An alias may begin with = (an
    exact call) and override zones, continent, coordinates or offset in brackets. Longitude and offset change sign, as
    the file counts west as positive. Lines of comments are left out; a web page or empty text gives nothing. Where a
    prefix is repeated the first entry counts: nth orders them."""
    chunks = F.posexplode(F.split(F.regexp_replace(F.col(text_col), "\r", ""), ";")).alias("chunk_no", "chunk")
    rows = files.where(~F.col(text_col).rlike("(?i)<html|<body")).select(chunks)
    kept = F.filter(F.transform(F.split("chunk", "\n"), trimmed), lambda x: (x != "") & ~x.startswith("#"))
    rows = rows.select("chunk_no", F.split(F.array_join(kept, " "), ":").alias("f")).where(F.size("f") >= 9)
    at = lambda i: F.col("f")[i]
    aliases = F.concat(F.array(at(7)), F.split(F.array_join(F.slice("f", 9, F.size("f")), ":"), r"[\s,]+"))
    rows = rows.select("chunk_no", "f", F.posexplode(aliases).alias("nth", "token"))
    token = F.regexp_replace(trimmed(F.col("token")), "[;,]+$", "")
    bare = F.regexp_replace(F.regexp_replace(token, "^=", ""), r"\([^)]*\)|\[[^\]]*\]|<[^>]*>|\{[^}]*\}|~[^~]*~", "")
    override = lambda pattern, k=1: F.nullif(F.regexp_extract(token, pattern, k), F.lit(""))
    cq = F.coalesce(override(r"\((\d+)\)").try_cast("int"), F.nullif(_number(at(1)).cast("int"), F.lit(0)))
    coordinates = r"<(-?[\d.]+)/(-?[\d.]+)>"
    out = rows.select(
        "chunk_no", "nth", _prefix(bare).alias("prefix"), token.startswith("=").alias("exact"), trimmed(at(0)).alias("country"),
        F.upper(F.coalesce(override(r"(?i)\{([A-Z]{2})\}"), trimmed(at(3)))).alias("continent"), cq.alias("cq_zone"),
        F.coalesce(override(r"\[(\d+)\]").try_cast("int"), _number(at(2)).cast("int")).alias("itu_zone"), _prefix(at(7)).alias("primary"),
        F.coalesce(override(coordinates).try_cast("double"), _number(at(4))).alias("latitude"),
        (-F.coalesce(override(coordinates, 2).try_cast("double"), _number(at(5)))).alias("longitude"),
        (-F.coalesce(override(r"~(-?[\d.]+)~").try_cast("double"), _number(at(6)))).alias("utc_offset"),
    ).where("prefix <> ''")
    first = Window.partitionBy("prefix", "exact").orderBy("chunk_no", "nth")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "chunk_no", "nth")


def known_calls(files: DataFrame, text_col: str = "text") -> DataFrame:
    """call: the plausible calls of texts that list them, with their base calls, each once."""
    tokens = files.select(F.explode(F.split(F.col(text_col), r"[\x00\s,;]+")).alias("token"))
    return _plausible(tokens.select(normalize_callsign(F.col("token")).alias("call")))


def known_calls_binary(files: DataFrame, content_col: str = "content") -> DataFrame:
    """call: the plausible calls of binary lists. A list begins with the little-endian place of its first call, where
    that lies within it, and holds calls between zero bytes; one with few of those is scanned for runs of call
    characters. A text (under 1 % of zero bytes and no such place) is read as known_calls() does."""
    raw = F.col(content_col)
    size = F.octet_length(raw)
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("long")
    place = byte(1) + byte(2) * 256 + byte(3) * 65_536 + byte(4) * 16_777_216
    has_place = F.coalesce((size >= 4) & (place >= 4) & (place < size), F.lit(False))
    text = F.decode(F.when(has_place, F.substring(raw, (place + 1).cast("int"), size)).otherwise(raw), "ISO-8859-1")
    nulls = size - F.length(F.translate(F.decode(raw, "ISO-8859-1"), "\x00", ""))
    parts = F.split(text, "\x00")
    exact = F.filter(parts, lambda p: p.rlike("^[A-Z0-9][A-Z0-9/]{2,14}$") & p.rlike("[A-Z]") & p.rlike("[0-9]"))
    scanned = F.filter(F.regexp_extract_all(text, F.lit("([A-Z0-9/]{3,15})"), 1), lambda p: p.rlike("[A-Z]") & p.rlike("[0-9]"))
    plain = F.split(F.decode(raw, "UTF-8"), r"[\x00\s,;]+")
    found = F.when((nulls < size * 0.01) & ~has_place, plain).when(F.size(exact) < 1000, F.concat(exact, scanned)).otherwise(exact)
    tokens = files.select(F.explode(found).alias("token"))
    return _plausible(tokens.select(normalize_callsign(F.col("token")).alias("call")))


def _plausible(calls: DataFrame) -> DataFrame:
    good = calls.where(plausible_callsign(F.col("call")))
    bases = good.select(base_call(F.col("call"), PORTABLE_CALLS).alias("call")).where(plausible_callsign(F.col("call")))
    return good.union(bases).distinct()


# --- fast entry --------------------------------------------------------------------------------------------------

FAST_KEYS = ["DATE", "TIME", "CALL", "BAND", "FREQ", "MODE", "RST_S", "RST_R", "STX", "SRX", "PROFILE", "ACT"]
CARRIED = ["DATE", "TIME", "BAND", "FREQ", "MODE", "PROFILE", "ACT"]
CLOCK = "^([01][0-9]|2[0-3])[0-5][0-9]([0-5][0-9])?$"


def fast_entries(notes: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of notes, line_no, values (a map), inherited and errors of each line of fast-entry shorthand.

    A line has KEY=VALUE tokens, and bare ones for a time and a call; NOTE= takes the rest. What a line leaves out is
    carried on from the lines before it. A time that falls back from the late evening to the small hours begins the
    next day. A serial number that is left out is one more than the last."""
    keys = [c for c in notes.columns if c != text_col]
    rows = notes.select(*keys, F.posexplode(F.split(F.col(text_col), LINE_END)).alias("line_no", "source"))
    rows = rows.withColumn("line_no", F.col("line_no") + 1).withColumn("_line", trimmed(F.col("source")))
    rows = rows.where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    note = r'(?i)(?:^|\s)NOTE=("[^"]*"|.*)$'
    rows = rows.withColumn("_note", F.regexp_replace(F.regexp_extract("_line", note, 1), '^"|"$', ""))
    tokens = F.split(trimmed(F.regexp_replace("_line", note, "")), r"\s+")
    pair = "(?i)^([A-Z_]+)=(.*)$"
    rows = rows.withColumn("_tokens", F.filter(tokens, lambda t: t != ""))
    pairs = F.transform(F.filter("_tokens", lambda t: t.rlike(pair)), lambda t: F.struct(F.upper(F.regexp_extract(t, pair, 1)).alias("k"), F.regexp_extract(t, pair, 2).alias("v")))
    bare = F.filter("_tokens", lambda t: ~t.rlike(pair))
    rows = rows.withColumn("_pairs", pairs).withColumn("_bare", bare)
    said = lambda key: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("_pairs", lambda p: p["k"] == key), lambda p: p["v"])), -1)
    times, calls = (F.filter("_bare", lambda t: t.rlike(CLOCK))), (F.filter("_bare", lambda t: ~t.rlike(CLOCK) & plausible_callsign(t)))
    first = lambda array: F.coalesce(F.get(array, F.lit(0)), F.lit(""))
    values = {k: said(k) for k in FAST_KEYS}
    values["TIME"] = F.coalesce(F.nullif(said("TIME"), F.lit("")), first(times))
    values["CALL"] = F.coalesce(F.nullif(said("CALL"), F.lit("")), F.upper(first(calls)))
    values["DATE"] = F.regexp_replace(said("DATE"), "[-/]", "")
    unknown = F.transform(F.filter("_pairs", lambda p: ~p["k"].isin(FAST_KEYS)), lambda p: F.concat(F.lit("unknown token "), p["k"]))
    unclear = F.transform(F.filter("_bare", lambda t: ~t.rlike(CLOCK) & ~plausible_callsign(t)), lambda t: F.concat(F.lit("unclear "), t))
    rows = rows.withColumns({f"_{k}": v for k, v in values.items()}).withColumn("_errors", F.concat(unknown, unclear))
    before = Window.partitionBy(*keys).orderBy("line_no")
    filled = {k: F.coalesce(F.last(F.nullif(f"_{k}", F.lit("")), ignorenulls=True).over(before), F.lit("")) for k in CARRIED}
    rows = rows.withColumns({f"_own_{k}": F.col(f"_{k}") != "" for k in CARRIED}).withColumns({f"_{k}": v for k, v in filled.items()})
    # A date that is given starts counting days anew; each fall back over midnight after it adds one.
    previous = F.lag("_TIME").over(before)
    late = (F.col("_TIME") < previous) & (F.substring(previous, 1, 2) >= "20") & (F.substring("_TIME", 1, 2) <= "04")
    rows = rows.withColumn("_late", F.coalesce(late, F.lit(False)).cast("int")).withColumn("_dated", F.sum(F.col("_own_DATE").cast("int")).over(before))
    rows = rows.withColumn("_days", F.sum("_late").over(Window.partitionBy(*keys, "_dated").orderBy("line_no")))
    day = F.when(F.col("_DATE").rlike(r"^\d{8}$"), F.try_to_date("_DATE", "yyyyMMdd"))
    rows = rows.withColumn("_DATE", F.when(day.isNotNull() & (F.col("_days") > 0), F.date_format(F.date_add(day, F.col("_days").cast("int")), "yyyyMMdd")).otherwise(F.col("_DATE")))
    rows = rows.withColumn("_serial", F.when(F.col("_STX").rlike(r"^\d+$"), F.col("_STX").try_cast("long")))
    rows = rows.withColumn("_group", F.count("_serial").over(before))
    group = Window.partitionBy(*keys, "_group").orderBy("line_no")
    counted = F.first("_serial", ignorenulls=True).over(group) + F.row_number().over(group) - 1
    text = counted.cast("string")
    rows = rows.withColumn("_STX", F.when((F.col("_STX") == "") & counted.isNotNull(), F.lpad(text, F.greatest(F.length(text), F.lit(3)), "0")).otherwise(F.col("_STX")))
    checks = [
        (F.col("_CALL") == "", "CALL is required"), ((F.col("_CALL") != "") & ~plausible_callsign(F.col("_CALL")), "CALL looks invalid"),
        (~F.col("_DATE").rlike(r"^\d{8}$") | F.try_to_date("_DATE", "yyyyMMdd").isNull(), "DATE must be a day"), (~F.col("_TIME").rlike(CLOCK), "TIME must be a time"),
        (F.col("_MODE") == "", "MODE is required"), ((F.col("_BAND") == "") & (F.col("_FREQ") == ""), "BAND or FREQ is required"),
    ]
    missing = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), m) for c, m in checks]), lambda m: m.isNotNull())
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_{k}").alias("value")) for k in [*FAST_KEYS]], F.struct(F.lit("NOTES").alias("key"), F.col("_note").alias("value"))), lambda e: e["value"] != "")
    inherited = F.filter(F.array(*[F.when(~F.col(f"_own_{k}") & (F.col(f"_{k}") != ""), k) for k in CARRIED]), lambda k: k.isNotNull())
    return rows.select(*keys, "line_no", "source", F.map_from_entries(entries).alias("values"), inherited.alias("inherited"), F.concat("_errors", missing).alias("errors"))


# The tags of fast-entry keys.
FAST_TAGS = {"DATE": "QSO_DATE", "TIME": "TIME_ON", "CALL": "CALL", "BAND": "BAND", "FREQ": "FREQ", "MODE": "MODE", "RST_S": "RST_SENT", "RST_R": "RST_RCVD", "STX": "STX", "SRX": "SRX", "NOTES": "NOTES"}


def fast_entry_tags(entries: DataFrame) -> DataFrame:
    """entries without errors, with tags (name, value, type): the activity as MY_SIG and MY_SIG_INFO."""
    tags = []
    for key, name in FAST_TAGS.items():
        value = F.try_element_at(F.col("values"), F.lit(key))
        tags.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(None).cast("string").alias("type"))))
    act = F.try_element_at(F.col("values"), F.lit("ACT"))
    program = F.when(act.rlike(r"(?i)^(K|VE)-\d"), "POTA").otherwise("ACTIVITY")
    for name, value in (("MY_SIG", program), ("MY_SIG_INFO", act)):
        tags.append(F.when(act.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(None).cast("string").alias("type"))))
    return entries.where(F.size("errors") == 0).withColumn("tags", F.filter(F.array(*tags), lambda t: t.isNotNull()))
