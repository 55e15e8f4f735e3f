"""The contest rules: for each contest how a contact's points and multipliers follow from its columns.

Geography comes from the look-up of the station (s_) and of the worked call (w_); where a rule needs a side that
isn't resolved, or a band that isn't told, a contact has no points and no multiplier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.functions.geo import distance_km
from qsolake.functions.radio import callsign_prefix, let, trimmed, wpx_prefix
from qsolake.functions.values import leading_int
from qsolake.plans import contest_sets as sets
from qsolake.plans.scoring import Builder, Rule, exchange_part, khz, per_band

BAND_CALL = ("band", "call_key")
BAND_MODE_CALL = ("band", "mode_raw", "call_key")
LOW = ["160M", "80M", "40M"]


# --- what a contact says -----------------------------------------------------------------------------------------


def text(name: str) -> Column:
    return trimmed(F.coalesce(F.col(name), F.lit("")))


def code(name: str) -> Column:
    return F.upper(text(name))


def call() -> Column:
    return code("call")


def got() -> Column:
    """The received exchange as it was written."""
    return text("rcvd")


def last() -> Column:
    return F.upper(exchange_part("srx_string", "rcvd"))


def wpx(of: str = "call") -> Column:
    return wpx_prefix(F.col(of))


def mode_is(*modes: str) -> Column:
    return F.upper("mode").isin(list(modes))


def mode_group(*modes: str) -> Column:
    """The mode if it is one of these, else OTHER."""
    return F.when(code("mode").isin(list(modes)), code("mode")).otherwise("OTHER")


def band_is(*names: str) -> Column:
    return F.col("band").isin(list(names))


def told() -> Column:
    return F.col("band") != "OTHER"


def worked() -> Column:
    return F.col("w_primary").isNotNull()


def both() -> Column:
    return worked() & F.col("s_primary").isNotNull()


def here(*entities: str) -> Column:
    """The station's entity is one of these."""
    return F.coalesce(F.col("s_primary").isin(list(entities)), F.lit(False))


def there(*entities: str) -> Column:
    return F.coalesce(F.col("w_primary").isin(list(entities)), F.lit(False))


def to(continent: str) -> Column:
    return F.coalesce(F.col("w_continent") == continent, F.lit(False))


def from_(continent: str) -> Column:
    return F.coalesce(F.col("s_continent") == continent, F.lit(False))


def near() -> Column:
    """Both on one continent."""
    return F.coalesce(F.col("s_continent") == F.col("w_continent"), F.lit(False))


def same() -> Column:
    return F.coalesce(F.col("s_primary") == F.col("w_primary"), F.lit(False))


def within(value: Column, values: list) -> Column:
    return F.coalesce(value.isin(list(values)), F.lit(False))


def suffix(*names: str) -> Column:
    """The call ends with one of these after a slash."""
    return call().rlike("/(" + "|".join(names) + ")$")


def low() -> Column:
    return band_is(*LOW)


def case(*branches, otherwise=0) -> Column:
    out = F
    for condition, value in branches:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def gate(condition: Column, value, otherwise=0) -> Column:
    return F.when(condition, value).otherwise(otherwise)


def joined(*tokens: Column) -> Column:
    """Several multipliers; null ones are left out."""
    return F.concat_ws("; ", *tokens)


def named(label: str, value: Column) -> Column:
    """label:value, null for an empty value."""
    return F.when(value != "", F.concat(F.lit(label + ":"), value))


def dxcc(label: str = "DXCC") -> Column:
    return F.concat(F.lit(label + ":"), F.col("w_primary"))


def first_digit(value: Column) -> Column:
    return F.regexp_extract(value, r"(\d)", 1)


def last_digit(value: Column) -> Column:
    return F.regexp_extract(value, r"(\d)\D*$", 1)


def area(digit: Column, label: str = "AREA") -> Column:
    """label:entity and digit; null without a digit."""
    return F.when(digit != "", F.concat(F.lit(label + ":"), F.col("w_primary"), digit))


def in_order(*keys: Column) -> Window:
    return Window.partitionBy("doc_id", *keys).orderBy("line_no")


def first_seen(value: Column, where: Column, *keys: Column) -> Column:
    """A value is met for the first time in its log (and keys) among the contacts that where holds for."""
    return where & (F.row_number().over(in_order(where, value, *keys)) == 1)


# --- locators ----------------------------------------------------------------------------------------------------


def grid(side: str) -> Column:
    own, exchange = ("my_grid", "stx_string") if side == "sent" else ("grid", "srx_string")
    return F.coalesce(F.nullif(code(own), F.lit("")), code(exchange))


def grid4() -> Column:
    return F.substring(grid("received"), 1, 4)


def km() -> Column:
    return distance_km(grid("sent"), grid("received"))


def whole_km() -> Column:
    return F.coalesce(F.floor(km()), F.lit(0))


def km_or_one(rounded: Callable[[Column], Column] = F.floor) -> Column:
    return gate((grid("sent") != "") & (grid("sent") == grid("received")), 1, F.coalesce(rounded(km()), F.lit(0)))


def six(locator: Column) -> Column:
    """The part before a comma; four letters are taken for the middle of their field."""
    return let(F.upper(trimmed(F.substring_index(locator, ",", 1))), lambda g: F.when(F.length(g) == 4, F.concat(g, F.lit("55AA"))).otherwise(F.substring(g, 1, 6)))


def six_bonus() -> Column:
    a, b = six(grid("sent")), six(grid("received"))
    return case(((a == "") | (b == ""), 0), (a == b, 1), otherwise=F.coalesce(F.floor(distance_km(a, b)), F.lit(0)))


# --- kinds of call signs -----------------------------------------------------------------------------------------


def contains_any(value: Column, parts: list[str]) -> Column:
    return value.rlike("|".join(parts))


def prefix_like(parts: list[str], of: str = "call") -> Column:
    """The first two letters of the award prefix hold one of the parts."""
    return contains_any(F.substring(wpx(of), 1, 2), parts)


def us_call(of: str = "call") -> Column:
    """A US call; AG4, KG4, NG4 and WG4 with fewer than three letters behind aren't ordinary ones."""
    rest = [(code(of).contains(p), F.length(F.try_element_at(F.split(code(of), p, 2), F.lit(2))) >= 3) for p in ("AG4", "KG4", "NG4", "WG4")]
    return prefix_like(sets.US_FRAGMENTS, of) & case(*rest, otherwise=F.lit(True))


def canadian_call(of: str = "call") -> Column:
    return prefix_like(sets.CANADIAN_FRAGMENTS, of)


def domestic(of: str = "call") -> Column:
    return us_call(of) | canadian_call(of)


def japanese_call(of: str = "call") -> Column:
    return ~code(of).contains("/MM") & F.substring(wpx(of), 1, 2).isin(sets.KCJ_PREFIXES)


def italian_call(of: str = "call") -> Column:
    return wpx(of).startswith("I") & ~wpx(of).rlike("IG9|IH9")


def estonian_call(of: str = "call") -> Column:
    return F.substring(wpx(of), 1, 2) == "ES"


def cis_call() -> Column:
    return ~call().startswith("R1AN") & ~call().contains("RI1AN") & prefix_like(sets.CIS_FRAGMENTS)


def begins(of: str, *starts: str) -> Column:
    return code(of).rlike("^(" + "|".join(starts) + ")")


def hungarian(of: str = "call") -> Column:
    return F.regexp_replace(code(of), "[^A-Z0-9/]", "").rlike("^(HA|HG)")


def swiss() -> Column:
    return ~call().rlike("HB0|HE0") & begins("call", "HB", "HE")


def holyland(of: str = "call") -> Column:
    return F.regexp_replace(code(of), "[^A-Z0-9/]", "").rlike("^(4X|4Z|J1)")


def polish(of: str = "call") -> Column:
    return begins(of, *sets.POLISH_PREFIXES)


def spanish(of: str = "call") -> Column:
    return begins(of, "EA", "EB", "EC", "ED", "EE", "EF", "EG", "EH", "AM", "AO")


def french(of: str, entity: str) -> Column:
    return F.coalesce(F.col(entity).startswith("F") | (F.col(entity).isNotNull() & begins(of, *sets.FRENCH_TERRITORY_PREFIXES)), F.lit(False))


def jt_call() -> Column:
    return begins("call", "JT", "JU", "JV")


def portable() -> Column:
    return suffix("P", "M", "MM")


def mobile() -> Column:
    return call().rlike(r"/MM?(/|$)")


# --- points that several rules share -----------------------------------------------------------------------------


def apart(same_entity, same_continent, else_) -> Builder:
    """By distance: one entity, one continent, further."""
    c = lambda v: v() if callable(v) else F.lit(v)
    return lambda: gate(told() & both(), case((same(), c(same_entity)), (near(), c(same_continent)), otherwise=c(else_)))


def low_high(a: int, b: int) -> Builder:
    return lambda: F.when(low(), a).otherwise(b)


def told_and_heard() -> Column:
    return told() & worked() & (got() != "")


def one() -> Column:
    return F.lit(1)


def one_if(condition: Callable[[], Column]) -> Builder:
    return lambda: condition().cast("int")


def from_to(home: tuple[str, ...], own, visitors, others) -> Builder:
    """Points of contests of one country: of its stations, of others working it, of others among themselves."""
    return lambda: gate(told() & both(), case((here(*home), own()), (there(*home), visitors()), otherwise=others()))


def near_far(a: int, b: int) -> Builder:
    return lambda: F.when(near(), a).otherwise(b)


def in_or_out(continent: str, a: int, b: int) -> Builder:
    return lambda: F.when(to(continent), a).otherwise(b)


# --- rules with logic of their own -------------------------------------------------------------------------------


def ages() -> Column:
    sent, received = leading_int(F.col("sent")), leading_int(F.col("rcvd"))
    young = (sent < 26).cast("int") + (received < 26).cast("int")
    return case((sent.isNull() | received.isNull(), 0), (young == 2, 5), (young == 1, 2), otherwise=1)


def yl() -> Column:
    n = (code("sent") == "YL").cast("int") + (code("rcvd") == "YL").cast("int")
    return case((n == 2, 5), (n == 1, 3), otherwise=1)


def wpx_points() -> Column:
    home = F.when(from_("NA"), 2).otherwise(1)
    other = F.col("s_country") == F.col("w_country")
    return case((~both(), 0), (other, 1), (near(), low_high(2, 1)() * home), otherwise=low_high(6, 3)())


def ukei_km() -> Column:
    a, b = (F.coalesce(F.try_element_at(F.split(text(c), r"\s+"), F.lit(-1)), F.lit("")) for c in ("sent", "rcvd"))
    up = F.ceil(distance_km(a, b))
    return case((F.upper(a).eqNullSafe(F.upper(b)) & (a != ""), 1), (up < 500, 1), otherwise=F.coalesce(F.floor(up / 500) + 1, F.lit(0)))


def section() -> Column:
    """The last word of the exchange that is a section, else the longest section that the exchange ends with."""
    words = F.filter(F.split(code("rcvd"), "[^A-Z0-9]+"), lambda w: w.isin(sets.ARRL_SECTIONS))
    longest = sorted(sets.ARRL_SECTIONS, key=len, reverse=True)
    end = F.regexp_extract(code("rcvd"), "(" + "|".join(longest) + ")$", 1)
    tail = case(*[(F.substring(code("rcvd"), -n, n).isin([s for s in longest if len(s) == n]), F.substring(code("rcvd"), -n, n)) for n in (3, 2)], otherwise=end)
    return F.coalesce(F.try_element_at(words, F.lit(-1)), tail)


def remembrance() -> Column:
    minutes = F.substring("time_on", 1, 2).try_cast("int") * 60 + F.substring("time_on", 3, 2).try_cast("int")
    base = gate(band_is("160M", "23CM", "13CM", "9CM", "6CM", "3CM", "1.25CM", "6MM", "4MM", "2.5MM", "2MM", "1MM"), 2, 1)
    return gate(call() != "", base * gate((minutes > 660) & (minutes < 960), 3, 1) * gate(mode_is("CW", "RY"), 2, 1))


def low_power() -> Column:
    said = F.coalesce(F.nullif(code("srx_string"), F.lit("")), code("rcvd"))
    power = F.regexp_extract(F.regexp_replace(said, "^([^W]*)W", "$1."), r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    weak = F.coalesce((power > 0) & (power <= 10), F.lit(False))
    return case((call() == "", 0), (suffix("M", "P"), gate(weak, 15, 5)), otherwise=gate(weak, 10, 5))


def squares_first() -> Column:
    sent, received = F.substring(grid("sent"), 1, 4), grid4()
    there_are = (sent != "") & (received != "")
    firsts = first_seen(sent, there_are, F.col("band")).cast("int") + first_seen(received, there_are, F.col("band")).cast("int")
    return gate(there_are, 1 + 10 * firsts)


def aegean() -> Column:
    close = per_band({"160M": 3, "80M": 3, "40M": 3, "20M": 1, "15M": 1, "10M": 1})
    away = per_band({"80M": 6, "40M": 6, "20M": 2, "15M": 2, "10M": 2})
    return gate(both(), gate(near(), close, away) * gate(call().rlike(r"[\\/]QRP"), 2, 1) * gate(F.upper("w_matched").isin("SV5", "SV8", "SV9"), 3, 1))


def aegean_bonus() -> Column:
    """20 for a station with QRP in its call: once, at the first contact of its log."""
    return gate(code("my_call").rlike(r"[\\/]QRP") & (F.row_number().over(in_order()) == 1), 20)


def member_exchange(column: str) -> Column:
    return code(column).rlike("^[A-Z]{2}.+$")


def wwpmc() -> Column:
    own, other = member_exchange("sent"), member_exchange("rcvd")
    return case((~own & other, 25), (~own, 5), (other & (code("rcvd") != code("sent")), 10), otherwise=5)


def serials() -> Column:
    serial = F.upper(exchange_part("srx", "rcvd"))
    counts = worked() & (serial != "")
    key = F.concat(F.coalesce(F.col("w_primary"), F.lit("")), F.lit("|"), serial)
    return case((~counts, 0), (first_seen(key, counts, F.col("band")), 12), otherwise=2)


def croatian() -> Column:
    home = here("9A")
    abroad = case((~home & there("9A"), low_high(10, 6)()), (home & low(), near_far(4, 10)()), (home, near_far(2, 6)()), (low(), near_far(2, 6)()), otherwise=near_far(1, 3)())
    return gate(both(), abroad)


def rsgb_160() -> Column:
    fine = both() & khz().between(1800, 2100)
    district = last()
    uk, valid = there(*sets.UK), within(district, sets.RSGB_160_DISTRICTS)
    key = F.when(uk, F.concat(F.lit("D"), district)).otherwise(F.concat(F.lit("E"), F.coalesce("w_primary", F.lit(""))))
    seen = fine & F.when(uk, valid).otherwise(here(*sets.UK))
    return case((~F.coalesce(fine, F.lit(False)), 0), (uk & ~valid, 0), (~uk & ~here(*sets.UK), 2), (first_seen(key, F.coalesce(seen, F.lit(False))), 7), otherwise=2)


def field_day_entity() -> Column:
    zone = F.col("w_itu")
    return (zone.between(17, 39) & ~there("BY")) | zone.isin(sets.FIELD_DAY_ZONES) | there(*sets.FIELD_DAY_ENTITIES)


def epc_member() -> Column:
    digits = F.regexp_replace(code("rcvd"), r"\D", "")
    number = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0)).cast("string")
    return case((~code("rcvd").contains("EPC") | (digits == "0000"), ""), otherwise=F.concat(F.lit("EPC"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), "0")))


def iota(column: str) -> Column:
    return F.regexp_extract(code(column), r"((AF|AN|AS|EU|NA|OC|SA)-\d+)", 1)


def dok() -> Column:
    """A DOK of three characters, by the bounds that are put on each of them."""
    first, second, third = (F.substring(code("rcvd"), i, 1) for i in (1, 2, 3))
    return F.when((F.length(code("rcvd")) == 3) & (first >= "A") & (second <= "9") & (third <= "9"), code("rcvd")).otherwise("")


def kcj() -> Column:
    heard = got() != ""
    continent = F.lit(" AF AS EU NA OC SA ").contains(code("rcvd"))
    return case((~told() | ~heard, ""), (japanese_call(), named("JA", code("rcvd"))), (japanese_call("my_call") & continent, named("CONT", code("rcvd"))), otherwise="")


def southern_prefix() -> Column:
    return F.when(contains_any(F.substring(wpx(), 1, 3), ["3B8", "3DA", "ZS", *sets.SARL_AREA_8]), wpx()).otherwise("")


def southern_area() -> Column:
    short = F.substring(southern_prefix(), 1, 3)
    return case(*[(short.contains(f"ZS{i}"), i) for i in range(1, 7)], (short.rlike("3B8|3DA"), 7), (contains_any(short, sets.SARL_AREA_8), 8), (short.contains("ZS"), 9))


def southern_bands(rows: DataFrame) -> DataFrame:
    """_prefix of the contest's target area, _new: first time on its band, _nth: which band of the prefix that is."""
    counts = told() & (southern_prefix() != "")
    rows = rows.withColumn("_prefix", F.when(counts, southern_prefix()).otherwise(""))
    rows = rows.withColumn("_new", first_seen(F.col("_prefix"), F.col("_prefix") != "", F.col("band")))
    return rows.withColumn("_nth", F.sum(F.col("_new").cast("int")).over(in_order(F.col("_prefix"))))


def california() -> Column:
    own_section = F.when(F.length(got()) == 4, "CA").otherwise(got())
    return case(
        (~told() | (got() == ""), ""), (F.length(text("sent")) != 4, named("COUNTY", got())),
        (us_call(), F.when(within(own_section, sets.US_STATES), F.concat(F.lit("US:"), own_section)).otherwise("")),
        (canadian_call() & within(got(), sets.CALIFORNIA_PARTY_PROVINCES), named("CA", got())), otherwise="",
    )


def new_york() -> Column:
    county, state = within(got(), sets.NEW_YORK_COUNTIES), within(got(), sets.US_STATES)
    inside = within(text("sent"), sets.NEW_YORK_COUNTIES)
    return case(
        (~told() | got().isin("", "DX"), ""), (~inside, F.when(us_call() & county, named("NYC", got())).otherwise("")),
        (us_call() & county, F.concat(F.lit("NYC:"), got(), F.lit("; US:NY"))), (us_call(), F.when(state, named("US", got())).otherwise("")),
        (canadian_call() & within(got(), sets.NEW_YORK_PARTY_PROVINCES), named("CA", got())), otherwise="",
    )


def province_name(value: Column) -> Column:
    return F.when(value == "PEI", "PE").when(value == "NWT", "NT").otherwise(value)


def state_or_entity(exchange: Column) -> Column:
    """A US state or Canadian province that is one, elsewhere the entity."""
    province = province_name(exchange)
    return case(
        (there("W"), F.when(within(exchange, sets.US_STATES), F.concat(F.lit("STATE:"), exchange)).otherwise("")),
        (there("VE"), F.when(within(province, sets.CANADIAN_PROVINCES), F.concat(F.lit("PROVINCE:"), province)).otherwise("")), otherwise=dxcc(),
    )


def ten_metres() -> Column:
    group, province = mode_group("CW"), province_name(got())
    value = case(
        (suffix("M", "MM"), F.concat(F.lit(":MOBILE:"), got())),
        (there("W", "KL7", "KH6"), F.when(within(got(), sets.US_STATES), F.concat(F.lit(":STATE:"), got()))),
        (there("VE"), F.when(within(province, sets.CANADIAN_PROVINCES), F.concat(F.lit(":PROVINCE:"), province))),
        (there("XE"), F.concat(F.lit(":MEXICO:"), call())), otherwise=F.concat(F.lit(":"), dxcc()),
    )
    return gate(band_is("10M") & worked() & (got() != ""), F.concat(group, value), "")


def top_band() -> Column:
    value = F.when(got() == "NWT", "NT").otherwise(got())
    known = F.when(within(value, sets.ARRL_160_SECTIONS), F.concat(F.lit("SECTION:"), value)).otherwise("")
    return case((~(band_is("160M") & worked() & (got() != "")), ""), (~domestic("my_call") & ~domestic(), ""), (~domestic(), dxcc()), otherwise=known)


def arrl_dx() -> Column:
    return case(
        (~told_and_heard(), ""), (domestic("my_call"), F.when(domestic(), "").otherwise(dxcc())),
        (us_call(), F.concat(F.lit("STATE:"), got())), (canadian_call(), F.concat(F.lit("PROVINCE:"), got())), otherwise="",
    )


def areas_and_continent() -> tuple[Column, Column, Column]:
    digit = first_digit(wpx())
    return dxcc(), F.when(there(*sets.BY_AREA), area(digit)), F.concat(F.lit("CONT:"), F.col("w_continent"))


def sprint() -> Column:
    """Each entity, area and continent at its first contact only."""
    counts = told_and_heard()
    return gate(counts, joined(*[F.when(first_seen(F.coalesce(t, F.lit("")), counts & t.isNotNull()), t) for t in areas_and_continent()]), "")


def russian_parts(of: str) -> tuple[Column, Column]:
    return tuple(F.regexp_extract(code(of), "([0-9])([A-Z])", k) for k in (1, 2))


def russian_zone(of: str, entity: str) -> Column:
    digit, letter = russian_parts(of)
    return case(
        (F.col(entity) == "RA2", "SZ"), (~within(F.col(entity), ["RA1", "RA0"]) | (digit == ""), ""), (digit == "1", "SZ"),
        (digit.isin("2", "3", "4"), F.when(letter == "T", "CE").otherwise("PV")), (digit == "5", F.when(letter == "A", "YU").otherwise("CE")),
        (digit.isin("6", "7"), F.when(letter.isin(*"ALIUY"), "YU").otherwise("SK")),
        (digit.isin("8", "9"), case((letter.isin(*"FSW"), "CE"), (letter == "X", "SZ"), (letter.isin(*"VTHZOUYM"), "UR"), otherwise="SI")),
        otherwise=F.when(letter.isin(*"ABHOSUWY"), "UR").otherwise("DV"),
    )


# Russian regions that count as countries of their own, by digit and letter of the call.
RUSSIAN_REGIONS = {
    "1N": "R1N", "5S": "R4S", "5P": "R4P", "5U": "R4U", "5W": "R4W", "5Y": "R4Y",
    "6Z": "R9Z", "6I": "R6I", "6E": "R6E", "6P": "R6P", "6Q": "R6Q", "6W": "R6W", "6Y": "R6Y",
    "7Z": "R9Z", "7I": "R6I", "7E": "R6E", "7P": "R6P", "7Q": "R6Q", "7W": "R6W", "7Y": "R6Y",
    "8W": "R9W", "8X": "R9X", "8M": "R9Z", "9W": "R9W", "9X": "R9X", "9M": "R9Z", "0O": "R0O", "0Q": "R0Q", "0W": "R0W", "0Y": "R0Y",
}


def russian_country() -> Column:
    table = F.create_map(*[F.lit(v) for p in RUSSIAN_REGIONS.items() for v in p])
    region = F.try_element_at(table, F.concat(*russian_parts("call")))
    return F.when(there("RA1", "RA0", "RA2"), F.coalesce(region, F.col("w_primary"))).otherwise(F.col("w_primary"))


def cq_m() -> Column:
    a, b = russian_zone("my_call", "s_primary"), russian_zone("call", "w_primary")
    return gate(told() & both(), case((call().contains("/MM"), 3), ((a != "") & (b != ""), F.when(a == b, 1).otherwise(2)), (same(), 1), (near(), 2), otherwise=3))


def member_number() -> Column:
    """What follows the last /, \\ or A of the exchange, as a number where it is one."""
    member = trimmed(F.regexp_extract(code("rcvd"), r"[/\\A]([^/\\A]*)$", 1))
    n = leading_int(member)
    return F.when(n > 0, n.cast("string")).otherwise(member)


def zone_of_exchange() -> Column:
    raw = exchange_part("cqz", "rcvd", 1)
    n = leading_int(raw)
    return F.when(n <= 40, n.cast("string")).otherwise("")


def exchange_zone() -> Column:
    return F.upper(exchange_part("cqz", "rcvd"))


def portuguese_entity() -> Column:
    return F.when(there("IT9", "IG9"), "I").when(there("YU8"), "YU").otherwise(F.col("w_primary"))


def juiz_de_fora() -> Column:
    special = (F.length(code("rcvd")) == 3) & F.substring(code("rcvd"), 3, 1).isin(*"CYMQ")
    far = band_is("80M", "40M")
    return gate(told() & both(), case(
        (special, 10), (call().contains("/MM"), 3), (~band_is("80M", "40M", "20M", "15M", "10M"), 0), (same(), 1),
        (near(), F.when(far, 4).otherwise(2)), otherwise=F.when(far, 6).otherwise(3),
    ))


def dig_member() -> Column:
    return F.coalesce(leading_int(got()), F.lit(0))


def european(side: str) -> Column:
    """EU where the exchange begins with a letter, else the continent."""
    exchange, place = ("sent", "s_continent") if side == "sent" else ("rcvd", "w_continent")
    return F.when(code(exchange).rlike("^[A-Z]"), "EU").otherwise(F.coalesce(place, F.lit("")))


def merged_entity(column: str) -> Column:
    return F.when(F.col(column) == "YU8", "YU").when(F.col(column).isin("IG9", "IT9"), "I").otherwise(F.col(column))


def eu_psk() -> Column:
    a, b = european("sent"), european("received")
    return gate(told() & both(), case(
        ((a != "EU") & (b == "EU"), 5), (a != b, 3), (merged_entity("s_primary") != merged_entity("w_primary"), 2), (call().contains("/MM"), 3), otherwise=1,
    ))


def itu_points() -> Column:
    zone = leading_int(last())
    return gate(told() & both() & (last() != ""), case(
        (last().rlike("^[A-Z]"), 1), (F.coalesce(zone, F.lit(0)) < 1, 0), (zone == F.col("s_itu"), 1), (near(), 3), otherwise=5,
    ))


def numbered(label: str, value: Column) -> Column:
    n = leading_int(value)
    return F.when(n > 0, F.concat(F.lit(label + ":"), n.cast("string"))).otherwise("")


def japan_apart() -> Column:
    return per_band(sets.JIDX_POINTS) * gate(worked() & (japanese_call("my_call") != there(*sets.JAPANESE)), 1)


def okom_apart() -> Column:
    return worked() & (here(*sets.CZECH_SLOVAK) != there(*sets.CZECH_SLOVAK))


def dutch_area() -> Column:
    name = case(
        (there("RA0", "UA9"), "RA"), (there("VE") & call().contains("VO"), "VO"), (there("VE") & call().contains("VY"), "VY"), otherwise=F.col("w_primary")
    )
    return F.when(there(*sets.PACC_AREAS), F.concat(name, last_digit(call())))


def pacc() -> Column:
    province = F.when(within(last(), sets.DUTCH_PROVINCES), F.concat(F.lit("PROVINCE:"), last()))
    inside = F.coalesce(F.concat(F.lit("AREA:"), dutch_area()), dxcc())
    value = F.concat(mode_group("CW"), F.lit(":"), F.when(here("PA"), inside).otherwise(province))
    return gate(told() & worked() & (here("PA") | there("PA")), value, "")


def russian_160() -> Column:
    ships, ours, theirs = suffix("MM"), here(*sets.RUSSIAN), there(*sets.RUSSIAN)
    entity = F.when(there("RA2"), "RA1").otherwise(F.col("w_primary"))
    return gate(band_is("160M") & both(), case(
        (~ours & theirs, F.when(ships, 5).otherwise(10)), (~ours & ~ships & near(), F.when(same(), 2).otherwise(3)), (~ours, 5),
        (theirs & (ships | ~near()), 5), (theirs, F.when(entity == F.col("s_primary"), 2).otherwise(3)), otherwise=near_far(3, 5)(),
    ))


def russian_dx() -> Column:
    ships, ours, theirs = suffix("MM"), here(*sets.RUSSIAN), there(*sets.RUSSIAN)
    return gate(told() & both(), case(
        (~ours & theirs, F.when(ships, 5).otherwise(10)), (~ours & ~ships & near(), F.when(same(), 2).otherwise(3)), (~ours, 5),
        (theirs & ships, 5), (theirs, near_far(2, 5)()), otherwise=near_far(3, 5)(),
    ))


def district_code() -> Column:
    return F.when(last().rlike("^[A-Z]{2}"), last()).otherwise("")


def rdac() -> Column:
    ours, theirs = here(*sets.RUSSIAN), there(*sets.RUSSIAN)
    return gate(told() & both(), case(
        (~ours, gate(theirs & (district_code() != ""), 10)), (theirs & suffix("MM"), 10), (theirs, near_far(1, 2)()), otherwise=near_far(3, 5)(),
    ))


def ref() -> Column:
    ours, theirs = french("my_call", "s_primary"), french("call", "w_primary")
    return gate(told() & both(), case(
        (~ours & ~theirs, 0), (~ours, F.when(~near() & ~same(), 3).otherwise(1)), (theirs, near_far(6, 15)()), otherwise=near_far(1, 2)(),
    ))


def rnars() -> Column:
    return gate(told() & worked(), case((call() == "GB4RN", 10), (last() == "", 0), (last().rlike("^[A-Z]"), 10), otherwise=1))


def rnars_multiplier() -> Column:
    value = F.when(there(*sets.RNARS_AREAS), area(last_digit(call()))).otherwise(dxcc())
    return gate(rnars() > 0, case((call() == "GB4RN", "SPECIAL:GB4RN"), (last().rlike("^[A-Z]"), value), otherwise=""), "")


def doubled_low(points: Callable[[], Column]) -> Builder:
    return lambda: gate(told() & both(), points() * F.when(low(), 2).otherwise(1))


def russian_tokens(label: Callable[[], Column] = lambda: F.lit("")) -> Builder:
    def build() -> Column:
        oblast = F.when(F.col("w_primary").startswith("R") & (last() != ""), F.concat(label(), F.lit("OBLAST:"), last()))
        return gate(told() & both(), joined(F.concat(label(), dxcc()), oblast), "")

    return build


def colon(value: Column) -> Column:
    return F.concat(value, F.lit(":"))


def scandinavian() -> Column:
    ours, theirs = here(*sets.SCANDINAVIAN), there(*sets.SCANDINAVIAN)
    return gate(told() & both(), case(
        (ours, F.when(theirs, 0).otherwise(in_or_out("EU", 2, 3)())), (~theirs, 0), (~from_("EU") & band_is("80M", "40M"), 3), otherwise=1,
    ))


def call_area(of: str, entity: str) -> Column:
    return F.concat(F.col(entity), last_digit(code(of)))


def scc() -> Column:
    one_area = call_area("my_call", "s_primary") == call_area("call", "w_primary")
    return gate(told() & both(), case((~near(), 3), (~same(), 2), (~there(*sets.SCC_AREAS), 1), otherwise=F.when(one_area, 1).otherwise(2)))


def trc(side: str) -> Column:
    return F.upper(exchange_part(*(("stx_string", "sent") if side == "sent" else ("srx_string", "rcvd"))))


def ur_digi() -> Column:
    ours, theirs = here("UR"), there("UR")
    points = case((suffix("MM"), 5), (ours & theirs, 1), (ours, near_far(1, 3)()), (theirs, F.when(from_("EU"), 5).otherwise(10)), otherwise=near_far(1, 3)())
    return gate(told() & both(), points * F.when(band_is("10M"), 2).otherwise(1))


def ur_digi_multiplier() -> Column:
    mode = F.when(code("mode") == "RY", "RY:").otherwise("PK:")
    oblast = F.when(there("UR") & within(last(), sets.UKRAINIAN_OBLASTS), F.concat(mode, F.lit("OBLAST:"), last()))
    return gate(told() & both() & ~suffix("MM"), joined(F.concat(mode, dxcc()), oblast), "")


def uba_multiplier() -> Column:
    province = F.upper(F.regexp_replace(exchange_part("srx_string", "rcvd"), "[^A-Z]", ""))
    belgian = joined(F.when(within(province, sets.BELGIAN_PROVINCES), F.concat(F.lit("PROVINCE:"), province)), F.concat(F.lit("ON-PREFIX:"), wpx()))
    return gate(told() & both(), case((here("ON"), dxcc()), (~there("ON"), F.when(to("EU"), dxcc("EUROPE")).otherwise("")), otherwise=belgian), "")


def ukei_dx() -> Column:
    night = F.coalesce(leading_int(F.col("time_on")), F.lit(0))
    uk = there(*sets.UK)
    points = case(
        (here(*sets.UK), in_or_out("EU", 2, 4)() * F.when((night > 100) & (night < 459), 2).otherwise(1)),
        (from_("EU"), case((uk, 2), (to("EU"), 1), otherwise=2)), otherwise=case((uk, 4), (to("EU"), 2), otherwise=1),
    )
    return gate(told() & both(), points * F.when(band_is("80M", "40M"), 2).otherwise(1))


def six_metre_points() -> Column:
    a, b = grid("sent"), grid("received")
    return case(((a == "") | (b == ""), 0), (a == b, 1), otherwise=F.coalesce(F.ceil(distance_km(a, b)), F.lit(0)))


def six_metre_tokens() -> Column:
    member = F.when(leading_int(code("srx_string")) > 0, F.concat(F.lit("MEMBER:"), leading_int(code("srx_string")).cast("string")))
    return gate(six_metre_points() > 0, joined(member, named("SQUARE", grid("received")), F.when(worked() & ~suffix("M", "MM"), dxcc())), "")


def zone_points(sent: Column, received: Column) -> Column:
    """Points between two CQ zones. A stand-in for the sponsors' table of 40 x 40 zones, which goes here: nearer in
    number is nearer in points."""
    return F.abs(sent - received) + 2


def between_zones(sent: Column, received: Column, points) -> Column:
    return gate(sent.between(1, 40) & received.between(1, 40), points(sent, received))


def drcg(points=zone_points) -> Builder:
    def build() -> Column:
        base = between_zones(leading_int(text("sent")), leading_int(got()), points)
        return gate(told() & worked(), base * case((band_is("80M"), 3), (band_is("20M"), 2), otherwise=1))

    return build


def volta(points=zone_points) -> Builder:
    def build() -> Column:
        sent = leading_int(F.coalesce(F.nullif(code("stx_string"), F.lit("")), text("sent")))
        received = leading_int(F.coalesce(F.nullif(code("srx_string"), F.lit("")), got()))
        return gate(told() & both() & ~same(), between_zones(sent, received, points) * F.when(band_is("80M", "10M") & ~near(), 2).otherwise(1))

    return build


def volta_bands(rows: DataFrame) -> DataFrame:
    """_fourth: the contact with which an entity of another continent is worked on its fourth band."""
    counts = F.coalesce((volta()() > 0) & ~near(), F.lit(False))
    rows = rows.withColumn("_counts", counts).withColumn("_entity", F.coalesce("w_primary", F.lit("")))
    rows = rows.withColumn("_new", first_seen(F.col("_entity"), F.col("_counts"), F.col("band")))
    nth = F.sum(F.col("_new").cast("int")).over(in_order(F.col("_entity")))
    return rows.withColumn("_fourth", F.col("_new") & (nth == 4))


def european_side(column: str) -> Column:
    return within(F.col(column), sets.WAE_EUROPE)


def wae(rtty: bool) -> Builder:
    apart_ = lambda: F.lit(True) if rtty else european_side("s_primary") != european_side("w_primary")
    return lambda: gate(band_is(*sets.WAE_WEIGHTS) & both() & apart_(), 1)


def wae_multiplier(rtty: bool) -> Builder:
    def build() -> Column:
        value = F.coalesce(F.when(there(*sets.WAE_AREAS), area(first_digit(wpx()))), dxcc())
        return gate(wae(rtty)() > 0, value, "")

    return build


def romanian_county() -> Column:
    letters = F.regexp_replace(F.upper(F.coalesce(F.nullif(code("srx_string"), F.lit("")), F.coalesce("rcvd", F.lit("")))), "[^A-Z]", "")
    return F.when(within(letters, sets.ROMANIAN_COUNTIES), letters).otherwise("")


def romanian() -> Column:
    ours, theirs = here("YO"), there("YO")
    return gate(told() & both(), case(
        (~ours & theirs, 8), (~ours & same(), near_far(1, 2)()), (~ours, 4), (theirs, near_far(0, 4)()), otherwise=8,
    ))


def bulgarian_tokens() -> Column:
    ours, theirs, zone = here("LZ"), there("LZ"), F.concat(F.lit("ITU:"), last())
    abroad = F.when(theirs, F.when(within(last(), sets.BULGARIAN_DISTRICTS), F.concat(F.lit("DISTRICT:"), last())).otherwise("")).otherwise(zone)
    return gate(told() & both() & (last() != ""), F.when(ours, joined(F.when(~theirs, zone), dxcc())).otherwise(abroad), "")


def naqp() -> Column:
    place = F.upper(F.coalesce(F.nullif(code("qth"), F.lit("")), exchange_part("srx_string", "rcvd")))
    state = F.when(place == "MD", "DC").otherwise(place)
    return gate(told() & worked() & (place != ""), case(
        (there("W", "KH6", "KL7"), F.when(within(state, sets.US_STATES), F.concat(F.lit("STATE:"), state)).otherwise("")),
        (there("VE"), F.when(within(place, sets.CANADIAN_PROVINCES), F.concat(F.lit("PROVINCE:"), place)).otherwise("")),
        (to("NA"), F.concat(F.lit("NA-COUNTRY:"), place)), otherwise="",
    ), "")


def ea_eligible() -> Column:
    return told() & worked() & (~spanish() | within(code("rcvd"), sets.SPANISH_PROVINCES))


def helvetia_canton() -> Column:
    value = exchange_part("srx_string", "rcvd")
    return F.when(within(value, sets.SWISS_CANTONS), value).otherwise("")


def line() -> Column:
    return F.col("line_no").cast("string")


def by_kind(**scopes: Column) -> Callable[[], Column]:
    """The scope of a token by what it begins with; one band for the rest."""

    def build() -> Column:
        out = F
        for start, scope in scopes.items():
            out = out.when(F.col("token").startswith(start + ":"), scope())
        return out.otherwise(F.col("band"))

    return build


everywhere = lambda: F.lit("")
PER_BAND = {"band": "legacy", "scope": "band"}
TOKENS = {"band": "legacy", "scope": "band", "tokens": True}
SCORED = TOKENS | {"with_points": True}
GLOBAL_TOKENS = {"tokens": True, "with_points": True, "first_band": True}

RULES = {
    r.id: r
    for r in [
        Rule("generic-prefix", one, lambda: F.coalesce(F.nullif(wpx(), F.lit("")), callsign_prefix(F.col("call"))), duplicates=BAND_MODE_CALL),
        Rule("wfd", lambda: gate(mode_is("PH", "FM", "AM"), 1, 2), contests=("WFD", "*WINTER-FIELD-DAY*"), duplicates=BAND_MODE_CALL, fixed=1),
        Rule("cq-wpx", wpx_points, wpx, contests=("CQ-WPX*",), duplicates=BAND_CALL),
        Rule("sarl-youth", ages, contests=("SARL-YOUTH-SPRINT",), duplicates=BAND_MODE_CALL, fixed=1),
        Rule("sarl-yl", yl, contests=("SARL-YL-SPRINT",), duplicates=BAND_MODE_CALL, fixed=1),
        Rule("wia-ha", lambda: gate(band_is("80M"), gate(mode_is("CW"), 2, 1)), contests=("WIA-HA",), duplicates=BAND_CALL, fixed=1),
        Rule("ukeicc", ukei_km, contests=("UKEICC-80M*",), duplicates=BAND_CALL, fixed=1),
        Rule("radio-popov", lambda: F.greatest(F.coalesce(leading_int(got()), F.lit(0)), F.lit(0)), contests=("RADIO-POPOV",), duplicates=BAND_CALL, fixed=1),
        Rule("ig-rtty", one_if(lambda: got() != ""), lambda: code("rcvd"), contests=("IG-RY", "IG-RTTY"), duplicates=BAND_CALL),
        Rule("cwops", one, call, contests=("CW-OPS",), duplicates=BAND_CALL),
        Rule("hsc", lambda: case((got() == "", 0), ((code("rcvd") != "NM") & (leading_int(got()) > 0), 5), otherwise=1), contests=("HSC", "HSC-CW"), duplicates=BAND_CALL, fixed=1),
        Rule("arrl-ss", lambda: F.lit(2), section, contests=("ARRL-SS-CW", "ARRL-SS-SSB"), duplicates=BAND_CALL),
        Rule("euhfc", one_if(lambda: got() != ""), lambda: code("rcvd"), contests=("EUHFC", "EU-HF"), duplicates=BAND_CALL, scope="band"),
        Rule("spar-wfd", one_if(lambda: mode_is("CW", "PH", "RY", "TV", "SA")), lambda: gate(mode_is("CW", "PH", "RY", "TV", "SA"), code("mode"), ""), contests=("SPAR-WFD",), duplicates=("band", "mode_key", "call_key"), scope="band"),
        Rule("popov-vhf", whole_km, contests=("POPOV-VHF",), fixed=1),
        Rule("tmc-rtty", whole_km, contests=("TMC-RTTY",), fixed=1),
        Rule("pears-vhf", km_or_one, grid4, contests=("PEARS-VHF-UHF",), scope="band", total="band_product"),
        Rule("digifest", km_or_one, grid4, contests=("DIGIFEST",)),
        Rule("wia-vhf", squares_first, grid4, contests=("WIA-VHF-UHF",), factors=sets.WIA_FACTORS, total="factors"),
        Rule("sarl-vhf", km_or_one, grid4, contests=("SARL-VHF", "SARL-VHF-DIGITAL"), scope="band", factors=sets.SARL_VHF_FACTORS, total="band_factor_product"),
        Rule("aegean-vhf", lambda: km_or_one(F.ceil), grid4, contests=("AEGEAN-VHF",), scope="band", total="band_qso_product"),
        Rule("rsgb-low-power", low_power, contests=("RSGB-LOW-POWER",), fixed=1),
        Rule("remembrance-day", remembrance, contests=("REMEMBRANCE-DAY",), fixed=1),
        Rule("basso-ferrarese", lambda: gate(band_is("40M", "20M"), gate(within(call(), sets.JOLLY_CALLS), 100, 1)), lambda: gate(band_is("40M", "20M") & within(call(), sets.JOLLY_CALLS), "JOLLY", ""), contests=("BASSO-FERRARESE",), scope=line, total="jolly"),
        Rule("bdm-ww-rtty", lambda: gate(both(), near_far(5, 10)()), contests=("BDM-WW-RTTY",), fixed=1),
        Rule("aegean-rtty", aegean, bonus=aegean_bonus, contests=("AEGEAN-RTTY",), fixed=1, total="log_bonus"),
        Rule("baltic", lambda: gate(both(), case((here(*sets.BALTIC), near_far(1, 2)()), (there(*sets.BALTIC), near_far(10, 20)()), otherwise=1)), contests=("BALTIC",), fixed=1),
        Rule("inorc", lambda: gate(code("rcvd").rlike("^[A-Z]"), gate(band_is("20M", "15M", "10M"), 20, 10), gate(band_is("20M", "15M", "10M"), 2, 1)), lambda: gate(code("rcvd").rlike("^[A-Z]"), call(), ""), contests=("INORC",), minimum=1),
        Rule("wwpmc", wwpmc, lambda: gate(member_exchange("rcvd"), F.concat(F.when(mode_is("CW"), "CW|").otherwise("OTHER|"), code("rcvd")), ""), contests=("WWPMC",), scope="band", minimum=1),
        Rule("ukr-champ-rtty", serials, contests=("UKR-CHAMP-RTTY",), fixed=1),
        Rule("gdbage-dx", lambda: gate(worked(), gate(band_is("80M"), 3, 2)), lambda: gate(begins("call", "Y[B-H]", "[78][A-I]", "P[K-O]", "JZ"), wpx(), ""), contests=("GDBAGE-DX-TEST",), scope="band"),
        Rule("ap-sprint", lambda: gate(worked() & (here(*sets.AP_SPRINT) | there(*sets.AP_SPRINT)), 1), lambda: gate(worked() & (here(*sets.AP_SPRINT) | there(*sets.AP_SPRINT)), wpx(), ""), contests=("AP-SPRINT",)),
        Rule("9a-cw", croatian, lambda: F.col("w_primary"), contests=("9A-CW",), scope="band"),
        Rule("rsgb-160", rsgb_160, contests=("RSGB-160",), fixed=1),
        Rule("rsgb-nfd", lambda: gate(worked(), in_or_out("EU", 2, 3)() * gate(band_is("10M", "160M"), 2, 1) * gate(portable(), 2, 1)), contests=("RSGB-NFD",), fixed=1),
        Rule("rsgb-ssb-fd", lambda: gate(worked(), case((~field_day_entity(), 3), (portable(), 5), otherwise=2)), lambda: gate(portable(), "", F.col("w_primary")), contests=("RSGB-SSB-FD",), scope="band"),
        Rule("arrl-uhf", lambda: per_band(sets.ARRL_UHF_POINTS), lambda: gate(per_band(sets.ARRL_UHF_POINTS) > 0, grid4(), ""), contests=("ARRL-UHF-AUG",), scope="band"),
        Rule("arrl-vhf", lambda: per_band(sets.ARRL_VHF_POINTS), lambda: gate(per_band(sets.ARRL_VHF_POINTS) > 0, grid4(), ""), contests=("ARRL-VHF-JUN", "ARRL-VHF-SEP"), scope="band"),
        Rule("arrl-vhf-jan", lambda: per_band(sets.ARRL_VHF_JANUARY_POINTS), lambda: gate(per_band(sets.ARRL_VHF_JANUARY_POINTS) > 0, grid4(), ""), contests=("ARRL-VHF-JAN",), scope="band"),
        Rule("cq-vhf", lambda: case((~told(), 0), (band_is("4M", "2M"), 2), otherwise=1), lambda: gate(told() & (grid("sent") != "") & (grid4() != ""), F.concat(grid("sent"), F.lit("->"), grid4()), ""), contests=("CQ-VHF",), scope="band"),
        Rule("epc-psk63", lambda: case((got() == "", 0), (~code("rcvd").contains("EPC"), 1), (epc_member() != "", 5), otherwise=0), epc_member, contests=("EPC-PSK63",), duplicates=BAND_CALL, scope="band"),
        Rule("ari-sez", lambda: per_band(sets.ARI_SEZ_POINTS), lambda: gate(told() & (got() != ""), F.concat(mode_group("CW", "PH"), F.lit("|"), F.substring(code("rcvd"), 1, 4)), ""), contests=("ARI-SEZ",), scope="band"),
        Rule("rsgb-iota", lambda: case((iota("sent") == "", gate(iota("rcvd") != "", 15, 2)), otherwise=gate((iota("rcvd") != "") & (iota("rcvd") != iota("sent")), 15, 5)), lambda: gate(iota("rcvd") != "", F.concat(F.when(mode_is("CW"), "CW|").otherwise("PH|"), iota("rcvd")), ""), contests=("RSGB-IOTA",), scope="band"),
        Rule("ww-digi", lambda: F.coalesce(F.floor(F.ceil(km()) / 3000) + 1, F.lit(0)), grid4, contests=("WW-DIGI",), scope="band", total="band_product"),
        Rule("ybdx-80m", lambda: gate(band_is("80M") & both(), case((there("YB"), 50), otherwise=near_far(3, 5)())), lambda: gate(band_is("80M") & worked(), joined(F.concat(F.lit("DXCC:"), F.col("w_country")), F.concat(F.lit("WPX:"), wpx())), ""), contests=("YBDX-80M",), tokens=True, with_points=True),
        Rule("avhfc", lambda: case((band_is("6M"), 1), (band_is("2M"), 2)), lambda: gate(band_is("6M", "2M"), six(grid("received")), ""), bonus=lambda: gate(band_is("6M", "2M"), six_bonus()), contests=("AVHFC",), scope="band", total="band_product_bonus"),
        Rule("dmc-rtty", one_if(told), lambda: gate(told(), wpx(), ""), contests=("DMC-RTTY",)),
        Rule("darc-xmas", one_if(lambda: told() & (wpx() != "")), lambda: gate(told() & (wpx() != ""), joined(named("WPX", wpx()), named("DOK", dok())), ""), contests=("DARC-XMAS", "XMAS"), tokens=True, scope="band", with_points=True),
        Rule("es-open-hf", lambda: gate(estonian_call("my_call") | estonian_call(), gate(mode_is("CW"), 2, 1)), lambda: gate(told() & estonian_call(), F.concat(F.when(mode_is("CW"), "CW|").otherwise("OTHER|"), wpx()), ""), contests=("ES-OPEN-HF",), scope="band"),
        Rule("uba-psk63-prefix", one_if(lambda: told() & (wpx() != "")), lambda: gate(told() & (wpx() != ""), joined(named("WPX", wpx()), F.when(got().rlike("^[A-Z]{2}.+"), F.concat(F.lit("UBA:"), got()))), ""), contests=("UBA-PSK63-PREFIX",), tokens=True, scope="band", with_points=True),
        Rule("kcj", lambda: gate(told(), gate(japanese_call("my_call"), gate(japanese_call(), 1, 5), gate(japanese_call(), 1, 0))), kcj, contests=("KCJ", "KCJ-TOPBAND"), scope="band"),
        Rule("sarl-hf", lambda: gate(told() & (wpx() != ""), gate(mode_is("PH"), 1, 2)), lambda: gate(F.col("_new"), F.concat(F.lit("AREA:"), southern_area().cast("string")), ""), bonus=lambda: gate(F.col("_new") & (F.col("_nth") == 3), 2), contests=("SARL-HF-CW", "SARL-HF-PHONE"), scope="band", total="twice_and_bonus", prepare=southern_bands),
        Rule("cis-qpsk63-dx", lambda: gate(told() & (call() != "") & ~suffix("M", "MM"), gate(cis_call(), 3, 1)), lambda: gate(told() & ~suffix("M", "MM") & ~got().contains("0000"), got(), ""), contests=("CIS-QPSK63-DX",)),
        Rule("ca-qso-party", lambda: gate(told() & (call() != ""), gate(mode_is("PH"), 2, 3)), california, contests=("CA-QSO-PARTY",)),
        Rule("ny-qso-party", lambda: gate(told() & (call() != "") & (got() != ""), case((mode_is("CW"), 2), (mode_is("RY"), 3), otherwise=1)), new_york, contests=("NY-QSO-PARTY",), **GLOBAL_TOKENS),
        Rule("rac", lambda: gate(told() & (call() != "") & (got() != ""), case((within(call(), sets.RAC_STATIONS), 20), (canadian_call(), 10), otherwise=2)), lambda: gate(told() & canadian_call() & within(got(), sets.RAC_PROVINCES), F.concat(F.when(mode_is("CW"), "CW:").otherwise("OTHER:"), got()), ""), contests=("RAC-CANADA-DAY", "RAC-CANADA-WINTER"), scope="band"),
        Rule("georgia", lambda: gate(band_is("80M") & (wpx() != "") & both(), case((there("4L"), 10), (~near(), 4), (F.col("w_country") != F.col("s_country"), 2), otherwise=1)), lambda: gate(band_is("80M") & worked() & (wpx() != ""), joined(F.when(there("4L"), F.concat(F.lit("4L:"), call())), F.concat(F.lit("DXCC:"), F.col("w_country")), named("WPX", wpx())), ""), contests=("GEORGIA",), **GLOBAL_TOKENS),
        Rule("10m-rtty", lambda: gate(band_is("10M") & worked(), 1), lambda: gate(band_is("10M") & worked(), state_or_entity(got()), ""), contests=("10M-RTTY",)),
        Rule("aadx", lambda: gate(told() & both(), case((band_is("160M"), 3), (band_is("80M", "12M"), 2), otherwise=1) * gate(from_("AS") & ~to("AS"), 3, 1)), lambda: gate(told() & both(), F.when(from_("AS"), dxcc()).otherwise(F.concat(F.lit("CONT:"), F.col("w_continent"))), ""), contests=("AADX-CW", "AADX-SSB", "ALL-ASIAN-CW", "ALL-ASIAN-SSB"), **PER_BAND),
        Rule("africa-dx", lambda: gate(told_and_heard(), in_or_out("AF", 2, 1)()), lambda: gate(told_and_heard() & to("AF"), F.concat(F.lit("AF:"), mode_group("PH", "CW"), F.lit(":"), F.col("w_primary")), ""), contests=("AFRICA-DX",), with_points=True, total="at_least_one", **PER_BAND),
        Rule("agb-party", lambda: gate(band_is("80M") & both() & (got() != ""), case((~near(), 3), (member_number() != "", 5), otherwise=1)), lambda: gate(band_is("80M") & worked() & (got() != ""), joined(F.when(~suffix("M", "A", "P", "MM"), dxcc()), named("AGB", member_number())), ""), contests=("AGB-PARTY",), **GLOBAL_TOKENS),
        Rule("ari-dx", lambda: gate(told_and_heard() & both(), case((italian_call("my_call"), in_or_out("EU", 1, 3)()), (italian_call(), 10), (same(), 0), otherwise=near_far(1, 3)())), lambda: gate(told_and_heard(), case((~italian_call("my_call") & italian_call(), F.when(within(got(), sets.ITALIAN_PROVINCES), F.concat(F.lit("PROV:"), got())).otherwise("")), (there(*sets.ITALIAN), ""), otherwise=dxcc()), ""), contests=("ARI-DX",), **TOKENS),
        Rule("arrl-10", lambda: gate(band_is("10M") & worked() & (got() != ""), case((mode_is("CW") & call().rlike(r"[\\/][NT]$"), 8), (mode_is("CW"), 4), otherwise=2)), ten_metres, contests=("ARRL-10",)),
        Rule("arrl-160", lambda: gate(band_is("160M") & worked() & (got() != ""), case((domestic(), 2), (domestic("my_call"), 5))), top_band, contests=("ARRL-160",)),
        Rule("arrl-dx", lambda: gate(told_and_heard() & (domestic("my_call") != domestic()), 3), arrl_dx, contests=("ARRL-DX-CW", "ARRL-DX-SSB"), **PER_BAND),
        Rule("arrl-rtty", lambda: gate(told_and_heard(), 1), lambda: gate(told_and_heard(), case((~domestic(), dxcc()), (within(got(), [*sets.US_STATES, *sets.CANADIAN_PROVINCES, "PEI", "NWT"]), F.concat(F.lit("AREA:"), got())), otherwise=""), ""), contests=("ARRL-RTTY",), band="legacy"),
        Rule("bartg-rtty", lambda: gate(told_and_heard(), 1), lambda: gate(told_and_heard(), joined(*areas_and_continent()), ""), contests=("BARTG-RTTY",), **SCORED | {"scope": by_kind(CONT=everywhere)}, total="continents_apart"),
        Rule("bartg-sprint", lambda: gate(told_and_heard(), 1), sprint, contests=("BARTG-SPRINT",), **SCORED | {"scope": "global"}, total="continents_apart"),
        Rule("cq-m", cq_m, lambda: gate(told() & worked() & ~call().contains("/MM"), F.concat(F.lit("COUNTRY:"), russian_country()), ""), contests=("CQ-M",), **PER_BAND),
        Rule("cqsa", lambda: gate(told() & both(), case((call().contains("/M"), 3), (~from_("SA") & to("SA"), 10), (same(), 1), (near(), 2), otherwise=3)), lambda: gate(told() & worked() & ~call().contains("/M"), joined(F.concat(F.lit("CONT:"), F.col("w_continent")), F.when(to("SA"), dxcc("SA-DXCC"))), ""), contests=("CQSA-CW", "CQSA-RTTY", "CQSA-SSB"), **TOKENS),
        Rule("cq-wpx-rtty", lambda: gate(band_is("80M", "40M", "20M", "15M", "10M") & both(), case((~near(), gate(band_is("80M", "40M"), 6, 3)), (same() & ~call().contains("/MM"), gate(band_is("80M", "40M"), 2, 1)), otherwise=gate(band_is("80M", "40M"), 4, 2))), lambda: gate(first_seen(wpx(), band_is("80M", "40M", "20M", "15M", "10M") & worked() & (wpx() != "")), F.concat(F.lit("WPX:"), wpx()), ""), contests=("CQ-WPX-RTTY",), band="legacy", scope=line, with_points=True),
        Rule("cq-ww", lambda: gate(told() & both() & (exchange_zone() != ""), case((same(), 0), (~near(), 3), (to("NA"), 2), otherwise=1)), lambda: gate(told() & worked() & (exchange_zone() != "") & ~suffix("MM", "P", "A", "M"), joined(named("ZONE", exchange_zone()), dxcc()), ""), contests=("CQ-WW-CW", "CQ-WW-SSB"), **TOKENS),
        Rule("cq-160", lambda: gate(band_is("160M") & both() & (got() != ""), case((suffix("MM", "A"), 5), (~near(), 10), (same(), 2), otherwise=5)), lambda: gate(band_is("160M") & worked() & (got() != "") & ~suffix("MM", "A"), joined(dxcc(), F.when(there("W") & within(got(), sets.US_STATES), F.concat(F.lit("STATE:"), got())), F.when(there("VE") & within(got(), sets.CANADIAN_PROVINCES), F.concat(F.lit("PROVINCE:"), got()))), ""), contests=("CQ-160-CW", "CQ-160-SSB"), **TOKENS | {"band": "160M:1800:2100"}),
        Rule("cq-ww-rtty", lambda: gate(told() & both() & (zone_of_exchange() != ""), case((same(), 1), (near(), 2), otherwise=3)), lambda: gate(told() & worked() & (zone_of_exchange() != ""), joined(named("ZONE", zone_of_exchange()), dxcc(), F.when((there("W") & within(code("srx_string"), sets.US_STATES)) | (there("VE") & within(code("srx_string"), [*sets.CANADIAN_PROVINCES, "PEI"])), F.concat(F.lit("AREA:"), code("srx_string")))), ""), contests=("CQ-WW-RTTY",), **TOKENS),
        Rule("arr-psk63", lambda: gate(told() & worked(), case((within(call(), sets.ARR_CALLS), 10), (there(*sets.PORTUGUESE), 5), otherwise=1)), lambda: gate(told() & worked(), joined(F.concat(F.lit("DXCC:"), portuguese_entity()), F.when(there(*sets.PORTUGUESE), F.concat(F.lit("CT:"), call()))), ""), contests=("ARR-PSK63",), **TOKENS | {"scope": by_kind(CT=line)}),
        Rule("cwjf-mm", juiz_de_fora, lambda: gate(told() & worked(), joined(F.when(to("SA"), F.concat(F.lit("SA-WPX:"), wpx())), F.when(first_seen(F.coalesce("w_primary", F.lit("")), told() & worked()), dxcc())), ""), contests=("CWJF-MM",), **TOKENS),
        Rule("dig-qso-party", lambda: gate(told() & worked(), gate(dig_member() != 0, 10, 1)), lambda: gate(told() & worked(), joined(dxcc(), F.when(first_seen(dig_member(), told() & worked() & (dig_member() != 0)), F.concat(F.lit("DIG:"), dig_member().cast("string")))), ""), contests=("DIG-QSO-PARTY", "DIG-PA"), **TOKENS),
        Rule("dl-dx-rtty", lambda: gate(told() & both(), case((same(), 5), (near(), 10), otherwise=15) + gate(there("DL"), near_far(3, 5)(), 0)), lambda: gate(told() & worked(), joined(dxcc(), F.when(there(*sets.BY_AREA), area(first_digit(wpx())))), ""), contests=("DL-DX-RTTY",), **SCORED),
        Rule("drcg-ww-rtty", drcg(), lambda: gate(told() & worked(), F.when(there(*sets.BY_AREA), F.coalesce(area(first_digit(wpx())), F.lit(""))).otherwise(dxcc()), ""), contests=("DRCG-WW-RTTY", "LDC-RTTY"), **SCORED),
        Rule("ea-rtty", lambda: gate(ea_eligible(), gate(spanish(), gate(spanish("my_call"), 2, 3), 1)), lambda: gate(ea_eligible(), joined(F.when(call() == "EA4URE", "EADX100:EA4URE"), F.when(spanish(), F.concat(F.lit("EA:"), wpx())), dxcc(), F.when(there(*sets.BY_AREA), area(first_digit(wpx())))), ""), contests=("EA-RTTY",), **SCORED),
        Rule("polska-ww-bpsk63", apart(1, 2, 3), lambda: gate(told() & worked() & ~mobile(), joined(dxcc(), F.when(there("SP"), F.concat(F.lit("SP:"), wpx()))), ""), contests=("POLSKA-WW-BPSK63",), **SCORED),
        Rule("epc-ukr-dx", lambda: gate(told() & both(), case((~here("UR") & there("UR"), 10), (~near(), 5), (~same(), 2), (mobile(), 3), otherwise=1)), lambda: gate(told() & worked() & ~mobile(), joined(dxcc(), F.when(there("UR") & code("rcvd").contains("UR"), F.concat(F.lit("OBLAST:"), code("rcvd")))), ""), contests=("EPC-UKR-DX",), **SCORED),
        Rule("epc-ww-dx", lambda: gate(told() & both(), case((call().contains("/MM"), 3), (same(), 1), (near() & band_is("80M", "40M", "20M"), 2), (near(), gate(band_is("15M", "10M"), 3)), otherwise=per_band({"80M": 6, "40M": 4, "20M": 4, "15M": 4, "10M": 5}))), lambda: gate(told() & worked() & ~call().contains("/MM"), dxcc(), ""), contests=("EPC-WW-DX",), **PER_BAND),
        Rule("eudxc", lambda: gate(told() & both(), case((same(), 2), (there(*sets.EUDXC), 10), otherwise=near_far(3, 5)())), lambda: gate(told() & worked(), joined(F.when(there(*sets.EUDXC), named("REGION", code("rcvd"))), named("WAE", wpx())), ""), contests=("EUDXC",), **SCORED),
        Rule("eu-psk-dx", eu_psk, lambda: gate(told() & worked(), joined(F.concat(F.lit("DXCC:"), merged_entity("w_primary")), F.when(european("received") == "EU", named("EU-AREA", code("rcvd")))), ""), contests=("EU-PSK-DX",), **SCORED),
        Rule("ft8-dx", lambda: gate(told() & worked(), 1), lambda: gate(told() & worked(), state_or_entity(province_name(code("rcvd"))), ""), contests=("FT8-DX", "FT8-RU"), band="legacy", **GLOBAL_TOKENS),
        Rule("gacw", lambda: gate(told() & both(), case((same(), 0), (near(), 1), (to("SA"), 5), otherwise=3)), lambda: gate(told() & worked() & ~suffix("MM", "M"), joined(named("ZONE", exchange_part("srx_string", "rcvd")), dxcc()), ""), contests=("GACW",), **TOKENS),
        Rule("ha-dx", lambda: gate(told() & both(), case((hungarian("my_call"), gate(hungarian(), 1, near_far(3, 5)())), (hungarian(), 6), otherwise=near_far(1, 3)())), lambda: gate(told() & worked(), case((hungarian("my_call"), dxcc()), (hungarian(), F.coalesce(named("COUNTY", exchange_part("srx_string", "rcvd")), F.lit(""))), otherwise=""), ""), contests=("HA-DX",), minimum=1, **TOKENS),
        Rule("helvetia", lambda: gate(told() & both(), gate(swiss(), gate(helvetia_canton() != "", 10), near_far(1, 3)())), lambda: gate(told() & worked(), case((~swiss(), dxcc()), (helvetia_canton() != "", joined(named("CANTON", helvetia_canton()), dxcc())), otherwise=""), ""), contests=("HELVETIA",), **TOKENS),
        Rule("holyland", lambda: gate(told() & both(), case((call().contains("/MM"), 4), (holyland("my_call"), gate(there("4X") | holyland(), 1, near_far(2, 8)())), (there("4X") | holyland(), 8), (~near(), 4), (same(), 1), otherwise=2)), lambda: gate(told() & worked() & ~call().contains("/MM"), joined(F.when(there("4X") | holyland(), named("AREA", exchange_part("srx_string", "rcvd"))), dxcc()), ""), contests=("HOLYLAND",), **TOKENS),
        Rule("iaru-hf", itu_points, lambda: gate(told() & worked(), F.when(last().rlike("^[A-Z]"), F.concat(F.lit("HQ:"), last())).otherwise(numbered("ITU", last())), ""), contests=("IARU-HF",), **TOKENS),
        Rule("jarts-ww-rtty", apart(2, 2, 3), lambda: gate(told() & worked(), F.when(there(*sets.BY_AREA), F.coalesce(area(first_digit(wpx())), F.lit(""))).otherwise(dxcc()), ""), contests=("JARTS-WW-RTTY",), **TOKENS),
        Rule("jidx", japan_apart, lambda: gate((japan_apart() > 0) & ~call().contains("/MM") & (last() != ""), gate(japanese_call("my_call"), joined(named("ZONE", last()), dxcc()), F.concat(F.lit("PREFECTURE:"), last())), ""), contests=("JIDX-CW", "JIDX-SSB", "JIDX-PH"), **TOKENS),
        Rule("jt-dx", lambda: gate(told() & both() & ~(here("JT") & jt_call()), case((~near(), 3), (same(), 1), otherwise=2)), lambda: gate(told() & worked() & ~(here("JT") & jt_call()), gate(jt_call(), F.concat(F.lit("JT:"), call()), dxcc()), ""), contests=("JT-DX", "JT-DX-RTTY"), **PER_BAND),
        Rule("lz-dx", lambda: gate(told() & both(), case((~here("LZ") & there("LZ"), 10), otherwise=near_far(1, 3)())), bulgarian_tokens, contests=("LZ-DX",), **TOKENS),
        Rule("marconi-memorial", lambda: gate(told() & worked(), 1), lambda: gate(told() & worked() & ~suffix("MM", "M"), dxcc(), ""), contests=("MARCONI-MEMORIAL",), **PER_BAND),
        Rule("naqp", lambda: gate(told() & worked(), 1), naqp, contests=("NAQP-CW", "NAQP-RTTY", "NAQP-SSB"), **PER_BAND),
        Rule("oceania-dx", lambda: gate(both() & (from_("OC") | to("OC")), per_band(sets.OCEANIA_POINTS)), lambda: gate(both() & (from_("OC") | to("OC")) & (per_band(sets.OCEANIA_POINTS) > 0), wpx(), ""), contests=("OCEANIA-DX-CW", "OCEANIA-DX-SSB"), **PER_BAND),
        Rule("ok-om-dx", lambda: gate(okom_apart(), near_far(1, 3)()), lambda: gate(told() & okom_apart(), gate(here(*sets.CZECH_SLOVAK), wpx(), F.coalesce(named("DISTRICT", last()), F.lit(""))), ""), contests=("OK-OM-DX",), **PER_BAND),
        Rule("okom-dx-ssb", lambda: gate(told() & both(), case((suffix("MM"), 5), (~same(), 3), (here(*sets.CZECH_SLOVAK), 2), otherwise=1)), lambda: gate(told() & worked() & ~suffix("MM"), gate(there(*sets.CZECH_SLOVAK), F.coalesce(named("OKOM", last()), F.lit("")), dxcc()), ""), contests=("OKOM-DX-SSB",), **PER_BAND),
        Rule("ok-dx-rtty", lambda: gate(both(), per_band({"40M": 3, "80M": 3, "10M": 1, "15M": 1, "20M": 1}) * near_far(1, 2)()), lambda: gate(told() & worked(), joined(dxcc(), F.when(~here("OK") & there("OK"), F.concat(F.lit("OK:"), call()))), ""), contests=("OK-DX-RTTY",), band="legacy", tokens=True),
        Rule("pacc", lambda: gate(told() & worked() & (here("PA") | there("PA")), 1), pacc, contests=("PACC",), **PER_BAND),
        Rule("portugal-day", lambda: gate(told() & both(), gate(there(*sets.PORTUGUESE), gate(here(*sets.PORTUGUESE), 5, 10), near_far(1, 2)())), lambda: gate(told() & worked(), joined(dxcc(), F.when(there(*sets.PORTUGUESE), named("DISTRICT", last()))), ""), contests=("PDC", "PORTUGAL-DAY", "PORTUGAL=DAY"), **SCORED | {"scope": "global"}, weight=lambda: F.when(F.col("token").startswith("DISTRICT:"), 5).otherwise(1)),
        Rule("radio-160", russian_160, lambda: gate(band_is("160M") & worked() & ~suffix("MM"), joined(dxcc(), F.when(there(*sets.RUSSIAN), named("OBLAST", last()))), ""), contests=("RADIO-160",), **TOKENS | {"band": "160M:1800:2000"}),
        Rule("radio-ww-rtty", apart(5, 5, 10), lambda: gate(told() & worked(), gate(there(*sets.RUSSIAN), F.coalesce(named("OBLAST", last()), F.lit("")), dxcc()), ""), contests=("RADIO-WW-RTTY",), **PER_BAND),
        Rule("rcc-cup", lambda: gate(told() & both(), gate(last().contains("RCC"), 10, near_far(3, 5)())), lambda: gate(told() & worked(), case((last().contains("RCC"), F.concat(F.lit("RCC:"), call())), (leading_int(last()).isNotNull(), F.concat(F.lit("ITU:"), leading_int(last()).cast("string"))), otherwise=""), ""), contests=("RCC-CUP",), **PER_BAND),
        Rule("rdac", rdac, lambda: gate(told() & both(), joined(F.when(there(*sets.RUSSIAN), named("RDA", district_code())), F.when(here(*sets.RUSSIAN), dxcc())), ""), contests=("RDAC",), **SCORED | {"scope": by_kind(RDA=everywhere)}, first_band=True),
        Rule("rdxc", russian_dx, lambda: gate(told() & worked() & ~suffix("MM"), joined(dxcc(), F.when(there(*sets.RUSSIAN), named("OBLAST", district_code()))), ""), contests=("RDXC",), **TOKENS),
        Rule("ref", ref, lambda: gate(ref() > 0, case((french("call", "w_primary"), F.coalesce(named("DEPT", last()), F.lit(""))), (french("my_call", "s_primary"), dxcc()), otherwise=""), ""), contests=("REF-160M", "REF-CW", "REF-SSB"), **PER_BAND),
        Rule("rnars", rnars, rnars_multiplier, contests=("RNARS", "RNARS-CW"), band="legacy", **GLOBAL_TOKENS),
        Rule("ru-ww-digi", doubled_low(lambda: case((suffix("QRP"), 5), (same(), 1), (near(), 3), otherwise=5)), russian_tokens(lambda: colon(mode_group("RY"))), contests=("RUS-WW-DIGI", "RU-WW-DIGI"), **TOKENS),
        Rule("ru-ww-mm", doubled_low(lambda: case((same(), 1), (near(), 3), otherwise=5)), russian_tokens(lambda: colon(mode_group("RY", "CW", "PH"))), contests=("RUS-WW-MM", "RU-WW-MM"), **TOKENS),
        Rule("ru-ww-psk", doubled_low(lambda: case((same(), 1), (near(), 3), otherwise=5)), russian_tokens(), contests=("RUS-WW-PSK", "RU-WW-PSK"), **TOKENS),
        Rule("sac", scandinavian, lambda: gate(scandinavian() > 0, gate(here(*sets.SCANDINAVIAN), dxcc(), F.coalesce(area(last_digit(call())), F.lit(""))), ""), contests=("SAC-CW", "SAC-SSB"), **PER_BAND),
        Rule("sartg-rtty", lambda: gate(told() & both(), case((~near(), 15), (same(), 5), otherwise=10)), lambda: gate(told() & both(), joined(dxcc(), F.when(there(*sets.BY_AREA), area(last_digit(call())))), ""), contests=("SARTG-RTTY", "SARTG RTTY", "SARTG"), **TOKENS),
        Rule("scc-rtty", scc, lambda: gate(told() & both(), F.coalesce(named("YEAR", last()), F.lit("")), ""), contests=("SCC-RTTY", "SCC RTTY"), **PER_BAND),
        Rule("sp-dx", lambda: gate(told() & worked(), gate(polish("my_call"), in_or_out("EU", 1, 3)(), gate(polish(), 3))), lambda: gate(told() & worked(), case((polish("my_call"), dxcc()), (polish() & within(last(), sets.POLISH_VOIVODESHIPS), F.concat(F.lit("VOIVODESHIP:"), last())), otherwise=""), ""), contests=("SP-DX", "SPDX", "SPDX CONTEST"), **PER_BAND),
        Rule("sp-dx-rtty", apart(2, 5, 10), lambda: gate(told() & both(), joined(dxcc(), F.when(polish() & within(last(), sets.POLISH_VOIVODESHIPS), F.concat(F.lit("VOIVODESHIP:"), last()))), ""), contests=("SP-DX-RTTY", "SP DX RTTY", "SPDX-RTTY"), total="continents", **TOKENS),
        Rule("trc-dx", lambda: gate(told() & worked(), gate((trc("received") == "TRC") & (trc("sent") != "TRC"), 10, 1)), lambda: gate(told() & worked(), gate(trc("received") == "TRC", dxcc("TRC"), numbered("ITU", trc("received"))), ""), contests=("TRC-DX", "TRC DX"), **PER_BAND),
        Rule("ur-dx-digi", ur_digi, ur_digi_multiplier, contests=("UR-DX-DIGI", "UR DX DIGI"), **TOKENS),
        Rule("ua-dx", from_to(("UR",), lambda: gate(there("UR"), 1, in_or_out("EU", 2, 3)()), lambda: F.lit(10), lambda: case((same(), 1), (near(), 2), otherwise=3)), lambda: gate(told() & both(), joined(dxcc(), F.when(~here("UR") & there("UR") & within(last(), sets.UKRAINIAN_OBLASTS), F.concat(F.lit("OBLAST:"), last()))), ""), contests=("UDXC", "UADX", "UA-DX", "UKRAINIAN DX"), **TOKENS),
        Rule("uba", from_to(("ON",), lambda: gate(there("ON"), 1, in_or_out("EU", 2, 3)()), lambda: F.lit(10), in_or_out("EU", 3, 1)), uba_multiplier, contests=("UBA", "UBA-CW", "UBA-SSB"), **TOKENS),
        Rule("uk-dx", lambda: gate(told() & both(), case((suffix("MM"), 3), (~here(*sets.UK) & there(*sets.UK), 5), (same(), 1), (near(), 2), otherwise=3)), lambda: gate(told() & both() & ~suffix("MM"), joined(dxcc(), F.when(there(*sets.UK) & ~last().rlike(r"^\d*$"), F.concat(F.lit("UK-AREA:"), last()))), ""), contests=("UKDX", "UK-DX-CW", "UK-DX-RTTY", "UK-DX-SSB"), **TOKENS),
        Rule("ukeidx", ukei_dx, lambda: gate(told() & both(), case((~there(*sets.UK), dxcc()), (within(last(), sets.UKEI_DISTRICTS), F.concat(F.lit("DISTRICT:"), last())), otherwise=""), ""), contests=("UKEIDX", "UKEIDX-CW", "UKEIDX-SSB"), **PER_BAND),
        Rule("uksmg", six_metre_points, six_metre_tokens, contests=("UKSMG",), total="by_500", **GLOBAL_TOKENS),
        Rule("un-dx", from_to(("UN",), lambda: gate(there("UN"), 2, in_or_out("AS", 3, 5)()), lambda: F.lit(10), lambda: gate(same(), near_far(2, 3)(), 5)), lambda: gate(told() & both(), joined(dxcc(), F.when(there("UN"), named("KDA", last()))), ""), contests=("UN-DX", "UNDX"), **TOKENS),
        Rule("volta-rtty", volta(), lambda: gate(volta()() > 0, joined(dxcc(), F.when(F.col("_fourth"), dxcc("4-BAND"))), ""), contests=("VOLTA-RTTY", "VOLTA RTTY"), total="accepted", prepare=volta_bands, **TOKENS),
        Rule("wae-dx", wae(False), wae_multiplier(False), contests=("DARC-WAEDC-CW", "DARC-WAEDC-SSB", "WAEDC"), weight=lambda: per_band(sets.WAE_WEIGHTS), total="with_qtcs", **SCORED),
        Rule("wae-rtty", wae(True), wae_multiplier(True), contests=("DARC-WAEDC-RTTY",), weight=lambda: per_band(sets.WAE_WEIGHTS), total="with_qtcs", **SCORED),
        Rule("wag", from_to(("DL",), lambda: gate(there("DL"), 1, in_or_out("EU", 3, 5)()), lambda: F.lit(3), lambda: F.lit(0)), lambda: gate(told() & both(), case((here("DL"), dxcc()), (there("DL"), F.coalesce(named("DOK", F.regexp_replace(F.coalesce(F.nullif(code("srx_string"), F.lit("")), code("rcvd")), "[^A-Z0-9]", "")), F.lit(""))), otherwise=""), ""), contests=("WAG-CW", "WAG-SSB", "WAG-MIXED", "WAG"), **TOKENS),
        Rule("xe-rtty", lambda: gate(told() & both() & (~there("XE") | within(last(), sets.MEXICAN_STATES)), gate(same(), 2, 3)), lambda: gate(told() & both(), case((~there("XE"), dxcc()), (within(last(), sets.MEXICAN_STATES), F.concat(F.lit("XE-STATE:"), last())), otherwise=""), ""), contests=("XE-RTTY", "XE-INTL-RTTY", "XERTTY"), **TOKENS),
        Rule("yb-dx", from_to(("YB",), lambda: gate(there("YB"), 0, near_far(5, 10)()), lambda: F.lit(10), lambda: case((same(), 1), (near(), 2), otherwise=3)), lambda: gate(told() & both(), joined(dxcc(), F.when(here("YB") | there("YB"), F.concat(F.lit("WPX:"), wpx()))), ""), contests=("YB-DX", "YB DX CONTEST"), **TOKENS),
        Rule("yo-dx", romanian, lambda: gate(romanian() > 0, gate(~here("YO") & there("YO"), F.coalesce(named("YO-COUNTY", romanian_county()), F.lit("")), dxcc()), ""), contests=("YODX", "YO-DX", "YO DX"), **PER_BAND),
        Rule("yo-psk31", lambda: gate(band_is("80M") & worked(), gate(there("YO"), 2, 1)), lambda: gate(band_is("80M") & worked(), joined(F.when(there("YO"), named("YO-COUNTY", romanian_county())), dxcc()), ""), contests=("YO-PSK31", "YO PSK31"), **TOKENS | {"band": "80M:3500:4000"}),
        Rule("yu-dx", apart(1, 2, 4), lambda: gate(told() & both() & there("YU"), F.coalesce(named("YU", F.coalesce(F.nullif(code("srx_string"), F.lit("")), got())), F.lit("")), ""), contests=("YU-DX", "YUDX", "YU DX CONTEST"), **PER_BAND),
    ]
}


def rule_for(contest: str) -> str:
    """The rule of a contest's name, generic-prefix where none is made for it."""
    name = contest.strip().upper()
    exact = [r.id for r in RULES.values() if name in r.contests]
    like = [r.id for r in RULES.values() for c in r.contests if c.endswith("*") and (c.strip("*") in name if c.startswith("*") else name.startswith(c[:-1]))]
    return (exact or like or ["generic-prefix"])[0]
