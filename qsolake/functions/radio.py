"""Bands, frequencies, call signs and prefixes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The amateur bands in kHz (inclusive) and a representative frequency of each.
BANDS_KHZ = [
    (1800, 2000, "160M"), (3500, 4000, "80M"), (5000, 5500, "60M"), (7000, 7300, "40M"), (10100, 10150, "30M"),
    (14000, 14350, "20M"), (18068, 18168, "17M"), (21000, 21450, "15M"), (24890, 24990, "12M"), (28000, 29700, "10M"),
    (50000, 54000, "6M"), (70000, 71000, "4M"), (144000, 148000, "2M"), (222000, 225000, "1.25M"),
    (420000, 450000, "70CM"), (902000, 928000, "33CM"), (1200000, 1300000, "23CM"), (2300000, 2450000, "13CM"),
    (3300000, 3500000, "9CM"), (5650000, 5925000, "6CM"), (10000000, 10500000, "3CM"), (24000000, 24250000, "1.25CM"),
    (47000000, 47200000, "6MM"), (75500000, 81000000, "4MM"), (119000000, 123000000, "2.5MM"),
    (134000000, 149000000, "2MM"), (241000000, 300000000, "1MM"),
]
BAND_FREQUENCY = {
    "160M": "1850", "80M": "3550", "60M": "5357", "40M": "7050", "30M": "10120", "20M": "14050", "17M": "18100",
    "15M": "21050", "12M": "24920", "10M": "28050", "6M": "50100", "4M": "70200", "2M": "144300", "1.25M": "223500",
    "70CM": "432100", "33CM": "902100", "23CM": "1296100", "13CM": "2304000", "9CM": "3400000", "6CM": "5760000",
    "3CM": "10368000", "1.25CM": "24048000", "6MM": "47088000", "4MM": "76032000", "2.5MM": "122250000",
    "2MM": "142000000", "1MM": "241000000",
}
# Suffixes that say how, not where, a station operates.
PORTABLE = ["A", "AM", "M", "MM", "P", "QRP", "R"]
PORTABLE_CALLS = [*PORTABLE, "QRPP"]


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable: it is evaluated once, and its expression isn't repeated in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(x: Column) -> Column:
    """Strip all white space, Unicode's too, from both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def number(x: Column) -> Column:
    """A decimal number with point or comma; null where it isn't one, 0 for an empty string."""
    return let(F.regexp_replace(trimmed(x), ",", "."), _number)


def _number(text: Column) -> Column:
    return F.when(text == "", F.lit(0.0)).otherwise(F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")))


def band_of_khz(khz: Column) -> Column:
    def chosen(value: Column) -> Column:
        out = F.when((value >= BANDS_KHZ[0][0]) & (value <= BANDS_KHZ[0][1]), BANDS_KHZ[0][2])
        for low, high, name in BANDS_KHZ[1:]:
            out = out.when((value >= low) & (value <= high), name)
        return out.otherwise("")

    return let(khz, chosen)


def band_from_frequency(x: Column) -> Column:
    """Band of a label, a frequency in kHz, in MHz (below 1000) or in GHz (with a G); empty if it is in none."""

    def band(compact: Column) -> Column:
        giga = F.regexp_extract(compact, r"^(\d+(?:[.,]\d+)?)G$", 1)
        value = F.when(giga != "", number(giga) * 1_000_000).otherwise(number(compact))
        khz = let(value, lambda v: F.when(v < 1000, v * 1000).otherwise(v))
        return F.when(compact.isin(list(BAND_FREQUENCY)), compact).otherwise(band_of_khz(khz))

    return let(F.upper(trimmed(F.coalesce(x, F.lit("")))), band)


def adif_frequency_band(mhz: Column) -> Column:
    """Band of a frequency that is known to be in MHz."""
    return band_of_khz(number(F.coalesce(mhz, F.lit(""))) * 1000)


# The import table in MHz (inclusive).
IMPORT_BANDS_MHZ = [
    (1.8, 2, "160M"), (3.5, 4, "80M"), (5, 5.5, "60M"), (7, 7.3, "40M"), (10.1, 10.15, "30M"), (14, 14.35, "20M"),
    (18.068, 18.168, "17M"), (21, 21.45, "15M"), (24.89, 24.99, "12M"), (28, 29.7, "10M"), (50, 54, "6M"), (70, 71, "4M"),
    (144, 148, "2M"), (222, 225, "1.25M"), (420, 450, "70CM"), (902, 928, "33CM"), (1240, 1300, "23CM"),
    (2300, 2450, "13CM"), (3300, 3500, "9CM"), (5650, 5925, "6CM"), (10000, 10500, "3CM"),
]


def import_frequency_band(mhz: Column) -> Column:
    def found(value: Column, bands: list) -> Column:
        if len(bands) > 1:  # half of the bands at a time, as every frequency of an import is looked up
            half = len(bands) // 2
            return F.when(value < bands[half][0], found(value, bands[:half])).otherwise(found(value, bands[half:]))
        low, high, name = bands[0]
        return F.when((value >= low) & (value <= high), F.lit(name)).otherwise("")

    return let(mhz, lambda value: found(value, IMPORT_BANDS_MHZ))


def frequency_to_khz(x: Column) -> Column:
    value = number(x)
    khz = F.floor(F.when(value < 1000, value * 1000).otherwise(value) + 0.5).cast("long").cast("string")
    return F.coalesce(khz, F.upper(trimmed(x)))


def frequency_to_mhz(x: Column) -> Column:
    value = number(x)
    mhz = F.when(value >= 1000, value / 1000).otherwise(value)
    text = F.format_string("%.6f", mhz)
    return F.when(value.isNull(), F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""))


def frequency_from_band(x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in BAND_FREQUENCY.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.upper(trimmed(x))), F.lit(""))


def normalize_callsign(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9/]", "")


def plausible_callsign(x: Column) -> Column:
    call = normalize_callsign(x)
    return (
        F.length(call).between(3, 15) & call.rlike("[A-Z]") & call.rlike("[0-9]")
        & call.rlike("^([A-Z0-9]{1,4}/)?[A-Z0-9]{1,7}(/[A-Z0-9]{1,4})?$")
    )


def call_parts(call: Column) -> Column:
    return F.filter(F.split(call, "/"), lambda p: p != "")


def longest(parts: Column) -> Column:
    """The longest part, the first of equals; empty if there is none."""
    return F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))


def callsign_prefix(x: Column) -> Column:
    part = longest(F.split(normalize_callsign(x), "/"))
    upto = F.regexp_extract(part, "^([A-Z]*[0-9])", 1)
    letters = F.regexp_extract(part, "^([A-Z]+)", 1)
    return F.when(upto != "", upto).otherwise(F.concat(F.when(letters != "", letters).otherwise(F.substring(part, 1, 2)), F.lit("0")))


def base_call(x: Column, portable: list[str] = PORTABLE) -> Column:
    """The call without location prefixes and operating suffixes."""

    def base(call: Column) -> Column:
        return let(call_parts(call), lambda parts: (
            F.when(F.size(parts) < 2, call)
            .when(F.try_element_at(parts, F.lit(-1)).isin(portable), F.try_element_at(parts, F.lit(1)))
            .otherwise(longest(parts))
        ))

    return let(normalize_callsign(x), base)


def wpx_prefix(x: Column) -> Column:
    """Award prefix: the location's if one is given, else the call's, up to its last digit."""

    def source(call: Column, base: Column) -> Column:
        located = F.filter(call_parts(call), lambda p: (p != base) & ~p.isin(PORTABLE) & p.rlike("[A-Z]"))
        return F.regexp_replace(F.coalesce(F.try_element_at(located, F.lit(1)), base), "[^A-Z0-9]", "")

    def prefix(place: Column) -> Column:
        upto, letters = F.regexp_extract(place, "^(.*[0-9])", 1), F.regexp_replace(place, "[^A-Z]", "")
        return F.when(upto != "", upto).when(letters != "", F.concat(F.substring(letters, 1, 2), F.lit("0"))).otherwise("")

    return let(let(normalize_callsign(x), lambda call: let(base_call(x), lambda base: source(call, base))), prefix)


def lookup_candidates(x: Column) -> Column:
    """What a country lookup tries, in order: a short numbered suffix, the call, its short parts, its base."""
    call = normalize_callsign(x)
    parts = call_parts(call)
    suffix = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    first = F.when((F.size(parts) > 1) & suffix.rlike("^[A-Z]{0,3}[0-9]{1,2}$") & ~suffix.isin(PORTABLE), F.array(suffix)).otherwise(F.array().cast("array<string>"))
    short = F.filter(parts, lambda p: ~p.isin(PORTABLE) & (F.length(p) <= 4))
    more = F.when(F.size(parts) > 1, F.concat(short, F.array(base_call(x)))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(first, F.array(call), more)), lambda c: c != "")
