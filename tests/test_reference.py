"""Country files, call lists, fast entry, conversions and preflight on small cases."""

from pyspark.sql import functions as F

from qsolake.operators import conversions, lookup, preflight
from qsolake.plans import rules
from qsolake.sources import reference

COUNTRY = """# a comment
Germany:                  14:  28:  EU:   51.00:   -10.00:    -1.0:  DL:
    DA,DB,=DL1XX(33)[37]{AF}<10.5/7.5>~2~;
United States:            05:  08:  NA:   37.53:    91.67:     5.0:  K:
    K,N,W,DL;
Guantanamo Bay:           08:  11:  NA:   19.90:    75.00:     5.0:  KG4:
    KG4;
"""


def test_country_file(spark):
    found = reference.country_entries(spark.createDataFrame([(COUNTRY,), ("<html>x:1:2:3:4:5:6:7:8;",), (None,)], "text string"))
    rows = {(r.prefix, r.exact): r for r in found.collect()}
    assert set(rows) == {("DL", False), ("DA", False), ("DB", False), ("DL1XX", True), ("K", False), ("N", False), ("W", False), ("KG4", False)}
    assert rows["DL", False].country == "Germany" and rows["DL", False].longitude == 10.0 and rows["DL", False].utc_offset == 1.0
    special = rows["DL1XX", True]
    assert (special.cq_zone, special.itu_zone, special.continent, special.latitude, special.longitude, special.utc_offset) == (33, 37, "AF", 10.5, -7.5, -2.0)
    calls = spark.createDataFrame([("KG4ABC",), ("KG4AB",), ("DL1XX",), ("QQ1A",)], "call string")
    named = {r.call: (r.w_country, r.w_primary) for r in lookup.country_lookup(calls, "call", found, "w_").collect()}
    assert named == {"KG4ABC": ("United States", "K"), "KG4AB": ("Guantanamo Bay", "KG4"), "DL1XX": ("Germany", "DL"), "QQ1A": (None, None)}


def test_call_lists(spark):
    texts = spark.createDataFrame([("k1ab, DL2XY/P\n12 zz",), (None,)], "text string")
    assert {r.call for r in reference.known_calls(texts).collect()} == {"K1AB", "DL2XY/P", "DL2XY"}
    binary = (8).to_bytes(4, "little") + b"JUNK" + b"K1AB\0G3XYZ\0\0no\0"
    found = reference.known_calls_binary(spark.createDataFrame([(bytearray(binary),), (bytearray(b"W1AA W2BB"),)], "content binary"))
    assert {r.call for r in found.collect()} == {"K1AB", "G3XYZ", "W1AA", "W2BB"}


def test_fast_entry(spark):
    text = "# day\nDATE=2026-01-31 TIME=2355 K1AB BAND=20M MODE=CW STX=9\n0003 DL2XY NOTE=\"hi there\"\n0010 ??? \n"
    rows = reference.fast_entries(spark.createDataFrame([(1, text)], "log int, text string")).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [2, 3, 4]
    assert rows[0]["values"]["DATE"] == "20260131" and rows[0]["values"]["STX"] == "9" and not rows[0].errors
    assert rows[1]["values"]["DATE"] == "20260201" and rows[1]["values"]["STX"] == "010" and rows[1]["values"]["NOTES"] == "hi there"
    assert rows[2]["values"]["DATE"] == "20260201" and set(rows[2].errors) == {"unclear ???", "CALL is required"}
    tagged = reference.fast_entry_tags(reference.fast_entries(spark.createDataFrame([(1, "DATE=20260131 1200 K1AB FREQ=14.05 MODE=CW ACT=K-0001")], "log int, text string"))).first()
    assert [(t.name, t.value) for t in tagged.tags if t.name.startswith("MY_")] == [("MY_SIG", "POTA"), ("MY_SIG_INFO", "K-0001")]


def test_edi_bands_and_dates(spark):
    bands = ["144 MHz", "1,3 GHz", "432 MHz", "10 GHz", "21 MHz", ""]
    rows = spark.createDataFrame([(b,) for b in bands], "b string").select(conversions.edi_band(F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == ["2M", "23CM", "70CM", "3CM", "", ""]
    dates = spark.createDataFrame([("260906", ""), ("990906", ""), ("990906", "20260101"), ("bad", "")], "d string, s string")
    assert [r.x for r in dates.select(conversions.edi_date(F.col("d"), F.col("s")).alias("x")).collect()] == ["20260906", "19990906", "20990906", ""]


def test_preflight_of_a_satellite_contact(spark):
    tags = [[("CALL", "K1AB"), ("QSO_DATE", "20260101"), ("TIME_ON", "1200"), ("BAND", "2M"), ("MODE", "FM"), ("STATION_CALLSIGN", s), ("SAT_NAME", "AO-7")] for s in ("DL1AA", "DL2BB")]
    records = spark.createDataFrame([(1, i + 1, [(n, v, None) for n, v in t]) for i, t in enumerate(tags)], "log int, record int, tags array<struct<name:string,value:string,type:string>>")
    found = preflight.findings(records, "lotw", keys=("log",))
    assert sorted((r.record or 0, r.code) for r in found.collect()) == [(0, "LOTW-MIXED-LOCATION"), (1, "LOTW-PROP-SAT"), (2, "LOTW-PROP-SAT")]
    assert {r.outcome for r in preflight.outcome(records, found, ("log",)).collect()} == {"rejected"}


def test_rules_by_contest_name():
    assert rules.rule_for(" cq-ww-cw ") == "cq-ww" and rules.rule_for("CQ-WPX-SSB") == "cq-wpx" and rules.rule_for("CQ-WPX-RTTY") == "cq-wpx-rtty"
    assert rules.rule_for("ARRL WINTER-FIELD-DAY 2026") == "wfd" and rules.rule_for("none such") == "generic-prefix"
    assert len(rules.RULES) == 135
