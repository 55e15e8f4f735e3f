"""The guided import on small files."""

from pyspark.sql import functions as F

from qsolake.functions import radio
from qsolake.sources import guided

HEAD = "Date,Time,Freq,Mode,Call,STX,SRX,Comment"
FILES = {
    "quoted": f'{HEAD}\n20240106,1238,14050,USB,Q3M,1,2,"said ""hi"", left"\n20240106,1239,14.05,CW,Q7WW,2,12,"one\ntwo"\n',
    "newlines": f"{HEAD}\r\n20240106,1238,14050,CW,Q3M,1,2,a\r20240106,1239,14.05,CW,Q7WW,2,12,b\n{HEAD}\n",
    "twice": "20240106\t1238\t14.05\tCW\tQ3M\n20240106\t1238\t14.050\tCW\tQ3M\n",
    "stray": 'Date;Time;Band;Mode;Call\n20240106;1238;20M;CW;Q3"M\n20240106;1238;20M;CW;"Q3M\n',
    "two calls": "20240106 1238 14.05 CW Q1AA Q3M\n20240107 1239 7.05 CW Q1AA Q7WW/P\n",
    "grouped": "Date Time Freq Mode MyCall Snt Exchange Call Rcvd Exchange Pts Comment\nYYYYMMDD HHMM kHz\n"
    "20240106 1238 50110,5 USB Q5XYZ 59 001 KK11AA Q3M 59 17 KK12BB 16\n20240106 1240 50100 CW Q5XYZ 599 002 KK11AA Q9ABC/P 599 7 KK13 99 a long comment\n",
    "conflict": "Date,Time,Freq,Band,Mode,Submode,Call,Callsign\n20240230,2460,14.05,40M,USB,LSB,Q3M,Q3X\n",
    "metadata": "Station: Q1AB\nStation: Q2AB\n# none\nDate|Time|Frequency MHz|Mode|Call\n01/02/2024|1238|14.05|CW|Q3M\n13/02/2024|1:38Z|0|CW|Q3M\nTotal 2\n",
    "empty": "",
    "none": None,
    "long": "x" * 5001,
}


def made(spark, bounds=None, candidate=None, names=tuple(FILES), **options):
    files = spark.createDataFrame([(n, FILES[n]) for n in names], "path string, text string")
    limits = guided.Limits(characters=5000)
    picked = guided.chosen(guided.interpretations(files, bounds, limits=limits), candidate)
    session = guided.sessions(files, picked, limits=limits)
    found = {n: [] for n in names}
    for r in sorted(guided.contacts(session, **options).collect(), key=lambda r: r.nth):
        found[r.path].append((r["values"], sorted(i.code for i in r.issues), r.unmapped))
    return {r.path: r for r in session.collect()}, found


def test_layouts(spark):
    session, found = made(spark, names=[n for n in FILES if n != "grouped"])
    assert {n: (r.candidate, [x.kind for x in r.rows]) for n, r in session.items()} == {
        "quoted": ("delimiter-2", ["header", "qso", "qso"]), "newlines": ("delimiter-2", ["header", "qso", "qso", "header"]),
        "twice": ("delimiter-0", ["qso"] * 2), "stray": ("delimiter-1", ["header", "qso", "qso"]), "two calls": (session["two calls"].candidate, ["qso"] * 2),
        "conflict": ("delimiter-2", ["header", "qso"]),
        "metadata": ("delimiter-3", ["metadata", "metadata", "comment", "header", "qso", "qso", "summary"]), "empty": ("delimiter-0", []), "long": (None, []),
    }
    assert session["long"].rejected == "characters" and session["metadata"].metadata == {"Station": "Q2AB"}
    assert found["empty"] == found["none"] == found["long"] == []
    one, two = found["quoted"]
    assert one[0] == {"QSO_DATE": "20240106", "TIME_ON": "1238", "FREQ": "14.05", "MODE": "SSB", "CALL": "Q3M", "STX": "1", "SRX": "2", "COMMENT": 'said "hi", left', "SUBMODE": "USB", "BAND": "20M"}
    assert two[0]["COMMENT"] == "one\ntwo" and one[1] == two[1] == []
    assert [x[1] for x in found["twice"]] == [[], ["duplicate-row"]]
    assert [x[1] for x in found["newlines"]] == [[], []]
    assert [x[1] for x in found["stray"]] == [["invalid-call", "malformed-record"], ["malformed-record"]] and found["stray"][1][0]["CALL"] == "Q3M"
    assert "CALL" not in found["two calls"][0][0] and "STATION_CALLSIGN" not in found["two calls"][0][0]  # which is which isn't invented
    assert found["two calls"][0][1] == ["missing-field"] and "Q1AA" in {v.strip() for v in found["two calls"][0][2].values()}
    assert found["conflict"][0][1] == ["band-conflict", "duplicate-mapping", "invalid-date", "invalid-time", "submode-conflict"]
    assert [x[1] for x in found["metadata"]] == [["ambiguous-date"], ["invalid-frequency"]] and found["metadata"][1][0]["TIME_ON"] == "0138"


def test_choices(spark):
    _, found = made(spark, names=("metadata",), date_order="dmy")
    assert [x[0]["QSO_DATE"] for x in found["metadata"]] == ["20240201", "20240213"]
    session, _ = made(spark, names=("twice",), candidate="whitespace")
    assert session["twice"].candidate == "whitespace"
    session, _ = made(spark, [9, 14, 20, 23], "fixed-width", names=("two calls",))
    assert session["two calls"].rows[0].cells == ["20240106 ", "1238 ", "14.05 ", "CW ", "Q1AA Q3M"]


def test_grouped_exchanges(spark):
    session, found = made(spark, candidate="whitespace", names=("grouped",))
    assert [x.kind for x in session["grouped"].rows] == ["header", "header", "qso", "qso"]
    assert [x[1] for x in found["grouped"]] == [[], []] and found["grouped"][0][0]["FREQ"] == "50.1105"
    assert found["grouped"][1][0]["COMMENT"] == "a long comment" and found["grouped"][1][0]["CALL"] == "Q9ABC/P"


def test_limits_are_optional(spark):
    files = spark.createDataFrame([("long", "a,b\n" * 2000), ("wide", ",".join("x" * 300)), ("none", None)], "path string, text string")
    found = {r.path: (r.rejected, r.n) for r in guided.sessions(files).selectExpr("path", "rejected", "size(rows) n").collect()}
    assert found == {"long": (None, 2000), "wide": (None, 1)}
    for limits, path, why in (
        (guided.Limits(rows=1999), "long", "rows"), (guided.Limits(cells=3999), "long", "cells"), (guided.Limits(characters=7999), "long", "characters"),
    ):
        made = {r.path: r.rejected for r in guided.sessions(files, limits=limits).collect()}
        assert made == {"long": None, "wide": None} | {path: why}


def test_cells_without_patterns(spark):
    """White space, shapes and headings of cells are told as by the patterns that name them; lines without quotes are cut like others."""
    cells = ["20240106", "6/9/2024", "2024-1-6", "1238", "12:38z", "9:05:30", "KK12", "kk12bb34", "Q3M", "q7ww/p", "ft8", "Phone", "QSO_DATE", "Pts", "m-y call", "Date1", "5 5", "", "ß1", "x" * 30 + "1", "Q3M ", "12:38 cw"]
    cells += [f"{a}Q3M{a}b{a}" for a in guided.WHITE + "\x1c\u200b\ufeff"] + list(guided.WHITE)
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    c = F.col("c")
    shapes = guided.is_date(c) | guided.is_time(c) | guided.is_grid(c) | guided.is_call(c) | guided.is_mode(c)
    letters = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    for r in rows.select("c", guided.trimmed(c).alias("t"), radio.trimmed(c).alias("u"), guided.evidence(c).alias("e"), shapes.alias("s"), guided.field_of(c).alias("f"), letters.alias("l")).collect():
        assert (r.t, r.e) == (r.u, r.s) and r.f == guided.HEADINGS.get(r.l, r.c if r.c in guided.FIELDS else ""), r
    text = 'a,b\n\r\nc,"d,\n""e"\rf,g"h,\n"i"j\n,\nk'
    want = [("a,b", ["a", "b"], []), ("", [""], []), ('c,"d,\n""e"', ["c", 'd,\n"e'], []), ('f,g"h,', ["f", 'g"h', ""], [guided.STRAY_QUOTE]), ('"i"j', ["ij"], [guided.AFTER_QUOTE]), (",", ["", ""], []), ("k", ["k"], [])]
    assert guided.scanned(text, ",") == want and guided.scanned("a\n" * 3 + 'b,"c', ",")[3:] == [('b,"c', ["b", "c"], [guided.UNCLOSED])] and guided.scanned("", ",") == []
    bands = spark.range(0, 12_000_000, 50).select((F.col("id") / 1000).alias("mhz")).unionByName(spark.createDataFrame([(x,) for low, high, _ in radio.IMPORT_BANDS_MHZ for x in (float(low), float(high))] + [(None,), (float("nan"),)], "mhz double"))
    one = F.coalesce(*[F.when((F.col("mhz") >= low) & (F.col("mhz") <= high), name) for low, high, name in radio.IMPORT_BANDS_MHZ], F.lit(""))
    assert bands.where(radio.import_frequency_band(F.col("mhz")) != one).count() == 0
