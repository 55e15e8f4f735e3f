"""Exports of small imports: gates, records, losses; the search for an interpretation that can be exported."""

from pyspark.sql import functions as F
from qsolake.operators import exports, recovery
from qsolake.sources import guided

HEAD = "Date,Time,Freq,Mode,MyCall,Call,RST Sent,STX,RST Rcvd,SRX,Grid,Pts,Comment"
FILES = {
    "good": f"{HEAD}\n20240106,1238,144.3,SSB,Q1AB,Q3M,59,1,59,17,KK12BB,120,a;b\n20240106,123930,144.05,CW,Q1AB,Q7WW/P,599,2,599,1234,KK22,7,\n",
    "digital": f"{HEAD}\n20240106,1238,144.174,FT8,Q1AB,Q3M,59,1,59,17,,1,=x\n",
    "mixed": f"{HEAD}\n20240106,1238,144.3,CW,Q1AB,Q3M,5,1,59,12345,KK12BB00,x,\n20240107,1238,432.2,CW,Q2AB,Q3M,59,1,59,17,,1,\n",
}
META = "path string, utc_confirmed boolean, contest string, station string, locator string, band string, scoring string, claimed_score string, dates string"


def made(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    heads = spark.createDataFrame([(n, True, "SPRING", None, "KK11AA", None, "supplied-points", None, None) for n in FILES], META)
    return guided.contacts(guided.sessions(files)).cache(), heads


def codes(found):
    return {(r.path, r.nth, r.code, r.field) for r in found.where("severity = 'error'").collect()}


def test_gates(spark):
    rows, heads = made(spark)
    assert codes(exports.gated(rows, "edi", heads)) == {
        ("digital", 1, "IMPORT-EDI-MODE", "MODE"), ("mixed", None, "IMPORT-MIXED-METADATA", "STATION_CALLSIGN"), ("mixed", None, "IMPORT-MIXED-METADATA", "BAND"),
        ("mixed", None, "IMPORT-STATION", "STATION_CALLSIGN"), ("mixed", None, "IMPORT-SCORE", ""), ("mixed", 1, "IMPORT-POINTS", "QSO_POINTS"), ("mixed", 1, "IMPORT-EDI-SERIAL", "SRX"),
        ("mixed", 1, "IMPORT-EDI-RST", "RST_SENT"), ("mixed", 1, "IMPORT-EDI-GRID", "GRIDSQUARE"), ("mixed", 1, "invalid-number", "QSO_POINTS"), ("mixed", 1, "invalid-report", "RST_SENT"),
    }
    bare = codes(exports.gated(rows.where("path = 'good'"), "cabrillo"))
    assert bare == {("good", None, "IMPORT-UTC", "TIME_ON"), ("good", None, "IMPORT-CONTEST", "CONTEST")}
    assert codes(exports.gated(rows.where("path = 'good'"), "csv")) == set()


def test_records_and_heads(spark):
    rows, heads = made(spark)
    lines = lambda f: {(r.path, r.nth): r.line for r in exports.export(rows, f, heads).collect()}
    assert lines("edi") == {("good", 1): "240106;1238;Q3M;1;59;001;59;017;;KK12BB;120;;;;", ("good", 2): "240106;1239;Q7WW/P;2;599;002;599;1234;;KK22;7;;;;"}
    assert set(lines("adif")) == {("good", 1), ("good", 2), ("digital", 1)}
    assert lines("cabrillo")["good", 2].split() == "QSO: 144 CW 2024-01-06 1239 Q1AB 599 2 Q7WW/P 599 1234".split()
    assert lines("csv")["digital", 1].endswith("\"20240106,1238,144.174,FT8,Q1AB,Q3M,59,1,59,17,,1,=x\",{}") and "'=x" in lines("csv")["digital", 1]
    head = {r.path: r.head for r in exports.heads(rows, "edi", heads).collect()}["good"].split("\n")
    assert head[:6] == ["[REG1TEST;1]", "TName=SPRING", "TDate=20240106;20240106", "PCall=Q1AB", "PWWLo=KK11AA", "PBand=144 MHz"] and head[-1] == "[QSORecords;2]" and "CToSc=127" in head


def test_losses(spark):
    rows, heads = made(spark)

    def lost(format):
        found = exports.losses(rows, exports.export(rows, format, heads), format, heads)
        return {(r.path, r.nth, r.field, r.kind, r.source, r.written) for r in found.collect()}

    assert lost("adif") == set()
    assert lost("csv") == {("digital", 1, "COMMENT", "changed", "=x", "'=x")}
    assert lost("edi") == {
        ("good", 1, "FREQ", "lost", "144.3", ""), ("good", 2, "FREQ", "lost", "144.05", ""), ("good", 1, "COMMENT", "lost", "a;b", ""), ("good", 2, "TIME_ON", "changed", "123930", "1239"),
        ("good", 1, "STX", "changed", "1", "001"), ("good", 1, "SRX", "changed", "17", "017"), ("good", 2, "STX", "changed", "2", "002"),
    }
    assert {x for x in lost("cabrillo") if x[0] == "digital"} == {
        ("digital", 1, "FREQ", "changed", "144.174", "144"), ("digital", 1, "MODE", "changed", "FT8", "DG"), ("digital", 1, "QSO_POINTS", "lost", "1", ""), ("digital", 1, "COMMENT", "lost", "=x", ""),
    }


def test_empty_import(spark):
    rows, heads = made(spark)
    none = rows.limit(0)
    assert exports.export(none, "edi", heads).count() == exports.gated(none, "edi", heads).count() == 0
    blank = rows.where("path = 'good' and nth = 1").withColumn("values", F.lit(None).cast("map<string,string>"))
    assert ("good", None, "IMPORT-EMPTY", "") in codes(exports.gated(blank, "adif", heads))


TABS = "Date\tTime\tFreq\tMode\tCall\tComment\n20240106\t1238\t14.05\tCW\tQ3M\ta 5\" disc\n20240106\t1239\t14.05\tCW\tQ7WW\tnone\n"
LINES = 'Date,Time,Freq,Mode,Call,Comment\n20240106,1238,14.05,CW,Q3M,"two\nlines"\n20240106,1239,14.05,,Q7WW,x\n'


def test_recovery(spark):
    files = spark.createDataFrame([("tabs", TABS), ("lines", LINES), ("fine", TABS.replace('"', "")), ("none", None)], "path string, text string")
    heads = spark.createDataFrame([(n, True, None, None, None, None, None, None, None) for n in ("tabs", "lines", "fine")], META)
    found = {r.path: r for r in recovery.recover(files, "adif", heads).collect()}
    assert set(found) == {"tabs", "lines", "fine"}
    tabs, lines, fine = found["tabs"], found["lines"], found["fine"]
    assert (tabs.selected, tabs.reason, tabs.errors) == ("whitespace", "validated", 0) and [(t.candidate, t.errors, t.rejected) for t in tabs.tried] == [("delimiter-0", 1, False), ("whitespace", 0, False)]
    assert (lines.selected, lines.reason) == ("delimiter-2", "review-required") and lines.errors == 2 and any(t.rejected for t in lines.tried) and len(lines.tried) == 4
    assert (fine.selected, fine.reason, len(fine.tried)) == ("delimiter-0", "validated", 1)
    locked = {r.path: r for r in recovery.recover(files, "adif", heads, locked="delimiter-0").collect()}
    assert (locked["tabs"].selected, locked["tabs"].reason, locked["tabs"].errors) == ("delimiter-0", "user-mapping-locked", 1)
    assert len({r.path: r for r in recovery.recover(files, "adif", heads, attempts=1).collect()}["tabs"].tried) == 1


def test_recovery_reads_once(spark, monkeypatch):
    """Contacts are made once, and of the interpretations only that cover the records of the first one."""
    seen, contacts = [], guided.contacts
    monkeypatch.setattr(guided, "contacts", lambda session, **options: seen.append({r.path for r in session.select("path").collect()}) or contacts(session, **options))
    files = spark.createDataFrame([("tabs", TABS), ("lines", LINES), ("fine", TABS.replace('"', "")), ("none", None), ("empty", "")], "path string, text string")
    heads = spark.createDataFrame([(n, True, None, None, None, None, None, None, None) for n in ("tabs", "lines", "fine")], META)
    found = recovery.recover(files, "adif", heads)
    rows = {r.path: r for r in found.collect()}
    rejected = {f"{r.path}{recovery.MARK}{t.candidate}" for r in rows.values() for t in r.tried if t.rejected}
    assert len(seen) == 1 and rejected and not seen[0] & rejected
    assert {"tabs\x1fdelimiter-0", "tabs\x1fwhitespace", "lines\x1fdelimiter-2"} <= seen[0]
    assert (rows["empty"].selected, rows["empty"].errors, rows["empty"].reason) == (rows["empty"].tried[0].candidate, 1, "review-required")


def test_tallies(spark):
    """The findings of each file are those of gated(), for each format, with rows that repeat, lack or mistake something."""
    head = "Date,Time,Freq,Mode,Call,Grid,Comment\n"
    line = "20240106,1238,14.05,CW,Q3M,KK12,a\n"
    texts = {
        "good": head + line, "twice": head + line * 3 + line.replace("Q3M", "Q7WW") * 2, "bad": head + line.replace("Q3M", "NOCALL") * 2 + line.replace("CW", "") + line.replace("\n", ",x,y\n"),
        "other": head + line, "short": head + line + "20240106,1239,14.05,CW,Q7WW\n",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    session = guided.sessions(files).localCheckpoint()
    heads = spark.createDataFrame([(n, n != "bad", "X", "Q1AB", "KK11AA", None, "supplied-points", None, None) for n in ("good", "twice", "bad", "short")], META)
    whole, single = guided.contacts(session).localCheckpoint(), guided.contacts(session, repeats=False).localCheckpoint()
    for format in exports.FORMATS:
        for metadata in (heads, None):
            want = {path: [0, 0] for path in texts}
            for r in exports.gated(whole, format, metadata).collect():
                want[r.path][r.severity == "warning"] += 1
            tallied = {path: [0, 0] for path in texts} | {r.path: [r.errors, r.warnings] for r in exports.tallied(single, format, metadata).collect()}
            assert tallied == want, (format, metadata)
    assert want["twice"][1] == 3 and want["bad"][1] == 1
