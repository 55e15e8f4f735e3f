import pytest
from pyspark.sql import functions as F

from qsolake.operators import checks, search, table
from qsolake.sources import logs, writers
from qsolake.streaming import contacts as streams

CABRILLO = "START-OF-LOG: 3.0\r\nCALLSIGN: K2BB\r\nCONTEST: ANY\r\n\r\n; note\r\nQSO: 14050 CW 2026-09-06 1238 K2BB 599 001 DL1AA 599 232\r\nx-qso: 7050 PH 2026-09-06 1239 K2BB 59\r\nQTC: x\r\nwhat\r\nEND-OF-LOG:\r\n"
EDI = "[REG1TEST;1]\nTName=A\nTDate=20260906;20260906\nPCall=K9QQX\nPWWLo=EN52AB\nPBand=144 MHz\ntname=B\n[Remarks]\nX=Y\n[QSORecords;2]\n260906;1238;S53O;1;59;001;59;232;;JN86AT;16;;;;\n260906;2538;;1;59;002;59;233;;ZZ;x;;;\n[END;any]\n"


def one(spark, text):
    return spark.createDataFrame([(1, text)], "log long, text string")


def test_cabrillo_lines(spark):
    rows = logs.cabrillo_lines(one(spark, CABRILLO)).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["header"] * 3 + ["blank", "comment", "qso", "qso", "qtc", "unknown", "header"]
    assert [(r.key, r.value) for r in rows][1] == ("CALLSIGN", "K2BB")
    made = logs.cabrillo_contacts(one(spark, CABRILLO)).orderBy("line_no").collect()
    assert (made[0].CALL, made[0].SRX_STRING, made[0].excluded) == ("DL1AA", "232", False)
    assert (made[1].RST_SENT, made[1].CALL) == ("59", "")
    assert logs.cabrillo_contacts(one(spark, None)).count() == 0


def test_fixed_columns(spark):
    fields = {"FREQUENCY": F.lit("14050"), "MODE": F.lit("CW"), "QSO_DATE": F.lit("2026-09-06"), "TIME_ON": F.lit("1238"), "MY_CALL": F.lit("K2BB"), "CALL": F.lit("DL1AA")}
    line = spark.range(1).select(writers.cabrillo_line(fields, F.lit(True)).alias("raw"))
    layout = (("MY_CALL", 13), ("RST_SENT", 3), ("STX", 6), ("CALL", 13))
    got = line.select(logs.cabrillo_fields(F.col("raw"), layout).alias("f")).select("f.*").first()
    assert (got.FREQUENCY, got.MY_CALL, got.RST_SENT, got.CALL) == ("14050", "K2BB", "", "DL1AA")


def test_check_cabrillo(spark):
    found = {(r.line_no, r.code) for r in checks.check_cabrillo(one(spark, CABRILLO)).collect()}
    assert found == {(7, "QSO-CALL-EMPTY"), (7, "QSO-EXCHANGE")}
    bare = {r.code for r in checks.check_cabrillo(one(spark, "QSO: x y z")).collect()}
    assert {"CAB-START", "CAB-END", "CAB-HEADER-REQUIRED", "QSO-DATE", "QSO-TIME", "QSO-MODE", "QSO-FREQUENCY"} <= bare


def test_edi(spark):
    made = logs.edi_contacts(one(spark, EDI)).orderBy("line_no").collect()
    assert [(r.line_no, r.CALL, r.n_fields) for r in made] == [(11, "S53O", 15), (12, "", 14)]
    assert logs.edi_headers(one(spark, EDI)).first().headers == {"TNAME": "A", "TDATE": "20260906;20260906", "PCALL": "K9QQX", "PWWLO": "EN52AB", "PBAND": "144 MHz"}
    found = {(r.line_no, r.code) for r in checks.check_edi(one(spark, EDI)).collect()}
    assert found == {(12, f"EDI-{c}") for c in ("FIELD-COUNT", "QSO-TIME", "QSO-CALL", "QSO-WWL", "QSO-POINTS")}


def test_adif_lengths_rule(spark):
    text = "<CALL:4>no <EOH> <call:4>K2BB<COMMENT:9:M><MODE:2>x <MODE:2>CW<EOR>\n<APP_X:2>\U0001f600<QSO_DATE:8>20260906<eor><CALL:2>zz"
    rows = logs.adif_records(one(spark, text)).orderBy("record").collect()
    assert [[(t.name, t.value, t.type) for t in r.tags] for r in rows] == [
        [("CALL", "K2BB", None), ("COMMENT", "<MODE:2>x", "M"), ("MODE", "CW", None)],
        [("APP_X", "\U0001f600", None), ("QSO_DATE", "20260906", None)],
    ]
    again = logs.adif_records(one(spark, text)).select(F.col("record").alias("log"), writers.adif_from_tags("tags").alias("text"))
    assert [r.tags for r in logs.adif_records(again).orderBy("log").collect()] == [r.tags for r in rows]
    assert {r.code for r in checks.check_adif(logs.adif_records(one(spark, text)), ["log"]).collect()} >= {"ADIF-DATE", "ADIF-CALL-EMPTY"}


def test_adx(spark):
    text = '<ADX><HEADER/><RECORDS><RECORD><CALL>K2BB</CALL><APP PROGRAMID="x" FIELDNAME="y" TYPE="N">1 &amp; 2</APP></RECORD><RECORD/></RECORDS></ADX>'
    rows = logs.adx_records(one(spark, text)).collect()
    assert [(t.name, t.value, t.type) for t in rows[0].tags] == [("CALL", "K2BB", None), ("APP_X_Y", "1 & 2", "N")]
    for bad in ("<ADX>", '<!DOCTYPE a [<!ENTITY b "c">]><ADX>&b;</ADX>'):
        assert logs.adx_records(one(spark, bad)).first().error


def test_long_adx(spark, monkeypatch):
    monkeypatch.setattr(logs, "ADX_CHUNK", 64)
    record = "<RECORD><CALL>K{0}BB</CALL><COMMENT>\U0001f600 {0} &lt;</COMMENT><USERDEF FIELDNAME='z'>{0}</USERDEF></RECORD>\n"
    text = "\ufeff<ADX><RECORDS>" + "".join(record.format(i) for i in range(700)) + "<RECORD/></RECORDS>"
    found = [list(scanned) for scanned in logs.scan_adx(memoryview((text + "</ADX>").encode()))]
    assert max(map(len, found)) < 3  # records leave while the document is read
    assert [t["value"].as_py() for tags in found for r in tags for t in r if t["name"].as_py() == "USERDEF_Z"] == [str(i) for i in range(700)]
    files = spark.createDataFrame([(1, "good", text + "</ADX>"), (2, "cut", text), (3, None, "<ADX/>"), (4, "null", None)], "n int, name string, text string")
    read = logs.adx_records(files)
    # No row holds the records of its whole document beside its own, as a generator's do.
    assert "Generate" not in read._jdf.queryExecution().toString()
    rows = {(r.n, r.name, r.record): r for r in read.collect()}
    assert set(rows) == {(1, "good", i) for i in range(1, 702)} | {(2, "cut", None), (4, "null", None)}
    assert [tuple(t) for t in rows[1, "good", 700].tags] == [("CALL", "K699BB", None), ("COMMENT", "\U0001f600 699 <", None), ("USERDEF_Z", "699", None)] and rows[1, "good", 701].tags == []
    assert all(r.error is None for r in rows.values() if r.record) and rows[2, "cut", None].tags is None and rows[2, "cut", None].error.startswith("no element found") and rows[4, "null", None].error


def test_decoding(spark, tmp_path):
    for name, data in {"a": b"\xef\xbb\xbfx", "b": b"\xff\xfex\x00", "c": "é".encode(), "d": b"\xe9 \x80\x81"}.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path[-1]: (r.text, r.encoding) for r in logs.read_logs(spark, str(tmp_path)).collect()}
    assert found == {"a": ("x", "UTF-8 BOM"), "b": ("x", "UTF-16 LE"), "c": ("é", "UTF-8"), "d": ("é €\x81", "Windows-1252")}


def test_formats(spark):
    rows = [("QSO: x", ""), (EDI, ""), ("<ADX>", ""), ("<eoh>", ""), ("x", "a.edi"), ("x", "a.ADI"), ("x", "a.cbr"), ("CONTEST: x", "a.log"), ("x", "a.log"), ("", "")]
    made = spark.createDataFrame(rows, "text string, name string").select(logs.detect_format(F.col("text"), F.col("name")).alias("f")).collect()
    assert [r.f for r in made] == ["cabrillo", "edi", "adif", "adif", "edi", "adif", "cabrillo", "cabrillo", "text", "text"]


@pytest.mark.parametrize("text, found", [("a;b\nc;d\n", ";"), ("a\tb;c;d\n1\t2\n", "\t"), ("ab\ncd\n", ""), ("a,b", ","), ("", "")])
def test_delimiter(spark, text, found):
    assert one(spark, text).select(logs.detect_delimiter(F.col("text")).alias("d")).first().d == found


def test_tables(spark):
    rows = [(r.row_no, r.cells) for r in logs.table_rows(one(spark, "a;b;c\nd\n;e;\n"), delimiter=F.lit(";")).orderBy("row_no").collect()]
    assert rows == [(1, ["a", "b", "c"]), (2, ["d", "", ""]), (3, ["", "e", ""])]
    assert logs.table_rows(one(spark, "ab\nc")).orderBy("row_no").first().cells == ["a", "b"]
    made = table.align_rows(spark.createDataFrame([(1, 1, ["", "x", ""]), (1, 2, ["y", "", ""]), (1, 3, ["", "z", ""])], "log long, row_no long, cells array<string>"), [0, 1, 2], ["log"])
    assert [r.cells for r in made.orderBy("row_no").collect()] == [["", "x", ""], ["", "y", ""], ["", "z", ""]]
    pasted = table.paste_column(spark.createDataFrame([(1, ["a"]), (2, ["b"])], "row_no long, cells array<string>"), 0, spark.createDataFrame([(2, "v")], "row_no long, value string"))
    assert [r.cells for r in pasted.orderBy("row_no").collect()] == [["a", ""], ["b", "v"]]


def test_search(spark):
    made = search.find_all(one(spark, "ab xAB\n\nab"), "ab").orderBy("line_no", "column").collect()
    assert [(r.line_no, r.column, r.value) for r in made] == [(1, 1, "ab"), (1, 5, "AB"), (3, 1, "ab")]
    assert search.find_all(one(spark, "ab xAB\n\nab"), "ab", whole_word=True, match_case=True).count() == 2
    for bad in ("", "x" * 501):
        with pytest.raises(ValueError):
            search.pattern(bad)
    with pytest.raises(ValueError):
        search.pattern("(a+)+", regex=True)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text(CABRILLO)
    (tmp_path / "in/b.log").write_text(CABRILLO)
    rows = streams.log_folder(spark, str(tmp_path / "in"))
    for name, made, n in (("activity", streams.activity(rows, 60, ["MODE"]), 2), ("firsts", streams.first_contacts(rows, ["CALL"]), 2)):
        mode = "complete" if name == "activity" else "append"
        running = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        running.awaitTermination(120)
        assert spark.table(name).count() == n
    assert spark.table("activity").agg(F.sum("contacts")).first()[0] == 4
