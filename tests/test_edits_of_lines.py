"""Layouts, repairs, QTCs and duplicates on small and awkward input."""

import pytest
from pyspark.sql import functions as F

from qsolake.operators import cabrillo_lines, contacts, qtcs
from qsolake.operators.components import components
from qsolake.plans import synth

LOGS = "path string, text string"


def logs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], LOGS)


def test_layout_names(spark):
    more = spark.createDataFrame([("A", 1, [], [("CALL", 5)]), ("A-CW", 2, [], []), ("DARC-WAEDC-CW", 1, [], [])], cabrillo_lines.LAYOUT)
    got = {r.contest: r.layout.minimum_length for r in cabrillo_lines.layout_table(spark, more).collect()}
    assert (got["A"], got["A-CW"], got["A-SSB"], got["DARC-WAEDC-CW"]) == (1, 2, 1, 79)


def test_contacts_of_awkward_logs(spark):
    found = cabrillo_lines.contest_contacts(logs(spark, None, "", "CONTEST:\nQSO:", "contest: darc-waedc-ssb\n\tX-qso: 14050 PH d t me 59 1 you 59 2", "X-QSO: 7050 CW"), cabrillo_lines.layout_table(spark))
    rows = [(r.path, r.contest, r.line_no, r.excluded, r.frequency, r.call, r.sent_exchange, r.received_exchange) for r in found.orderBy("path").collect()]
    assert rows == [("2", "", 2, False, "", "", "", ""), ("3", "DARC-WAEDC-SSB", 2, False, "14050", "YOU".lower(), "1", "2"), ("4", "GENERIC-CONTEST", 1, True, "7050", "", "", "")]


@pytest.mark.parametrize("line", ["a\tb", "\t", "12345678\tx", "1234567\t\ty", "no tab", "é😀\tz"])
def test_tabs(spark, line):
    assert spark.createDataFrame([(line,)], "l string").select(cabrillo_lines.tabs_expanded(F.col("l"))).head()[0] == line.expandtabs(8)


def test_repairs_settle(spark):
    text = "START-OF-LOG: 3.0 \r\nCONTEST: ANY\r\n\r\nX-QSO: 7.05 usb 20260101 1:05 K1A 59 1 K2B 59 2\nsoap\tbox\r"
    given, table = logs(spark, text, None, ""), cabrillo_lines.layout_table(spark)
    found = cabrillo_lines.repairs(given, table)
    done = cabrillo_lines.apply_repairs(given, found)
    got = {r.path: r.text for r in done.collect()}
    assert got["1"] is None and got["2"] == ""
    assert got["0"] == "START-OF-LOG: 3.0\r\nCONTEST: ANY\r\n\r\nX-QSO:  7050  PH 2026-01-01 0105 K1A           59  1      K2B           59  2\nsoap    box\r".replace("X-QSO:  ", "X-QSO: ")
    assert cabrillo_lines.repairs(done, table).count() == 0
    assert {r.state for r in cabrillo_lines.repair_states(done, found).collect()} == {"stale"}


def test_changes_of_lines(spark):
    changes = spark.createDataFrame([("0", 1, "a", "b\nc"), ("0", 2, "x", "y"), ("0", 2, "x", "y"), ("0", 3, "", "new"), ("9", 1, "a", "b")], "path string, line_no int, before string, after string")
    given = logs(spark, "a\nx\n")
    assert {(r.path, r.line_no, r.state) for r in cabrillo_lines.repair_states(given, changes).collect()} == {("0", 1, "lines"), ("0", 2, "applied"), ("0", 3, "missing"), ("9", 1, "missing")}
    assert [r.text for r in cabrillo_lines.apply_repairs(given, changes).collect()] == ["a\ny\n"]


def test_qtcs_of_awkward_logs(spark):
    given = logs(spark, None, "", "CONTEST: DARC-WAEDC-CW\nQTC:\nQTC: 1", "CONTEST: OTHER\nQTC:")
    assert [r.n for r in qtcs.qtc_counts(given).orderBy("path").collect()] == [2, 1]
    found = qtcs.check_qtcs(given, synth.countries(spark))
    assert {r.path for r in found.select("path").collect()} == {"2"}
    codes = {r.code for r in found.where("line_no = 2").collect()}
    assert codes == {"QTC-FREQUENCY", "QTC-MODE", "QTC-DATE", "QTC-TIME", "QTC-QSO-TIME", "QTC-CALL", "QTC-SERIAL", "QTC-GROUP"}


def test_every_qtc_code_is_planted(spark):
    from qsolake import edit_queries

    found = {r.code for r in edit_queries.check_qtc(spark, "/root/testdata/sf0.001").select("code").distinct().collect()}
    assert found == {
        "WAEDC-QSO-MODE", "WAEDC-STX", "WAEDC-SRX", "QTC-FREQUENCY", "QTC-MODE", "QTC-DATE", "QTC-TIME", "QTC-QSO-TIME", "QTC-CALL", "QTC-SERIAL", "QTC-GROUP", "QTC-RETURN",
        "QTC-REPORTED-TWICE", "QTC-CONTINENT", "QTC-RECEIVER-EU", "QTC-SENDER-DX", "QTC-SERIES-SIZE", "QTC-SERIES-METADATA", "QTC-PAIR-LIMIT",
    }


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(70, 60), (70, 80), (5, 5), (None, 3), (60, 70), (90, 90)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "first long, second long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 60: 60, 70: 60, 80: 60}
    assert components(spark.createDataFrame([], "first string, second string")).count() == 0


def test_candidates_of_awkward_records(spark):
    rows = [(1, None), (2, {}), (3, {"CALL": "k1a", "QSO_DATE": "20260101", "TIME_ON": "1200", "X": "1"}), (4, {"CALL": " K1A ", "QSO_DATE": "20260101", "TIME_ON": "120030", "Y": ""}),
            (5, {"CALL": "K1A", "QSO_DATE": "20260101", "TIME_ON": "12"}), (6, {"CALL": "K1A", "QSO_DATE": "20260101", "TIME_ON": "1206"})]
    found = contacts.duplicate_candidates(spark.createDataFrame(rows, "id int, fields map<string,string>"))
    assert [(r.first, r.second, r.kind, r.differing) for r in found.collect()] == [(3, 4, "lotw", ["CALL", "TIME_ON", "X"])]
