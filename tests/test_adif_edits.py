"""Edits of ADIF files change the bytes of their tags alone."""

import pytest

from qsolake.operators import adif_edits

EDITS = "path string, record int, name string, value string, nth int"


def patched(spark, texts, edits):
    logs = spark.createDataFrame(list(texts.items()), "path string, text string")
    return {r.path: r.text for r in adif_edits.patch_adif(logs, spark.createDataFrame(edits, EDITS)).collect()}


@pytest.mark.parametrize("text", ["", "no tag", "<EOH>", "<eor>", "x<EOH><call:3>Q1A<eor>\n<eor> \r\n tail <call:2>Q2", "<call:90>Q1A <EOR>", "﻿😀<eoh>\r\n<A:2>😀<EOR>"])
def test_parts_give_the_text(spark, text):
    p = spark.createDataFrame([(text,)], "text string").select(adif_edits.adif_parts(adif_edits.F.col("text")).alias("p")).head().p
    assert p.header + "".join(r.body + r.end for r in p.records) + p.tail == text


def test_only_named_bytes_change(spark):
    texts = {"a": "head <EOH>\n<call:3:S>Q1A - <x:1>y<eor>\n<eor><CALL:3>Q2B< EOR >tail", "b": "<call:3>Q1A<eor>", "c": None, "d": ""}
    edits = [("a", 1, "Call", "Q10😀", 1), ("a", 3, "qth", None, 2), ("a", 2, "call", "lost", 3), ("a", 4, "call", "lost", 4), ("d", 1, "call", "lost", 5), ("c", 1, "call", "lost", 6)]
    assert patched(spark, texts, edits) == {
        "a": "head <EOH>\n<CALL:5:S>Q10😀 - <x:1>y<eor>\n<eor><CALL:3>Q2B<QTH:0> < EOR >tail", "b": texts["b"], "c": None, "d": "",
    }
    logs = spark.createDataFrame(list(texts.items()), "path string, text string")
    refused = adif_edits.refused_edits(logs, spark.createDataFrame([*edits, ("b", 1, "EOR", "", 7), ("b", 1, "Q", "<EOR>", 8), ("b", 1, None, "", 9)], EDITS))
    assert {(r.nth, r.reason) for r in refused.collect()} == {(3, "record"), (4, "record"), (5, "record"), (6, "record"), (7, "name"), (8, "marker"), (9, "name")}


def test_edits_of_one_tag(spark):
    edits = [("a", 1, "x", "1", 2), ("a", 1, "X ", "22", 3), ("a", 1, "x", "0", 1), ("a", 1, "b", "", 5), ("a", 1, "a", "", 9), ("a", 1, "b", "3", 10)]
    assert patched(spark, {"a": "<x:1>a<X:1>b <call:2>c😀<eor>".encode("utf-16", "surrogatepass").decode("utf-16")}, edits) == {
        "a": "<X:2>22<X:2>22 <call:2>c😀<B:1>3 <A:0> <eor>"
    }


def test_no_edits(spark):
    assert patched(spark, {"a": "<x:1>a<eor>"}, []) == {"a": "<x:1>a<eor>"}
