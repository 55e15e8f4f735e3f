"""Edits of small imports, recipes replayed on other files, the lineage of values and the report."""

import json

import pytest
from pyspark.sql import functions as F
from qsolake.operators import workspace
from qsolake.operators.workspace import Add, Join, Mapping, Recipe, Split
from qsolake.sources import guided

HEAD = "Date\tTime\tCall\tFreq\tMode\tExchange"
LINES = {
    "one": f"{HEAD}\n20260906\t1200\tQ3M\t144.3\tSSB\t001 KK11AA Portable",
    "two": f"{HEAD}\n20260907\t12:01\tq7ww\t144300\tUSB\t002 KK22BB Home station\n20260907\t1202\tQ3M\t144.3\tSSB",
    "other": "Date\tTime\tCall\tFreq\tMode\n20260906\t1200\tQ3M\t144.3\tSSB",
    "none": "",
}
STEPS = (Split(5, " ", 3), Join((7, 6)), Add())
RECIPE = Recipe(
    ("date", "time", "call", "freq", "mode", "exchange"),
    STEPS,
    (
        Mapping("Date", "QSO_DATE"), Mapping("Time", "TIME_ON"), Mapping("Call", "CALL"), Mapping("Freq", "FREQ"), Mapping("Mode", "MODE"),
        Mapping("Serial", "STX"), Mapping("Rest", "COMMENT"), Mapping("Operator", "OPERATOR", constant="q1op"),
    ),
)


def sessions(spark, names=tuple(LINES)):
    files = spark.createDataFrame([(n, LINES[n]) for n in names], "path string, text string")
    picked = guided.interpretations(files).where("candidate = 'delimiter-0'")
    return guided.sessions(files, picked)


def cells(df):
    return {(r.path, x.nth): (x.cells, x.originals) for r in df.select("path", "rows").collect() for x in r.rows if x.kind == "qso"}


def lineage(df, **kw):
    return {(r.path, r.nth, x.field): x for r in guided.contacts(df, lineage=True, **kw).collect() for x in r.lineage}


def test_replay_equals_single_steps(spark, tmp_path):
    def written(df):
        """Each edit's result as a table, as a chain of them plans slowly."""
        path = str(tmp_path / f"s{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    base = written(sessions(spark))
    step = base.where("path IN ('one', 'two')")
    for s in STEPS:
        step = written(workspace.edit(step, s))
    for i, name, field in ((5, "Serial", "STX"), (6, "Rest", "COMMENT"), (7, "Operator", "OPERATOR")):
        step = workspace.map_column(written(step), i, name=name, field=field, **({"constant": "q1op"} if field == "OPERATOR" else {}))
    step, done = written(step), written(workspace.replay(base, RECIPE))
    both = {k: v for k, v in cells(done).items() if k[0] in ("one", "two")}
    assert both == cells(step)
    assert both["one", 1] == (["20260906", "1200", "Q3M", "144.3", "SSB", "001", "KK11AA Portable", ""], ["20260906", "1200", "Q3M", "144.3", "SSB", "001 KK11AA Portable", "001 KK11AA Portable | 001 KK11AA Portable", ""])
    assert both["two", 1][0][5:] == ["002", "KK22BB Home station", ""] and both["two", 2][0][5:] == ["", "", ""]
    values = lambda df: {(r.path, r.nth): r["values"] for r in guided.contacts(df).collect() if r.path in ("one", "two")}
    assert values(done) == values(step) and values(done)["two", 1]["OPERATOR"] == "Q1OP" and values(done)["two", 1]["COMMENT"] == "KK22BB Home station"
    notice = {r.path: r.notice for r in done.collect()}
    assert notice == {"one": "applied", "two": "applied", "other": "columns-differ", "none": "columns-differ"}
    left = {r.path: (r.columns, r.rows) for r in base.collect()}
    assert all((r.columns, r.rows) == left[r.path] for r in done.where("notice <> 'applied'").collect())
    assert {r.path: r.notice for r in workspace.replay(done.drop("notice"), RECIPE).collect()}["one"] == "columns-differ"


def test_recipes_are_refused_before_reading(spark):
    wrong = {
        "there is no column 6": RECIPE._replace(steps=(Split(6, " ", 2),)), "separator is empty": RECIPE._replace(steps=(Split(0, "", 2),)), "two columns or more": RECIPE._replace(steps=(Split(0, " ", 1),)),
        "two different": RECIPE._replace(steps=(Join((1, 1)),)), "joined column is missing": RECIPE._replace(steps=(Join((5, 6)),)), "no known kind": RECIPE._replace(steps=("add",)),
        "the steps give 7": RECIPE._replace(steps=(Add(),)), "no columns to begin": RECIPE._replace(base=()), "column 6: its settings": RECIPE._replace(columns=(*RECIPE.columns[:5], Mapping("x", "low"), *RECIPE.columns[6:])),
    }
    for text, recipe in wrong.items():
        assert text in "; ".join(workspace.faults(recipe))
        with pytest.raises(ValueError, match=text):
            workspace.replay(None, recipe)  # nothing is read
    assert workspace.from_json(workspace.to_json(RECIPE)) == RECIPE
    for text in ("{}", "[]", "null", '{"base":["a"],"steps":[{"kind":"drop"}],"columns":[]}', '{"base":["a"],"steps":[{"kind":"add","x":1}],"columns":[]}', "{"):
        with pytest.raises(ValueError):
            workspace.from_json(text)


def test_lineage(spark):
    base = sessions(spark, ("two",))
    was = lineage(base)
    assert (was["two", 1, "TIME_ON"].changes, was["two", 1, "TIME_ON"]["class"]) == (["time"], "lossless-normalization")
    assert (was["two", 1, "FREQ"].original, was["two", 1, "FREQ"].value, was["two", 1, "FREQ"]["class"]) == ("144300", "144.3", "suggested-repair")
    assert (was["two", 1, "MODE"].changes, was["two", 1, "SUBMODE"].changes, was["two", 1, "SUBMODE"].value) == (["mode:USB"], ["mode:USB", "submode"], "USB")
    assert (was["two", 1, "BAND"].column, was["two", 1, "BAND"].place, was["two", 2, "FREQ"]["class"]) == ("derived", None, "preserved")
    edits = spark.createDataFrame([("two", 1, 2, "Q8AA"), ("two", 1, 2, None), ("two", 2, 0, "6.9.2026"), ("two", 9, 0, "x"), ("two", 1, 99, "x"), (None, 1, 1, "x")], "path string, nth int, place int, value string")
    now = lineage(workspace.change_cells(base, edits))
    call, date = now["two", 1, "CALL"], now["two", 2, "QSO_DATE"]
    assert (call.original, call.value, call.changes, call["class"]) == ("q7ww", "Q8AA", ["edited"], "user-supplied")
    assert (date.original, date.value, date["class"]) == ("20260907", "6.9.2026", "ambiguous")
    fixed = lineage(workspace.map_column(workspace.change_cells(base, edits), 0, date_order="dmy"))["two", 2, "QSO_DATE"]
    assert (fixed.value, fixed.changes, fixed["class"]) == ("20260906", ["edited", "date"], "user-supplied")
    twice = lineage(workspace.map_column(base, 5, field="CALL"))
    assert twice["two", 1, "CALL"]["class"] == "ambiguous"
    with pytest.raises(ValueError):
        workspace.map_column(base, 0, colour="red")


def test_widths_and_awkward_edits(spark):
    base = sessions(spark)
    assert (workspace.split_width(base, 5, " "), workspace.split_width(base, 77, ","), workspace.split_width(base.limit(0), 0, ",")) == (4, 1, 1)
    dots = workspace.edit(base.where("path = 'one'"), Split(3, ".", 2))
    assert cells(dots)["one", 1][0][3:5] == ["144", "3"]
    assert cells(workspace.edit(base, Split(5, " ", 2)))["other", 1] == cells(base)["other", 1]
    assert workspace.replay(base.limit(0), RECIPE).count() == 0
    narrow = base.where("path = 'one'").withColumn("columns", F.slice("columns", 1, 4))  # two cells beyond the columns
    assert cells(workspace.edit(narrow, Join((0, 1))))["one", 1][0] == ["20260906 1200", "Q3M", "144.3", "SSB", "001 KK11AA Portable"]
    with pytest.raises(ValueError):
        workspace.edit(base, Join((1,)))


def test_report(spark):
    done = workspace.replay(sessions(spark, ("one", "none")), RECIPE)
    made = {(r.path, r.nth): json.loads(r.line) for r in workspace.report(done, recipe=RECIPE).collect()}
    assert set(made) == {("one", None), ("one", 1), ("none", None)}
    head, contact = made["one", None], made["one", 1]
    assert workspace.from_json(head["recipe"]) == RECIPE and [c["field"] for c in head["columns"]][5:] == ["STX", "COMMENT", "OPERATOR"] and head["rows"][0]["kind"] == "header"
    assert contact["values"]["STX"] == "001" and {x["field"]: x["class"] for x in contact["lineage"]}["OPERATOR"] == "user-supplied" and contact["original"] == LINES["one"].split("\n")[1]
