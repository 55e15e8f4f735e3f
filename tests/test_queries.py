"""Every query that has SQL gives the rows of that SQL."""

import math
from collections import Counter

import duckdb
import pytest

from qsolake import edit_queries, export_queries, import_queries, log_queries, queries, rule_queries, text_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
MADE = queries.QUERIES | log_queries.QUERIES | import_queries.QUERIES | export_queries.QUERIES | edit_queries.QUERIES | rule_queries.QUERIES | text_queries.QUERIES
SQL = queries.ORACLES | log_queries.ORACLES | import_queries.ORACLES | export_queries.ORACLES | edit_queries.ORACLES | rule_queries.ORACLES | text_queries.ORACLES


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", SQL)
def test_rows(spark, con, name):
    made = MADE[name](spark, SF)
    cur = con.execute(SQL[name])
    columns = sorted(d[0] for d in cur.description)
    assert sorted(made.columns) == columns
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in made.collect()) == want


@pytest.mark.parametrize("name", sorted(set(MADE) - set(SQL)))
def test_runs(spark, name):
    assert MADE[name](spark, SF).count() > 0
