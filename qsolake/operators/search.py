"""Finding and replacing text in lines, with patterns that Spark's expressions take."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.sources.logs import LINE_END, lines

LONGEST = 500
NESTED = re.compile(r"(?:\([^)]*[+*][^)]*\)|\[[^\]]+\])[+*{]")


def pattern(query: str, *, regex: bool = False, whole_word: bool = False, match_case: bool = False) -> str:
    """The pattern of a query; one that is empty, too long or has nested repeats is an error."""
    if not query or len(query) > LONGEST:
        raise ValueError("a query has 1 to 500 characters")
    if regex and NESTED.search(query):
        raise ValueError("nested repeats aren't allowed")
    body = query if regex else "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in query)
    body = f"\\b(?:{body})\\b" if whole_word else body
    return body if match_case else f"(?i){body}"


def count_matches(text: Column, query: str, **options) -> Column:
    return F.regexp_count(text, F.lit(pattern(query, **options)))


def find_all(logs: DataFrame, query: str, text_col: str = "text", **options) -> DataFrame:
    """The keys of logs, line_no, column (from 1) and value of every match within a line."""
    p = pattern(query, **options)
    keys = [c for c in logs.columns if c != text_col]
    hits = lines(logs, text_col).where(F.col("raw").rlike(p))
    found = hits.withColumn("_found", F.regexp_extract_all("raw", F.lit(f"({p})"), F.lit(1))).withColumn("_between", F.split("raw", p, -1))
    length = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    out = found.select(*keys, "line_no", "_found", "_between", F.posexplode("_found").alias("_i", "value")).where("value <> ''")
    return out.select(*keys, "line_no", (length("_between", F.col("_i") + 1) + length("_found", F.col("_i")) + 1).alias("column"), "value")


def replace_all(text: Column, query: str, replacement: str, **options) -> Column:
    """Every match replaced; the replacement of a query that isn't a pattern is taken as it is."""
    if not options.get("regex"):
        replacement = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, pattern(query, **options), replacement)


def line_endings(text: Column, newline: str) -> Column:
    return F.regexp_replace(text, LINE_END, newline)


# Characters that look like blanks or like nothing.
BLANKS = "               　"
HIDDEN = "​‌‍⁠﻿"


def clean_blanks(text: Column) -> Column:
    """Odd blanks as plain ones, and hidden characters gone."""
    return F.translate(text, BLANKS + HIDDEN, " " * len(BLANKS))


def count_odd_blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, BLANKS + HIDDEN, ""))
