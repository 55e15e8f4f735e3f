"""Edits of ADIF files that leave every byte alone that no edit names.

A file is cut into its header (up to <EOH>), its records (each with its <EOR>) and its tail, whose concatenation is the
file. Only records with edits are scanned for the spans of their tags; new tags are spliced in by span. A record is
numbered as by logs.adif_records. A null text has no parts and stays null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.functions.radio import let, trimmed
from qsolake.sources import logs as source
from qsolake.sources.writers import adif_tag

END = r"<\s*EOR\s*>"
REST = 1 << 30
SPANS = "array<struct<name:string,value:string,type:string,start:int,stop:int>>"


def spans_of(record: Column) -> Column:
    """The tags of a record with start and stop in characters; null for null."""

    @F.pandas_udf(SPANS)
    def run(records: pd.Series) -> pd.Series:
        named = lambda r: [dict(zip(("name", "value", "type", "start", "stop"), t)) for t in source.scan_spans(r)]
        return records.map(lambda r: None if r is None else named(r))

    return run(record)


def adif_parts(text: Column) -> Column:
    """A struct of header, records (array of body and end) and tail."""
    header = F.regexp_extract(text, r"(?is)\A.*?<\s*EOH\s*>", 0)

    def cut(head: Column) -> Column:
        body = F.substring(text, F.length(head) + 1, F.lit(REST))
        whole = F.regexp_extract_all(body, F.lit(f"(?is).*?{END}"), F.lit(0))

        def made(found: Column) -> Column:
            ended = F.transform(found, lambda r: let(F.length(F.regexp_extract(r, f"(?i){END}\\z", 0)), lambda n: F.struct(
                F.substring(r, F.lit(1), F.length(r) - n).alias("body"), F.right(r, n).alias("end"))))
            read = F.aggregate(found, F.lit(0), lambda a, r: a + F.length(r))
            return F.struct(head.alias("header"), ended.alias("records"), F.substring(body, read + 1, F.lit(REST)).alias("tail"))

        return let(whole, made)

    return let(header, cut)


def adif_documents(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """The keys of logs, header, header_tags, n_records (segments up to an <EOR>), tail, newline."""
    keys = [c for c in logs.columns if c != text_col]
    newline = F.coalesce(F.nullif(F.regexp_extract(text_col, "\r\n", 0), F.lit("")), F.nullif(F.regexp_extract(text_col, "[\r\n]", 0), F.lit("")), F.lit("\n"))
    # Rows of one element: a Python function isn't planned over an expression that holds lambdas.
    cut = logs.select(*keys, newline.alias("newline"), F.inline(F.array(adif_parts(F.col(text_col)))))
    out = cut.select(*keys, "header", source.tags_of("header").alias("header_tags"), F.size("records").alias("n_records"), "tail", "newline")
    return out.where(F.size("header_tags") >= 0)  # always so; it keeps the function out of a caller's lambdas


def _normal(edits: DataFrame) -> DataFrame:
    return edits.withColumn("name", F.upper(trimmed(F.col("name")))).withColumn("value", F.coalesce("value", F.lit("")))


def _reason() -> Column:
    """Why an edit can't be read back as it was meant; null if it can."""
    named = F.coalesce(F.col("name").rlike("^[A-Z][A-Z0-9_]*$") & ~F.col("name").isin("EOH", "EOR"), F.lit(False))
    return F.when(~named, "name").when(F.col("value").rlike(r"(?i)<\s*EO[HR]\s*>"), "marker")


def refused_edits(logs: DataFrame, edits: DataFrame, text_col: str = "text") -> DataFrame:
    """The edits that patch_adif leaves out, with reason: name (no tag's name), marker (the value would end the record or
    the header when read again), record (the file has no such record)."""
    keys = [c for c in logs.columns if c != text_col]
    there = source.adif_records(logs, text_col).select(*keys, "record", F.lit(True).alias("_there")).distinct()
    reason = F.coalesce(_reason(), F.when(F.col("_there").isNull(), "record"))
    return _normal(edits).join(there, [*keys, "record"], "left").withColumn("reason", reason).where("reason is not null").drop("_there")


def spliced(body: Column, spans: Column, edits: Column) -> Column:
    """body with the tags that edits (array of name, value) name replaced in place, and those it lacks put at its end."""
    wanted = F.transform(edits, lambda e: e["name"])
    value = lambda name: F.get(F.filter(edits, lambda e: e["name"] == name), F.lit(0))["value"]
    changed = F.filter(spans, lambda s: F.array_contains(wanted, s["name"]))
    added = F.filter(edits, lambda e: ~F.exists(spans, lambda s: s["name"] == e["name"]))

    def joined(tags: Column) -> Column:
        from_ = lambda i: F.coalesce(F.get(tags, i - 1)["stop"], F.lit(0))
        pieces = F.transform(tags, lambda s, i: F.concat(
            F.substring(body, from_(i) + 1, s["start"] - from_(i)), adif_tag(s["name"], value(s["name"]), s["type"])))
        return F.concat(F.array_join(pieces, ""), F.substring(body, from_(F.size(tags)) + 1, F.lit(REST)))

    new = F.array_join(F.transform(added, lambda e: F.concat(adif_tag(e["name"], e["value"]), F.lit(" "))), "")
    return F.concat(let(changed, joined), new)


def patch_adif(logs: DataFrame, edits: DataFrame, text_col: str = "text") -> DataFrame:
    """logs, each text with its edits. edits: the keys of logs (unique there), record, name, value, nth.

    Of several edits of one tag the one with the greatest nth holds (then the greatest value); a tag that a record has
    several times changes each time; one that it lacks goes before its <EOR>, in the order of nth. A null value is empty.
    A file without edits never leaves its row; those of refused_edits change nothing."""
    keys = [c for c in logs.columns if c != text_col]
    valid = _normal(edits).where(_reason().isNull()).groupBy(*keys, "record", "name").agg(F.min("nth").alias("nth"), F.max(F.struct("nth", "value"))["value"].alias("value"))
    of_record = valid.groupBy(*keys, "record").agg(F.sort_array(F.collect_list(F.struct("nth", "name", "value"))).alias("_edits"))
    files = valid.select(*keys).distinct()
    bare = F.struct(F.lit("").alias("body"), F.lit("").alias("end"))
    part = lambda text: F.array(bare.withField("body", text))
    cut = logs.join(files, keys, "left_semi").where(F.col(text_col).isNotNull()).select(*keys, adif_parts(F.col(text_col)).alias("p"))
    rows = cut.select(*keys, F.posexplode(F.concat(part(F.col("p.header")), F.col("p.records"), part(F.col("p.tail")))).alias("record", "r"), (F.size("p.records") + 1).alias("_tail"))
    # The tail follows the last record: an edit of a record that isn't there must not meet it.
    met = rows.withColumn("record", F.when(F.col("record") < F.col("_tail"), F.col("record")).otherwise(1 << 30)).join(of_record, [*keys, "record"], "left")
    scanned = met.withColumn("_spans", spans_of(F.when(F.col("_edits").isNotNull() & (F.col("record") > 0), F.col("r.body"))))
    body = F.when(F.size("_spans") > 0, spliced(F.col("r.body"), F.col("_spans"), F.col("_edits"))).otherwise(F.col("r.body"))
    done = scanned.select(*keys, "record", F.concat(body, "r.end").alias("_text"))
    together = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("record", "_text"))), lambda x: x["_text"]), "")
    changed = done.groupBy(*keys).agg(together.alias(text_col))
    left = files.withColumn("_edited", F.lit(True))
    same = logs.join(left, keys, "left").where(F.col("_edited").isNull() | F.col(text_col).isNull()).drop("_edited")
    return same.unionByName(changed).select(logs.columns)
