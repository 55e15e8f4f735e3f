"""Mixing sources to target weights by systematic sampling.

A source's weight gives its target in words; its documents then each expect target / source size copies, and a
document is emitted once for every integer that the running sum of expected copies, moved by one random offset,
crosses at it. Within a source the documents are in order of size, so the taken words miss the target by no more
than about one document. As the expectation is the same all over a source, the running sum is the document's
exact rank within it times that expectation: ranks come from one range sort over all sources, whatever their sizes.

Defined cases: a null text has size 0; null sources are a source of their own, the last; a source of size 0 has
target 0 and takes none; repeated rows are documents of their own, those of one id in the order of their text's
hash; a very long text is one document, so its source may miss its target by that much; an empty table gives no
row. Columns of the input that are named like a result column are replaced."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.llm.common import n_words, ranked, written

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
REPEATS = 3
SEED = 7
#: The targets of so many sources are sent to every task; those of more are joined by source.
SENT_SOURCES = 100_000


def offset(seed: int = SEED) -> float:
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, n_docs, source_size), one row a source, with its target.

    Filling up by weight, with the excess over a cap shared again, ends at min(cap, level * weight) for one level:
    the sources that are capped are those with the smallest cap per weight, so the level follows from running sums."""
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * repeats
    order = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("number", number).withColumn("weight", weight).withColumn("cap", cap)
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))))
        .withColumn("target", F.least("target", "cap"))
    )


def mix_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    seed: int = SEED,
    carry: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken; with carry also the whole row as a struct _row."""
    carried: list[Column] = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("hash"), *carried
    )
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("hash")]
    rows = ranked(slim, order, "mixing")
    sizes = written(rows.groupBy("source").agg(F.min("_rank").alias("first"), F.sum("size").alias("source_size")), "source-sizes")
    chosen = targets(sizes, weights, repeats).select(
        F.col("source").alias("_source"), "source_size", "target", "first",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(repeats)))).otherwise(0.0).alias("expected"),
    )
    if sizes.count() <= SENT_SOURCES:
        chosen = F.broadcast(chosen)
    place = F.col("_rank") - F.col("first")
    crossed = lambda n: F.floor(F.col("expected") * n + offset(seed))
    return (
        rows.join(chosen, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("copies", F.least(crossed(place + 1) - crossed(place), F.lit(repeats)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "size", "source_size", "target", "copies", "taken", *[c for c in ["_row"] if carry])
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as it is drawn, with the columns of docs."""
    drawn = mix_counts(docs, carry=True, **options).where("copies > 0")
    return drawn.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
