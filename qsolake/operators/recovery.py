"""Which interpretation of a text table can be exported: a bounded search over the best-scored ones, for every file at once.

The frontier is rows (file, rank): the ATTEMPTS interpretations of the best scores. Each is read in full and held against
the gates of the format. One that reads other source records than the first interpretation, or in another order or number,
is rejected whatever it scores: records are compared by a digest of place and original text, added up for each candidate,
so no file's records come together; contacts are made of the others only. Of these the first without an error is taken, else
the one with the fewest.

Defined cases: a file none of whose interpretations covers its records, and one that is empty, has no errors to compare and
selected is the first one tried or null; equal scores are tried by name; line ends count as equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qsolake.operators import exports
from qsolake.operators.components import checkpoints
from qsolake.sources import guided

ATTEMPTS, MOST = 4, 8
#: Between a file's path and the name of an interpretation.
MARK = "\x1f"


def frontier(candidates: DataFrame, attempts: int = ATTEMPTS, locked: str | None = None) -> DataFrame:
    """The interpretations that are tried, with rank (from 1)."""
    if locked is not None:
        candidates = candidates.where(F.col("candidate") == locked)
    order = Window.partitionBy("path").orderBy(F.desc("score"), "candidate")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, min(MOST, attempts)))


def coverage(sessions: DataFrame) -> DataFrame:
    """path and a digest of its source records, in their order and number."""
    records = sessions.select("path", F.inline(F.transform(F.filter("rows", lambda r: r["kind"] == "qso"), lambda r: F.struct(r["nth"].alias("nth"), r["original"].alias("original")))))
    line = F.replace(F.replace(F.coalesce("original", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    one = lambda salt: F.xxhash64("nth", line, F.lit(salt))
    return records.groupBy("path").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(one("a").cast("decimal(38,0)")).alias("sum"), F.bit_xor(one("b")).alias("xor")).alias("digest")
    )


def recover(
    files: DataFrame, format: str, metadata: DataFrame | None = None, *, attempts: int = ATTEMPTS, locked: str | None = None, date_order: str = "auto"
) -> DataFrame:
    """path, selected (an interpretation), errors and warnings of it, tried (rank, candidate, errors, warnings, rejected; in
    order) and reason: validated, user-mapping-locked or review-required. files are (path, text), metadata as for exports."""
    checkpoints(files.sparkSession)
    tried = frontier(guided.interpretations(files), attempts, locked).checkpoint()  # small rows, which all that follows asks for
    own = F.concat_ws(MARK, "path", "candidate")

    def opened(some: DataFrame) -> DataFrame:
        texts = files.join(some.select("path", "candidate"), "path").select(own.alias("path"), "text")
        return guided.sessions(texts, some.withColumn("path", own))

    keyed = tried.select(own.alias("key"), "path", "candidate", "rank")
    by_rank = Window.partitionBy("path").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rejected = ~F.col("digest").eqNullSafe(F.first("digest").over(by_rank))
    covered = keyed.join(coverage(opened(tried)).withColumnRenamed("path", "key"), "key", "left").withColumn("rejected", rejected).checkpoint()
    left = tried.join(covered.where(~F.col("rejected") & F.col("digest").isNotNull()).select("path", "candidate"), ["path", "candidate"])
    read = guided.contacts(opened(left), date_order=date_order, repeats=False)
    if metadata is not None:
        metadata = metadata.join(left.select("path", "candidate"), "path").withColumn("path", own)
    found = exports.tallied(read, format, metadata).withColumnRenamed("path", "key")
    rows = covered.join(found, "key", "left").na.fill(0, ["errors", "warnings"])
    # A candidate that reads no record can't be written: the gate of empty files has no file to find.
    rows = rows.withColumn("errors", F.when(F.col("digest").isNull(), F.col("errors") + 1).otherwise(F.col("errors")))
    done = F.min(F.when(~F.col("rejected") & (F.col("errors") == 0), F.col("rank"))).over(Window.partitionBy("path"))
    rows = rows.withColumn("_done", done).where(F.col("_done").isNull() | (F.col("rank") <= F.col("_done")))
    one = F.struct("rank", "candidate", F.when(F.col("rejected"), 1).otherwise(F.col("errors")).cast("long").alias("errors"), F.when(F.col("rejected"), 0).otherwise(F.col("warnings")).cast("long").alias("warnings"), "rejected")
    best = F.min_by("candidate", F.when(~F.col("rejected"), F.struct("errors", "rank")))
    made = rows.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("tried"), best.alias("selected"), F.max("_done").alias("_done"))  # MOST at most
    chosen = F.get(F.filter("tried", lambda t: t["candidate"] == F.col("selected")), F.lit(0))
    otherwise = F.lit("user-mapping-locked" if locked is not None else "review-required")
    return made.select("path", "selected", chosen["errors"].alias("errors"), chosen["warnings"].alias("warnings"), "tried", F.when(F.col("_done").isNotNull(), "validated").otherwise(otherwise).alias("reason"))
