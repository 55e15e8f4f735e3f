"""Groups of rows that pairs connect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 100


def checkpoints(spark: SparkSession) -> None:
    """See that checkpoints have a folder: spark.checkpoint.dir, else (in local mode only) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="contacts-"))


def components(pairs: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """id, component: every row of a pair with the smallest id that pairs lead to from it.

    In turn, each row's greater neighbours and then its smaller ones are hung on the smallest of them, until nothing
    changes: the number of rounds grows with the logarithm of the longest chain. Every round is checkpointed; the driver
    sees one count and one sum of it. Pairs with a null or of a row with itself connect nothing; without pairs there is no row."""
    checkpoints(pairs.sparkSession)
    links = pairs.select(F.greatest(first, second).alias("high"), F.least(first, second).alias("low")).where(F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col(first) != F.col(second)))
    links, seen = links.distinct().checkpoint(), None
    for _ in range(ROUNDS):
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        ways = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        root = ways.groupBy(F.col("high").alias("id")).agg(F.min("low").alias("low")).select("id", F.least("id", "low").alias("root"))
        up = ways.join(root, F.col("high") == F.col("id")).where(F.col("low") > F.col("id")).select(F.col("low").alias("high"), F.col("root").alias("low")).distinct()
        root = up.groupBy(F.col("high").alias("id")).agg(F.min("low").alias("root"))
        down = up.join(root, F.col("high") == F.col("id")).where(F.col("low") != F.col("root")).select(F.col("low").alias("high"), F.col("root").alias("low"))
        links = down.unionByName(root.select(F.col("id").alias("high"), F.col("root").alias("low"))).distinct().checkpoint()
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    tops = links.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct()
    return links.select(F.col("high").alias("id"), F.col("low").alias("component")).unionByName(tops)
