"""The corpus pipeline: each stage calls one operator on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsolake.llm import line_dedup, mixing, packing, simhash, toxicity
from qsolake.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic, by models that leave the held-out fold of labels alone, so that what they catch
    there measures them. Null and empty texts count as ordinary and stay, rows that repeat are judged alike, without labels
    all stay; an empty table stays empty, other columns are carried."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels).where("predicted = 0").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated lines cut out, n_chars counted anew. No row goes: a text may become empty, a null one stays
    null; a null id counts as the smallest, rows that repeat an id as documents of their own."""
    kept = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, its smallest id. Null and empty texts are one group; one id with two
    different texts keeps both; of rows equal in id and text any one stays."""
    return simhash.simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as it is drawn. Null sources are one source; texts without words may be drawn or not; a source
    without words gives none; repeated rows are drawn on their own."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences. A null or empty text is its end id alone; rows that repeat are packed each; a very
    long text fills many sequences; an empty table gives no piece; other columns are left out."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learnt models and tokenization aren't expressible in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
