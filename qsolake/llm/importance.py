"""Quality by importance resampling.

Words and pairs of neighbouring words are hashed into BUCKETS. A target model counts the buckets in labelled good
documents, a raw model in all documents. A document's log_ratio is the log of its likelihood under the target model
over that under the raw one, the sum of its n-grams' log ratios. Its log_weight is that ratio tempered to the power
of SHARPNESS over the number of n-grams, as whole ratios of long texts would leave short ones no chance. Documents
are then drawn without replacement by the Gumbel top-k: the k largest of log_weight + Gumbel noise, the noise a hash
of the id. k is the share of good rows among the labelled ones, of all documents. The k-th place is found by an exact
rank over a range sort, not by sending k rows anywhere.

The target model is fitted on at most TARGET labelled documents; raw counts, weights and ranks cover everything.

Defined cases: a null or empty text has weight 0; a null id has noise of its own hash, and is drawn like any other;
repeated rows have equal keys and fall next to each other; without good labels all weights are 0; an empty table
gives no row; a very long text counts whole; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qsolake.llm.common import ranked, short_batches, tidied, written
from qsolake.llm.toxicity import held_out

BUCKETS = 1 << 14
TARGET = 10_000
SHARPNESS = 40.0
SMOOTHING = 1.0


class Hashes(dict):
    """word -> 64-bit hash; at most SIZE words are kept."""

    SIZE = 300_000

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word) >> 1
        if len(self) >= self.SIZE:
            self.clear()
        self[word] = value
        return value


def buckets(text: str | None, hashes: Hashes) -> np.ndarray:
    words = (text or "").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]
    return (np.concatenate([h, pairs ^ (pairs >> np.uint64(31))]) % np.uint64(BUCKETS)).astype(np.int64)


def counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets: each task adds up its own, BUCKETS rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = Hashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(buckets(text, hashes), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for row in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def importance_weights(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """doc_id, log_ratio, log_weight of every document, and the share of good rows among the labelled ones."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = known.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    share = marks.agg(F.avg(F.col("good").cast("double"))).first()[0]
    chosen = marks.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET).select("doc_id")
    rows = short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    target = counts(rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text"))
    raw = counts(rows.select("text"))
    ratios = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)) - np.log(
        (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    )
    if not target.sum():
        ratios[:] = 0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            sums, weights = [], []
            for text in batch.column(1).to_pylist():
                own = buckets(text, hashes)
                sums.append(float(ratios[own].sum()))
                weights.append(sums[-1] * SHARPNESS / max(len(own), 1))
            columns = [batch.column(0), pa.array(sums, pa.float64()), pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "log_ratio", "log_weight"])

    return rows.mapInArrow(tidied(weigh), "doc_id long, log_ratio double, log_weight double"), 1.0 if share is None else share


def importance_resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, **columns) -> DataFrame:
    """doc_id, log_ratio, log_weight, gumbel_key, kept: the share of documents with the largest keys."""
    weighed, good = importance_weights(docs, labels, **columns)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    # Written first: the sort by ranges reads its rows twice, and the texts are to be weighed once.
    rows = ranked(written(keyed, "importance-weights"), [F.col("gumbel_key").desc(), F.col("doc_id")], "importance")
    k = round((good if share is None else share) * rows.count())
    return rows.withColumn("kept", F.col("_rank") < k).drop("_rank")
