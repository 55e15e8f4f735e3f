"""Ranked lexical search: postings as a term-bucketed DataFrame, integer scores, sums by item and document, top k.

A task turns its documents, some TERMS_AT_ONCE terms at a time, into posting lists: one row for a term of such a batch, with
the documents that hold it, how often, and how long they are. Lists are dealt to buckets by the hash of their term;
those of terms that many documents of the batch hold are dealt by their batch too, so a term that is in every document
fills no bucket, and no list is longer than a batch. Sorted by bucket and written, they are the index; it may be searched
any number of times.

A search joins the items' terms to the lists (sent to the tasks while there are at most SENT_TERMS of them, else joined by
term), adds up how many documents hold each, scores every posting once in 64-bit integers, brings the lists of a batch
together, and sums by item and document there, so that the sums are whole before they leave their task. Of the window
over an item's documents Spark keeps k rows of each task before it shuffles.

Defined cases: a null or empty text has no term and is never found, nor counted; items of null or empty text give no row;
rows that repeat an item's id are one item with the terms of all; rows that repeat a document's id are documents of their
own, each counted and ranked; a null id is an id as any other, ranked before all others of equal score; a very long text is
read whole; without documents or items there is no row. Other columns are left out. docs must come from files or another
source that gives the same rows in the same order when a lost task reads it again, as rows are numbered while they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.llm.common import lower_ascii, short_batches, tidied, written

#: Letters and digits of ASCII and all other characters beyond ASCII make terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Buckets into which terms are hashed; a bucket is what a lookup of one term reads.
BUCKETS = 1024
#: A list of more documents than this is dealt by its batch too.
LONG_LIST = 32
#: Rows (term, items) that are sent to the tasks at most.
SENT_TERMS = 200_000
K = 10
#: The term of the lists that hold every document of a batch with a term.
ALL = ""
#: counts: how often the document holds the term, shifted by 32 bits, and how many terms it has.
LISTS = "term string, batch long, n_docs int, ids array<long>, counts array<long>"
#: Lists in an Arrow batch that goes back to Spark.
AT_ONCE = 20_000
#: Terms that are inverted together; a longer text is taken whole.
TERMS_AT_ONCE = 2_000_000


def _bytes() -> bytes:
    """For each byte of UTF-8 what it becomes: part of a term, lower-cased, or a blank."""
    kept = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
    return bytes(b if b in kept else b + 32 if b + 32 in kept and 65 <= b <= 90 else 32 for b in range(256))


class Numbers(dict):
    """term -> its number, in the order of first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = made = len(self)
        return made


class Batch:
    """Documents that are inverted together."""

    def __init__(self):
        self.numbers, self.found, self.n, self.rows, self.ids, self.size = Numbers(), [], [], [], [], 0

    def add(self, row: int, doc_id: int | None, terms: list[bytes]) -> None:
        self.found.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms)))
        for values, value in ((self.n, len(terms)), (self.rows, row), (self.ids, doc_id)):
            values.append(value)
        self.size += len(terms)

    def lists(self) -> Iterator[pa.RecordBatch]:
        """The posting lists; rows that repeat an id get lists of their own, so that a list's batch and id name one row."""
        n, words = np.array(self.n, np.int64), np.concatenate(self.found)
        seen: dict = {}
        again = np.array([seen[x] for x in self.ids if not seen.update({x: seen.get(x, -1) + 1})])
        names, ids = pa.array(list(self.numbers), pa.binary()), pa.array(self.ids, pa.int64())
        keys, tf = np.unique(words * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
        term, doc = keys // len(n), keys % len(n)
        for k in range(again.max() + 1):
            own = np.flatnonzero(again == k)
            yield self.made(pa.array([ALL.encode()]), self.rows[own[0]], ids, n, np.zeros(len(own), np.int64), own, np.ones(len(own), np.int64))
            there = again[doc] == k
            t, d, c = (term, doc, tf) if there.all() else (term[there], doc[there], tf[there])
            ends = np.searchsorted(t, np.arange(0, len(names) + AT_ONCE, AT_ONCE))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if a < b:
                    yield self.made(names, self.rows[own[0]], ids, n, t[a:b], d[a:b], c[a:b])

    @staticmethod
    def made(names: pa.Array, batch: int, ids: pa.Array, n: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        offsets = np.append(starts, len(term))
        at = pa.array(offsets.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(term[starts])).cast(pa.string()), pa.array(np.full(len(starts), batch)), pa.array(np.diff(offsets).astype(np.int32)),
             pa.ListArray.from_arrays(at, ids.take(pa.array(doc))), pa.ListArray.from_arrays(at, pa.array(tf << 32 | n[doc]))],
            ["term", "batch", "n_docs", "ids", "counts"],
        )


def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of the documents (row, id, text), some TERMS_AT_ONCE terms at a time."""
    table, now = _bytes(), Batch()
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            if terms := (text.as_py() or b"").translate(table).split():
                now.add(row, doc_id, terms)
            if now.size >= TERMS_AT_ONCE:
                yield from now.lists()
                now = Batch()
    if now.size:
        yield from now.lists()


def postings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs, written to the shared folder: LISTS and the bucket of each."""
    read = short_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    part = F.when(F.col("n_docs") > LONG_LIST, F.col("batch"))
    made = read.mapInArrow(tidied(invert), LISTS).repartition(bucket, part)
    return written(made.withColumn("bucket", bucket).sortWithinPartitions("bucket"), "postings")


def terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Rows (term, items): each term with the items that hold it."""
    found = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(TERM), F.lit(0)))
    pairs = items.select(F.col(item_col).alias("item_id"), F.explode(found).alias("term"))
    held = pairs.groupBy("term").agg(F.collect_set(F.struct("item_id")).alias("items"))
    return held.select("term", F.transform("items", lambda x: x.item_id).alias("items"))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def n_of(counts: Column) -> Column:
    return counts.bitwiseAND(F.lit((1 << 32) - 1))


def search(index: DataFrame, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", k: int = K, sent_terms: int = SENT_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item; all with a score, if fewer."""
    spark = index.sparkSession
    whole = index.where(F.col("term") == ALL).agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + n_of(x))), F.lit(0))
    )
    count, length = whole.first()
    wanted = written(terms(items, item_col, text_col), "item-terms")
    few = wanted.count() <= sent_terms

    def joined(right: DataFrame) -> DataFrame:
        return index.join(F.broadcast(right) if few else right, "term")

    held = joined(wanted.select("term")).groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * count + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = written(wanted.join(held, "term").select("term", "items", weight.alias("w")).where("w > 0"), "item-weights")

    m = F.lit(100 - 90).cast("long") + div(F.lit(90 * count).cast("long") * n_of(F.col("p.counts")), F.lit(max(length, 1)).cast("long"))
    tf = F.shiftright("p.counts", 32)
    score = F.col("w") * div(F.lit(1_000_000_000).cast("long") * tf, 1000 * tf + 8 * m)
    lists = joined(weighed).select("batch", "w", "items", "ids", "counts").repartition("batch")
    scored = (
        lists.select("batch", "w", "items", F.explode(F.arrays_zip("ids", "counts")).alias("p"))
        .select("batch", "items", F.col("p.ids").alias("doc_id"), score.alias("s")).where("s > 0")
        .select("batch", "doc_id", "s", F.explode("items").alias("item_id"))
        .groupBy("batch", "item_id", "doc_id").agg(F.sum("s").alias("score"))
    )
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "batch")
    return (
        scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )
